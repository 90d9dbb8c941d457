"""Line deduplication: lines whose key occurs in several documents are dropped from all of them.

A key is a line without ASCII white space at its ends, A-Z lower-cased. Two Bloom filters find the
keys that may occur twice; only those are shuffled, counted per task first, and confirmed exactly
by their SHA-256. Empty keys are never dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import bloom, common
from postloom.session import written

BROADCAST_KEYS = 500_000  # about 60 MB in a Python worker
BYTES_PER_LINE = 64  # a guess that only sizes the filter
COUNTED = pa.schema([("hash", pa.int64()), ("digest", pa.binary()), ("docs", pa.int64()), ("row", pa.int64()), ("line", pa.int32())])
SUSPECTS = 200_000


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip() for line in text.lower().split(b"\n")]


def key_hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def repeated_keys(docs: DataFrame, text: str, row: str | None, min_docs: int) -> tuple[DataFrame, np.ndarray]:
    """Keys found in at least `min_docs` documents with their first place (by `row`, if given), and the filter used."""
    source = docs.select(
        common.quoted(text).cast("string").cast("binary"), (F.col(row) if row else F.lit(0)).cast("bigint").alias("row")
    )

    def distinct(values: list[bytes]) -> list[set[bytes]]:
        return [set(line_keys(value)) - {b""} for value in values]

    def hashes_of(b):
        found = [key_hash(key) for keys in distinct(common.texts(b.column(0))) for key in keys]
        return np.array(found, np.uint64)

    lines = bloom.text_bytes(docs, text) // BYTES_PER_LINE
    packed = bloom.twice_seen(source, hashes_of, bloom.size_for(lines))
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def suspects(batches):
        counts: dict[tuple[int, bytes], list] = {}

        def flush():
            keys, values = list(counts), list(counts.values())
            counts.clear()
            signed = np.array([h for h, _ in keys], np.uint64).view(np.int64)
            yield common.batch(COUNTED, signed, [d for _, d in keys], *[[v[k] for v in values] for k in range(3)])

        for b in batches:
            values, rows = common.texts(b.column(0)), b.column(1).to_pylist()
            keys = [line_keys(value) for value in values]
            flat = [(k, n, key) for k, own in enumerate(keys) for n, key in enumerate(own) if key]
            hashes = np.array([key_hash(key) for _, _, key in flat], np.uint64)
            last: dict = {}
            for at in np.flatnonzero(bloom.contains(shared.value, hashes)) if len(flat) else ():
                k, n, key = flat[at]
                pair = (int(hashes[at]), hashlib.sha256(key).digest())
                if last.get(pair) == k:
                    continue  # a document counts once
                last[pair] = k
                place = (rows[k], n)
                if pair in counts:
                    counts[pair][0] += 1
                    if place < (counts[pair][1], counts[pair][2]):
                        counts[pair][1:] = place
                else:
                    counts[pair] = [1, *place]
            if len(counts) >= SUSPECTS:
                yield from flush()
        if counts:
            yield from flush()

    counted = common.map_arrow(source, suspects, COUNTED).groupBy("hash", "digest")
    confirmed = counted.agg(F.sum("docs").alias("docs"), F.min(F.struct("row", "line")).alias("first"))
    return written(confirmed.where(F.col("docs") >= min_docs), "repeated"), packed


def drop_repeated_lines(
    docs: DataFrame,
    text: str = "text",
    min_docs: int = 10,
    keep: str = "none",
    id_col: str = "doc_id",
    digests: bool = False,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """`docs` without the lines that occur in at least `min_docs` documents, with `n_lines` and `n_dropped`.

    `keep="none"` drops such lines everywhere; `keep="first"` leaves each in the document that comes
    first by `id_col` (nulls first, ties by content). Lines stay in order, joined by a newline. A
    null text reads as one empty line. Every row counts as a document, repeated ones too. With
    `digests` the column `kept_sha256` (hex) takes the place of the shortened text. Input columns
    named like a result are replaced.

    Confirmed keys are broadcast while there are at most `broadcast_keys`; beyond that each document
    is joined with its own repeated keys.
    """
    common.prepare(docs.sparkSession)
    named = docs
    row = None
    many_columns = [c for c in docs.columns if c != id_col]
    if keep == "first":
        named, row = common.keyed(docs, id_col, *many_columns), common.ROW
    confirmed, packed = repeated_keys(named, text, row, min_docs)
    if confirmed.count() <= broadcast_keys:
        return _drop_known(named, text, row, confirmed, keep, digests).drop(common.ROW)
    if row is None:
        numbered = docs.withColumn(common.ROW, F.monotonically_increasing_id())
        named, row = written(numbered, "rows"), common.ROW  # written, so that the numbers hold
    return _drop_joined(named, text, row, confirmed, packed, keep, digests).drop(common.ROW)


def _finish(value: bytes, repeated: Callable[[int, bytes], bool], digests: bool):
    lines = value.split(b"\n")
    kept = [line for n, (line, key) in enumerate(zip(lines, line_keys(value))) if not (key and repeated(n, key))]
    text = b"\n".join(kept)
    shown = hashlib.sha256(text).hexdigest() if digests else text.decode()
    return shown, len(lines), len(lines) - len(kept)


def _kinds(text: str, digests: bool) -> dict:
    return {"kept_sha256" if digests else text: pa.string(), "n_lines": pa.int64(), "n_dropped": pa.int64()}


def _drop_known(docs, text, row, confirmed, keep, digests):
    found = confirmed.select("hash", "digest", "first.row", "first.line").toArrow()
    known: dict[int, list] = {}
    for h, digest, at, line in zip(*[found[c].to_pylist() for c in ("hash", "digest", "row", "line")]):
        known.setdefault(h & 0xFFFFFFFFFFFFFFFF, []).append((digest, at, line))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    first = keep == "first"

    def make():
        keys = shared.value

        def one(value: bytes, at: int | None):
            def repeated(n, key):
                for digest, own, line in keys.get(key_hash(key), ()):
                    if digest == hashlib.sha256(key).digest():
                        return not (first and own == at and line == n)
                return False

            return _finish(value, repeated, digests)

        return one

    if not first:
        def over(values_of=make):
            one = values_of()
            return lambda values: [one(value, None) for value in values]

        return common.map_text(docs, text, _kinds(text, digests), over)
    packed = docs.withColumn("__packed", F.concat(F.lpad(F.hex(F.col(row)), 16, "0"), F.lit(":"), F.coalesce(common.quoted(text).cast("string"), F.lit(""))))

    def over():
        one = make()
        return lambda values: [one(v[17:], int(v[:16], 16) - (1 << 64) * (v[:1] >= b"8")) for v in values]

    made = common.map_text(packed, "__packed", _kinds(text, digests), over, replace_text=True)
    return made if digests else made.select(*[common.quoted(c) for c in common.without(docs, ["n_lines", "n_dropped"])], "n_lines", "n_dropped")


def _drop_joined(docs, text, row, confirmed, packed, keep, digests):
    """Each document with the repeated keys it holds: suspects joined with the confirmed keys, gathered by document."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    schema = pa.schema([("at", pa.int64()), ("hash", pa.int64()), ("digest", pa.binary())])

    def suspects(batches):
        for b in batches:
            values, rows = common.texts(b.column(0)), b.column(1).to_pylist()
            flat = [(at, key) for value, at in zip(values, rows) for key in set(line_keys(value)) - {b""}]
            hashes = np.array([key_hash(key) for _, key in flat], np.uint64)
            hit = np.flatnonzero(bloom.contains(shared.value, hashes)) if len(flat) else []
            chosen = [flat[k] for k in hit]
            yield common.batch(
                schema, [at for at, _ in chosen], hashes[hit].view(np.int64) if len(chosen) else [],
                [hashlib.sha256(key).digest() for _, key in chosen],
            )

    source = docs.select(common.quoted(text).cast("string").cast("binary"), F.col(row).cast("bigint"))
    own = common.map_arrow(source, suspects, schema)
    found = written(own, "suspects").join(confirmed, ["hash", "digest"])
    place = F.when(F.col("first.row") == F.col("at"), F.col("first.line")).otherwise(-1)
    mine = found.select(F.col("at").alias("__at"), F.concat(F.hex("digest"), F.lpad(place.cast("string"), 12, " ")).alias("mark"))
    marks = mine.groupBy("__at").agg(F.array_join(F.collect_list("mark"), "").alias("__marks"))
    first = keep == "first"
    joined = docs.join(marks, docs[row] == marks["__at"], "left").drop("__at")
    head = F.coalesce(F.col("__marks"), F.lit(""))
    body = F.coalesce(common.quoted(text).cast("string"), F.lit(""))
    packed_text = joined.withColumn("__packed", F.concat(head, F.lit("\n"), body)).drop("__marks")

    def over():
        def one(packed_value: bytes):
            head, _, value = packed_value.partition(b"\n")
            lines = {head[k : k + 64]: int(head[k + 64 : k + 76]) for k in range(0, len(head), 76)}

            def repeated(n, key):
                line = lines.get(hashlib.sha256(key).hexdigest().upper().encode()) if lines else None
                return line is not None and not (first and line == n)

            return _finish(value, repeated, digests)

        return lambda values: [one(value) for value in values]

    made = common.map_text(packed_text, "__packed", _kinds(text, digests), over, replace_text=True)
    return made if digests else made.select(*[common.quoted(c) for c in common.without(docs, ["n_lines", "n_dropped"])], "n_lines", "n_dropped")
