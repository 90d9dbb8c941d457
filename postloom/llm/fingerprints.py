"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last eight bytes ends a chunk wherever its low bits are all ones; how many
bits count is chosen from the length so that about 64 chunks arise. A fingerprint is the block size
and two signatures, one character per chunk: one for the block size and one for its double.
Fingerprints whose block sizes are equal or differ by a factor of two are compared by the edit
distance (insertions and deletions) of the signatures made with the same block size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm import common
from postloom.session import written

CHUNKS = 64
HALVINGS = 3  # how often the block size is halved where too few chunks arise
RUN = 7  # signatures without a common run of this length (a third of the shorter one, if less) are unlike
BLOCK = 1 << 22
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
BYTES = (common.mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
Fingerprint = tuple[int, bytes, bytes]


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of the last eight; zero bytes before the first count as nothing."""
    h = BYTES[data]
    factor = np.uint32(0x2C1B3C6D)
    for step in (1, 2, 4):
        wider = h.copy()
        wider[step:] += h[:-step] * factor if len(h) > step else 0
        h, factor = wider, factor * factor
    h ^= h >> np.uint32(15)
    return h * np.uint32(0x297A2D39)


with np.errstate(over="ignore"):
    BYTES[0] = 0


def _level(size: int) -> int:
    """Bits that count: the fewest with which a text of `size` bytes has at most `CHUNKS` chunks or so."""
    return max(1, (-(-size // CHUNKS) - 1).bit_length())


def fingerprint_texts(texts: list[bytes]) -> list[Fingerprint]:
    """Fingerprints (block size exponent and two signatures) of texts, computed in blocks of `BLOCK` bytes."""
    out: list = []
    group, size = [], 0
    for text in texts:
        if len(text) > BLOCK:
            out += _short(group)
            group, size = [], 0
            out.append(_long(text))
            continue
        if size + len(text) > BLOCK:
            out += _short(group)
            group, size = [], 0
        group.append(text)
        size += len(text) + 8
    return out + _short(group)


def _marks(h: np.ndarray, mask) -> tuple[np.ndarray, np.ndarray]:
    """Places where all bits of the mask are ones, and how many low bits are ones there."""
    at = np.flatnonzero((h & mask) == mask)
    after = h[at].astype(np.int64) + 1
    return at, np.log2((after & -after).astype(np.float64)).astype(np.int64)


def _short(texts: list[bytes]) -> list[Fingerprint]:
    if not texts:
        return []
    data = np.frombuffer(b"".join(t + bytes(8) for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 8) - 8
    starts = ends - sizes
    levels = [_level(n) for n in sizes.tolist()]
    with np.errstate(over="ignore"):
        h = rolling(data)
    masks = np.array([(1 << max(1, level - HALVINGS)) - 1 for level in levels], np.uint32)
    at, ones = _marks(h, np.repeat(masks, sizes + 8))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
    out = []
    for k, level in enumerate(levels):
        own = slice(first[k], last[k])
        cuts = at[own] + 1
        bounds = (sums[cuts], sums[starts[k]], sums[ends[k]], cuts[-1] < ends[k] if len(cuts) else sizes[k] > 0)
        out.append(_signatures(level, ones[own], *bounds))
    return out


def _long(text: bytes) -> Fingerprint:
    """The same for one text of more than a block, with the last seven bytes of each block carried on."""
    level = _level(len(text))
    mask = np.uint32((1 << max(1, level - HALVINGS)) - 1)
    ones, sums, total, last = [], [], np.uint64(0), 0
    for start in range(0, len(text), BLOCK):
        before = min(start, 7)
        data = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - start) + before, start - before)
        with np.errstate(over="ignore"):
            h = rolling(data)[before:]
            at, found = _marks(h, mask)
            running = total + np.cumsum(h, dtype=np.uint64)
        ones.append(found)
        sums.append(running[at])
        total = running[-1]
        last = start + int(at[-1]) + 1 if len(at) else last
    return _signatures(level, np.concatenate(ones), np.concatenate(sums), np.uint64(0), total, last < len(text))


def _signatures(level: int, ones: np.ndarray, sums: np.ndarray, start: np.uint64, end: np.uint64, tail: bool) -> Fingerprint:
    """Both signatures from the running sums at possible cuts; `tail`: bytes follow the last of these."""
    least = max(1, level - HALVINGS)
    while level > least and int((ones >= level).sum()) < CHUNKS // 2:
        level -= 1
    made = []
    for bits, most in ((level, CHUNKS), (level + 1, CHUNKS // 2)):
        chosen = ones >= bits
        edges = sums[chosen]
        open_ = tail or (len(ones) and not chosen[-1])  # a chunk without a cut at its end
        if len(edges) >= most:
            edges, open_ = edges[: most - 1], True  # the last character stands for all the rest
        edges = np.concatenate([[start], edges, [end] if open_ else []]).astype(np.uint64)
        with np.errstate(over="ignore"):
            value = common.mix(np.diff(edges))
        made.append(ALPHABET[(value >> np.uint64(58)).astype(np.int64)].tobytes())
    return level, made[0], made[1]


def shown(fingerprint: Fingerprint) -> str:
    level, first, second = fingerprint
    return f"{1 << level}:{first.decode()}:{second.decode()}"


def likeness(left: list[Fingerprint], right: list[Fingerprint]) -> np.ndarray:
    """Likeness (0 to 1) of pairs of fingerprints: 1 if equal, else by the better of the comparable signatures."""
    out = np.fromiter((float(a == b) for a, b in zip(left, right)), np.float64, len(left))
    pairs: list[tuple[int, bytes, bytes]] = []
    for k, (a, b) in enumerate(zip(left, right)):
        if out[k]:
            continue
        if a[0] == b[0]:
            pairs += [(k, a[1], b[1]), (k, a[2], b[2])]
        elif a[0] + 1 == b[0]:
            pairs.append((k, a[2], b[1]))
        elif a[0] == b[0] + 1:
            pairs.append((k, a[1], b[2]))
    if pairs:
        which, first, second = zip(*pairs)
        np.maximum.at(out, np.array(which), signature_likeness(list(first), list(second)))
    return out


def signature_likeness(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """1 minus the share of characters to insert or delete; 0 without a long enough common run.

    The longest common subsequence of all pairs at once, one bit per character of `first`.
    """
    a = np.full((len(first), 64), 255, np.uint8)
    b = np.full((len(first), 64), 254, np.uint8)
    for k, (x, y) in enumerate(zip(first, second)):
        a[k, : len(x)] = np.frombuffer(x, np.uint8)
        b[k, : len(y)] = np.frombuffer(y, np.uint8)
    size_a, size_b = (np.fromiter(map(len, s), np.int64, len(s)) for s in (first, second))
    ones = np.full(len(first), 0xFFFFFFFFFFFFFFFF, np.uint64)
    runs = [np.zeros(len(first), np.uint64) for _ in range(RUN)]
    seen = np.zeros((RUN, len(first)), bool)
    for j in range(int(size_b.max(initial=0))):
        equal = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view("<u8").ravel()
        with np.errstate(over="ignore"):
            common_bits = ones & equal
            ones = (ones + common_bits) | (ones - common_bits)
        for r in range(RUN - 1, 0, -1):
            runs[r] = (runs[r - 1] << np.uint64(1)) & equal
            seen[r] |= runs[r] != 0
        runs[0] = equal
        seen[0] |= equal != 0
    longest = seen.sum(0)
    subsequence = np.bitwise_count(~ones).astype(np.int64)
    both = size_a + size_b
    needed = np.minimum(RUN, np.maximum(2, np.minimum(size_a, size_b) // 3))
    value = 2.0 * subsequence / np.maximum(both, 1)
    return np.where(longest >= needed, np.minimum(value, 1.0), 0.0)


def edited(text: str, following: str) -> str:
    """`text` with its last half replaced by as many characters from the start of `following`, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = [
    ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]


def _compared(texts: list[bytes]) -> list[tuple]:
    """Results of all texts but the last, each with the one after it as its next."""
    decoded = [t.decode() for t in texts]
    changed = [edited(x, y).encode() for x, y in zip(decoded, decoded[1:])]
    own, others = fingerprint_texts(texts), fingerprint_texts(changed)
    near_edited, near_next = likeness(own[:-1], others), likeness(own[:-1], own[1:])
    return [
        (len(d), hashlib.sha256(c).hexdigest(), shown(f), shown(g), float(x), float(y))
        for d, c, f, g, x, y in zip(decoded, changed, own, others, near_edited, near_next)
    ]


def fingerprint_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document the id, its fingerprint, that of its edited text, and its likeness to that and to the next document.

    Documents are ordered by id (nulls first, ties by content), after the last comes the first. Null
    counts as the empty text. One row per row in; other columns are not returned. Documents are
    range-partitioned and sorted once; only the last of each partition needs a text from elsewhere,
    the first of the next one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    common.prepare(spark)
    chosen = docs.select(common.quoted(id_col).alias("doc"), F.coalesce(common.quoted(text).cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = chosen.repartitionByRange(parts, "doc", tie).sortWithinPartitions("doc", tie)
    doc_type = to_arrow_schema(chosen.schema).field("doc").type
    schema = pa.schema([("doc", doc_type), *RESULT, ("part", pa.int64()), ("first", pa.binary()), ("last", pa.binary())])

    def local(batches):
        part, held = TaskContext.get().partitionId(), None
        for b in batches:
            ids, texts = b.column(0).to_pylist(), common.texts(b.column(1))
            if not texts:
                continue
            opening = held is None
            if not opening:
                ids, texts = [held[0], *ids], [held[1], *texts]
            rows = _compared(texts)
            yield common.batch(
                schema, ids[:-1], *(zip(*rows) if rows else [[]] * len(RESULT)), [part] * len(rows),
                [None] * len(rows), [None] * len(rows),
            )
            if opening:
                yield common.batch(schema, [None], *[[None]] * len(RESULT), [part], [texts[0]], [None])
            held = ids[-1], texts[-1]
        if held is not None:
            yield common.batch(schema, [held[0]], *[[None]] * len(RESULT), [part], [None], [held[1]])

    found = written(common.map_arrow(ordered.select("doc", F.col("text").cast("binary")), local, schema), "prints")
    # one row per partition: which partition comes next
    firsts = found.where("first is not null").select("part", "first")
    around = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = found.where("first is not null").select("part").select(
        "part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(around)).alias("next")
    )
    ends = (
        found.where("last is not null").select("doc", "part", "last").join(following, "part")
        .join(firsts.select(F.col("part").alias("next"), "first"), "next").select("doc", "last", "first")
    )
    finished = pa.schema([("doc", doc_type), *RESULT])

    def finish(batches):
        for b in batches:
            pairs = zip(common.texts(b.column(1)), common.texts(b.column(2)))
            rows = [_compared(list(pair))[0] for pair in pairs]
            yield common.batch(finished, b.column(0), *(zip(*rows) if rows else [[]] * len(RESULT)))

    names = [name for name, _ in RESULT]
    done = found.where("n_chars is not null").select("doc", *names)
    return done.unionByName(common.map_arrow(ends, finish, finished)).select(F.col("doc").alias(id_col), *names)
