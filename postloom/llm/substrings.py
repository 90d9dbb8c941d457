"""Substring deduplication: words covered by a window of words that also starts earlier are removed.

Every window has an anchor, the least hash among the shorter word sequences in it; equal windows
have equal anchors. Runs of windows with one anchor are cut out of the documents as segments, and a
twice-seen Bloom filter of anchors leaves only segments that may repeat. Equal segments become one,
whose first occurrence counts. Different segments with one anchor are dealt into shards of bounded
size; each shard builds an FM-index and streams its segments through backward search, which tells
the windows that occur earlier. Where an anchor has more segments than a shard may hold, they are
spread over shards, and the windows that are first in their shard meet by their hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import bloom, common
from postloom.llm.fmindex import FMIndex
from postloom.llm.pieces import Cache
from postloom.session import written

WORDS_PER_SHARD = 300_000
SEGMENTS_PER_ANCHOR = 5_000  # beyond that an anchor's segments are spread over several shards
MOST_WINDOWS = 32  # of a segment: their marks fit into one number
BYTES_PER_ANCHOR = 32  # a guess that only sizes the filter
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SEGMENTS = pa.schema([
    ("d1", pa.int64()), ("d2", pa.int64()), ("anchor", pa.int64()), ("row", pa.int64()), ("start", pa.int64()),
    ("windows", pa.int32()), ("loops", pa.int32()), ("words", pa.binary()),
])
MARKS = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("mask", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("row", pa.int64()), ("at", pa.int64())])


class Cutter:
    """Cuts documents into runs of windows with one anchor."""

    def __init__(self, window: int):
        self.window = window
        self.length = max(1, window // 2 - 2)  # words of a sequence that may be an anchor
        self.choices = window - self.length + 1  # such sequences in a window
        self.hashes = Cache(xxhash.xxh3_64_intdigest)

    def runs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Anchor, first window and number of windows of each run, and whether windows may repeat within a run."""
        nothing = np.zeros(0, np.int64)
        if len(words) < self.window:
            return np.zeros(0, np.uint64), nothing, nothing, False
        hashes = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        size = len(words) - self.length + 1
        h = np.zeros(size, np.uint64)
        for k in range(self.length):
            h = h * MULTIPLIER + hashes[k : k + size]
        h = common.mix(h)
        loops = any(bool((h[p:] == h[:-p]).any()) for p in range(1, min(self.choices + 1, size)))
        least, covered = h, 1
        while covered < self.choices:
            step = min(covered, self.choices - covered)
            least = np.minimum(least[: len(least) - step], least[step:])
            covered += step
        changes = np.flatnonzero(least[1:] != least[:-1]) + 1
        starts = np.concatenate([[0], changes])
        counts = np.diff(np.concatenate([starts, [len(least)]]))
        if counts.max() > MOST_WINDOWS:
            parts = -(-counts // MOST_WINDOWS)
            number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begun = np.repeat(starts, parts) + number * MOST_WINDOWS
            counts = np.minimum(MOST_WINDOWS, np.repeat(starts + counts, parts) - begun)
            starts = begun
        return least[starts], starts, counts, loops


def _suspects(rows: DataFrame, text: str, window: int) -> DataFrame:
    """Segments whose anchor may occur twice, as occurrences."""
    source = rows.select(common.ROW, common.quoted(text).cast("string").cast("binary"))
    cutter = Cutter(window)

    def hashes_of(b):
        found = []
        for value in common.texts(b.column(1)):
            anchors, _, _, loops = cutter.runs(value.split())
            found += [anchors, anchors] if loops else [anchors]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    size = bloom.text_bytes(rows, text) // BYTES_PER_ANCHOR
    packed = bloom.twice_seen(source, hashes_of, bloom.size_for(size))
    shared = rows.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in SEGMENTS]
            for row, value in zip(b.column(0).to_pylist(), common.texts(b.column(1))):
                words = value.split()
                anchors, starts, counts, loops = cutter.runs(words)
                hit = np.flatnonzero(bloom.contains(shared.value, anchors)) if len(anchors) else []
                if not len(hit):
                    continue
                bodies = [b" ".join(words[s : s + n + window - 1]) for s, n in zip(starts[hit].tolist(), counts[hit].tolist())]
                halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body) for body in bodies), "<i8").reshape(-1, 2)
                for column, part in zip(out, (halves[:, 0], halves[:, 1], anchors[hit].view(np.int64), [row] * len(hit), starts[hit], counts[hit], [int(loops)] * len(hit), bodies)):
                    column.extend(part)
            yield common.batch(SEGMENTS, *out)

    return written(common.map_arrow(source, run, SEGMENTS), "segments")


def _search(dealt: DataFrame, window: int) -> DataFrame:
    """Marks of all segments of the shards: windows that occur earlier in the shard, and hashes of first windows where asked."""

    def search(held: list[tuple]):
        numbers = Cache(lambda word: len(numbers), 1 << 62)
        symbols = [[numbers[w] for w in r[8].split(b" ")] for r in held]
        lengths = np.fromiter(map(len, symbols), np.int64, len(held))
        index = FMIndex(np.concatenate([np.array(s, np.int64) for s in symbols]), lengths)
        windows = np.fromiter((r[6] for r in held), np.int64, len(held))
        owner = np.repeat(np.arange(len(held)), windows)
        place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        later = index.later_matches(index.starts[owner] + place, window)
        masks = np.zeros(len(held), np.int64)
        np.bitwise_or.at(masks, owner[later], np.int64(1) << place[later])
        for k in np.flatnonzero(masks).tolist():
            yield held[k][1], held[k][2], int(masks[k]), None, None, None, None
        for at in np.flatnonzero(~later).tolist():
            k, n = int(owner[at]), int(place[at])
            if held[k][7]:
                words = held[k][8].split(b" ")[n : n + window]
                w1, w2 = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "<i8").tolist()
                yield held[k][1], held[k][2], 1 << n, w1, w2, held[k][3], held[k][4] + n

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for item in zip(*[c.to_pylist() for c in b.columns]):
                if held and held[0][0] != item[0]:
                    yield common.batch(MARKS, *(list(zip(*search(held))) or [[]] * len(MARKS)))
                    held = []
                held.append(item)
        if held:
            yield common.batch(MARKS, *(list(zip(*search(held))) or [[]] * len(MARKS)))

    return written(common.map_arrow(dealt, run, MARKS), "marks")


def repeated_windows(rows: DataFrame, text: str, window: int, words_per_shard: int = WORDS_PER_SHARD, segments_per_anchor: int = SEGMENTS_PER_ANCHOR) -> DataFrame:
    """Windows of `rows` (a table made by `keyed`) that also start earlier: `row`, `start` of a segment and a `mask` of its windows."""
    found = _suspects(rows, text, window)
    bare = found.drop("words")
    first = F.min(F.struct("row", "start")).alias("first")
    distinct = written(
        bare.groupBy("d1", "d2").agg(first, F.min("anchor").alias("anchor"), F.min("windows").alias("windows"), F.max("loops").alias("loops"), F.count(F.lit(1)).alias("n")),
        "distinct",
    )
    anchors = written(
        distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("loops").alias("looped")).where("kinds > 1 OR looped = 1"), "anchors"
    )
    spread = F.ceil(F.col("kinds") / segments_per_anchor)
    doubtful = distinct.join(anchors, "anchor").select(
        "d1", "d2", F.col("first.row").alias("row"), F.col("first.start").alias("start"), "anchor", "windows",
        (spread > 1).alias("spread"), F.pmod(F.col("d1"), spread).alias("salt"),
    )
    doubtful = written(doubtful, "doubtful")
    total = doubtful.agg(F.sum(F.col("windows") + F.lit(window - 1))).first()[0] or 0
    shards = max(1, -(-2 * total // words_per_shard))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // 4)
    bodies = found.select("d1", "d2", "row", "start", "words").join(doubtful, ["d1", "d2", "row", "start"])
    dealt = bodies.select(
        F.pmod(F.xxhash64("anchor", "salt"), F.lit(shards)).alias("shard"), "d1", "d2", "row", "start", "anchor", "windows", "spread", "words"
    ).repartition(parts, "shard").sortWithinPartitions("shard", "row", "start")
    marks = _search(dealt, window)
    # windows of anchors that were spread: all but the first of each kind are marked as well
    apart = marks.where("w1 is not null")
    kinds = apart.groupBy("w1", "w2").agg(F.min(F.struct("row", "at")).alias("least"), F.count(F.lit(1)).alias("n"))
    kinds = written(kinds.where("n > 1").drop("n"), "kinds")
    later = apart.join(kinds, ["w1", "w2"]).where("row <> least.row OR at <> least.at").select("d1", "d2", "mask")
    masks = marks.where("w1 is null").select("d1", "d2", "mask").unionByName(later)
    masks = masks.groupBy("d1", "d2").agg(F.expr("bit_or(mask)").alias("mask"))
    judged = written(distinct.where("n > 1").select("d1", "d2", "first").join(masks, ["d1", "d2"], "full_outer"), "judged")
    every = F.expr("shiftleft(1L, windows) - 1")
    # a segment without `first` here occurs once
    own = F.col("first").isNull() | ((F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start")))
    marked = bare.join(judged, ["d1", "d2"]).select("row", "start", F.when(own, F.coalesce("mask", F.lit(0))).otherwise(every).alias("mask"))
    return marked.where("mask <> 0")


def drop_repeated_passages(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = 20, digests: bool = False,
    words_per_shard: int = WORDS_PER_SHARD, segments_per_anchor: int = SEGMENTS_PER_ANCHOR,
) -> DataFrame:
    """`docs` without the words covered by a window of `window` words that also starts earlier, and `n_words`, `n_removed`.

    Earlier means a smaller id (nulls first, ties by content) or the same document before. Words lie
    between ASCII white space, case counts; windows are judged on the input. A text that loses
    nothing keeps its spacing; otherwise the words left are joined by one space. With `digests` the
    column `kept_sha256` (hex, of the words left joined by one space) takes the place of the text.
    Null texts have no words and stay null. One row per row in; input columns named like a result
    are replaced.
    """
    common.prepare(docs.sparkSession)
    rows = common.keyed(docs, id_col, *[c for c in docs.columns if c != id_col])
    marked = repeated_windows(rows, text, window, words_per_shard, segments_per_anchor)
    gathered = marked.groupBy(F.col("row").alias("__at")).agg(F.flatten(F.collect_list(F.array("start", "mask"))).alias("__marks"))
    joined = rows.join(gathered, rows[common.ROW] == gathered["__at"], "left")
    marks = F.coalesce(F.array_join(F.transform("__marks", lambda x: x.cast("string")), " "), F.lit(""))
    body = F.coalesce(common.quoted(text).cast("string"), F.lit(""))
    packed = joined.withColumn("__packed", F.concat(marks, F.lit("\n"), body)).drop("__at", "__marks", common.ROW)

    def make():
        def one(value: bytes):
            head, _, body = value.partition(b"\n")
            words = body.split()
            covered = np.zeros(len(words) + 1, np.int64)
            numbers = np.array(head.split(), np.int64)
            for start, mask in numbers.reshape(-1, 2).tolist():
                at = start + np.flatnonzero((mask >> np.arange(MOST_WINDOWS)) & 1)
                covered[at] += 1
                covered[at + window] -= 1
            gone = np.cumsum(covered[:-1]) > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if digests or gone.any() else body
            shown = hashlib.sha256(kept).hexdigest() if digests else kept.decode()
            return shown, len(words), int(gone.sum())

        return lambda values: [one(value) for value in values]

    kinds = {"kept_sha256" if digests else "__kept": pa.string(), "n_words": pa.int64(), "n_removed": pa.int64()}
    made = common.map_text(packed, "__packed", kinds, make, replace_text=True)
    if digests:
        return made
    kept = F.when(common.quoted(text).isNotNull(), F.col("__kept")).alias(text)
    return made.select(
        *[kept if c == text else common.quoted(c) for c in docs.columns if c not in ("n_words", "n_removed")], "n_words", "n_removed"
    )
