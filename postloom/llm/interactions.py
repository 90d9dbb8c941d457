"""Filter interaction audit: five document filters applied in every order, counted per language.

Filters fail a document when it has A: under 200 words, B: fewer than half its words distinct,
C: more than 3 % of its code points in A-Z, D: any of `#$%&*|`, E: the same text as a document of
smaller doc_id anywhere in the table. Words are maximal runs without ASCII white space, compared
case-sensitively; a null text is the empty text.

Method for E: a counting-Bloom prepass. Texts are hashed twice (JVM `xxhash64` with two seeds).
Each input partition turns its hashes into partial sketches, one per hash segment: the sparse
counter positions its keys touch, counted and saturated at 2, with the distinct keys beside them.
Spark deals the partials by segment; each segment's sketches are merged into one counting array,
and every key whose least counter is under 2 is a guaranteed unique text and cleared. Only the
rest, the possible repeats, are looked up again with their full text: grouped by the exact text,
the least doc_id of each text marks all others with E (a text with over a million copies is
joined back in salts). Segments hold about `SEGMENT_KEYS` keys
each, their number grows with the table, and a key repeated a million times arrives at its segment
once per input partition, so no task grows with a hot text.

The five flags form a mask per document. Documents are counted per (part, mask) with their good
and toxic labels, and each of the 32 masks is spread over the 120 orders and five steps, so the
final sums are over at most 32 rows per part and order.

Handling: a null lang forms the part ''. A null doc_id is never smaller than another and never
fails E; repeated rows with the same doc_id and text do not fail E against each other. `labels`
rows with a null doc_id are ignored; several rows of one doc_id count as good (toxic) when any of
them says so. An empty table gives no rows; a part exists when it has documents. Extra columns of
either table are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import map_arrow, mix, prepare, quoted
from postloom.operators.joins import lookup_join, small
from postloom.session import written

# Fixed values of the contract.
LETTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
SYMBOLS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"

SEGMENT_KEYS = 1 << 21  # keys a segment is sized for
COUNTERS_PER_KEY = 8
PROBES = 4

ORDERS = ["".join(p) for p in permutations(LETTERS)]
BIT = {letter: 1 << k for k, letter in enumerate(LETTERS)}

PARTIAL = pa.schema(
    [("segment", pa.int64()), ("positions", pa.binary()), ("counts", pa.binary()), ("h1", pa.binary()), ("h2", pa.binary())]
)


def probes(h1: np.ndarray, h2: np.ndarray, width: int) -> np.ndarray:
    """PROBES counter positions per key (rows), by double hashing of mixed hashes, in [0, width)."""
    a = mix(h1.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    b = mix(h2.view(np.uint64)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((a[:, None] + steps[None, :] * b[:, None]) % np.uint64(width)).astype(np.int64)


def partial_sketches(segments: int, width: int):
    """Per input partition: for each segment, the counters its keys touch (saturated at 2) and its distinct keys."""

    def run(batches):
        h1s, h2s = [], []
        for b in batches:
            if b.num_rows:
                h1s.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                h2s.append(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
        if not h1s:
            return
        keys = np.stack([np.concatenate(h1s), np.concatenate(h2s)], axis=1)
        keys, times = np.unique(keys, axis=0, return_counts=True)
        segment = np.mod(keys[:, 0], segments)
        order = np.argsort(segment, kind="stable")
        keys, times, segment = keys[order], times[order], segment[order]
        cuts = np.flatnonzero(np.diff(segment)) + 1
        for part in np.split(np.arange(len(keys)), cuts):
            if not len(part):
                continue
            k, t = keys[part], times[part]
            spots = probes(k[:, 0], k[:, 1], width)
            where, first = np.unique(spots.ravel(), return_inverse=True)
            counts = np.zeros(len(where), np.int64)
            np.add.at(counts, first, np.repeat(t, PROBES))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(segment[part[0]])], pa.int64()),
                    pa.array([where.astype(np.uint32).tobytes()], pa.binary()),
                    pa.array([np.minimum(counts, 2).astype(np.uint8).tobytes()], pa.binary()),
                    pa.array([k[:, 0].tobytes()], pa.binary()),
                    pa.array([k[:, 1].tobytes()], pa.binary()),
                ],
                schema=PARTIAL,
            )

    return run


def possible_repeats(width: int):
    """Merge a segment's sketches and return the keys whose every counter reached 2."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counters = np.zeros(width, np.uint8)
        for where, counts in zip(frame["positions"], frame["counts"], strict=True):
            spots = np.frombuffer(where, np.uint32).astype(np.int64)
            counters[spots] = np.minimum(counters[spots] + np.frombuffer(counts, np.uint8), 2)
        h1 = np.concatenate([np.frombuffer(x, np.int64) for x in frame["h1"]])
        h2 = np.concatenate([np.frombuffer(x, np.int64) for x in frame["h2"]])
        keys = np.unique(np.stack([h1, h2], axis=1), axis=0) if len(h1) else np.zeros((0, 2), np.int64)
        least = counters[probes(keys[:, 0], keys[:, 1], width)].min(axis=1) if len(keys) else np.zeros(0, np.uint8)
        chosen = keys[least >= 2]
        return pd.DataFrame({"h1": chosen[:, 0], "h2": chosen[:, 1]})

    return run


def repeated_texts(rows: DataFrame, total: int) -> DataFrame:
    """(h1, h2) of all texts that the merged counting sketches cannot clear as unique."""
    segments = max(1, -(-total // SEGMENT_KEYS))
    per_segment = -(-total // segments)
    width = 1 << int(max(10, np.ceil(np.log2(max(per_segment, 1) * COUNTERS_PER_KEY))))
    partials = map_arrow(rows.select("__h1", "__h2"), partial_sketches(segments, width), PARTIAL)
    return partials.groupBy("segment").applyInPandas(possible_repeats(width), "h1 long, h2 long")


def filter_flags(docs: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "lang") -> DataFrame:
    """Per document: its id, part, and the mask of failed filters (bits A=1 ... E=16)."""
    prepare(docs.sparkSession)
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    words = F.filter(F.split(body, SPACE), lambda w: w != "")
    n_chars = F.length(body)
    upper = n_chars - F.length(F.regexp_replace(body, "[A-Z]", ""))
    rows = docs.select(
        quoted(id_col).alias("__id"),
        F.coalesce(quoted(part).cast("string"), F.lit("")).alias("part"),
        body.alias("__text"),
        (
            F.when(F.size(words) < MIN_WORDS, BIT["A"]).otherwise(0)
            + F.when(F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PERCENT, BIT["B"]).otherwise(0)
            + F.when(upper * 100 > n_chars * UPPER_PERCENT, BIT["C"]).otherwise(0)
            + F.when(body.rlike(SYMBOLS), BIT["D"]).otherwise(0)
        ).alias("__mask"),
        F.xxhash64(body).alias("__h1"),
        F.xxhash64(F.lit("second"), body).alias("__h2"),
    )
    rows = written(rows, "interaction-rows")
    total = rows.count()
    suspects = written(repeated_texts(rows, total), "interaction-suspects")
    looked = rows.join(small(suspects.withColumnRenamed("h1", "__h1").withColumnRenamed("h2", "__h2")), ["__h1", "__h2"])
    looked = looked.select("__id", "__h1", "__h2", "__text")
    on = ["__h1", "__h2", "__text"]
    firsts = written(looked.groupBy(*on).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("n")), "interaction-firsts")
    # a text with very many copies is spread over salts of its rows' ids instead of landing in one task
    later = (
        lookup_join(looked, firsts.select(*on, "__first"), on, "__id", counts=firsts.select(*on, "n"))
        .where(F.col("__id") > F.col("__first"))
        .select("__id", "__h1", "__h2")
        .distinct()
        .withColumn("__later", F.lit(True))
    )
    flagged = rows.drop("__text").join(later, ["__id", "__h1", "__h2"], "left")
    mask = F.col("__mask") + F.when(F.col("__later"), BIT["E"]).otherwise(0)
    return flagged.select(F.col("__id").alias("doc_id"), "part", mask.alias("mask"))


def steps() -> F.Column:
    """The 600 (order, step) pairs with the bit of the step's filter and the bits of the filters before it."""
    made = []
    for order in ORDERS:
        for k, letter in enumerate(order):
            earlier = sum(BIT[x] for x in order[:k])
            made.append(F.struct(F.lit(order).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(BIT[letter]).alias("bit"), F.lit(earlier).alias("earlier")))
    return F.array(*made)


def interaction_counts(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row per part, filter order and step with the counts named in the module docstring."""
    flags = filter_flags(docs, text, id_col, part)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    masks = (
        flags.join(marks, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )
    spread = masks.select("part", "mask", "n", "good", "toxic", F.inline(steps()))
    bit, earlier, mask = F.col("bit"), F.col("earlier"), F.col("mask")
    fails = (mask.bitwiseAND(bit)) != 0
    before = (mask.bitwiseAND(earlier)) != 0
    removed = fails & ~before

    def count(condition: F.Column, of: str = "n") -> F.Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")

    sums = spread.groupBy("part", "filter_order", "step", "bit").agg(
        count(mask.bitwiseAND(bit.bitwiseOR(earlier)) == 0).alias("kept"),
        count(removed).alias("removed"),
        count(fails & before).alias("redundant"),
        count(mask == bit).alias("unique_fails"),
        count(removed, "good").alias("good_lost"),
        count(removed, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit")).cast("long")
    return sums.withColumn("shapley", shapley).select(
        "part", "filter_order", F.col("step").cast("int"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
