"""Seeded stratified splits and folds with exact sizes, without gathering a class in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.joins import lookup_join
from postloom.session import materialize

ROWS_PER_BUCKET = 1_000_000


def order_key(id_col: str, seed: int) -> Column:
    """Seeded random order of the rows: md5 of seed and id, then the id."""
    name = F.col(id_col).cast("string")
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), name)), F.lit(":"), name)


def _bucket_digits(rows: int, per_bucket: int) -> int:
    digits = 1
    while rows / 16**digits > per_bucket and digits < 5:
        digits += 1
    return digits


def ranked(
    df: DataFrame, id_col: str, label: str, seed: int = 42, per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add `rank` (1, 2, ... per label in the seeded order) and `label_rows`.

    The leading hex digits of the md5 cut every label into buckets of nearly equal size. Rows are
    numbered within their bucket, and the number of rows in earlier buckets is added from a small
    table of counts. So no task ever sees a whole class.
    """
    keyed = df.withColumn("_key", order_key(id_col, seed))
    digits = _bucket_digits(df.count(), per_bucket)
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, digits))
    sizes = keyed.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    by_label = Window.partitionBy(label)
    offsets = sizes.select(
        F.col(label).alias("_label"),
        F.col("_bucket").alias("_of"),
        (F.sum("_n").over(by_label.orderBy("_bucket")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_label).alias("label_rows"),
    )
    within = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_key"))
    return (
        keyed.withColumn("_within", within)
        .join(offsets, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_of")))
        .withColumn("rank", F.col("_before") + F.col("_within"))
        .select(*df.columns, "rank", "label_rows")
    )


def valid_rows(label_rows: Column, tenths: int = 2) -> Column:
    """Rows of a class that go to the validation part: its share, rounded to the nearest."""
    return F.floor((label_rows * tenths + 5) / 10)


def stratified_split(
    df: DataFrame,
    id_col: str,
    label: str,
    tenths: int = 2,
    seed: int = 42,
    per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add `is_valid`, true for the first rows of every class in the seeded order.

    Only one threshold per class is looked for: counts per bucket tell in which bucket it lies and
    only rows of that bucket are numbered. The table itself is then compared with the thresholds
    and is not shuffled.
    """
    # rows without a label are a class of their own
    name = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    keyed = df.select(name.alias("_label"), order_key(id_col, seed).alias("_key"))
    digits = _bucket_digits(df.count(), per_bucket)
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, digits))
    sizes = keyed.groupBy("_label", "_bucket").agg(F.count("*").alias("n"))
    by_label = Window.partitionBy("_label")
    upto = F.sum("n").over(by_label.orderBy("_bucket"))
    cut = (
        sizes.select(
            "_label", "_bucket", "n", upto.alias("upto"), valid_rows(F.sum("n").over(by_label), tenths).alias("want")
        )
        .where((F.col("want") <= F.col("upto")) & (F.col("want") > F.col("upto") - F.col("n")))
        .select("_label", "_bucket", (F.col("want") - F.col("upto") + F.col("n")).alias("nth"))
    )
    # one row per class
    cut = materialize(cut)
    within = F.row_number().over(Window.partitionBy("_label", "_bucket").orderBy("_key"))
    limits = (
        lookup_join(keyed, cut, ["_label", "_bucket"], "_key")
        .withColumn("within", within)
        .where(F.col("within") == F.col("nth"))
        .select("_label", F.col("_key").alias("_limit"))
    )
    marked = lookup_join(df.withColumn("_label", name), materialize(limits), "_label", id_col, "left")
    inside = F.coalesce(order_key(id_col, seed) <= F.col("_limit"), F.lit(False))
    return marked.select(*df.columns, inside.alias("is_valid"))


def hashed_split(df: DataFrame, id_col: str, hundredths: int = 20, seed: int = 42) -> DataFrame:
    """Add `is_valid` from a hash of the id alone: one narrow pass, class sizes only approximate."""
    return df.withColumn("is_valid", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(100)) < hundredths)


def stratified_folds(
    df: DataFrame, id_col: str, label: str, folds: int = 10, seed: int = 42, per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add `fold`: the rows of every class are dealt out in the seeded order."""
    dealt = ranked(df, id_col, label, seed, per_bucket)
    return dealt.select(*df.columns, ((F.col("rank") - 1) % folds).cast("int").alias("fold"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """`(label, n, weight)` with weight = rows / (classes * rows of the class)."""
    counts = materialize(df.groupBy(label).agg(F.count("*").alias("n")))
    rows, classes = counts.agg(F.sum("n"), F.count("*")).first()
    return counts.select(label, "n", (F.lit(float(rows or 0)) / (F.lit(classes) * F.col("n"))).alias("weight"))


def add_weights(df: DataFrame, label: str, spread_by: str, column: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(column))
    return lookup_join(df, weights, label, spread_by)
