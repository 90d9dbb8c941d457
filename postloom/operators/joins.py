"""Lookup joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import materialize

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_FLOOR = 1_000_000  # rows of one key that a task may get, whatever the size of the table


def table_bytes(df: DataFrame) -> int:
    """Upper estimate of the size of a small table: text bytes plus 24 bytes per column and row."""
    width = F.lit(24 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) * 2
    return df.agg(F.sum(width)).first()[0] or 0


def hot_keys(counts: DataFrame, on: list[str], floor: int = HOT_FLOOR) -> DataFrame | None:
    """Keys with more than `floor` rows and the number of salts that leaves each salt about `floor` rows, or None.

    `counts` has the key columns and `n`, the number of rows per key. The rows per salted key do
    not grow with the table; the number of hot keys is at most its rows over `floor`.
    """
    most = counts.agg(F.max("n")).first()[0]
    if (most or 0) <= floor:
        return None
    salts = F.ceil(F.col("n") / floor).cast("int")
    return materialize(counts.where(F.col("n") > floor).select(*on, salts.alias("_salts")))


def small(df: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if its measured size allows it, else as it is."""
    return F.broadcast(df) if table_bytes(df) <= broadcast_bytes else df


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: str | list[str],
    spread_by: str,
    how: str = "inner",
    counts: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Join `rows` with `table`, which has one row per key and is read several times.

    The table is broadcast only if its measured size is under `broadcast_bytes`. Beyond that both
    sides are shuffled, and keys with more than `floor` rows are spread over several salts derived from `spread_by` (a column of `rows` that varies within a key). `counts` gives
    the rows per key (key columns and `n`) where the caller knows them already.
    """
    on = [on] if isinstance(on, str) else on
    if table_bytes(table) <= broadcast_bytes:
        return rows.join(F.broadcast(table), on, how)
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count("*").alias("n"))
    hot = hot_keys(counts, on, floor)
    if hot is None and how == "inner":
        return rows.join(table, on, how)
    salt = F.lit(0).cast("bigint")
    salted_rows, salted_table = rows, table.withColumn("_salt", salt)
    if hot is not None:
        hot = small(hot)
        salted_rows = rows.join(hot, on, "left")
        salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_salts").cast("bigint")), salt)
        last = F.coalesce(F.col("_salts"), F.lit(1)).cast("bigint") - 1
        salted_table = (
            table.join(hot, on, "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
            .drop("_salts")
        )
    # rows without a key match nothing, but an outer join would send all of them to one task
    keyless = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in on])
    if how != "inner":
        missing = rows.where(keyless).count()
        spread = F.pmod(F.xxhash64(spread_by), F.lit(max(1, -(-missing // floor))).cast("bigint"))
        salt = F.when(keyless, spread).otherwise(salt)
    salted_rows = salted_rows.withColumn("_salt", salt).drop("_salts")
    return salted_rows.join(salted_table, [*on, "_salt"], how).drop("_salt")
