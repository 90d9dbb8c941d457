"""Rates and remaining time from series of progress samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import written

KEPT = 40
ROWS_PER_BLOCK = 100_000


def running_totals(
    samples: DataFrame, key: str, order: list[str], totals: dict[str, Column], position: str
) -> DataFrame:
    """Add the position of every row within its series and running totals up to it.

    The rows are range-partitioned by series and order, so a very long series covers many
    partitions. Each partition numbers and sums its own stretch of a series; what lies before it is
    added from a table with one row per series and partition. The range partitioning is
    written down because both steps must see the same partition borders.
    """
    values = {f"_v{index}": column for index, column in enumerate(totals.values())}
    parts = written(
        samples.withColumns(values).repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "parts"
    )
    sums = parts.groupBy(key, "_part").agg(
        F.count("*").alias("_rows"), *[F.sum(name).alias(f"_sum{name}") for name in values]
    )
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.col(key).alias("_series"),
        F.col("_part").alias("_at"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_sum{name}").over(earlier), F.lit(0)).alias(f"_before{name}") for name in values],
    )
    here = Window.partitionBy(key, "_part").orderBy(*order)
    stretch = parts.withColumn("_row", F.row_number().over(here))
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stretch = stretch.withColumns({f"_run{name}": F.sum(name).over(upto) for name in values})
    joined = stretch.join(before, F.col(key).eqNullSafe(F.col("_series")) & (F.col("_part") == F.col("_at")))
    return joined.select(
        *samples.columns,
        (F.col("_row") + F.col("_rows_before")).alias(position),
        *[
            (F.col(f"_run{name}") + F.col(f"_before{name}")).alias(title)
            for name, title in zip(values, totals)
        ],
    )


def in_blocks(rows: DataFrame, position: str, halo: int, size: int = ROWS_PER_BLOCK) -> DataFrame:
    """Cut numbered series into blocks; the last `halo` rows of a block are repeated in the next one.

    Adds `_block` and `_extra` (true for repeated rows). A window over (series, block) then sees
    everything that lies up to `halo` rows back, and no task holds more than one block of a series.
    """
    if halo > size:
        raise ValueError("blocks have to be longer than what they look back on")
    at = F.col(position) - 1
    block = F.floor(at / size)
    repeated = (at % size) >= size - halo
    places = F.when(repeated, F.array(block, block + 1)).otherwise(F.array(block))
    return rows.withColumn("_block", F.explode(places)).withColumn("_extra", F.col("_block") > block)


def rolling_rate(
    samples: DataFrame,
    key: str = "run",
    time: str = "seconds",
    position: str = "position",
    lines: str = "lines_done",
    size_done: str = "bytes_done",
    kept: int = KEPT,
    block_rows: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add `bytes_per_second` and `lines_per_second` against the oldest of the last `kept` samples.

    Byte rates are cut to whole numbers. Where no time has passed the rates are null. `position`
    numbers the samples of a series from 1.
    """
    rated = _rates(in_blocks(samples, position, kept - 1, block_rows), key, time, position, lines, size_done, kept)
    return rated.where(~F.col("_extra")).drop("_block", "_extra")


def _rates(blocks: DataFrame, key: str, time: str, position: str, lines: str, size_done: str, kept: int) -> DataFrame:
    recent = Window.partitionBy(key, "_block").orderBy(position).rowsBetween(-(kept - 1), 0)
    passed = F.col(time) - F.first(time).over(recent)
    size_rate = F.try_divide(F.col(size_done) - F.first(size_done).over(recent), passed)
    line_rate = F.try_divide(F.col(lines) - F.first(lines).over(recent), passed)
    return blocks.withColumns(
        {"bytes_per_second": F.floor(size_rate).cast("bigint"), "lines_per_second": line_rate}
    )


def eta(
    samples: DataFrame,
    totals: DataFrame,
    key: str = "run",
    time: str = "seconds",
    position: str = "position",
    lines: str = "lines_done",
    size_done: str = "bytes_done",
    kept: int = KEPT,
    block_rows: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add `avg_speed` over the last `kept` rates and the whole `seconds_left` at that speed.

    `totals` has `total_bytes` per series. Null rates do not count in the mean; an average speed
    below one byte per second leaves `seconds_left` null.
    """
    halo = 2 * (kept - 1)
    rated = _rates(in_blocks(samples, position, halo, block_rows), key, time, position, lines, size_done, kept)
    recent = Window.partitionBy(key, "_block").orderBy(position).rowsBetween(-(kept - 1), 0)
    speed = rated.withColumn("avg_speed", F.avg("bytes_per_second").over(recent)).where(~F.col("_extra"))
    left = F.try_divide(F.col("total_bytes") - F.col(size_done), F.floor("avg_speed"))
    return (
        speed.drop("_block", "_extra")
        .join(totals.select(F.col(key).alias("_series"), "total_bytes"), F.col(key).eqNullSafe(F.col("_series")))
        .drop("_series")
        .withColumn("seconds_left", F.floor(left).cast("bigint"))
    )


def series_totals(samples: DataFrame, key: str = "run", size_done: str = "bytes_done") -> DataFrame:
    return samples.groupBy(key).agg(F.max(size_done).alias("total_bytes"))
