"""Dump files: which there are, and their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import constants as C
from postloom import schemas
from postloom.functions.names import entity_of, file_name_of, in_months, month_of
from postloom.sources.zstd_source import register


def list_dumps(
    spark: SparkSession, folder: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """One row per dump file under `folder`, pruned by month. File contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", C.DUMP_GLOB)
        .load(folder)
        .select("path", file_name_of(F.col("path")).alias("file_name"), "length")
    )
    name = F.col("file_name")
    return files.where(in_months(name, start, end)).select(
        "path", "file_name", "length", entity_of(name).alias("entity"), month_of(name).alias("month")
    )


def largest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("length"), "path")


def _source() -> list[Column]:
    """Path and name of the file a row comes from, in the plain spelling `list_dumps` uses."""
    plain = lambda name: F.url_decode(F.replace(F.col(name), F.lit("+"), F.lit("%2B")))
    return [plain("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name")]


def read_lines(
    spark: SparkSession, paths: list[str], long_windows: bool = False, spread: int | None = None
) -> DataFrame:
    """`(path, file_name, value)` of all lines of the files, also of a last line without newline.

    A compressed file is read by one task. `spread` hands the lines on to that many partitions when
    the work after reading is worth a shuffle. `long_windows` reads with a decoder that accepts
    frames with a window of up to 2 GiB.
    """
    if not paths:
        return spark.createDataFrame([], schemas.LINES)
    if long_windows:
        register(spark)
        lines = spark.read.format("zstd_lines").option("paths", "\n".join(paths)).load()
    else:
        lines = spark.read.option("lineSep", "\n").text(paths).select(*_source(), "value")
    return lines.repartition(spread) if spread else lines


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same rows as a stream of files arriving in `folder`."""
    reader = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", C.DUMP_GLOB)
        .option("lineSep", "\n")
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.text(folder).select(*_source(), "value")
