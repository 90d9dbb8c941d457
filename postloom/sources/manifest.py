"""Which files earlier runs have completed, and with which arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import schemas
from postloom.sources.tables import read_stored, write_batch

RUN_TYPE = "split"


def run_args(field: str, value: str, match: str = "auto") -> str:
    """The filter of a run as one text; the mode is named where it is not the usual one."""
    mode = "" if match == "auto" else f" ({match})"
    return f"{field}:{value or None}{mode}"


def read_manifest(spark: SparkSession, output: str) -> DataFrame:
    return read_stored(spark, f"{output}/manifest", schemas.MANIFEST)


def check_args(manifest: DataFrame, args: str, run_type: str = RUN_TYPE) -> None:
    """Refuse to go on with a run that was begun with another filter or of another type."""
    other = manifest.where((F.col("args") != args) | (F.col("type") != run_type)).select("args", "type").first()
    if other:
        raise ValueError(f"stored run has {other.args!r} of type {other.type!r}, not {args!r} of type {run_type!r}")


def pending(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files no earlier run has completed; files that failed or were cut off start anew."""
    done = manifest.where("complete").select(F.col("input_path").alias("path")).distinct()
    return files.join(done, "path", "left_anti")


def append_manifest(rows: DataFrame, output: str, batch_id: str) -> None:
    write_batch(rows, f"{output}/manifest", batch_id)
