"""Ingest of arriving dump files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postloom import constants as C
from postloom.functions.names import in_months
from postloom.operators.records import OK
from postloom.plans.ingest import mark, store
from postloom.session import configure, scratch_scope
from postloom.sources.dumps import stream_lines
from postloom.sources.tables import stream_batch_id, write_batch


def stream_ingest(
    spark: SparkSession,
    folder: str,
    output: str,
    checkpoint: str,
    field: str = "subreddit",
    value: str = C.COMMUNITY,
    start: str | None = None,
    end: str | None = None,
    match: str = "auto",
    comment_depth: int | None = None,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Store the dump files of `folder` that are new and stop when all of them have been read.

    The checkpoint remembers the files, so a second run reads only new ones.
    """
    lines = stream_lines(spark, folder, files_per_trigger)
    lines = lines.where(in_months(F.col("file_name"), start, end))
    return ingest_stream(lines, output, checkpoint, field, value, match, comment_depth)


def ingest_stream(
    lines: DataFrame,
    output: str,
    checkpoint: str,
    field: str = "subreddit",
    value: str = C.COMMUNITY,
    match: str = "auto",
    comment_depth: int | None = None,
) -> StreamingQuery:
    """Store a stream of `(path, file_name, value)` rows.

    A replayed micro-batch replaces its own folders. The line counts of each micro-batch are in
    `observedMetrics` of the query progress and in the table `{output}/progress`.
    """
    configure(lines.sparkSession)
    marked = mark(lines, field, value, match).observe(
        "lines",
        F.count(F.lit(1)).alias("lines_processed"),
        F.count_if("matched").alias("lines_matched"),
        F.count_if(F.col("line_status") != OK).alias("error_lines"),
    )

    def write(batch: DataFrame, number: int) -> None:
        batch_id = stream_batch_id(batch, number)
        with scratch_scope(batch.sparkSession):
            counters = store(batch, output, batch_id, field, comment_depth)
            progress = counters.withColumn("batch", F.lit(number)).withColumn("ts", F.current_timestamp())
            write_batch(progress, f"{output}/progress", batch_id)

    return (
        marked.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
