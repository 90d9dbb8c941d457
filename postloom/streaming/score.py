"""Prediction for arriving texts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postloom.session import scratch_scope
from postloom.sources.tables import stream_batch_id, write_batch


def stream_predictions(
    model: PipelineModel, texts: DataFrame, output: str, checkpoint: str, keep: tuple[str, ...] = ("id", "text")
) -> StreamingQuery:
    """Write predictions of a stream of `(id, text)` rows; stops when all input has been read.

    Each micro-batch goes through the same transform as a batch table and owns one output folder,
    so a replay writes the same rows to the same place.
    """
    from postloom.plans.train import predict

    def write(batch: DataFrame, batch_number: int) -> None:
        with scratch_scope(batch.sparkSession):
            write_batch(predict(model, batch, keep), output, stream_batch_id(batch, batch_number))

    return (
        texts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
