"""A key index of the append-only tables: the ids each batch stored, in folders by hash bucket.

    {output}/keys/{table}/batch_id=.../bucket=.../    ids of that batch in that bucket, sorted

A new batch needs to know which of its ids an earlier batch stored. It reads only the buckets its
own ids fall in: the bucket is a partition column, so Spark lists and opens no other folder (the
plan shows it under PartitionFilters). It reads the id column alone, and only of batches entered
in the manifest or the progress table. A batch writes its keys before it is entered, so the keys
of a batch that failed are never read, and storing it again replaces them.

Tables stored before the index existed get the keys of their committed batches written on first
use, batch by batch, so no id of theirs is missed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators import records
from postloom.sources.tables import entered_batches, exists, read_committed

BUCKETS = 256  # about stored ids / 1,000,000 keeps a bucket of one batch near a file of 10 MB


def bucket(key: F.Column, buckets: int = BUCKETS) -> F.Column:
    """The bucket of a key; the key is compared as text."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def folder(output: str, table: str) -> str:
    return f"{output}/keys/{table}"


def write_keys(rows: DataFrame, output: str, table: str, batch_id: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Write the keys of one batch; writing the same batch again replaces them."""
    keys = rows.select(F.col(key).cast("string").alias("id")).where(F.col("id").isNotNull())
    keys = keys.withColumn("bucket", bucket(F.col("id"), buckets))
    target = f"{folder(output, table)}/batch_id={batch_id}"
    keys.repartition("bucket").sortWithinPartitions("id").write.mode("overwrite").partitionBy("bucket").parquet(target)


def _listed(spark: SparkSession, path: str) -> set[str]:
    """Batch ids of the `batch_id=...` folders directly under `path`; a listing of folder names only."""
    if not exists(spark, path):
        return set()
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(hadoop) if status.isDirectory()]
    return {name.split("=", 1)[1] for name in names if name.startswith("batch_id=")}


def backfill(spark: SparkSession, output: str, table: str, schema, buckets: int = BUCKETS) -> None:
    """Write the keys of committed batches of `table` that have none, each from its own folder."""
    missing = _listed(spark, f"{output}/{table}") - _listed(spark, folder(output, table))
    if not missing:
        return
    stored = read_committed(spark, output, table, schema)
    for batch_id in sorted(missing):
        write_keys(stored.where(F.col("batch_id") == batch_id), output, table, batch_id, buckets=buckets)


def bucket_scan(spark: SparkSession, path: str, touched: list[int]) -> DataFrame:
    """The keys under `path` in the buckets `touched`; other bucket folders are pruned, not read."""
    return spark.read.schema("id string, batch_id string, bucket int").parquet(path).where(F.col("bucket").isin(touched))


def stored_keys(spark: SparkSession, output: str, table: str, touched: list[int], batch_id: str | None = None) -> DataFrame:
    """Ids in the buckets `touched` of all committed batches but `batch_id`."""
    path = folder(output, table)
    if not touched or not exists(spark, path):
        return spark.createDataFrame([], "id string")
    keys = bucket_scan(spark, path, touched)
    if batch_id is not None:
        keys = keys.where(F.col("batch_id") != batch_id)
    batches = entered_batches(spark, output)
    if batches is None:
        return keys.select("id").limit(0)
    return keys.join(batches, "batch_id", "left_semi").select("id")


def not_stored(rows: DataFrame, output: str, table: str, batch_id: str, schema, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """Rows (a written table with one row per key) whose key no committed batch of `table` has stored.

    The buckets of the batch are at most `buckets` small numbers and are brought to the driver to
    prune the folders read.
    """
    spark = rows.sparkSession
    backfill(spark, output, table, schema, buckets)
    touched = sorted(r[0] for r in rows.select(bucket(F.col(key), buckets).alias("b")).distinct().collect())
    known = stored_keys(spark, output, table, touched, batch_id).withColumnRenamed("id", "__stored")
    keyed = rows.withColumn("__stored", F.col(key).cast("string"))
    return records.not_stored(keyed, known, "__stored").drop("__stored")
