"""Stored tables and files: batches, datasets, matrices and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom import schemas
from postloom.operators.dataset import fill_text, require_columns

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def read_stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table with its batch column, or an empty one where nothing has been stored yet."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.StringType())])
    if "created_utc" in schema.names:
        full = full.add("month", "string")
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], full)
        raise


def entered_batches(spark: SparkSession, output: str) -> DataFrame | None:
    """Distinct ids of the batches entered in the manifest or the progress table, or None if neither exists."""
    entered = [
        spark.read.schema("batch_id string").parquet(f"{output}/{name}").select("batch_id")
        for name in ("manifest", "progress")
        if exists(spark, f"{output}/{name}")
    ]
    if not entered:
        return None
    batches = entered[0] if len(entered) == 1 else entered[0].unionByName(entered[1])
    return batches.distinct()


def read_committed(spark: SparkSession, output: str, table: str, schema: T.StructType) -> DataFrame:
    """A stored table without the batches of runs that ended before they were entered in the manifest or the progress."""
    stored = read_stored(spark, f"{output}/{table}", schema)
    batches = entered_batches(spark, output)
    if batches is None:
        return stored.limit(0)
    return stored.join(batches, "batch_id", "left_semi").select(*stored.columns)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table with the columns it has."""
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> DataFrame:
    """A database table with the columns it has; filters and columns are pushed to the database."""
    return spark.read.jdbc(url, table, properties=properties or {})


def write_batch(rows: DataFrame, path: str, batch_id: str, month_of: str | None = None) -> None:
    """Write one batch of a table. Writing a batch again replaces it, so a replay changes nothing.

    `month_of` names a timestamp column whose month becomes a partition folder. Rows are rebalanced
    by month first: adaptive execution merges small months into one file and splits large ones.
    """
    target = f"{path}/batch_id={batch_id}"
    if month_of is None:
        rows.write.mode("overwrite").parquet(target)
        return
    # from the day in UTC, whatever the time zone of the session
    day = F.date_from_unix_date(F.floor(F.unix_seconds(month_of) / 86400).cast("int"))
    month = F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("none"))
    rows.withColumn("month", month).hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(target)


def stream_batch_id(batch: DataFrame, number: int) -> str:
    """Name of a micro-batch that stays the same on replay and differs between streams."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"s{query}-{number}"


def write_dataset(df: DataFrame, path: str) -> None:
    """A dataset as Parquet and as CSV next to each other."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{path}/csv")


def read_dataset(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The Parquet form of a dataset; raises ValueError unless it has the columns."""
    return require_columns(spark.read.parquet(f"{path}/parquet"), *columns)


def read_training_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.DATASET_CLEAN) -> DataFrame:
    """A CSV dataset with quotes and line breaks inside fields; null fields become empty text."""
    rows = spark.read.options(**CSV_OPTIONS, multiLine="true", enforceSchema="false").schema(schema).csv(path)
    return fill_text(rows, *schema.names)


def write_lines(lines: DataFrame, path: str, value: str = "value") -> None:
    """Lines as gzip text; there is no zstd codec for writing text."""
    lines.select(F.col(value).cast("string").alias("value")).write.mode("overwrite").option(
        "compression", "gzip"
    ).text(path)


def write_weights(weights: DataFrame, path: str) -> None:
    """A TF-IDF matrix in long form, with zstd-compressed Parquet pages."""
    weights.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_results(path: str, report: DataFrame, confusion: DataFrame) -> None:
    """A classification report and a confusion table, each as Parquet and CSV."""
    write_dataset(report.coalesce(1), f"{path}/report")
    write_dataset(confusion.coalesce(1), f"{path}/confusion")
