"""Views over the test tables that stand for posts, comments, progress samples and dump lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.progress import running_totals

POSTS_SQL = """
SELECT doc_id, cast(doc_id AS string) AS id,
 CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('Post ', cast(doc_id AS string), ' - gonna share, can''t wait') END AS title,
 CASE WHEN doc_id % 17 = 0 THEN '[deleted]' WHEN doc_id % 19 = 0 THEN '[removed]' WHEN doc_id % 23 = 0 THEN NULL
      ELSE concat(text, ' see https://example.org/p/', cast(doc_id AS string), '?q=1 cannot stop') END AS selftext,
 1704067200 + doc_id * 3600 AS created_epoch,
 CASE WHEN doc_id % 5 = 0 THEN 'MentalHealth' WHEN doc_id % 7 = 0 THEN 'mentalhealthsupport' WHEN doc_id % 11 = 0 THEN 'cats' ELSE 'mentalhealth' END AS subreddit,
 CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN 'Other' WHEN lang = 'en' THEN 'Need Support' WHEN lang = 'fr' THEN 'Venting'
      WHEN lang = 'de' THEN 'Opinion / Thoughts' ELSE 'Sadness / Grief' END AS link_flair_text
FROM documents
"""

THREAD_SQL = """
SELECT concat('c', cast(conv_id AS string), '_', cast(turn AS string)) AS id, concat('p', cast(conv_id AS string)) AS post_id,
 CASE WHEN turn = 0 THEN concat('p', cast(conv_id AS string)) ELSE concat('c', cast(conv_id AS string), '_', cast(cast(floor((turn - 1) / 2) AS bigint) AS string)) END AS parent_id,
 CASE WHEN role = 'system' THEN 'AutoModerator' WHEN turn % 5 = 4 THEN '[deleted]' ELSE role END AS author,
 CASE WHEN turn % 6 = 5 THEN NULL ELSE text END AS body
FROM conversations
"""

PROGRESS_SQL = """
SELECT user_id AS run, event_id AS sample_id, ts,
 sum(cast(floor(value * 1000) AS bigint)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bytes_done,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lines_done, event_type
FROM events
"""

LINES_SQL = """
SELECT event_id,
 CASE WHEN user_id % 40 = 0 THEN 'RS_misc.zst' ELSE concat(CASE WHEN user_id % 4 = 1 THEN 'RC_' ELSE 'RS_' END, '2024-0', cast(user_id % 6 + 1 AS string), '.zst') END AS file_name,
 CASE WHEN event_id % 50 = 0 THEN 'not json' WHEN event_id % 51 = 0 THEN '[1]' WHEN event_id % 53 = 0 THEN '{"id":"x"}' WHEN event_id % 59 = 0 THEN '{"id":"x","subreddit":5}'
      ELSE concat('{"id":"e', cast(event_id AS string), '","subreddit":"', event_type, '","author":"user', cast(user_id AS string), '","created_utc":', cast(1704067200 + event_id AS string),
        ',"permalink":"/r/x/', cast(event_id AS string), '","selftext":', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"hi"' END, ',"score":', cast(event_id % 100 AS string), '}') END AS value
FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    # the text holds JSON braces, so the table is named by a temporary view and not by formatting
    table(spark, sf_dir, source).createOrReplaceTempView(f"postloom_{source}")
    return spark.sql(sql.replace(f"FROM {source}", f"FROM postloom_{source}"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, sf_dir, POSTS_SQL, "documents")
    return view.withColumn("created_utc", F.timestamp_seconds("created_epoch"))


def thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, THREAD_SQL, "conversations")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, LINES_SQL, "events")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`PROGRESS_SQL` without a window over a whole run, which may hold a large share of the rows."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("sample_id"), "ts", "event_type", "value"
    )
    done = running_totals(
        events, "run", ["ts", "sample_id"], {"bytes_done": F.floor(F.col("value") * 1000).cast("bigint")}, "lines_done"
    )
    return done.select("run", "sample_id", "ts", "bytes_done", "lines_done", "event_type")


def spread_few_files(df: DataFrame, by: str) -> DataFrame:
    """Rows of a table with fewer files than the session has cores, spread over all cores.

    A file with a single row group is one task, whatever follows. Work that is heavy per row is
    worth a shuffle then; a table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, F.col(by)) if len(df.inputFiles()) < cores else df
