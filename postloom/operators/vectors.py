"""TF-IDF weights of numbered rows in long form, for the models that are trained on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.joins import lookup_join
from postloom.operators.tfidf import doc_freq, smooth_idf, term_counts
from postloom.session import written


def numbered(df: DataFrame) -> DataFrame:
    """Rows with a number of their own in `_row`, written, so that ids may be null or repeat."""
    return written(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def tasks(df: DataFrame, rows: int, per_task: int) -> int:
    """Tasks for a pass over `rows` rows that is heavy per row: few for small tables, all cores from a
    sixteenth of `per_task` per task on, more for larger ones."""
    cores = 2 * df.sparkSession.sparkContext.defaultParallelism
    return max(min(cores, -(-16 * rows // per_task)), -(-rows // per_task), 1)


def fit_terms(docs: DataFrame, text: str) -> DataFrame:
    """`(term, df, idf, feature)`: the idf table with a number per term, written."""
    frequencies = smooth_idf(doc_freq(docs, text), docs.count())
    return written(frequencies.withColumn("feature", F.monotonically_increasing_id()), "terms")


def weights(docs: DataFrame, terms: DataFrame, text: str, carry: tuple[str, ...] = ("feature",)) -> DataFrame:
    """`(_row, weight)` and the columns `carry` of the term, per row and known term, scaled to length one."""
    known = lookup_join(
        term_counts(docs, "_row", text), terms.select("term", "idf", *carry), "term", "_row", "inner",
        terms.select("term", F.col("df").alias("n")),
    )
    raw = F.col("tf") * F.col("idf")
    length = F.sqrt(F.sum(raw * raw).over(Window.partitionBy("_row")))
    return known.select("_row", *carry, (raw / length).alias("weight"))
