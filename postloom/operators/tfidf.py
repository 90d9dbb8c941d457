"""Term statistics and TF-IDF in long form, one row per document and term."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.text import terms
from postloom.operators.joins import BROADCAST_BYTES, HOT_FLOOR, lookup_join
from postloom.session import written


def term_counts(
    docs: DataFrame, id_col: str = "id", text: str = "text_clean", carry: tuple[str, ...] = ()
) -> DataFrame:
    """`(id, term, tf)` plus the small columns in `carry`.

    Documents are placed by id once; whatever groups by document afterwards needs no other shuffle.
    """
    words = docs.select(id_col, *carry, text).repartition(F.col(id_col))
    words = words.select(id_col, *carry, F.explode(terms(F.col(text))).alias("term"))
    return words.groupBy(id_col, *carry, "term").agg(F.count("*").alias("tf"))


def doc_freq(docs: DataFrame, text: str = "text_clean") -> DataFrame:
    """`(term, df)`: the number of documents a term occurs in."""
    words = docs.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"))


def smooth_idf(frequencies: DataFrame, n_docs: int) -> DataFrame:
    """`(term, df, idf)` with idf = ln((1 + n) / (1 + df)) + 1."""
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    return frequencies.withColumn("idf", idf)


def fit_idf(docs: DataFrame, text: str = "text_clean", n_docs: int | None = None) -> DataFrame:
    """The idf table of a corpus, computed once and written down."""
    return written(smooth_idf(doc_freq(docs, text), docs.count() if n_docs is None else n_docs), "idf")


def vocabulary(docs: DataFrame, text: str = "text_clean") -> DataFrame:
    """Distinct terms in order."""
    return docs.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).distinct().orderBy("term")


def tfidf(
    docs: DataFrame,
    idf: DataFrame,
    id_col: str = "id",
    text: str = "text_clean",
    carry: tuple[str, ...] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """`(id, term, weight)` plus `carry`: tf times idf, scaled to length one per document.

    Terms the idf table does not know are ignored, as for texts the model was not fitted on.
    """
    counts = term_counts(docs, id_col, text, carry)
    known = lookup_join(
        counts, idf.select("term", "idf"), "term", id_col, "inner",
        idf.select("term", F.col("df").alias("n")), broadcast_bytes, floor,
    )
    raw = F.col("tf") * F.col("idf")
    length = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(id_col)))
    return known.select(id_col, *carry, "term", (raw / length).alias("weight"))


def wide_matrix(weights: DataFrame, top: int, id_col: str = "id") -> DataFrame:
    """One column per term for the `top` terms of the largest total weight.

    The full matrix has as many columns as the vocabulary has words; the long form is the complete
    result and this is a report on part of it.
    """
    best = weights.groupBy("term").agg(F.sum("weight").alias("total")).orderBy(F.desc("total"), "term").limit(top)
    names = sorted(row.term for row in best.collect())
    return weights.groupBy(id_col).pivot("term", names).agg(F.sum("weight")).na.fill(0.0, names)
