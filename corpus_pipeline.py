"""The corpus pipeline: documents through five operators, each stage written and read again.

Documents whose language is rejected go; lines that ten documents share go from all of them; of
similar documents (five-word shingles, similarity of 0.8 or more) the first stays; words in passages
of twenty words that also start earlier go; what is left is packed into sequences of 1024 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import language, lines, packing, setjoin, substrings
from postloom.session import written

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


READ = ("doc_id", "text", "lang")  # the columns the stages read; all others only pass through


def _guarded(docs: DataFrame, stage) -> DataFrame:
    """`stage` applied to `docs` with every other column hidden under a reserved name and given back
    unchanged afterwards, so that no result of an operator (`score`, `n_lines`, ...) replaces a
    column of the user's; `n_chars`, if present, is that of the new text."""
    hidden = {c: f"__user{k}" for k, c in enumerate(docs.columns) if c.lower() not in READ}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    made = stage(docs.select(*[quoted(c).alias(hidden.get(c, c)) for c in docs.columns]))
    back = made.select(*[quoted(hidden.get(c, c)).alias(c) for c in docs.columns])
    if "n_chars" in hidden:
        back = back.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those unlike every language of the corpus go."""

    def stage(rows: DataFrame) -> DataFrame:
        model = language.fit(rows)
        return language.identify(rows, model).where("not rejected")

    return _guarded(docs, stage)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _guarded(docs, lambda rows: lines.drop_repeated_lines(rows, min_docs=10))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _guarded(docs, lambda rows: setjoin.drop_similar(rows, size=5, percent=80))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _guarded(docs, lambda rows: substrings.drop_repeated_passages(rows, window=20))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack_documents(docs, path(TOKENIZER), length=1024, ranks_path=path(RANKS))


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_similar),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]
ORACLE_SQL = None  # language models, FM-indexes and tokenizers are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
