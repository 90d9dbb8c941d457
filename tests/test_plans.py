"""What the physical plans of the main queries must and must not hold."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "flair_dataset", "label_counts", "record_projection", "line_status_counts", "remove_urls", "tokenize", "remove_stopwords",
    "dedup_keep_first", "comments_per_post", "classification_report", "lemmatize", "tfidf",
])
def test_no_python_workers_and_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    for part in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert part not in text


def test_narrow_queries_do_not_shuffle(spark):
    for name in ("flair_dataset", "record_projection", "remove_urls", "remove_punct", "field_filter_any", "comment_projection"):
        assert "Exchange" not in plan(entry.queries()[name](spark, FOLDER))


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(entry.queries()["label_set"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in text
    text = plan(entry.queries()["confusion_counts"](spark, FOLDER))
    assert "ReadSchema: struct<quality:bigint,toxic:bigint>" in text or "quality" in text and "doc_id" not in text
    text = plan(entry.queries()["comments_per_post"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(turn), EqualTo(turn,0)" in text


def test_tfidf_shuffles_documents_once(spark):
    from postloom.operators import tfidf

    docs = spark.createDataFrame([("1", "some words here"), ("2", "more words")], "id string, text_clean string")
    text = plan(tfidf.tfidf(docs, tfidf.fit_idf(docs)).select(F.col("weight")))
    assert text.count("Exchange hashpartitioning") == 1


def test_months_prune_files(spark, tmp_path):
    from postloom.functions.names import in_months

    for month in range(1, 5):
        spark.createDataFrame([(f"m{month}",)], "value string").coalesce(1).write.text(str(tmp_path / f"RS_2024-0{month}.zst"))
    lines = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path))
    name = F.regexp_extract(F.col("_metadata.file_path"), "(RS_[^/]+)", 1)
    assert sorted(r.value for r in lines.where(in_months(name, "2024-02", "2024-03")).collect()) == ["m2", "m3"]
