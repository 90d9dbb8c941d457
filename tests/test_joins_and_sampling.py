import hashlib

import pytest
from pyspark.sql import functions as F

from postloom.operators import joins, sampling


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_a_hot_key(spark, how):
    keys = ["hot"] * 700 + [f"k{i % 50}" for i in range(300)] + ["missing"] * 5 + [None] * 40
    rows = spark.createDataFrame([(i, key) for i, key in enumerate(keys)], "id int, key string").repartition(6)
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(50)], "key string, v int")
    expected = rows_of(rows.join(table, "key", how).select("id", "key", "v"))
    for options in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "floor": 10}):
        assert rows_of(joins.lookup_join(rows, table, "key", "id", how, **options).select("id", "key", "v")) == expected
    salted = joins.lookup_join(rows, table, "key", "id", how, broadcast_bytes=0, floor=10)
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()


def test_rows_per_salt_do_not_grow_with_the_input(spark):
    for scale in (1, 2, 50):
        sizes = {"a": 10_000 * scale, "b": 110 * scale, "c": 3}
        counts = spark.createDataFrame(list(sizes.items()), "key string, n bigint")
        hot = {r.key: r["_salts"] for r in joins.hot_keys(counts, ["key"], floor=100).collect()}
        assert set(hot) == {"a", "b"} and all(sizes[key] / salts <= 100 for key, salts in hot.items())
    assert joins.hot_keys(counts, ["key"]) is None


def test_table_size(spark):
    df = spark.createDataFrame([("a" * 1000, 1)] * 10, "k string, v int")
    assert 10_000 < joins.table_bytes(df) < 20_000
    assert joins.table_bytes(df.limit(0)) == 0


LABELS = ["big"] * 331 + ["mid"] * 57 + ["two"] * 2 + ["one"] + ["three"] * 3


def brute_ranks(seed=42):
    ranks = {}
    for label in set(LABELS):
        ids = [str(i) for i, name in enumerate(LABELS) if name == label]
        ids.sort(key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
        ranks |= {i: (rank, len(ids)) for rank, i in enumerate(ids, 1)}
    return ranks


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(str(i), label) for i, label in enumerate(LABELS)], "id string, label string")


def test_rows_without_a_label_are_split_like_a_class(spark):
    df = spark.createDataFrame([(str(i), "a" if i < 50 else None) for i in range(80)], "id string, label string")
    rows = sampling.stratified_split(df, "id", "label").where("is_valid").collect()
    assert sum(r.label == "a" for r in rows) == 10 and sum(r.label is None for r in rows) == 6


@pytest.mark.parametrize("per_bucket", [1_000_000, 20, 1])
def test_split_and_folds(labelled, per_bucket):
    ranks = brute_ranks()
    for parts in (1, 7):
        df = labelled.repartition(parts)
        split = sampling.stratified_split(df, "id", "label", per_bucket=per_bucket).collect()
        assert len(split) == len(LABELS)
        assert {r.id: r.is_valid for r in split} == {i: rank <= (2 * n + 5) // 10 for i, (rank, n) in ranks.items()}
        folds = sampling.stratified_folds(df, "id", "label", 10, per_bucket=per_bucket).collect()
        assert {r.id: r.fold for r in folds} == {i: (rank - 1) % 10 for i, (rank, _) in ranks.items()}


def test_rows_without_a_label_are_kept(spark):
    df = spark.createDataFrame([(str(i), None if i % 3 else "x") for i in range(30)], "id string, label string")
    folds = sampling.stratified_folds(df, "id", "label", 4, per_bucket=2).collect()
    assert len(folds) == 30 and {r.fold for r in folds if r.label is None} == {0, 1, 2, 3}
    assert sampling.stratified_split(df, "id", "label").count() == 30


def test_split_does_not_shuffle_the_rows(labelled):
    plan = sampling.stratified_split(labelled, "id", "label")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_hashed_split_is_close(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("id"))
    share = sampling.hashed_split(df, "id").where("is_valid").count() / 20000
    assert 0.18 < share < 0.22


def test_class_weights(labelled):
    weights = {r.label: r.weight for r in sampling.class_weights(labelled, "label").collect()}
    n, k = len(LABELS), len(set(LABELS))
    assert weights == {label: pytest.approx(n / (k * LABELS.count(label))) for label in set(LABELS)}
    total = sampling.add_weights(labelled, "label", "id").agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(n)
