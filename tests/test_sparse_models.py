"""Forest and machines on sparse weights, against plain numpy on dense ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.operators import forest, machine
from postloom.plans import train as T

SCHEMA = "id string, label double, weight double, text_clean string"


def corpus(n, seed=5, own=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 1, 2])
        words = [rng.choice([f"topic{label}x{rng.randrange(3)}", f"noise{rng.randrange(15)}"]) for _ in range(rng.randrange(9))]
        rows.append((None if i % 7 == 0 else "same", float(label), 1.0 + label / 2, " ".join(words + [f"own{i}x{k}" for k in range(own)])))
    return rows


def test_forest_against_plain_numpy(spark):
    rows = corpus(120)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    trees, least = 6, 2
    fit = forest.fit_forest(docs, "label", "weight", "text_clean", trees, 4, least, 42)
    held = forest.numbered(docs)
    sparse = forest.sparse_rows(held, fit.terms, "text_clean").collect()
    nodes = fit.nodes.orderBy("node").collect()
    assert len(nodes) > 3 * trees and any(node.feature >= 0 for node in nodes)
    got = {r._row: r.prediction for r in forest.predict_forest(fit, held, "text_clean").collect()}
    assert len(got) == len(rows)
    for row in sparse:
        cells, total = dict(zip(row.features, row.cells)), np.zeros(3)
        assert list(row.features) == sorted(row.features)
        for node in range(trees):
            while nodes[node].feature >= 0:
                above = cells.get(nodes[node].feature, -(10**9)) >= nodes[node].cell
                node = nodes[node].right - (not above)
            total += nodes[node].shares
        assert got[row._row] == np.argmax(total)
    right = sum(got[row._row] == row.label for row in sparse)
    assert right > sum(row.label == 0 for row in sparse)


def test_best_split_is_the_best_of_its_sums(spark):
    """Gains of all cells of two terms by hand; rows without the term are below every cell."""
    total = np.array([[6, 4]]) * forest.UNIT

    class Shared:
        value = forest.Nodes(np.array([forest.OPEN]), np.zeros(1), np.zeros(1), total, np.array([10]))

    sums = [(0, 7, -3, 0, 1), (0, 7, -1, 1, 3), (0, 9, -2, 0, 2), (0, 9, -2, 1, 1)]
    df = spark.createDataFrame([(*one, one[4]) for one in sums], "node int, feature bigint, cell int, label int, w bigint, n bigint")
    df = df.withColumn("w", F.col("w") * forest.UNIT).coalesce(1)
    found = df.mapInArrow(forest._best_splits(Shared, 1), forest._SPLIT).collect()
    assert [(r.node, r.feature, r.cell, r.n, [w // forest.UNIT for w in r.w]) for r in found] == [(0, 7, -1, 3, [0, 3])]
    assert found[0].gain == pytest.approx(0.48 - 0.7 * (1 - (6 / 7) ** 2 - (1 / 7) ** 2))
    # three rows on the right are too few for four on both sides
    assert df.mapInArrow(forest._best_splits(Shared, 5), forest._SPLIT).collect() == []


def test_forest_reads_the_terms_of_a_row_and_not_the_vocabulary(spark):
    """600 rows of 200 own terms: 120,000 terms, 72 million numbers as dense rows."""
    docs = spark.createDataFrame(corpus(600, own=200), SCHEMA).repartition(4)
    pipeline, maps = T.build_pipeline("rf", 600, {"trees": [5], "depth": [3], "min_split": [2], "min_leaf": [1]})
    (model,) = pipeline.fit(docs, maps[0]).stages
    sparse = forest.sparse_rows(forest.numbered(docs), model.fit.terms, "text_clean")
    assert sparse.agg(F.sum(F.size("features"))).first()[0] < 600 * 210
    out = model.transform(docs)
    assert out.columns == [*docs.columns, "prediction"] and out.count() == 600
    assert out.groupBy("id").count().count() == 2  # null and repeated ids keep their rows


def test_machine_minimizes_the_hinge_loss_of_the_dense_rows(spark):
    rows = corpus(150, seed=8)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    reg = 1 / len(rows)
    fit = machine.fit_machine(docs, "label", "weight", "text_clean", reg, 1e-4, 100)
    held = machine.numbered(docs)
    found = {r.feature: np.array(r.coefs) for r in fit.terms.collect()}
    place = {feature: k for k, feature in enumerate(found)}
    known = {r._row: r for r in held.collect()}
    x, order = np.zeros((len(rows), len(place))), {row: k for k, row in enumerate(known)}
    for r in machine.weights(held, fit.terms, "text_clean").collect():
        x[order[r._row], place[r.feature]] = r.weight
    assert (x.sum(axis=1) == 0).any()  # rows without a term are trained on and predicted
    label = np.array([r.label for r in known.values()])
    weight = np.array([r.weight for r in known.values()])
    coefs, free = np.array(list(found.values())), np.array(fit.intercepts)
    got = {r._row: r.prediction for r in machine.predict_machine(fit, held, "text_clean").collect()}
    margins = x @ coefs + free
    assert [got[row] for row in known] == list(np.argmax(margins, axis=1).astype(float))
    assert np.mean(np.argmax(margins, axis=1) == label) > np.mean(label == 0)
    rng = np.random.default_rng(1)
    for k in range(3):
        sign = np.where(label == k, 1.0, -1.0)

        def loss(w, b):
            return (weight * np.maximum(1 - sign * (x @ w + b), 0)).sum() / weight.sum() + reg / 2 * (w @ w)

        least, w, b = np.inf, np.zeros(len(place)), 0.0
        for turn in range(1, 6001):  # plain subgradient descent from zero
            least = min(least, loss(w, b))
            pull = -weight / weight.sum() * sign * (sign * (x @ w + b) < 1)
            w, b = w - (reg * w + x.T @ pull) / (reg * (turn + 30)), b - 5 * pull.sum() / np.sqrt(turn)
        assert loss(coefs[:, k], free[k]) <= least + 2e-3
        for size in (1e-1, 1e-2):
            for _ in range(40):
                assert loss(coefs[:, k] + size * rng.normal(size=len(w)) / 5, free[k] + size * rng.normal()) > loss(coefs[:, k], free[k]) - 1e-3


def test_machine_sends_numbers_per_row_to_the_driver_and_not_per_term(spark):
    """200 rows of 300 own terms: what reaches the driver is 200 numbers a class, not 60,000."""
    docs = spark.createDataFrame(corpus(200, own=300), SCHEMA).repartition(4)
    pipeline, maps = T.build_pipeline("svm", 200, {"c": [1.0], "tol": [1e-2], "iterations": [3]})
    (model,) = pipeline.fit(docs, maps[0]).stages
    assert len(model.fit.intercepts) == 3 and model.fit.terms.count() > 60_000
    sizes = []

    def product(by_row):
        sizes.append(by_row.shape)
        return by_row

    machine.minimize(product, np.where(np.arange(200)[:, None] % 3 == np.arange(3), 1.0, -1.0), np.ones(200), 0.01, 1e-2, 3)
    assert set(sizes) == {(200, 3)} and len(sizes) <= 4
    assert model.transform(docs).count() == 200
