import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.functions.stages import SmoothTfidf
from postloom.operators import bayes, evaluation, tfidf
from postloom.plans import train as T
from postloom.plans.preprocess import cleaning_model, preprocess_dataset
from postloom.sources import tables
from postloom.streaming.score import stream_predictions

TOPICS = {"a": ["apple", "pear", "plum"], "b": ["bike", "car", "train"], "c": ["cat", "dog", "cow"]}


def corpus(n=90, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.choice("aaabc")
        words = [rng.choice(TOPICS[label] + ["the", "x", "of", f"w{rng.randrange(30)}"]) for _ in range(rng.randint(0, 12))]
        rows.append((f"d{i}", label, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "id string, label_post string, text_clean string").repartition(4)


def dense(rows, fitted=None):
    """TF-IDF by hand; `fitted` is the (vocabulary, idf) of another set of rows."""
    texts = [[w for w in row[2].split() if len(w) > 1] for row in rows]
    if fitted is None:
        vocab = sorted({w for t in texts for w in t})
        df = np.array([sum(w in t for t in texts) for w in vocab])
        fitted = vocab, np.log((1 + len(texts)) / (1 + df)) + 1
    vocab, idf = fitted
    x = np.array([[t.count(w) for w in vocab] for t in texts]) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0), fitted


def test_tfidf_in_both_forms(spark, docs):
    x, (vocab, _) = dense(corpus())
    expected = {(row[0], w): x[i, j] for i, row in enumerate(corpus()) for j, w in enumerate(vocab) if x[i, j]}
    idf = tfidf.fit_idf(docs)
    for options in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "floor": 5}):
        got = {(r.id, r.term): r.weight for r in tfidf.tfidf(docs, idf, **options).collect()}
        assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    model = SmoothTfidf().fit(docs)
    terms = model.stages[1].vocabulary
    for r in model.transform(docs).collect():
        got = {(r.id, terms[i]): v for i, v in zip(r.features.indices, r.features.values)}
        assert got == {k: pytest.approx(v) for k, v in expected.items() if k[0] == r.id}
    assert [r.term for r in tfidf.vocabulary(docs).collect()] == vocab
    with pytest.raises(ValueError, match="vocabulary"):
        SmoothTfidf(maxVocabulary=5).fit(docs)


def test_wide_matrix(docs):
    wide = tfidf.wide_matrix(tfidf.tfidf(docs, tfidf.fit_idf(docs)), 4)
    assert len(wide.columns) == 5 and wide.where("isnull(the)").isEmpty()


def gaussian(rows, test, smoothing):
    x, fitted = dense(rows)
    z, _ = dense(test, fitted)
    labels = sorted({row[1] for row in rows})
    y = np.array([row[1] for row in rows])
    eps = smoothing * x.var(axis=0).max()
    scores = []
    for label in labels:
        part = x[y == label]
        m, v = part.mean(axis=0), part.var(axis=0) + eps
        scores.append(math.log(len(part) / len(x)) - 0.5 * np.log(2 * np.pi * v).sum() - 0.5 * ((z - m) ** 2 / v).sum(axis=1))
    return {row[0]: labels[i] for row, i in zip(test, np.argmax(np.array(scores), axis=0))}


def test_gaussian_bayes(spark, docs):
    rows, test = corpus(), corpus(60, seed=9)
    fit = bayes.fit_bayes(docs, "label_post")
    assert sorted(r["class"] for r in fit.classes.collect()) == ["a", "b", "c"] and fit.rows == len(rows)
    new = spark.createDataFrame(test, "id string, label_post string, text_clean string")
    values = [1e-9, 1e-7, 1e-2]
    for options in ({}, {"broadcast_bytes": 0, "floor": 5}):
        got = bayes.predict_bayes(fit, new, values, **options).collect()
        for s, value in enumerate(values):
            assert {r.id: r[f"prediction_{s}"] for r in got} == gaussian(rows, test, value)


@pytest.mark.parametrize("kind, grid", [
    ("nb", {"var_smoothing": [1e-9, 1e-2]}),
    ("svm", {"c": [1.0, 0.1], "tol": [1e-3], "iterations": [10]}),
    ("rf", {"trees": [8], "depth": [None, 4], "min_split": [2], "min_leaf": [1]}),
])
def test_train_save_load_predict(spark, docs, tmp_path, kind, grid):
    out = str(tmp_path / kind)
    raw = docs.withColumnRenamed("text_clean", "text")
    cleaned, cleaning = preprocess_dataset(raw)
    tuned = T.train_and_evaluate(spark, cleaned, kind, out, cleaning, grid, folds=3)
    scores = tuned.scores.collect()
    assert len(scores) == 2 and all(0 <= r.score <= 1 for r in scores)
    best = T.best_scores(tuned.scores).first()
    assert best.score == max(r.score for r in scores) and best.params == str(tuned.best)
    report = {r.label: r for r in tables.read_dataset(spark, f"{out}/report", "label", "f1").collect()}
    assert {"accuracy", "macro avg", "weighted avg"} < set(report)
    assert spark.read.parquet(f"{out}/tfidf").columns == ["id", "term", "weight"]
    model = T.load_model(f"{out}/model")
    texts = spark.createDataFrame([("1", "The APPLE, pear & plum! http://x.y"), ("2", "dog cow cat"), ("3", ""), ("4", "bike train car")],
                                  "id string, text string")
    rows = {r.id: r.prediction for r in T.predict(model, texts, ("id",)).collect()}
    assert set(rows) == {"1", "2", "3", "4"} and set(rows.values()) <= {"a", "b", "c"}
    assert len(T.predict(model, texts.select("text")).collect()) == 4
    texts.repartition(2).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_predictions(model, arriving, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.id: r.prediction for r in spark.read.parquet(str(tmp_path / "out")).collect()} == rows


def test_errors(spark, docs, tmp_path):
    with pytest.raises(ValueError):
        T.build_pipeline("tree")
    with pytest.raises(ValueError):
        T.train_and_evaluate(spark, docs, "tree", str(tmp_path), cleaning_model(None))
    with pytest.raises(Exception):
        T.load_model(str(tmp_path / "missing"))


def test_default_grids():
    assert [len(T.build_pipeline(kind, 100)[1]) for kind in ("nb", "svm")] == [3, 12]
    maps = T.build_pipeline("rf")[1]
    assert len(maps) == 36 and len(T.parameter_sets("rf")) == 36
    assert len({tuple(sorted((p.name, v) for p, v in m.items())) for m in maps}) == 27  # four pairs of minimums, three leaf sizes


def test_report(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 3 + [("b", "b")] * 2 + [("c", "a")] + [("a", "d")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    rows = {r.label: r for r in evaluation.classification_report(df).collect()}
    assert (rows["a"].precision, rows["a"].recall, rows["a"].support) == (pytest.approx(5 / 6), pytest.approx(5 / 9), 9)
    assert (rows["c"].precision, rows["c"].recall, rows["c"].f1, rows["d"].support) == (0, 0, 0, 0)
    assert rows["accuracy"].f1 == pytest.approx(7 / 12) and rows["macro avg"].recall == pytest.approx((5 / 9 + 1) / 4)
    assert rows["weighted avg"].recall == pytest.approx(7 / 12) and rows["weighted avg"].support == 12
    text = evaluation.report_text(evaluation.classification_report(df)).splitlines()
    assert text[0].split() == ["precision", "recall", "f1-score", "support"] and text[2].split() == ["a", "0.83", "0.56", "0.67", "9"]
    assert text[7].split() == ["accuracy", "0.58", "12"]
    counts = evaluation.confusion_counts(df)
    wide = {r.label: r for r in evaluation.confusion_matrix(counts, ["a", "b", "c", "d"]).collect()}
    assert (wide["a"].a, wide["a"].b, wide["a"].c, wide["a"].d, wide["c"].a) == (5, 3, 0, 1, 1)
    percents = evaluation.confusion_percent(counts).groupBy("label").agg(F.sum("percent").alias("p")).collect()
    assert all(r.p == pytest.approx(100) for r in percents)


def test_dataset_files(spark, tmp_path):
    rows = [("A", 'say "hi", you\nand me'), ("", "x,y"), ("B", ""), ("C", "back\\slash")]
    df = spark.createDataFrame(rows, "label_post string, text_clean string")
    tables.write_dataset(df, str(tmp_path / "d"))
    assert sorted(map(tuple, tables.read_dataset(spark, str(tmp_path / "d"), "text_clean").collect())) == sorted(rows)
    assert sorted(map(tuple, tables.read_training_csv(spark, str(tmp_path / "d" / "csv")).collect())) == sorted(rows)
    with pytest.raises(ValueError):
        tables.read_dataset(spark, str(tmp_path / "d"), "text")
    tables.write_lines(spark.createDataFrame([("one",), ("two",)], "value string"), str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ["one", "two"]
    assert list((tmp_path / "l").glob("*.gz"))
    df.createOrReplaceTempView("some_posts")
    assert tables.read_table(spark, "some_posts").columns == df.columns


def test_training_and_prediction_clean_alike(spark, tmp_path):
    """Words that only the lemma table makes known, repeated and null ids, and as many rows out as in."""
    rows = [(f"{k}", "dog cat walk dogs", "Venting") for k in range(20)] + [(f"r{k}", "paper book link books", "Resources") for k in range(10)]
    raw = spark.createDataFrame(rows, "id string, text string, label_post string")
    cleaned, cleaning = preprocess_dataset(raw)
    T.train_and_evaluate(spark, cleaned, "nb", str(tmp_path / "m"), cleaning, {"var_smoothing": [1e-2]}, folds=2)
    model = T.load_model(str(tmp_path / "m/model"))
    texts = spark.createDataFrame([("a", "dogs dogs dogs"), ("a", "books"), (None, "dog"), (None, None)], "id string, text string")
    got = [(r.id, r.text, r.prediction) for r in T.predict(model, texts, ("id", "text")).collect()]
    assert len(got) == 4
    assert set(got) >= {("a", "dogs dogs dogs", "Venting"), ("a", "books", "Resources"), (None, "dog", "Venting")}


def test_bayes_with_very_many_classes(spark):
    rng = random.Random(7)
    rows = [(f"{k}", f"c{k % 300:03}", f"topic{k % 300} shared " + " ".join(f"w{rng.randrange(40)}" for _ in range(4))) for k in range(900)]
    docs = spark.createDataFrame(rows, "id string, label_post string, text_clean string")
    test = rows[:40] + [("none", "", "unknown"), ("empty", "", "")]
    got = bayes.predict_bayes(bayes.fit_bayes(docs, "label_post"), spark.createDataFrame(test, docs.schema), [1e-2]).collect()
    assert {r.id: r.prediction_0 for r in got} == gaussian(rows, test, 1e-2)
