"""Operators on urls, vectors and edges, and the pipeline, against brute force."""

import os
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from postloom.llm import embeddings, queries, urls
from postloom.llm.components import connected_components
import test_texts as T

FOLDER = "/root/testdata/sf0.001"


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"), ("block", "com", "/de/x"), ("allow", "com", "/de/x/y"), ("block", "a.b.example.org", "/"), ("allow", "net", ""),
]
URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://EXAMPLE.ORG/es/1", "http://example.org", "http://example.org?x=/es/", "http://x.example.org/en/12#a",
    "http://badexample.org/es/", "http://a.com/de/", "http://a.com/de/x", "http://a.com/de/x/yz", "http://a.com/de/x0", "http://a.com/dd", "http://a.com/fr/", "http://com/fr/é",
    "http://q.a.b.example.org/", "http://b.example.org/en/1", "ftp://z.net", "http://org./x", "http://.org/x", "http://a..org/x", "x://y://z.org/", "http://ÄÖ.org/\n?",
]


def test_urls(spark):
    many = URLS * 3 + [f"https://h{k % 7}.example.{'org' if k % 2 else 'com'}/{'de' if k % 3 else 'es'}/{k}" for k in range(400)]
    pages = spark.createDataFrame([(k, u, "mine", 5) for k, u in enumerate(many)], "page_id long, url string, rule string, key int")
    made = urls.judge_urls(pages.repartition(3), urls.rule_table(spark, RULES))
    assert made.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in made.collect()}
    assert got == {k: brute_rule(u, RULES) for k, u in enumerate(many)}


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = urls.rule_table(spark, RULES).limit(0)
    assert [r.verdict for r in urls.judge_urls(pages, none, default="block").collect()] == ["block"]
    assert urls.judge_urls(pages.limit(0), urls.rule_table(spark, RULES)).collect() == []


def test_url_filter_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = urls.judge_urls(pages, urls.rule_table(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 4), (7, 8), (8, 9), (9, 10), (10, 7), (None, 1), (20, 21), (20, 21)] + [(30, k) for k in range(31, 60)] + [(k, k + 1) for k in range(100, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 20: 20, 21: 20} | {k: 7 for k in range(7, 11)} | {k: 30 for k in range(30, 60)} | {k: 100 for k in range(100, 161)}
    assert got == want


def vectors():
    random = np.random.default_rng(3)
    rows = [random.standard_normal(16) for _ in range(150)]
    centre = random.standard_normal(16)
    rows += [centre + 0.05 * random.standard_normal(16) for _ in range(120)]
    rows += [rows[0], rows[0], 2 * rows[1], -rows[2]]
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 15]
    return [list(map(float, np.float32(r))) for r in rows] + bad


@pytest.mark.parametrize("shard", [1000, 40])
def test_embeddings(spark, shard, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD", shard)
    data = vectors()
    table = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(data)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table.repartition(3)).collect()}
    assert len(got) == len(data)
    good = [i for i, v in enumerate(data) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([data[i] for i in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in good])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.97 * near.sum()
    for i in set(range(len(data))) - set(good):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[270].component_id == got[271].component_id == got[0].component_id == 0 and not got[270].kept
    assert got[272].component_id == 1 and got[273].component_id == 273
    assert {got[i].component_id for i in range(150, 270)} == {150}


def test_embeddings_finds_pairs_beside_a_large_group(spark, monkeypatch):
    """One group supplies nearly all links; what is audited has to see the pairs too."""
    monkeypatch.setattr(embeddings, "SHARD", 20)
    monkeypatch.setattr(embeddings, "SAMPLE", 70)
    random = np.random.default_rng(11)
    first = random.standard_normal((300, 64))
    other = random.standard_normal((300, 64))
    other -= first * ((other * first).sum(1) / (first * first).sum(1))[:, None]
    other *= (np.linalg.norm(first, axis=1) / np.linalg.norm(other, axis=1))[:, None]
    group = random.standard_normal(64) + 0.02 * random.standard_normal((100, 64))
    data = np.concatenate([first, first + 0.32 * other, group])
    table = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table.repartition(3)).collect()}
    assert sum(got[i].component_id == got[i + 300].component_id for i in range(300)) >= 0.97 * 300
    assert len({got[i].component_id for i in range(600, 700)}) == 1


def test_embeddings_of_two_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(table).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 2, 4), (5, 2, 4), (6, 2, 1), (7, 2, 4)]


def test_embeddings_of_nothing(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    same = spark.createDataFrame([(None, [1.0, 0.0]), (None, [2.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in embeddings.near_duplicates(same).collect()) == [(0, 1, False), (0, 1, True), (4, 0, True)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    df = queries.QUERIES[name](spark, FOLDER)
    want = db.sql(queries.ORACLES[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(row[k] for k in order)) for row in want.fetchall())


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= names and "corpus_pipeline" in sys.modules


def test_pipeline_keeps_user_columns(spark, tmp_path):
    """Columns named like results of the operators come out as they went in; an empty table passes every stage."""
    extra = "score double, bits double, rejected string, lang_pred string, n_lines int, n_dropped int, n_words int, n_removed int, Component_ID long"
    values = (0.5, 2.5, "no", "xx", 7, 3, 8, 4, -1)
    rows = [(i, t, "en", *values) for i, t in enumerate(T.make_texts()) if t and any(map(str.isalpha, t))]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, {extra}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", *[c.split()[0] for c in extra.split(", ")]]
        assert {tuple(r)[3:] for r in docs.collect()} <= {values}, name
    empty = spark.createDataFrame([], f"doc_id bigint, text string, lang string, {extra}")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0, name


def test_pipeline(spark, tmp_path):
    """Every stage against brute force on what the stage before it kept."""
    rows = [(i, t, "en" if t and i % 9 else None, "s", len(t or "")) for i, t in enumerate(T.make_texts())]
    rows += [(1000 + k, f"the small dog number {k} sat on that mat and was seen by them all", "en", "s", 60) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "jaccard_join", "substring_dedup", "packing"]

    def step(name, docs):
        made = stages[name](spark, docs, str(tmp_path))
        made.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    def texts(df):
        return sorted((r.doc_id, r.text) for r in df.collect())

    first = step("language_id", kept)
    gone = {r.doc_id for r in kept.collect()} - {r.doc_id for r in first.collect()}
    assert {i for i, t, *_ in rows if not any(map(str.isalpha, t or ""))} <= gone and len(gone) < 12
    second = step("line_dedup", first)
    assert texts(second) == [(i, c.decode()) for i, (_, _, c) in sorted(T.brute_lines(texts(first), 10).items())]
    third = step("jaccard_join", second)
    heads = {i for i, (_, _, head) in T.brute_join(texts(second), 5, 80).items() if i == head}
    assert texts(third) == [(i, t) for i, t in texts(second) if i in heads]
    fourth = step("substring_dedup", third)
    windows = T.brute_windows(texts(third), 20)
    assert texts(fourth) == [(i, windows[i][2].decode() if windows[i][1] else t) for i, t in texts(third)]
    assert first.columns == second.columns == third.columns == fourth.columns == docs.columns
    packed = step("packing", fourth)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in texts(fourth)}
    assert corpus_pipeline.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0] == packed.agg({"length": "sum"}).first()[0]
