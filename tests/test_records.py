import pytest
from pyspark.sql import functions as F

from postloom.functions import names
from postloom.operators import records
from postloom.operators.dataset import between_months, flair_dataset, month_start, preview, fill_text
from postloom.session import configure

LINES = [
    ('{"id":"1","subreddit":"MentalHealth","created_utc":1577836800}', "ok", True),
    ('{"id":"2","subreddit":"mentalhealthsupport","created_utc":"1577836800","selftext":null}', "ok", True),
    ('{"id":"3","subreddit":"cats","created_utc":"nonsense"}', "ok", False),
    ('{"id":"4","subreddit":"mentalhealth","created_utc":"nonsense"}', "bad_time", False),
    ('{"id":"5","subreddit":"mentalhealth","created_utc":0,"selftext":"a","author":"","permalink":""}', "ok", True),
    ('{"subreddit":"mentalhealth"}', "missing_id", False),
    ("not json", "bad_json", False),
    ("", "bad_json", False),
    ('{"id":"x"', "bad_json", False),
    ("[1]", "not_object", False),
    ('"text"', "not_object", False),
    ('{"id":"z"}', "missing_field", False),
    ('{"id":"z","subreddit":5}', "non_string_field", False),
    ('{"id":"z","subreddit":null}', "non_string_field", False),
    ('{"id":"6","subreddit":"cats","subreddit":"mentalhealth"}', "ok", True),
    ('  {"id":"7","subreddit":"mentalhealth","author":"[deleted]","permalink":"/r/1","score":3,"num_comments":2}', "ok", True),
    ('{"id":"8","subreddit":"mentalhealth","created_utc":1577836800.9}', "ok", True),
    ('{"id":"9","subreddit":"mentalhealth","created_utc":99999999999999}', "bad_time", False),
]


@pytest.fixture(scope="module")
def marked(spark):
    configure(spark)
    df = spark.createDataFrame([(i, line) for i, (line, _, _) in enumerate(LINES)], "n int, value string")
    return records.mark_matches(records.parse_lines(df), "MentalHealth")


def test_status_and_match(marked):
    rows = marked.orderBy("n").collect()
    assert [(r.line_status, r.matched) for r in rows] == [(s, m) for _, s, m in LINES]


def test_projection(marked):
    rows = {r.id: r for r in records.select_posts(marked.where("matched")).withColumn("t", F.unix_seconds("created_utc")).collect()}
    assert rows["1"].t == 1577836800 and rows["2"].t == 1577836800 and rows["8"].t == 1577836800
    assert rows["1"].selftext == "" and rows["2"].selftext is None and rows["5"].selftext == "a"
    assert rows["5"].t is None and rows["5"].author is None and rows["5"].link is None
    assert rows["7"].author == "u/[deleted]" and rows["7"].link.endswith(".com/r/1")
    assert (rows["7"].score, rows["7"].num_comments, rows["1"].score) == (3, 2, None)


def test_lines_are_parsed_once(marked):
    plan = marked.where("matched").select("n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
    assert "Python" not in plan


def test_filter_modes(spark):
    df = spark.createDataFrame([("MentalHealth",), ("mentalhealthsupport",), ("cats",)], "s string")
    kept = lambda **kw: [r.s for r in df.where(records.matches(F.col("s"), **kw)).collect()]
    assert kept(value="mentalhealth") == ["MentalHealth", "mentalhealthsupport"]
    assert kept(value="mentalhealth", match="exact") == ["MentalHealth"]
    assert kept(value="Cats , mentalhealth") == ["MentalHealth", "cats"]
    assert kept(value="at,support", match="contains") == ["mentalhealthsupport", "cats"]
    for bad in ("", "a,,b"):
        with pytest.raises(ValueError):
            records.matches(F.col("s"), bad)
    with pytest.raises(ValueError):
        records.matches(F.col("s"), "a", "like")


def test_field_names_with_quotes(spark):
    df = spark.createDataFrame([('{"a\'b.c":"Hit"}',)], "value string")
    assert records.parse_lines(df, "a'b.c").first().observed == "hit"


def test_comments(spark):
    line = '{"id":"c1","link_id":"t3_p","parent_id":"t1_c0","author":"[deleted]","created_utc":5,"body":"b","subreddit":"s"}'
    row = records.select_comments(records.parse_lines(spark.createDataFrame([(line,)], "value string"))).first()
    assert (row.id, row.post_id, row.parent_id, row.author, row.body, row.depth) == ("c1", "p", "c0", "[deleted]", "b", None)


def test_keep_first_and_latest(spark):
    rows = [("a", 2, "y", 1), ("a", 1, "z", 2), ("a", 1, "b", 3), ("b", None, "q", 4), ("b", 7, "r", 5)]
    df = spark.createDataFrame(rows, "id string, t int, path string, v int")
    for parts in (1, 3):
        first = records.keep_first(df.repartition(parts), "id", ["t", "path"])
        assert first.columns == df.columns
        assert sorted((r.id, r.v) for r in first.collect()) == [("a", 3), ("b", 5)]
    last = records.latest_state(df.na.drop(), "id", ["t", "v"])
    assert sorted((r.id, r.v) for r in last.collect()) == [("a", 1), ("b", 5)]


def test_months_and_entities(spark):
    files = ["RS_2020-01.zst", "RS_2020-03.zst", "RC_2020-02.zst", "RS_misc.zst", "other_2020-02.zst", "RS_2020-02.txt"]
    df = spark.createDataFrame([(f,) for f in files], "f string")
    kept = df.where(names.is_dump(F.col("f")) & names.in_months(F.col("f"), "2020-01", "2020-02"))
    rows = kept.select("f", names.entity_of(F.col("f")).alias("e"), names.month_of(F.col("f")).alias("m")).collect()
    assert [(r.f, r.e, r.m) for r in rows] == [
        ("RS_2020-01.zst", "submissions", "2020-01"), ("RC_2020-02.zst", "comments", "2020-02"), ("RS_misc.zst", "submissions", "")
    ]
    with pytest.raises(Exception, match="unknown dump file type"):
        df.select(names.entity_of(F.col("f"))).collect()


def test_dataset_bounds_and_nulls(spark):
    start = month_start("2024-01")
    rows = [
        ("edge", None, "body", "mentalhealth", "Venting", start), ("in", None, "body", "mentalhealth", "Venting", start + 1),
        ("null", "t", None, "mentalhealth", "Venting", start + 1), ("gone", "t", "[removed]", "mentalhealth", "Venting", start + 1),
        ("empty", "t", "", "mentalhealth", "Venting", start + 1), ("case", "t", "b", "MentalHealth", "venting", start + 1),
        ("end", "t", "b", "mentalhealth", "Venting", month_start("2024-02")),
    ]
    df = spark.createDataFrame(rows, "id string, title string, selftext string, subreddit string, link_flair_text string, e bigint")
    df = df.withColumn("created_utc", F.timestamp_seconds("e"))
    out = {r.id: r.text for r in flair_dataset(df, "2024-01", "2024-02", keep=("id",)).collect()}
    assert out == {"in": " body", "empty": "t "}
    loose = {r.id for r in flair_dataset(df, "2024-01", "2024-02", ignore_case=True, keep=("id",)).collect()}
    assert loose == {"in", "empty", "case"}
    assert preview(df).count() == 5
    assert df.where(between_months(F.col("created_utc"), None, None)).count() == 7
    assert fill_text(df.where("id = 'null'"), "selftext", "e").first().selftext == ""
