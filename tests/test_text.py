import pytest
from pyspark.sql import functions as F

from postloom.functions import text as X
from postloom.operators import lemmas
from postloom.plans.preprocess import clean_text, preprocess_dataset

WORDS = ["see", "i", "a", "can", "not"]
CASES = [
    ("See https://a.b/c?d=1 now!", "See  now", "now"),
    ("I can't stop self-harm_x", "I cant stop selfharmx", "cant stop selfharmx"),
    ("café ’s naïve", "caf s nave", "caf nave"),
    ("I cannot go, gonna cry", "I cannot go gonna cry", "gon cry"),
    ("HTTP://UP.com x", "HTTPUPcom x", "httpupcom"),
    ("", "", ""),
    ("cannotx xcannot cannot1 CANNOT", "cannotx xcannot cannot1 CANNOT", "cannotx xcannot cannot1"),
    ("gimme gotta lemme wanna", "gimme gotta lemme wanna", "gim got lem wan"),
    ("http://x.y rest \U0001f600 tail", " rest  tail".replace(" ", "", 1), "rest tail"),
]


def test_cleaning_cases(spark):
    df = spark.createDataFrame([(i, case[0]) for i, case in enumerate(CASES)], "id int, text string")
    text = F.col("text")
    plain = X.remove_non_ascii(X.remove_punctuation(X.remove_urls(text)))
    staged = X.remove_short(X.remove_stopwords(X.tokenize(F.lower(plain)), WORDS), 3)
    rows = df.select(
        plain.alias("plain"), X.join_tokens(staged).alias("staged"), X.join_tokens(X.clean_tokens(text, WORDS)).alias("all")
    ).orderBy("id").collect()
    for row, (_, plain_text, tokens) in zip(rows, CASES):
        assert (row.plain, row.staged, row["all"]) == (plain_text, tokens, tokens)


def test_punctuation_is_the_ascii_set(spark):
    import string

    row = spark.createDataFrame([(string.printable + "¿§",)], "text string").select(
        X.remove_punctuation(F.col("text")).alias("t")
    ).first()
    assert row.t == "".join(c for c in string.printable + "¿§" if c not in string.punctuation)


def test_tokenizer_agrees_with_a_plain_reading(spark):
    import random
    import re

    rng = random.Random(5)
    parts = ["cannot", "can", "not", "gonna", "na", "wanna", "x", " ", "  ", "\t", "\x1d", "\x01", "lemme", "1", "\n", "gimme"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = df.select(X.tokenize(F.col("text")).alias("t")).orderBy("id").collect()
    for row, value in zip(rows, texts):
        for head, tail in (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")):
            value = re.sub(rf"\b({head})({tail})\b", r"\1 \2", value, flags=re.A)
        assert row.t == [w for w in re.split(r"[\t-\r\x1c-\x20]+", value) if w]


def test_stopword_lists(spark, tmp_path):
    path = tmp_path / "own.txt"
    path.write_text("  hello \n\nUPPER\nthe\n", encoding="utf-8")
    base = set(X.load_stopwords())
    assert {"the", "i", "don't"} <= base
    assert set(X.load_stopwords("english", str(path))) == base | {"hello", "", "UPPER"}
    assert set(X.load_stopwords("english", str(path), spark)) == base | {"hello", "", "UPPER"}
    assert set(X.load_stopwords("english", str(tmp_path / "none.txt"), spark)) == base
    assert X.load_stopwords("klingon") == []
    assert "der" in X.load_stopwords("german")


def test_value_lists(spark):
    assert X.parse_values(" B,a , b") == ["a", "b"]
    row = spark.createDataFrame([(" B,a , b",)], "v string").select(X.values_of(F.col("v")).alias("v")).first()
    assert row.v == ["b", "a"]


def test_lemmas(spark):
    words = ["cars", "car", "glass", "wolves", "wolf", "boxes", "box", "women", "woman", "cities", "city", "news", "churches",
             "church", "bus", "s"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    table = {r.word: r.lemma for r in lemmas.lemma_table(df).collect()}
    assert table == {"cars": "car", "wolves": "wolf", "boxes": "box", "women": "woman", "cities": "city", "churches": "church"}
    dictionary = spark.createDataFrame([("new",), ("mouse",)], "word string")
    odd = spark.createDataFrame([("mice", "mouse"), ("news", "newz")], "word string, lemma string")
    more = df.unionByName(spark.createDataFrame([("mice",)], "word string"))
    table = {r.word: r.lemma for r in lemmas.lemma_table(more, dictionary, odd).collect()}
    assert table == {"news": "newz", "mice": "mouse"}


def test_lemmas_keep_order_columns_and_empty_rows(spark):
    docs = spark.createDataFrame(
        [(1, "x", ["cars", "car", "cars", "end"], 5.0), (2, "y", [], 6.0), (3, "z", None, 7.0)],
        "id int, label string, tokens array<string>, extra double",
    )
    for carry in ((), ("label",), ("label", "extra")):
        out = {r.id: r for r in lemmas.lemmatize(docs, "id", carry=carry).collect()}
        assert out[1].tokens == ["car", "car", "car", "end"] and out[1].label == "x" and out[1].extra == 5.0
        assert out[2].tokens == [] and out[2].label == "y"
        assert not out[3].tokens and out[3].extra == 7.0


def test_lemma_join_without_broadcast_gives_the_same(spark):
    docs = spark.createDataFrame(
        [(i, ["cars"] * (i % 7) + ["dogs", "car", "dog", f"w{i}"]) for i in range(200)], "id int, tokens array<string>"
    )
    table = lemmas.lemma_table(lemmas.vocabulary(docs))
    a = lemmas.apply_lemmas(docs, table, "id")
    b = lemmas.apply_lemmas(docs, table, "id", broadcast_bytes=0, floor=20)
    assert sorted(map(tuple, ((r.id, tuple(r.tokens)) for r in a.collect()))) == sorted(
        (r.id, tuple(r.tokens)) for r in b.collect()
    )


def test_preprocess_dataset(spark):
    raw = spark.createDataFrame(
        [("Cars are https://x.y great", "A"), ("The car", "B"), ("", "B"), ("", "B")], "text string, label_post string"
    )
    rows = sorted((r.label_post, r.text_clean) for r in preprocess_dataset(raw)[0].collect())
    assert rows == [("A", "car great"), ("B", ""), ("B", ""), ("B", "car")]
    with pytest.raises(ValueError):
        preprocess_dataset(raw.drop("text"))


def test_clean_text_without_lemmas_is_one_narrow_pass(spark):
    df = spark.createDataFrame([("1", "Cars go", "A")], "id string, text string, label_post string")
    plan = clean_text(df, lemmas=None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_chained_stages_equal_the_whole(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from postloom.functions.stages import TextStage, cleaning_stages

    texts = [case[0] for case in CASES] + ["Cars and a car, wolves & a wolf", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    model = cleaning_stages(stopwords=WORDS).fit(df)
    model.write().save(str(tmp_path / "m"))
    expected = {r.id: r.text_clean for r in clean_text(df.na.fill("", ["text"]), stopwords=WORDS).collect()}
    for kept in (model, PipelineModel.load(str(tmp_path / "m"))):
        assert {r.id: r.text for r in kept.transform(df).collect()} == expected
    with pytest.raises(ValueError):
        TextStage(stage="spelling")


def test_shuffles_are_sized_by_the_input(spark):
    from postloom.session import size_shuffles

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 10) == int(before)
        assert size_shuffles(spark, 1000 * 128 * 1024 * 1024) == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
