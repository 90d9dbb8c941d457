import json
import random

from pyspark.sql import functions as F

from postloom.operators import threads


def brute(rows, keep=lambda r: True, limit=None):
    below = {}
    for r in rows:
        below.setdefault((r[1], r[2]), []).append(r)
    out, stack = {}, [(r, 0) for r in rows if r[1] == r[2]]
    while stack:
        r, depth = stack.pop()
        if not keep(r) or (limit is not None and depth > limit):
            continue
        out[r[0]] = depth
        stack += [(c, depth + 1) for c in below.get((r[1], r[0]), []) if c[2] != c[1]]
    return out


def forest(seed, n=400, posts=3):
    rng, rows, per = random.Random(seed), [], {}
    for i in range(n):
        post = "p0" if rng.random() < 0.6 else f"p{rng.randrange(posts)}"
        kin = per.setdefault(post, [])
        if not kin or rng.random() < 0.1:
            parent = post
        elif rng.random() < 0.4:
            parent = kin[0]  # one comment with very many replies
        else:
            parent = kin[-1]  # and long chains
        rows.append((f"c{i}", post, parent, rng.choice(["x", "AutoModerator", "y", "z"]), rng.choice(["t", "t", None])))
        kin.append(f"c{i}")
    rows += [(f"d{i}", "p1", f"d{i - 1}" if i else "p1", "x", "t") for i in range(60)]
    rows += [("o1", "p0", "gone", "x", "t"), ("o2", "p0", "o1", "x", "t")]  # no way up
    rows += [("n1", "p0", None, "x", "t"), ("n2", "p0", "n1", "x", "t")]
    rows += [("k1", "p1", "k2", "x", "t"), ("k2", "p1", "k1", "x", "t")]  # a cycle
    rng.shuffle(rows)
    return rows


SCHEMA = "id string, post_id string, parent_id string, author string, body string"


def found(df):
    return {r.id: r.depth for r in df.collect()}


def test_depth_pruning_and_limit(spark):
    rows = forest(1)
    df = spark.createDataFrame(rows, SCHEMA)
    keep = threads.keeps(F.col("author"), F.col("body"))
    kept = lambda r: r[4] is not None and r[3] != "AutoModerator"
    assert max(brute(rows).values()) > 20
    assert found(threads.thread_depth(df)) == brute(rows)
    assert found(threads.thread_depth(df, keep=keep)) == brute(rows, kept)
    for limit in (0, 1, 5):
        assert found(threads.thread_depth(df, limit, keep)) == brute(rows, kept, limit)
    assert threads.thread_depth(df, -1).count() == 0


def test_hot_parents_are_salted(spark):
    rows = forest(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(threads.thread_depth(df, floor=20)) == brute(rows)


def test_counts(spark):
    rows = forest(3)
    df = spark.createDataFrame(rows, SCHEMA)
    posts = spark.createDataFrame([("p0", "t"), ("p7", "u")], "id string, title string")
    n = sum(r[1] == "p0" for r in rows)
    found_counts = sorted(map(tuple, threads.posts_with_comments(posts, df).collect()))
    assert found_counts == [("p0", "t", n), ("p7", "u", 0)]  # a post without comments counts 0


def node(id, author="x", replies="", **more):
    return {"kind": "t1", "data": {"id": id, "author": author, "created_utc": 10.0, "replies": replies, "body": f"b{id}", **more}}


def listing(*nodes):
    return {"kind": "Listing", "data": {"children": list(nodes)}}


def test_nested_listings(spark):
    bare = {"kind": "more", "data": {"id": "m", "author": "x", "replies": listing(node("m1")), "created_utc": 1}}
    tree = listing(
        node("a", replies=listing(node("a1", "[deleted]", listing(node("a2"))), node("bot", "AutoModerator", listing(node("lost"))))),
        bare,
        node("b", created_utc=None),
    )
    docs = [("p1", json.dumps([listing(), tree])), ("p2", json.dumps([listing(), listing()])), ("p3", json.dumps([listing(), listing(node("c"))]))]
    out = threads.flatten_listings(spark.createDataFrame(docs, "post_id string, value string"))
    rows = sorted((r.id, r.post_id, r.parent_id, r.author, r.body, r.depth, r.t) for r in out.withColumn("t", F.unix_seconds("created_utc")).collect())
    assert rows == [
        ("a", "p1", "p1", "u/x", "ba", 0, 10), ("a1", "p1", "a", "[deleted]", "ba1", 1, 10), ("a2", "p1", "a1", "u/x", "ba2", 2, 10),
        ("b", "p1", "p1", "u/x", "bb", 0, None), ("c", "p3", "p3", "u/x", "bc", 0, 10),
    ]


def test_listing_of_one_post_and_of_none(spark):
    docs = spark.createDataFrame([("p2", json.dumps([listing(), listing()]))], "post_id string, value string")
    assert threads.flatten_listings(docs).count() == 0
