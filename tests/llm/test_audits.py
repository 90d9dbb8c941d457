"""Source divergence, filter interactions and decontamination against plain Python on small tables."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from postloom.llm import decontaminate, divergence, interactions

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        found = term.findall(text.translate(AZ))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    kept = {lang: sorted(t for t, d in per.items() if d >= 10) for lang, per in docs.items()}

    def shares(counter, terms):
        n, v = sum(counter[t] for t in terms), len(terms)
        return {t: 1 + (10**9 * (counter[t] + 2)) // (n + 2 * v) for t in terms}

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    out = []
    for lang in {g[0] for g in groups}:
        terms = kept.get(lang, [])
        whole = Counter()
        for (l2, s), c in counts.items():
            if l2 == lang:
                whole.update(c)
        q = shares(whole, terms)
        mine = {s: shares(counts[lang, s], terms) for (l2, s) in groups if l2 == lang}
        for s, p in mine.items():
            pairs = sorted(((sum(f(p[t], mine[h][t]) for t in terms), h) for h in mine if h != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", h, v, k + 1) for k, (v, h) in enumerate(pairs)]
            over = [(f(p[t], q[t]), t) for t in terms if counts[lang, s][t] > 0 and p[t] > q[t]]
            over.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, k + 1) for k, (v, t) in enumerate(over[:10])]
    return sorted(out)


def divergence_rows():
    rows = []
    words = ["alpha", "Beta", "gamma", "délta", "ÉPS", "zeta9eta", "x"]
    for k in range(60):
        text = " ".join(words[(k + j) % len(words)] for j in range(k % 5 + 1)) + (" alpha" * (k % 3))
        rows.append((text if k % 17 else None, ["en", "fr", None][k % 3], ["s1", "s2", "s3", None][k % 4]))
    rows.append(("lone words only here", "xx", "a"))
    rows.append(("", "xx", "b"))
    rows.append(("alpha beta", "en", "s1"))
    rows.append(("alpha beta", "en", "s1"))
    return rows


def test_divergence_matches_python(spark):
    rows = divergence_rows()
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = sorted(tuple(r) for r in divergence.source_divergence(df).collect())
    assert got == brute_divergence(rows)
    assert any(r[2] == "term" for r in got) and any(r[0] == "xx" and r[4] == 0 for r in got)


def test_divergence_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(empty).count() == 0
    clash = spark.createDataFrame([("a b", "en", "s", 1, "x")], "text string, lang string, source string, term long, part string")
    assert [tuple(r) for r in divergence.source_divergence(clash).collect()] == []


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_interactions(docs, labels):
    first = {}
    for doc_id, text, _ in docs:
        t = text or ""
        if doc_id is not None:
            first[t] = min(first.get(t, doc_id), doc_id)
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, x in labels if d is not None and x == 1}
    masks = []
    for doc_id, text, lang in docs:
        t = text or ""
        w = words(t)
        upper = sum(1 for c in t if "A" <= c <= "Z")
        mask = (
            (len(w) < 200) * 1 + (len(set(w)) * 100 < len(w) * 50) * 2 + (upper * 100 > len(t) * 3) * 4
            + bool(re.search(r"[#$%&*|]", t)) * 8 + (doc_id is not None and doc_id > first[t]) * 16
        )
        masks.append((lang or "", mask, doc_id in good, doc_id in toxic))
    out = []
    bit = {c: 1 << k for k, c in enumerate("ABCDE")}
    for part in sorted({m[0] for m in masks}):
        mine = [m for m in masks if m[0] == part]
        table = {}
        for order in ("".join(p) for p in permutations("ABCDE")):
            earlier = 0
            for step, letter in enumerate(order, 1):
                b = bit[letter]
                rem = [m for m in mine if m[1] & b and not m[1] & earlier]
                table[order, step] = (
                    sum(1 for m in mine if not m[1] & (b | earlier)), len(rem), sum(1 for m in mine if m[1] & b and m[1] & earlier),
                    sum(1 for m in mine if m[1] == b), sum(m[2] for m in rem), sum(m[3] for m in rem), letter,
                )
                earlier |= b
        shapley = Counter()
        for v in table.values():
            shapley[v[6]] += v[1]
        out += [(part, o, s, *v[:6], shapley[v[6]]) for (o, s), v in table.items()]
    return sorted(out)


def interaction_rows():
    long = " ".join(f"w{k}" for k in range(260))
    shout = " ".join(f"W{k}" for k in range(230))
    return [
        (1, long, "en"), (2, long, "en"), (3, long, "fr"), (0, long + " #", "en"), (4, None, None), (5, "", "en"), (5, "", "en"),
        (None, long, "en"), (6, shout, "de"), (7, "a a a a", "de"), (8, shout, None), (9, long + " x", "en"), (10, "é " * 300, "fr"),
    ]


def test_interactions_match_python(spark):
    docs = interaction_rows()
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, 0, 1), (None, 1, 1), (7, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in interactions.interaction_counts(d, lab).collect())
    assert len(got) == 600 * len({r[2] or "" for r in docs})
    assert got == brute_interactions(docs, labels)


def test_interactions_segments_and_empty(spark, monkeypatch):
    monkeypatch.setattr(interactions, "SEGMENT_KEYS", 2)
    docs = interaction_rows() * 3
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in interactions.interaction_counts(d, lab).collect())
    assert got == brute_interactions(docs, [])
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert interactions.interaction_counts(empty, lab).count() == 0


def brute_contamination(docs, bench, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for item, text in bench:
        w = word.findall((text or "").translate(AZ))
        if not w:
            continue
        for i in range(max(len(w) - window, 0) + 1):
            wins[tuple(w[i : i + window])].add(item)
    out = []
    for doc_id, text in docs:
        w = word.findall((text or "").translate(AZ))
        hit, items = set(), set()
        for key, owners in wins.items():
            n = len(key)
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) == key:
                    hit.update(range(p, p + n))
                    items.update(o for o in owners if o is not None)
        named = ",".join(sorted(str(i) for i in items))
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(named.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def contamination_rows():
    passage = "The quick brown fox jumps over the lazy dog and then runs far away home"
    bench = [(1, passage), (2, "Short test item"), (3, None), (4, ""), (None, "orphan words one two three four five six seven eight nine ten"), (5, passage), (6, "ünï cödé wörds hère ànd thére ok")]
    docs = [
        (1, "Intro. " + passage.upper() + " tail"), (2, "nothing here at all"), (3, None), (4, ""), (5, "a short test item, again SHORT TEST ITEM"),
        (6, "orphan words one two three four five six seven eight nine ten eleven"), (7, "x " * 3000 + passage + " y" * 3000),
        (7, "x " * 3000 + passage + " y" * 3000), (8, "the quick brown fox jumps over the lazy dog and"), (9, "ünï cödé wörds hère ànd thére ok!"),
    ]
    return docs, bench


def digest(spark, docs, bench):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash")).repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.find_contamination(d, b)
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return sorted(
        (tuple(r) for r in found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(named, 256), "contaminated").collect()),
        key=repr,
    )


def test_contamination_matches_python(spark):
    docs, bench = contamination_rows()
    assert digest(spark, docs, bench) == brute_contamination(docs, bench)


def test_contamination_blocks_shards_and_empty(spark, monkeypatch):
    docs, bench = contamination_rows()
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 3)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 5)
    assert digest(spark, docs, bench) == brute_contamination(docs, bench)
    assert all(not r[5] for r in digest(spark, docs, []))
    assert digest(spark, [], bench) == []
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.remove_contaminated(d, b).collect()) == [2, 3, 4]


@pytest.mark.parametrize("window", [3])
def test_contamination_other_window(spark, window):
    docs, bench = contamination_rows()
    from pyspark.sql import functions as F

    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((r.doc_id, r.n_hit) for r in decontaminate.find_contamination(d, b, window=window).select("doc_id", "n_hit").collect())
    want = sorted((r[0], r[2]) for r in brute_contamination(docs, bench, window))
    assert got == want and F is not None
