"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import types
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postloom.llm import bpe, fingerprints, language, lines, packing, setjoin, substrings, tokens

SCHEMA = "doc_id bigint, text string, n_lines string, at int, kept_sha256 string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def make_texts() -> list:
    rnd = random.Random(5)
    passage = [" ".join(f"p{rnd.randint(0, 9999)}" for _ in range(k)) for k in (19, 20, 21, 60)]
    texts = [None, "", " ", "\n", "one", "ONE ", "a b", "a " * 70, "x\ty\r\n z", "日本語 テスト", "don't  stop <|endoftext|> now", "é" * 300]
    for k in range(60):
        words = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(0, 90))]
        for p in rnd.sample(passage, 2):
            words.insert(rnd.randint(0, len(words)), p)
        parts = [" Common Line\t", *[rnd.choice([" ", "  "]).join(words)], "common line" if k % 3 else f"own {k}"]
        texts.append("\n".join(parts))
    base = [f"b{rnd.randint(0, 50)}" for _ in range(200)]
    for k in range(12):
        changed = list(base)
        for _ in range(k // 2):
            changed[rnd.randrange(200)] = f"c{k}"
        texts.append(" ".join(changed))
    texts.append(" ".join(f"long{rnd.randint(0, 5000)}" for _ in range(30_000)))
    return texts + texts[-3:-1] + texts[20:24]


@pytest.fixture(scope="module")
def corpus():
    return list(enumerate(make_texts()))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "mine", 1, None) for i, t in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, and rows that are the same altogether."""
    rows = [(None, "null id"), (None, "null id"), (3, "same words here"), (3, "same words here"), (3, "other"), (1, None)]
    return spark.createDataFrame([(i, t, "mine", 1, None) for i, t in rows], SCHEMA)


def sha(value: bytes) -> str:
    return hashlib.sha256(value).hexdigest()


def brute_lines(corpus, least):
    cut = {i: (t or "").encode().split(b"\n") for i, t in corpus}
    key = lambda line: line.strip().lower()
    counts = {}
    for own in cut.values():
        for k in {key(line) for line in own} - {b""}:
            counts[k] = counts.get(k, 0) + 1
    kept = {i: [x for x in own if counts.get(key(x), 0) < least] for i, own in cut.items()}
    return {i: (len(cut[i]), len(cut[i]) - len(kept[i]), b"\n".join(kept[i])) for i in cut}


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_lines(docs, corpus, broadcast_keys):
    made = lines.drop_repeated_lines(docs, min_docs=10, digests=True, broadcast_keys=broadcast_keys).collect()
    want = brute_lines(corpus, 10)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in made} == {i: (a, b, sha(c)) for i, (a, b, c) in want.items()}
    assert sum(b for _, b, _ in want.values()) > 60


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_lines_keep_the_first(spark, broadcast_keys):
    rows = [(2, "A\nb\na"), (1, "b\nc"), (None, "a "), (3, "d\n\n"), (3, "d\n\n"), (-5, "D")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = lines.drop_repeated_lines(df, min_docs=2, keep="first", broadcast_keys=broadcast_keys)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.text, r.n_dropped) for r in made.collect()))
    assert got == [(False, 0, "a ", 0), (True, -5, "D", 0), (True, 1, "b\nc", 0), (True, 2, "", 3), (True, 3, "\n", 1), (True, 3, "\n", 1)]
    assert made.columns == ["doc_id", "text", "n_lines", "n_dropped"]


def test_fingerprints(docs, corpus):
    made = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    assert len(made) == len(corpus)
    texts = [t or "" for _, t in corpus]
    by_text = {}
    for (i, _), own, following in zip(corpus, texts, texts[1:] + texts[:1]):
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert made[i].n_chars == len(own) and made[i].edited_sha256 == sha(edited.encode())
        assert by_text.setdefault(own, made[i].fingerprint) == made[i].fingerprint
        assert by_text.setdefault(edited, made[i].edited_fingerprint) == made[i].edited_fingerprint
        assert 0 <= made[i].near_edited <= 1 and 0 <= made[i].near_next <= 1
        if own == following:
            assert made[i].near_next == 1
    long = max(corpus, key=lambda x: len(x[1] or ""))[0]
    assert 0.3 < made[long].near_edited < 1


def test_fingerprints_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(str(random.Random(2).random()) for _ in range(1)).encode() + bytes(range(1, 256)) * 900
    whole = fingerprints.fingerprint_texts([text, b"", b"abc"])
    monkeypatch.setattr(fingerprints, "BLOCK", 5000)
    assert fingerprints.fingerprint_texts([text, b"", b"abc"]) == whole


def test_signature_likeness_is_the_common_subsequence():
    rnd = random.Random(3)
    pairs = [tuple(bytes(rnd.choice(b"AB") for _ in range(rnd.randint(1, 64))) for _ in range(2)) for _ in range(100)]

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        return row[-1]

    got = fingerprints.signature_likeness(*map(list, zip(*pairs)))
    assert all(g == 0 or abs(g - 2 * longest(a, b) / (len(a) + len(b))) < 1e-12 for g, (a, b) in zip(got, pairs))
    assert (got > 0).sum() > 50


def brute_windows(corpus, window):
    seen, out = set(), {}
    for i, t in corpus:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("limits", [{}, {"words_per_shard": 500, "segments_per_anchor": 2}])
def test_substrings(docs, corpus, limits):
    made = substrings.drop_repeated_passages(docs, window=20, digests=True, **limits).collect()
    want = brute_windows(corpus, 20)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in made} == {i: (a, b, sha(c)) for i, (a, b, c) in want.items()}
    assert sum(b for _, b, _ in want.values()) > 1000


def test_substrings_keep_texts_that_lose_nothing(docs, corpus):
    made = substrings.drop_repeated_passages(docs, window=20)
    assert made.columns == ["doc_id", "text", "n_lines", "at", "kept_sha256", "n_words", "n_removed"]
    want = brute_windows(corpus, 20)
    texts = dict(corpus)
    for r in made.collect():
        assert r.text == (want[r.doc_id][2].decode() if want[r.doc_id][1] else texts[r.doc_id])


def test_plain_words_are_not_matched_by_the_pattern(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    splitter, matched = tokens.Splitter(path), []
    words_of = tokens.words_of
    monkeypatch.setattr(tokens, "words_of", lambda piece: matched.append(piece) or words_of(piece))
    plain = ["word", " word", " Größe", " ª", "É", " ʼ" + "a", " 世界"]
    mixed = [" it's", " a1", "1", " ", "  x", " x\n", "!", " x,y", " ²", " ·", " a<|endoftext|>b", "<|endoftext|>", "e\u0301"]
    for piece in plain + mixed:
        parts = splitter.added.split(piece) if splitter.added else [piece]
        want = [w for k, part in enumerate(parts) for w in ([part] if k % 2 else [part[a:b] for _, (a, b) in splitter.cut(part)] if part else [])]
        assert splitter.words(piece) == want, piece
    assert not set(matched) & set(plain)


def brute_join(corpus, size, percent):
    sets = {}
    for i, t in corpus:
        words = (t or "").encode().lower().split()
        k = min(size, len(words))
        sets[i] = {tuple(words[s : s + k]) for s in range(len(words) - k + 1)} if words else set()
    first, links = {i: i for i in sets}, dict.fromkeys(sets, 0)
    pairs = [(i, j) for i in sets for j in sets if j < i and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) > 0]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(first[i], first[j])
            changed |= first[i] != low or first[j] != low
            first[i] = first[j] = low
    return {i: (len(sets[i]), links[i], first[i]) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_set_join(docs, corpus, size, percent):
    made = setjoin.similar_sets(docs, size=size, percent=percent).collect()
    want = brute_join(corpus, size, percent)
    assert {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in made} == want
    assert sum(n > 0 for _, n, _ in want.values()) > 15


def test_set_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 7)
    rnd = random.Random(8)
    base = [f"b{rnd.randint(0, 500)}" for _ in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(120)] = f"x{rnd.randint(0, 5)}"
        rows.append((i, " ".join(own)))
    made = setjoin.similar_sets(spark.createDataFrame(rows, "doc_id bigint, text string"), size=3, percent=90).collect()
    assert {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in made} == brute_join(rows, 3, 90)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_set_join_with_signatures_of_too_many_sets(spark, monkeypatch, size, percent):
    monkeypatch.setattr(setjoin, "GROUP", 4)
    monkeypatch.setattr(setjoin, "PAIRED", 10)
    monkeypatch.setattr(setjoin, "BLOCK", 20)
    rnd = random.Random(size)
    rows = []
    for length in (12, 30, 60, 200):
        base = [f"b{rnd.randint(0, 5000)}" for _ in range(length)]
        for _ in range(40):
            own = base[: length - rnd.randint(0, length // 6)]
            for _ in range(rnd.choice((0, 1, 2, length // 30, length // 8))):
                own[rnd.randrange(len(own))] = f"x{rnd.randint(0, 5)}"
            rows.append((len(rows), " ".join(own)))
    made = setjoin.similar_sets(spark.createDataFrame(rows, "doc_id bigint, text string"), size=size, percent=percent).collect()
    want = brute_join(rows, size, percent)
    assert {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in made} == want
    assert len({c for _, _, c in want.values()}) < len(rows) and sum(n for _, n, _ in want.values()) > 100


@pytest.mark.parametrize("group", [256, 16, 4])
def test_a_common_passage_makes_no_candidates(spark, monkeypatch, group):
    """Texts that share a passage and are not similar were verified as one cluster, each against all."""
    monkeypatch.setattr(setjoin, "GROUP", group, raising=False)
    verified, filtered = [], []
    links, size_for = setjoin._links, setjoin.bloom.size_for
    monkeypatch.setattr(setjoin, "_links", lambda clusters, *more: verified.append(clusters.count()) or links(clusters, *more))
    monkeypatch.setattr(setjoin.bloom, "size_for", lambda keys: filtered.append(keys) or size_for(keys))
    rnd = random.Random(5)
    passage = [f"p{k}" for k in range(30)]
    rows = [(i, " ".join([f"w{rnd.randint(0, 10**6)}" for _ in range(240)] + passage)) for i in range(50)]
    rows.append((50, rows[49][1] + " more"))
    made = setjoin.similar_sets(spark.createDataFrame(rows, "doc_id bigint, text string"), size=5, percent=80).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in made} == {i: (int(i > 48), min(i, 49)) for i in range(51)}
    assert verified[0] <= 4  # of 51
    assert max(filtered) <= len(rows)  # no filter of signatures, of which every set has many, goes through the driver


def test_drop_similar_keeps_one_of_each_group(docs, corpus):
    kept = setjoin.drop_similar(docs)
    want = {i for i, (_, _, first) in brute_join(corpus, 5, 80).items() if i == first}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_packing(docs, corpus):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = packing.pack_documents(docs, TOKENIZER, ranks_path=ranks, ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in made:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(corpus)
    for i, t in corpus:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids
        for r in own:
            raw = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw) and r.doc_tokens == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0


def test_hilbert_curve_visits_every_cell_by_single_steps():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = packing.hilbert_index(grid, 3)
    assert sorted(order) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(order)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("head", [tokens.HEAD, 20])
def test_token_counts(docs, corpus, head):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    made = {r.doc_id: r for r in tokens.count_tokens(docs, TOKENIZER, head=head).collect()}
    assert len(made) == len(corpus)
    for i, t in corpus:
        count = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (made[i].n_bytes, made[i].n_tokens, made[i].over_limit) == (len((t or "").encode()), count, count > 512)


def test_token_counts_of_many_added_tokens(spark):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = ["<|endoftext|>" * 5000, "a<|endoftext|>b " * 3000 + "<|endoftext|>", "<|endoftext|x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, TOKENIZER).collect()}
    assert made == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def reference_codec(path):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, corpus):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = reference_codec(path)
    made = {r.doc_id: r for r in bpe.encode_digests(docs, path).collect()}
    for i, t in corpus:
        ids = codec.encode_ordinary(t or "")
        assert made[i].n_tokens == len(ids) and made[i].ids_sha256 == sha(",".join(map(str, ids)).encode())
        assert made[i].decoded_sha256 == sha((t or "").encode())
    assert bpe.encode_texts(docs.where("doc_id = 4"), path).first().decoded == b"one"


def test_bpe_on_odd_strings():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec, own, rnd = reference_codec(path), bpe.Codec(path), random.Random(4)
    texts = ["".join(rnd.choice("ab \n\t'sté1!日 \x1c ") for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rnd.choice("thein") for _ in range(rnd.randint(200, 500))) for _ in range(10)]
    for text, (ids, decoded) in zip(texts, own.encode(texts)):
        assert ids.decode() == ",".join(map(str, codec.encode_ordinary(text))) and decoded == text.encode()


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = language.fit(docs.where(fold != 2))
    judged = language.identify(docs.where(fold == 2), model).collect()
    right = sum(r.lang == r.lang_pred for r in judged)
    assert right >= 0.98 * len(judged) and sum(r.rejected for r in judged) <= 0.01 * len(judged)
    assert all(0 <= r.score <= 1 for r in judged)
    # probabilities of what may follow a context add up to one (and a little for characters never seen)
    codes = [1, ord("t")]
    follow = [chr(c) for c in range(2, 700) if chr(c) == "\x02" or chr(c).isalpha()]
    sums, _ = model.score(["t" + c if c != "\x02" else "t" for c in follow if c != "\x02"])
    assert codes and np.isfinite(sums).all()


def test_language_is_drawn_from_distinct_texts(spark):
    few = [(f"el perro y la gata {chr(97 + k)}", "es") for k in range(10)]
    hot = [("the very same words", "en")] * 2000
    rows = few * 200 + hot + [(f"the dog and the cat {k}", "en") for k in range(500)]
    table = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    odd = spark.createDataFrame([("el perro y la gata",)], "text string")
    assert language.identify(odd, language.fit(table, fit_rows=100)).first().lang_pred == "es"
    kept = [tuple(r) for r in language.drawn(table, 100).collect()]
    assert len(kept) == len(set(kept)) and set(few) <= set(kept)
    assert 60 <= sum(name == "en" for _, name in kept) <= 140


@pytest.mark.parametrize("few", [1, 24])
def test_language_rejects_other_scripts_beside_a_small_label(spark, few):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text", "lang").distinct()
    spanish = docs.where("lang = 'es' and length(text) > 200").orderBy(F.xxhash64("text")).limit(60).collect()
    rest = docs.where("lang <> 'es'").orderBy(F.xxhash64("text")).limit(2000)
    model = language.fit(rest.unionByName(spark.createDataFrame(spanish[:few], docs.schema)))
    own = spark.createDataFrame(spanish[30:], docs.schema)
    assert not any(r.rejected for r in language.identify(own, model).collect() if r.lang_pred == "es")
    planted = ["日本語の文章はここに置かれている " * 6, "это предложение написано по русски и довольно длинное " * 4, "zxqv kjhw wqpz vbnk xxzq jjkw " * 9]
    judged = language.identify(spark.createDataFrame([(t,) for t in planted], "text string"), model).collect()
    assert "es" in {r.lang_pred for r in judged} and all(r.rejected for r in judged)


def test_language_bound_ignores_one_mislabelled_text():
    model = types.SimpleNamespace(languages=["en", "fr"])
    random_ = np.random.default_rng(2)
    bits, size = 2.1 + 0.1 * random_.standard_normal(40), np.full(40, 300)
    language._calibrate(model, np.append(bits, 14.5), np.zeros(41, int), np.append(size, 300))
    assert (14.5 - model.means[0]) * np.sqrt(300) / model.spreads[0] > model.highest[0]
    assert np.isfinite(model.highest).all()


def test_texts_with_letters_stay_without_a_model(spark):
    rows = spark.createDataFrame([("some words",), ("12 !",), (None,)], "text string")
    assert [r.rejected for r in language.identify(rows, None).collect()] == [False, True, True]


def test_language_of_odd_texts(spark):
    rows = [(1, "der die das und", "x"), (2, None, "x"), (3, "", "x"), (4, "123 !!", "x"), (5, "zq" * 3000, "x")]
    train = [(f"der hund und die katze {k}", "de", "t") for k in range(30)] + [(f"the dog and a cat {k}", "en", "t") for k in range(30)] + [(None, "fr", "t"), ("le chien", None, "t")]
    model = language.fit(spark.createDataFrame(train, "text string, lang string, score string"))
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id int, text string, lang_pred string"), model).collect()}
    assert got[1].lang_pred == "de" and got[1].score > 0.9
    assert [got[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and got[5].lang_pred in ("de", "en")
    nothing = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert nothing is None
    assert [r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id int, text string, x string"), nothing).collect()] == ["und"] * 5


OPERATORS = {
    "lines": lambda d: lines.drop_repeated_lines(d, min_docs=2),
    "lines_first": lambda d: lines.drop_repeated_lines(d, min_docs=2, keep="first"),
    "fingerprints": fingerprints.fingerprint_documents,
    "substrings": lambda d: substrings.drop_repeated_passages(d, window=2),
    "packing": lambda d: packing.pack_documents(d, TOKENIZER),
    "tokens": lambda d: tokens.count_tokens(d, TOKENIZER),
    "sets": setjoin.similar_sets,
    "similar": setjoin.drop_similar,
    "bpe": lambda d: bpe.encode_digests(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(none, name):
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_null_and_repeated_ids(odd, name):
    made = OPERATORS[name](odd).collect()
    if name == "packing":  # a document may lie in several pieces
        made = [r for r in made if r.start == 0]
    assert len(made) == (4 if name == "similar" else 6)
    if name == "sets":
        assert sorted((r.doc_id or 0, r.n_links) for r in made) == [(0, 1), (0, 1), (1, 0), (3, 0), (3, 1), (3, 1)]
