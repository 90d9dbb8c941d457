"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import bpe, decontaminate, divergence, embeddings, fingerprints, interactions, language, lines, packing, setjoin, substrings, tokens, urls

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"  # one vocabulary in two formats
MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = lines.drop_repeated_lines(docs, min_docs=10, digests=True)
    return made.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, urls.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embeddings.near_duplicates(vectors, least=0.95)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = substrings.drop_repeated_passages(docs, window=20, digests=True)
    return made.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path
    return packing.pack_documents(docs, path(TOKENIZER), length=1024, ranks_path=path(RANKS))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path(TOKENIZER), limit=512)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = language.fit(docs.where(fold != 2))
    held_out = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    texts = docs.select("doc_id", held_out, "text")
    return language.identify(texts, model).select("doc_id", "held_out", "lang_pred", "score", "bits", "rejected")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return setjoin.similar_sets(docs, size=3, percent=90).select("doc_id", "n_shingles", "component_id", "n_links")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.encode_digests(docs, public_tokenizers.path(MULTI_RANKS))
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "lang", "source")
    return divergence.source_divergence(docs)


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return interactions.interaction_counts(docs, labels)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate.find_contamination(docs, bench, window=10)
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), "contaminated"
    )


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINE_KEY = LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")

OP1_SQL = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS n FROM cut),
keyed AS (SELECT doc_id, n, line, {LINE_KEY} AS key FROM lines),
repeated AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, r.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP3_SQL = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
 ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parsed AS (SELECT page_id, {LOWER.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
 coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT p.page_id, arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost) * 100000 + length(rpath)) AS best
 FROM parsed p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.best.rule AS rule, coalesce(f.best.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON p.page_id = f.page_id
"""

OP11_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
t AS (SELECT lang, source, r, unnest(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
groups AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
occ AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL),
gc AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c FROM groups g JOIN kept k ON g.lang = k.lang
 LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
gn AS (SELECT lang, source, sum(c) AS n FROM gc GROUP BY ALL),
gp AS (SELECT gc.lang, gc.source, gc.term, gc.c, 1 + (1000000000::HUGEINT * (gc.c + 2)) // (gn.n + 2 * v.v) AS p
 FROM gc JOIN gn ON gc.lang = gn.lang AND gc.source = gn.source JOIN v ON gc.lang = v.lang),
lc AS (SELECT lang, term, sum(c) AS c FROM gc GROUP BY ALL),
ln AS (SELECT lang, sum(c) AS n FROM lc GROUP BY ALL),
lp AS (SELECT lc.lang, lc.term, 1 + (1000000000::HUGEINT * (lc.c + 2)) // (ln.n + 2 * v.v) AS q FROM lc JOIN ln ON lc.lang = ln.lang JOIN v ON lc.lang = v.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
 FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item, (gp.p - lp.q) * (gp.p - lp.q) // (gp.p + lp.q) AS value
 FROM gp JOIN lp ON gp.lang = lp.lang AND gp.term = lp.term WHERE gp.c > 0 AND gp.p > lp.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (SELECT doc_id, part,
  (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
  + (CASE WHEN len(list_distinct(words)) * 100 < len(words) * 50 THEN 2 ELSE 0 END)
  + (CASE WHEN (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) * 100 > length(t) * 3 THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM w),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
 FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN lab ON f.doc_id = lab.doc_id GROUP BY ALL),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
perms AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
 FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0) AS earlier FROM perms, range(1, 6) r(s)),
x AS (SELECT m.part, s.filter_order, s.step, s.bit, m.n, m.good, m.toxic, (m.mask & (s.bit | s.earlier)) = 0 AS keep,
 (m.mask & s.bit) <> 0 AND (m.mask & s.earlier) = 0 AS rem, (m.mask & s.bit) <> 0 AND (m.mask & s.earlier) <> 0 AS red, m.mask = s.bit AS uni FROM m, steps s),
agg AS (SELECT part, filter_order, step, bit, sum(CASE WHEN keep THEN n ELSE 0 END) AS kept, sum(CASE WHEN rem THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN red THEN n ELSE 0 END) AS redundant, sum(CASE WHEN uni THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN rem THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN rem THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
 unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM agg
"""

BENCH_WORDS = LOWER.format("coalesce(text, '')")
OP13_SQL = rf"""
WITH dw AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all({BENCH_WORDS}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({BENCH_WORDS}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, w[i + 1 : i + least(len(w), 10)] AS win, least(len(w), 10) AS l FROM starts),
lens AS (SELECT DISTINCT l FROM win),
spots AS (SELECT rn, w, unnest(range(0, len(w))) AS p FROM dw),
pos AS (SELECT spots.rn, spots.p, lens.l, spots.w[spots.p + 1 : spots.p + lens.l] AS s FROM spots JOIN lens ON spots.p + lens.l <= len(spots.w)),
occ AS (SELECT pos.rn, pos.p, pos.l, win.item_id FROM pos JOIN win ON pos.l = win.l AND pos.s = win.win),
hit AS (SELECT rn, count(DISTINCT q) AS n FROM (SELECT rn, unnest(range(p, p + l)) AS q FROM occ) GROUP BY rn),
named AS (SELECT rn, list_sort(list(DISTINCT item_id::VARCHAR) FILTER (item_id IS NOT NULL)) AS ids FROM occ GROUP BY rn)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(len(n.ids), 0)::BIGINT AS n_items,
 sha256(coalesce(array_to_string(n.ids, ','), '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit h ON d.rn = h.rn LEFT JOIN named n ON d.rn = n.rn
"""

QUERIES = {
    query.__name__: query
    for query in (
        op1_line_dedup, op2_fingerprints, op3_url_filter, op4_embedding_near_dedup, op5_substring_dedup, op6_packing, op7_token_counts, op8_language_id, op9_jaccard_join, op10_bpe_codec, op11_source_divergence, op12_filter_interactions, op13_decontamination,
    )
}
ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op3_url_filter": OP3_SQL, "op11_source_divergence": OP11_SQL, "op12_filter_interactions": OP12_SQL, "op13_decontamination": OP13_SQL}
