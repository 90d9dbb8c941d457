"""Source divergence audit: how far each source's term distribution lies from its language's.

Method: an Arrow compute pipeline inside `mapInArrow` (`ascii_lower`, `split_pattern_regex`,
`dictionary_encode` and a hash `group_by`) turns each batch of documents into partial counts per
(lang, source, term), merged within a task up to a bounded number of rows; Spark merges these columnar shards by a map-side combined aggregation keyed
by the term, and the divergences are computed from the merged counts with joins and sums.

Smoothed shares are integers: for a group with N occurrences of the V kept terms of its language,
a term counted c times there has p = 1 + floor(10^9 (c + 2) / (N + 2V)). Two groups differ at a
term by f = floor((p - q)^2 / (p + q)). All of it is exact: products go through decimals of 38
digits and the quotients are integral divisions.

Part `pair` sums f over all kept terms for each two sources of a language. Terms that neither
source holds contribute one value per pair, so they are counted, not listed: the sum is assembled
from terms both hold (per bucket of terms, a (term, source) matrix in numpy inside
`applyInPandas`, summed over buckets by Spark), terms only one holds (a histogram of counts per source
against every other source's share of an unseen term), and the rest. The work is the number of
nonzero (source, term) counts times the sources of the language, never the vocabulary times the
sources squared. Part `term` lists the kept terms of a group whose share exceeds the language's,
the ten largest; the limit per group is applied per map task before the shuffle as well.

Null text, lang and source read as the empty string. A group without any kept term still gets its
pair rows (N = 0); a language without kept terms (V = 0) gives pair values 0 and no term rows
(its unseen share is set to 1 so that no quotient by N + 2V = 0 is formed).
An empty table gives no rows. Repeated rows count as documents each. Extra input columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import map_arrow, prepare, quoted
from postloom.operators.joins import small
from postloom.session import materialize, written

# Fixed values of the contract: what a term is, the scale of shares, how many documents keep a term.
TERM_BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
MIN_DOCS = 10
TOP = 10

HELD_ROWS = 1 << 21  # partial counts a task merges before handing them on
BUCKET_ENTRIES = 1 << 21  # nonzero (source, term) counts of kept terms per task of the pair sums

PARTIAL = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())]
)


def batch_counts(b: pa.RecordBatch) -> pa.Table:
    """Occurrences `n` and documents `d` of each (lang, source, term) of one batch, and one row with a
    null term per (lang, source) present, so that groups without terms are known too."""
    empty = pa.scalar("", pa.string())
    lang = pc.fill_null(b.column(0).cast(pa.string()), empty)
    source = pc.fill_null(b.column(1).cast(pa.string()), empty)
    text = pc.ascii_lower(pc.fill_null(b.column(2).cast(pa.string()), empty))
    pieces = pc.split_pattern_regex(text, TERM_BREAKS)
    terms = pc.list_flatten(pieces)
    owner = pc.list_parent_indices(pieces)
    keep = pc.not_equal(pc.utf8_length(terms), 0)
    terms, owner = terms.filter(keep), owner.filter(keep)
    coded = pc.dictionary_encode(terms)
    table = pa.table({"lang": pc.take(lang, owner), "source": pc.take(source, owner), "term": coded.indices, "doc": owner})
    counted = table.group_by(["lang", "source", "term"]).aggregate([("doc", "count"), ("doc", "count_distinct")])
    found = pa.table(
        {
            "lang": counted.column("lang"),
            "source": counted.column("source"),
            "term": pc.take(coded.dictionary, counted.column("term")),
            "n": counted.column("doc_count").cast(pa.int64()),
            "d": counted.column("doc_count_distinct").cast(pa.int64()),
        }
    )
    present = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"]).aggregate([])
    k = present.num_rows
    marks = pa.table(
        {
            "lang": present.column("lang"),
            "source": present.column("source"),
            "term": pa.nulls(k, pa.string()),
            "n": pa.array([0] * k, pa.int64()),
            "d": pa.array([0] * k, pa.int64()),
        }
    )
    return pa.concat_tables([found, marks])


def merge(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("d", "sum")])
    return pa.table([summed.column(c) for c in ("lang", "source", "term", "n_sum", "d_sum")], schema=PARTIAL)


def partial_counts(batches):
    """Counts of a task's batches, merged in Arrow until about `HELD_ROWS` rows are held, then handed on."""
    held, rows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        counted = batch_counts(b)
        held.append(counted)
        rows += counted.num_rows
        if rows >= HELD_ROWS:
            merged = merge(held)
            if merged.num_rows >= HELD_ROWS // 2:
                yield from merged.to_batches()
                held, rows = [], 0
            else:
                held, rows = [merged], merged.num_rows
    if held:
        yield from merge(held).to_batches()


def share(count: str, total: str, kept: str) -> F.Column:
    """p = 1 + floor(SCALE (count + 2) / (total + 2 kept)) of three columns named in SQL, exact."""
    return F.expr(
        f"1 + (cast({SCALE} as decimal(38,0)) * (cast({count} as decimal(38,0)) + 2))"
        f" div (cast({total} as decimal(38,0)) + 2 * cast({kept} as decimal(38,0)))"
    ).cast("long")


def gap(p: str, q: str) -> F.Column:
    """f = floor((p - q)^2 / (p + q)) of two shares named in SQL; both are at most 10^9 + 1."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def shared_terms(frame: pd.DataFrame) -> pd.DataFrame:
    """For the terms of one bucket of one language: per two sources g, h holding a term both, the
    number of such terms and the sum of f(p_g, p_h) - f(p_g, unseen_h) - f(unseen_g, p_h).

    Terms are laid out as rows of a (term, source) matrix in chunks of about a million cells, and
    each source is compared with all others by whole-matrix operations.
    """
    lang = frame["lang"].iloc[0]
    names, source = np.unique(frame["source"].to_numpy(dtype=object), return_inverse=True)
    _, term = np.unique(frame["term"].to_numpy(dtype=object), return_inverse=True)
    p = frame["p"].to_numpy(np.int64)
    width = len(names)
    unseen = np.zeros(width, np.int64)
    unseen[source] = frame["p0"].to_numpy(np.int64)
    common = np.zeros((width, width), np.int64)
    inside = np.zeros((width, width), np.int64)
    chunk = max(1, (1 << 20) // width)
    for start in range(0, int(term.max()) + 1, chunk):
        chosen = (term >= start) & (term < start + chunk)
        rows = term[chosen] - start
        shares = np.zeros((chunk, width), np.int64)
        held = np.zeros((chunk, width), bool)
        shares[rows, source[chosen]] = p[chosen]
        held[rows, source[chosen]] = True
        for g in range(width):
            mine = held[:, g]
            if not mine.any():
                continue
            pg, ph, hh = shares[mine, g][:, None], shares[mine], held[mine]
            value = gaps(pg, ph) - gaps(pg, unseen[None, :]) - gaps(unseen[g], ph)
            inside[g] += np.where(hh, value, 0).sum(axis=0)
            common[g] += hh.sum(axis=0)
    g, h = np.nonzero(common)
    other = g != h
    g, h = g[other], h[other]
    return pd.DataFrame({"lang": lang, "g": names[g], "h": names[h], "common": common[g, h], "inside": inside[g, h]})


def merged_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, d) summed over all documents; a null term marks that a group occurs."""
    prepare(docs.sparkSession)
    read = docs.select(quoted(lang).alias("lang"), quoted(source).alias("source"), quoted(text).alias("text"))
    parts = map_arrow(read, partial_counts, PARTIAL)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of the audit described in the module docstring."""
    counts = written(merged_counts(docs, text, lang, source), "divergence-counts")
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    seen = counts.where(F.col("term").isNotNull())
    per_lang = seen.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.sum("n").alias("c"))
    kept = written(per_lang.where(F.col("docs") >= MIN_DOCS).select("lang", "term", "c"), "divergence-kept")
    sizes = materialize(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("lang_total")))
    entries = seen.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", F.col("n").alias("c"))
    per_group = entries.groupBy("lang", "source").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("held"))
    # one row per occurring group: its total, its number of kept terms held, V and the share of an unseen term
    stats = (
        groups.join(small(sizes), "lang", "left")
        .join(per_group, ["lang", "source"], "left")
        .select(
            "lang",
            "source",
            F.coalesce("v", F.lit(0)).alias("v"),
            F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("held", F.lit(0)).alias("held"),
        )
        .withColumn("p0", F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(F.lit(1).cast("long")))
    )
    stats = small(materialize(stats))
    shares = entries.join(stats.select("lang", "source", "total", "v"), ["lang", "source"]).select(
        "lang", "source", "term", "c", share("c", "total", "v").alias("p")
    )
    shares = written(shares, "divergence-shares")  # read by both parts three times
    lang_shares = kept.join(small(sizes), "lang").select("lang", "term", share("c", "lang_total", "v").alias("q"))

    # part `term`: kept terms of a group above the language's share
    over = (
        shares.join(lang_shares, ["lang", "term"])
        .where(F.col("p") > F.col("q"))
        .select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").cast("binary"))
    terms = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.col("rank").cast("int"))

    # part `pair`: for sources g and h of a language, the sum over all kept terms of f(p_g, p_h)
    ends = stats.select("lang", "source", "p0")
    entries_total = stats.agg(F.sum("held")).first()[0] or 0
    buckets = max(1, -(-entries_total // BUCKET_ENTRIES))
    holders = shares.join(ends, ["lang", "source"]).select("lang", "term", "source", "p", "p0")
    both = (
        holders.groupBy("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("__bucket"))
        .applyInPandas(shared_terms, "lang string, g string, h string, common long, inside long")
        .groupBy("lang", "g", "h")
        .agg(F.sum("common").alias("common"), F.sum("inside").alias("inside"))
    )
    # terms held by g, against every other source's unseen share: one row per distinct share of g
    held = shares.groupBy("lang", F.col("source").alias("g"), F.col("p").alias("pg")).agg(F.count(F.lit(1)).alias("m"))
    alone = (
        held.join(ends.select("lang", F.col("source").alias("h"), F.col("p0").alias("h0")), "lang")
        .where(F.col("g") != F.col("h"))
        .groupBy("lang", "g", "h")
        .agg(F.sum(F.col("m") * gap("pg", "h0")).alias("alone"))
    )
    pairs = (
        stats.select("lang", F.col("source").alias("g"), F.col("p0").alias("g0"), F.col("held").alias("tg"), "v")
        .join(stats.select("lang", F.col("source").alias("h"), F.col("p0").alias("h0"), F.col("held").alias("th")), "lang")
        .where(F.col("g") != F.col("h"))
        .join(both, ["lang", "g", "h"], "left")
        .join(alone, ["lang", "g", "h"], "left")
        .join(alone.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), F.col("alone").alias("back")), ["lang", "g", "h"], "left")
    )
    common = F.coalesce("common", F.lit(0))
    rest = (F.col("v") - F.col("tg") - F.col("th") + common) * gap("g0", "h0")
    value = F.coalesce("inside", F.lit(0)) + F.coalesce("alone", F.lit(0)) + F.coalesce("back", F.lit(0)) + rest
    ranked = Window.partitionBy("lang", "g").orderBy(F.col("value").desc(), F.col("h").cast("binary"))
    pair_rows = pairs.select("lang", "g", "h", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(ranked))
    pair_rows = pair_rows.select(
        "lang", F.col("g").alias("source"), F.lit("pair").alias("part"), F.col("h").alias("item"), "value", F.col("rank").cast("int")
    )
    return pair_rows.unionByName(terms)
