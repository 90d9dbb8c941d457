"""URL filters by a sort-merge range join of urls with rules on host and path prefixes.

A rule's canonical key is its host with the labels reversed, a dot after each, followed by the
rule's path: all urls it fits at that host are one interval of keys. A url gets one key per parent
domain that is as deep as a rule can be. Rules send an opening and a closing event at the ends of
their intervals, and a sweep over all sorted keys carries the innermost rule that is open: prefix
intervals nest, so a rule's closing puts back its parent, and parents form the stack. The sweep
runs in range partitions; what is open at the end of one is handed to the next through a table of
one row per partition. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.session import written

# The letters that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ["host", "path", "rule", "verdict"]
NODE = "struct<at:int,rule:string,verdict:string>"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    rest = F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*", 0)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _rule_nodes(rules: DataFrame) -> DataFrame:
    """One row per distinct (host, path): key, depth of the host, and its parent, the next shorter rule around it.

    Parents are found by looking up the beginnings of a rule's path at the lengths that rules of
    the same host have.
    """
    host = F.translate("host", UPPER, LOWER)
    clean = rules.where("host is not null and path is not null and verdict is not null").select(
        host.alias("host"), "path", "verdict"
    )
    # of contradicting rules block wins
    unique = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        "*", F.concat("host", "path").alias("rule"), F.size(F.split("host", r"\.", -1)).alias("depth")
    )
    lengths = unique.groupBy(F.col("host").alias("_host")).agg(F.collect_set(F.length("path")).alias("_lengths"))
    shorter = unique.join(lengths, unique["host"] == lengths["_host"]).select(
        unique["host"], unique["path"],
        F.explode(F.filter("_lengths", lambda n: n < F.length("path"))).alias("_n"),
    )
    shorter = shorter.withColumn("_start", F.expr("substring(path, 1, _n)"))
    around = unique.select(
        F.col("host").alias("_host"), F.col("path").alias("_path"),
        F.struct(F.length("path").alias("n"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict")).alias("_parent"),
    )
    parents = (
        shorter.join(around, (F.col("host") == F.col("_host")) & (F.col("_start") == F.col("_path")))
        .groupBy("host", "path").agg(F.max("_parent").alias("parent"))
        .select(F.col("host").alias("_h"), F.col("path").alias("_p"), "parent")
    )
    return unique.join(parents, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").select(
        F.encode(F.concat(reversed_host(F.col("host")), "path"), "utf-8").alias("key"),
        "depth", "rule", "verdict", "parent", "host",
    )


def _events(nodes: DataFrame) -> DataFrame:
    """Openings and closings. No key below a prefix sorts after the prefix followed by a byte 0xFF."""
    own = F.struct(F.col("depth").alias("at"), "rule", "verdict").cast(NODE)
    back = F.struct(F.col("depth").alias("at"), F.col("parent.rule").alias("rule"), F.col("parent.verdict").alias("verdict")).cast(NODE)
    opened = nodes.select("key", F.lit(0).alias("kind"), own.alias("node"))
    closed = nodes.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(1).alias("kind"), back.alias("node"))
    return opened.unionByName(closed)


def sweep(events: DataFrame, points: DataFrame) -> DataFrame:
    """`points` (with `key`) and the node of the last event at or before each in key order."""
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = events.withColumn("point", F.lit(False)).unionByName(
        points.withColumn("point", F.lit(True)).withColumn("kind", F.lit(2)), allowMissingColumns=True
    )
    # the tie column splits many points with one key; events come before points of the same key
    others = [c for c in points.columns if c != "key"]
    tied = both.withColumn("_tie", F.when(F.col("point"), F.xxhash64(*others)).otherwise(F.lit(-(2**63)).cast("bigint")))
    ranged = tied.repartitionByRange(parts, "key", "kind", "_tie").withColumn("_part", F.spark_partition_id())
    cut = written(ranged, "sweep")
    order = Window.partitionBy("_part").orderBy("key", "kind", "_tie")
    swept = cut.withColumn("_node", F.last("node", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = cut.where(~F.col("point")).groupBy("_part").agg(
        F.max(F.struct("key", "kind")).alias("_last"), F.max_by("node", F.struct("key", "kind")).alias("_end")
    )
    # one row per partition, however large the table
    ends = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part").join(last, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    return (
        swept.where("point").join(F.broadcast(carried), "_part")
        .select(*points.columns, F.coalesce("_node", "_carried").alias("node"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with `host`, `path`, the longest fitting `rule` (host and path joined; else null) and its `verdict`.

    A rule fits its host and all subdomains where the url's path starts with the rule's. The
    longest host wins, then the longest path. Urls that no rule fits get `default`. One row per
    row in: each distinct url is judged once and joined back; null urls and urls without `://` have
    an empty host and path and no rule. Input columns named like a result are replaced.
    """
    from postloom.llm.common import quoted, without

    kept = pages.select(*[quoted(c) for c in without(pages, RESULTS)])
    if url.lower() in RESULTS:
        raise ValueError("the url column must not be named like a result")
    nodes = written(_rule_nodes(rules), "rules")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    address = quoted(url).cast("string")
    parsed = pages.select(address.alias("_url")).where("_url is not null").distinct().select(
        "_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path")
    )
    # parent domains as deep as the deepest rule, of which only those with rules are kept
    labels = F.split("_host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deepest, 1)))),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    anchors = parsed.where("_host != ''").select("_url", "_path", F.explode(suffixes).alias("_anchor"))
    hosts = nodes.select(F.col("host").alias("_anchor")).distinct()
    points = anchors.join(hosts, "_anchor", "left_semi").select(
        F.encode(F.concat(reversed_host(F.col("_anchor")), "_path"), "utf-8").alias("key"), "_url"
    )
    hits = sweep(_events(nodes), points).where("node.rule is not null")
    best = hits.groupBy(F.col("_url").alias("__url")).agg(F.max("node").alias("__node"))
    joined = kept.withColumn("__key", address).join(best, F.col("__key") == F.col("__url"), "left")
    return joined.select(
        *[quoted(c) for c in kept.columns],
        host_of(F.col("__key")).alias("host"), path_of(F.col("__key")).alias("path"),
        F.col("__node.rule").alias("rule"), F.coalesce("__node.verdict", F.lit(default)).alias("verdict"),
    )
