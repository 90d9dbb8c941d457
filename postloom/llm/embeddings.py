"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors are dealt to the shards of their nearest cluster centres, so shards overlap; each shard
builds a pruned proximity graph, and the neighbour lists of a vector from all its shards are
united. Every vector is then searched for in its shards over the united lists, greedily from the
medoid and on through everything in range. Pairs found are verified in double precision. An audit
compares a sample of queries with brute force, those with few links apart from the others; while
recall of either kind is too low, vectors go to more shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import common, graph
from postloom.llm.components import connected_components
from postloom.session import written

SHARD = 1000  # vectors of a shard, or of a block of one
CENTRES = 4096  # at most
SAMPLE = 20_000  # vectors that the cluster centres are fitted on, at most about
AUDITED = 200  # queries of the audit, about, at first
ENOUGH, FEW = 200, 10  # more are drawn until so many of them have links, but few
MOST = 20_000  # queries of the audit, about, at most
OVERLAP = 2
RECALL = 0.97
SLACK = 1e-3  # graph search in single precision looks so much further
VECTORS = pa.schema([("row", pa.int64()), ("size", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("vector", pa.binary())])
ASSIGNED = pa.schema([("row", pa.int64()), ("cells", pa.list_(pa.int32()))])
LISTS = pa.schema([("row", pa.int64()), ("near", pa.list_(pa.int64()))])
FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("found", pa.int64()), ("links", pa.int64())])


def _checked(rows: DataFrame, embedding: str) -> DataFrame:
    """Vectors as bytes of doubles, size 0 for those that link with nothing, and a digest of the values."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for value in b.column(1).to_pylist():
                usable = bool(value) and None not in value
                vector = np.array(value if usable else [], np.float64)
                with np.errstate(over="ignore"):
                    scale = np.abs(vector).max(initial=0.0)
                    usable = usable and bool(np.isfinite(vector).all()) and scale > 0
                raw = (vector / scale + 0.0).tobytes() if usable else b""  # zero has one sign
                d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(raw), "<i8").tolist()
                for column, item in zip(out, (len(vector) if usable else 0, d1, d2, raw)):
                    column.append(item)
            yield common.batch(VECTORS, b.column(0), *out)

    source = rows.select(common.ROW, common.quoted(embedding).cast("array<double>"))
    return written(common.map_arrow(source, run, VECTORS), "vectors")


def _units(raw: list[bytes]) -> np.ndarray:
    vectors = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def fit_centres(vectors: np.ndarray, count: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Spherical k-means on a sample."""
    random = np.random.default_rng(seed)
    centres = vectors[np.sort(random.choice(len(vectors), min(count, len(vectors)), replace=False))]
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        sizes = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1e-12), centres)
    return centres


def _assigned(reps: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """The nearest `overlap` cells of each vector."""
    shared = reps.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for b in batches:
            raw = common.texts(b.column(1))
            if raw:
                likeness = _units(raw).astype(np.float32) @ shared.value.T
                nearest = np.sort(np.argsort(-likeness, 1, kind="stable")[:, :overlap], 1)
                yield common.batch(ASSIGNED, b.column(0), nearest.tolist())

    made = written(common.map_arrow(reps.select("row", "vector"), run, ASSIGNED), "cells")
    sizes = made.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("blocks"))
    blocks = {cell: n for cell, n in sizes.collect()}  # one row per centre
    # the block of a vector in its cells: cells larger than a shard are cut by hash
    count = F.create_map(*[F.lit(int(x)) for pair in blocks.items() for x in pair]) if blocks else F.create_map(F.lit(0), F.lit(1))
    hashed = F.pmod(F.xxhash64("row"), F.lit(1 << 30)).cast("int")
    return made.withColumn("homes", F.transform("cells", lambda c: F.struct(c.alias("cell"), count[c].alias("blocks"), F.pmod(hashed, count[c]).alias("block"))))


def _dealt(table: DataFrame, keys: list[str]) -> DataFrame:
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(max(parts, 1), *keys).sortWithinPartitions(*keys, "row")


def _graphs(members: DataFrame) -> DataFrame:
    """Neighbour lists of all shards, united per vector."""

    def run(batches):
        for held in common.groups(batches, 2):
            rows = np.array([r[2] for r in held], np.int64)
            lists = graph.build(_units([r[3] for r in held]).astype(np.float32))
            yield common.batch(LISTS, rows, [rows[own[own >= 0]].tolist() for own in lists])

    shards = members.select(F.col("home.cell").alias("cell"), F.col("home.block").alias("block"), "row", "vector")
    lists = common.map_arrow(_dealt(shards, ["cell", "block"]), run, LISTS)
    return written(lists.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")


def _searched(members: DataFrame, united: DataFrame, least: float) -> DataFrame:
    """Verified links of all vectors with those of their shards: forests, and numbers of links.

    A pair that lies in several cells counts in the first. In a cell of several blocks each vector
    searches all of them.
    """
    every = members.join(united, "row").select(
        F.col("home.cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("home.blocks") - 1)).alias("block"),
        "row", "vector", "near", "cells", "copies", F.col("home.block").alias("own"),
    )

    def run(batches):
        for held in common.groups(batches, 2):
            cell, block = held[0][:2]
            vectors = _units([r[3] for r in held])
            inside = np.array([r[7] == block for r in held])
            nodes = np.flatnonzero(inside)
            if not len(nodes):
                continue
            rows = np.array([r[2] for r in held], np.int64)
            copies = np.array([r[6] for r in held], np.int64)
            node_rows = rows[nodes]  # ascending
            lists = [np.array(held[k][4], np.int64) for k in nodes]
            owner = np.repeat(np.arange(len(nodes)), [len(x) for x in lists])
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            local = np.searchsorted(node_rows, flat).clip(0, len(nodes) - 1)
            hit = node_rows[local] == flat
            owner, local = owner[hit], local[hit]
            counts = np.bincount(owner, minlength=len(nodes))
            neighbours = np.full((len(nodes), max(1, counts.max(initial=1))), -1, np.int32)
            neighbours[owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)] = local
            single = vectors.astype(np.float32)
            self_ = np.where(inside, np.cumsum(inside) - 1, -1)
            query, node = graph.range_search(single[nodes], neighbours, single, self_, least - SLACK)
            node = nodes[node]
            if inside.all():  # both directions of a pair are here: either one finds it
                keys = np.unique(np.concatenate([query * len(held) + node, node * len(held) + query]))
                query, node = np.divmod(keys, len(held))
            sure = (np.einsum("nd,nd->n", vectors[query], vectors[node]) >= least) & (query != node)
            query, node = query[sure], node[sure]
            cells = [set(r[5]) for r in held]
            ours = np.fromiter((min(cells[a] & cells[b]) == cell for a, b in zip(query.tolist(), node.tolist())), bool, len(query))
            query, node = query[ours], node[ours]
            found = np.bincount(query, minlength=len(held))
            links = np.bincount(query, copies[node], minlength=len(held)).astype(np.int64)
            linked = np.flatnonzero(found)
            yield common.batch(FOUND, rows[linked], [None] * len(linked), found[linked], links[linked])
            edges = _forest(query, node, len(held))
            yield common.batch(FOUND, rows[[a for a, _ in edges]], rows[[b for _, b in edges]], [0] * len(edges), [0] * len(edges))

    return written(common.map_arrow(_dealt(every, ["cell", "block"]), run, FOUND), "found")


def _forest(left: np.ndarray, right: np.ndarray, count: int) -> list[tuple[int, int]]:
    parent = list(range(count))
    out = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = a, b
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def true_links(reps: DataFrame, least: float, audited: int = AUDITED) -> np.ndarray:
    """Rows (vector, number of its links by brute force) of audited vectors that have links.

    About `audited` vectors are drawn, then five times as many and so on, until ENOUGH of them have
    few links, all are drawn or MOST are: a few large groups can make up nearly all of the links.
    """
    total = reps.count()
    drawn = reps.select("row", "vector", F.pmod(F.xxhash64("row", F.lit(17)), F.lit(1 << 30)).alias("draw"))
    schema = pa.schema([("u", pa.int64()), ("true", pa.int64())])
    out, before = np.zeros((0, 2), np.int64), 0
    while total and before < 1 << 30 and before * total < MOST << 30 and (out[:, 1] <= FEW).sum() < ENOUGH:
        until = min(1 << 30, -(-min(audited, MOST) << 30) // total)
        audited *= 5
        table = drawn.where((F.col("draw") >= before) & (F.col("draw") < until)).toArrow()
        before = until
        rows = np.array(table["row"].to_pylist(), np.int64)
        if not len(rows):
            continue
        shared = reps.sparkSession.sparkContext.broadcast((rows, _units(table["vector"].to_pylist())))

        def run(batches):
            queries, units = shared.value  # noqa: B023
            counts = np.zeros(len(queries), np.int64)
            for b in batches:
                raw = common.texts(b.column(1))
                for start in range(0, len(queries) if raw else 0, SHARD):
                    part = slice(start, start + SHARD)
                    near = _units(raw) @ units[part].T >= least
                    near &= b.column(0).to_numpy()[:, None] != queries[None, part]
                    counts[part] += near.sum(0)
            linked = np.flatnonzero(counts)
            yield common.batch(schema, queries[linked], counts[linked])

        counted = common.map_arrow(reps.select("row", "vector"), run, schema).groupBy("u").agg(F.sum("true").alias("true")).toArrow()
        out = np.concatenate([out, np.stack([counted["u"].to_numpy(), counted["true"].to_numpy()], 1)])
    return out


def audit_recall(true: np.ndarray, found: DataFrame) -> float:
    """Recall of the search for the audited vectors: the mean of their shares of links found, taken over those with
    at most FEW links and over the others; the lower of the two."""
    spark = found.sparkSession
    wanted = spark.createDataFrame(pa.table({"u": true[:, 0], "true": true[:, 1]}))
    got = found.where("v is null").groupBy("u").agg(F.sum("found").alias("found"))
    share = F.least("true", F.coalesce("found", F.lit(0))) / F.col("true")
    kinds = wanted.join(got, "u", "left").groupBy(F.col("true") <= FEW).agg(F.avg(share).alias("share")).collect()
    return min([1.0, *[row["share"] for row in kinds]])


def _links(reps: DataFrame, size: int, least: float, recall: float) -> DataFrame:
    """Verified links of vectors of one length, searched until the audit finds recall high enough."""
    total = reps.count()
    share = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(1, total)) * (1 << 30)))
    sample = reps.where(share).select("row", "vector").toArrow().sort_by("row")["vector"].to_pylist()
    overlap = OVERLAP
    audited = true_links(reps, least)
    while True:
        count = min(CENTRES, max(1, overlap * total // SHARD))
        centres = fit_centres(_units(sample).astype(np.float32), count) if sample else np.zeros((1, size), np.float32)
        overlap = min(overlap, len(centres))
        placed = written(reps.join(_assigned(reps, centres, overlap), "row").withColumn("home", F.explode("homes")).drop("homes"), "members")
        found = _searched(placed, _graphs(placed), least)
        if audit_recall(audited, found) >= recall or overlap >= len(centres):
            return found
        overlap *= 2


def near_duplicates(
    table: DataFrame, embedding: str = "embedding", id_col: str = "vec_id", least: float = 0.95, recall: float = RECALL
) -> DataFrame:
    """Per vector its id, `n_links`, `component_id` and `kept`.

    Vectors link when their cosine is at least `least` in double precision. Null, empty and zero
    vectors and those with null or non-finite components link with nothing. Vectors of each
    length are compared with one another. `n_links` counts the other rows linked directly, copies included;
    `component_id` is the smallest id reachable by links and `kept` whether it is the row's own.
    One row per row in. Rows with null or repeated ids keep their own row; of rows with one id the
    first is kept.
    """
    spark = table.sparkSession
    common.prepare(spark)
    rows = common.keyed(table.select(common.quoted(id_col), common.quoted(embedding)), id_col, embedding)
    checked = _checked(rows, embedding)
    usable = checked.where("size > 0")
    classes = written(usable.groupBy("d1", "d2").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = written(usable.select("row", "size", "vector").join(classes.select("row", "copies"), "row"), "representatives")
    found = spark.createDataFrame([], "u long, v long, found long, links long")
    for size in sorted(r["size"] for r in reps.groupBy("size").count().where("count > 1").collect()):
        found = found.unionByName(_links(reps.where(F.col("size") == size), size, least, recall))
    linked = connected_components(found.where("v is not null"), "u", "v")
    counts = found.where("v is null").groupBy(F.col("u").alias("row")).agg(F.sum("links").alias("others"))
    named = classes.join(linked.withColumnRenamed("node", "row"), "row", "left").join(counts, "row", "left").select(
        "d1", "d2", F.coalesce("component", "row").alias("component"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    named = written(named, "components")
    linking = F.col("size") > 0
    own = checked.where(linking).select("row", "d1", "d2").join(named, ["d1", "d2"]).select("row", "n_links", "component")
    alone = checked.where(~linking).select("row", F.lit(0).cast("bigint").alias("n_links"), F.col("row").alias("component"))
    result = own.unionByName(alone).withColumn("kept", F.col("row") == F.col("component"))
    kind = dict(rows.dtypes)[id_col]
    if common.id_is_key(rows, id_col):
        return result.select(F.col("row").cast(kind).alias(id_col), "n_links", F.col("component").cast(kind).alias("component_id"), "kept")
    ids = rows.select(F.col(common.ROW).alias("row"), common.quoted(id_col).alias("_id"))
    heads = ids.select(F.col("row").alias("component"), F.col("_id").alias("component_id"))
    return result.join(ids, "row").join(heads, "component").select(F.col("_id").alias(id_col), "n_links", "component_id", "kept")
