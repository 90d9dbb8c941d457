"""A random forest on sparse TF-IDF weights, grown level by level over all trees at once.

Spark's own forest writes every row as one number per term of the vocabulary, which grows with the
rows times the vocabulary. Here a row keeps only the terms it has. The work follows Spark's forest:
Poisson bags, a draw of sqrt(terms) terms per node, Gini impurity, votes by leaf shares.

Weights are compared by cells of a logarithmic grid, 64 to the octave; a term a row does not have
is below all cells. Sums are kept as whole numbers, so a forest does not depend on their order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.operators.vectors import fit_terms, numbered, tasks, weights
from postloom.session import importable, written

CELLS = 64  # per octave of the weight
UNIT = 1 << 20  # row weights are counted in this share of one
ROWS = 500  # rows of a batch that are walked at once
ROWS_PER_TASK = 8_000
SUMS_PER_TASK = 2_000_000
LEAF, OPEN = -1, -2

# P(X <= k) of a Poisson variable with mean 1
BAGS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])

_SUMS = "node int, feature bigint, cell int, label int, w bigint, n bigint"
_SPLIT = "node int, gain double, feature bigint, cell int, n bigint, w array<bigint>"


@dataclass
class Nodes:
    """All trees in one numbering; the root of tree t is node t.

    `feature` is LEAF or OPEN where nothing is split. Rows whose cell of the feature is at least
    `cell` go to the node `right`, all others to `right - 1`. `w` and `n` are the class weights and the rows.
    """

    feature: np.ndarray
    cell: np.ndarray
    right: np.ndarray
    w: np.ndarray
    n: np.ndarray


@dataclass
class ForestFit:
    terms: DataFrame
    nodes: DataFrame
    trees: int


def cell(weight: str) -> Column:
    return F.floor(F.log2(weight) * CELLS).cast("int")


def sparse_rows(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """Numbered rows with the arrays `features` (ascending) and `cells`; empty arrays without a known term."""
    found = weights(docs, terms, text).select("_row", F.struct("feature", cell("weight").alias("cell")).alias("pair"))
    pairs = found.groupBy("_row").agg(F.array_sort(F.collect_list("pair")).alias("pairs"))
    both = docs.join(pairs, "_row", "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<feature:bigint,cell:int>>")))
    return both.select("*", F.col("pairs.feature").alias("features"), F.col("pairs.cell").alias("cells")).drop("pairs")


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(x.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64))


def _bags(rows: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each tree takes each row."""
    tree = _hashed(np.arange(trees), seed)
    drawn = _hashed(_hashed(rows, seed)[:, None] ^ tree[None, :], seed)
    return np.searchsorted(BAGS, (drawn >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")


def _parts(batch: pa.RecordBatch):
    """Slices of a batch as numpy arrays: the slice, and row in the slice, feature and cell of every pair."""
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        features, cells = part.column("features"), part.column("cells")
        lengths = np.diff(features.offsets.to_numpy())
        row = np.repeat(np.arange(part.num_rows), lengths)
        yield part, row, features.flatten().to_numpy(), cells.flatten().to_numpy()


def _walk(nodes: Nodes, trees: int, rows: int, row: np.ndarray, feature: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The node every row ends in, per tree."""
    used = np.unique(nodes.feature[nodes.feature >= 0])
    at = np.tile(np.arange(trees), (rows, 1))
    if not len(used):
        return at
    place = np.minimum(np.searchsorted(used, feature), len(used) - 1)
    known = used[place] == feature
    # ends with a key that no row has
    keys = np.append(row[known] * len(used) + place[known], rows * len(used))
    values = np.append(cells[known], 0)
    wanted = np.searchsorted(used, nodes.feature)
    flat, going = at.reshape(-1), np.arange(rows * trees)
    going = going[nodes.feature[flat] >= 0]
    while len(going):
        node = flat[going]
        key = (going // trees) * len(used) + wanted[node]
        found = np.searchsorted(keys, key)
        above = (keys[found] == key) & (values[found] >= nodes.cell[node])
        flat[going] = nodes.right[node] - 1 + above
        going = going[nodes.feature[flat[going]] >= 0]
    return flat.reshape(rows, trees)


def _level_sums(shared, trees: int, seed: int, share: float):
    """Per open node and drawn term: weight and rows by cell and class; feature -1 has all rows of a root."""
    limit = np.uint64(min(int(share * 2.0**32), 2**32 - 1))

    def sums(batches):
        nodes = shared.value
        open_ = nodes.feature == OPEN
        draw = _hashed(np.arange(len(open_)), seed + 1) | np.uint64(1)
        for batch in batches:
            for part, row, feature, cells in _parts(batch):
                at = _walk(nodes, trees, part.num_rows, row, feature, cells)
                bags = _bags(part.column("_row").to_numpy(), trees, seed)
                label = part.column("label").to_numpy().astype(np.int64)
                unit = np.rint(part.column("weight").to_numpy() * UNIT).astype(np.int64)
                bags = np.where(open_[at], bags, 0)
                short = _hashed(feature, seed + 2) >> np.uint64(32)
                out = []
                if len(open_) == trees:
                    r, t = np.nonzero(bags)
                    out.append((at[r, t], np.full(len(r), -1), np.zeros(len(r), int), r, bags[r, t]))
                for tree in range(trees):
                    taken = np.nonzero(bags[row, tree])[0]
                    of = row[taken]
                    with np.errstate(over="ignore"):
                        drawn = (short[taken] * draw[at[of, tree]]) & np.uint64(0xFFFFFFFF)
                    # a multiplier spreads the upper bits only
                    drawn = drawn <= limit
                    taken, of = taken[drawn], of[drawn]
                    out.append((at[of, tree], feature[taken], cells[taken], of, bags[of, tree]))
                node, feat, cell_, of, n = (np.concatenate(one) for one in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node.astype(np.int32)), pa.array(feat.astype(np.int64)), pa.array(cell_.astype(np.int32)),
                        pa.array(label[of].astype(np.int32)), pa.array(unit[of] * n), pa.array(n.astype(np.int64)),
                    ],
                    names=["node", "feature", "cell", "label", "w", "n"],
                )

    return sums


def gini(w: np.ndarray) -> np.ndarray:
    total = np.maximum(w.sum(axis=-1, keepdims=True), 1)
    return 1.0 - ((w / total) ** 2).sum(axis=-1)


def _best_splits(shared, least: int):
    """The best split per node among the terms of a partition, which holds all sums of a term and node."""

    def best(batches):
        tables = [batch for batch in batches if batch.num_rows]
        if not tables:
            return
        nodes = shared.value
        table = pa.Table.from_batches(tables)
        node, feature, cell_, label, w, n = (table.column(k).to_numpy() for k in range(6))
        order = np.lexsort((-cell_, feature, node))
        node, feature, cell_, label, w, n = (one[order] for one in (node, feature, cell_, label, w, n))
        new_group = np.r_[True, (node[1:] != node[:-1]) | (feature[1:] != feature[:-1])]
        new_cell = new_group | np.r_[True, cell_[1:] != cell_[:-1]]
        first, entry = np.nonzero(new_cell)[0], np.cumsum(new_cell) - 1
        by_class = np.zeros((len(first), nodes.w.shape[1]), np.int64)
        np.add.at(by_class, (entry, label), w)
        rows = np.add.reduceat(n, first)
        # sums over all higher cells of the same term
        starts = np.nonzero(new_group[first])[0]
        group = np.cumsum(new_group[first]) - 1
        right, right_n = np.cumsum(by_class, axis=0), np.cumsum(rows)
        right -= (right[starts] - by_class[starts])[group]
        right_n -= (right_n[starts] - rows[starts])[group]
        node, feature, cell_ = node[first], feature[first], cell_[first]
        total, total_n = nodes.w[node], nodes.n[node]
        left, left_n = total - right, total_n - right_n
        share = right.sum(axis=1) / np.maximum(total.sum(axis=1), 1)
        gain = gini(total) - share * gini(right) - (1 - share) * gini(left)
        gain = np.where((right_n >= least) & (left_n >= least), gain, 0.0)
        order = np.lexsort((cell_, feature, -gain, node))
        order = order[np.r_[True, node[order][1:] != node[order][:-1]]]
        order = order[gain[order] > 1e-12]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(node[order]), pa.array(gain[order]), pa.array(feature[order]), pa.array(cell_[order]),
                pa.array(right_n[order]), pa.array(list(right[order]), pa.list_(pa.int64())),
            ],
            names=["node", "gain", "feature", "cell", "n", "w"],
        )

    return best


def _grown(nodes: Nodes, splits: pa.Table, least: int, last: bool) -> Nodes:
    """The nodes after a level: open ones are split or become leaves, and their children follow."""
    feature, cell_, right = nodes.feature.copy(), nodes.cell.copy(), nodes.right.copy()
    feature[feature == OPEN] = LEAF
    if not splits.num_rows:
        return Nodes(feature, cell_, right, nodes.w, nodes.n)
    splits = splits.sort_by("node")
    node = splits.column("node").to_numpy()
    feature[node], cell_[node] = splits.column("feature").to_numpy(), splits.column("cell").to_numpy()
    right[node] = len(feature) + 2 * np.arange(len(node)) + 1
    right_w = np.array(splits.column("w").to_pylist(), np.int64).reshape(len(node), -1)
    right_n = splits.column("n").to_numpy()
    w = np.stack([nodes.w[node] - right_w, right_w], axis=1).reshape(2 * len(node), -1)
    n = np.stack([nodes.n[node] - right_n, right_n], axis=1).reshape(-1)
    done = last | ((w > 0).sum(axis=1) <= 1) | (n < 2 * least)
    none = np.zeros(len(n), np.int32)
    return Nodes(
        np.r_[feature, np.where(done, LEAF, OPEN)], np.r_[cell_, none], np.r_[right, none],
        np.r_[nodes.w, w], np.r_[nodes.n, n],
    )


def fit_forest(
    docs: DataFrame, label: str, weight: str, text: str, trees: int, depth: int, least: int, seed: int
) -> ForestFit:
    """A forest of `trees` trees over `docs`, whose labels are 0.0, 1.0, ...

    One pass over the rows per level: rows walk down the trees so far and add what they have of the
    terms drawn by their nodes. Sums and the choice of splits are spread by node and term; only the
    chosen split of each node reaches the driver.
    """
    spark = docs.sparkSession
    importable(spark)
    docs = numbered(docs.select(F.col(label).cast("int").alias("label"), F.col(weight).cast("double").alias("weight"), text))
    terms = fit_terms(docs, text)
    rows, classes = docs.agg(F.count("*"), F.max("label")).first()
    count = max(terms.count(), 1)
    n_tasks = tasks(docs, rows, ROWS_PER_TASK)
    table = written(sparse_rows(docs, terms, text).drop(text).repartition(n_tasks, "_row"), "sparse")
    classes = (classes or 0) + 1
    none = np.zeros(trees, np.int32)
    nodes = Nodes(np.full(trees, OPEN), none, none, np.zeros((trees, classes), np.int64), np.zeros(trees, np.int64))
    share = math.ceil(math.sqrt(count)) / count
    for level in range(depth + 1):
        if level == depth or not (nodes.feature == OPEN).any():
            break
        shared = spark.sparkContext.broadcast(nodes)
        sums = table.mapInArrow(_level_sums(shared, trees, seed, share), _SUMS)
        sums = sums.groupBy("node", "feature", "cell", "label").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        sums = written(sums, "sums")
        if level == 0:
            for one in sums.where("feature = -1").toArrow().to_pylist():
                nodes.w[one["node"], one["label"]] = one["w"]
                nodes.n[one["node"]] += one["n"]
            nodes.feature[(nodes.w > 0).sum(axis=1) <= 1] = LEAF
            totals = spark.sparkContext.broadcast(nodes)
        else:
            totals = shared
        spread = sums.where("feature >= 0").repartition(n_tasks, "node", "feature")
        best = spread.mapInArrow(_best_splits(totals, least), _SPLIT)
        chosen = best.groupBy("node").agg(
            F.max_by(F.struct(*best.columns), F.struct("gain", -F.col("feature"), -F.col("cell"))).alias("split")
        )
        splits = chosen.select("split.*").toArrow()
        splits = splits.filter(pa.array(nodes.feature[splits.column("node").to_numpy()] == OPEN))
        nodes = _grown(nodes, splits, least, level + 1 == depth)
        shared.unpersist()
    nodes.feature[nodes.feature == OPEN] = LEAF
    shares = nodes.w / np.maximum(nodes.w.sum(axis=1, keepdims=True), 1)
    stored = pa.table(
        {
            "node": np.arange(len(nodes.feature)), "feature": nodes.feature.astype(np.int64),
            "cell": nodes.cell.astype(np.int32), "right": nodes.right.astype(np.int32),
            "shares": pa.array(list(shares), pa.list_(pa.float64())),
        }
    )
    return ForestFit(terms, written(spark.createDataFrame(stored), "nodes"), trees)


def _votes(shared, trees: int):
    def votes(batches):
        nodes, shares = shared.value
        for batch in batches:
            for part, row, feature, cells in _parts(batch):
                at = _walk(nodes, trees, part.num_rows, row, feature, cells)
                total = np.zeros((part.num_rows, shares.shape[1]))
                for tree in range(trees):
                    total += shares[at[:, tree]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array(np.argmax(total, axis=1).astype(np.float64))],
                    names=["_row", "prediction"],
                )

    return votes


def predict_forest(fit: ForestFit, docs: DataFrame, text: str) -> DataFrame:
    """`(_row, prediction)` for numbered rows: the class with the largest sum of leaf shares."""
    importable(docs.sparkSession)
    table = fit.nodes.orderBy("node").toArrow()
    feature, cell_, right = (table.column(name).to_numpy() for name in ("feature", "cell", "right"))
    shares = np.array(table.column("shares").to_pylist(), float).reshape(len(feature), -1)
    nodes = Nodes(feature, cell_, right, shares, right)
    shared = docs.sparkSession.sparkContext.broadcast((nodes, shares))
    rows = sparse_rows(docs.select("_row", text), fit.terms, text).select("_row", "features", "cells")
    rows = rows.repartition(tasks(docs, docs.count(), ROWS_PER_TASK), "_row")
    return rows.mapInArrow(_votes(shared, fit.trees), "_row bigint, prediction double")
