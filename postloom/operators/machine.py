"""Linear support vector machines, one per class against the rest, on sparse TF-IDF weights.

The objective is that of Spark's LinearSVC without standardization: the weighted mean of the hinge
loss plus the squared length of the coefficients times half the regularization, with a free
intercept. L-BFGS started at zero never leaves the span of the rows, so each of its vectors is kept
as one number per row (its combination of the rows) and its products with the rows. An iteration
needs one distributed product with all rows and sends one number per row and class to the driver,
whatever the size of the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.vectors import fit_terms, numbered, tasks, weights
from postloom.session import importable, written

PAIRS_PER_TASK = 1_000_000
CHUNK = 8192  # rows whose sums travel together
MEMORY = 10  # steps L-BFGS remembers
WINDOW = 20  # iterations over which the loss has to stand still
TRIALS = 40

_POSTINGS = "part int, feature binary, start binary, row binary, value binary"


@dataclass
class MachineFit:
    """`terms` has the coefficients per class in `coefs`."""

    terms: DataFrame
    intercepts: list[float]


def _pack(shared):
    """All terms of a partition in one row: per term its rows (as places in the sorted numbers) and weights."""

    def pack(batches):
        tables = [batch for batch in batches if batch.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        row, feature, value = (table.column(name).to_numpy() for name in ("_row", "feature", "weight"))
        order = np.lexsort((row, feature))
        row, feature, value = row[order], feature[order], value[order]
        start = np.nonzero(np.r_[True, feature[1:] != feature[:-1]])[0]
        place = np.searchsorted(shared.value, row).astype(np.int32)
        held = [feature[start].astype(np.int64), start.astype(np.int64), place, value.astype(np.float64)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(feature[0]) % 2**31], pa.int32()), *[pa.array([one.tobytes()], pa.binary()) for one in held]],
            names=["part", "feature", "start", "row", "value"],
        )

    return pack


def _blocks(batches):
    for batch in batches:
        for one in batch.to_pylist():
            kinds = {"feature": np.int64, "start": np.int64, "row": np.int32, "value": np.float64}
            yield one["part"], *(np.frombuffer(one[name], kind) for name, kind in kinds.items())


def _per_term(by_row: np.ndarray, start: np.ndarray, row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums over the rows of every term, per class."""
    return np.add.reduceat(by_row[row] * value[:, None], start, axis=0)


def _row_sums(shared):
    """The part of rows times rows times `shared` that the terms of a block make, in chunks of rows."""

    def sums(batches):
        by_row = shared.value
        for part, _, start, row, value in _blocks(batches):
            of_pair = np.repeat(_per_term(by_row, start, row, value), np.diff(np.r_[start, len(row)]), axis=0)
            of_pair *= value[:, None]
            total = np.stack([np.bincount(row, one, len(by_row)) for one in of_pair.T], axis=1)
            for chunk, first in enumerate(range(0, len(total), CHUNK)):
                held = pa.array([total[first : first + CHUNK].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), held], names=["chunk", "part", "sums"]
                )

    return sums


def _added(batches):
    """Sums per chunk, added in the order of their blocks."""
    found: dict[int, list] = {}
    for batch in batches:
        for one in batch.to_pylist():
            found.setdefault(one["chunk"], []).append((one["part"], one["sums"]))
    for chunk, parts in found.items():
        total = sum(np.frombuffer(sums) for _, sums in sorted(parts))
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "sums"]
        )


def _coefficients(shared):
    def coefficients(batches):
        for _, feature, start, row, value in _blocks(batches):
            found = _per_term(shared.value, start, row, value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(feature), pa.array(list(found), pa.list_(pa.float64()))], names=["feature", "coefs"]
            )

    return coefficients


@dataclass
class _Vector:
    """A vector per class: combination of the rows, products with the rows, and the intercept."""

    rows: np.ndarray
    margins: np.ndarray
    free: np.ndarray

    def dot(self, other: _Vector) -> np.ndarray:
        return np.einsum("nk,nk->k", self.rows, other.margins) + self.free * other.free

    def plus(self, factor: np.ndarray, other: _Vector) -> _Vector:
        return _Vector(
            self.rows + factor * other.rows, self.margins + factor * other.margins, self.free + factor * other.free
        )

    def times(self, factor) -> _Vector:
        return _Vector(self.rows * factor, self.margins * factor, self.free * factor)


def _direction(gradient: _Vector, memory: list[tuple[_Vector, _Vector, np.ndarray]], scale: np.ndarray) -> _Vector:
    """Minus the gradient times the estimate of the inverse second derivatives."""
    found, factors = gradient, []
    for step, change, inverse in reversed(memory):
        factors.append(inverse * step.dot(found))
        found = found.plus(-factors[-1], change)
    found = found.times(scale)
    for (step, change, inverse), factor in zip(memory, reversed(factors)):
        found = found.plus(factor - inverse * change.dot(found), step)
    return found.times(-1.0)


def minimize(product, signs: np.ndarray, weight: np.ndarray, reg: float, tol: float, iterations: int) -> tuple[_Vector, np.ndarray]:
    """The machines of all classes at once, and their losses.

    `product` takes a matrix with a row per text and multiplies it by the texts' products with each
    other; `signs` is 1 where a text is of the class and -1 elsewhere. A class is done when its
    loss fell by less than `tol` over the last iterations or its gradient is that small.
    """
    n, classes = signs.shape
    share = (weight / weight.sum())[:, None]
    zero = np.zeros((n, classes))
    at = _Vector(zero, zero, np.zeros(classes))

    def loss(v: _Vector) -> np.ndarray:
        hinge = np.maximum(1.0 - signs * (v.margins + v.free), 0.0)
        return (share * hinge).sum(axis=0) + 0.5 * reg * np.einsum("nk,nk->k", v.rows, v.margins)

    def slope(v: _Vector, along: _Vector) -> np.ndarray:
        missed = signs * (v.margins + v.free) < 1.0
        steep = (share * signs * (along.margins + along.free) * missed).sum(axis=0)
        return reg * np.einsum("nk,nk->k", along.rows, v.margins) - steep

    def gradient(v: _Vector) -> _Vector:
        pull = -share * signs * (signs * (v.margins + v.free) < 1.0)
        return _Vector(reg * v.rows + pull, reg * v.margins + product(pull), pull.sum(axis=0))

    now, uphill, memory = loss(at), gradient(at), []
    first, past, scale = now.copy(), [now], np.ones(classes)
    going = np.ones(classes, bool)
    for turn in range(iterations):
        along = _direction(uphill, memory, scale)
        down = uphill.dot(along)
        going &= down < 0
        step = np.ones(classes) if turn else 1.0 / np.sqrt(np.maximum(uphill.dot(uphill), 1e-30))
        low, high, found = np.zeros(classes), np.full(classes, np.inf), ~going
        for _ in range(TRIALS):
            tried = at.plus(step, along)
            long = loss(tried) > now + 1e-4 * step * down
            short = ~long & (slope(tried, along) < 0.9 * down)
            found |= ~long & ~short
            if found.all():
                break
            high, low = np.where(~found & long, step, high), np.where(~found & short, step, low)
            halved = np.where(np.isinf(high), 2.0 * low, 0.5 * (low + high))
            step = np.where(found, step, halved)
        # without a step that is long enough, the longest one that lowered the loss is taken
        step = np.where(going, np.where(found, step, low), 0.0)
        going &= step > 0
        if not going.any():
            break
        moved = along.times(step)
        at = at.plus(1.0, moved)
        after = gradient(at)
        change = after.plus(-1.0, uphill)
        bend, size = moved.dot(change), change.dot(change)
        kept = bend > 1e-15
        memory = [*memory, (moved, change, np.where(kept, 1.0 / np.where(kept, bend, 1.0), 0.0))][-MEMORY:]
        scale = np.where(kept, bend / np.where(kept, size, 1.0), scale)
        now, uphill = loss(at), after
        past = [*past, now][-WINDOW:]
        still = np.max(past, axis=0) - now <= tol * first
        flat = np.sqrt(np.maximum(uphill.dot(uphill), 0.0)) <= np.maximum(tol * now, 1e-8)
        going &= ~(still | flat)
        if not going.any():
            break
    return at, now


def fit_machine(
    docs: DataFrame, label: str, weight: str, text: str, reg: float, tol: float, iterations: int
) -> MachineFit:
    """One machine per class of `docs`, whose labels are 0.0, 1.0, ..."""
    spark = docs.sparkSession
    context = spark.sparkContext
    importable(spark)
    docs = numbered(docs.select(F.col(label).cast("int").alias("label"), F.col(weight).cast("double").alias("weight"), text))
    terms = fit_terms(docs, text)
    known = docs.select("_row", "label", "weight").toArrow().sort_by("_row")
    ids, labels, row_weights = (known.column(name).to_numpy() for name in ("_row", "label", "weight"))
    signs = np.where(labels[:, None] == np.arange(labels.max() + 1), 1.0, -1.0)
    shared_ids = context.broadcast(ids)
    n_tasks = tasks(docs, terms.agg(F.sum("df")).first()[0] or 0, PAIRS_PER_TASK)
    pairs = weights(docs, terms, text).repartition(n_tasks, "feature")
    postings = written(pairs.mapInArrow(_pack(shared_ids), _POSTINGS), "postings")
    gather = min(-(-len(ids) // CHUNK), context.defaultParallelism)

    def product(by_row: np.ndarray) -> np.ndarray:
        shared = context.broadcast(by_row)
        sums = postings.mapInArrow(_row_sums(shared), "chunk int, part int, sums binary").repartition(gather, "chunk")
        found = sums.mapInArrow(_added, "chunk int, sums binary").toArrow().to_pylist()
        out = np.zeros_like(by_row)
        for one in found:
            out[one["chunk"] * CHUNK : (one["chunk"] + 1) * CHUNK] = np.frombuffer(one["sums"]).reshape(-1, by_row.shape[1])
        shared.unpersist()
        return out

    best, _ = minimize(product, signs, row_weights, reg, tol, iterations)
    coefs = postings.mapInArrow(_coefficients(context.broadcast(best.rows)), "feature bigint, coefs array<double>")
    return MachineFit(written(terms.join(coefs, "feature"), "terms"), best.free.tolist())


def predict_machine(fit: MachineFit, docs: DataFrame, text: str) -> DataFrame:
    """`(_row, prediction)` for numbered rows: the class with the largest margin, the first one on ties."""
    names = [f"_{k}" for k in range(len(fit.intercepts))]
    sums = [F.sum(F.col("weight") * F.col("coefs")[k]).alias(name) for k, name in enumerate(names)]
    found = weights(docs, fit.terms, text, ("coefs",)).groupBy("_row").agg(*sums)
    margins = F.array(*[F.coalesce(name, F.lit(0.0)) + F.lit(free) for name, free in zip(names, fit.intercepts)])
    every = docs.select("_row").join(found, "_row", "left").select("_row", margins.alias("margins"))
    first = F.array_position("margins", F.array_max("margins")) - 1
    return every.select("_row", first.cast("double").alias("prediction"))
