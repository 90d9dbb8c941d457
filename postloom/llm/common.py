"""Helpers shared by the operators: packing Arrow columns, row keys, and scratch tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.session import written

ROW = "__row"  # names with two underscores in front are reserved
INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def prepare(spark: SparkSession) -> None:
    """Make this package importable in Python workers of a local session and keep Arrow batches small.

    On a cluster the package is handed to the executors with `--py-files`. A batch of a thousand
    rows bounds what a Python worker holds at once; long texts are bounded by Spark's own limit of
    bytes per batch.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def texts(column: pa.Array) -> list[bytes]:
    """Bytes of a binary or string column; null reads as the empty text."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def pack(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the next `lengths[i]` items of `values`."""
    item = values.dtype.itemsize
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(np.asarray(lengths, np.int64) * item, out=offsets[1:])
    if offsets[-1] >= 2**31:
        raise ValueError("more than 2 GB in one batch")
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), data])


def unpack(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All items of a binary column without nulls, and the number of items of each row."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    item = np.dtype(kind).itemsize
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, kind), np.zeros(len(column), np.int64)
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(values.tobytes(), kind), np.diff(offsets).astype(np.int64) // item


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def empty(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator on an array of uint64; fixed values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(docs: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """`columns` with a key `ROW` that is unique and ordered as `id_col`, nulls first.

    The id itself serves as the key where it is an integer, never null and never repeated (checked
    by one count over that column). Otherwise rows are range-partitioned by id, ties by their other
    columns, numbered in that order, and written, so that the numbers hold whatever is recomputed.
    """
    chosen = docs.select(quoted(id_col), *[quoted(c) for c in columns if c != id_col])
    if dict(chosen.dtypes)[id_col] in INTEGRAL:
        total, known, distinct = chosen.agg(
            F.count(F.lit(1)), F.count(quoted(id_col)), F.countDistinct(quoted(id_col))
        ).first()
        if total == distinct == known:
            return chosen.withColumn(ROW, quoted(id_col).cast("bigint"))
    tie = F.xxhash64(*[quoted(c) for c in chosen.columns])
    parts = int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = chosen.withColumn("__tie", tie).repartitionByRange(parts, quoted(id_col), "__tie")
    ordered = ranged.sortWithinPartitions(quoted(id_col), "__tie")
    return written(ordered.withColumn(ROW, F.monotonically_increasing_id()).drop("__tie"), "rows")


def id_is_key(rows: DataFrame, id_col: str) -> bool:
    """Whether the `ROW` of a table made by `keyed` is the id itself and not a number given to it."""
    if dict(rows.dtypes)[id_col] not in INTEGRAL:
        return False
    same = F.col(ROW).eqNullSafe(quoted(id_col).cast("bigint"))
    return rows.select(ROW, quoted(id_col)).where(~same).isEmpty()


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of `df` other than `names`, whose results replace them."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(df: DataFrame, function, schema: pa.Schema) -> DataFrame:
    """`mapInArrow` with an Arrow schema and at least one (empty) batch per partition."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield empty(schema)
        yield from function(batches)

    return df.mapInArrow(run, from_arrow_schema(schema))


def map_text(docs: DataFrame, text: str, kinds: dict[str, pa.DataType], make, replace_text: bool = False) -> DataFrame:
    """`docs` with the columns `kinds` worked out from the bytes of `text`, one row per row.

    `make()` runs once per partition and returns a function from the list of texts of a batch to
    the list of result rows. Input columns named like a result are replaced; other columns pass
    through. With `replace_text` the text column itself does not pass through.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    names = [*kinds, *([text] if replace_text else [])]
    passed = docs.select(*[quoted(c) for c in without(docs, names)])
    passed_schema = to_arrow_schema(passed.schema) if passed.columns else pa.schema([])
    source = docs.select(*[quoted(c) for c in passed.columns], quoted(text).cast("string").cast("binary").alias("__text"))
    schema = pa.schema([*passed_schema, *[pa.field(name, kind) for name, kind in kinds.items()]])

    def run(batches):
        own = make()
        for b in batches:
            rows = own(texts(b.column(b.num_columns - 1)))
            columns = [b.column(k) for k in range(b.num_columns - 1)]
            made = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*columns, *made], schema=schema)

    return map_arrow(source, run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches as lists that agree in the first `keys` columns."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*[column.to_pylist() for column in b.columns]):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held
