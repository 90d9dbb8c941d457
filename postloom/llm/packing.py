"""Packing documents into sequences along a space-filling curve.

A document's token ids are hashed into a small vector and projected to three dimensions; its place
on a Hilbert curve through these is its sort key. Documents are range-partitioned and sorted by
key, and each partition fills sequences with neighbouring documents one after another. What is left
in the last sequence of a partition is cut into lengths that are powers of two, which need no
padding. The key ends in a hash of the id, so copies of one document spread over partitions.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import common
from postloom.llm.pieces import PATTERN, Pieces
from postloom.llm.tokens import load_tokenizer
from postloom.session import written

BUCKETS, DIMENSIONS, BITS = 64, 3, 10
SHUFFLE_BYTES = 64 * 1024 * 1024
ENCODED = pa.schema([("n", pa.int64()), ("curve", pa.int64()), ("ids", pa.binary())])


class Encoder:
    """Ids of texts as the tokenizers library gives them.

    With a rank file of the same vocabulary, pieces in Latin letters without added tokens are
    encoded from it, which is faster; all others by the library itself.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        self.tokenizer = load_tokenizer(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.fast = _from_ranks(ranks_path).encode_ordinary if ranks_path else None
        self.pieces = Pieces(self._piece)

    def _piece(self, piece: str) -> bytes:
        if self.fast and (not piece or max(piece) <= "ɏ") and not any(t in piece for t in self.added):
            ids = self.fast(piece)
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces.values(text)), self.kind)


@lru_cache(1)
def _from_ranks(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def encoder(path: str, ranks_path: str | None) -> Encoder:
    return Encoder(path, ranks_path)


@lru_cache(1)
def _directions() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS))


def document_vector(ids: np.ndarray) -> np.ndarray:
    """Signed counts of hashed ids, of length one (zero for no ids)."""
    mixed = common.mix(ids.astype(np.uint64) + np.uint64(1))
    sign = 1.0 - 2.0 * ((mixed >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
    vector = np.bincount((mixed % np.uint64(BUCKETS)).astype(np.int64), sign, BUCKETS)
    size = np.sqrt((vector * vector).sum())
    return vector / size if size else vector


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (n, d): undo the excess work, then Gray-decode."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | (x[i] >> bit & 1)
    return index


def curve_positions(vectors: np.ndarray) -> np.ndarray:
    """Hilbert positions of document vectors: projected, squeezed into (0, 1), put on a grid."""
    projected = vectors @ _directions()
    grid = ((0.5 + np.arctan(projected) / np.pi) * (1 << BITS)).astype(np.int64)
    return hilbert_index(np.clip(grid, 0, (1 << BITS) - 1))


def pack_documents(
    docs: DataFrame,
    path: str,
    text: str = "text",
    id_col: str = "doc_id",
    length: int = 1024,
    end_id: int = 0,
    ranks_path: str | None = None,
    ids: bool = False,
) -> DataFrame:
    """Pieces of all documents in sequences of `length` tokens, without padding.

    A document is its ids (null text: none) followed by `end_id`. One row per piece: the id column,
    `start` and `length` in the document, `ids_crc32` of its ids as little-endian 32-bit numbers,
    `doc_tokens`, `sequence_id`, `offset` in the sequence; with `ids` also `ids` (array of int).
    Every id lies in exactly one piece. Sequences have `length` tokens, but the last ones of a
    partition have a power of two. Rows with equal or null ids are documents of their own. The
    result is written before it is returned, so that sequence ids hold. `path` names a tokenizers
    file, `ranks_path` a rank file of the same vocabulary.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    kinds = {f.name: f.type for f in ENCODED}
    chosen = docs.select(common.quoted(id_col).alias("doc"), common.quoted(text).alias("body"))

    def encoded():
        own = encoder(path, ranks_path)

        def run(values):
            found = [own.encode(value.decode()) for value in values]
            vectors = np.array([document_vector(x) for x in found]) if found else np.zeros((0, BUCKETS))
            curve = curve_positions(vectors)
            return [(len(x) + 1, int(c), x.tobytes()) for x, c in zip(found, curve)]

        return run

    made = common.map_text(chosen, "body", kinds, encoded, replace_text=True)
    tie = F.pmod(F.xxhash64("doc"), F.lit(1 << 32))
    table = written(made.withColumn("key", F.shiftleft(F.col("curve"), 32) + tie).drop("curve"), "encoded")
    size = table.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * size // SHUFFLE_BYTES))
    ordered = table.repartitionByRange(parts, "key").sortWithinPartitions("key")
    width = 2 if load_tokenizer(path).get_vocab_size() <= 1 << 16 else 4
    return written(_packed(ordered.select("doc", "ids"), id_col, length, end_id, width, ids), "packed")


def _packed(ordered: DataFrame, id_col: str, length: int, end_id: int, width: int, ids: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    doc_type = to_arrow_schema(ordered.schema).field("doc").type
    fields = [
        (id_col, doc_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if ids else []))

    def rows_of(sequence: list, number: int) -> list[tuple]:
        out, offset = [], 0
        for doc, start, part, total in sequence:
            row = (doc, start, len(part), zlib.crc32(part.tobytes()), total, number, offset)
            out.append((*row, part) if ids else row)
            offset += len(part)
        return out

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        open_, room = [], length
        for b in batches:
            out = []
            for doc, raw in zip(b.column(0).to_pylist(), common.texts(b.column(1))):
                whole = np.append(np.frombuffer(raw, f"<u{width}").astype("<u4"), np.uint32(end_id))
                start = 0
                while start < len(whole):
                    part = whole[start : start + room]
                    open_.append((doc, start, part, len(whole)))
                    start += len(part)
                    room -= len(part)
                    if not room:
                        out += rows_of(open_, number)
                        number += 1
                        open_, room = [], length
            if out:
                yield common.batch(schema, *zip(*out))
        rest = length - room
        out = []
        while rest:  # the largest power of two first
            size = 1 << (rest.bit_length() - 1)
            taken, need = [], size
            while need:
                doc, start, part, total = open_.pop(0)
                taken.append((doc, start, part[:need], total))
                if len(part) > need:
                    open_.insert(0, (doc, start + need, part[need:], total))
                need -= min(need, len(part))
            out += rows_of(taken, number)
            number += 1
            rest -= size
        if out:
            yield common.batch(schema, *zip(*out))

    return common.map_arrow(ordered, run, schema)
