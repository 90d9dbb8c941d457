"""Two Bloom filters over a whole table: keys seen once, and keys seen at least twice.

Every task puts the hashes of its rows into both filters; filters of different tasks are merged by
or, and what is in the once-seen filters of two tasks goes to the twice-seen one. No repeated key
is ever missed. Keys that only look repeated are sorted out by whoever uses the filter. Tasks send
the positions they set, at most `probes` per distinct hash, cut into segments; so the size of what
moves follows the rows and not tasks times filter size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import common
from postloom.session import written

PROBES = 3
SEGMENTS = 256
BLOCK = 1 << 20
MIN_BITS = 1 << 18
MAX_BITS = 1 << 30  # 128 MB: the bound on what is broadcast. A fuller filter suspects more keys and misses none.
SCHEMA = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def size_for(keys: int) -> int:
    """Bits of a filter for about so many keys: sixteen per key, a power of two within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (16 * max(1, keys) - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int, probes: int = PROBES) -> np.ndarray:
    """The `probes` positions of each hash, one row per probe."""
    steps = np.arange(1, probes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (common.mix(hashes[None, :] + steps[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def twice_seen(rows: DataFrame, hashes_of, bits: int, once: bool = False, probes: int = PROBES) -> np.ndarray:
    """The packed twice-seen filter (or the once-seen one) of all hashes that `hashes_of(batch)` gives for the Arrow batches of `rows`.

    A hash counts once per batch and position in the returned array, so a function that returns
    the distinct hashes of each row counts rows.
    """
    spark = rows.sparkSession
    segment = bits // SEGMENTS

    def cut(sets: list[np.ndarray]):
        edges = [np.searchsorted(s, np.arange(SEGMENTS + 1) * segment) for s in sets]
        for k in range(SEGMENTS):
            single, twice = [(s[e[k] : e[k + 1]] - k * segment).astype(np.uint32) for s, e in zip(sets, edges)]
            if len(single):
                yield common.batch(SCHEMA, [k], [single.tobytes()], [twice.tobytes()])

    def local(batches):
        held, size = [], 0

        def flush():
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            yield from cut([np.unique(positions(h, bits, probes)) for h in (hashes, hashes[counts > 1])])

        for b in batches:
            held.append(hashes_of(b))
            size += len(held[-1])
            if size >= BLOCK:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def merge(batches):
        filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for k, single, twice in zip(*[c.to_pylist() for c in b.columns]):
                if k not in filters:
                    filters[k] = np.zeros(segment, bool), np.zeros(segment, bool)
                seen, again = filters[k]
                at = np.frombuffer(single, np.uint32)
                again[at[seen[at]]] = True
                again[np.frombuffer(twice, np.uint32)] = True
                seen[at] = True
        for k, (seen, again) in filters.items():
            bits_of = np.packbits(seen if once else again, bitorder="little")
            yield common.batch(SCHEMA, [k], [b""], [bits_of.tobytes()])

    common.prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = common.map_arrow(rows, local, SCHEMA).repartition(min(SEGMENTS, parts), "segment")
    merged = written(common.map_arrow(sent, merge, SCHEMA).select("segment", "twice"), "filter")
    packed = np.zeros(bits // 8, np.uint8)
    table = merged.toArrow()
    for k, part in zip(table["segment"].to_pylist(), table["twice"].to_pylist()):
        packed[k * segment // 8 : (k + 1) * segment // 8] = np.frombuffer(part, np.uint8)
    return packed


def contains(packed: np.ndarray, hashes: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """For each hash whether all its positions are set."""
    at = positions(hashes, len(packed) * 8, probes)
    return ((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(common.quoted(text).cast("string")).cast("bigint"))).first()[0] or 0
