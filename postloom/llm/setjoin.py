"""Exact Jaccard self-join of word-shingle sets by universe partition.

Hash values of shingles are cut into segments, as many as a pair of similar sets of a size band may
differ in, plus spare ones. By the pigeonhole principle two similar sets agree in some segments, so
each set sends one signature per segment. As probes it needs only some of them: the allocation
takes the segments with most shingles, since small ones are shared by many sets. Small sets have
few segments to spare; where they would need an empty one, the allocation takes a small one with
its one-deletion neighbourhood instead, which counts for two. Signatures meet by range of their values. The pigeonhole
principle says more than that one agrees: of the segments a set fills, all but as many as the pair may differ in. Pairs that
share a probed signature and enough signatures in all become candidates, so a common passage alone makes none; candidates are
linked to clusters, and all pairs of a cluster are verified exactly in blocks. A signature of very many sets is not paired out:
its sets are linked as a star, but for those with too few such signatures to be similar to any set by them alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import bloom, common
from postloom.llm.components import connected_components
from postloom.llm.pieces import Cache
from postloom.session import written

GROWTH = 1.5  # between the sizes of neighbouring bands
FIRST_BAND = 8
SPARE = 0.25  # segments beyond those needed, as a share of them: the smallest of a set need not be probed
FEW = 16  # segments of a band up to which small segments send their one-deletion neighbourhoods
SMALL = (2, 3)  # shingles of a segment whose one-deletion neighbourhood may be probed
BLOCK = 1000  # sets of a cluster that are verified together
GROUP = 16  # sets that share a signature and are paired out; more are linked as a star
SENT = 1 << 20  # signatures a task sorts and sends at a time
PAIRED = 1 << 21  # pairs a task makes at a time
SEGMENTS = 256  # ranges of signatures, or one per shuffle partition if these are more
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
SIGNED = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("probes", pa.int32()), ("filled", pa.int32()), ("least", pa.int32()), ("signatures", pa.binary())])
RANGE = pa.schema([("segment", pa.int32()), ("signatures", pa.binary()), ("rows", pa.binary()), ("probes", pa.binary())])
SHARED = pa.schema([("signature", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("shared", pa.int64()), ("probed", pa.int32())])
SETS = pa.schema([("row", pa.int64()), ("shingles", pa.binary())])
FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


class Shingles:
    """Sorted distinct 64-bit hashes of the shingles of texts."""

    def __init__(self, size: int):
        self.size = size
        self.words = Cache(xxhash.xxh3_64_intdigest)

    def of(self, text: bytes) -> np.ndarray:
        """A-Z lower-cased, words between ASCII white space; fewer words than a shingle make one, none make none."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        h = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            h = h * MULTIPLIERS[0] + common.mix(hashes[k : len(words) - size + 1 + k] + MULTIPLIERS[k % len(MULTIPLIERS)])
        return np.unique(common.mix(h))


@lru_cache(None)
def bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(first size, last size, segments) of each band up to the size `largest`."""
    out, first = [], 1
    last = FIRST_BAND
    while first <= largest:
        needed = differing(last, percent) + 1
        out.append((first, last, needed + max(2, int(needed * SPARE))))
        first, last = last + 1, int(last * GROWTH) + 1
    return out


def differing(size: int, percent: int) -> int:
    """Most shingles that a set of this size and a similar one that is not smaller differ in."""
    larger = 100 * size // percent
    return (100 - percent) * (size + larger) // (100 + percent)


@lru_cache(4096)
def _segment_starts(segments: int) -> np.ndarray:
    return np.array([-(-(k << 64) // segments) for k in range(1, segments)], np.uint64)


def signatures(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Signatures to probe with and signatures only to be found by, in the bands of the set and of its smaller partners;
    how many segments the set fills in its own band; and the least number of them that any similar set shares."""
    size = len(shingles)
    most = differing(size, percent)
    if not most:
        return shingles[:0], shingles[:0], 0, 0  # only equal sets are similar
    values = common.mix(shingles ^ MULTIPLIERS[1])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    probes, others, filled, least = [], [], 0, size
    smallest = -(-percent * size // 100)
    for band, (first, last, segments) in enumerate(bands(percent, max(size, FIRST_BAND))):
        if last < smallest:
            continue
        edges = np.concatenate([[0], np.searchsorted(shingles, _segment_starts(segments)), [size]])
        counts = np.diff(edges)
        filled = int(np.count_nonzero(counts))
        least = min(least, filled - (most if last >= size else (100 - percent) * (size + last) // (100 + percent)))
        names = (np.arange(segments, dtype=np.uint64) + np.uint64(band << 32)) * MULTIPLIERS[2]
        own = sums[edges[1:]] - sums[edges[:-1]]
        exact = common.mix(own + names + counts.astype(np.uint64) * MULTIPLIERS[3])
        order = np.argsort(-counts, kind="stable")
        chosen = order[: most + 1]
        empty = chosen[counts[chosen] == 0]
        small = [k for k in chosen[::-1] if SMALL[0] <= counts[k] <= SMALL[1]][::-1]
        if segments > FEW:  # so many segments have enough spare ones
            small = []
        swapped = min(len(empty), len(small))  # an empty segment against the neighbourhood of a small one
        doubled = set(small[:swapped])
        probing = np.zeros(segments, bool)
        probing[chosen] = True
        probing[empty[:swapped]] = False
        # a set that has to probe an empty segment can be found by all of its empty ones
        usable = (counts > 0) | (swapped < len(empty))
        probes.append(exact[probing])
        others.append(exact[usable & ~probing])
        for k in np.flatnonzero((counts >= SMALL[0]) & (counts <= SMALL[1] + 1)) if segments <= FEW else ():
            inside = slice(edges[k], edges[k + 1])
            names_of = names[k : k + 1] + (counts[k : k + 1] - 1).astype(np.uint64) * MULTIPLIERS[3]
            rest = common.mix(own[k : k + 1] - values[inside] + names_of)
            (probes if k in doubled else others).append(rest)
    return np.concatenate(probes), np.concatenate(others), filled, max(least, 1)


def similar(shared: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (left + right - shared)


def verify(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, both: bool, percent: int):
    """Links of a block: pairs across the two sides, or all pairs if `both` sides are one. Yields (i, j) of a spanning
    forest of the links, and afterwards the number of linked documents of each set (as (i, None, number))."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    by_shingle = np.argsort(dense, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(dense))])
    holders = owner[by_shingle]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    links = np.zeros(len(sets), np.int64)
    for i in range(len(sets)):
        own = dense[offsets[i] : offsets[i + 1]]
        lengths = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(holders[at], minlength=len(sets))[i + 1 :]
        hit = similar(shared, sizes[i], sizes[i + 1 :], percent)
        if not both:
            hit &= side[i + 1 :] != side[i]
        hit = np.flatnonzero(hit) + i + 1
        links[i] += copies[hit].sum()
        links[hit] += copies[i]
        for j in hit.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                yield i, j, 0
    for i in np.flatnonzero(links).tolist():
        yield i, None, int(links[i])


def _signed(rows: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    def run(batches):
        shingles = Shingles(size)
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            parts = []
            for value in common.texts(b.column(1)):
                own = shingles.of(value)
                probes, others, filled, least = signatures(own, percent)
                digest = common.mix(own + MULTIPLIERS[4]).sum(dtype=np.uint64), common.mix(own + MULTIPLIERS[5]).sum(dtype=np.uint64)
                for column, item in zip(out, (len(own), *np.array(digest, np.uint64).view(np.int64).tolist(), len(probes), filled, least)):
                    column.append(item)
                parts.append(np.concatenate([probes, others]))
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield common.batch(SIGNED, b.column(0), *out, common.pack(flat, np.fromiter(map(len, parts), np.int64, len(parts))))

    source = rows.select(common.ROW, common.quoted(text).cast("string").cast("binary"))
    return common.map_arrow(source, run, SIGNED)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, all first bytes before all second ones, which compresses better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def paired(values: np.ndarray, rows: np.ndarray, probe: np.ndarray, group: int, block: int):
    """Batches of the pairs of rows that share a signature, each with the number of signatures they share here and whether
    one of the two probes with one of them. Signatures of more than `group` rows give their rows, without pairs."""
    order = np.lexsort((~probe, rows, values))
    values, rows, probe = values[order], rows[order], probe[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows, probe = values[new], rows[new], probe[new]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(values)))
    for k in np.flatnonzero(sizes > group).tolist():
        own = slice(starts[k], starts[k] + sizes[k])
        n = int(sizes[k])
        yield common.batch(
            SHARED, values[own].view(np.int64), rows[own], pa.nulls(n, pa.int64()), np.ones(n, np.int64), np.full(n, probe[own].any(), np.int32)
        )
    small = (sizes > 1) & (sizes <= group)
    starts, sizes = starts[small], sizes[small]
    blocks = np.cumsum(sizes * (sizes - 1) // 2) // block
    for cut in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(blocks)) + 1):
        if not len(cut):
            continue
        g = sizes[cut]
        place = np.arange(g.sum()) - np.repeat(np.cumsum(g) - g, g)
        after = np.repeat(g, g) - 1 - place
        left = np.repeat(np.repeat(starts[cut], g) + place, after)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        u, v, probed = rows[left], rows[right], probe[left] | probe[right]
        order = np.lexsort((v, u))
        u, v, probed = u[order], v[order], probed[order]
        first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
        shared = np.diff(np.append(first, len(u)))
        yield common.batch(
            SHARED, pa.nulls(len(first), pa.int64()), u[first], v[first], shared, np.maximum.reduceat(probed, first).astype(np.int32)
        )


def _shared(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of representatives that share signatures, and the rows of signatures that too many share.

    Tasks sort their signatures and send them, cut into ranges, with their rows; a range is worked on by one task. Copies
    stay out by a filter of the representatives; the few it lets through take no part in the verification.
    """
    spark = signed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = max(SEGMENTS, parts)

    def keys_of(b):
        return common.mix(b.column(0).to_numpy().astype(np.int64).view(np.uint64))

    packed = bloom.twice_seen(reps, keys_of, bloom.size_for(reps.count()), once=True)
    shared = spark.sparkContext.broadcast(packed)
    group, block = GROUP, PAIRED

    def send(batches):
        held, size = [], 0

        def flush():
            values, rows, probe = [np.concatenate(c) for c in zip(*held)]
            order = np.argsort(values, kind="stable")
            values, rows, probe = values[order], rows[order], probe[order]
            edges = np.concatenate([[0], np.searchsorted(values, _segment_starts(segments)), [len(values)]])
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[k], edges[k + 1])
                yield common.batch(RANGE, [k], [_planes(values[own])], [_planes(rows[own])], [probe[own].tobytes()])

        for b in batches:
            b = b.take(pa.array(np.flatnonzero(bloom.contains(shared.value, keys_of(b)))))
            values, lengths = common.unpack(b.column(2), "<u8")
            place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            probe = place < np.repeat(b.column(1).to_numpy(), lengths)
            held.append((values, np.repeat(b.column(0).to_numpy(), lengths), probe))
            size += len(values)
            if size >= SENT:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def meet(batches):
        held: list[tuple] = []
        for b in batches:
            for _, values, rows, probe in zip(*[c.to_pylist() for c in b.columns]):
                held.append((_from_planes(values, "<u8"), _from_planes(rows, "<i8"), np.frombuffer(probe, bool)))
        if held:
            yield from paired(*[np.concatenate(c) for c in zip(*held)], group, block)

    sent = common.map_arrow(signed.select("row", "probes", "signatures"), send, RANGE).repartition(parts, "segment")
    return written(common.map_arrow(sent, meet, SHARED), "shared")


def _candidates(signed: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Edges between representatives that may be similar by the signatures they share.

    Two similar sets agree in all segments the smaller one fills in its own band, but for as many as they differ in. Pairs
    that share fewer signatures are left out; shared signatures that are not paired out count as far as both rows have
    them. Rows of such a signature are linked to the first of them if they have enough of these for a pair that shares no others.
    """
    found = _shared(signed, reps)
    many = found.where("v is null")
    hot = many.groupBy(F.col("u").alias("row")).agg(F.count(F.lit(1)).alias("hot"))
    sizes = signed.select("row", "n", "filled", "least").join(hot, "row", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    sizes = written(sizes, "sizes")
    pairs = found.where("v is not null").groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.max("probed").alias("probed"))
    for end in ("u", "v"):
        pairs = pairs.join(sizes.select(F.col("row").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "filled", "hot")]), end)
    low, high = F.least("n_u", "n_v"), F.greatest("n_u", "n_v")
    filled = F.when(F.col("n_u") == F.col("n_v"), F.greatest("filled_u", "filled_v")).when(
        F.col("n_u") < F.col("n_v"), F.col("filled_u")
    ).otherwise(F.col("filled_v"))
    unpaired = F.least("hot_u", "hot_v")
    enough = F.col("shared") + unpaired >= filled - F.floor((100 - percent) * (low + high) / (100 + percent))
    near = pairs.where((100 * low >= percent * high) & enough & ((F.col("probed") == 1) | (unpaired > 0))).select("u", "v")
    staying = sizes.where("hot > 0 AND hot >= least").select(F.col("row").alias("u"))
    rows = written(many.where("probed = 1").select("signature", "u").join(staying, "u"), "many")
    # written, so that the join of a signature shared by very many sets can be split while it runs
    centers = written(rows.groupBy("signature").agg(F.min("u").alias("v")), "centers")
    return near.unionByName(rows.join(centers, "signature").where("u <> v").select("u", "v").distinct())


def _sets(rows: DataFrame, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """Shingles of the wanted rows, found by a filter of their keys and then exactly, so that texts need no shuffle."""
    count = wanted.count()

    def keys_of(b):
        return common.mix(b.column(0).to_numpy().astype(np.int64).view(np.uint64))

    packed = bloom.twice_seen(wanted.select("row"), keys_of, bloom.size_for(count), once=True)
    shared = rows.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        shingles = Shingles(size)
        for b in batches:
            hit = np.flatnonzero(bloom.contains(shared.value, keys_of(b)))
            chosen = b.take(pa.array(hit))
            made = [shingles.of(value).tobytes() for value in common.texts(chosen.column(1))]
            yield common.batch(SETS, chosen.column(0), made)

    source = rows.select(common.ROW, common.quoted(text).cast("string").cast("binary"))
    return written(common.map_arrow(source, run, SETS), "sets").join(wanted, "row")


def _links(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links of all clusters, as forests and link counts. A large cluster is cut into blocks by hash, and
    every pair of blocks is a task of its own, so no cluster is gathered."""
    sizes = written(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "clusters")
    spread = clusters.join(sizes, "component").select(
        F.col("node").alias("row"), "component", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("row"), F.col("blocks").cast("bigint")).cast("int")
    blocked = sets.join(spread, "row").withColumn("own", own)
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner")
    tasks = blocked.select("row", "copies", "shingles", "component", "own", partner).select(
        "component", F.least("own", "partner").alias("low"), F.greatest("own", "partner").alias("high"),
        F.col("own").alias("side"), "row", "copies", "shingles",
    )
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tasks.repartition(parts, "component", "low", "high").sortWithinPartitions("component", "low", "high", "row")

    def run(batches):
        held: list = []

        def finish():
            if len(held) > 1:
                rows = [r[4] for r in held]
                done = verify(
                    [np.frombuffer(r[6], "<u8") for r in held], np.array([r[5] for r in held]),
                    np.array([r[3] for r in held]), held[0][1] == held[0][2], percent,
                )
                out = [(rows[i], None if j is None else rows[j], n) for i, j, n in done]
                if out:
                    yield common.batch(FOUND, *zip(*out))
            held.clear()

        for b in batches:
            for item in zip(*[c.to_pylist() for c in b.columns]):
                if held and held[0][:3] != item[:3]:
                    yield from finish()
                held.append(item)
        yield from finish()

    return written(common.map_arrow(dealt, run, FOUND), "links")


def joined_rows(rows: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """For each row of a table made by `keyed`: `row`, `n`, `n_links` and `component` (the first row reachable)."""
    signed = written(_signed(rows, text, size, percent), "signed")
    filled = signed.where("n > 0")
    classes = written(filled.groupBy("n", "d1", "d2").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")), "classes")
    clusters = written(connected_components(_candidates(filled, classes.select("row"), percent), "u", "v"), "clusters")
    wanted = clusters.select(F.col("node").alias("row")).join(classes.select("row", "copies"), "row")
    links = _links(clusters, _sets(rows, text, size, wanted), percent)
    linked = connected_components(links.where("v is not null"), "u", "v")
    counts = links.where("v is null").groupBy(F.col("u").alias("row")).agg(F.sum("links").alias("others"))
    named = classes.join(linked.withColumnRenamed("node", "row"), "row", "left").join(counts, "row", "left").select(
        "n", "d1", "d2", F.coalesce("component", "row").alias("component"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    named = written(named, "components")
    own = signed.select("row", "n", "d1", "d2")
    alone = own.where("n = 0").select("row", "n", F.lit(0).cast("bigint").alias("n_links"), F.col("row").alias("component"))
    return own.where("n > 0").join(named, ["n", "d1", "d2"]).select("row", "n", "n_links", "component").unionByName(alone)


def similar_sets(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = 80
) -> DataFrame:
    """Per document its id, `n_shingles`, `n_links` and `component_id`.

    Sets are the distinct shingles of `size` words (A-Z lower-cased, between ASCII white space); a
    text with fewer words is one shingle; null and empty texts have none and link with nothing. Two
    documents link when 100 * shared >= `percent` * union; the component id is the smallest id
    reachable by links. Documents with equal sets are joined once as one. One row per row in; rows
    with null or repeated ids keep their own row, and ids order them (nulls first).
    """
    common.prepare(docs.sparkSession)
    rows = common.keyed(docs, id_col, text)
    result = joined_rows(rows, text, size, percent)
    kind = dict(rows.dtypes)[id_col]
    if common.id_is_key(rows, id_col):
        return result.select(
            F.col("row").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), "n_links", F.col("component").cast(kind).alias("component_id")
        )
    ids = rows.select(F.col(common.ROW).alias("row"), common.quoted(id_col).alias("_id"))
    heads = ids.select(F.col("row").alias("component"), F.col("_id").alias("component_id"))
    return result.join(ids, "row").join(heads, "component").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "n_links", "component_id"
    )


def drop_similar(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group of similar ones: the first by id (nulls first, ties by content).

    Groups are those of `similar_sets`. Documents without words are all kept. All columns stay.
    """
    common.prepare(docs.sparkSession)
    rows = common.keyed(docs, id_col, *[c for c in docs.columns if c != id_col])
    gone = joined_rows(rows, text, size, percent).where("row <> component").select(F.col("row").alias(common.ROW))
    return rows.join(gone, common.ROW, "left_anti").select(*[common.quoted(c) for c in docs.columns])
