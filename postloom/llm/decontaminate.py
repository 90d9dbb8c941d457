"""Benchmark decontamination: find where training documents repeat test items word for word.

Words are maximal runs of ASCII digits, letters and non-ASCII characters after A-Z is lower-cased.
A window is `window` consecutive words of a test item; an item of fewer words (but not none) is one
window. A document word that lies inside any occurrence of a window is hit.

Method: training suffix arrays. Every input partition of the documents is a training shard (cut
into pieces of about `SHARD_WORDS` words; documents are never split). Its words are numbered by an
Arrow dictionary, and its suffixes are sorted by their first `window` word numbers (`lexsort` over
those numbers packed into as few 64-bit keys as the shard's vocabulary allows), which orders them
exactly as a full suffix array does to the only depth a window can reach; a suffix ends at its
document's end. Every test suffix that starts a window is then binary-searched
(`searchsorted` on the sorted keys) for the interval of training suffixes that begin with it: the
longest verbatim match up to the window and all its locations. The windows of the test set come
from Spark, distinct, with the items that hold each; they travel to the shards in blocks of at
most `BLOCK_WINDOWS`, each broadcast once, so the whole test set is searched against every
training row without a join of the two tables. Documents stay where they were read: nothing of
the corpus is shuffled.

Handling: a null or empty text has no words and no hits. A test item with a null text or without
words has no window; one with a null item_id marks hits but is not named in `items`. Repeated
documents are searched each; repeated items name their ids once per document. Extra columns of
`docs` pass through; result columns of the same names are replaced. An empty test table hits
nothing; an empty document table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import map_arrow, prepare, quoted, without

# Fixed values of the contract: what separates words, and the window.
WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10

SHARD_WORDS = 1 << 21
BLOCK_WINDOWS = 1 << 20
RESULTS = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.int64()), "contaminated": pa.bool_()}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: F.Column) -> F.Column:
    """The words of a text column in Spark, for the test items."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def test_windows(bench: DataFrame, window: int = WINDOW, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows (an array of words) of all test items, with the sorted distinct ids of the items holding each."""
    words = bench.select(quoted(id_col).cast("long").alias("item"), words_of(quoted(text)).alias("w"))
    words = words.where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    made = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("window"))
    return made.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def blocks(windows: DataFrame, block: int = BLOCK_WINDOWS) -> list:
    """The windows in blocks of at most `block`, each as flat Arrow arrays, one block collected at a time."""
    total = windows.count()
    count = max(1, -(-total // block))
    keyed = windows.withColumn("__block", F.pmod(F.xxhash64("window"), F.lit(count)))
    made = []
    for b in range(count if total else 0):
        rows = keyed.where(F.col("__block") == b).select("window", "items").toArrow()
        made.append((rows.column("window").combine_chunks(), rows.column("items").combine_chunks()))
    return made


def layout(ids: np.ndarray, window: int) -> tuple[int, int, int]:
    """Bits per word number, word numbers per 64-bit key and keys per suffix for a shard."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    per = 64 // bits
    return bits, per, -(-window // per)


def pack(word, room: np.ndarray, window: int, bits: int, per: int, keys: int, fill: np.uint64 | None = None) -> np.ndarray:
    """Keys (keys x rows): `word(i)` gives word i of every row; it is kept where i < room, else 0
    (or `fill`); each key holds `per` numbers, the first in its highest bits."""
    made = np.zeros((keys, len(room)), np.uint64)
    top = np.uint64((1 << bits) - 1)
    for i in range(window):
        j, slot = divmod(i, per)
        shift = np.uint64(bits * (per - 1 - slot))
        value = np.where(i < room, word(i).astype(np.uint64), np.uint64(0) if fill is None else fill)
        made[j] |= (value & top) << shift
    return made


def as_bytes(keys: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Keys (keys x rows), in `order`, as one big-endian byte string per row, ordered as the word numbers are."""
    rows = keys.shape[1] if order is None else len(order)
    made = np.empty((rows, keys.shape[0]), ">u8")
    for j in range(keys.shape[0]):
        made[:, j] = keys[j] if order is None else keys[j][order]
    return made.view(f"V{8 * keys.shape[0]}").ravel()


def sort_keys(keys: np.ndarray) -> np.ndarray:
    """Order of the rows by all keys: by the first key, then runs that tie on it by the others."""
    order = np.argsort(keys[0])
    if keys.shape[0] == 1:
        return order
    first = keys[0][order]
    tied = np.zeros(len(first), bool)
    same = first[1:] == first[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    if tied.any():
        at = np.flatnonzero(tied)
        run = np.cumsum(np.concatenate([[True], ~same]))[at]
        inner = np.lexsort([keys[j][order[at]] for j in range(keys.shape[0] - 1, 0, -1)] + [run])
        order[at] = order[at][inner]
    return order


def shard_keys(ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all suffixes of a shard (ids > 0; 0 ends every document) sorted by their
    first `window` ids, and those packed keys as big-endian bytes for binary search."""
    bits, per, keys = layout(ids, window)
    ends = np.flatnonzero(ids == 0)
    starts = np.flatnonzero(ids != 0)
    room = ends[np.searchsorted(ends, starts)] - starts
    last = len(ids) - 1
    packed = pack(lambda i: ids[np.minimum(starts + i, last)], room, window, bits, per, keys)
    order = sort_keys(packed)
    return starts[order], as_bytes(packed, order)


def search(shard_words: pa.Array, ids: np.ndarray, block, window: int):
    """Occurrences (start, length, window index) of the block's windows in a shard."""
    windows, _ = block
    flat = pc.list_flatten(windows)
    lengths = pc.list_value_length(windows).to_numpy(zero_copy_only=False).astype(np.int64)
    found = pc.index_in(flat, value_set=shard_words)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    where = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(lengths)), lengths)
    complete = np.ones(len(lengths), bool)
    np.logical_and.at(complete, owner, known)
    chosen = np.flatnonzero(complete & (lengths > 0))
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    suffixes, keys = shard_keys(ids, window)
    bits, per, count = layout(ids, window)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    words = np.zeros((len(lengths), window), np.int64)
    slot = np.arange(len(owner)) - offsets[owner]
    words[owner, slot] = where
    words, room = words[chosen], lengths[chosen]
    low = as_bytes(pack(lambda i: words[:, i], room, window, bits, per, count))
    high = as_bytes(pack(lambda i: words[:, i], room, window, bits, per, count, fill=np.uint64((1 << bits) - 1)))
    left = np.searchsorted(keys, low, "left")
    right = np.searchsorted(keys, high, "right")
    times = right - left
    which = np.repeat(chosen, times)
    position = np.repeat(left - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    return suffixes[position], lengths[which], which


def find_shard(texts: list, block_values: list, window: int) -> list[tuple]:
    """Result rows (n_words, n_hit, items, contaminated) of the documents of one shard."""
    lowered = pc.ascii_lower(pa.array(texts, pa.string()).fill_null(""))
    pieces = pc.split_pattern_regex(lowered, WORD_BREAKS)
    flat = pc.list_flatten(pieces)
    owner = pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False)
    keep = pc.not_equal(pc.utf8_length(flat), 0).to_numpy(zero_copy_only=False)
    flat, owner = flat.filter(pa.array(keep)), owner[keep]
    n_docs = len(texts)
    n_words = np.bincount(owner, minlength=n_docs).astype(np.int64)
    coded = pc.dictionary_encode(flat)
    # one separator (0) after every document: document d occupies [begin[d], begin[d] + n_words[d]]
    begin = np.concatenate([[0], np.cumsum(n_words + 1)[:-1]]).astype(np.int64)
    ids = np.zeros(int(n_words.sum() + n_docs), np.int64)
    rank = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n_words)[:-1]]), n_words)
    ids[begin[owner] + rank] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    diff = np.zeros(len(ids) + 1, np.int64)
    pairs = []
    for block in block_values:
        starts, lengths, which = search(coded.dictionary, ids, block, window)
        if not len(starts):
            continue
        np.add.at(diff, starts, 1)
        np.add.at(diff, starts + lengths, -1)
        doc = np.searchsorted(begin, starts, "right") - 1
        items = block[1]
        item_offsets = items.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        item_values = pc.fill_null(items.values, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        named = items.values.is_valid().to_numpy(zero_copy_only=False)
        met = np.unique(np.stack([doc, which], axis=1), axis=0)
        counts = item_offsets[met[:, 1] + 1] - item_offsets[met[:, 1]]
        at = np.repeat(item_offsets[met[:, 1]] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        ok = named[at]
        pairs.append(np.stack([np.repeat(met[:, 0], counts)[ok], item_values[at][ok]], axis=1))
    hit = (np.cumsum(diff)[:-1] > 0).astype(np.int64)
    hits = np.add.reduceat(hit, begin) if len(begin) else np.zeros(0, np.int64)
    found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    per_doc = np.split(found[:, 1], np.searchsorted(found[:, 0], np.arange(1, n_docs)))
    return [
        (int(n_words[d]), int(hits[d]), per_doc[d].tolist(), bool(hits[d] > 0)) for d in range(n_docs)
    ]


def find_contamination(docs: DataFrame, bench: DataFrame, text: str = "text", window: int = WINDOW, id_col: str = "item_id") -> DataFrame:
    """`docs` with n_words, n_hit, items (sorted ids of the test items with a window in it) and contaminated."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    prepare(spark)
    shipped = [spark.sparkContext.broadcast(b) for b in blocks(test_windows(bench, window, id_col))]
    passed = docs.select(*[quoted(c) for c in without(docs, list(RESULTS))])
    names = passed.columns
    source = passed.select(*[quoted(c) for c in names], quoted(text).cast("string").alias("__text"))
    schema = pa.schema([*to_arrow_schema(passed.schema), *[pa.field(n, k) for n, k in RESULTS.items()]])

    def flush(held: list[pa.RecordBatch], values: list):
        table = pa.Table.from_batches(held)
        rows = find_shard(table.column("__text").to_pylist(), values, window)
        made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(RESULTS.values())]
        columns = [table.column(c).combine_chunks() for c in names]
        return pa.RecordBatch.from_arrays([*columns, *made], schema=schema)

    def run(batches):
        values = [b.value for b in shipped]
        held, words = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            words += pc.sum(pc.utf8_length(pc.fill_null(b.column("__text"), ""))).as_py() // 6 + b.num_rows
            if words >= SHARD_WORDS:
                yield flush(held, values)
                held, words = [], 0
        if held:
            yield flush(held, values)

    return map_arrow(source, run, schema)


def remove_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents of `docs` without a hit word, with their own columns only."""
    found = find_contamination(docs, bench, text, window)
    return found.where(~F.col("contaminated")).select(*[quoted(c) for c in docs.columns])
