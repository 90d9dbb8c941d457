"""Byte-level byte-pair encoding and decoding with numpy matrices.

Distinct pre-tokens are put into matrices of about equal length, one row of byte ids each. In every
round each row merges its leftmost pair of minimum rank; ranks of all pairs come from one hashed
lookup, and the merged cell is squeezed out of the row. Rows without a mergeable pair leave the
matrix. Pre-tokens of more than WIDEST bytes are merged one by one with a heap of linked pairs instead,
since rounds over long rows cost the square of their length. A vocabulary is a file of lines "base64 rank".

Nulls and empty texts have no ids. Invalid UTF-8 cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postloom.llm import common
from postloom.llm.pieces import Cache, bare, split, words_of

NO_RANK = np.int32(2**31 - 1)
WIDEST = 256
MAX_CELLS = 1 << 20
MAX_CACHED = 400_000


class Ranks:
    """A rank file: token bytes by id, ids by bytes, and a hash table from pairs of ids to merged ids."""

    def __init__(self, data: bytes):
        self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        self.tokens = {rank: token for token, rank in self.ids.items()}
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, NO_RANK, np.int32)
        self._fill(np.array(keys, np.int64), np.array(merged, np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """Open addressing: of the keys that want a free slot one gets it, the others try the next."""
        slot = self._slot(keys)
        self.longest = 0
        while len(keys):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = keys[free]
            placed = self.slots[slot] == keys
            self.merged[slot[placed]] = merged[placed]
            keys, merged = keys[~placed], merged[~placed]
            slot = (slot[~placed] + 1) & (len(self.slots) - 1)
            self.longest += 1

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges into (its rank), or NO_RANK."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        found = np.where(self.slots[slot] == keys, self.merged[slot], NO_RANK)
        open_ = np.flatnonzero((found == NO_RANK) & (self.slots[slot] >= 0) & (self.slots[slot] != keys))
        for _ in range(1, self.longest):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
            here = self.slots[slot[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = self.merged[slot[open_[hit]]]
            open_ = open_[(here >= 0) & ~hit]
        return found


@lru_cache(2)
def load_ranks(path: str) -> Ranks:
    with open(path, "rb") as file:
        return Ranks(file.read())


def encode_matrix(rows: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Ids of byte strings of similar length, all rows merging one pair per round."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    width = int(lengths.max())
    ids = np.full((len(rows), width + 1), -1, np.int32)
    inside = np.arange(width + 1) < lengths[:, None]
    ids[inside] = ranks.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
    out: list = [None] * len(rows)
    at, size = np.arange(len(rows)), lengths.copy()
    cost = np.full((len(rows), width), NO_RANK, np.int32)
    pairs = inside[:, 1:]
    cost[pairs] = ranks.pair_ranks(ids[:, :-1][pairs], ids[:, 1:][pairs])
    while len(at):
        best = cost.argmin(1)  # the first of equal minima: the leftmost
        lowest = cost[np.arange(len(at)), best]
        done = lowest == NO_RANK
        if done.any():
            for k, own, n in zip(at[done].tolist(), ids[done].tolist(), size[done].tolist()):
                out[k] = own[:n]
            keep = ~done
            ids, cost, at, size = ids[keep], cost[keep], at[keep], size[keep]
            best, lowest = best[keep], lowest[keep]
            if not len(at):
                break
            widest = int(size.max())
            ids, cost = ids[:, : widest + 1], cost[:, :widest]
        # compaction: cells right of the merged pair move one to the left
        columns = np.arange(cost.shape[1])
        row = np.arange(len(at))
        moved = np.minimum(columns + (columns > best[:, None]), ids.shape[1] - 1)
        shorter = np.take_along_axis(ids, moved, 1)
        shorter[row, best] = lowest
        ids = np.concatenate([shorter, np.full((len(at), 1), -1, np.int32)], 1)
        moved = np.minimum(columns + (columns > best[:, None]), cost.shape[1] - 1)
        cost = np.take_along_axis(cost, moved, 1)
        size = size - 1
        cost[row, size - 1] = NO_RANK  # the last id begins no pair
        cost[row, best] = NO_RANK
        has = best + 1 < size
        cost[row[has], best[has]] = ranks.pair_ranks(lowest[has], ids[row[has], best[has] + 1])
        has = best > 0
        cost[row[has], best[has] - 1] = ranks.pair_ranks(ids[row[has], best[has] - 1], lowest[has])
    return out


def encode_long(word: bytes, ranks: Ranks) -> list[int]:
    """Ids of one long byte string: the same merges in the same order from a heap of linked pairs."""
    ids = ranks.byte_ids[np.frombuffer(word, np.uint8)]
    first = ranks.pair_ranks(ids[:-1], ids[1:])
    found = np.flatnonzero(first != NO_RANK)
    heap = list(zip(first[found].tolist(), found.tolist(), ids[found].tolist(), ids[found + 1].tolist()))
    heapq.heapify(heap)
    ids = ids.tolist()
    after = list(range(1, len(ids) + 1))
    before = list(range(-1, len(ids) - 1))
    lookup = Cache(lambda pair: int(ranks.pair_ranks(np.array([pair[0]]), np.array([pair[1]]))[0]), MAX_CACHED)
    while heap:
        rank, at, left, right = heapq.heappop(heap)
        follower = after[at]
        if ids[at] != left or follower >= len(ids) or ids[follower] != right:
            continue  # one of the two has been merged meanwhile
        ids[at], ids[follower] = rank, -1
        after[at] = after[follower]
        if after[at] < len(ids):
            before[after[at]] = at
            if (new := lookup[rank, ids[after[at]]]) != NO_RANK:
                heapq.heappush(heap, (new, at, rank, ids[after[at]]))
        if before[at] >= 0 and (new := lookup[ids[before[at]], rank]) != NO_RANK:
            heapq.heappush(heap, (new, before[at], ids[before[at]], rank))
    return [i for i in ids if i >= 0]


def encode_words(words: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Ids of distinct pre-tokens: known tokens at once, the others in buckets of similar length."""
    out: list = [None] * len(words)
    buckets: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        known = ranks.ids.get(word)
        if known is not None:
            out[k] = [known]
        elif len(word) > WIDEST:
            out[k] = encode_long(word, ranks)
        else:
            buckets.setdefault((len(word) + 3) // 4, []).append(k)
    for quarter, bucket in buckets.items():
        step = max(1, MAX_CELLS // (4 * quarter))
        for start in range(0, len(bucket), step):
            part = bucket[start : start + step]
            for k, ids in zip(part, encode_matrix([words[k] for k in part], ranks)):
                out[k] = ids
    return out


class Codec:
    """Encodes whole texts; every distinct piece is encoded once while it stays in a cache.

    For a piece the caches have its ids as decimal text and the bytes that decoding these ids gives.
    """

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.decimals = {i: str(i) for i in self.ranks.tokens}
        self.whole: dict[str, tuple[bytes, bytes]] = {}
        self.inner: dict[str, tuple[bytes, bytes]] = {}

    def learn(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        parts = list(map(words_of, pieces))
        words = list({word for part in parts for word in part})
        decimal, token = self.decimals.__getitem__, self.ranks.tokens.__getitem__
        known = {}
        for word, ids in zip(words, encode_words([word.encode() for word in words], self.ranks)):
            known[word] = ",".join(map(decimal, ids)).encode(), b"".join(map(token, ids))
        return [
            known[part[0]] if len(part) == 1
            else (b",".join([known[w][0] for w in part]), b"".join([known[w][1] for w in part]))
            for part in parts
        ]

    def _fill(self, cache: dict, keys: set[str], prefix: str) -> None:
        if len(cache) > MAX_CACHED:
            known = {key: cache[key] for key in keys if key in cache}
            cache.clear()
            cache.update(known)
        new = [key for key in keys if key not in cache]
        cache.update(zip(new, self.learn([prefix + key for key in new])))

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids as decimals joined by commas, and the decoded bytes."""
        plain = [bare(text) for text in texts]
        cut = [split(text) if text and parts is None else [] for text, parts in zip(texts, plain)]
        self._fill(self.inner, {p for parts in plain if parts for p in parts[1:]}, " ")
        heads = {parts[0] for parts in plain if parts}
        self._fill(self.whole, heads | {piece for pieces in cut for piece in pieces}, "")
        for parts, pieces in zip(plain, cut):
            values = list(map(self.whole.__getitem__, parts[:1] if parts else pieces))
            if parts:
                values += map(self.inner.__getitem__, parts[1:])
            yield b",".join([x for x, _ in values]), b"".join([x for _, x in values])


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`docs` with the ids of each text (decimals joined by commas) and the bytes decoded from them.

    One row out per row in, whatever repeats; null counts as empty. `path` names a rank file every
    executor has. Columns of the input named like a result are replaced.
    """
    kinds = {ids: pa.binary(), decoded: pa.binary()}
    return common.map_text(docs, text, kinds, lambda: _encoder(path, lambda pair: pair))


def encode_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with `n_tokens`, `ids_sha256` and `decoded_sha256` of each text instead of the ids themselves."""
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return common.map_text(docs, text, kinds, lambda: _encoder(path, _digests))


def _encoder(path: str, finish):
    own = codec(path)
    return lambda values: [finish(pair) for pair in own.encode([value.decode() for value in values])]


def _digests(pair: tuple[bytes, bytes]) -> tuple[int, str, str]:
    ids, decoded = pair
    count = ids.count(b",") + 1 if ids else 0
    return count, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()
