"""Token counts: every distinct pre-token is cut into pieces once, documents add up their counts.

Tasks count the pre-tokens of their documents; the counts meet by pre-token and a tokenizer counts
the pieces of each distinct one. The most frequent pre-tokens, a bounded number, go to all tasks as
a table. Each document adds up its frequencies times those counts at once and sends only its other
pre-tokens, which join the counts by shuffle. No ids are materialised.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import common
from postloom.llm.pieces import bare, split, words_of
from postloom.session import written

HEAD = 1 << 19  # pre-tokens sent to all tasks, the most frequent ones: about 60 MB in a Python worker
FLUSH = 1_000_000
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
PIECES = pa.schema([("word", pa.string()), ("n", pa.int64()), ("pieces", pa.int64())])
PARTS = pa.schema([("row", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("bytes", pa.int64())])


@lru_cache(2)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Splitter:
    """Pre-tokens of pieces as the tokenizer file makes them; added tokens stand for themselves."""

    def __init__(self, path: str):
        tokenizer = load_tokenizer(path)
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        added = sorted({t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content}, key=len, reverse=True)
        # leftmost match, the longest added token first at each place; one pass, however many a text holds
        self.tokens = added
        self.lettered = any(token.removeprefix(" ").isalpha() for token in added)
        self.added = re.compile("(" + "|".join(re.escape(token) for token in added) + ")") if added else None

    def words(self, piece: str) -> list[str]:
        if not self.lettered and (piece[1:] if piece[0] == " " else piece).isalpha() and max(piece) <= "\u024f":
            return [piece]  # letters alone are one pre-token, and no added token is part of them
        if self.added is None or not any(token in piece for token in self.tokens):
            return self.plain(piece)
        made: list[str] = []
        for k, part in enumerate(self.added.split(piece)):
            if k % 2:
                made.append(part)
            elif part:
                made.extend(self.plain(part))
        return made

    def plain(self, piece: str) -> list[str]:
        if max(piece) <= "\u024f":
            return words_of(piece)
        # other scripts by the library itself, whose character classes may be those of another Unicode version
        return [piece[start:end] for _, (start, end) in self.cut(piece)]


def document_pieces(text: str) -> Counter:
    """Frequencies of the pieces of a text, without order."""
    if not text:
        return Counter()
    parts = bare(text)
    if parts is None:
        return Counter(split(text))
    counts = Counter({" " + part: n for part, n in Counter(parts[1:]).items()})
    counts[parts[0]] += 1
    return counts


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", limit: int = 512, head: int = HEAD
) -> DataFrame:
    """Per document its id, `n_bytes`, `n_tokens` and `over_limit` (more than `limit` tokens).

    `path` names a byte-level tokenizers file every executor has. Added tokens inside texts count as
    the library treats them. Null counts as empty. Repeated ids and null ids keep their own rows.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    rows = common.keyed(docs, id_col, text)
    source = rows.select(F.col(common.ROW), common.quoted(text).cast("string").cast("binary"))

    def local(batches):
        # `inner` counts the pieces behind a space without it, so that a text's parts are added as they are
        splitter, counts, inner = Splitter(path), Counter(), Counter()

        def flush():
            words = Counter()
            for piece, n in chain(counts.items(), ((" " + part, n) for part, n in inner.items())):
                for word in splitter.words(piece):
                    words[word] += n
            counts.clear()
            inner.clear()
            names = list(words)
            for k in range(0, len(names), 100_000):
                part = names[k : k + 100_000]
                yield common.batch(COUNTS, part, [words[w] for w in part])

        for b in batches:
            for value in common.texts(b.column(1)):
                content = value.decode()
                parts = bare(content)
                if parts is None:
                    counts.update(document_pieces(content))
                else:
                    counts[parts[0]] += 1
                    inner.update(parts[1:])
            if len(counts) + len(inner) > FLUSH:
                yield from flush()
        yield from flush()

    def piece_counts(batches):
        tokenizer = load_tokenizer(path)
        for b in batches:
            found = tokenizer.encode_batch_fast(b.column(0).to_pylist(), add_special_tokens=False)
            yield common.batch(PIECES, b.column(0), b.column(1), [len(e) for e in found])

    words = common.map_arrow(source, local, COUNTS).groupBy("word").agg(F.sum("n").alias("n"))
    known = written(common.map_arrow(words, piece_counts, PIECES), "pieces")
    table = known.where(F.col("n") >= _frequent(known, head)).select("word", "pieces").toArrow()
    shared = spark.sparkContext.broadcast((table["word"], table["pieces"]))

    def per_document(batches):
        splitter = Splitter(path)
        column, pieces = shared.value
        top = dict(zip(column.to_pylist(), pieces.to_pylist()))
        sums: dict[str, int] = {}
        rare: dict[str, list[str]] = {}

        def learn(piece: str) -> None:
            total, others = 0, []
            for word in splitter.words(piece):
                if word in top:
                    total += top[word]
                else:
                    others.append(word)
            sums[piece] = total
            if others:
                rare[piece] = others

        for b in batches:
            out: list[list] = [[], [], [], []]
            for row, value in zip(b.column(0).to_pylist(), common.texts(b.column(1))):
                counts = document_pieces(value.decode())
                if len(sums) > FLUSH // 2:
                    sums.clear()
                    rare.clear()
                for piece in counts:
                    if piece not in sums:
                        learn(piece)
                total = sum(map(mul, counts.values(), map(sums.__getitem__, counts)))
                left = Counter()
                for piece in counts.keys() & rare.keys():
                    for word in rare[piece]:
                        left[word] += counts[piece]
                out[0].extend([row] * (1 + len(left)))
                out[1].extend([None, *left])
                out[2].extend([total, *left.values()])
                out[3].extend([len(value), *[0] * len(left)])
            yield common.batch(PARTS, *out)

    parts = written(common.map_arrow(source, per_document, PARTS), "frequencies")
    sums = parts.where("word is null").select("row", "bytes", F.col("n").alias("tokens"))
    others = parts.where("word is not null").join(known.select("word", "pieces"), "word")
    counted = sums.unionByName(others.select("row", F.lit(0).alias("bytes"), (F.col("n") * F.col("pieces")).alias("tokens")))
    total = counted.groupBy("row").agg(F.sum("bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    if common.id_is_key(rows, id_col):
        named = total.withColumn(id_col, F.col("row").cast(dict(rows.dtypes)[id_col]))
    else:
        named = total.join(rows.select(F.col(common.ROW).alias("row"), common.quoted(id_col)), "row")
    return named.select(
        common.quoted(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def _frequent(known: DataFrame, head: int) -> int:
    """The smallest frequency that at most `head` pre-tokens reach, from counts per power of two."""
    at = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    total, most = 0, 1 << 62
    for power, words in sorted(known.groupBy(at.alias("p")).agg(F.count(F.lit(1)).alias("w")).collect(), reverse=True):
        total += words
        if total > head:
            break
        most = 1 << power
    return most
