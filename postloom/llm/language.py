"""Language identification by interpolated Kneser-Ney character models, one per language.

Models run over the letters of single words with a mark before and after, so a word is scored once
per distinct word. They are fitted on a bounded sample of labelled rows and kept as sorted arrays
of hashes: per order the n-grams of all languages with their log-probability in each, and the
contexts with their back-off weight in each. A text gets the language of lowest cross-entropy per
character. The part of the sample that is not fitted on sets how much higher than usual the
cross-entropy may be, given the length, before a text is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import common
from postloom.session import written

ORDER = 5
FIT_ROWS = 2000  # distinct labelled texts per language that are fitted on or calibrated with: the bound of the sample
ALPHABET = 1 << 10  # the share of an unseen character is one in so many
BASE = np.uint64(0x100000001B3)
OPEN, CLOSE = 1, 2
SCORED_CHARS = 30.0  # characters that the confidence counts at most
SLACK = 1.25  # beyond the deviation that all calibrating texts but a few keep to
QUANTILE = 0.98  # of the deviations; the highest ones may be of mislabelled texts
LEAST_BOUND = 20.0  # no bound is lower, in units of the median deviation
FEW = 8  # calibrating texts that a language needs for figures of its own
AT_LEAST = 2.0  # times the usual cross-entropy of its language: no text below is rejected
WORDS = re.compile(r"[^\W\d_]+")
FITTED = pa.schema([("lang", pa.string()), ("order", pa.int32()), ("kind", pa.string()), ("hashes", pa.binary()), ("values", pa.binary()), ("suffixes", pa.binary()), ("contexts", pa.binary())])
MAX_CACHED = 300_000


def letters(token: str) -> list[str]:
    return [w for w in WORDS.findall(token.lower()) if any(map(str.isalpha, w))]


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words one after another with marks, each code's place in its word, and its word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = "\x01" + "\x02\x01".join(words) + "\x02" if words else ""
    codes = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    return codes, np.arange(len(codes)) - starts[word], word


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes that end at each place; the first n - 1 places hold nothing of use."""
    out = np.zeros(len(codes), np.uint64)
    if n and len(codes) >= n:
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * BASE + codes[j : len(codes) - n + 1 + j]
        out[n - 1 :] = common.mix(h)
    return out


def fit_language(words: list[str], counts: np.ndarray) -> list[tuple]:
    """Rows (order, kind, hashes, values, suffix hashes, context hashes) of one language's model.

    The highest order and n-grams at the start of a word use counts; lower orders use the number of
    different characters before the n-gram. Values of "gram" rows are the discounted shares, those
    of "context" rows the weights of the next lower order, both as logarithms.
    """
    codes, place, word = coded(words)
    weight = np.asarray(counts, np.float64)[word]
    hashes = [gram_hashes(codes, n) for n in range(ORDER + 1)]
    shifted = [np.concatenate([[np.uint64(0)], h[:-1]]) if len(h) else h for h in hashes]
    rows, above = [], None
    for n in range(ORDER, 0, -1):
        at = np.flatnonzero((place >= max(1, n - 1)))
        grams, first, inverse = np.unique(hashes[n][at], return_index=True, return_inverse=True)
        raw = np.bincount(inverse, weight[at], len(grams))
        first = at[first]
        count = raw
        if n < ORDER:
            suffixes, different = np.unique(above, return_counts=True)
            count = np.where(place[first] == n - 1, raw, 0.0)  # starts with the mark: nothing can be before it
            inside = np.searchsorted(suffixes, grams).clip(0, max(0, len(suffixes) - 1))
            if len(suffixes):
                count = np.where((suffixes[inside] == grams) & (place[first] > n - 1), different[inside], count)
            count = np.maximum(count, 1.0)
        one, two = (count == 1).sum(), (count == 2).sum()
        discount = one / (one + 2.0 * two) if one and two else 0.5
        context = shifted[n - 1][first] if n > 1 else np.zeros(len(grams), np.uint64)
        contexts, at_context = np.unique(context, return_inverse=True)
        total = np.bincount(at_context, count, len(contexts))
        kinds = np.bincount(at_context, minlength=len(contexts))
        share = np.maximum(count - discount, 1e-9) / total[at_context]
        left = discount * kinds / total
        suffix = hashes[n - 1][first] if n > 1 else np.zeros(len(grams), np.uint64)
        rows.append((n, "gram", grams, share, suffix, context))
        rows.append((n, "context", contexts, left, contexts[:0], contexts[:0]))
        above = suffix
    return rows


class Model:
    """The models of all languages, looked up together."""

    def __init__(self, rows: list[dict]):
        self.languages = sorted({row["lang"] for row in rows})
        number = {lang: k for k, lang in enumerate(self.languages)}
        self.grams, self.logs, self.contexts, self.weights = {}, {}, {}, {}
        below = None
        for n in range(1, ORDER + 1):
            own = [row for row in rows if row["order"] == n]
            take = lambda kind, field, dtype: [(number[r["lang"]], np.frombuffer(r[field], dtype)) for r in own if r["kind"] == kind]  # noqa: B023, E731
            contexts = take("context", "hashes", np.uint64)
            keys = np.unique(np.concatenate([h for _, h in contexts]))
            weights = np.ones((len(keys), len(self.languages)))
            for (lang, h), (_, v) in zip(contexts, take("context", "values", np.float64)):
                weights[np.searchsorted(keys, h), lang] = v
            self.contexts[n], self.weights[n] = keys, weights
            grams = take("gram", "hashes", np.uint64)
            union, first = np.unique(np.concatenate([h for _, h in grams]), return_index=True)
            suffix = np.concatenate([h for _, h in take("gram", "suffixes", np.uint64)])[first]
            context = np.concatenate([h for _, h in take("gram", "contexts", np.uint64)])[first]
            share = np.zeros((len(union), len(self.languages)))
            for (lang, h), (_, v) in zip(grams, take("gram", "values", np.float64)):
                share[np.searchsorted(union, h), lang] = v
            lower = np.full((len(union), len(self.languages)), 1.0 / ALPHABET)
            if below is not None:
                lower = below[np.searchsorted(self.grams[n - 1], suffix)]
            below = share + weights[np.searchsorted(keys, context)] * lower
            self.grams[n], self.logs[n] = union, np.log2(below).astype(np.float32)
        self.weights = {n: np.log2(w).astype(np.float32) for n, w in self.weights.items()}
        self.means = self.spreads = self.highest = self.lowest = None

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word the sum of log2 probabilities in each language, and the number of characters predicted."""
        codes, place, word = coded(words)
        at = np.flatnonzero(place >= 1)
        total = np.zeros((len(at), len(self.languages)), np.float32)
        open_ = np.arange(len(at))
        hashes = [gram_hashes(codes, n) for n in range(ORDER + 1)]
        for n in range(ORDER, 0, -1):
            fits = open_[place[at[open_]] >= n - 1]
            keys = hashes[n][at[fits]]
            found = np.searchsorted(self.grams[n], keys).clip(0, len(self.grams[n]) - 1)
            hit = self.grams[n][found] == keys
            total[fits[hit]] += self.logs[n][found[hit]]
            missed = fits[~hit]
            context = hashes[n - 1][at[missed] - 1] if n > 1 else np.zeros(len(missed), np.uint64)
            inside = np.searchsorted(self.contexts[n], context).clip(0, len(self.contexts[n]) - 1)
            known = self.contexts[n][inside] == context
            total[missed[known]] += self.weights[n][inside[known]]
            rest = np.ones(len(at), bool)
            rest[fits[hit]] = False
            open_ = open_[rest[open_]]
        total[open_] -= np.float32(np.log2(ALPHABET))
        sums = np.zeros((len(words), len(self.languages)))
        for k in range(len(self.languages)):
            sums[:, k] = np.bincount(word[at], total[:, k], len(words))
        return sums, np.bincount(word[at], minlength=len(words))


class Scorer:
    """Cross-entropies of texts; every distinct token is scored once while it stays in the cache."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.sums, self.sizes = np.zeros((0, len(model.languages))), np.zeros(0, np.int64)

    def _learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.index]
        if len(self.index) + len(new) > MAX_CACHED:
            self.index, new = {}, list(tokens)
            self.sums, self.sizes = self.sums[:0], self.sizes[:0]
        parts = [letters(token) for token in new]
        words = list({w for part in parts for w in part})
        number = {w: k for k, w in enumerate(words)}
        sums, sizes = self.model.score(words) if words else (self.sums[:0], self.sizes[:0])
        owner = np.repeat(np.arange(len(new)), [len(part) for part in parts])
        which = np.fromiter((number[w] for part in parts for w in part), np.int64, len(owner))
        token_sums = np.stack([np.bincount(owner, sums[which, k], len(new)) for k in range(len(self.model.languages))], 1)
        self.index.update(zip(new, range(len(self.sums), len(self.sums) + len(new))))
        self.sums = np.concatenate([self.sums, token_sums])
        self.sizes = np.concatenate([self.sizes, np.bincount(owner, sizes[which], len(new)).astype(np.int64)])

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character in each language (one row per text), and the characters predicted."""
        cut = [text.split() for text in texts]
        every = list(chain.from_iterable(cut))
        self._learn(set(every))
        flat = np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
        owner = np.repeat(np.arange(len(texts)), [len(tokens) for tokens in cut])
        sizes = np.bincount(owner, self.sizes[flat], len(texts)) if len(flat) else np.zeros(len(texts))
        bits = np.stack(
            [np.bincount(owner, self.sums[flat, k], len(texts)) for k in range(len(self.model.languages))], 1
        ) if len(flat) else np.zeros((len(texts), len(self.model.languages)))
        return -bits / np.maximum(sizes, 1)[:, None], sizes


def drawn(labelled: DataFrame, fit_rows: int) -> DataFrame | None:
    """About `fit_rows` distinct texts per label of (`text`, `lang`), each once; None without labels.

    Texts are drawn by their hash, so copies come or go together and count as one.
    """
    hashed = F.xxhash64("text", F.lit(11))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.countDistinct(hashed).alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(hashed, F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, fit_rows / n))])
    return labelled.where(draw < share[F.col("lang")]).distinct()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> Model | None:
    """Models of all non-null labels of `docs`, from about `fit_rows` distinct texts per label; None without any.

    Texts are chosen by their hash alone and used once, so the same texts give the same model
    however many copies they have. A fifth of them, again by hash, only calibrates the rejection.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    labelled = docs.select(common.quoted(text).cast("string").alias("text"), common.quoted(lang).cast("string").alias("lang"))
    labelled = labelled.where("text is not null and lang is not null")
    kept = drawn(labelled, fit_rows)
    if kept is None:
        return None
    sample = written(kept.withColumn("tries", F.pmod(F.xxhash64("text", F.lit(12)), F.lit(5)) == 0), "sample")
    word_counts = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def local(batches):
        found: dict[str, Counter] = {}
        for b in batches:
            for value, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(name, Counter()).update(letters(value))
        for name, words in found.items():
            yield common.batch(word_counts, [name] * len(words), list(words), list(words.values()))

    # a language with a single text may have only one to calibrate with; it is fitted on then
    fitted = sample.where("not tries").select("text", "lang")
    missing = sample.join(fitted.select("lang").distinct(), "lang", "left_anti").select("text", "lang")
    words = common.map_arrow(fitted.unionByName(missing), local, word_counts).groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def per_language(group: pa.Table) -> pa.Table:
        name = group["lang"][0].as_py()
        order = np.argsort(np.array(group["word"].to_pylist(), object))
        names = np.array(group["word"].to_pylist(), object)[order].tolist()
        rows = fit_language(names, group["n"].to_numpy()[order])
        return pa.Table.from_pylist(
            [dict(zip(FITTED.names, (name, n, kind, h.tobytes(), v.astype(float).tobytes(), s.tobytes(), c.tobytes()))) for n, kind, h, v, s, c in rows],
            schema=FITTED,
        )

    from pyspark.sql.pandas.types import from_arrow_schema

    rows = words.groupBy("lang").applyInArrow(per_language, from_arrow_schema(FITTED)).toArrow().to_pylist()
    if not rows:
        return None
    model = Model(rows)
    shared = spark.sparkContext.broadcast(model)

    def calibrating():
        scorer = Scorer(shared.value)

        def run(values):
            bits, sizes = scorer.entropies([v.decode() for v in values])
            return [(float(b.min()), int(b.argmin()), int(n)) for b, n in zip(bits, sizes)]

        return run

    kinds = {"bits": pa.float64(), "best": pa.int32(), "size": pa.int64()}
    tried = common.map_text(sample.where("tries"), "text", kinds, calibrating, replace_text=True).where("size > 0").toArrow()
    bits, best, size = (tried[c].to_numpy() for c in ("bits", "best", "size"))
    sure = np.array([model.languages[k] == name for k, name in zip(best, tried["lang"].to_pylist())], bool)
    _calibrate(model, bits[sure], best[sure], size[sure])
    return model


def _calibrate(model: Model, bits: np.ndarray, best: np.ndarray, size: np.ndarray) -> None:
    """Usual cross-entropy of each language and the highest deviation, in units that shrink with the root of the length.

    Takes texts whose label is the language that they chose. Languages with fewer than FEW of them
    take the figures of all languages together, and twice the cross-entropy is let pass, since a
    model of few texts predicts less well. With fewer than FEW in all nothing is rejected.
    """
    count = len(model.languages)
    model.means, model.spreads, model.highest = np.zeros(count), np.ones(count), np.full(count, np.inf)
    model.lowest = np.zeros(count)
    for k in range(count):
        own = best == k
        known = own.sum() >= FEW
        if not known:
            own = np.ones(len(best), bool)
        if own.sum() >= FEW:
            mean = np.median(bits[own])
            scaled = (bits[own] - mean) * np.sqrt(size[own])
            spread = max(1.4826 * np.median(np.abs(scaled - np.median(scaled))), 1e-6)
            usual = np.quantile(scaled, QUANTILE, method="lower") / spread
            model.means[k], model.spreads[k], model.highest[k] = mean, spread, max(SLACK * usual, LEAST_BOUND)
            model.lowest[k] = AT_LEAST * mean * (1 if known else 2)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred`, `score` (0 to 1), `bits` per character and `rejected`.

    A null text or one without a letter is `und`, rejected, with score 0. Without a model all texts
    are `und`, and those with a letter are not rejected. A rejected text keeps its
    nearest language in `lang_pred`. Ties go to the first language in order. Input columns named
    like a result are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        scorer = _scorer(own) if own is not None else None

        def run(values):
            if scorer is None:
                return [("und", 0.0, None, not letters(v.decode())) for v in values]
            bits, sizes = scorer.entropies([v.decode() for v in values])
            best = bits.argmin(1)
            gaps = (bits - bits.min(1, keepdims=True)) * np.minimum(sizes, SCORED_CHARS)[:, None]
            score = 1.0 / np.exp2(-gaps).sum(1)
            lowest = bits.min(1)
            deviation = (lowest - own.means[best]) * np.sqrt(sizes) / own.spreads[best]
            return [
                (own.languages[k], float(s), float(b), bool(d > own.highest[k] and b > own.lowest[k])) if n else ("und", 0.0, None, True)
                for k, s, b, d, n in zip(best, score, lowest, deviation, sizes)
            ]

        return run

    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "bits": pa.float64(), "rejected": pa.bool_()}
    return common.map_text(docs, text, kinds, make)


@lru_cache(1)
def _scorer(model: Model) -> Scorer:
    return Scorer(model)
