"""Noun lemmas as a job over the vocabulary instead of a dictionary call per word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom import constants as C
from postloom.operators.joins import BROADCAST_BYTES, HOT_FLOOR, lookup_join
from postloom.session import written


def vocabulary(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """Distinct words with the number of times they occur."""
    return tokens.select(F.explode(column).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def lemma_table(
    words: DataFrame, dictionary: DataFrame | None = None, exceptions: DataFrame | None = None
) -> DataFrame:
    """`(word, lemma)` for the words whose lemma differs from the word itself.

    Candidates are the word and its form under every noun ending. Those found in `dictionary`
    (one column `word`; by default the words themselves) compete, the shortest wins and ties go to
    the first in alphabetical order. Irregular nouns may be given in `exceptions` (`word, lemma`)
    and come before the endings.
    """
    words = words.select("word")
    known = words if dictionary is None else dictionary.select("word").distinct()
    word = F.col("word")
    forms = [
        F.when(word.endswith(old), F.concat(F.expr(f"left(word, length(word) - {len(old)})"), F.lit(new)))
        for old, new in C.NOUN_ENDINGS
    ]
    # words without such an ending cannot change, so they never reach the joins
    changing = words.where(word.endswith("s") | word.endswith("men"))
    candidates = changing.select("word", F.explode(F.array_compact(F.array(word, *forms))).alias("form"))
    lemmas = (
        candidates.join(known.select(F.col("word").alias("form")), "form", "left_semi")
        .groupBy("word")
        .agg(F.min(F.struct(F.length("form").alias("size"), F.col("form"))).alias("best"))
        .select("word", F.col("best.form").alias("lemma"))
    )
    if exceptions is not None:
        irregular = words.join(exceptions.select("word", "lemma"), "word").groupBy("word").agg(
            F.min(F.struct(F.length("lemma").alias("size"), F.col("lemma"))).alias("best")
        ).select("word", F.col("best.lemma").alias("lemma"))
        lemmas = irregular.unionByName(lemmas.join(irregular, "word", "left_anti"))
    return lemmas.where(F.col("word") != F.col("lemma"))


def apply_lemmas(
    docs: DataFrame,
    lemmas: DataFrame,
    id_col: str,
    column: str = "tokens",
    carry: tuple[str, ...] = (),
    counts: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Replace every word that has a lemma, keeping order and all other columns.

    `lemmas` is read several times and should be a stored table. Rows are placed
    by `id_col` first: with a broadcast lemma table the words of a document then stay where they
    are until they are put together again. Small columns named in `carry` travel with the words;
    all others are joined back by id.
    """
    others = [name for name in docs.columns if name not in (id_col, column, *carry)]
    words = docs.select(id_col, *carry, column).repartition(F.col(id_col))
    words = words.select(id_col, *carry, F.posexplode_outer(column).alias("pos", "word"))
    words = lookup_join(words, lemmas, "word", id_col, "left", counts, broadcast_bytes, floor)
    place = F.struct("pos", F.coalesce("lemma", "word").alias("word"))
    spelled = words.groupBy(id_col).agg(
        *[F.first(name).alias(name) for name in carry],
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), place))).alias("_words"),
    )
    spelled = spelled.select(id_col, *carry, F.col("_words.word").alias(column))
    if others:
        spelled = docs.select(id_col, *others).join(spelled, id_col)
    return spelled.select(*docs.columns)


def lemmatize(
    docs: DataFrame,
    id_col: str,
    column: str = "tokens",
    carry: tuple[str, ...] = (),
    dictionary: DataFrame | None = None,
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """Lemmatize token arrays with a table built from their own vocabulary.

    The arrays are written once, so that texts are not cleaned again for each of the passes.
    """
    docs = written(docs, "tokens")
    words = written(vocabulary(docs, column), "words")
    lemmas = written(lemma_table(words, dictionary, exceptions), "lemmas")
    return apply_lemmas(docs, lemmas, id_col, column, carry, words)
