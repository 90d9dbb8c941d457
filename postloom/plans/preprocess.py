"""Cleaning of a labelled text dataset."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom import constants as C
from postloom.functions import text as X
from postloom.operators.dataset import require_columns
from postloom.functions.stages import NounLemmasModel, TextCleaner
from postloom.operators.lemmas import apply_lemmas, lemma_table, lemmatize, vocabulary
from postloom.session import written


def with_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """`df` with a row id; ids that have to be made up are written down so that they never change."""
    if id_col in df.columns:
        return df
    return written(df.withColumn(id_col, F.monotonically_increasing_id()), "rows")


def clean_text(
    df: DataFrame,
    text: str = "text",
    id_col: str = "id",
    min_length: int = 3,
    stopwords: list[str] | None = None,
    lemmas: DataFrame | bool | None = True,
    dictionary: DataFrame | None = None,
    exceptions: DataFrame | None = None,
    carry: tuple[str, ...] = ("label_post",),
    output: str = "text_clean",
) -> DataFrame:
    """Replace `text` by `output`: the words that are left after all stages, joined by spaces.

    `lemmas` is True for a table built from the words of this text, a table to use as it is, or
    None for no lemmas. All other columns stay, `carry` names small ones that need no join to do
    so; the ids have to be unique.
    """
    words = C.ENGLISH_STOPWORDS if stopwords is None else stopwords
    others = [name for name in df.columns if name not in (text, id_col)]
    tokens = df.select(id_col, *others, X.clean_tokens(F.col(text), words, min_length).alias("tokens"))
    carried = tuple(name for name in carry if name in others)
    if lemmas is True:
        tokens = lemmatize(tokens, id_col, "tokens", carried, dictionary, exceptions)
    elif lemmas is not None and lemmas is not False:
        tokens = apply_lemmas(tokens, lemmas, id_col, "tokens", carried)
    return tokens.select(id_col, *others, X.join_tokens(F.col("tokens")).alias(output))


def cleaning_model(
    lemmas: DataFrame | None, min_length: int = 3, stopwords: list[str] | None = None
) -> PipelineModel:
    """All cleaning stages from a column `text` to `text_clean`, with the lemma table they use (None: no lemmas)."""
    stages = [TextCleaner(inputCol="text", outputCol="text_clean", minLength=min_length, stopwords=stopwords)]
    return PipelineModel(stages if lemmas is None else [*stages, NounLemmasModel(lemmas)])


def preprocess_dataset(
    df: DataFrame,
    min_length: int = 3,
    language: str = "english",
    custom_stopwords: str | None = None,
    dictionary: DataFrame | None = None,
    exceptions: DataFrame | None = None,
    id_col: str = "id",
) -> tuple[DataFrame, PipelineModel]:
    """`(label_post, text_clean)` of a raw dataset, with its id column first if it has one, and the fitted cleaning.

    The cleaning holds the word list, the shortest length and the lemma table of this dataset;
    training stores it in front of the model, so that new texts are cleaned in the same way.
    """
    require_columns(df, "text", "label_post")
    kept = [id_col] if id_col in df.columns else []
    rows = with_id(df.select(*kept, "text", "label_post"), id_col)
    stopwords = X.load_stopwords(language, custom_stopwords, df.sparkSession)
    tokens = X.clean_tokens(F.coalesce("text", F.lit("")), stopwords, min_length).alias("tokens")
    tokens = written(rows.select(id_col, "label_post", tokens), "tokens")
    words = written(vocabulary(tokens), "words")
    table = written(lemma_table(words, dictionary, exceptions), "lemmas")
    spelled = apply_lemmas(tokens, table, id_col, "tokens", ("label_post",), words)
    cleaned = spelled.select(*kept, "label_post", X.join_tokens(F.col("tokens")).alias("text_clean"))
    return cleaned, cleaning_model(table, min_length, stopwords)
