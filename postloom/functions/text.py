"""Text cleaning as column expressions; every stage runs inside the JVM."""

from __future__ import annotations

import logging
import re

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from postloom import constants as C

log = logging.getLogger(__name__)

# white space, or the place inside a glued word; the one-letter look-behind rules most places out
_SEAMS = "|".join(rf"(?<=\b{head})(?={tail}\b)" for head, tail in C.SPLIT_WORDS)
_LAST_LETTERS = "".join(sorted({head[-1] for head, _ in C.SPLIT_WORDS}))
_TOKEN_BORDER = rf"{C.SPACE_PATTERN}|(?i)(?<=[{_LAST_LETTERS}])(?:{_SEAMS})"


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, C.URL_PATTERN, "")


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, C.PUNCTUATION, "")


def remove_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, C.NON_ASCII_PATTERN, "")


def tokenize(text: Column) -> Column:
    """Words of a punctuation-free ASCII text; glued pairs such as "cannot" become two words."""
    return F.filter(F.split(text, _TOKEN_BORDER), lambda word: word != "")


def remove_stopwords(tokens: Column, stopwords: list[str]) -> Column:
    if not stopwords:
        return tokens
    return F.filter(tokens, lambda word: ~word.isin(sorted(stopwords)))


def remove_short(tokens: Column, min_length: int = 3) -> Column:
    return F.filter(tokens, lambda word: F.length(word) >= min_length)


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def clean_tokens(text: Column, stopwords: list[str], min_length: int = 3) -> Column:
    """All stages before lemmatization in their fixed order, with a single tokenization."""
    plain = remove_non_ascii(remove_punctuation(remove_urls(text)))
    return F.filter(
        F.split(F.lower(plain), _TOKEN_BORDER),
        # one pass over the words for all three conditions; shortest first, as it is the cheapest
        lambda word: (F.length(word) >= max(min_length, 1)) & (~word.isin(sorted(stopwords)) if stopwords else F.lit(True)),
    )


def terms(text: Column) -> Column:
    """Lower-cased words of two or more word characters, as the vectorizer sees them."""
    return F.regexp_extract_all(F.lower(text), F.lit(C.TERM_PATTERN), F.lit(0))


def load_stopwords(
    language: str = "english", custom_path: str | None = None, spark: SparkSession | None = None
) -> list[str]:
    """Stopwords of a language plus an optional file with one word per line.

    Words of the file are trimmed but keep their case. A file that does not exist is ignored; an
    unknown language gives no stopwords at all.
    """
    if language == "english":
        words = set(C.ENGLISH_STOPWORDS)
    else:
        try:
            words = set(StopWordsRemover.loadDefaultStopWords(language))
        except Exception as error:  # the JVM reports unknown languages in several ways
            log.warning("no stopwords for language %r: %s", language, type(error).__name__)
            return []
    if custom_path:
        words.update(_read_word_file(custom_path, spark))
    return sorted(words)


def _read_word_file(path: str, spark: SparkSession | None) -> list[str]:
    if spark is None:
        try:
            with open(path, encoding="utf-8") as file:
                return [line.strip() for line in file]
        except FileNotFoundError:
            return []
    try:
        return [row.value.strip() for row in spark.read.text(path).collect()]
    except Exception as error:
        if re.search("PATH_NOT_FOUND", str(error)):
            return []
        raise


def parse_values(value: str) -> list[str]:
    """Distinct, trimmed, lower-cased entries of a comma-separated list."""
    return sorted({part.strip().lower() for part in value.split(",")})


def values_of(rule: Column) -> Column:
    """`parse_values` for a column of lists."""
    return F.array_distinct(F.transform(F.split(rule, ","), lambda part: F.lower(F.trim(part))))
