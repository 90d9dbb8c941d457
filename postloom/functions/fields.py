"""Derivations of single output columns from raw JSON fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import constants as C

# the years 1 to 9999, which is what a calendar timestamp can hold
_MIN_EPOCH, _MAX_EPOCH = -62135596800, 253402300799


def filled(value: Column) -> Column:
    """Null where the value is null or empty."""
    return F.nullif(value, F.lit(""))


def post_author(author: Column) -> Column:
    return F.concat(F.lit(C.AUTHOR_PREFIX), filled(author))


def comment_author(author: Column) -> Column:
    """Like `post_author`, but the name of a deleted account stays bare."""
    return F.when(author == C.DELETED_AUTHOR, author).otherwise(F.concat(F.lit(C.AUTHOR_PREFIX), author))


def link_of(permalink: Column, prefix: str = C.LINK_PREFIX) -> Column:
    return F.concat(F.lit(prefix), filled(permalink))


def epoch_of(json: Column, key: str) -> Column:
    """Whole seconds from a JSON number or digit string; the number 0 counts as missing."""
    seconds = F.try_variant_get(json, f"$.{key}", "bigint")
    kind = F.schema_of_variant(F.try_variant_get(json, f"$.{key}", "variant"))
    return F.when((seconds != 0) | (kind == "STRING"), seconds)


def epoch_is_bad(json: Column, key: str) -> Column:
    """True where a value is given but cannot be a time."""
    given = F.try_variant_get(json, f"$.{key}", "string")
    seconds = F.try_variant_get(json, f"$.{key}", "bigint")
    usable = F.coalesce(seconds.between(_MIN_EPOCH, _MAX_EPOCH), F.lit(False))
    return F.coalesce(~given.isin("", "0", "false") & ~usable, F.lit(False))


def timestamp_of(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)
