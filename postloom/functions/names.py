"""What a dump file's name says about its content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import constants as C


def month_of(file_name: Column) -> Column:
    """First YYYY-MM in the name, or an empty string."""
    return F.regexp_extract(file_name, C.MONTH_PATTERN, 1)


def in_months(file_name: Column, start: str | None, end: str | None) -> Column:
    """True for files within both months (inclusive); files without a month are always kept."""
    month = month_of(file_name)
    within = F.lit(True)
    if start:
        within = within & (month >= start)
    if end:
        within = within & (month <= end)
    return (month == "") | within


def is_dump(file_name: Column) -> Column:
    return file_name.rlike(r"^(RC_|RS_)") & file_name.endswith(".zst")


def entity_of(file_name: Column) -> Column:
    """`submissions` or `comments` by prefix; any other name is an error."""
    return (
        F.when(file_name.startswith("RS"), F.lit("submissions"))
        .when(file_name.startswith("RC"), F.lit("comments"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown dump file type: "), file_name)).cast("string"))
    )


def file_name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
