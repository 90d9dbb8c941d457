"""Labelled text datasets from stored posts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import constants as C


def month_start(month: str) -> int:
    """Epoch second at which a YYYY-MM month (or a full YYYY-MM-DD date) begins, in UTC."""
    pattern = "%Y-%m" if len(month) == 7 else "%Y-%m-%d"
    return int(datetime.strptime(month, pattern).replace(tzinfo=timezone.utc).timestamp())


def between_months(created: Column, start: str | None, end: str | None) -> Column:
    """Both bounds are exclusive: the first instants of both months are outside."""
    inside = F.lit(True)
    if start:
        inside = inside & (created > F.timestamp_seconds(F.lit(month_start(start))))
    if end:
        inside = inside & (created < F.timestamp_seconds(F.lit(month_start(end))))
    return inside


def dataset_text(title: Column, selftext: Column) -> Column:
    """Title, one space, body; a missing part leaves its side of the space empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(selftext, F.lit("")))


def flair_dataset(
    posts: DataFrame,
    start: str | None = None,
    end: str | None = None,
    flairs: list[str] | None = None,
    community: str = C.COMMUNITY,
    ignore_case: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """`(text, label_post)` of the posts of a community that carry one of the flairs.

    Posts with a removed or missing body are dropped. `ignore_case` compares community and flair
    without regard to case; `keep` names columns to carry along, for example an id.
    """
    flair, group = F.col("link_flair_text"), F.col("subreddit")
    wanted = flairs or C.FLAIRS
    if ignore_case:
        flair, group = F.lower(flair), F.lower(group)
        wanted, community = [name.lower() for name in wanted], community.lower()
    body = F.col("selftext")
    rows = posts.where(flair.isin(wanted) & (group == community) & between_months(F.col("created_utc"), start, end))
    for tombstone in C.TOMBSTONES:
        rows = rows.where(body != tombstone)
    return rows.select(
        *keep, dataset_text(F.col("title"), body).alias("text"), F.col("link_flair_text").alias("label_post")
    )


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def fill_text(df: DataFrame, *names: str) -> DataFrame:
    """Cast to string with nulls as empty text; no row is dropped."""
    return df.withColumns({name: F.coalesce(F.col(name).cast("string"), F.lit("")) for name in names})


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)
