"""From raw JSON lines to typed posts and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import fields
from postloom.functions.text import parse_values
from postloom.operators.joins import BROADCAST_BYTES, table_bytes

OK = "ok"
POST_FIELDS = ["id", "author", "title", "created_utc", "selftext", "subreddit", "link_flair_text", "permalink",
               "num_comments", "score"]
COMMENT_FIELDS = ["id", "link_id", "parent_id", "author", "created_utc", "body"]


def _text(key: str) -> Column:
    return F.try_variant_get("json", f"$.{key}", "string")


def field_path(field: str) -> str:
    """JSON path of a top-level key; it may hold dots, spaces and one kind of quotes."""
    quote = '"' if "'" in field else "'"
    if quote in field:
        raise ValueError(f"unusable field name: {field}")
    return f"$[{quote}{field}{quote}]"


def _once(column: Column) -> Column:
    """Compute an expensive value in a generator, below which no later filter can be moved.

    A filter on a plain projection is pushed under it together with a copy of the expression, and
    every line would be parsed once per use.
    """
    return F.explode(F.array(column))


def parse_lines(lines: DataFrame, field: str = "subreddit", value: str = "value") -> DataFrame:
    """Add `json` (a VARIANT), `observed` (the filter field in lower case) and `line_status`."""
    path = field_path(field)
    found = F.try_variant_get("json", path, "variant")
    kind = F.schema_of_variant(found)
    status = (
        F.when(F.col("json").isNull(), "bad_json")
        .when(~F.col(value).rlike(r"^\s*\{"), "not_object")
        .when(found.isNull(), "missing_field")
        .when(kind != "STRING", "non_string_field")
        .otherwise(OK)
    )
    observed = F.when(kind == "STRING", F.lower(F.try_variant_get("json", path, "string")))
    parsed = lines.select(*lines.columns, _once(F.try_parse_json(value)).alias("json"))
    parsed = parsed.select(
        *parsed.columns, _once(F.struct(status.alias("line_status"), observed.alias("observed"))).alias("_head")
    )
    return parsed.select(*lines.columns, "json", "_head.line_status", "_head.observed")


def matches(observed: Column, value: str, match: str = "auto") -> Column:
    """Field filter: one value has to be contained, several have to be equal to the field.

    `match` set to "contains" or "exact" overrides that choice. Case never counts.
    """
    values = parse_values(value)
    if "" in values:
        raise ValueError("an empty filter value would match every line")
    if match == "auto":
        match = "contains" if len(values) == 1 else "exact"
    if match == "exact":
        return F.lower(observed).isin(values)
    if match != "contains":
        raise ValueError(f"unknown match mode: {match}")
    any_of = F.lit(False)
    for entry in values:
        any_of = any_of | F.contains(F.lower(observed), F.lit(entry))
    return any_of


def mark_matches(parsed: DataFrame, value: str, match: str = "auto") -> DataFrame:
    """Add `matched`; a matching line without an id or with an unusable time becomes an error line."""
    hit = (F.col("line_status") == OK) & matches(F.col("observed"), value, match)
    bad = hit & fields.epoch_is_bad(F.col("json"), "created_utc")
    status = F.when(hit & _text("id").isNull(), "missing_id").when(bad, "bad_time").otherwise(F.col("line_status"))
    marks = F.struct(status.alias("line_status"), hit.alias("hit"))
    others = [name for name in parsed.columns if name != "line_status"]
    marked = parsed.select(*others, _once(marks).alias("_marks"))
    status = F.col("_marks.line_status")
    return marked.select(*others, status.alias("line_status"), (F.col("_marks.hit") & (status == OK)).alias("matched"))


def select_posts(parsed: DataFrame, *keep: str) -> DataFrame:
    """The ten post columns, from `parsed` lines; `keep` names columns to carry along."""
    selftext = F.when(F.try_variant_get("json", "$.selftext", "variant").isNull(), "").otherwise(_text("selftext"))
    epoch = fields.epoch_of(F.col("json"), "created_utc")
    return parsed.select(
        *keep,
        _text("id").alias("id"),
        fields.post_author(_text("author")).alias("author"),
        _text("title").alias("title"),
        fields.timestamp_of(epoch).alias("created_utc"),
        selftext.alias("selftext"),
        _text("subreddit").alias("subreddit"),
        _text("link_flair_text").alias("link_flair_text"),
        fields.link_of(_text("permalink")).alias("link"),
        F.try_variant_get("json", "$.num_comments", "int").alias("num_comments"),
        F.try_variant_get("json", "$.score", "int").alias("score"),
    )


def select_comments(parsed: DataFrame, *keep: str) -> DataFrame:
    """Flat comment rows; type prefixes such as `t1_` are cut off, the depth is found later."""
    epoch = fields.epoch_of(F.col("json"), "created_utc")
    bare = r"^t[0-9]_"
    return parsed.select(
        *keep,
        _text("id").alias("id"),
        F.regexp_replace(_text("link_id"), bare, "").alias("post_id"),
        F.regexp_replace(_text("parent_id"), bare, "").alias("parent_id"),
        fields.comment_author(_text("author")).alias("author"),
        fields.timestamp_of(epoch).alias("created_utc"),
        _text("body").alias("body"),
        F.lit(None).cast("int").alias("depth"),
    )


def line_counters(marked: DataFrame, *by: str) -> DataFrame:
    """Lines processed, matched and in error per file."""
    return marked.groupBy(*by).agg(
        F.count("*").alias("lines_processed"),
        F.count_if("matched").alias("lines_matched"),
        F.count_if(F.col("line_status") != OK).alias("error_lines"),
    )


def run_totals(files: DataFrame) -> DataFrame:
    """Totals over the latest state of all files of a run."""
    done = F.col("complete") | F.col("error_message").isNotNull()
    return files.agg(
        F.count("*").alias("files"),
        F.sum("file_size").alias("total_bytes"),
        F.sum("bytes_processed").alias("bytes_processed"),
        F.sum("lines_processed").alias("lines_processed"),
        F.sum("lines_matched").alias("lines_matched"),
        F.sum("error_lines").alias("error_lines"),
        F.count_if(done).alias("files_done"),
        F.count_if(F.col("error_message").isNotNull()).alias("files_failed"),
    )


def latest_state(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last update per key, combined on the map side before the shuffle."""
    rest = [name for name in updates.columns if name not in (key, *order)]
    last = updates.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(key, *[F.col("_last")[name].alias(name) for name in (*order, *rest)])


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the smallest by `order` and then by all other columns.

    A minimum is combined on the map side, so a key with very many copies sends one row per map task.
    Rows whose order columns are null come last.
    """
    rest = [name for name in rows.columns if name not in (key, *order)]
    ranks = []
    for index, name in enumerate(order):
        ranks += [F.col(name).isNull().alias(f"_null{index}"), F.col(name).alias(name)]
    first = rows.groupBy(key).agg(F.min(F.struct(*ranks, *rest)).alias("_first"))
    return first.select(*[F.col(key) if name == key else F.col("_first")[name].alias(name) for name in rows.columns])


def not_stored(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the stored table; only the key column of that table is read.

    `rows` should be a written table. If its keys are small enough to broadcast, the stored keys
    are looked through where they are instead of being shuffled for every batch.
    """
    keys = rows.select(key)
    known = stored.select(key)
    if table_bytes(keys) <= BROADCAST_BYTES:
        known = known.join(F.broadcast(keys), key, "left_semi")
    return rows.join(known, key, "left_anti")
