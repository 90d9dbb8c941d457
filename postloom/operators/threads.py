"""Comment threads: nested listings to flat rows, and depth from parent pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import constants as C
from postloom.functions import fields
from postloom.operators.joins import HOT_FLOOR, hot_keys, small
from postloom.session import written


def keeps(author: Column, body: Column) -> Column:
    """Nodes that stay: they have a body and are not written by the excluded author."""
    names = [C.EXCLUDED_AUTHOR, C.AUTHOR_PREFIX + C.EXCLUDED_AUTHOR]  # raw, and as stored
    return body.isNotNull() & ~F.coalesce(author, F.lit("")).isin(names)


def flatten_listings(listings: DataFrame, post_id: str = "post_id", value: str = "value") -> DataFrame:
    """Comment rows of landed listing documents (one JSON array per post).

    Each round unnests one level of replies of all listings together. A node that is dropped takes
    its replies with it, since only kept nodes are unnested further.
    """
    start = F.try_variant_get(F.try_parse_json(value), "$[1].data.children", "variant")
    level = listings.select(
        F.col(post_id).alias("post_id"), F.col(post_id).alias("parent_id"), start.alias("children")
    )
    done: DataFrame | None = None
    depth = 0
    while True:
        nodes = _unnest(level, depth)
        level = written(nodes, "level")
        if level.isEmpty():
            return done if done is not None else _comment_rows(level)
        rows = _comment_rows(level)
        done = rows if done is None else done.unionByName(rows)
        level = level.where(F.schema_of_variant("replies").startswith("OBJECT")).select(
            "post_id",
            F.col("id").alias("parent_id"),
            F.try_variant_get("replies", "$.data.children", "variant").alias("children"),
        )
        depth += 1


def _unnest(level: DataFrame, depth: int) -> DataFrame:
    node = level.lateralJoin(
        level.sparkSession.tvf.variant_explode_outer(F.col("children").outer()).select(F.col("value").alias("node"))
    )
    data = lambda key, kind: F.try_variant_get("node", f"$.data.{key}", kind)
    present = data("body", "variant").isNotNull()
    return node.where(
        present & (F.coalesce(data("author", "string"), F.lit("")) != C.EXCLUDED_AUTHOR)
    ).select(
        "post_id",
        "parent_id",
        data("id", "string").alias("id"),
        fields.comment_author(F.coalesce(data("author", "string"), F.lit("None"))).alias("author"),
        fields.timestamp_of(fields.epoch_of(F.col("node"), "data.created_utc")).alias("created_utc"),
        data("body", "string").alias("body"),
        F.lit(depth).alias("depth"),
        data("replies", "variant").alias("replies"),
    )


def _comment_rows(level: DataFrame) -> DataFrame:
    return level.select("id", "post_id", "parent_id", "author", "created_utc", "body", "depth")


def thread_depth(
    comments: DataFrame,
    max_depth: int | None = None,
    keep: Column | None = None,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Add `depth` to flat comments: 0 under the post itself, else the parent's depth plus one.

    A comment whose chain of parents does not reach its post is left out. With `keep`, comments
    that fail it are left out together with all replies below them. With `max_depth`, deeper
    comments are left out (-1 keeps none).

    Every round doubles the distance each pending comment has looked up the tree, so a tree of
    depth d takes log2(d) joins instead of d.
    """
    columns = [name for name in comments.columns if name != "depth"]
    base = comments.select(*columns).where("post_id IS NOT NULL AND parent_id IS NOT NULL")
    if keep is not None:
        base = base.where(keep)
    if max_depth is not None and max_depth < 0:
        return base.limit(0).withColumn("depth", F.lit(0))
    top = F.col("parent_id") == F.col("post_id")
    # one row per comment, whatever repeats; of different parents the least counts
    unique = base.groupBy("post_id", "id").agg(F.min("parent_id").alias("parent_id"))
    state = written(
        unique.select(
            "post_id",
            "id",
            F.when(~top, F.col("parent_id")).alias("above"),
            F.when(top, 0).otherwise(1).cast("bigint").alias("steps"),
        ),
        "threads",
    )
    total = state.count()
    # comments that have found their post are not written again by later rounds
    done, pending = state.where("above IS NULL"), state.where("above IS NOT NULL")
    reach = 1
    while not pending.isEmpty():
        # a chain longer than all comments together is a cycle, one longer than the limit is cut
        if reach > total or (max_depth is not None and reach > max_depth):
            break
        moved = written(_double(done.unionByName(pending), pending, floor), "threads")
        done, pending = done.unionByName(moved.where("above IS NULL")), moved.where("above IS NOT NULL")
        reach *= 2
    found = done.select("post_id", "id", F.col("steps").cast("int").alias("depth"))
    if max_depth is not None:
        found = found.where(F.col("depth") <= max_depth)
    return base.join(found, ["post_id", "id"]).select(*columns, "depth")


def _double(state: DataFrame, pending: DataFrame, floor: int) -> DataFrame:
    """One round: every pending comment jumps to where its current ancestor points."""
    upper = state.select(
        "post_id", F.col("id").alias("above"), F.col("above").alias("next"), F.col("steps").alias("more")
    )
    counts = pending.groupBy("post_id", "above").agg(F.count("*").alias("n"))
    on = ["post_id", "above"]
    hot = hot_keys(counts, on, floor)
    if hot is not None:
        # a comment with very many replies: spread its replies, repeat its own row per salt
        salts = F.coalesce(F.col("_salts"), F.lit(1)).cast("bigint")
        hot = small(hot)
        pending = pending.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64("id"), salts))
        upper = upper.join(hot, on, "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))
        )
        on = [*on, "_salt"]
    return pending.join(upper, on).select(
        "post_id", "id", F.col("next").alias("above"), (F.col("steps") + F.col("more")).alias("steps")
    )


def comments_per_post(comments: DataFrame) -> DataFrame:
    return comments.groupBy("post_id").agg(F.count("*").alias("comments"))


def posts_with_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts joined with the number of their comments, 0 for posts without any.

    Comments are counted before the join, so a post with very many comments is one row in it.
    """
    joined = posts.join(comments_per_post(comments), posts["id"] == F.col("post_id"), "left").drop("post_id")
    return joined.withColumn("comments", F.coalesce("comments", F.lit(0)))
