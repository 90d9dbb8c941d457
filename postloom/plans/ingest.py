"""Batch ingest of dump files into the tables `submissions`, `comments`, `rejects` and `manifest`.

    {output}/submissions/batch_id=.../month=.../    typed posts, one row per id
    {output}/comments/batch_id=.../month=.../       flat comments, one row per id
    {output}/rejects/batch_id=.../                  lines in error with their status
    {output}/manifest/batch_id=.../                 one row per file, written last
    {output}/keys/{table}/batch_id=.../bucket=.../  the ids each batch stored, by hash bucket
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import constants as C
from postloom import schemas
from postloom.functions.names import entity_of
from postloom.operators import records, threads
from postloom.session import configure, scratch_folder, scratch_scope, written
from postloom.sources import keyindex
from postloom.sources import manifest as M
from postloom.sources.dumps import list_dumps, read_lines
from postloom.sources.tables import read_committed, write_batch


def mark(lines: DataFrame, field: str, value: str, match: str = "auto") -> DataFrame:
    """Lines with their status, whether they match, and the entity their file holds."""
    marked = records.mark_matches(records.parse_lines(lines, field), value, match)
    return marked.withColumn("entity", entity_of(F.col("file_name")))


def _stage(marked: DataFrame, folder: str) -> DataFrame:
    """Write every line once with its status; text is kept for matching lines and errors only.

    Dumps are decompressed and parsed a single time. The counters, the tables and the rejects are
    then read from their own folders of this table.
    """
    kind = F.when(F.col("matched"), "matched").when(F.col("line_status") != records.OK, "error").otherwise("other")
    text = F.when(kind != "other", F.col("value"))
    rows = marked.select("path", "file_name", "entity", "line_status", "matched", text.alias("value"), kind.alias("kind"))
    rows.write.mode("overwrite").partitionBy("kind").parquet(folder)
    schema = "path string, file_name string, entity string, line_status string, matched boolean, value string, kind string"
    return marked.sparkSession.read.schema(schema).parquet(folder)


def store(
    marked: DataFrame, output: str, batch_id: str, field: str, comment_depth: int | None = None
) -> DataFrame:
    """Append the matching lines of one batch to the tables and return its counters per file.

    Ids that an earlier batch has stored are left out. The batch writes to its own folders, so
    storing it again after a failure replaces what the first attempt left behind, and readers see
    it only once it is entered in the manifest. With `comment_depth` only comments up to that depth
    are stored, with their depth (-1: none); parents have to be stored already or in this batch.
    """
    spark = marked.sparkSession
    staged = _stage(marked, scratch_folder(spark, "stage"))
    hits = records.parse_lines(staged.where("kind = 'matched'").select("path", "entity", "value"), field)
    posts = records.select_posts(hits.where("entity = 'submissions'"), "path")
    _append(posts, output, "submissions", batch_id, schemas.SUBMISSIONS)
    if comment_depth is None or comment_depth >= 0:
        comments = records.select_comments(hits.where("entity = 'comments'"), "path")
        _append(comments, output, "comments", batch_id, schemas.COMMENTS, comment_depth)
    errors = staged.where("kind = 'error'").select("path", "file_name", "line_status", "value")
    write_batch(errors, f"{output}/rejects", batch_id)
    return records.line_counters(staged, "path")


def _append(rows: DataFrame, output: str, table: str, batch_id: str, schema, depth: int | None = None) -> None:
    """Store the first row of each id of a batch that no committed batch has stored, and index its ids.

    Stored ids are looked up in the key index, in the buckets of the batch's own ids only.
    """
    first = written(records.keep_first(rows, "id", ["created_utc", "path"]).drop("path"), "first")
    if depth is not None:
        stored = read_committed(rows.sparkSession, output, table, schema).where(F.col("batch_id") != batch_id)
        every = stored.select(schema.names).unionByName(first.select(schema.names))
        deep = threads.thread_depth(every, depth).select("id", "depth").dropDuplicates(["id"])
        first = written(first.drop("depth").join(deep, "id").select(*first.columns), "first")
    fresh = written(keyindex.not_stored(first, output, table, batch_id, schema), "fresh")
    write_batch(fresh, f"{output}/{table}", batch_id, "created_utc")
    keyindex.write_keys(fresh, output, table, batch_id)


def readable(spark: SparkSession, paths: list[str], long_windows: bool = False) -> tuple[list[str], dict[str, str]]:
    """Files that can be read to their end, and the error of each that cannot.

    Halves a list that fails, so a few bad files among many take few jobs. Only looked for after a
    batch has failed.
    """
    try:
        read_lines(spark, paths, long_windows).agg(F.sum(F.length("value"))).first()
    except Exception as error:
        if len(paths) == 1:
            return [], {paths[0]: str(error).strip().splitlines()[0][:500] if str(error).strip() else type(error).__name__}
        half = len(paths) // 2
        left, right = readable(spark, paths[:half], long_windows), readable(spark, paths[half:], long_windows)
        return left[0] + right[0], left[1] | right[1]
    return paths, {}


def ingest(
    spark: SparkSession,
    folder: str,
    output: str,
    field: str = "subreddit",
    value: str = C.COMMUNITY,
    start: str | None = None,
    end: str | None = None,
    comment_depth: int | None = None,
    match: str = "auto",
    long_windows: bool = False,
    spread: int | None = None,
) -> DataFrame:
    """Ingest all files under `folder` that are not in the manifest yet; returns the manifest.

    A second call reads only files that are new or failed before. A file that cannot be read to its
    end gets its error in the manifest and is not complete; the others are stored. A call with
    another filter than the stored run raises ValueError and writes nothing. With `comment_depth`
    only comments up to that depth are stored (-1: none).
    """
    configure(spark)
    records.matches(F.lit(""), value, match)  # rejects an unusable filter before anything is read
    args = M.run_args(field, value, match)
    manifest = M.read_manifest(spark, output)
    M.check_args(manifest, args)
    files = M.pending(list_dumps(spark, folder, start, end), manifest)
    # names of files only; the same list is what the scan plans its tasks from
    todo = [row.path for row in files.select("path").orderBy("path").collect()]
    if not todo:
        return manifest

    def run(paths: list[str], failed: dict[str, str]) -> None:
        # the name depends on the files that failed as well, so a later try of theirs is a batch of its own
        batch_id = "b" + hashlib.md5("\n".join([args, *todo, *sorted(failed)]).encode()).hexdigest()
        marked = mark(read_lines(spark, paths, long_windows, spread), field, value, match)
        counters = store(marked, output, batch_id, field, comment_depth)
        same = lambda name: F.regexp_replace(name, "^file:/+", "/")
        counted = counters.select(same("path").alias("_at"), *[c for c in counters.columns if c != "path"])
        errors = spark.createDataFrame(list(failed.items()), "_failed string, error_message string")
        state = (
            files.join(counted, same("path") == F.col("_at"), "left")
            .join(errors, F.col("path") == F.col("_failed"), "left")
            .select(
                F.col("path").alias("input_path"),
                F.lit(output).alias("output_path"),
                F.col("error_message").isNull().alias("complete"),
                *[F.coalesce(name, F.lit(0)).alias(name) for name in ("lines_processed", "error_lines", "lines_matched")],
                F.col("length").alias("file_size"),
                "error_message",
                F.lit(args).alias("args"),
                F.lit(M.RUN_TYPE).alias("type"),
            )
        )
        M.append_manifest(state, output, batch_id)

    with scratch_scope(spark):
        try:
            run(todo, {})
        except Exception:
            good, bad = readable(spark, todo, long_windows)
            if not bad:
                raise
            run(good, bad)
    return M.read_manifest(spark, output)


def totals(manifest: DataFrame) -> DataFrame:
    """Run totals over the manifest; of a file that failed and was read later the later state counts."""
    rest = [name for name in manifest.columns if name not in ("input_path", "complete")]
    last = manifest.groupBy("input_path").agg(F.max(F.struct("complete", *rest)).alias("_last"))
    files = last.select("input_path", "_last.*")
    return records.run_totals(files.withColumn("bytes_processed", F.when(F.col("complete"), F.col("file_size")).otherwise(0)))


def ingest_listings(
    listings: DataFrame, output: str, batch_id: str, comment_depth: int | None = None
) -> DataFrame:
    """Store the comments of landed listing documents, `(post_id, value)` with one JSON array per post.

    The comments keep the depth of their listing; deeper ones than `comment_depth` are not stored
    (-1: none). Ids that an earlier batch has stored are left out. The same `batch_id` replaces what
    it stored before. Returns the comments of the batch.
    """
    spark = listings.sparkSession
    configure(spark)
    with scratch_scope(spark):
        comments = threads.flatten_listings(listings)
        if comment_depth is not None:
            comments = comments.where(F.col("depth") <= comment_depth)
        first = written(records.keep_first(comments, "id", ["created_utc", "post_id"]), "first")
        fresh = written(keyindex.not_stored(first, output, "comments", batch_id, schemas.COMMENTS).select(schemas.COMMENTS.names), "fresh")
        write_batch(fresh, f"{output}/comments", batch_id, "created_utc")
        keyindex.write_keys(fresh, output, "comments", batch_id)
        counts = listings.agg(F.count("*").alias("listings")).withColumn("ts", F.current_timestamp())
        write_batch(counts, f"{output}/progress", batch_id)  # from here on readers see the batch
    mine = read_committed(spark, output, "comments", schemas.COMMENTS)
    return mine.where(F.col("batch_id") == batch_id).select(schemas.COMMENTS.names)


def comment_threads(spark: SparkSession, output: str, max_depth: int | None = None) -> DataFrame:
    """Stored comments with their depth, without excluded ones and the replies below them."""
    comments = read_committed(spark, output, "comments", schemas.COMMENTS).select(schemas.COMMENTS.names)
    return threads.thread_depth(comments, max_depth, threads.keeps(F.col("author"), F.col("body")))
