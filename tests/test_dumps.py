import io
import json

import pytest
import zstandard
from pyspark.sql import functions as F

from postloom import schemas
from postloom.operators import threads
from postloom.plans import ingest as I
from postloom.sources import dumps, manifest
from postloom.sources.tables import read_committed, read_stored
from postloom.streaming.ingest import stream_ingest


def post(id, group="mentalhealth", **more):
    return json.dumps({"id": id, "subreddit": group, "created_utc": 1577836800, **more})


def comment(id, post_id, parent, group="mentalhealth"):
    return json.dumps({"id": id, "link_id": f"t3_{post_id}", "parent_id": parent, "author": "a", "created_utc": 5,
                       "body": "b", "subreddit": group})


def write(path, *frames, window=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    out = io.BytesIO()
    for text in frames:
        if window:
            params = zstandard.ZstdCompressionParameters.from_level(3, window_log=window)
            packer = zstandard.ZstdCompressor(compression_params=params)
        else:
            packer = zstandard.ZstdCompressor()
        with packer.stream_writer(out, closefd=False) as writer:
            writer.write(text.encode())
    path.write_bytes(out.getvalue())


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "dumps"
    write(root / "A" / "RS_2020-01.zst", "\n".join([post("p1"), post("p2", "cats"), "not json", "[1]", '{"id":"z"}']))
    whole = "\n".join([post("p3", selftext="first"), post("p1", title="again"), post("p4", "MentalHealthSupport")]) + "\n"
    write(root / "RS_2020-03.zst", whole[:60], whole[60:])
    write(root / "RC_2020-04.zst", "\n".join([comment("c1", "p1", "t3_p1"), comment("c2", "p1", "t1_c1"), comment("c3", "p9", "t3_p9", "cats")]))
    write(root / "RS_misc.zst", post("p5") + "\n")
    write(root / "other_2020-01.zst", post("no") + "\n")
    (root / "RS_2020-01.txt").write_text(post("no"))
    return root


def ids(df):
    return sorted(r.id for r in df.collect())


def test_listing(spark, folder):
    rows = dumps.list_dumps(spark, str(folder)).collect()
    assert sorted((r.file_name, r.entity, r.month) for r in rows) == [
        ("RC_2020-04.zst", "comments", "2020-04"), ("RS_2020-01.zst", "submissions", "2020-01"),
        ("RS_2020-03.zst", "submissions", "2020-03"), ("RS_misc.zst", "submissions", ""),
    ]
    kept = dumps.list_dumps(spark, str(folder), "2020-02", "2020-03")
    assert sorted(r.file_name for r in kept.collect()) == ["RS_2020-03.zst", "RS_misc.zst"]
    sizes = [r.length for r in dumps.largest_first(dumps.list_dumps(spark, str(folder))).collect()]
    assert sizes == sorted(sizes, reverse=True)


def test_both_readers_give_the_same_lines(spark, folder):
    paths = [r.path for r in dumps.list_dumps(spark, str(folder)).collect()]
    plain = sorted((r.file_name, r.value) for r in dumps.read_lines(spark, paths).collect())
    own = sorted((r.file_name, r.value) for r in dumps.read_lines(spark, paths, long_windows=True).collect())
    assert plain == own and len(plain) == 12
    assert sorted(r.value for r in dumps.read_lines(spark, paths, spread=3).collect()) == sorted(v for _, v in plain)


def test_long_windows(spark, tmp_path):
    write(tmp_path / "RS_2020-02.zst", "one\ntwo\n", window=31)
    path = f"file://{tmp_path}/RS_2020-02.zst"
    with pytest.raises(Exception):
        dumps.read_lines(spark, [path]).collect()
    assert [r.value for r in dumps.read_lines(spark, [path], long_windows=True).collect()] == ["one", "two"]


def test_lines_across_chunks(tmp_path, monkeypatch):
    from postloom.sources import zstd_source

    monkeypatch.setattr(zstd_source, "CHUNK", 7)
    text = "\n".join("é" * n for n in range(30)) + "\n\nlast"
    write(tmp_path / "RS_x.zst", text)
    got = [line for batch in zstd_source._line_batches(f"file://{tmp_path}/RS_x.zst") for line in batch]
    assert got == text.split("\n")


def test_ingest(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    state = {r.input_path.rsplit("/", 1)[-1]: r for r in I.ingest(spark, str(folder), out).collect()}
    counts = {name: (r.lines_processed, r.lines_matched, r.error_lines) for name, r in state.items()}
    assert counts == {"RS_2020-01.zst": (5, 1, 3), "RS_2020-03.zst": (3, 3, 0), "RC_2020-04.zst": (3, 2, 0), "RS_misc.zst": (1, 1, 0)}
    posts = read_stored(spark, f"{out}/submissions", schemas.SUBMISSIONS)
    assert ids(posts) == ["p1", "p3", "p4", "p5"]
    assert posts.where("id = 'p1'").first().title is None  # of two equal times the first file wins
    comments = read_stored(spark, f"{out}/comments", schemas.COMMENTS)
    assert sorted((r.id, r.depth) for r in threads.thread_depth(comments).collect()) == [("c1", 0), ("c2", 1)]
    assert ids(I.comment_threads(spark, out, 0)) == ["c1"] and ids(I.comment_threads(spark, out)) == ["c1", "c2"]
    assert sorted(r.line_status for r in spark.read.parquet(f"{out}/rejects").collect()) == ["bad_json", "missing_field", "not_object"]
    total = I.totals(manifest.read_manifest(spark, out)).first()
    assert (total.files, total.lines_processed, total.lines_matched, total.error_lines, total.files_done, total.files_failed) == (4, 12, 7, 3, 4, 0)
    assert total.total_bytes == total.bytes_processed > 0

    assert I.ingest(spark, str(folder), out).count() == 4  # nothing new
    write(folder / "RS_2020-05.zst", "\n".join([post("p1"), post("p6")]))
    assert I.ingest(spark, str(folder), out).count() == 5
    assert ids(read_stored(spark, f"{out}/submissions", schemas.SUBMISSIONS)) == ["p1", "p3", "p4", "p5", "p6"]
    with pytest.raises(ValueError):
        I.ingest(spark, str(folder), out, value="cats")
    assert manifest.read_manifest(spark, out).count() == 5


def test_storing_a_batch_twice_changes_nothing(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    paths = [r.path for r in dumps.list_dumps(spark, str(folder)).collect()]
    for _ in range(2):
        I.store(I.mark(dumps.read_lines(spark, paths), "subreddit", "mentalhealth"), out, "b1", "subreddit")
    assert ids(read_stored(spark, f"{out}/submissions", schemas.SUBMISSIONS)) == ["p1", "p3", "p4", "p5"]


@pytest.mark.parametrize("long_windows", [False, True])
def test_odd_folder_names(spark, tmp_path, long_windows):
    write(tmp_path / "my dumps+x%41é" / "RS_2020-01.zst", post("p1") + "\nbad\n")
    row = I.ingest(spark, str(tmp_path), str(tmp_path / "out"), long_windows=long_windows).first()
    assert (row.lines_processed, row.lines_matched, row.error_lines) == (2, 1, 1)
    assert "my dumps+x%41é" in row.input_path
    assert I.ingest(spark, str(tmp_path), str(tmp_path / "out"), long_windows=long_windows).count() == 1


def test_no_input_and_no_comments(spark, folder, tmp_path):
    empty = tmp_path / "empty"
    empty.mkdir()
    assert I.ingest(spark, str(empty), str(tmp_path / "o1")).count() == 0
    assert dumps.read_lines(spark, []).count() == 0
    I.ingest(spark, str(folder), str(tmp_path / "o2"), comment_depth=-1)
    assert read_stored(spark, str(tmp_path / "o2" / "comments"), schemas.COMMENTS).count() == 0
    with pytest.raises(ValueError):
        I.ingest(spark, str(folder), str(tmp_path / "o3"), value=" ")


def test_stream_equals_batch_and_reads_files_once(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = stream_ingest(spark, str(folder), out, state)
    query.awaitTermination()
    seen = [p.observedMetrics["lines"] for p in query.recentProgress if "lines" in p.observedMetrics]
    assert sum(r.lines_processed for r in seen) == 12 and sum(r.lines_matched for r in seen) == 7
    assert sum(r.error_lines for r in seen) == 3
    I.ingest(spark, str(folder), str(tmp_path / "batch"))
    columns = [name for name in schemas.SUBMISSIONS.names]
    both = [read_stored(spark, f"{root}/submissions", schemas.SUBMISSIONS).select(columns) for root in (out, tmp_path / "batch")]
    assert both[0].count() == 4 and both[0].exceptAll(both[1]).isEmpty() and both[1].exceptAll(both[0]).isEmpty()
    write(folder / "RS_2020-06.zst", "\n".join([post("p7"), post("p3")]))
    stream_ingest(spark, str(folder), out, state).awaitTermination()
    assert ids(read_stored(spark, f"{out}/submissions", schemas.SUBMISSIONS)) == ["p1", "p3", "p4", "p5", "p7"]
    progress = spark.read.parquet(f"{out}/progress")
    assert progress.agg(F.sum("lines_processed")).first()[0] == 14
    assert progress.select("batch").distinct().count() == 2


def test_month_limits_in_the_stream(spark, folder, tmp_path):
    stream_ingest(spark, str(folder), str(tmp_path / "o"), str(tmp_path / "s"), start="2020-02", end="2020-03").awaitTermination()
    assert ids(read_stored(spark, str(tmp_path / "o" / "submissions"), schemas.SUBMISSIONS)) == ["p1", "p3", "p4", "p5"]


def test_one_bad_file_does_not_stop_the_others(spark, folder, tmp_path):
    broken = folder / "RS_2020-05.zst"
    write(broken, "\n".join(post(f"q{k}", title="x" * 300 + str(k * 7919)) for k in range(3000)))
    whole = broken.read_bytes()
    broken.write_bytes(whole[: len(whole) // 2])
    out = str(tmp_path / "o")
    rows = {r.input_path.rsplit("/", 1)[1]: r for r in I.ingest(spark, str(folder), out).collect()}
    assert not rows["RS_2020-05.zst"].complete and rows["RS_2020-05.zst"].error_message
    assert all(r.complete and r.error_message is None for name, r in rows.items() if name != "RS_2020-05.zst")
    assert I.totals(manifest.read_manifest(spark, out)).first().files_failed == 1
    assert ids(read_committed(spark, out, "submissions", schemas.SUBMISSIONS)) == ["p1", "p3", "p4", "p5"]
    broken.write_bytes(whole)
    again = I.ingest(spark, str(folder), out)
    assert sum(r.complete for r in again.collect()) == 5
    last = I.totals(again).first()
    assert (last.files, last.files_failed, last.files_done) == (5, 0, 5)
    assert read_committed(spark, out, "submissions", schemas.SUBMISSIONS).count() == 3004


def test_readers_see_only_batches_that_are_entered(spark, folder, tmp_path):
    out = str(tmp_path / "o")
    I.ingest(spark, str(folder), out)
    lines = dumps.read_lines(spark, [str(folder / "RS_misc.zst")])
    I.store(I.mark(lines.withColumn("value", F.replace("value", F.lit("p5"), F.lit("p9"))), "subreddit", "mentalhealth"), out, "died", "subreddit")
    assert "p9" in ids(read_stored(spark, f"{out}/submissions", schemas.SUBMISSIONS))
    assert "p9" not in ids(read_committed(spark, out, "submissions", schemas.SUBMISSIONS))


def test_comment_depth_limits_what_is_stored(spark, folder, tmp_path):
    for depth, want in ((-1, {}), (0, {"c1": 0}), (1, {"c1": 0, "c2": 1})):
        out = str(tmp_path / f"o{depth}")
        I.ingest(spark, str(folder), out, comment_depth=depth)
        assert {r.id: r.depth for r in read_committed(spark, out, "comments", schemas.COMMENTS).collect()} == want


def test_ingest_leaves_no_scratch_tables(spark, folder, tmp_path):
    import os

    from postloom.session import checkpoint_dir

    where = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(where))
    I.ingest(spark, str(folder), str(tmp_path / "o"))
    stream_ingest(spark, str(folder), str(tmp_path / "s"), str(tmp_path / "state")).awaitTermination()
    left = {name for name in set(os.listdir(where)) - before if "-" in name and not name.count("-") == 4}
    assert not left


def test_months_do_not_depend_on_the_time_zone(spark, tmp_path):
    from postloom.sources.tables import write_batch

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.range(1).select(F.timestamp_seconds(F.lit(1577836800)).alias("created_utc"))  # 2020-01-01 in UTC
        write_batch(rows, str(tmp_path / "t"), "b", "created_utc")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [p.name for p in (tmp_path / "t" / "batch_id=b").glob("month=*")] == ["month=2020-01"]


def test_another_match_mode_is_another_run(spark, folder, tmp_path):
    I.ingest(spark, str(folder), str(tmp_path / "o"))
    with pytest.raises(ValueError):
        I.ingest(spark, str(folder), str(tmp_path / "o"), match="exact")


def test_landed_listings_are_stored_with_their_depth(spark, tmp_path):
    node = lambda id, replies="": {"data": {"id": id, "author": "a", "body": "b", "created_utc": 5, "replies": replies}}
    within = lambda *nodes: {"data": {"children": list(nodes)}}
    value = json.dumps([{}, within(node("c1", within(node("c2", within(node("c3"))))), node("c4"))])
    listings = spark.createDataFrame([("p1", value)], "post_id string, value string")
    out = str(tmp_path / "o")
    got = I.ingest_listings(listings, out, "first", comment_depth=1)
    assert {r.id: (r.post_id, r.parent_id, r.depth) for r in got.collect()} == {
        "c1": ("p1", "p1", 0), "c2": ("p1", "c1", 1), "c4": ("p1", "p1", 0)
    }
    assert ids(I.ingest_listings(listings, out, "second")) == ["c3"]
    assert ids(I.ingest_listings(listings, out, "first", comment_depth=1)) == ["c1", "c2", "c4"]
    assert ids(read_committed(spark, out, "comments", schemas.COMMENTS)) == ["c1", "c2", "c3", "c4"]
