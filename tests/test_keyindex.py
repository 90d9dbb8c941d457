"""The key index of stored batches: only the buckets of a batch are read, only committed batches count."""

from pyspark.sql import functions as F

from postloom.sources import keyindex
from postloom.sources.tables import write_batch

SCHEMA = "id string, created_utc timestamp"


def enter(spark, output, batch_id):
    write_batch(spark.createDataFrame([(batch_id,)], "note string"), f"{output}/manifest", batch_id)


def rows(spark, ids):
    return spark.createDataFrame([(i, None) for i in ids], SCHEMA)


def test_only_touched_buckets_of_committed_batches(spark, tmp_path):
    output = str(tmp_path)
    keyindex.write_keys(rows(spark, [f"a{k}" for k in range(200)]), output, "posts", "b1", buckets=16)
    enter(spark, output, "b1")
    keyindex.write_keys(rows(spark, ["lost1", "lost2"]), output, "posts", "b2", buckets=16)  # never entered
    batch = rows(spark, ["a3", "a150", "new", "lost1", None])
    touched = sorted(r[0] for r in batch.select(keyindex.bucket(F.col("id"), 16)).distinct().collect())
    known = keyindex.stored_keys(spark, output, "posts", touched, "b3")
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    scan = keyindex.bucket_scan(spark, keyindex.folder(output, "posts"), touched)
    files = {r[0] for r in scan.select(F.input_file_name()).collect()}
    assert files and all(any(f"bucket={b}/" in f for b in touched) for f in files)
    everything = {r[0] for r in keyindex.bucket_scan(spark, keyindex.folder(output, "posts"), list(range(16))).select(F.input_file_name()).collect()}
    assert len(files) < len(everything)
    fresh = keyindex.not_stored(batch, output, "posts", "b3", None, buckets=16)
    assert sorted(r.id for r in fresh.collect() if r.id is not None) == ["lost1", "new"]


def test_replay_and_backfill(spark, tmp_path):
    output = str(tmp_path)
    from postloom import schemas

    old = spark.createDataFrame([("p1", "x")], "id string, title string").withColumn("created_utc", F.lit(None).cast("timestamp"))
    write_batch(old.select("id"), f"{output}/submissions", "old")  # a table stored before the index existed
    enter(spark, output, "old")
    keyindex.write_keys(rows(spark, ["p2"]), output, "submissions", "b1")
    enter(spark, output, "b1")
    batch = rows(spark, ["p1", "p2", "p3"])
    fresh = keyindex.not_stored(batch, output, "submissions", "b1", schemas.SUBMISSIONS)
    assert sorted(r.id for r in fresh.collect()) == ["p2", "p3"]  # a replay of b1 does not see its own keys
    again = keyindex.not_stored(batch, output, "submissions", "b2", schemas.SUBMISSIONS)
    assert sorted(r.id for r in again.collect()) == ["p3"]


def test_batches_read_a_bounded_share(spark, tmp_path):
    output = str(tmp_path)
    read = []
    for n in range(6):
        ids = [f"x{n}-{k}" for k in range(50)]
        batch = rows(spark, ids)
        touched = sorted(r[0] for r in batch.select(keyindex.bucket(F.col("id"), 64)).distinct().collect())
        scan = keyindex.bucket_scan(spark, keyindex.folder(output, "t"), touched) if n else None
        read.append(len({r[0] for r in scan.select(F.input_file_name()).collect()}) if n else 0)
        fresh = keyindex.not_stored(batch, output, "t", f"b{n}", None, buckets=64)
        assert fresh.count() == 50
        keyindex.write_keys(fresh, output, "t", f"b{n}", buckets=64)
        enter(spark, output, f"b{n}")
    # files read grow with the batches in touched buckets, never with all buckets of all batches
    assert all(r <= n * len(touched) + 1 for n, r in enumerate(read))
