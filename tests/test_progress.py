import math
import random

import pytest
from pyspark.sql import functions as F

from postloom.operators import progress


def series(seed):
    rng = random.Random(seed)
    out = []
    for run, n in (("long", 500), ("short", 3), ("mid", 90)):
        t, size = 1000.0, 0
        for i in range(n):
            t += rng.choice([0, 0.5, 1, 7])
            size += rng.choice([0, 10, 1000, 5_000_000])
            out.append((run, i + 1, t, size, i * 3))
    return out


def brute(rows, kept):
    out, by_run = {}, {}
    for row in rows:
        by_run.setdefault(row[0], []).append(row)
    for run, items in by_run.items():
        total, speeds = max(item[3] for item in items), []
        for i, (_, pos, t, size, lines) in enumerate(items):
            first = items[max(0, i - kept + 1)]
            passed = t - first[2]
            rate = math.floor((size - first[3]) / passed) if passed else None
            speeds.append(rate)
            known = [s for s in speeds[-kept:] if s is not None]
            mean = sum(known) / len(known) if known else None
            left = math.floor((total - size) / math.floor(mean)) if mean is not None and math.floor(mean) else None
            out[run, pos] = (rate, (lines - first[4]) / passed if passed else None, mean, left)
    return out


@pytest.mark.parametrize("block_rows", [100_000, 100, 17])
def test_rates_and_remaining_time(spark, block_rows):
    kept = 8
    rows = series(4)
    df = spark.createDataFrame(rows, "run string, position bigint, seconds double, bytes_done bigint, lines_done bigint")
    expected = brute(rows, kept)
    rated = progress.rolling_rate(df, kept=kept, block_rows=block_rows).collect()
    assert len(rated) == len(rows)
    for r in rated:
        rate, lines, _, _ = expected[r.run, r.position]
        assert r.bytes_per_second == rate
        assert (r.lines_per_second is None) == (lines is None) and (lines is None or r.lines_per_second == pytest.approx(lines))
    timed = progress.eta(df, progress.series_totals(df), kept=kept, block_rows=block_rows).collect()
    assert len(timed) == len(rows)
    for r in timed:
        _, _, mean, left = expected[r.run, r.position]
        assert r.seconds_left == left and (mean is None or r.avg_speed == pytest.approx(mean))


def test_blocks_shorter_than_the_look_back_are_refused(spark):
    with pytest.raises(ValueError):
        progress.in_blocks(spark.range(3), "id", halo=10, size=5)


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["r1", "r2", "", "r4"]), rng.randrange(40), i, rng.randrange(100)) for i in range(900)]
    df = spark.createDataFrame(rows, "run string, t int, id int, v bigint").repartition(7)
    df = df.withColumn("run", F.nullif("run", F.lit("")))
    out = progress.running_totals(df, "run", ["t", "id"], {"total": F.col("v"), "double": F.col("v") * 2}, "position")
    out = out.na.fill("", ["run"])
    seen = {}
    for run, _, id_, v in sorted(rows):
        total, position = seen.get(run, (0, 0, 0))[:2]
        seen[run] = (total + v, position + 1, id_)
        seen[run, id_] = (total + v, position + 1)
    assert out.count() == len(rows)
    for r in out.collect():
        assert (r.total, r.position) == seen[r.run, r.id] and r.double == 2 * r.total
