import random

import pytest
from pyspark.sql import functions as F

from civicspark.operators import files as W

START = 1_700_000_000


def _frame(spark, events):
    """``events``: (path, seconds, number)."""
    return spark.createDataFrame(events, "path string, second double, number long").withColumn(
        "ts", F.timestamp_micros(((F.col("second") + START) * 1_000_000).cast("long"))
    )


def _greedy(events, seconds):
    last, taken = {}, []
    for path, second, number in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if path not in last or second - last[path] >= seconds:
            last[path] = second
            taken.append((path, number))
    return sorted(taken, key=repr)


def test_cooldown_counts_from_the_last_accepted(spark, rows_of):
    events = [("a", s, i) for i, s in enumerate([0.0, 200.0, 300.0, 590.0, 600.0])]
    accepted = W.cooldown(_frame(spark, events), tie="number")
    assert rows_of(accepted, "path", "number") == [("a", 0), ("a", 2), ("a", 4)]
    assert accepted.columns == ["path", "ts", "number"]
    assert W.cooldown(_frame(spark, events)).count() == 3


@pytest.mark.parametrize("block", [100, 301, 1000, 86_400])
@pytest.mark.parametrize("seed", [1, 2])
def test_cooldown_equals_the_sequential_rule(spark, rows_of, block, seed):
    chance = random.Random(seed)
    events = []
    for number in range(4000):
        # One path holds a third of all events and is never quiet for long.
        path = "hot" if number % 3 == 0 else f"p{chance.randint(0, 60)}"
        events.append((path, float(chance.randint(0, 40_000)), number))
    accepted = W.cooldown(_frame(spark, events), seconds=300, tie="number", block_seconds=block)
    assert rows_of(accepted, "path", "number") == _greedy(events, 300)


def test_cooldown_runs_cross_arrow_batches(spark, rows_of):
    events = [("hot", i * 0.5, i) for i in range(6000)] + [("cold", 10.0, -1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        accepted = rows_of(W.cooldown(_frame(spark, events), tie="number", block_seconds=1000), "path", "number")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert accepted == _greedy(events, 300)


def test_cooldown_needs_a_duration(spark):
    with pytest.raises(ValueError):
        W.cooldown(_frame(spark, [("a", 0.0, 1)]), seconds=0)


@pytest.mark.parametrize("block", [50, 100_000])
def test_stable_files(spark, rows_of, block):
    chance = random.Random(5)
    looks = [(chance.choice("ab"), float(i * 7), i, chance.choice(["x", "y", None])) for i in range(300)]
    frame = spark.createDataFrame(looks, "path string, second double, number long, sha256 string").withColumn(
        "ts", F.timestamp_seconds(F.col("second") + START)
    )
    before, expected = {}, []
    for path, _, number, sha in looks:
        if path in before and before[path] == sha:
            expected.append((number,))
        before[path] = sha
    assert rows_of(W.stable_files(frame, block), "number") == sorted(expected, key=repr)


def test_stale_files(spark, rows_of):
    old, new = "Sat, 01 Jan 2022 00:00:00 GMT", "Mon, 03 Jan 2022 00:00:00 GMT"
    listing = spark.createDataFrame([
        ("absent", new), ("absent-undated", None), ("same-hash", new), ("changed-newer", new), ("changed-older", old),
        ("changed-undated", None), ("unknown-newer", new), ("unknown-equal", "Sun, 02 Jan 2022 00:00:00 GMT"),
    ], "url string, last_modified string")
    mtime = "2022-01-02 00:00:00"
    manifest = spark.createDataFrame([
        ("same-hash", "h", "h", mtime), ("changed-newer", "h", "g", mtime), ("changed-older", "h", "g", mtime),
        ("changed-undated", "h", "g", mtime), ("unknown-newer", "h", None, mtime), ("unknown-equal", "h", None, mtime),
    ], "url string, sha256 string, stored_sha256 string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    assert rows_of(W.stale_files(listing, manifest), "url", "reason") == [
        ("absent", "absent"), ("absent-undated", "absent"), ("changed-newer", "newer"), ("unknown-newer", "newer"),
    ]
    assert W.stale_files(listing, manifest, force=True).count() == 8


def test_changed_files(spark, rows_of):
    listing = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2024-01-01'), ('b', TIMESTAMP'2024-01-02'), "
                        "('c', TIMESTAMP'2024-01-01') AS t(path, modificationTime)")
    log = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2024-01-01'), ('b', TIMESTAMP'2024-01-01') "
                    "AS t(path, modificationTime)")
    assert rows_of(W.changed_files(listing, log), "path") == [("b",), ("c",)]
