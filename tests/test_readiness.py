"""The readiness gate over several batches: growing, changed, broken and never-ending files; depth by source of the count."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lamella.streaming import jobs, state
from lamella.streaming.sources import replayed

START = dt.datetime(2024, 1, 1)


def looks(spark, rows):
    """(path, second, size, structure, size after the check)."""
    data = [(p, START + dt.timedelta(seconds=s), n, s, 0, ok, after, 0) for p, s, n, ok, after in rows]
    return spark.createDataFrame(data, "path string, ts timestamp, size long, mtime long, zero long, structure boolean, size_after long, mtime_after long").withColumn("mtime", F.lit(0).cast("long"))


def outcomes(spark, rows, batches):
    stream = replayed(looks(spark, rows), "ts", batches)
    out = jobs.drain(state.readiness(stream, "ts", 1000, 60_000, "1 second")).collect()
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    return sorted((r.path, (r.at - base) // 1000, r.outcome, r.size) for r in out)


@pytest.mark.parametrize("batches", [1, 4])
def test_gate(spark, batches):
    rows = [("growing", s, min(s, 5), True, min(s, 5)) for s in range(1, 12)]  # grows to second 5, is quiet after
    rows += [("whole", s, 9, True, 9) for s in range(1, 5)]
    rows += [("broken", s, 9, False, 9) for s in range(1, 5)] + [("broken", s, 9, True, 9) for s in (8, 9)]
    rows += [("moved", 1, 9, True, 9), ("moved", 3, 9, True, 10), ("moved", 4, 10, True, 10), ("moved", 6, 10, True, 10)]  # written to during the check
    rows += [("endless", s, s, True, s) for s in range(1, 100)]
    rows += [("silent", 2, 9, False, 9)]  # no look ends its turn but the timer
    rows += [("again", s, 9, True, 9) for s in (1, 2, 3)] + [("again", s, 11, True, 11) for s in (20, 21, 22)]
    rows += [("gone", 1, 9, True, 9), ("gone", 2, -1, False, -1), ("gone", 5, 4, True, 4), ("gone", 6, 4, True, 4)]
    rows += [("clock", s, 0, True, 0) for s in (150, 200)]
    got = outcomes(spark, rows, batches)
    assert got == sorted([
        ("growing", 6, "READY", 5), ("whole", 2, "READY", 9), ("broken", 8, "READY", 9), ("moved", 4, "READY", 10), ("endless", 61, "TIMEOUT", 61), ("endless", 122, "TIMEOUT", 99), ("silent", 62, "TIMEOUT", 9),
        ("again", 2, "READY", 9), ("again", 21, "READY", 11), ("gone", 2, "GONE", 9), ("gone", 6, "READY", 4), ("clock", 200, "READY", 0),
    ])


def test_depth_by_the_source_of_the_count(spark):
    assert state.next_state((5, 1, "PENDING"), 5, 1, 12, 10, from_folder=True)[0] == "DEPTH_UNVERIFIED"
    assert state.next_state((5, 1, "PENDING"), 5, 1, 12, 10)[0] == "FAILED"
    assert state.next_state((5, 1, "PENDING"), 5, 1, 8, 10, from_folder=True) == ("INCOMPLETE", "8 of 10 planes")
    df = spark.createDataFrame([(12, 10, True), (12, 10, False), (12, 10, None), (8, 10, True), (10, 10, True), (7, None, False)], "planes int, expected int, folder boolean")
    got = [r[0] for r in df.select(state.depth_state(F.col("planes"), F.col("expected"), F.col("folder"))).collect()]
    assert got == ["DEPTH_UNVERIFIED", "FAILED", "FAILED", "INCOMPLETE", "COMPLETE", "DEPTH_UNVERIFIED"]


def test_reasons_of_a_check():
    assert state.checked(10, 10, changed=True, problem="x") == ("INCOMPLETE", "changed while it was checked")
    assert state.checked(None, 10, problem="two times in its name") == ("FAILED", "two times in its name")
    assert state.checked(None, 10, unsupported="tiles")[0] == "INCOMPLETE"
    assert state.checked(10, 10, unsupported="tiles") == ("FAILED", "unsupported layout: tiles")


def test_states_over_batches_equal_states_in_one(spark):
    rows = [("a", k, (0, 5, 5, 5, 7, 7, -1, 7, 7)[k], 0, 10, 10, (0, 5, 6, 5, 7, 7, -1, 7, 7)[k]) for k in range(9)]
    df = spark.createDataFrame(rows, "path string, seq long, size long, mtime long, planes int, expected int, size_after long")
    one, many = (sorted(map(tuple, jobs.drain(state.file_states(replayed(df, "seq", n)), "update").collect()), key=lambda r: r[1]) for n in (1, 5))
    assert one == many
    assert [(s, x) for _, s, x, _ in one] == [(0, "PENDING"), (2, "INCOMPLETE"), (3, "PENDING"), (5, "COMPLETE"), (6, "REMOVED"), (7, "PENDING"), (8, "COMPLETE")]


@pytest.mark.parametrize("batches", [1, 4])
def test_a_removed_file_is_told_once_over_batches(spark, batches):
    """Looks at nothing go on in the next batch; what comes back begins anew."""
    rows = [(k, "a", size, 0, 9, 9) for k, size in enumerate([5, 5, -1, -1, -1, -1, 5, 5])]
    df = spark.createDataFrame(rows, "seq long, path string, size long, mtime long, planes int, expected int")
    got = jobs.drain(state.file_states(replayed(df, "seq", batches)), "update").collect()
    assert sorted((r.seq, r.state) for r in got) == [(0, "PENDING"), (1, "COMPLETE"), (2, "REMOVED"), (6, "PENDING"), (7, "COMPLETE")]
