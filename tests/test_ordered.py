"""Running columns: a blocked scan with chunks of any width must equal a replay in Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from taskloom.operators import dispatch
from taskloom.operators.ordered import (
    bounded_level,
    by_number,
    by_time,
    following,
    last_seen,
    ordered_scan,
    paced,
    previous,
    row_number,
    running_level,
    running_max,
    running_sum,
    seen_before,
    sum_since,
)

KEYS, ORDER = ["g"], ["t", "i"]


def make(spark, seed: int, n: int = 400):
    rng = random.Random(seed)
    rows = [
        (
            rng.choice(["hot", "hot", "hot", "warm", "cold", None]),
            rng.choice([None, *range(-5, 40)]),
            i,
            rng.choice([-2, -1, 1, 1, 2]),
            rng.choice([None, "a", "b", "c"]),
        )
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "g STRING, t INT, i INT, x INT, v STRING").repartition(5)


def groups(rows):
    for g in {r[0] for r in rows}:
        yield g, sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))


def replay(rows):
    expected = {}
    for _, group in groups(rows):
        total, level, top, last, since, pace = 0, 0, None, None, 0, None
        for n, (_, t, i, x, v) in enumerate(group):
            seen = last
            total += x
            level = max(0, level + x)
            top = x if top is None else max(top, x)
            last = v if v is not None else last
            since = 0 if v == "a" else since + x
            due = (t or 0) - (n + 1) * 3
            pace = due if pace is None else max(pace, due)
            before = group[n - 1][4] if n else None
            after = group[n + 1][4] if n + 1 < len(group) else None
            expected[i] = (n + 1, total, level, top, last, seen, before, after, since, n + 1, pace)
    return expected


@pytest.mark.parametrize("width", [1, 2, 7, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_running_columns(spark, seed, width):
    rows, df = make(spark, seed)
    x, v = F.col("x"), F.col("v")
    names = ["n", "total", "level", "top", "last", "seen", "before", "after", "since", "place", "pace"]
    measures = [
        row_number("n"), running_sum("total", x), running_level("level", x), running_max("top", x),
        last_seen("last", v, ORDER), seen_before("seen", v, ORDER), previous("before", v, ORDER), following("after", v, ORDER),
        sum_since("since", x, F.coalesce(v == "a", F.lit(False)), ORDER), paced("place", "pace", F.coalesce("t", F.lit(0)), 3),
    ]
    out = ordered_scan(df, KEYS, ORDER, by_number("t", width), measures)
    assert set(out.columns) == {*df.columns, *names}
    assert {r.i: tuple(r[n] for n in names) for r in out.collect()} == replay(rows)


def test_an_empty_table(spark):
    _, df = make(spark, 1)
    none = df.limit(0)
    assert ordered_scan(none, KEYS, ORDER, by_number("t"), [row_number("n")]).count() == 0
    assert bounded_level(none, KEYS, ORDER, by_number("t"), F.col("x"), F.lit(0), "level", 0, 5).count() == 0


@pytest.mark.parametrize("width", [1, 5, 1000])
@pytest.mark.parametrize("lo,hi,start", [(0, 3, 0), (0, 3, 2), (-2, 2, -2), (0, 0, 0)])
def test_levels_between_two_bounds(spark, width, lo, hi, start):
    rows, df = make(spark, 5)
    out = bounded_level(df, KEYS, ORDER, by_number("t", width), F.col("x"), F.lit(start), "level", lo, hi)
    expected = {}
    for _, group in groups(rows):
        level = start
        for _, _, i, x, _ in group:
            before, level = level, min(hi, max(lo, level + x))
            expected[i] = before, level
    assert set(out.columns) == {*df.columns, "level", "level_before"}
    assert {r.i: (r.level_before, r.level) for r in out.collect()} == expected


@pytest.mark.parametrize("chunk_s", [1, 20, 86400])
def test_admission_while_tasks_leave(spark, chunk_s):
    rng = random.Random(chunk_s)
    rows = [(i, rng.choice("pq"), rng.choice(["submitted", "submitted", "started", "completed"]), rng.randrange(200)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id INT, queue_name STRING, kind STRING, s INT")
    df = df.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)")))
    got = {r.event_id: (r.accepted, r.depth) for r in dispatch.admission_log(df, 4, chunk_s=chunk_s).collect()}
    expected = {}
    for q in "pq":
        held = 0
        for i, _, kind, s in sorted((r for r in rows if r[1] == q and r[2] != "completed"), key=lambda r: (r[3], r[0])):
            accepted = held < 4 if kind == "submitted" else None
            held = held + 1 if accepted else held if kind == "submitted" else max(0, held - 1)
            expected[i] = accepted, held
    assert got == expected and {a for a, _ in got.values()} == {True, False, None}


def test_no_job_is_run_to_build_a_scan(spark):
    _, df = make(spark, 3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("built", "")
    try:
        out = ordered_scan(df, KEYS, ORDER, by_number("t", 2), [row_number("n"), running_level("level", F.col("x"))])
        bounded_level(out, KEYS, ORDER, by_number("t", 2), F.col("x"), F.lit(0), "held", 0, 5)
        assert not tracker.getJobIdsForGroup("built")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_chunks_by_time(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 00:59:59.999999'), (TIMESTAMP_NTZ'2024-01-01 01:00:00'), (NULL) AS t(ts)")
    hours = sorted((r[0] for r in df.select(*by_time("ts")).collect()), key=lambda x: x or 0)
    assert hours[0] is None and hours[2] - hours[1] == 1
