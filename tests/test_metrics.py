"""Percentiles, windows, health thresholds and display text against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from taskloom.functions.text import fixed, format_duration, format_number, shorten
from taskloom.operators import health, metrics, ranks, rolling
from taskloom.plans import snapshot


def rank_rule(values):
    ordered, n = sorted(values), len(values)
    return tuple(ordered[int(n * p)] for p in (0.5, 0.95, 0.99))


@pytest.mark.parametrize("n", [1, 2, 4, 19, 20, 21, 100, 101])
def test_percentile_ranks(spark, n):
    df = spark.range(n).select(F.col("id").cast("double").alias("v"), F.lit("k").alias("k"))
    row = metrics.metric_summary(df, ["k"], F.col("v")).first()
    assert (row.p50, row.p95, row.p99) == rank_rule(range(n))
    assert (row["count"], row["sum"], row["min"], row["max"]) == (n, sum(range(n)), 0, n - 1)


def test_percentiles_with_repeats_and_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), float(rng.randrange(60))) for _ in range(1000)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    for r in metrics.metric_summary(df, ["k"], F.col("v")).collect():
        assert (r.p50, r.p95, r.p99) == rank_rule([v for k, v in rows if k == r.k])
    whole = metrics.metric_summary(df, [], F.col("v")).first()
    assert (whole.p50, whole.p95, whole.p99) == rank_rule([v for _, v in rows])


def test_ranks_of_any_double(spark):
    """Signs, zeros of both signs, subnormal and infinite values, NaN, ties, null keys and null values."""
    inf = float("inf")
    odd = [0.0, -0.0, -1.5, 1.5, 5e-324, -5e-324, 1e308, -1e308, inf, -inf, 2.0**-1074 * 3, 1 / 3, -1 / 3, 1e-300]
    rng = random.Random(8)
    rows = [("k", v) for v in odd * 3] + [(None, rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-30, 30)) for _ in range(500)]
    df = spark.createDataFrame(rows + [("k", None), ("none", None)], "k STRING, v DOUBLE").repartition(3)
    found = {r.k: (r.p50, r.p95, r.p99) for r in metrics.metric_summary(df, ["k"], F.col("v")).collect()}
    assert found == {k: rank_rule([v for g, v in rows if g == k]) for k in ("k", None)}
    order = spark.createDataFrame([(v,) for v in [*odd, float("nan")]], "v DOUBLE").select("v", ranks.sortable_bits(F.col("v")).alias("b"))
    got = [r.v for r in order.orderBy("b", "v").collect()]
    assert [x for x in got if x == x] == sorted(odd) and got[-1] != got[-1]


def test_ranks_without_a_window_over_values(spark):
    """Every window of the plan runs over digits; nothing is run while the query is built."""
    df = spark.range(200_000).select(F.lit("k").alias("k"), (F.col("id") / 7).alias("v"))
    summary = metrics.metric_summary(df, ["k"], F.col("v"))
    row = summary.first()
    assert (row.p50, row.p95, row.p99) == rank_rule([i / 7 for i in range(200_000)])
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert all("sum(_c" in line for line in plan.splitlines() if "Window" in line)


def test_no_samples_give_no_row(spark):
    df = spark.createDataFrame([("a", -1.0)], "k STRING, v DOUBLE")
    assert metrics.metric_summary(df, ["k"], metrics.positive(F.col("v"))).count() == 0


@pytest.mark.parametrize("window_s", [2, 5, 60])
def test_rolling_window_against_brute_force(spark, window_s):
    rng = random.Random(window_s)
    rows = sorted({(rng.choice("pq"), rng.randrange(0, 90_000_000, 250_000)) for _ in range(300)})
    rows = [(q, us, float(rng.randrange(1, 50))) for q, us in rows] + [("p", 10_000_000, 3.0), ("p", 10_000_000, 4.0)]
    base = 1_700_000_000_000_000
    df = spark.createDataFrame([(q, base + us, v) for q, us, v in rows], "q STRING, us LONG, v DOUBLE")
    df = df.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))
    out = rolling.rolling_summary(df, ["q"], F.col("v"), window_s=window_s)
    out = out.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")) - base).collect()
    assert len(out) == len({(q, us) for q, us, _ in rows})
    for r in out:
        inside = [v for q, us, v in rows if q == r.q and r.us - window_s * 1_000_000 <= us <= r.us]
        assert (r["count"], r["sum"], r["min"], r["max"]) == (len(inside), sum(inside), min(inside), max(inside))


def test_rolling_rate_uses_the_uptime_at_first(spark):
    df = spark.createDataFrame([("q", s) for s in (10, 20, 100)], "q STRING, s LONG")
    df = df.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    out = rolling.rolling_rate(df, ["q"], "1970-01-01 00:00:00").orderBy("ts").collect()
    assert [r.rate for r in out] == [1 / 10, 2 / 20, 1 / 60]


def test_histogram_is_cumulative(spark):
    values = [0.001, 0.005, 0.3, 10.0, 75.0, -1.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    rows = {r.le: r for r in metrics.latency_histogram(df, {"x": F.col("v")}).collect()}
    assert (rows["0.005"].cumulative, rows["0.25"].cumulative, rows["0.5"].cumulative) == (2, 2, 3)
    assert (rows["10"].cumulative, rows["60"].cumulative, rows["+Inf"].cumulative) == (4, 4, 5)
    assert rows["+Inf"]["count"] == 5 and len(rows) == 14


@pytest.mark.parametrize("depth,rate,workers,p95,status,checks", [
    (999, 95.0, 1, 9.9, "healthy", ("ok", "ok", "ok", "ok")),
    (1000, 95.0, 1, 10.0, "healthy", ("warning", "ok", "ok", "warning")),
    (1001, 95.0, 1, 10.1, "unhealthy", ("warning", "ok", "ok", "warning")),
    (0, 94.9, 0, None, "unhealthy", ("ok", "warning", "ok", "ok")),
    (1, 100.0, 0, None, "unhealthy", ("ok", "ok", "critical", "ok")),
    (0, 100.0, 0, 99.0, "healthy", ("ok", "ok", "ok", "warning")),
])
def test_health_thresholds(spark, depth, rate, workers, p95, status, checks):
    df = spark.createDataFrame([(depth, rate, workers, p95)], "queue_depth LONG, success_rate DOUBLE, active_workers LONG, p95 DOUBLE")
    row = health.health_status(df).first()
    assert row.status == status
    assert tuple(row[f"check_{c}"] for c in health.CHECKS) == checks
    expected = []
    if depth > 1000:
        expected.append(f"High queue depth: {depth}")
    if rate < 95:
        expected.append(f"Low success rate: {rate:.1f}%")
    if workers == 0 and depth > 0:
        expected.append("No active workers with pending tasks")
    if p95 is not None and p95 > 10:
        expected.append(f"High p95 processing time: {p95:.2f}s")
    assert row.warnings == "; ".join(expected)
    titles = [r.title for r in health.check_titles(health.health_status(df), []).collect()]
    assert titles == ["Queue Depth", "Success Rate", "Workers", "Processing Time"]


def test_success_rate_without_tasks(spark):
    row = spark.range(1).select(metrics.success_rate(F.lit(0), F.lit(0)).alias("a"), metrics.success_rate(F.lit(1), F.lit(3)).alias("b")).first()
    assert (row.a, row.b) == (100.0, 25.0)


@pytest.mark.parametrize("decimals", [0, 1, 2, 4, 6])
def test_fixed_rounds_like_the_exact_value(spark, decimals):
    rng = random.Random(decimals)
    values = [0.125, 0.375, 2.675, 1.005, 0.5, 1.5, 2.5, 0.0, 12.25, 12.35, -0.125, -2.675, -0.001, 1e-9, 1e12 + 0.5]
    values += [rng.randrange(10**7) / 1000 for _ in range(300)] + [rng.uniform(-1e4, 1e4) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for r in df.select("v", fixed(F.col("v"), decimals).alias("t")).collect():
        assert r.t == f"{r.v:.{decimals}f}", r.v


def test_display_text(spark):
    def number(x):
        return f"{x:.2f}" if x < 1000 else f"{x / 1000:.1f}K" if x < 1e6 else f"{x / 1e6:.1f}M"

    def duration(s):
        if s < 1:
            return f"{s * 1000:.0f}ms"
        return f"{s:.1f}s" if s < 60 else f"{s / 60:.1f}m" if s < 3600 else f"{s / 3600:.1f}h"

    values = [0.0, 0.0005, 0.9994, 0.9996, 1.0, 59.94, 59.96, 60.0, 999.994, 999.996, 1000.0, 3599.0, 3600.0, 12250.0, 999999.0, 1e6, 2.55e6]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for r in df.select("v", format_number(F.col("v")).alias("n"), format_duration(F.col("v")).alias("d")).collect():
        assert (r.n, r.d) == (number(r.v), duration(r.v))
    row = spark.range(1).select(shorten(F.lit("x" * 61), 60).alias("a"), shorten(F.lit("x" * 60), 60).alias("b")).first()
    assert (row.a, row.b) == ("x" * 60 + "...", "x" * 60)


def test_recent_errors_keep_and_cut(spark):
    df = spark.range(150).select(F.lit("q").alias("q"), F.col("id").alias("at"), F.repeat(F.lit("e"), 600).alias("error"))
    rows = metrics.recent_errors(df, ["q"], ["at"]).collect()
    assert len(rows) == 100 and min(r["at"] for r in rows) == 50
    assert {len(r.error) for r in rows} == {500} and {len(r.shown) for r in rows} == {63}


def test_exposition_without_samples_has_no_summary(spark):
    ts = F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")
    events = spark.createDataFrame([(1, "q", "submitted", 0.0)], "event_id LONG, queue_name STRING, kind STRING, processing_s DOUBLE").withColumn("ts", ts)
    workers = spark.createDataFrame([("w", True)], "worker_id STRING, running BOOLEAN")
    row = snapshot.metrics_row(events, workers, "2024-01-01 00:10:00", "2024-01-01 00:00:00")
    lines = [r.line for r in snapshot.exposition_lines(row).orderBy("line_no").collect()]
    assert len(lines) == 18
    assert lines[2] == "tasks_submitted_total 1" and lines[11] == "queue_depth 1" and lines[17] == "throughput_rate 0.0000"
