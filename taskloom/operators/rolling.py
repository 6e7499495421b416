"""Trailing-window statistics at every point of a log.

A RANGE frame re-reads its whole frame for each row and needs a whole queue in one task. Here time is cut
into granules. The window (t - W, inclusive, to t) is the end of one granule, whole granules, and the start
of another one, so each piece is a running or a short-frame aggregate in a small group:
(queue, granule) holds at most one row per distinct microsecond, (queue, bucket) at most two windows of granules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.times import from_micros, micros
from taskloom.schema import METRIC_WINDOW_S, RATE_WINDOW_S

# Granules per window: few keep the frames over whole granules short, many keep the groups small.
GRANULES = 10
MERGE = {"n": F.sum, "total": F.sum, "low": F.min, "high": F.max}


def _merged(over=None) -> list[Column]:
    return [(f(n) if over is None else f(n).over(over)).alias(f"m_{n}") for n, f in MERGE.items()]


def _plain(prefix: str = "m_") -> list[Column]:
    return [F.col(f"{prefix}{n}").alias(n) for n in MERGE]


def rolling_summary(
    points: DataFrame,
    keys: list[str],
    value: Column,
    ts: str = "ts",
    window_s: int = METRIC_WINDOW_S,
    granules: int = GRANULES,
) -> DataFrame:
    """Count, sum, min, max and average over the trailing window, one row per key and distinct time."""
    width = window_s * 1_000_000
    if granules < 2 or width % granules:
        raise ValueError("the window must hold at least two whole granules")
    granule_us = width // granules
    us, grain = F.col("us"), F.col("us") - F.pmod("us", F.lit(granule_us))
    base = (
        points.select(*keys, micros(F.col(ts)).alias("us"), value.cast("double").alias("v"))
        .groupBy(*keys, "us")
        .agg(
            F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        .withColumn("grain", grain)
    )
    # Each point also asks, one window earlier, for what lies behind it in that granule.
    own = F.struct(F.lit(0).alias("probe"), "us", "grain", *MERGE)
    probe = F.struct(
        F.lit(1).alias("probe"),
        (us - width).alias("us"),
        (F.col("grain") - width).alias("grain"),
        *[F.lit(None).cast("long" if n == "n" else "double").alias(n) for n in MERGE],
    )
    both = base.select(*keys, F.inline(F.array(own, probe)))
    group = Window.partitionBy(*keys, "grain")
    running = (Window.unboundedPreceding, Window.currentRow)
    since = group.orderBy(us, "probe").rowsBetween(*running)
    until = group.orderBy(us.desc(), "probe").rowsBetween(*running)
    is_probe = F.col("probe") == 1
    edges = both.select(
        *keys,
        (F.col("grain") + F.when(is_probe, width).otherwise(0)).alias("grain"),
        (us + F.when(is_probe, width).otherwise(0)).alias("us"),
        *[F.when(is_probe, f(n).over(until)).otherwise(f(n).over(since)).alias(n) for n, f in MERGE.items()],
    )
    # Whole granules in between; every granule is seen by its own bucket and by the next one.
    grains = base.groupBy(*keys, "grain").agg(*_merged()).select(*keys, "grain", *_plain())
    first = ((F.col("grain") - F.pmod("grain", F.lit(width))) / width).cast("long")
    shared = grains.withColumn("own", first).withColumn(
        "bucket", F.explode(F.array(F.col("own"), F.col("own") + 1))
    )
    inner = (
        Window.partitionBy(*keys, "bucket").orderBy("grain").rangeBetween(-(width - granule_us), -granule_us)
    )
    middle = shared.select(*keys, "grain", "own", "bucket", *_merged(inner)).filter("own = bucket")
    # Both kinds of rows meet by granule in one exchange, which the final grouping reuses.
    everything = edges.unionByName(middle.drop("own", "bucket"), allowMissingColumns=True)
    by_grain = Window.partitionBy(*keys, "grain")
    spread = everything.withColumns({f"m_{n}": F.max(f"m_{n}").over(by_grain) for n in MERGE})
    joined = (
        spread.filter(us.isNotNull())
        .groupBy(*keys, "grain", "us")
        .agg(*[f(n).alias(n) for n, f in MERGE.items()], *[F.max(f"m_{n}").alias(f"m_{n}") for n in MERGE])
    )
    count = F.col("n") + F.coalesce("m_n", F.lit(0))
    total = F.coalesce(F.col("total") + F.col("m_total"), F.col("total"), F.col("m_total"))
    return joined.select(
        *keys,
        from_micros(us).alias(ts),
        count.alias("count"),
        total.alias("sum"),
        F.least("low", "m_low").alias("min"),
        F.greatest("high", "m_high").alias("max"),
        (total / F.nullif(count, F.lit(0))).alias("avg"),
    )


def rolling_rate(
    points: DataFrame, keys: list[str], started_at: str, ts: str = "ts", window_s: int = RATE_WINDOW_S
) -> DataFrame:
    """Events per second over the trailing window, or over the uptime while that is shorter."""
    uptime = (micros(F.col(ts)) - micros(F.lit(started_at).cast("timestamp"))) / F.lit(1e6)
    seconds = F.least(F.lit(float(window_s)), uptime)
    counted = rolling_summary(points, keys, F.lit(1), ts, window_s)
    return counted.select(
        *keys, ts, "count", F.coalesce(F.try_divide("count", seconds), F.lit(0.0)).alias("rate")
    )
