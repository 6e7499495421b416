"""Exact order statistics of groups of any size, by radix selection.

A double's bits, with those of negative numbers turned round, order like the double. Each pass counts the values of every group by the next
bits of those it has narrowed to, finds for each wanted rank the digit where the running count reaches it, and keeps that digit's values.
After the last pass one value is left per rank. All groups and ranks go through a pass together. A pass's table has at most
2 ** 22 narrow rows per group and rank, whatever the number of values, so no task runs over a group's distinct values. Count, sum and extremes
come out of the first pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits that a pass looks at.
DIGITS = (22, 21, 21)
GROUP = "_group"
TOTALS = ["n", "sum", "min", "max"]


def sortable_bits(value: Column) -> Column:
    """A long that orders like the double; -0.0 counts as 0.0, and NaN is the largest."""
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def ranked_values(counted: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """For ``counted`` with GROUP, ``v`` (double) and ``c`` (how often): per group n, sum, min, max and a column per rank, the value of that rank.

    A rank is a column over ``n``, the group's number of values, from 1 up to it."""
    values = counted.withColumn("_bits", sortable_bits(F.col("v")))
    shift, wanted = 64, None
    for width in DIGITS:
        digit = F.shiftright("_bits", shift - width).alias("_digit")
        if wanted is None:
            place, rows = Window.partitionBy(GROUP), values.groupBy(GROUP, digit)
            parts = {"sum": F.sum(F.col("v") * F.col("c")), "min": F.min("v"), "max": F.max("v")}
        else:
            held = wanted.select(F.col(GROUP).alias("_g"), "_rank", "_left", F.col("_digit").alias("_prefix"), *TOTALS)
            inside = values.join(held, (F.col(GROUP) == F.col("_g")) & (F.shiftright("_bits", shift) == F.col("_prefix")))
            place, rows = Window.partitionBy(GROUP, "_rank"), inside.groupBy(GROUP, "_rank", digit)
            parts = {c: F.first(c) for c in ["_left", *TOTALS]}
        tallies = rows.agg(F.sum("c").alias("_c"), F.min("v").alias("v"), *[e.alias(c) for c, e in parts.items()])
        running = place.orderBy("_digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        tallies = tallies.withColumn("_upto", F.sum("_c").over(running))
        if wanted is None:
            whole = {"n": F.sum("_c"), "sum": F.sum("sum"), "min": F.min("min"), "max": F.max("max")}
            tallies = tallies.withColumns({c: e.over(place) for c, e in whole.items()})
            each = F.explode(F.array(*[F.struct(F.lit(name).alias("_rank"), rank.alias("_left")) for name, rank in ranks.items()]))
            tallies = tallies.withColumn("_x", each).select("*", "_x.*").drop("_x")
        before = F.col("_upto") - F.col("_c")
        wanted = tallies.where((before < F.col("_left")) & (F.col("_left") <= F.col("_upto")))
        wanted = wanted.select(GROUP, "_rank", (F.col("_left") - before).alias("_left"), "_digit", "v", *TOTALS)
        shift -= width
    picks = [F.max(F.when(F.col("_rank") == name, F.col("v"))).alias(name) for name in ranks]
    return wanted.groupBy(GROUP).agg(*[F.first(c).alias(c) for c in TOTALS], *picks)
