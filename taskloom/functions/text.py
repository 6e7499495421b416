"""Display text. Fixed-point rounding follows the exact binary value, ties to even."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, decimals: int) -> Column:
    """``x`` with ``decimals`` places. The JVM formatter rounds the shortest decimal text half up instead.

    The fraction times 10^d is split into its double value and its exact rounding error, which decides
    the cases where the product lands on a tie. The digits come from a whole number; only values beyond
    2^63 / 10^d are left to the JVM formatter.
    """
    x = x.cast("double")
    if decimals == 0:
        return F.format_string("%.0f", F.rint(x))
    scale = 10**decimals
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole
    product = part * float(scale)
    below = F.floor(product)
    split = F.lit(134217729.0) * part
    high = split - (split - part)
    error = (high * float(scale) - product) + (part - high) * float(scale)
    on_tie = below + F.when(error > 0, 1).when(error < 0, 0).otherwise(below % 2)
    rounded = F.when(product - below == 0.5, on_tie).otherwise(F.rint(product).cast("long"))
    digits = (whole * scale + rounded).cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-decimals))
    exact = F.concat(F.when(x < 0, "-").otherwise(""), digits.cast(f"decimal(25,{decimals})").cast("string"))
    return F.when(size < 9.0e18 / scale, exact).otherwise(F.format_string(f"%.{decimals}f", x))


def format_number(x: Column, decimals: int = 2) -> Column:
    """Plain below a thousand, then K and M with one place."""
    x = x.cast("double")
    return (
        F.when(x < 1000, fixed(x, decimals))
        .when(x < 1_000_000, F.concat(fixed(x / 1000, 1), F.lit("K")))
        .when(x >= 1_000_000, F.concat(fixed(x / 1_000_000, 1), F.lit("M")))
    )


def format_duration(secs: Column) -> Column:
    secs = secs.cast("double")
    return (
        F.when(secs < 1, F.concat(fixed(secs * 1000, 0), F.lit("ms")))
        .when(secs < 60, F.concat(fixed(secs, 1), F.lit("s")))
        .when(secs < 3600, F.concat(fixed(secs / 60, 1), F.lit("m")))
        .otherwise(F.concat(fixed(secs / 3600, 1), F.lit("h")))
    )


def title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def shorten(message: Column, limit: int) -> Column:
    """Cut to ``limit`` characters and mark the cut."""
    return F.when(F.length(message) > limit, F.concat(F.substring(message, 1, limit), F.lit("..."))).otherwise(
        message
    )
