"""Time arithmetic that works on TIMESTAMP and TIMESTAMP_NTZ columns alike (UTC session)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def instant(df: DataFrame, column: str, as_of: str) -> Column:
    """``as_of`` as a literal of the column's own type, so that comparisons reach the scan without a cast."""
    ntz = isinstance(df.schema[column].dataType, T.TimestampNTZType)
    return F.lit(as_of).cast("timestamp_ntz" if ntz else "timestamp")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    """Epoch seconds as double."""
    return micros(ts) / F.lit(1e6)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def plus_seconds(ts: Column, secs: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def iso_text(ts: Column) -> Column:
    """ISO-8601 text; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros(ts) % 1_000_000 == 0, whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")
