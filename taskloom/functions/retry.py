"""Retry arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskloom.schema import BACKOFF_BASE


def backoff_seconds(failures: Column, base: float = BACKOFF_BASE) -> Column:
    """Wait before the next attempt after that many failures; no cap."""
    return F.pow(F.lit(float(base)), failures)


def is_dead(failures: Column, max_retries: Column) -> Column:
    """The count includes the failure at hand, so 0 and 1 both die at the first one."""
    return failures >= max_retries
