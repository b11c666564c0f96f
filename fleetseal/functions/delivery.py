"""Retry timing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def backoff_seconds(attempt: Column) -> Column:
    """1, 2, 4 ... 256 seconds: doubling up to eight times, never above 300."""
    exponent = F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(8)).cast("int")
    return F.least(F.lit(300), F.call_function("shiftleft", F.lit(1), exponent))
