"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df to be broadcast if it has at most that many rows; otherwise df itself, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
