"""Numbering rows in order without sending them all to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: str, name: str = "nth", parts: int | None = None) -> DataFrame:
    """df with name: the rank from 1 by a numeric column, rows of one value in any order.

    Approximate quantiles, literals of the plan once found, cut the rows into ranges; each range is ranked on its own and begins after the
    count of those before it. Nulls come first.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [n / parts for n in range(1, parts)]
    cuts = sorted(set(df.agg(F.percentile_approx(order, shares or [0.5], 10_000)).first()[0] or []))
    place = sum((F.when(F.col(order) > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    rows = df.withColumn("_range", place)
    counts = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}
    before = [0, *accumulate(counts.get(n, 0) for n in range(len(cuts)))]
    start = F.get(F.array(*(F.lit(n) for n in before)), F.col("_range"))
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy("_range").orderBy(order)) + start).cast("long")).drop("_range")
