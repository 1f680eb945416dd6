"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are cut into pieces of at most ``capacity`` characters. Longest pieces go first.
Bins stand in order of their residual, and each carries two bitmaps: the sources and the
duplicate clusters it holds. From the tightest residual that fits, the search walks on to
the next larger one until neither bitmap conflicts; a piece that fits nowhere opens a bin.

The choice is inherently sequential, so documents are dealt by a hash of their id to groups of
about ``group_rows``; each is packed on its own and the number of groups grows with the rows. A hot
source or cluster is thereby spread over all groups.

Edge cases: a null text is empty and takes a place of length 0; a null source or cluster never
conflicts; a full piece fills a bin alone; ties go by id, then by order of text; repeated rows are
packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

CAPACITY, GROUP_ROWS = 8192, 4096


class Bins:
    """Residual-ordered bins with source and cluster bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) for a piece; source and cluster are bitmaps of one bit, or 0."""
        order, sources, clusters = self.order, self.sources, self.clusters
        for at in range(bisect_left(order, (length, -1)), len(order)):
            residual, n = order[at]
            if not (sources[n] & source or clusters[n] & cluster):
                del order[at]
                break
        else:
            residual, n = self.capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[n] |= source
        clusters[n] |= cluster
        if residual > length:
            insort(order, (residual - length, n))
        return n, self.capacity - residual


def pack(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(row, piece, start, length, bin, offset) of every piece, for rows already in tie order."""
    pieces = []
    for row, length in enumerate(lengths):
        for piece in range(max(1, -(-length // capacity))):
            start = piece * capacity
            pieces.append((min(capacity, length - start), row, piece, start))
    masks_s, masks_c = bitmaps(sources), bitmaps(clusters)
    bins, out = Bins(capacity), []
    for length, row, piece, start in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        n, offset = bins.place(length, masks_s[row], masks_c[row])
        out.append((row, piece, start, length, n, offset))
    return out


def bitmaps(values: list) -> list[int]:
    """One bit for each distinct value, in order of appearance; 0 for null."""
    place: dict = {}
    return [0 if x is None or x != x else 1 << place.setdefault(x, len(place)) for x in values]


def best_fit(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str | None = "source", cluster: Column | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, piece, start, length, bin, offset): where each piece of each document lies.

    cluster names the duplicate cluster of a row; equal texts form one by default. Lengths
    and hashes are computed by Spark, so only a few dozen bytes a document are shuffled.
    """
    clusters = F.xxhash64(whole_text(text)) if cluster is None else cluster
    meta = df.select(
        F.col(key),
        F.xxhash64(F.col(source)).alias("s") if source else F.lit(None).cast("long").alias("s"),
        clusters.alias("c"),
        F.char_length(whole_text(text)).cast("long").alias("n"),
        F.when(F.col(source).isNull(), True).otherwise(False).alias("free") if source else F.lit(True).alias("free"),
    )
    groups = max(1, math.ceil(df.count() / group_rows))
    kind = df.schema[key].dataType.simpleString()

    def packed(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "n", "c"], kind="stable")
        ids = rows[key].to_numpy()
        named = [None if free else s for s, free in zip(rows.s.tolist(), rows.free.tolist())]
        out = pack(rows.n.tolist(), named, rows.c.tolist(), capacity)
        table = pd.DataFrame(out, columns=["row", "piece", "start", "length", "bin", "offset"])
        table.insert(0, key, pd.Series(ids[table.row.to_numpy()], dtype=rows[key].dtype))
        table["bin"] += int(group[0]) << 32
        return table.drop(columns="row")

    schema = f"`{key}` {kind}, piece int, start long, length long, bin long, offset long"
    return meta.withColumn("g", F.pmod(F.xxhash64(F.col(key)), F.lit(groups))).groupBy("g").applyInPandas(packed, schema)
