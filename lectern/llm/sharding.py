"""K-d tree sharding, in DataFrame functions only.

The documents are split in two, again and again, at the weighted median of the node's widest
metadata dimension until each leaf holds the target bytes. A document's place in a dimension is a
48-bit key: 16 bits of the metadata value and 32 bits of a hash of the id, so equal values still
split evenly. A median is found by three grouped histograms of 2^16 bins each, the second and the
third inside the bin where the first crosses the target; the driver sees one row a node.

Edge cases: a null text has no bytes (size 1); null metadata counts as the empty string; a
document above the target bytes fills a leaf on its own account; repeated rows
share their key and stay together; an empty table gives an empty result; other columns with
the same names are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, whole_text

LOW, BINS = 32, 1 << 16
#: Rows numbered by one window partition, and most rows of offsets that are broadcast.
RUN, SMALL = 100_000, 1_000_000


def metadata(df: DataFrame, *, key: str, text: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, size, text_crc32, d0, d1, ...): d0 is the size on a log scale, then one dimension a column."""
    tie = F.xxhash64(key).bitwiseAND((1 << LOW) - 1)
    size = (F.octet_length(whole_text(text)) + 1).cast("long")
    places = [F.least(F.floor(F.log2(size) * 1024), F.lit(BINS - 1))]
    places += [F.shiftright(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), 16) for c in columns]
    dims = [F.shiftleft(p.cast("long"), LOW).bitwiseOR(tie).alias(f"d{i}") for i, p in enumerate(places)]
    return df.select(key, size.alias("size"), F.crc32(whole_text(text)).alias("text_crc32"), *dims)


def _case(choices: dict[int, Column], of: Column, otherwise: Column) -> Column:
    for node, value in choices.items():
        otherwise = F.when(of == node, value).otherwise(otherwise)
    return otherwise


def _medians(rows: DataFrame, dim: dict[int, int], target: dict[int, float]) -> dict[int, int]:
    """For each node the greatest key that goes left, so that the left holds nearly target[node] bytes."""
    place = _case({n: F.col(f"d{d}") for n, d in dim.items()}, F.col("node"), F.lit(None).cast("long"))
    rows = rows.select("node", "size", place.alias("place")).filter("place IS NOT NULL")
    prefix, before = dict.fromkeys(dim, 0), dict.fromkeys(dim, 0)
    for shift in (32, 16, 0):
        inside = F.shiftright("place", shift + 16) == _case({n: F.lit(p).cast("long") for n, p in prefix.items()}, F.col("node"), F.lit(-1).cast("long"))
        bins = rows.filter(inside).groupBy("node", F.shiftright("place", shift).alias("bin")).agg(F.sum("size").alias("bytes"))
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin")) + _case({n: F.lit(b).cast("long") for n, b in before.items()}, F.col("node"), F.lit(0).cast("long"))
        crossed = bins.withColumn("upto", upto).filter(F.col("upto") >= _case({n: F.lit(t) for n, t in target.items()}, F.col("node"), F.lit(0.0)))
        for row in crossed.groupBy("node").agg(F.min(F.struct("bin", "upto", "bytes")).alias("m")).select("node", "m.*").collect():
            prefix[row.node], before[row.node], last = row.bin, row.upto - row.bytes, row.upto
            if shift == 0 and target[row.node] - before[row.node] < last - target[row.node]:
                prefix[row.node] -= 1  # the boundary is nearer below this key
    return prefix


def assign(meta: DataFrame, *, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """meta with its leaf as ``shard``: 0 to shards - 1, or as many as target_bytes asks for."""
    dims = [c for c in meta.columns if c[0] == "d" and c[1:].isdigit()]
    if shards is None:
        total = meta.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    placed = meta.withColumn("node", F.lit(0))
    spans, base = {0: (0, shards)}, None  # node -> its first shard and how many
    while any(many > 1 for _, many in spans.values()):
        limits = [f(F.shiftright(d, LOW)).alias(f"{n}_{d}") for d in dims for n, f in (("low", F.min), ("high", F.max))]
        stats = {r.node: r for r in placed.groupBy("node").agg(F.sum("size").alias("bytes"), *limits).collect()}
        if not stats:
            break
        width = {n: [r[f"high_{d}"] - r[f"low_{d}"] for d in dims] for n, r in stats.items()}
        base = base or [max(1, w) for w in width[0]]
        live = [n for n, (_, many) in spans.items() if many > 1 and n in stats]
        dim = {n: max(range(len(dims)), key=lambda i: (width[n][i] / base[i], -i)) for n in live}
        target = {n: float(stats[n].bytes) * (spans[n][1] // 2) / spans[n][1] for n in live}
        cut = _medians(placed, dim, target)
        children = {n: F.when(F.col(f"d{dim[n]}") <= F.lit(cut[n]).cast("long"), F.lit(2 * n + 1)).otherwise(F.lit(2 * n + 2)) for n in live}
        placed = placed.withColumn("node", _case(children, F.col("node"), F.col("node")))
        spans = {k: v for n, (first, many) in spans.items() for k, v in (((2 * n + 1, (first, many // 2)), (2 * n + 2, (first + many // 2, many - many // 2))) if many > 1 else ((n, (first, many)),))}
    return placed.withColumn("shard", _case({n: F.lit(first) for n, (first, _) in spans.items()}, F.col("node"), F.lit(0)).cast("int")).drop("node")


def with_slots(df: DataFrame, *, key: str, shards: int) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Each shard is cut into runs by a hash of the key; runs are counted, their offsets summed, and rows
    numbered inside a run, so no task sorts a shard. Runs grow in number with the rows.
    """
    runs = max(64, math.ceil(df.count() / shards / RUN))
    cut = df.withColumn("run", F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(runs)))
    counts = cut.groupBy("shard", "run").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")
    offsets = counts.select("shard", "run", ahead.alias("ahead"))
    if runs * shards <= SMALL:
        offsets = F.broadcast(offsets)
    inside = F.row_number().over(Window.partitionBy("shard", "run").orderBy(key)) - 1
    numbered = cut.withColumn("inside", inside)
    return numbered.join(offsets, ["shard", "run"]).withColumn("slot", F.col("ahead") + F.col("inside"))


def kd_shards(df: DataFrame, *, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("source", "lang"), shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, slot). The texts are read once; later passes scan the checkpointed metadata."""
    meta = materialize(metadata(df, key=key, text=text, columns=columns))
    placed = assign(meta, shards=shards, target_bytes=target_bytes)
    return with_slots(placed.select(key, "size", "text_crc32", "shard"), key=key, shards=shards or 1).select(
        key, "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")
    )
