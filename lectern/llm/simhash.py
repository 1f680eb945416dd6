"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text gets a 64-bit majority fingerprint of its word shingles. Each bit position is
assigned a non-zero vector of r+1 bits; table v (a non-zero vector as well) keeps the
positions whose vector has odd inner product with v. Any r differing positions leave at
least one table whose kept bits agree, so no pair within the radius is missed.

Edge cases: a null text is the empty text, whose fingerprint is zero and links like any
other; fewer words than the shingle width give one shingle of them all; repeated rows and
equal texts share a fingerprint and so a component; a very long text is hashed whole, SPAN shingles at a time; a bit set in exactly
half of the hashes is 0; only id and text are read, so no other column clashes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_text
from .components import components

SEED = 42
#: Shingles hashed at once, and fingerprints compared in one block.
SPAN, BLOCK = 1 << 16, 4096


def fingerprint(text: str, width: int = 3) -> int:
    """The fingerprint as an unsigned integer: bit set if set in over half of the shingle hashes."""
    words = text.encode().lower().split()  # bytes: only A-Z fold, only ASCII white space splits
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for low in range(0, count, SPAN):
        pieces = [joined[a:b] for a, b in zip(starts[low : low + SPAN], stops[low : low + SPAN])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > count).tobytes(), "big")


def with_fingerprints(df: DataFrame, *, text: str = "text", width: int = 3, into: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(x, width) for x in batch], np.uint64).view(np.int64))

    return df.withColumn(into, prints(whole_text(text)))


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits, as signed integers."""
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        kept = sum(1 << bit for bit in range(64) if bin((bit % vectors + 1) & v).count("1") % 2)
        masks.append(kept - (1 << 64) if kept >> 63 else kept)
    return masks


def spanning_edges(prints: np.ndarray, ids: np.ndarray, radius: int) -> list[dict]:
    """A spanning forest of the graph that links prints within the radius; memory is linear in the block."""
    prints = prints.astype(np.int64).view(np.uint64)
    edges, left = [], np.arange(len(prints))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= radius
            if near.any():
                found = left[near]
                edges += [{"u": int(ids[at]), "v": int(ids[x])} for x in found]
                queue += found.tolist()
                left = left[~near]
    return edges


def near_pairs(reps: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) that connect the same fingerprints of reps (fp, root) as all pairs within the radius.

    A bucket is cut into blocks of about BLOCK fingerprints, every two blocks of a bucket meet in
    one row, and each row yields a spanning forest instead of its pairs. So no task holds a
    bucket, output stays linear in a block, and no link between components is lost.
    """
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(covering_masks(radius))))
    keyed = reps.select("fp", "root", F.inline(tables))
    wide = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1").select("t", "k", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    blocks = (
        keyed.join(wide, ["t", "k"])
        .groupBy("t", "k", "parts", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list(F.struct("fp", "root")).alias("m"))
        .select("t", "k", "parts", "part", F.transform("m", lambda x: x.fp).alias("fps"), F.transform("m", lambda x: x.root).alias("ids"))
    )
    blocks = materialize(blocks)
    met = (
        blocks.filter("parts > 1")
        .select("t", "k", "part", "fps", "ids", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .groupBy("t", "k", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
        .agg(F.flatten(F.collect_list("fps")).alias("fps"), F.flatten(F.collect_list("ids")).alias("ids"))
    )

    @F.pandas_udf("array<struct<u:long,v:long>>")
    def forest(fps: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([spanning_edges(np.asarray(f), np.asarray(i), radius) for f, i in zip(fps, ids)])

    rows = blocks.filter("parts = 1").select("fps", "ids").unionByName(met.select("fps", "ids"))
    return rows.select(F.inline(forest("fps", "ids"))).distinct()


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links within the radius.

    Equal fingerprints are first collapsed to one representative, so a group of copies that
    holds a third of all rows costs one fingerprint. The fingerprints are read once from the
    texts and checkpointed; everything after moves 16 bytes a document. A row whose key is
    null takes the component of the others with its fingerprint.
    """
    prints = materialize(with_fingerprints(df.select(key, text), text=text, width=width).select(key, "fp"))
    reps = materialize(prints.groupBy("fp").agg(F.min(key).alias("root")))
    named = components(near_pairs(reps.filter("root IS NOT NULL"), radius))
    rooted = reps.join(named.withColumnRenamed("node", "root"), "root", "left").select("fp", F.coalesce("component", "root").alias("component_id"))
    return prints.join(rooted, "fp", "left").select(key, "fp", "component_id")


def hex_print(column: str = "fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def deduplicate(df: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component stays: the one whose key names the component.

    Rows that repeat a key count as copies, and one of them stays. Rows with a null key
    cannot be named and stay. The texts are shuffled once, by key.
    """
    return keep_one(df, near_duplicates(df, key=key, text=text, width=width, radius=radius), key=key)


def keep_one(df: DataFrame, found: DataFrame, *, key: str) -> DataFrame:
    """The rows of df whose key names their component in found (key, component_id), one for each key."""
    tally = materialize(found.groupBy(key, "component_id").agg(F.count("*").alias("n")))
    kept = df.join(tally.filter(F.col(key) != F.col("component_id")).select(key), key, "left_anti")
    repeated = tally.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("n")).filter("n > 1")
    if repeated.limit(1).count() == 0:
        return kept
    named = kept.filter(F.col(key).isNotNull()).dropDuplicates([key])
    return named.unionByName(kept.filter(F.col(key).isNull()))
