"""Repeated and similar sentences inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Normalization, ngrams, normalize, without_ellipsis
from .segment import sentences


def keyed_sentences(df: DataFrame, least: int = 5, options: Normalization = Normalization(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, sentence, len_norm, match_key): length counts the ellipsis, the match key does not."""
    norm = normalize(F.col("sentence"), options)
    found = sentences(df, key=key, text=text).filter(F.length("sentence") >= least)
    return found.select(key, "idx", "sentence", F.length(norm).alias("len_norm"), without_ellipsis(norm).alias("match_key"))


def exact_groups(keyed: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, match_key, n, first_idx, preview) of keys that occur twice or more in one document."""
    return (
        keyed.filter("match_key <> ''")
        .groupBy(key, "match_key")
        .agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.min_by("sentence", "idx").alias("sentence"))
        .filter("n >= 2")
        .select(key, "match_key", "n", "first_idx", F.left("sentence", F.lit(40)).alias("preview"))
    )


def similar_pairs(keyed: DataFrame, threshold: float = 0.8, length_delta: float = 0.2, n: int = 3, *, key: str = "doc_id") -> DataFrame:
    """(key, left_idx, right_idx, score) of different keys of one document with Jaccard at least threshold.

    The length band of the shorter side is tested before any n-gram set is built. Rows meet by
    document and by log-scale length bucket (the shorter one's bucket and those its band reaches), so
    a long document is spread over many join keys.
    """
    rows = keyed.filter("match_key <> ''").groupBy(key, "match_key").agg(F.min("idx").alias("idx"), F.min("len_norm").alias("len"))
    ratio = 1 + max(length_delta, 0.01)
    bucket = lambda x: F.floor(F.log(x) / F.log(F.lit(ratio))).cast("int")
    grams = rows.withColumn("grams", ngrams(F.col("match_key"), n))
    top = F.ceil(F.col("len") * (1 + length_delta))
    a = grams.select(key, F.col("idx").alias("a"), F.col("len").alias("la"), F.col("match_key").alias("ka"), F.col("grams").alias("ga"), F.explode(F.sequence(bucket(F.col("len")), bucket(top))).alias("b"))
    c = grams.select(key, F.col("idx").alias("c"), F.col("len").alias("lc"), F.col("match_key").alias("kc"), F.col("grams").alias("gc"), bucket(F.col("len")).alias("b"))
    near = (F.col("lc") <= F.ceil(F.col("la") * (1 + length_delta))) & ((F.col("la") < F.col("lc")) | ((F.col("la") == F.col("lc")) & (F.col("a") < F.col("c"))))
    # The intersection alone gives the union's size, so each pair builds one set.
    shared = F.size(F.array_intersect("ga", "gc"))
    scored = a.join(c, [key, "b"]).filter(near).withColumn("score", F.transform(F.array(shared), lambda x: x / (F.size("ga") + F.size("gc") - x))[0]).filter(F.col("score") >= threshold)
    return scored.select(key, F.least("a", "c").alias("left_idx"), F.greatest("a", "c").alias("right_idx"), "score")


def similar_groups(pairs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, idx, group_id, score): components of the pairs inside each document.

    group_id is the least index; score the greatest of the group's pairs. A document's own edges are folded
    with a union-find, as components never cross documents.
    """
    import pandas as pd

    kind = pairs.schema[key].dataType.simpleString()

    def components(edges: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(edges.left_idx, edges.right_idx):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
        best: dict[int, float] = {}
        for a, s in zip(edges.left_idx, edges.score):
            best[find(a)] = max(best.get(find(a), 0.0), s)
        members = sorted(parent)
        return pd.DataFrame({key: edges[key].iloc[0], "idx": members, "group_id": [find(x) for x in members], "score": [best[find(x)] for x in members]})

    return pairs.groupBy(key).applyInPandas(components, f"`{key}` {kind}, idx int, group_id int, score double")


def unseen(rows: DataFrame, seen: DataFrame, body: str, order: str, *, key: str = "doc_id") -> DataFrame:
    """(key, body, order): bodies that ``seen`` lacks, once for each key, at their first place."""
    return rows.join(seen.select(body).distinct(), body, "left_anti").groupBy(key, body).agg(F.min(order).alias(order))
