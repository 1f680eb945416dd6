"""Fusing, scoring, capping and selecting retrieval hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered

# Weights and penalties of the final score.
WEIGHTS = {"llm": 0.35, "channel": 0.25, "cooccurrence": 0.15, "scope": 0.15, "cluster": 0.10}
NAVIGATION, SHORT, SHORT_CHARS = 0.4, 0.15, 20


def fused(hits: DataFrame) -> DataFrame:
    """One row a unit_key: the first hit's fields, the greatest score of each channel, all patterns.

    hits: (ordinal, unit_key, source, score, patterns array).
    """
    best = hits.groupBy("unit_key", "source").agg(F.min("ordinal").alias("ordinal"), F.max("score").alias("score"), F.flatten(F.collect_list("patterns")).alias("patterns"))
    return best.groupBy("unit_key").agg(
        F.min("ordinal").alias("ordinal"),
        F.min_by("source", "ordinal").alias("source"),
        F.max("score").alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "score")))).alias("channel_scores"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("patterns")))).alias("patterns"),
    )


def final_score(hits: DataFrame) -> DataFrame:
    """Add final_score from (llm, channel, n_patterns, scope, n_in_file, kind, snippet), between 0 and 1."""
    w = WEIGHTS
    penalty = F.when(F.col("kind") == "navigation_hint", NAVIGATION).otherwise(0.0) + F.when(F.length(F.trim("snippet")) < SHORT_CHARS, SHORT).otherwise(0.0)
    raw = (
        w["llm"] * F.col("llm")
        + w["channel"] * F.col("channel")
        + w["cooccurrence"] * F.least(F.lit(1.0), F.col("n_patterns") / 4)
        + w["scope"] * F.col("scope")
        + w["cluster"] * F.least(F.lit(0.3), (F.col("n_in_file") - 1) * 0.05)
        - penalty
    )
    return hits.withColumn("final_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def capped(hits: DataFrame, most: int = 5, *, group: str = "file", score: str = "score", tie: str = "hit_id") -> DataFrame:
    """The best ``most`` hits of each group; hits with a blank group are exempt."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return hits.withColumn("_rank", rank).filter((F.col("_rank") <= most) | (F.col(group) == "")).drop("_rank")


def soft_selected(hits: DataFrame, least: float, most: int, most_chars: int) -> DataFrame:
    """(query_id, hit_id, suggested): greedy by score; a hit over the character budget is passed over, the first always fits.

    hits: (query_id, hit_id, score, chars). Each query's hits are folded in order.
    """
    ranked = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "hit_id", "score", "chars"))).alias("h"))
    state = F.struct(F.lit(0).cast("long").alias("chars"), F.array().cast("array<long>").alias("out"))

    def step(a, x):
        take = (x.score >= least) & (F.size(a.out) < most) & ((F.size(a.out) == 0) | (a.chars + x.chars <= most_chars))
        return F.struct((a.chars + F.when(take, x.chars).otherwise(0)).alias("chars"), F.when(take, F.concat(a.out, F.array(x.hit_id.cast("long")))).otherwise(a.out).alias("out"))

    picked = ranked.withColumn("taken", F.aggregate("h", state, step, lambda a: a.out))  # at most ``most`` ids
    return picked.select("query_id", F.inline(F.transform("h", lambda x: F.struct(x.hit_id.cast("long").alias("hit_id"), F.array_contains("taken", x.hit_id.cast("long")).alias("suggested")))))


def quota_selected(entries: DataFrame, preferred: str, primary: int, relevant: int, long: int) -> DataFrame:
    """(digest, stage): entries of the preferred dictionary by length, then by relevance, then by length.

    entries: (dict_id, digest, chars, relevance).
    """
    take = lambda df, stage, n, *order: df.orderBy(*order, "digest").limit(n).select("digest", F.lit(stage).alias("stage"))
    first = take(entries.filter(F.col("dict_id") == preferred), 1, primary, F.desc("chars"))
    second = take(entries.join(first, "digest", "left_anti"), 2, relevant, F.desc("relevance"), F.desc("chars"))
    third = take(entries.join(first, "digest", "left_anti").join(second, "digest", "left_anti"), 3, long, F.desc("chars"))
    return first.union(second).union(third)


def tagged(hits: DataFrame, *, order: str = "ordinal") -> DataFrame:
    """Add tag: R001, R002, ... in order of a number."""
    nth = F.col("nth").cast("string")
    return numbered(hits, order).withColumn("tag", F.concat(F.lit("R"), F.when(F.length(nth) < 3, F.lpad(nth, 3, "0")).otherwise(nth))).drop("nth")


def new_hits(incoming: DataFrame, active: DataFrame) -> DataFrame:
    """Incoming hits whose digest is not active, the first of each digest."""
    fresh = incoming.join(active.select("digest"), "digest", "left_anti")
    return fresh.withColumn("_nth", F.row_number().over(Window.partitionBy("digest").orderBy("ordinal"))).filter("_nth = 1").drop("_nth")


def evicted(entries: DataFrame, cap: int) -> DataFrame:
    """Entries (id, weight, created_at) beyond the cap: the lightest, then the oldest. The cap heaviest stay."""
    kept = entries.orderBy(F.desc("weight"), F.desc("created_at"), F.desc("id")).limit(cap).select("id")
    return entries.join(kept, "id", "left_anti")


def scored_and_sorted(hits: DataFrame) -> DataFrame:
    """(query_id, hit_id, final_score, rank): hits with patterns counted by unit and by file, scored and ranked in their query."""
    counted = hits.withColumn("n_patterns", F.sum(F.coalesce(F.size("patterns"), F.lit(1))).over(Window.partitionBy("unit_key"))).withColumn("n_in_file", F.count("*").over(Window.partitionBy("file")))
    scored = final_score(counted).withColumn("final_score", F.round("final_score", 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "hit_id"))
    return scored.select("query_id", "hit_id", "final_score", rank.alias("rank"))


def united(channels: dict[str, DataFrame]) -> DataFrame:
    """The hits of all channels, each with its source; columns that a channel lacks are null there."""
    out = None
    for source, hits in channels.items():
        own = hits.withColumn("source", F.lit(source))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
