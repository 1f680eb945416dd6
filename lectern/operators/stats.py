"""Frequency tables and batch statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, token_estimate, trimmed


def word_frequency(df: DataFrame, *, text: str = "text") -> DataFrame:
    words = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def character_frequency(df: DataFrame, *, text: str = "text") -> DataFrame:
    chars = df.select(F.explode(F.split(F.regexp_replace(text, SPACE, ""), "")).alias("ch")).filter("ch <> ''")
    return chars.groupBy("ch").agg(F.count("*").alias("n"))


def field_totals(df: DataFrame, *fields: str) -> DataFrame:
    """(field, chars, tokens) of each text field; blank ones count nothing."""
    text = lambda f: F.coalesce(F.col(f), F.lit(""))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), text(f).alias("t")) for f in fields))
    return df.select(F.inline(rows)).groupBy("field").agg(F.sum(F.length("t")).alias("chars"), F.sum(token_estimate(F.col("t"))).alias("tokens"))


def segment_stats(segments: DataFrame, *, target: str = "target") -> DataFrame:
    n = F.length(trimmed(F.col(target)))
    return segments.agg(F.count("*").alias("n"), F.max(n).alias("longest"), F.min(n).alias("shortest"), F.sum(n).alias("total"))


def modal_length(lines: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, modal_length) over lines (key, line_no, line) that are not blank; the length seen first wins ties."""
    sizes = lines.filter(trimmed(F.col("line")) != "").groupBy(key, F.length("line").alias("len")).agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    return sizes.groupBy(key).agg(F.max_by("len", F.struct("n", -F.col("first"))).alias("modal_length"))


def progress(df: DataFrame, status: str, amount: str) -> DataFrame:
    """(status, items, amount, share of all items)."""
    by = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("items"), F.sum(amount).alias("amount"))
    return by.withColumn("share", F.col("items") / F.sum("items").over(Window.partitionBy()))


def calls_in_window(events: DataFrame, seconds: int = 60, *, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Each event with in_window: the events of its key in the seconds up to it, itself included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    recent = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(recent))


def alignment_counts(alignment: DataFrame, *, kind: str = "type", by: tuple[str, ...] = ()) -> DataFrame:
    """(total, match, delete, insert, movein, moveout) of aligned rows."""
    return alignment.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col(kind) == k).alias(k) for k in ("match", "delete", "insert", "movein", "moveout")))


def distinct_replacements(changes: DataFrame) -> DataFrame:
    """(wrong, correct, clause): each clause of each replacement once."""
    return changes.select("wrong", "correct", "clause").distinct()


def folder_counts(files: DataFrame, *, path: str = "file") -> DataFrame:
    """(dir, n): files directly in each folder; '' is the top."""
    return files.groupBy(F.regexp_extract(path, "^(.*)/", 1).alias("dir")).agg(F.count("*").alias("n"))


def total_places(entries: DataFrame) -> DataFrame:
    """One row (places): the places of all check entries (n)."""
    return entries.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("places"))


def cache_counts(asked: DataFrame, cache: DataFrame, *, key: str = "key", by: str = "source") -> DataFrame:
    """(source, hits, misses) of lookups against the keys of a cache."""
    known = cache.select(key).distinct().withColumn("_known", F.lit(True))
    met = asked.join(known, key, "left")
    return met.groupBy(by).agg(F.count("_known").alias("hits"), F.count_if(F.col("_known").isNull()).alias("misses"))


def scaled_totals(totals: DataFrame, factor: float) -> DataFrame:
    """(field, chars, tokens) times a factor, rounded up."""
    return totals.select("field", *(F.ceil(F.col(c) * factor).cast("long").alias(c) for c in ("chars", "tokens")))
