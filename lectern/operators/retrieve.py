"""Keyword ranking, vector similarity and pattern search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import substrings
from .segment import lines
from .sizes import small


def _terms(text: Column) -> Column:
    """The tokens of letters and digits, normalized for search, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: (F.length(t) > 1) | t.rlike("[a-z0-9]"))


def tokens(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term): one row a token."""
    return df.select(key, F.explode(_terms(F.col(text))).alias("term"))


def corpus_stats(toks: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """One row (n_docs, avg_len) over documents with a token."""
    return toks.groupBy(key).agg(F.count("*").alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"))


def bm25(df: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, top: int = 25, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, score, rank) for queries (query_id, term); scores above 0, best first, ties by key.

    Lengths are taken inside each row, and tokens that no query asks for go before counting, so only the asked
    (document, term) counts and one length a row are shuffled, never the tokens.
    """
    asked = queries.select("query_id", F.lower("term").alias("term")).distinct()
    lengths = df.select(key, F.size(_terms(F.col(text))).alias("dl")).groupBy(key).agg(F.sum("dl").alias("dl")).filter("dl > 0")
    tf = tokens(df, key=key, text=text).join(small(asked.select("term").distinct()), "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"))
    df_terms = tf.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = (
        tf.join(df_terms, "term").join(lengths, key).crossJoin(F.broadcast(stats)).withColumn("part", part).join(small(asked), "term").groupBy("query_id", key).agg(F.sum("part").alias("score")).filter("score > 0")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top)


def bigrams(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, gram, tf) of the character bigrams without white space."""
    grams = df.select(key, F.explode(substrings(F.regexp_replace(F.col(text), r"\s+", ""), 2)).alias("gram"))
    return grams.groupBy(key, "gram").agg(F.count("*").alias("tf"))


def bigram_cosine(df: DataFrame, queries: DataFrame, top: int = 20, least: float = 0.15, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, score, rank) by cosine of bigram counts, for queries (query_id, query).

    Each text's bigrams are counted before the shuffle, which carries its distinct ones; both norms and dots read that one exchange.
    Norms folded inside each row were measured and took over three times as long.
    """
    grams = bigrams(df, key=key, text=text)
    norms = grams.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    asked = bigrams(queries, key="query_id", text="query").withColumnRenamed("tf", "qtf")
    asked_norms = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("qnorm"))
    dots = grams.join(small(asked), "gram").groupBy("query_id", key).agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"))
    scored = dots.join(norms, key).join(small(asked_norms), "query_id").withColumn("score", F.col("dot") / (F.col("norm") * F.col("qnorm"))).filter(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", key, "score", "rank")


def dense_cosine(vectors: DataFrame, queries: DataFrame, top: int = 20, block: int = 4096, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank) by cosine of dense vectors, for queries (query_id, query).

    The queries are counted and dealt by hash to blocks of about ``block``; each block is broadcast to one scan of the vectors.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(F.col(vector), F.col(vector)) * dot(F.col("query"), F.col("query")))
    blocks = max(1, -(-queries.count() // block))
    met = None
    for n in range(blocks):
        part = F.broadcast(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n))
        pairs = vectors.select(key, vector).join(part, F.col(key) != F.col("query_id"))
        met = pairs if met is None else met.unionAll(pairs)
    scored = met.select("query_id", key, (dot(F.col(vector), F.col("query")) / F.nullif(norm, F.lit(0.0))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top)


def grep(df: DataFrame, pattern: str, per_file: int = 80, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line): lines that match regardless of case, at most per_file a document."""
    hits = lines(df, key=key, text=text).filter(F.col("line").rlike(f"(?i){pattern}"))
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).filter(F.col("nth") <= per_file).drop("nth")


def merge_hits(hits: DataFrame, most: int, gap: int = 5, *, file: str = "file") -> DataFrame:
    """(file, start_line, end_line, snippet, value): hits (file, line, line_text, value) no more than gap lines apart
    become one; the best ``most`` of all stay."""
    per_line = hits.groupBy(file, "line").agg(F.max("value").alias("value"), F.min("line_text").alias("line_text"))
    ahead = Window.partitionBy(file).orderBy("line")
    fresh = F.when(F.col("line") - F.lag("line").over(ahead) <= gap, 0).otherwise(1)
    runs = per_line.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(ahead))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "line_text"))), lambda x: x.line_text), "\n")
    merged = runs.groupBy(file, "run").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), text.alias("snippet"), F.max("value").alias("value"))
    return merged.orderBy(F.desc("value"), file, "start_line").limit(most).drop("run")
