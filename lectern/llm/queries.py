"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, html_extraction, language_id, lm_scoring, packing, quality_rules, sharding, simhash, token_counts
from .common import table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repair(table(spark, sf_dir, "conversations"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score_texts(table(spark, sf_dir, "documents"))
    bits = -F.col("score") * F.log2(F.lit(10.0)) / F.greatest("n_bytes", F.lit(1))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.nullif(F.regexp_extract("source", r"\.([^./]+)$", 1), F.lit(""))  # null where a source is no address
    docs = table(spark, sf_dir, "documents").withColumn("suffix", suffix)
    found = language_id.identify(docs, language_id.fit(docs), declared="lang", host="source", suffix="suffix")
    return found.select("doc_id", "lang", "language", "text_language", "confidence", "fit", "kept")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), language_id.page_evidence(table(spark, sf_dir, "pages"))
    found = language_id.identify(pages, language_id.fit(docs), declared="declared", host="host", suffix="suffix")
    return found.select("page_id", "host", "suffix", "declared", "language", "text_language", "confidence", "fit", "kept")


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.kd_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"),
        quality_rules.passes(quality_rules.POLICIES[-1]).alias("kept"),
        "failed_bits",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT doc_id, unnest(ws) AS v, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, v || ' ' || lead(v, 1) OVER o || ' ' || lead(v, 2) OVER o || ' ' || lead(v, 3) OVER o || ' ' || lead(v, 4) OVER o AS k
      FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g WHERE k IS NOT NULL) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(5) s(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
             length(regexp_replace(t, '\P{L}+', '', 'g')) AS n_letters,
             length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS n_capitals
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
ledger AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
       + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT
       + 32 * (n_letters >= 50 AND 10 * n_capitals > 6 * n_letters)::BIGINT + 64 * (2 * n_letters < word_chars)::BIGINT AS failed_bits FROM m)
"""
LEDGER_SQL = f"""{QUALITY_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM ledger"""
ABLATION_SQL = f"""{QUALITY_SQL},
policies AS (SELECT * FROM (VALUES ('base', 3), ('v1', 15), ('v2', 127)) v(version, mask)),
rules AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16), ('capitals', 32), ('few_letters', 64)) v(rule, bit))
SELECT version, rule, count(*) AS n_docs, sum((failed_bits & mask = 0)::INT)::BIGINT AS n_kept, sum((failed_bits & bit <> 0)::INT)::BIGINT AS n_failed,
       sum((failed_bits & mask = bit)::INT)::BIGINT AS n_only, bit_or(failed_bits & mask) AS union_bits
FROM ledger, policies, rules WHERE mask & bit <> 0 GROUP BY version, rule"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_html_extraction,
        op2_chat_format,
        op3_lm_scoring,
        op4_best_fit_packing,
        op5_decontamination,
        op6_language_id,
        op7_kd_sharding,
        op8_simhash_dedup,
        op9_token_counts,
        op10_quality_rules,
        language_id_pages,
        quality_ablations,
    )
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {"op10_quality_rules": LEDGER_SQL, "quality_ablations": ABLATION_SQL}
