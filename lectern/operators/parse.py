"""What language models and channels return, as rows: lookup plans, rerank decisions, cleaned hits, joined references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import clean_snippet, lookup_term
from ..functions.text import bound, trimmed

# Channels whose snippets are cleaned, most candidates of a lookup, most characters of a snippet.
CORPUS, CANDIDATES, SNIPPET = ("grep_md", "bm25", "vector"), 3, 500


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def lookup_plan(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, point_id, dict_id, candidates, mode, why): planned lookups with a candidate that is not blank, the first CANDIDATES of each.

    A lookup without an id is named by its place. Text without a valid object gives no row.
    """
    plan = F.from_json(json_object(F.col(text)), "lookups array<struct<pointId: string, dictId: string, candidates: array<string>, why: string>>")
    rows = df.select(key, F.posexplode(plan.lookups).alias("_i", "_l")).filter("_l IS NOT NULL")
    wanted = F.filter(F.transform("_l.candidates", trimmed), lambda c: c != "")
    found = rows.select(key, F.coalesce("_l.pointId", F.concat(F.lit("p-"), (F.col("_i") + 1).cast("string"))).alias("point_id"), F.col("_l.dictId").alias("dict_id"), F.slice(wanted, 1, CANDIDATES).alias("candidates"), F.lit("exact").alias("mode"), "_l.why")
    return found.filter(F.size("candidates") > 0)


def rerank_decisions(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, ref_tag, action, score, reason) of decisions with a tag: drop where it says so, else keep; a score that is no number is null."""
    found = F.from_json(json_object(F.col(text)), "decisions array<struct<refTag: string, action: string, score: string, reason: string>>").decisions
    rows = df.select(key, F.posexplode(found).alias("idx", "_d")).filter(F.coalesce("_d.refTag", F.lit("")) != "")
    return rows.select(key, "idx", F.col("_d.refTag").alias("ref_tag"), F.when(F.col("_d.action") == "drop", "drop").otherwise("keep").alias("action"), F.col("_d.score").try_cast("double").alias("score"), "_d.reason")


def merge_groups(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, keep, drop, reason) of merge groups that name what they keep."""
    found = F.from_json(json_object(F.col(text)), "mergeGroups array<struct<keep: string, drop: array<string>, reason: string>>").mergeGroups
    rows = df.select(key, F.posexplode(found).alias("idx", "_g")).filter(F.coalesce("_g.keep", F.lit("")) != "")
    return rows.select(key, "idx", "_g.keep", F.coalesce("_g.drop", F.array().cast("array<string>")).alias("drop"), "_g.reason")


def cleaned_hits(hits: DataFrame, mark: str, *, source: str = "source", snippet: str = "snippet", block: str = "reference_block", heading: str = "heading_path") -> DataFrame:
    """Hits with noise lines taken from the snippets of the CORPUS channels, and from their reference blocks; a hit with no snippet left goes.

    mark is the word that starts the machine comments around a block. A block without comments and head has the old snippet replaced once.
    """
    old = F.coalesce(F.col(snippet), F.lit(""))
    # Exploded, so that neither the filter nor a later column computes it again.
    rows = hits.withColumn("_new", F.explode(F.array(F.when(F.col(source).isin(*CORPUS), clean_snippet(old, F.col(heading)))))).filter("_new IS NULL OR _new <> ''")
    changed = F.col("_new").isNotNull() & (F.col("_new") != trimmed(old))
    part = lambda p: F.nullif(F.regexp_extract(block, p, 0), F.lit(""))
    begin, end, head = part(f"<!-- {mark}:grepHit begin[^>]*-->"), part(f"<!-- {mark}:grepHit end -->"), part(r"【文献摘录】[^\n]*")
    at = F.instr(F.col(block), F.col(snippet))
    inside = F.concat(F.left(F.col(block), at - 1), F.col("_new"), F.substr(F.col(block), at + F.length(snippet)))
    whole = begin.isNotNull() & end.isNotNull() & head.isNotNull()
    rebuilt = F.when(whole, F.concat_ws("\n", begin, head, F.lit(""), "_new", end)).when((old != "") & (at > 0), inside).otherwise(F.col(block))
    return rows.withColumns({block: F.when(changed, rebuilt).otherwise(F.col(block)), snippet: F.when(changed, F.left("_new", F.lit(SNIPPET))).otherwise(F.col(snippet))}).drop("_new")


def joined_reference(hits: DataFrame, *, by: str, order: str = "ordinal", block: str = "block") -> DataFrame:
    """(by, reference): the blocks of active hits that are no navigation hints, in order, a blank line between."""
    active = hits.filter("status = 'active' AND kind <> 'navigation_hint'")
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(block).alias("b"))))
    return active.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x.b), "\n\n").alias("reference"))


def converted(text: Column, characters: dict[str, str], phrases: dict[str, str] | None = None) -> Column:
    """The text in another script: phrases first, the longest before others, then single characters. Tables are parameters; none is bundled."""
    out = text
    for a in sorted(phrases or {}, key=lambda x: (-len(x), x)):
        out = F.replace(out, F.lit(a), F.lit(phrases[a]))
    return F.translate(out, "".join(characters), "".join(characters.values())) if characters else out


def alternate_terms(term: Column, *tables: dict[str, str]) -> Column:
    """The term in each table's script where that differs from the term itself; none for a blank term."""
    def others(base: Column) -> Column:
        found = F.array(*(lookup_term(converted(base, t)) for t in tables))
        return F.array_distinct(F.filter(found, lambda x: (x != "") & (x != base) & (base != "")))

    return bound(lookup_term(term), others)


def word_errors(replacements: DataFrame) -> DataFrame:
    """(wrong, correct, clause) as the rows of a word-error table, with its fixed column names."""
    return replacements.select(
        F.col("wrong").alias("错误词语"), F.col("correct").alias("正确词语"), F.col("clause").alias("错误词语所在小句"), F.length("wrong").alias("错词长度"), F.length("correct").alias("正词长度")
    )
