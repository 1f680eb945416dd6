"""Ordering, limiting, merging and judging hits, queries and dictionary entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from .sizes import small

#: Entries of one key in one array, and terms of one key that meet it in one task.
ENTRIES, TERMS = 1024, 4096
# The order of sources in an export, and the sources that an intent may use.
SOURCE_RANK = {"dict": 0, "grep_md": 1, "bm25": 2, "vector": 3, "wikipedia": 4, "web": 5}
INTENT_SOURCES = {
    "entity_name": "dict grep_md bm25 vector wikipedia web",
    "term_norm": "dict grep_md bm25 vector wikipedia web",
    "word_usage": "dict grep_md bm25 vector",
    "citation": "grep_md bm25 vector",
    "general_fact": "grep_md bm25 vector dict wikipedia web",
}
OTHER_SOURCES = "dict grep_md bm25 vector"


def export_order(hits: DataFrame) -> DataFrame:
    """hits (hit_id, source, score) with rank: by score to nine places, then source, then id."""
    ranks = F.create_map(*(F.lit(x) for pair in SOURCE_RANK.items() for x in pair))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.coalesce(F.try_element_at(ranks, F.col("source")), F.lit(9)), "hit_id")
    return hits.withColumn("rank", F.row_number().over(order))


def top_per_group(hits: DataFrame, most: int, *, group: str = "query_id", score: str = "score", tie: str = "hit_id") -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), tie)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def newest(entries: DataFrame, most: int, *, group: str, at: str, tie: str) -> DataFrame:
    """The entries a cache keeps in each group: the most recently fetched ones."""
    return entries.withColumn("age", F.row_number().over(Window.partitionBy(group).orderBy(F.col(at).desc(), tie))).filter(F.col("age") <= most).drop("age")


def by_confidence(items: DataFrame, *, group: str, confidence: str, tie: str) -> DataFrame:
    """items with rank in their group: surest first, those without a confidence last."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(confidence).desc_nulls_last(), tie)))


def filter_entries(entries: DataFrame, text: str = "", labels: tuple[str, ...] = (), least: int = 0) -> DataFrame:
    """Check entries (variant, preferred, n, label) that hold the text, have one of the labels and enough places."""
    if text.strip():
        entries = entries.filter(F.col("variant").contains(text.strip()) | F.col("preferred").contains(text.strip()))
    if labels:
        entries = entries.filter(F.coalesce("label", F.lit("")).isin(*labels))
    return entries.filter(F.col("n") >= least)


def hit_counts(hits: DataFrame) -> DataFrame:
    """hits (unit_key, file, patterns) with n_patterns of their unit and n_in_file."""
    return hits.withColumn("n_patterns", F.sum(F.coalesce(F.size("patterns"), F.lit(1))).over(Window.partitionBy("unit_key"))).withColumn("n_in_file", F.count("*").over(Window.partitionBy("file")))


def round_counts(rounds: DataFrame, hits: DataFrame) -> DataFrame:
    """(round, query_id, n) for rounds (round, round_id, query_id) and hits (query_id, round_id).

    A hit without a round counts for the first round that asks its query.
    """
    first = rounds.withColumn("first", F.min("round").over(Window.partitionBy("query_id")))
    mine = hits.withColumnsRenamed({"query_id": "hit_query", "round_id": "hit_round"})
    on = (F.col("query_id") == F.col("hit_query")) & (F.col("round_id").isNull() | (F.col("hit_round") == F.col("round_id")) | (F.col("hit_round").isNull() & (F.col("round") == F.col("first"))))
    return first.join(mine, on, "left").groupBy("round", "query_id").agg(F.count("hit_query").alias("n"))


def sense_adjusted(hits: DataFrame) -> DataFrame:
    """hits (hit_id, target, text, score) with fit and score: below 0.35 a misfit is pressed down, from 0.7 a fit gains 0.08."""
    fitted = hits.withColumn("fit", E.sense_fit(F.col("target"), F.col("text")))
    low = F.least(F.col("score"), F.lit(0.2)) * F.col("fit")
    return fitted.withColumn("score", F.when(F.col("fit") < 0.35, low).when(F.col("fit") >= 0.7, F.least(F.lit(1.0), F.col("score") + 0.08)).otherwise(F.col("score")))


def reranked(hits: DataFrame, decisions: DataFrame, merged: DataFrame) -> DataFrame:
    """hits (tag, score) after decisions (tag, new_score, action) and merged-away tags (tag): score, status, suggestible.

    A drop is soft: the score falls to 0.15 at most and the hit stays active; only merged hits are pruned.
    """
    gone = merged.select("tag", F.lit(True).alias("gone")).distinct()
    rows = hits.join(decisions, "tag", "left").join(gone, "tag", "left")
    dropped = F.coalesce(F.col("action") == "drop", F.lit(False)) & F.col("gone").isNull()
    score = F.when(dropped, F.when(F.col("new_score").isNull(), 0.0).otherwise(F.least("new_score", F.lit(0.15)))).otherwise(F.coalesce("new_score", "score"))
    return rows.select("tag", score.alias("score"), F.when(F.col("gone"), "pruned").otherwise("active").alias("status"), (F.col("gone").isNull() & ~dropped).alias("suggestible"))


def merged_reference(hits: DataFrame, *, group: str = "query_id") -> DataFrame:
    """(group, reference): blocks of the suggested hits, or of all active ones where none is suggested, best first."""
    usable = hits.filter((F.col("status") == "active") & (F.col("kind") != "navigation_hint"))
    flagged = F.max(F.coalesce("suggested", F.lit(False))).over(Window.partitionBy(group))
    picked = usable.withColumn("flagged", flagged).filter(~F.col("flagged") | F.col("suggested"))
    blocks = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), F.col("hit_id").alias("b"), F.col("block").alias("c"))))
    return picked.groupBy(group).agg(F.array_join(F.transform(blocks, lambda x: x.c), "\n\n").alias("reference"))


def coverage(hits: DataFrame, *, group: str = "query_id") -> DataFrame:
    """(group, source, active, suggested)."""
    return hits.groupBy(group, "source").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if((F.col("status") == "active") & F.col("suggested")).alias("suggested"))


def allowed_sources(queries: DataFrame, enabled: tuple[str, ...]) -> DataFrame:
    """queries (query_id, intent) with sources: those the intent names, in its order, that are enabled."""
    table = F.create_map(*(x for k, v in INTENT_SOURCES.items() for x in (F.lit(k), F.split(F.lit(v), " "))))
    named = F.coalesce(F.try_element_at(table, F.col("intent")), F.split(F.lit(OTHER_SOURCES), " "))
    return queries.withColumn("sources", F.filter(named, lambda s: s.isin(*enabled)))


def unasked(queries: DataFrame, earlier: DataFrame) -> DataFrame:
    """queries (query_id, intent, terms) that share no anchor term with an earlier one of the same intent."""
    exploded = lambda df, *cols: df.select(*cols, "intent", F.explode(E.anchor_terms(F.col("terms"))).alias("anchor"))
    asked = exploded(queries, "query_id").join(exploded(earlier).distinct(), ["intent", "anchor"], "left_semi").select("query_id").distinct()
    return queries.join(asked, "query_id", "left_anti")


def exact_entries(terms: DataFrame, entries: DataFrame) -> DataFrame:
    """Terms (term) with every entry (headword, body) of an equal key; null terms and headwords match nothing.

    A key's entries are gathered in arrays of about ENTRIES, and each array meets about TERMS of the key's terms at a
    time, so a key with many of both is spread over the tasks and the join moves arrays, not pairs. Equal rows stay together.
    """
    asked = terms.withColumn("_key", E.lookup_key(F.col("term"))).filter("_key IS NOT NULL")
    known = entries.withColumn("_key", E.lookup_key(F.col("headword"))).filter("_key IS NOT NULL")
    parts = lambda df, most, name: df.groupBy("_key").agg(F.ceil(F.count("*") / most).cast("int").alias(name)).filter(F.col(name) > 1)
    wide = small(parts(known, ENTRIES, "_entries").join(parts(asked, TERMS, "_terms"), "_key", "full"))
    part = lambda df, name: F.pmod(F.xxhash64(*df.columns), F.coalesce(name, F.lit(1))).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.coalesce(name, F.lit(1)) - 1))
    blocks = known.join(wide, "_key", "left").withColumn("_entry", part(entries, "_entries"))
    blocks = blocks.groupBy("_key", "_entry", "_terms").agg(F.collect_list(F.struct(*entries.columns)).alias("_block")).withColumn("_term", every("_terms"))
    dealt = asked.join(wide, "_key", "left").withColumn("_term", part(terms, "_terms")).withColumn("_entry", every("_entries"))
    met = dealt.join(blocks.select("_key", "_entry", "_term", "_block"), ["_key", "_entry", "_term"])
    return met.select(*terms.columns, F.inline("_block"))


def prefix_entries(terms: DataFrame, entries: DataFrame, least: int = 2, longest: int = 64) -> DataFrame:
    """(term, headword, body): the equal headword, else the first in order that begins with the term.

    Headwords give each of their prefixes up to ``longest`` characters, so the match is an equi-join; longer terms
    meet headwords by their first characters and are compared whole.
    """
    cut = lambda c: F.left(F.col(c), F.lit(longest))
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("headword"), F.lit(longest))), lambda n: F.left("headword", n))
    heads = entries.filter("headword <> ''").withColumn("start", F.explode(starts))
    asked = terms.filter(F.length("term") >= least).withColumn("start", cut("term"))
    found = asked.join(heads, "start").filter(F.col("headword").startswith(F.col("term")))
    order = Window.partitionBy("term").orderBy((F.col("headword") != F.col("term")).cast("int"), "headword")
    return found.withColumn("k", F.row_number().over(order)).filter("k = 1").select("term", "headword", "body")


def try_order(dicts: DataFrame, preferred: str | None = None, default: str | None = None, *, group: str = "profile") -> DataFrame:
    """dicts (group, dict_id, priority) with rank: preferred, default, then by priority, 100 where it has none."""
    place = F.when(F.col("dict_id") == preferred, 0).when(F.col("dict_id") == default, 1).otherwise(2)
    return dicts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(place, F.coalesce("priority", F.lit(100)), "dict_id")))


def era_years(asked: DataFrame, eras: DataFrame) -> DataFrame:
    """(key, year_index, raw, year): eras (key, raw) in which the year of that index lies inside the span."""
    found = asked.join(eras, "key").withColumn("year", E.span(F.col("raw"))["start"] + F.col("year_index") - 1)
    return found.filter(F.col("year").isNotNull() & E.in_span(F.col("year"), F.col("raw"))).select("key", "year_index", "raw", "year")


def packed(hits: DataFrame) -> DataFrame:
    """(digest, body): one body for each digest, the longest; of equal lengths the first in order."""
    return hits.groupBy("digest").agg(F.min_by("body", F.struct(-F.length("body"), "body")).alias("body"))


def dictionary_view(table: DataFrame, differing: bool | None = None, length: int | None = None) -> DataFrame:
    """(variant, preferred) of a table (variant, preferred array): the first value that is not null, keys of one length
    only where asked, and pairs that differ or agree."""
    view = table.select("variant", F.get(F.filter("preferred", lambda x: x.isNotNull()), 0).alias("preferred")).filter("preferred IS NOT NULL")
    if length is not None:
        view = view.filter(F.length("variant") == length)
    return view if differing is None else view.filter((F.col("variant") != F.col("preferred")) == differing)


def uneven_gaps(nodes: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, grandparent): places where the children's missing middle numbers differ. nodes: (key, grandparent, parent, value)."""
    sets = nodes.groupBy(key, "grandparent", "parent").agg(F.array_sort(F.collect_set("value")).alias("v"), F.count("*").alias("n")).filter("n >= 2")
    gaps = sets.withColumn("gaps", F.array_except(F.sequence(F.array_min("v"), F.array_max("v")), "v")).filter("size(gaps) > 0")
    return gaps.groupBy(key, "grandparent").agg(F.countDistinct("gaps").alias("kinds")).filter("kinds > 1").select(key, "grandparent")


def within_budget(hits: DataFrame, most_chars: int, *, group: str = "query_id", order: str = "ordinal", text: str = "snippet") -> DataFrame:
    """hits of each group in order until the characters exceed the budget; empty snippets are left out and cost nothing."""
    running = F.sum(F.length(text)).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return hits.filter(F.col(text) != "").withColumn("running", running).filter(F.col("running") <= most_chars).drop("running")


def pruned(hits: DataFrame, named: DataFrame, least: float | None = None) -> DataFrame:
    """hits (hit_id, score) with status pruned where they are named (hit_id) or score below ``least``."""
    rows = hits.join(named.select("hit_id", F.lit(True).alias("named")).distinct(), "hit_id", "left")
    low = F.coalesce(F.col("score") < least, F.lit(False)) if least is not None else F.lit(False)
    return rows.withColumn("status", F.when(F.coalesce("named", F.lit(False)) | low, "pruned").otherwise("active")).drop("named")


def unexpired(cache: DataFrame, now, ttl_seconds: int, snapshot: str | None = None, corpus: tuple[str, ...] = ("grep_md", "bm25", "vector")) -> DataFrame:
    """Cache entries (fetched_at, source, snapshot) younger than the limit; those of corpus channels only for the current snapshot."""
    fresh = F.unix_micros(F.col("fetched_at").cast("timestamp")) > F.unix_micros(now) - ttl_seconds * 1_000_000
    return cache.filter(fresh if snapshot is None else fresh & (~F.col("source").isin(*corpus) | (F.col("snapshot") == snapshot)))


def pending(units: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Units that have no result yet, so a stopped batch resumes where it ended."""
    return units.join(results.filter(F.col(key).isNotNull()).select(key), key, "left_anti")


def grouped_export(hits: DataFrame) -> DataFrame:
    """(query_id, document): the blocks of each group, best first, under a heading of its target."""
    blocks = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), "hit_id", "block")))
    joined = hits.filter("status <> 'pruned' AND kind <> 'navigation_hint' AND block <> ''").groupBy("query_id", "target").agg(F.array_join(F.transform(blocks, lambda x: x.block), "\n\n").alias("body"))
    return joined.select("query_id", F.concat(F.lit("## "), "target", F.lit("\n\n"), "body").alias("document"))


def processing_summary(units: DataFrame, *, text: str = "target", result: str = "result") -> DataFrame:
    """One row (total, processed, total_chars, processed_chars) over units."""
    done = F.col(result).isNotNull()
    return units.agg(F.count("*").alias("total"), F.count_if(done).alias("processed"), F.sum(F.length(text)).alias("total_chars"), F.coalesce(F.sum(F.when(done, F.length(text))), F.lit(0)).alias("processed_chars"))


def preset_dictionary(traditional: DataFrame, variants: DataFrame) -> DataFrame:
    """(simplified, others): all traditional and variant forms of tables (simplified, forms) as one string."""
    both = traditional.withColumnRenamed("forms", "t").join(variants.withColumnRenamed("forms", "v"), "simplified", "full")
    return both.select("simplified", F.concat(F.coalesce("t", F.lit("")), F.coalesce("v", F.lit(""))).alias("others"))


def active_sorted(hits: DataFrame, *, group: str = "query_id") -> DataFrame:
    """The active hits with rank in their group: best first, then by id."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), "hit_id")
    return hits.filter("status = 'active'").withColumn("rank", F.row_number().over(order))


def corpus_summary(hits: DataFrame, most: int = 24, *, group: str = "query_id") -> DataFrame:
    """The best active evidence of each group, ``most`` at the most, each with a line of source and block."""
    found = active_sorted(hits.filter("kind <> 'navigation_hint'"), group=group).filter(F.col("rank") <= most)
    return found.withColumn("line", F.concat("source", F.lit(" "), "block"))


def fallback_entries(terms: DataFrame, entries: DataFrame) -> DataFrame:
    """terms (query_id, term, alternatives array) with the entries (headword, ...) of the first of their forms that has any.

    All forms are looked up in one join; attempt counts from 0, the term itself.
    """
    forms = F.concat(F.array("term"), F.coalesce("alternatives", F.array().cast("array<string>")))
    asked = terms.select("query_id", F.posexplode(forms).alias("attempt", "key"))
    met = asked.join(entries, asked["key"] == entries["headword"])
    first = F.min("attempt").over(Window.partitionBy("query_id"))
    return met.withColumn("_first", first).filter("attempt = _first").drop("_first", "key")


def entry_scores(entries: DataFrame, priority: str = "priority") -> DataFrame:
    """entries (target, matched_key, cleaned, candidates, priority) with relevance, of wording and sense, and final_score."""
    wording = E.relevance(F.col("target"), F.col("matched_key"), F.col("cleaned"), F.col("candidates"))
    sense = E.sense_fit(F.col("target"), F.concat_ws("\n", "matched_key", "cleaned"))
    relevance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), wording * 0.55 + sense * 0.45))
    return entries.withColumn("relevance", relevance).withColumn("final_score", F.greatest(F.col(priority) * 0.5, relevance))


def remembered(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers of the cache (key, value), queries it lacks): asked (key, ...) against entries that still hold."""
    return asked.join(cache, "key"), asked.join(cache.select("key"), "key", "left_anti")


def citation_rows(citations: DataFrame, least: int = 5, ignored: tuple[str, ...] = ("short",), *, key: str = "doc_id") -> DataFrame:
    """Citations (key, start_line, end_line, text, footnote) without ignored kinds, one for each place and first 20 characters."""
    if "short" in ignored:
        citations = citations.filter(F.length(F.trim("text")) >= least)
    if "noFootnote" in ignored:
        citations = citations.filter(F.coalesce("footnote", F.lit("")) != "")
    same = Window.partitionBy(key, "start_line", "end_line", F.left("text", F.lit(20))).orderBy("text")
    return citations.withColumn("_k", F.row_number().over(same)).filter("_k = 1").drop("_k")


def like_prefix(rows: DataFrame, prefix: str, *, path: str = "file") -> DataFrame:
    """Rows whose path is LIKE the prefix: _ and % in it are wildcards, and no folder border is asked for."""
    return rows.filter(F.col(path).like(prefix + "%"))


def without_disambiguation(pages: DataFrame, *, flag: str = "disambiguation") -> DataFrame:
    return pages.filter(~F.coalesce(F.col(flag), F.lit(False)))


def first_sentences(sentences: DataFrame, most: int = 50_000, *, key: str = "doc_id") -> DataFrame:
    """The first sentences in order of file and place: the most that an index holds."""
    return sentences.orderBy(key, "idx").limit(most)


def asked_patterns(rounds: DataFrame) -> DataFrame:
    """(session, pattern): the distinct patterns of all queries (session, queries array<struct<patterns>>)."""
    each = rounds.select("session", F.explode("queries").alias("q")).select("session", F.explode("q.patterns").alias("pattern"))
    return each.filter(F.trim("pattern") != "").distinct()


def session_summary(hits: DataFrame, rounds: DataFrame) -> DataFrame:
    """(session, active_hits, rounds, updated_at) from hits (session, status) and rounds (session, finished_at, started_at)."""
    active = hits.groupBy("session").agg(F.count_if(F.col("status") == "active").alias("active_hits"))
    ran = rounds.groupBy("session").agg(F.count("*").alias("rounds"), F.max(F.coalesce("finished_at", "started_at")).alias("updated_at"))
    return ran.join(active, "session", "left").select("session", F.coalesce("active_hits", F.lit(0)).cast("long").alias("active_hits"), "rounds", "updated_at")


def revived(cached: DataFrame, query_id: str, round_id: str) -> DataFrame:
    """Cached hits as hits of the query and round that asks again, active."""
    return cached.withColumns({"query_id": F.lit(query_id), "round_id": F.lit(round_id), "status": F.lit("active")})


def scope_needs_choice(files: DataFrame, dictionaries: int, most_dictionaries: int = 8, most_files: int = 100, deepest: int = 4) -> DataFrame:
    """One row (files, depth, needs_choice): whether files (file) and dictionaries are too many, or folders too deep, to search them all."""
    depth = F.coalesce(F.max(F.size(F.split(F.regexp_extract("file", "^(.*)/", 1), "/"))), F.lit(0))
    found = files.agg(F.count("*").alias("files"), depth.alias("depth"))
    return found.withColumn("needs_choice", (F.col("files") > most_files) | (F.col("depth") > deepest) | F.lit(dictionaries > most_dictionaries))


# Limits by strength of a search: rounds, queries a round, lookups, hits selected a query, their characters, least score, quotas.
STRENGTHS = {
    "light": {"rounds": 1, "queries": 4, "lookups": 40, "candidates": 8, "selected": 3, "selected_chars": 4000, "least_score": 0.35, "primary": 4, "relevance": 2, "length": 2},
    "standard": {"rounds": 3, "queries": 6, "lookups": 100, "candidates": 14, "selected": 5, "selected_chars": 8000, "least_score": 0.3, "primary": 6, "relevance": 3, "length": 2},
    "thorough": {"rounds": 5, "queries": 10, "lookups": 200, "candidates": 20, "selected": 8, "selected_chars": 12000, "least_score": 0.25, "primary": 8, "relevance": 4, "length": 3},
}


def strength(name: str, **limits) -> dict:
    """The limits of a strength, standard where it is unknown, with those given in their place, never below 0."""
    chosen = dict(STRENGTHS.get(name, STRENGTHS["standard"]))
    unknown = set(limits) - set(chosen)
    if unknown:
        raise ValueError(f"unknown limits {sorted(unknown)}")
    return chosen | {k: max(0, v) for k, v in limits.items() if v is not None}
