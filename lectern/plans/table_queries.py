"""Registered queries on hits, entries and numbered nodes derived from whole tables, built alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import text as T
from ..operators import align, check, fuse, retrieve, select
from ..sources import files
from .registry import register
from .views import table

# Every order is a hit of its customer's query; the expressions read alike in both engines.
_HIT = (
    "o_orderkey AS hit_id",
    "o_orderkey AS ordinal",
    "o_custkey AS query_id",
    "CASE o_orderkey % 4 WHEN 0 THEN 'dict' WHEN 1 THEN 'grep_md' WHEN 2 THEN 'bm25' ELSE 'web' END AS source",
    "o_totalprice / 600000 AS score",
    "o_orderkey % 97 * 20 AS chars",
    "CASE WHEN o_orderstatus = 'P' THEN 'pruned' ELSE 'active' END AS status",
    "CASE WHEN o_orderkey % 11 = 0 THEN 'navigation_hint' ELSE 'evidence' END AS kind",
    "concat(o_orderpriority, ' ', CAST(o_orderkey % 1000 AS VARCHAR(9))) AS block",
    "CAST(o_orderkey % 500 AS VARCHAR(9)) AS unit_key",
    "CASE WHEN o_custkey % 9 = 0 THEN '' ELSE CAST(o_custkey % 25 AS VARCHAR(9)) END AS file",
    "concat('d', CAST(o_orderkey % 700 AS VARCHAR(9))) AS digest",
    "CASE WHEN o_orderkey % 5 = 0 THEN true ELSE false END AS suggested",
)
HITS = f"hits AS (SELECT {', '.join(_HIT)} FROM orders)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*(x.replace("VARCHAR(9)", "STRING") for x in _HIT))


register("w08_capped", f"WITH {HITS} SELECT hit_id FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, hit_id) AS k FROM hits) WHERE k <= 5 OR file = ''")(
    lambda s, d: fuse.capped(hits(s, d)).select("hit_id")
)
register("w10_soft_selected", f"""WITH RECURSIVE {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS k FROM hits),
st AS (SELECT query_id, hit_id, k, score >= 0.3 AS suggested, (score >= 0.3)::INT AS n, CASE WHEN score >= 0.3 THEN chars ELSE 0 END AS used FROM r WHERE k = 1
 UNION ALL SELECT query_id, hit_id, k, take, n + take::INT, used + CASE WHEN take THEN chars ELSE 0 END FROM (
  SELECT r.query_id, r.hit_id, r.k, r.chars, st.n, st.used, r.score >= 0.3 AND st.n < 5 AND (st.n = 0 OR st.used + r.chars <= 3000) AS take FROM st JOIN r ON r.query_id = st.query_id AND r.k = st.k + 1))
SELECT query_id, hit_id, suggested FROM st""")(lambda s, d: fuse.soft_selected(hits(s, d), 0.3, 5, 3000))
register("w11_quota_selected", f"""WITH {HITS}, e AS (SELECT source AS dict_id, digest, max(chars) AS chars, max(score) AS relevance FROM hits GROUP BY ALL),
u AS (SELECT min(dict_id) AS dict_id, digest, max(chars) AS chars, max(relevance) AS relevance FROM e GROUP BY digest),
a AS (SELECT digest FROM u WHERE dict_id = 'dict' ORDER BY chars DESC, digest LIMIT 6),
b AS (SELECT digest FROM u WHERE digest NOT IN (FROM a) ORDER BY relevance DESC, chars DESC, digest LIMIT 4),
c AS (SELECT digest FROM u WHERE digest NOT IN (FROM a) AND digest NOT IN (FROM b) ORDER BY chars DESC, digest LIMIT 3)
SELECT digest, 1 AS stage FROM a UNION ALL SELECT digest, 2 FROM b UNION ALL SELECT digest, 3 FROM c""")(
    lambda s, d: fuse.quota_selected(
        hits(s, d).groupBy("digest").agg(F.min("source").alias("dict_id"), F.max("chars").alias("chars"), F.max("score").alias("relevance")), "dict", 6, 4, 3)
)
register("w12_tagged", f"WITH {HITS} SELECT ordinal, 'R' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS tag FROM (SELECT ordinal, row_number() OVER (ORDER BY ordinal) AS k FROM hits)")(
    lambda s, d: fuse.tagged(hits(s, d)).select("ordinal", "tag")
)
_ENTRY = ("event_id AS id", "CAST(floor(value) AS INT) % 10 AS weight", "ts AS created_at")
register("w14_evicted", f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY weight DESC, created_at DESC, id DESC) AS k FROM (SELECT {', '.join(_ENTRY)} FROM events)) WHERE k > 200")(
    lambda s, d: fuse.evicted(table(s, d, "events").selectExpr(*_ENTRY), 200).select("id")
)
register("u03_new_hits", f"WITH {HITS} SELECT digest, min(ordinal) AS ordinal FROM hits WHERE status = 'pruned' AND digest NOT IN (SELECT digest FROM hits WHERE status = 'active' AND ordinal % 97 = 0) GROUP BY digest")(
    lambda s, d: fuse.new_hits(hits(s, d).filter("status = 'pruned'"), hits(s, d).filter("status = 'active' AND ordinal % 97 = 0")).select("digest", "ordinal")
)
register("u04_fused", f"""WITH {HITS} SELECT unit_key, min(ordinal) AS ordinal, arg_min(source, ordinal) AS source, max(score) AS score,
array_to_string(list_sort(list_distinct(list(digest))), ',') AS patterns FROM hits GROUP BY unit_key""")(
    lambda s, d: fuse.fused(hits(s, d).withColumn("patterns", F.array("digest"))).select("unit_key", "ordinal", "source", "score", F.array_join("patterns", ",").alias("patterns"))
)
_PARTS_OF = "score AS llm, score AS channel, hit_id % 6 AS n_patterns, (hit_id % 8) / 8.0 AS scope, hit_id % 9 + 1 AS n_in_file, kind, block AS snippet"
_FINAL = """greatest(0, least(1, 0.35 * llm + 0.25 * channel + 0.15 * least(1, n_patterns / 4) + 0.15 * scope + 0.1 * least(0.3, (n_in_file - 1) * 0.05)
 - CASE WHEN kind = 'navigation_hint' THEN 0.4 ELSE 0 END - CASE WHEN length(trim(snippet)) < 20 THEN 0.15 ELSE 0 END))"""
register("r08_final_score", f"WITH {HITS}, p AS (SELECT hit_id, {_PARTS_OF} FROM hits) SELECT hit_id, round({_FINAL}::DOUBLE, 9) AS final_score FROM p")(
    lambda s, d: fuse.final_score(hits(s, d).selectExpr("hit_id", *(x.strip() for x in _PARTS_OF.replace("/ 8.0", "/ 8.0D").split(",")))).select("hit_id", F.round("final_score", 9).alias("final_score"))
)
register("r10_scored_hits", f"""WITH {HITS}, c AS (SELECT *, count(*) OVER (PARTITION BY unit_key) AS n_patterns, count(*) OVER (PARTITION BY file) AS n_in_file FROM hits),
p AS (SELECT query_id, hit_id, score AS llm, score AS channel, 0 AS scope, n_patterns, n_in_file, kind, block AS snippet FROM c), f AS (SELECT query_id, hit_id, round({_FINAL}::DOUBLE, 9) AS final_score FROM p)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, hit_id) AS rank FROM f""")(
    lambda s, d: fuse.scored_and_sorted(hits(s, d).selectExpr("query_id", "hit_id", "unit_key", "file", "array(digest) AS patterns", "score AS llm", "score AS channel", "0 AS scope", "kind", "block AS snippet"))
)
register("r14_reranked", f"""WITH {HITS} SELECT digest AS tag, CASE WHEN gone THEN coalesce(new_score, score) WHEN action = 'drop' THEN CASE WHEN new_score IS NULL THEN 0 ELSE least(new_score, 0.15) END ELSE coalesce(new_score, score) END::DOUBLE AS score,
CASE WHEN gone THEN 'pruned' ELSE 'active' END AS status, NOT gone AND coalesce(action <> 'drop', true) AS suggestible
FROM (SELECT t.digest, t.score, t.k % 13 = 0 AS gone, CASE WHEN k % 3 = 0 THEN 'drop' WHEN k % 3 = 1 THEN 'keep' END AS action, CASE WHEN k % 6 < 4 AND k % 3 < 2 THEN t.score / 2 END AS new_score
 FROM (SELECT digest, max(score) AS score, substring(digest, 2)::INT AS k FROM hits GROUP BY digest) t)""")(
    lambda s, d: (lambda t: select.reranked(
        t.select("tag", "score"),
        t.filter("k % 3 < 2").selectExpr("tag", "CASE WHEN k % 6 < 4 THEN score / 2 END AS new_score", "CASE WHEN k % 3 = 0 THEN 'drop' ELSE 'keep' END AS action"),
        t.filter("k % 13 = 0").select("tag"),
    ))(hits(s, d).groupBy(F.col("digest").alias("tag")).agg(F.max("score").alias("score")).withColumn("k", F.expr("int(substring(tag, 2))")))
)
register("r16_merged_reference", f"""WITH {HITS}, u AS (SELECT *, bool_or(suggested) OVER (PARTITION BY query_id) AS flagged FROM hits WHERE status = 'active' AND kind <> 'navigation_hint')
SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY score DESC, hit_id) AS reference FROM u WHERE suggested OR NOT flagged GROUP BY query_id""")(lambda s, d: select.merged_reference(hits(s, d)))
register("r19_grouped_export", f"""WITH {HITS} SELECT query_id, '## ' || file || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY score DESC, hit_id) AS document
FROM hits WHERE status <> 'pruned' AND kind <> 'navigation_hint' AND block <> '' GROUP BY query_id, file""")(lambda s, d: select.grouped_export(hits(s, d).withColumnRenamed("file", "target")))
register("h05_coverage", f"WITH {HITS} SELECT query_id, source, sum((status = 'active')::INT)::BIGINT AS active, sum((status = 'active' AND suggested)::INT)::BIGINT AS suggested FROM hits GROUP BY ALL")(
    lambda s, d: select.coverage(hits(s, d))
)
register("h06_corpus_summary", f"""WITH {HITS} SELECT query_id, hit_id, rank, source || ' ' || block AS line FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank FROM hits WHERE status = 'active' AND kind <> 'navigation_hint') WHERE rank <= 24""")(
    lambda s, d: select.corpus_summary(hits(s, d)).select("query_id", "hit_id", "rank", "line")
)
register("h09_active_hits", f"WITH {HITS} SELECT hit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank FROM hits WHERE status = 'active'")(lambda s, d: select.active_sorted(hits(s, d)).select("hit_id", "rank"))
register("k05_export_order", f"""WITH {HITS} SELECT hit_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, CASE source WHEN 'dict' THEN 0 WHEN 'grep_md' THEN 1 WHEN 'bm25' THEN 2 ELSE 5 END, hit_id) AS rank FROM hits""")(
    lambda s, d: select.export_order(hits(s, d)).select("hit_id", "rank")
)
register("k08_try_order", f"""WITH {HITS}, e AS (SELECT query_id AS profile, digest AS dict_id, min(CASE WHEN chars % 3 > 0 THEN chars END) AS priority FROM hits GROUP BY ALL)
SELECT profile, dict_id, row_number() OVER (PARTITION BY profile ORDER BY CASE dict_id WHEN 'd7' THEN 0 WHEN 'd8' THEN 1 ELSE 2 END, coalesce(priority, 100), dict_id) AS rank FROM e""")(
    lambda s, d: select.try_order(hits(s, d).groupBy(F.col("query_id").alias("profile"), F.col("digest").alias("dict_id")).agg(F.min(F.expr("CASE WHEN chars % 3 > 0 THEN chars END")).alias("priority")), "d7", "d8").select("profile", "dict_id", "rank")
)
register("a15_round_counts", f"""WITH {HITS}, r AS (SELECT DISTINCT query_id, hit_id % 3 AS round, CASE WHEN hit_id % 3 < 2 THEN 'r' || (hit_id % 3) END AS round_id FROM hits),
f AS (SELECT *, min(round) OVER (PARTITION BY query_id) AS first FROM r), h AS (SELECT query_id, CASE WHEN hit_id % 5 > 0 THEN 'r' || (hit_id % 3) END AS round_id FROM hits)
SELECT f.round, f.query_id, count(h.query_id) AS n FROM f LEFT JOIN h ON h.query_id = f.query_id AND (f.round_id IS NULL OR h.round_id = f.round_id OR (h.round_id IS NULL AND f.round = f.first)) GROUP BY ALL""")(
    lambda s, d: select.round_counts(
        hits(s, d).selectExpr("query_id", "hit_id % 3 AS round", "CASE WHEN hit_id % 3 < 2 THEN concat('r', hit_id % 3) END AS round_id").distinct(),
        hits(s, d).selectExpr("query_id", "CASE WHEN hit_id % 5 > 0 THEN concat('r', hit_id % 3) END AS round_id"))
)
_FOUND = f"found AS (SELECT digest AS variant, block AS preferred, (count(*) OVER (PARTITION BY digest)) AS n, CASE WHEN chars % 3 = 0 THEN 'single' WHEN chars % 3 = 1 THEN 'custom' END AS label FROM hits)"
register("p07_filtered_entries", f"WITH {HITS}, {_FOUND} SELECT variant, preferred FROM found WHERE (contains(variant, 'd1') OR contains(preferred, 'd1')) AND coalesce(label, '') IN ('single', 'custom') AND n >= 2")(
    lambda s, d: select.filter_entries(hits(s, d).selectExpr("digest AS variant", "block AS preferred", "count(*) OVER (PARTITION BY digest) AS n", "CASE WHEN chars % 3 = 0 THEN 'single' WHEN chars % 3 = 1 THEN 'custom' END AS label"), " d1 ", ("single", "custom"), 2).select("variant", "preferred")
)
register("j28_merged_entries", f"WITH {HITS} SELECT digest AS variant, unit_key AS preferred, sum(chars)::BIGINT AS n, arg_min(source, ordinal) AS label FROM hits GROUP BY digest, unit_key")(
    lambda s, d: check.merged_entries(hits(s, d).selectExpr("ordinal", "source AS label", "digest AS variant", "unit_key AS preferred", "chars AS n"))
)
register("j29_allowed_sources", f"""WITH {HITS} SELECT hit_id AS query_id, CASE source WHEN 'dict' THEN 'bm25' WHEN 'web' THEN 'dict,bm25,web' WHEN 'grep_md' THEN 'bm25,dict,web' ELSE 'dict,bm25' END AS sources FROM hits""")(
    lambda s, d: select.allowed_sources(hits(s, d).selectExpr("hit_id AS query_id", "CASE source WHEN 'dict' THEN 'citation' WHEN 'web' THEN 'term_norm' WHEN 'grep_md' THEN 'general_fact' ELSE 'other' END AS intent"), ("dict", "bm25", "web")).select("query_id", F.array_join("sources", ",").alias("sources"))
)
_OLD, _NEW = "o_orderkey % 5 < 4", "o_orderkey % 7 < 6"
register("s05_changes", f"""WITH a AS (SELECT o_orderkey::VARCHAR AS file, o_custkey AS mtime, 10 AS size FROM orders WHERE {_OLD}), b AS (SELECT o_orderkey::VARCHAR AS file, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS mtime, 10 AS size FROM orders WHERE {_NEW})
SELECT file, CASE WHEN b.mtime IS NULL THEN 'delete' WHEN a.mtime IS NULL THEN 'add' ELSE 'replace' END AS action FROM a FULL JOIN b USING (file) WHERE a.mtime IS DISTINCT FROM b.mtime""")(
    lambda s, d: files.changes(
        table(s, d, "orders").filter(_OLD).selectExpr("string(o_orderkey) AS file", "o_custkey AS mtime", "10 AS size"),
        table(s, d, "orders").filter(_NEW).selectExpr("string(o_orderkey) AS file", "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS mtime", "10 AS size"))
)
register("u06_refresh_sets", f"""WITH a AS (SELECT o_orderkey::VARCHAR AS file FROM orders WHERE {_OLD}), b AS (SELECT o_orderkey::VARCHAR AS file FROM orders WHERE {_NEW})
SELECT file, 'deleted' AS what FROM (FROM a EXCEPT FROM b) UNION ALL SELECT file, 'added' FROM (FROM b EXCEPT FROM a)""")(
    lambda s, d: files.vanished_and_new(table(s, d, "orders").filter(_OLD).selectExpr("string(o_orderkey) AS file"), table(s, d, "orders").filter(_NEW).selectExpr("string(o_orderkey) AS file"))
)
_UNIT = "o_orderkey AS idx, CASE WHEN o_orderkey % 9 = 0 THEN concat('# ', o_orderpriority) ELSE o_orderpriority END AS target, o_orderstatus AS context"
register("j05_zip_units", f"""WITH u AS (SELECT {_UNIT} FROM orders), v AS (SELECT idx, target || 'x' AS target FROM u WHERE idx % 2 = 0),
a AS (SELECT idx, row_number() OVER (ORDER BY idx) AS k FROM u WHERE NOT starts_with(target, '#')), b AS (SELECT target, row_number() OVER (ORDER BY idx) AS k FROM v WHERE NOT starts_with(target, '#'))
SELECT u.idx, u.target, coalesce(b.target, u.context) AS context FROM u LEFT JOIN a USING (idx) LEFT JOIN b USING (k)""")(
    lambda s, d: (lambda u: align.zip_units(u, u.filter("idx % 2 = 0").withColumn("target", F.concat("target", F.lit("x")))).select("idx", "target", "context"))(
        table(s, d, "orders").selectExpr(*(x.strip() for x in ("o_orderkey AS idx", "CASE WHEN o_orderkey % 9 = 0 THEN concat('# ', o_orderpriority) ELSE o_orderpriority END AS target", "o_orderstatus AS context"))))
)
register("j06_body_into_units", f"""WITH u AS (SELECT {_UNIT} FROM orders), m AS (SELECT text FROM benchmark WHERE item_id = 3)
SELECT idx, target, CASE WHEN starts_with(target, '# ') THEN context ELSE m.text END AS context FROM u, m""")(
    lambda s, d: align.body_into_units(
        table(s, d, "orders").selectExpr("o_orderkey AS idx", "CASE WHEN o_orderkey % 9 = 0 THEN concat('# ', o_orderpriority) ELSE o_orderpriority END AS target", "o_orderstatus AS context"),
        table(s, d, "benchmark").filter("item_id = 3").select("text"), levels=(1,))
)

# Numbered nodes: every line item is a numbered line of its order.
_NODE = ("l_orderkey AS doc_id", "l_suppkey % 2 AS parent", "l_returnflag AS slot", "l_suppkey % 3 AS level", "CAST(l_partkey * 10 + l_linenumber AS INT) AS line_no", "CAST(l_quantity AS INT) % 6 AS value")
NODES = f"nodes AS (SELECT DISTINCT ON (doc_id, line_no) * FROM (SELECT {', '.join(_NODE)} FROM lineitem) ORDER BY doc_id, line_no, parent, slot, level, value)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = F.min(F.struct("parent", "slot", "level", "value")).alias("n")
    return table(spark, sf_dir, "lineitem").selectExpr(*_NODE).groupBy("doc_id", "line_no").agg(least).select("doc_id", "line_no", "n.*")


register("w01_sibling_issues", f"""WITH {NODES}, x AS (SELECT *, count(*) OVER g AS c, row_number() OVER o AS k, value - lag(value) OVER o AS step FROM nodes
 WINDOW g AS (PARTITION BY doc_id, parent, slot, level), o AS (PARTITION BY doc_id, parent, slot, level ORDER BY line_no)),
y AS (SELECT doc_id, parent, slot, level, line_no, CASE WHEN c = 1 THEN 'isolated' WHEN k = 1 AND value <> 1 THEN 'start' WHEN step = 0 THEN 'duplicate' WHEN step < 0 THEN 'order' WHEN step > 1 THEN 'gap' END AS issue FROM x)
SELECT * FROM y WHERE issue IS NOT NULL""")(lambda s, d: check.sibling_issues(nodes(s, d)))
register("a16_mixed_slots", f"WITH {NODES} SELECT doc_id, level, count(DISTINCT slot) AS n_slots FROM nodes GROUP BY ALL HAVING count(DISTINCT slot) > 1")(lambda s, d: check.mixed_slots(nodes(s, d)))
register("a17_uneven_gaps", f"""WITH {NODES}, g AS (SELECT doc_id % 50 AS doc_id, parent AS grandparent, doc_id AS parent, list_sort(list_distinct(list(value))) AS v, count(*) AS n FROM nodes GROUP BY ALL),
h AS (SELECT doc_id, grandparent, list_sort(list_filter(range(v[1], v[-1] + 1), lambda x: NOT list_contains(v, x))) AS gaps FROM g WHERE n >= 2)
SELECT doc_id, grandparent FROM h WHERE len(gaps) > 0 GROUP BY ALL HAVING count(DISTINCT gaps) > 1""")(
    lambda s, d: select.uneven_gaps(nodes(s, d).selectExpr("doc_id % 50 AS doc_id", "parent AS grandparent", "doc_id AS parent", "value"))
)
register("w07_merge_hits", """WITH p AS (SELECT l_suppkey::VARCHAR AS file, l_partkey::INT AS line, max(l_discount) AS value, min(l_returnflag) AS t FROM lineitem GROUP BY ALL),
q AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY file ORDER BY line) <= 5 THEN 0 ELSE 1 END AS fresh FROM p), r AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY line) AS run FROM q),
m AS (SELECT file, min(line) AS start_line, max(line) AS end_line, string_agg(t, chr(10) ORDER BY line) AS snippet, max(value) AS value FROM r GROUP BY file, run)
SELECT * FROM m ORDER BY value DESC, file, start_line LIMIT 30""")(
    lambda s, d: retrieve.merge_hits(table(s, d, "lineitem").selectExpr("string(l_suppkey) AS file", "int(l_partkey) AS line", "l_returnflag AS line_text", "l_discount AS value"), 30)
)

# Dictionaries: parts by name.
register("j07_exact_entries", "SELECT c.c_custkey AS id, p.p_name AS term, p.p_brand AS body FROM customer c JOIN part p ON p.p_partkey % 200 = c.c_custkey % 400")(
    lambda s, d: select.exact_entries(
        table(s, d, "customer").selectExpr("c_custkey AS id", "concat(string(c_custkey % 400), 'k') AS term"), table(s, d, "part").selectExpr("concat(string(p_partkey % 200), 'k') AS headword", "p_name", "p_brand AS body")
    ).selectExpr("id", "p_name AS term", "body")
)
register("j08_prefix_entries", """WITH t AS (SELECT DISTINCT left(w, 2 + len(w) % 4) AS term FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark) WHERE length(left(w, 2 + len(w) % 4)) >= 2),
h AS (SELECT DISTINCT w AS headword FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents WHERE text IS NOT NULL))
SELECT term, arg_min(headword, (headword <> term, headword)) AS headword FROM t JOIN h ON starts_with(headword, term) GROUP BY term""")(
    lambda s, d: select.prefix_entries(
        table(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("w")).selectExpr("left(w, 2 + length(w) % 4) AS term").filter("length(term) >= 2").distinct(),
        table(s, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("headword")).distinct().withColumn("body", F.lit("b"))).select("term", "headword")
)
register("j09_fallback_entries", """WITH t AS (SELECT c_custkey AS query_id, 'k' || (c_custkey % 300) AS term, ['a' || (c_custkey % 70), 'k' || (c_custkey % 7)] AS alts FROM customer),
a AS (SELECT query_id, 0 AS attempt, term AS key FROM t UNION ALL SELECT query_id, unnest([1, 2]), unnest(alts) FROM t),
e AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'k' || p_partkey ELSE 'a' || p_partkey END AS headword, p_brand AS dict_id, p_size AS priority, p_partkey AS body FROM part),
j AS (SELECT * FROM a JOIN e ON headword = key), f AS (SELECT *, min(attempt) OVER (PARTITION BY query_id) AS first FROM j)
SELECT query_id, attempt, headword, dict_id, body FROM f WHERE attempt = first""")(
    lambda s, d: select.fallback_entries(
        table(s, d, "customer").selectExpr("c_custkey AS query_id", "concat('k', c_custkey % 300) AS term", "array(concat('a', c_custkey % 70), concat('k', c_custkey % 7)) AS alternatives"),
        table(s, d, "part").selectExpr("CASE WHEN p_partkey % 2 = 0 THEN concat('k', p_partkey) ELSE concat('a', p_partkey) END AS headword", "p_brand AS dict_id", "p_partkey AS body"),
    ).select("query_id", "attempt", "headword", "dict_id", "body")
)
register("j19_era_years", """SELECT p_partkey AS id, n.n AS year_index, 1000 + p_partkey + n.n - 1 AS year FROM part, (SELECT unnest([1, 15, 90]) AS n) n WHERE n.n - 1 <= p_size""")(
    lambda s, d: (lambda p: select.era_years(p.select("key", F.explode(F.array(F.lit(1), F.lit(15), F.lit(90))).alias("year_index")), p.select("key", "raw")).selectExpr("int(key) AS id", "year_index", "int(year) AS year"))(
        table(s, d, "part").selectExpr("string(p_partkey) AS key", "concat(1000 + p_partkey, '—', 1000 + p_partkey + p_size) AS raw"))
)
register("f26_spans", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 1000 + p_partkey ELSE -(300 + p_size) END AS first, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 1000 + p_partkey + p_size ELSE -(300 - p_size) END AS last FROM part")(
    lambda s, d: table(s, d, "part").withColumn("raw", F.expr("CASE WHEN p_partkey % 6 = 0 THEN concat(1000 + p_partkey, '—？') WHEN p_partkey % 2 = 0 THEN concat(1000 + p_partkey, '—', 1000 + p_partkey + p_size) ELSE concat('前', 300 + p_size, '—前', 300 - p_size) END"))
    .select(F.col("p_partkey").alias("id"), E.span(F.col("raw"))["start"].cast("long").alias("first"), E.span(F.col("raw"))["end"].cast("long").alias("last"))
)
register("f35_confidence", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN round(value / 100, 6) WHEN event_id % 3 = 1 THEN CASE WHEN value > 1 THEN round(value / 100, 6) ELSE value END ELSE NULL END AS c FROM events WHERE value >= 0 AND value <= 100")(
    lambda s, d: table(s, d, "events").filter("value >= 0 AND value <= 100").withColumn("x", F.expr("CASE event_id % 3 WHEN 0 THEN concat(string(value), '%') WHEN 1 THEN string(value) ELSE 'high' END")).select(F.col("event_id").alias("id"), F.round(T.confidence(F.col("x")), 6).alias("c"))
)
register("p05_in_scope", "SELECT l_orderkey, l_suppkey % 3 = 0 AND l_partkey % 4 <> 0 AS inside FROM lineitem")(
    lambda s, d: table(s, d, "lineitem").withColumn("path", F.expr("concat(CASE l_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'ab' ELSE 'b' END, CASE WHEN l_partkey % 4 = 0 THEN '/x/' ELSE '/xy/' END, l_orderkey, '.md')"))
    .select("l_orderkey", files.in_scope(F.col("path"), ["a"], ["a/x"]).alias("inside"))
)
register("f08_jaccard", """WITH q AS (SELECT doc_id, string_split(text, chr(10))[1] AS a, coalesce(string_split(text, chr(10))[2], '') AS b FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, a, b, list_distinct(CASE WHEN length(a) < 2 THEN [a] ELSE list_transform(range(1, length(a)), lambda i: substring(a, i, 2)) END) AS x, list_distinct(CASE WHEN length(b) < 2 THEN [b] ELSE list_transform(range(1, length(b)), lambda i: substring(b, i, 2)) END) AS y FROM q)
SELECT doc_id, round(CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS score FROM g""")(
    lambda s, d: table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.split("text", "\n")[0].alias("a"), F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit("")).alias("b")).select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b"), 2), 6).alias("score"))
)
