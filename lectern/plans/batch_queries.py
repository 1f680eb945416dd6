"""Registered queries on budgets, caches, batches, exports and rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import text as T
from ..operators import retrieve, rewrite, sections, segment, select
from .registry import documents, register, values
from .views import MD_DOCS, WS, md_docs, sql_trim, table

register("r06_within_budget", """SELECT event_id FROM (SELECT event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events WHERE props <> '') WHERE running <= 100""")(
    lambda s, d: select.within_budget(table(s, d, "events"), 100, group="user_id", order="event_id", text="props").select("event_id")
)
register("r15_pruned", "SELECT o_orderkey AS hit_id, CASE WHEN o_totalprice < 50000 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) THEN 'pruned' ELSE 'active' END AS status FROM orders")(
    lambda s, d: select.pruned(table(s, d, "orders").selectExpr("o_orderkey AS hit_id", "o_totalprice AS score"), table(s, d, "lineitem").filter("l_quantity > 49").selectExpr("l_orderkey AS hit_id"), 50000.0).select("hit_id", "status")
)
register("p15_unexpired", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAY")(
    lambda s, d: select.unexpired(table(s, d, "events").withColumnRenamed("ts", "fetched_at"), F.lit(table(s, d, "events").selectExpr("string(max(ts))").first()[0]).cast("timestamp"), 3 * 86400).select("event_id")
)
register("t06_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")(
    lambda s, d: select.pending(table(s, d, "orders").select("o_orderkey"), table(s, d, "lineitem").filter("l_quantity > 45").selectExpr("l_orderkey AS o_orderkey"), "o_orderkey")
)
register("a18_processing_summary", "SELECT count(*) AS total, count(quality) AS processed, sum(length(text))::BIGINT AS total_chars, sum(CASE WHEN quality IS NOT NULL THEN length(text) END)::BIGINT AS processed_chars FROM documents LEFT JOIN labels USING (doc_id)")(
    lambda s, d: select.processing_summary(documents(s, d).join(table(s, d, "labels"), "doc_id", "left"), text="text", result="quality")
)
register("s04_top_folders", "SELECT source AS dir, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, dir LIMIT 30")(
    lambda s, d: table(s, d, "documents").groupBy(F.col("source").alias("dir")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dir").limit(30)
)
register("s16_preset_dictionary", "SELECT * FROM (VALUES ('a', 'AÄ'), ('b', 'B'), ('c', 'Ç')) v(simplified, others)")(
    lambda s, d: select.preset_dictionary(values([("a", "A"), ("b", "B")], "simplified string, forms string")(s, d), values([("a", "Ä"), ("c", "Ç")], "simplified string, forms string")(s, d))
)
register("f42_fingerprint", """SELECT doc_id, left(sha1('{"a":' || doc_id || ',"lang":"' || lang || '"}'), 24) AS key FROM documents WHERE lang IS NOT NULL""")(
    lambda s, d: table(s, d, "documents").filter("lang IS NOT NULL").select("doc_id", E.fingerprint(lang=F.col("lang"), a=F.col("doc_id")).alias("key"))
)
register("e03_inserted", "SELECT doc_id, left(text, 3) || '<b>' || substring(text, 4, 6) || '<a>' || substring(text, 10) AS text FROM documents WHERE length(text) > 10")(
    lambda s, d: rewrite.inserted(documents(s, d).filter("length(text) > 10").withColumn("additions", F.expr("array(named_struct('end', 9, 'addition', '<a>'), named_struct('end', 3, 'addition', '<b>'))")))
)
register("j16_pattern_check", "SELECT * FROM (VALUES (1, 0, 0, 2, 'ab', 'ba'), (1, 1, 3, 4, 'a', 'A'), (1, 1, 5, 6, 'a', 'A')) v(doc_id, rule, start, \"end\", found, preferred)")(
    lambda s, d: rewrite.pattern_check(values([(1, "ab a a"), (2, None)], "doc_id int, text string")(s, d), [(r"(a)(b)", r"\2\1"), ("a", "A")])
)
register("j16_documents", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) FROM documents) GROUP BY doc_id")(
    lambda s, d: rewrite.pattern_check(documents(s, d), [("[0-9]+", "#")]).groupBy("doc_id").agg(F.count("*").alias("n"))
)
_PLAIN = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"
register("p12_new_evidence", f"""WITH {_PLAIN} SELECT doc_id, line_no FROM l WHERE substring(sha1(line), 1, 12) NOT IN (SELECT substring(sha1(text), 1, 12) FROM benchmark WHERE text IS NOT NULL)""")(
    lambda s, d: segment.lines(documents(s, d)).withColumn("digest", T.digest(F.col("line"))).join(table(s, d, "benchmark").select(T.digest(F.col("text")).alias("digest")), "digest", "left_anti").select("doc_id", "line_no")
)
register("r05_grep_context", f"""WITH {_PLAIN}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l WHERE regexp_matches(line, '(?i)th[aeiou]n\\b'))
SELECT h.doc_id, h.line_no, min(l.line_no) AS start_line, max(l.line_no) AS end_line, string_agg(l.line, chr(10) ORDER BY l.line_no) AS snippet FROM h JOIN l ON l.doc_id = h.doc_id AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 WHERE k <= 80 GROUP BY ALL""")(
    lambda s, d: sections.expand(documents(s, d), retrieve.grep(documents(s, d), r"th[aeiou]n\b"))
)
register("g19_first_segment", f"WITH {MD_DOCS}, t AS (SELECT doc_id, string_split(substring(text, 3), chr(10) || '## ')[1] AS target FROM md_docs) SELECT * FROM t")(
    lambda s, d: segment.first_segment(md_docs(s, d), "title", F.lit(2))
)
register("u07_distinct_pairs", f"WITH {_PLAIN} SELECT DISTINCT regexp_replace(line, '{WS}', '', 'g') AS body, line_no FROM l WHERE {sql_trim('line')} <> ''")(
    lambda s, d: segment.lines(documents(s, d)).filter(T.trimmed(F.col("line")) != "").select(T.replaced(F.col("line"), T.SPACE).alias("body"), "line_no").distinct()
)
