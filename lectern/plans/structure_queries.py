"""Registered queries on numbering, blocks of citations, scoped retrieval and memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T
from ..operators import align, check, duplicates, numbering, retrieve, segment
from .registry import documents, register
from .views import KEYED, WS, sql_trim, table

_SERIAL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"
register("f23_numbered_documents", f"""WITH {_SERIAL} SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN 13 ELSE 9 END AS slot, line_no::BIGINT AS value FROM l""")(
    lambda s, d: numbering.numbered_lines(documents(s, d).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 2 == 0, F.concat((i + 1).cast("string"), F.lit(". "), x)).otherwise(F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), x))), "\n").alias("text"))).select("doc_id", "line_no", "slot", "value")
)
register("j03_block_matches", f"""WITH {KEYED}, p AS (SELECT doc_id, norm, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS pos FROM normed WHERE norm <> ''),
c AS (SELECT doc_id FROM p GROUP BY doc_id HAVING count(*) >= 4) SELECT doc_id AS block_id, doc_id AS file, 1 AS first_pos, 1.0::DOUBLE AS score FROM c""")(
    lambda s, d: (lambda p: align.block_matches(
        p.filter("pos = 2").selectExpr("doc_id AS block_id", "1 AS anchor_idx", "doc_id AS file", "pos AS ref_pos").join(p.filter("pos = 3").selectExpr("doc_id AS block_id"), "block_id", "left_semi"),
        p.filter("pos BETWEEN 1 AND 3").selectExpr("doc_id AS block_id", "pos - 1 AS idx", "norm"),
        p.selectExpr("doc_id AS file", "pos", "norm"),
    ))(duplicates.keyed_sentences(documents(s, d)).withColumn("norm", T.normalize(F.col("sentence"))).filter("norm <> ''").withColumn("pos", F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1")))
)
_TERMS = [(1, "the"), (1, "tion"), (2, "de")]
register("r02_scoped_bm25", """WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))) AS term FROM documents WHERE starts_with(source, 'src1')),
k AS (SELECT * FROM t WHERE NOT (length(term) = 1 AND NOT regexp_matches(term, '[a-z0-9]'))), l AS (SELECT doc_id, count(*) AS dl FROM k GROUP BY doc_id), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'tion'), (2, 'de')) v(query_id, term)), tf AS (SELECT doc_id, term, count(*) AS tf FROM k WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN l USING (doc_id) JOIN q USING (term), s GROUP BY ALL)
SELECT * FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x) WHERE rank <= 25""".replace("\\\\", "\\"))(
    lambda s, d: retrieve.bm25(table(s, d, "documents").filter(F.col("source").startswith("src1")).select("doc_id", "text"), s.createDataFrame(_TERMS, "query_id int, term string")).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
)
register("u08_new_rounds", f"WITH {_SERIAL}, n AS (SELECT doc_id, line_no, line, regexp_replace(line, '{WS}', '', 'g') AS body FROM l) SELECT doc_id, body, min(line_no) AS line_no FROM n WHERE body NOT IN (SELECT regexp_replace(text, '{WS}', '', 'g') FROM benchmark WHERE text IS NOT NULL) GROUP BY doc_id, body")(
    lambda s, d: duplicates.unseen(segment.lines(documents(s, d)).select("doc_id", "line_no", T.replaced(F.col("line"), T.SPACE).alias("body")), table(s, d, "benchmark").select(T.replaced(F.col("text"), T.SPACE).alias("body")), "body", "line_no")
)
register("k01_sorted_entries", """SELECT doc_id, ch, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM (SELECT doc_id, ch, count(*) AS n, min(pos) AS first_pos
FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(0, length(text))) AS pos FROM documents) WHERE regexp_matches(ch, '[éèüñ]') GROUP BY doc_id, ch)""")(
    lambda s, d: check.sorted_entries(check.characters(documents(s, d)).filter(F.col("ch").rlike("[éèüñ]")).groupBy("doc_id", "ch").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))).select("doc_id", "ch", "n", "rank")
)
register("h02_clean_blocks", f"SELECT page_id, {sql_trim('regexp_replace(regexp_replace(html, ' + chr(39) + '<!--[^>]*-->' + WS + '*' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '\\n{3,}' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + ')')} AS html FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", H.without_comments(F.col("html")).alias("html"))
)
