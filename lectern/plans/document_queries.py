"""Registered queries on lines, quotes, headings and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T
from ..operators import sections, segment
from .registry import documents, register
from .views import MD_DOCS, SENTENCES, WS, md_docs, sql_trim, table

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"


def _marked(s: SparkSession, d: str, every: int, mark: str) -> DataFrame:
    """Documents with a mark before every so-manieth line."""
    return documents(s, d).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % every == 0, F.concat(F.lit(mark), x)).otherwise(x)), "\n").alias("text"))


register("f01_line_endings", "SELECT page_id, regexp_replace(html, '\\r\\n?', chr(10), 'g') AS html FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", T.line_endings(F.col("html")).alias("html")))
register("f05_without_ellipsis", "SELECT doc_id, regexp_replace(text, '…+|\\.{2,}', '', 'g') AS text FROM documents")(lambda s, d: documents(s, d).select("doc_id", T.without_ellipsis(F.col("text")).alias("text")))
register("f17_clean_title", f"""WITH {_LINES} SELECT doc_id, line_no, {sql_trim(r"regexp_replace(regexp_replace(regexp_replace(line, '\[\s*\^[0-9a-zA-Z]+\s*\]', '', 'g'), '\^[0-9a-zA-Z]+\^', '', 'g'), '[\s.…0-9\x{2460}-\x{2473}\x{3251}-\x{325F}]', '', 'g')")} AS title FROM l""")(
    lambda s, d: segment.lines(documents(s, d)).select("doc_id", "line_no", H.clean_title(F.col("line")).alias("title"))
)
register("f22_multi_level", "SELECT doc_id, doc_id % 7 * 100000000 + doc_id % 11 * 10000 + doc_id % 13 AS value FROM documents")(
    lambda s, d: documents(s, d).select("doc_id", T.multi_level(F.concat_ws(".", F.expr("doc_id % 7"), F.expr("doc_id % 11"), F.expr("doc_id % 13"))).alias("value"))
)
register("f29_control_free", r"SELECT page_id, regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS html FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", T.control_free(F.col("html")).alias("html")))
_QUOTED = """q AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 0 THEN ' > ' || x ELSE x END) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM q)"""
_STRIPPED = "regexp_replace(line, '^" + WS[:-1] + ">]*', '')"
register("f44_unquoted", f"WITH {_QUOTED} SELECT doc_id, string_agg(regexp_replace(line, '^[ \t>]+', ''), chr(10) ORDER BY line_no) AS text FROM l GROUP BY doc_id")(
    lambda s, d: _marked(s, d, 3, " > ").select("doc_id", T.unquoted(F.col("text")).alias("text"))
)
register("g21_blockquotes", f"""WITH {_QUOTED}, k AS (SELECT *, regexp_matches(line, '^{WS}*>') AS quoted, sum((NOT regexp_matches(line, '^{WS}*>'))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM l)
SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, string_agg({_STRIPPED}, chr(10) ORDER BY line_no) AS quote FROM k WHERE quoted GROUP BY doc_id, run""")(
    lambda s, d: sections.blockquotes(_marked(s, d, 3, " > "))
)
register("g22_quote_sentences", f"""WITH ql AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM main.documents),
documents AS (SELECT doc_id * 1000000 + line_no AS doc_id, text FROM ql WHERE line_no % 3 = 0), {SENTENCES}
SELECT doc_id // 1000000 AS doc_id, sentence, (doc_id % 1000000)::INT AS start_line, (doc_id % 1000000)::INT AS end_line FROM sentences""")(lambda s, d: sections.quote_sentences(sections.blockquotes(_marked(s, d, 3, " > "))))
register("g13_line_paragraphs", f"""WITH {MD_DOCS}, b AS (SELECT *, {sql_trim('line')} = '' AS blank FROM md_lines),
f AS (SELECT *, (NOT blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), true))::INT AS first FROM b)
SELECT doc_id, line_no, CASE WHEN blank THEN 0 ELSE sum(first) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 END::BIGINT AS paragraph FROM f""")(lambda s, d: sections.line_paragraphs(md_docs(s, d)))
register("g15_unfenced_headings", """WITH f AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 5 = 0 THEN '```' || x WHEN i % 2 = 0 THEN '## ' || x ELSE x END) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM f),
k AS (SELECT *, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 AS inside FROM l)
SELECT doc_id, line_no, 2 AS level, trim(regexp_replace(trim(substring(line, 4)), '\\s+#+\\s*$', '')) AS title FROM k WHERE inside = 0 AND starts_with(line, '## ') AND trim(substring(line, 4)) <> ''""")(
    lambda s, d: segment.outline(documents(s, d).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 5 == 0, F.concat(F.lit("```"), x)).when((i + 1) % 2 == 0, F.concat(F.lit("## "), x)).otherwise(x)), "\n").alias("text"))).select("doc_id", "line_no", "level", "title")
)
_ENDS = f"""{_LINES}, c AS (SELECT doc_id, length(line) AS n, count(*) AS k, min(line_no) AS f FROM l WHERE {sql_trim('line')} <> '' GROUP BY doc_id, length(line)),
m AS (SELECT doc_id, arg_max(n, k * 1000000 - f) AS mode FROM c GROUP BY doc_id),
w AS (SELECT l.*, mode, length(line) AS n, {sql_trim('line')} AS t, regexp_matches({sql_trim('line')}, '[。！？：；—…]+[’”）]*$') AS stop, lead(line) OVER (PARTITION BY l.doc_id ORDER BY line_no) AS nx FROM l LEFT JOIN m USING (doc_id)),
v AS (SELECT *, coalesce({sql_trim('nx')}, '') AS nt, coalesce(length(nx), 0) AS nn FROM w),
ends AS (SELECT doc_id, line_no, line, CASE WHEN t <> '' THEN
 CASE WHEN n < mode - 3 THEN 2 WHEN n > mode + 3 THEN 1 WHEN NOT stop THEN -2 ELSE 0 END + CASE WHEN stop THEN CASE WHEN abs(n - mode) <= 3 THEN 1 ELSE 3 END ELSE 0 END
 + CASE WHEN nt <> '' AND (regexp_matches(nx, '^\\s{{3,4}}') OR (mode - nn BETWEEN 2 AND 3 AND NOT regexp_matches(nx, '^\\s'))) THEN 2 + regexp_matches(nt, '^[A-Z0-9一二三四五六七八九十]')::INT ELSE 0 END
 + CASE WHEN nt <> '' AND nn * 10 > n * 12 THEN 2 WHEN nt <> '' AND nn * 10 > n * 11 THEN 1 ELSE 0 END END AS score FROM v)"""
register("w13_paragraph_ends", f"WITH {_ENDS} SELECT * FROM ends")(lambda s, d: sections.paragraph_ends(documents(s, d)))
register("f13_spaced_paragraphs", f"""WITH {_ENDS}, z AS (SELECT *, max(CASE WHEN score IS NOT NULL THEN line_no END) OVER (PARTITION BY doc_id) AS last FROM ends)
SELECT doc_id, string_agg(CASE WHEN score >= 3 AND line_no < last THEN line || chr(10) ELSE line END, chr(10) ORDER BY line_no) AS text FROM z GROUP BY doc_id""")(lambda s, d: sections.spaced_paragraphs(documents(s, d)))


def _anchors(s: SparkSession, d: str) -> DataFrame:
    return segment.lines(md_docs(s, d)).filter("line_no % 4 = 1").select("doc_id", "line_no")


_AROUND = "SELECT a.doc_id, a.line_no, a.s AS start_line, a.e AS end_line, string_agg(m.line, chr(10) ORDER BY m.line_no) AS snippet FROM a JOIN md_lines m ON m.doc_id = a.doc_id AND m.line_no BETWEEN a.s AND a.e GROUP BY ALL"
register("g26_line_context", f"""WITH {MD_DOCS}, x AS (SELECT doc_id, line_no, max(line_no) OVER (PARTITION BY doc_id) AS top FROM md_lines),
a AS (SELECT doc_id, line_no, greatest(line_no - 2, 1) AS s, least(line_no + 2, top) AS e FROM x WHERE line_no % 4 = 1) {_AROUND}""")(lambda s, d: sections.expand(md_docs(s, d), _anchors(s, d)))
register("g26_paragraph", f"""WITH {MD_DOCS}, x AS (SELECT *, {sql_trim('line')} = '' AS blank, max(line_no) OVER (PARTITION BY doc_id) AS top,
 max(CASE WHEN {sql_trim('line')} = '' THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS before, min(CASE WHEN {sql_trim('line')} = '' THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM md_lines),
a AS (SELECT doc_id, line_no, CASE WHEN blank THEN greatest(line_no - 2, 1) ELSE coalesce(before, 0) + 1 END AS s, CASE WHEN blank THEN least(line_no + 2, top) ELSE coalesce(after, top + 1) - 1 END AS e FROM x WHERE line_no % 4 = 1) {_AROUND}""")(
    lambda s, d: sections.expand(md_docs(s, d), _anchors(s, d), "md_paragraph")
)
register("g17_sections_around", "SELECT * FROM (VALUES (1, 1, 1, 7, '# a\nx\n## b\ny\n### c\nz\n## d'), (1, 3, 3, 6, '## b\ny\n### c\nz'), (1, 6, 5, 7, '### c\nz\n## d'), (2, 1, 1, 1, 'p')) v(doc_id, line_no, start_line, end_line, snippet)")(
    lambda s, d: sections.expand(s.createDataFrame([(1, "# a\nx\n## b\ny\n### c\nz\n## d"), (2, "p")], "doc_id int, text string"), s.createDataFrame([(1, 1), (1, 3), (1, 6), (1, 9), (2, 1)], "doc_id int, line_no int"), "heading_section")
)
_TOC = [("Two", 2), ("Lost", 1)]
register("j25_marked_titles", "SELECT * FROM (VALUES (1, 1, '## Two', 2), (1, 2, 'x', NULL), (1, 3, '## 1. Two', 2)) v(doc_id, line_no, line, level)")(
    lambda s, d: sections.mark_titles(s.createDataFrame([(1, "# Two\nx\n1. Two")], "doc_id int, text string"), s.createDataFrame(_TOC, "title string, level int"))
)
register("j25_missing_titles", "SELECT 'Lost' AS title, 1 AS level")(lambda s, d: sections.missing_titles(s.createDataFrame([(1, "# Two\nx")], "doc_id int, text string"), s.createDataFrame(_TOC, "title string, level int")))

# predicates

register("p01_long_sentences", f"WITH {SENTENCES} SELECT doc_id, idx FROM sentences WHERE length(sentence) >= 40")(lambda s, d: segment.sentences(documents(s, d)).filter(F.length("sentence") >= 40).select("doc_id", "idx"))
register("p03_citation_confidence", f"""WITH {SENTENCES}, t AS (SELECT doc_id, idx, length(sentence) AS n, length(regexp_replace(sentence, '[0-9０-９\\p{{P}}{WS[1:-1]}]', '', 'g')) AS rest FROM sentences)
SELECT doc_id, idx, CASE WHEN n < 5 OR (n - rest) * 10 >= n * 9 THEN 'likely_not' ELSE 'citation' END AS confidence FROM t""")(
    lambda s, d: segment.sentences(documents(s, d)).select("doc_id", "idx", H.citation_confidence(F.col("sentence")).alias("confidence"))
)
register("p09_heading_units", f"WITH {MD_DOCS} SELECT doc_id, coalesce(starts_with(list_filter(string_split(text, chr(10)), lambda x: {sql_trim('x')} <> '')[1], '## '), false) AS heads FROM md_docs")(
    lambda s, d: md_docs(s, d).select("doc_id", H.starts_with_heading(F.col("text"), (2,)).alias("heads"))
)
register("p10_heading_place", f"WITH {_LINES} SELECT doc_id, line_no, length(regexp_extract(line, '^{WS}*')) <= 4 AS heading FROM l")(lambda s, d: segment.lines(documents(s, d)).select("doc_id", "line_no", H.in_heading_place(F.col("line")).alias("heading")))
register("p11_requestable", f"WITH {_LINES} SELECT doc_id, count(*) FILTER ({sql_trim('line')} <> '') AS items FROM l GROUP BY doc_id")(
    lambda s, d: segment.lines(documents(s, d)).groupBy("doc_id").agg(F.count_if(T.trimmed(F.col("line")) != "").alias("items"))
)
register("p13_substantive", f"WITH {_LINES} SELECT doc_id, line_no, line_no % 2 = 0 AND regexp_replace(line, '{WS}', '', 'g') <> '' AS changed FROM l")(
    lambda s, d: segment.lines(documents(s, d)).select("doc_id", "line_no", H.differs(F.col("line"), F.when(F.col("line_no") % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "line"))).alias("changed"))
)
