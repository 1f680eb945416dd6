"""Registered queries on places in texts, numbers inside lines, notes, memory and parsed answers, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import claims, memory, notes, private_use
from ..operators import context, numbering, parse, persons, segment
from .registry import documents, register, sql_rows
from .table_queries import HITS, hits
from .views import md_docs, sql_trim, table

# Every line by its place: list items, blank lines, code fences and quotes; read alike in both engines, where i counts from 0.
_KINDS = "CASE {i} % 11 WHEN 2 THEN concat('- ', x) WHEN 5 THEN '' WHEN 7 THEN '```' WHEN 10 THEN concat('> ', x) ELSE concat(x, ' ') END"
register("f14_joined_paragraphs", f"""WITH l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {_KINDS.format(i='(i - 1)')})) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, {sql_trim('line')} AS t FROM l),
k AS (SELECT *, CASE WHEN t = '' THEN 'b' WHEN starts_with(t, '```') THEN 'f' WHEN regexp_matches(t, '^([-*+]|[0-9]+\\.)\\s') THEN 'l' WHEN regexp_matches(t, '^(#{{1,6}}|>)\\s|^[-*]{{3,}}$|^\\|.*\\|$') THEN 's' ELSE 'p' END AS k FROM t),
c AS (SELECT *, CASE WHEN k <> 'f' AND sum((k = 'f')::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 THEN 'c' ELSE k END AS c FROM k),
a AS (SELECT *, last_value(CASE WHEN c <> 'p' THEN c END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM c),
m AS (SELECT *, c = 'p' AND after IS DISTINCT FROM 'l' AS plain FROM a),
g AS (SELECT *, sum((NOT (plain AND lag(plain, 1, false) OVER (PARTITION BY doc_id ORDER BY i)))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, lag(plain, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM m)),
r AS (SELECT doc_id, g, string_agg(CASE WHEN plain THEN t ELSE line END, ' ' ORDER BY i) AS line FROM g GROUP BY ALL)
SELECT doc_id, string_agg(line, chr(10) ORDER BY g) AS text FROM r GROUP BY doc_id""".replace("lag(plain, 1, false) OVER (PARTITION BY doc_id ORDER BY i)))::INT", "was))::INT"))(
    lambda s, d: documents(s, d).filter("text IS NOT NULL").select("doc_id", context.joined_paragraphs(F.array_join(F.expr(f"transform(split(text, '\\n'), (x, i) -> {_KINDS.format(i='i')})"), "\n")).alias("text"))
)
register("f15_private_numbers", """WITH n AS (SELECT doc_id, doc_id % 9999 + 1 AS n, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, concat(CASE WHEN n <= 20 THEN chr((9311 + n)::INT) WHEN n <= 35 THEN chr((12881 + n - 21)::INT) WHEN n <= 50 THEN chr((12977 + n - 36)::INT) ELSE '[' || n || ']' END, text, '[', n, ']') AS text FROM n""")(
    lambda s, d: (lambda n: documents(s, d).filter("text IS NOT NULL").select("doc_id", F.concat(private_use.decoded(F.concat(n, "text")), private_use.decoded(private_use.encoded(F.expr("doc_id % 9999 + 1"), private_use.PLANES[0]), True)).alias("text")))(
        F.concat(F.lit("\U00100b64\U00100b65\U00100a81"), private_use.encoded(F.expr("doc_id % 9999 + 1"))))
)
_SCRIPT = {"é": "e", "è": "e", "ü": "u"}
register("f16_converted", "SELECT doc_id, translate(replace(text, 'de', 'DE'), 'éèü', 'eeu') AS text FROM documents")(
    lambda s, d: documents(s, d).select("doc_id", parse.converted(F.col("text"), _SCRIPT, {"de": "DE"}).alias("text"))
)
register("h11_alternate_terms", r"""WITH w AS (SELECT doc_id, regexp_extract(text, '[\p{L}]+') AS t FROM documents), a AS (SELECT doc_id, t, translate(t, 'éèü', 'eeu') AS x, replace(t, 'e', 'é') AS y FROM w WHERE t <> '')
SELECT doc_id, list_filter([x, y], lambda v: v <> t) AS terms FROM a""")(
    lambda s, d: documents(s, d).select("doc_id", F.regexp_extract("text", r"\p{L}+", 0).alias("t")).filter("t <> ''").select("doc_id", parse.alternate_terms(F.col("t"), _SCRIPT, {"e": "é"}).alias("terms"))
)
_NOTED = "concat(left(text, 20), '[^a]“quoted”', CASE doc_id % 4 WHEN 0 THEN ' ①② x' WHEN 1 THEN '。[^1] x' WHEN 2 THEN '{n}[^z]' ELSE ' and. ^3^' END)"
register("f46_note_marks", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '①②' WHEN 1 THEN '[^1]' WHEN 2 THEN '[^a]' ELSE '^3^' END AS marker, CASE doc_id % 4 WHEN 2 THEN '[^z]' WHEN 3 THEN '^3^' END AS at_end FROM documents WHERE length(text) >= 20 AND NOT regexp_matches(text, '[\\^\\[“”]')")(
    lambda s, d: documents(s, d).filter("length(text) >= 20").filter(~F.col("text").rlike(r"[\^\[“”]")).withColumn("t", F.expr(_NOTED.replace("{n}", "\\n"))).select("doc_id", notes.note_of_quote(F.col("t"), F.lit(24), F.lit(32)).alias("marker"), notes.note_at_end(F.col("t")).alias("at_end"))
)
register("h21_selected_citation", "SELECT doc_id, text, doc_id AS start_line, doc_id + 3 AS end_line, CASE WHEN doc_id % 2 = 0 THEN 'blockquote' ELSE 'quote' END AS type, 'citation' AS confidence FROM documents WHERE NOT contains(text, '>')")(
    lambda s, d: documents(s, d).filter("NOT contains(text, '>')").select("doc_id", notes.selected_citation(F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('x\\n > ', text) ELSE text END"), F.col("text"), F.expr("doc_id - 1"), F.expr("doc_id + 2")).alias("c")).select("doc_id", "c.*")
)
register("h18_outline_summary", """WITH o AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), p AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN a WHEN 1 THEN list_slice(a, 1, -2) ELSE list_concat(['x'], list_slice(a, 2, len(a))) END AS b FROM o)
SELECT doc_id, doc_id % 3 = 0 OR a = b AS ok, CASE WHEN doc_id % 3 = 0 OR a = b THEN concat('两个文件标题一致（各 ', len(a), ' 个）：A 与 B。') WHEN doc_id % 3 = 1 THEN concat('标题数量不同（A ', len(a), ' 个，B ', len(a) - 1, ' 个）。第 ', len(a), ' 处不一致：', chr(10), 'A：## ', a[len(a)], '（第 ', len(a), ' 行）', chr(10), 'B：（无）')
ELSE concat('标题数量相同（各 ', len(a), ' 个）。第 1 处不一致：', chr(10), 'A：## ', a[1], '（第 1 行）', chr(10), 'B：## x（第 1 行）') END AS message FROM p""")(lambda s, d: _outlines(s, d))


def _outlines(s: SparkSession, d: str) -> DataFrame:
    heads = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit(2).alias("level"), x.alias("title"), (i + 1).alias("line_no")))
    rows = documents(s, d).filter("text IS NOT NULL").select("doc_id", heads.alias("a"))
    other = F.transform("a", lambda h, i: F.struct(h.level.alias("level"), F.when(i == 0, "x").otherwise(h.title).alias("title"), h.line_no.alias("line_no")))
    rows = rows.withColumn("b", F.when(F.col("doc_id") % 3 == 0, F.col("a")).when(F.col("doc_id") % 3 == 1, F.slice("a", F.lit(1), F.size("a") - 1)).otherwise(other))
    return rows.select("doc_id", notes.outline_summary(F.lit("A"), F.lit("B"), F.col("a"), F.col("b")).alias("m")).select("doc_id", "m.*")


register("f43_memory_lines", r"""WITH e AS (SELECT doc_id, trim(regexp_replace(CASE WHEN length(text) > 800 THEN left(text, 800) || '…' ELSE text END, '\s+', ' ', 'g')) AS o FROM documents WHERE NOT regexp_matches(text, '^\s|\s$'))
SELECT doc_id, concat(o, ' <changed to> new <weight> ', greatest(0, least(1000, doc_id * 7 - 100)), CASE WHEN doc_id % 2 = 0 THEN ' <note> a b' ELSE '' END, ' [id:m', doc_id, '] [at:now]') AS line FROM e""")(lambda s, d: _memory(s, d))


def _memory(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).filter(~F.col("text").rlike(r"^\s|\s\z"))
    entry = memory.entry(F.col("text"), F.lit(" new "), F.expr("doc_id * 7 - 100 + 0.5"), F.expr("CASE WHEN doc_id % 2 = 0 THEN ' a  b ' ELSE ' ' END"))
    return rows.withColumn("e", entry).select("doc_id", memory.entry_line(F.col("e"), F.concat(F.lit("m"), F.col("doc_id").cast("string")), F.lit("now")).alias("line"))


register("h15_memory_block", r"""WITH x AS (SELECT doc_id, text, concat('[第1次·t1 id:r1]', chr(10), 'first', chr(10), chr(10), '---', chr(10), chr(10), '[第2次·t2 id:r2]', chr(10), text) AS r FROM documents WHERE NOT regexp_matches(text, '^\s|\s$'))
SELECT doc_id, concat(CASE WHEN doc_id % 3 > 0 THEN concat(chr(10), '<editorial_memory_global>', chr(10), CASE WHEN length(text) > 5500 THEN trim(left(text, 5500) || chr(10) || '…(截断)') ELSE text END, chr(10), '</editorial_memory_global>') ELSE '' END,
chr(10), '<editorial_memory_current_rounds>', chr(10), CASE WHEN length(r) > 16000 THEN left(r, 16000) || chr(10) || '…(截断)' ELSE r END, chr(10), '</editorial_memory_current_rounds>',
chr(10), '<editorial_proofread_context>', chr(10), 'document: d', doc_id, chr(10), 'selection: L', doc_id + 1, chr(10), 'note: 用户框选的校对范围；以下 target 即该范围全文。', chr(10), '</editorial_proofread_context>') AS block FROM x""")(
    lambda s, d: documents(s, d).filter(~F.col("text").rlike(r"^\s|\s\z")).select("doc_id", memory.memory_block(
        F.when(F.col("doc_id") % 3 > 0, F.split("text", "\n")).otherwise(F.array(F.lit(" "))),
        F.array(F.struct(F.lit("t1").alias("created_at"), F.lit("r1").alias("id"), F.lit(" first ").alias("body")), F.struct(F.lit("t2").alias("created_at"), F.lit("r2").alias("id"), F.concat(F.lit("\n"), "text").alias("body"))),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("doc_id")).alias("block"))
)

# numbers inside lines

_NUMBERED = "replace(replace(replace(replace(replace(replace(text, ', ', ' 12. '), ' de ', ' A. '), ' the ', '㈡'), ' und ', '第三，'), ' of ', '一、'), ' to ', '(7)')"
_HAN = "[一二三四五六七八九十百千]+"
_INLINE = f"""n AS (SELECT doc_id, {_NUMBERED} AS text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM n),
p AS (SELECT *, unnest(range(0, length(line))) AS start FROM l),
q AS (SELECT *, substring(line, start + 1, 12) AS t, CASE WHEN start > 0 THEN substring(line, start, 1) ELSE '' END AS b FROM p WHERE regexp_matches(substring(line, start + 1, 1), '[0-9A-Z一二三四五六七八九十百千第其(（﹙㈠-㉟①-⒛㊱-㊿]')),
k AS (SELECT doc_id, line_no, start, t, CASE WHEN regexp_matches(t, '^{_HAN}、') AND NOT regexp_matches(b, '[\\x{{4e00}}-\\x{{9fa5}}]') THEN 4 WHEN regexp_matches(t, '^第{_HAN}[，,]') AND NOT regexp_matches(b, '[\\x{{4e00}}-\\x{{9fa5}}]') THEN 15
WHEN regexp_matches(t, '^[0-9]+\\.([^0-9]|$)') AND NOT regexp_matches(b, '[0-9]') THEN 13 WHEN regexp_matches(t, '^[A-Z]\\.([^A-Z]|$)') AND NOT regexp_matches(b, '[A-Z]') THEN 14
WHEN regexp_matches(t, '^[(（﹙][0-9]+[)）﹚]') THEN 9 WHEN t[1] = '㈡' THEN 6 END AS slot FROM q),
inline AS (SELECT doc_id, line_no, start::INT AS start, slot, regexp_extract(t, '^[第其(（﹙]?([0-9]+|{_HAN}|[A-Z]|㈡)', 1) AS number, regexp_extract(t, '^([第其(（﹙]?([0-9]+|{_HAN}|[A-Z])[、，,.)）﹚]|㈡)', 1) AS matched FROM k WHERE slot IS NOT NULL)"""


def _numbered(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).filter("text IS NOT NULL").select("doc_id", F.expr(_NUMBERED).alias("text"))


register("w04_inline_numbers", f"WITH {_INLINE} SELECT *, CASE WHEN regexp_matches(number, '^[0-9]+$') THEN number::BIGINT WHEN slot = 14 THEN ascii(number) - 64 WHEN slot = 6 THEN 2 WHEN number = '三' THEN 3 ELSE 1 END AS value FROM inline")(
    lambda s, d: numbering.inline_numbers(_numbered(s, d))
)
# Every fourth line is blank, so paragraphs have three lines at most; every ninth is a heading.
_PARTED = "CASE WHEN {i} % 4 = 3 THEN '' WHEN {i} % 9 = 4 THEN concat('# ', x) ELSE x END"
register("w05_segment_numbers", f"""WITH {_INLINE.replace(f'SELECT doc_id, {_NUMBERED} AS text FROM documents WHERE text IS NOT NULL', f"SELECT doc_id, array_to_string(list_transform(string_split({_NUMBERED}, chr(10)), lambda x, i: {_PARTED.format(i='(i - 1)')}), chr(10)) AS text FROM documents WHERE text IS NOT NULL")},
e AS (SELECT doc_id, line_no, line, {sql_trim('line')} = '' AS blank FROM l),
g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM e),
s AS (SELECT doc_id, g, min(line_no) AS start_line, max(line_no) AS end_line, arg_min(line, line_no) AS f, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS segment FROM g WHERE NOT blank GROUP BY doc_id, g),
i AS (SELECT inline.*, g.g FROM inline JOIN g USING (doc_id, line_no) WHERE NOT regexp_matches(g.line, '^\\s*#{{1,6}}\\s')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY line_no, start) AS n, count(*) OVER (PARTITION BY doc_id, g, slot) AS c FROM i)
SELECT doc_id, segment, start_line, end_line, CASE WHEN length(f) > 20 THEN left(f, 20) || '…' ELSE f END AS preview, line_no, start, slot, number FROM r JOIN s USING (doc_id, g) WHERE n > 1 OR c > 1""")(
    lambda s, d: numbering.segment_numbers(_numbered(s, d).select("doc_id", F.array_join(F.expr(f"transform(split(text, '\\n'), (x, i) -> {_PARTED.format(i='i')})"), "\n").alias("text")))
)
register("w06_custom_numbers", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL)
SELECT doc_id, line_no, 1000 AS slot, 7 AS level, line_no::VARCHAR AS number, line_no AS value FROM l WHERE line_no % 3 = 0
UNION ALL SELECT doc_id, line_no, 1100, NULL, line_no::VARCHAR, line_no FROM l WHERE line_no % 3 = 1""")(lambda s, d: _custom(s, d))


def _custom(s: SparkSession, d: str) -> DataFrame:
    lines = F.expr("transform(split(text, '\\n'), (x, i) -> CASE (i + 1) % 3 WHEN 0 THEN concat('## § § ', i + 1, ' ; ', x) WHEN 1 THEN concat(x, ' <<', i + 1, '>>') ELSE x END)")
    rows = documents(s, d).filter("text IS NOT NULL").select("doc_id", F.array_join(lines, "\n").alias("text"))
    starts = numbering.numbered_lines(rows, numbering.custom_slots([(None, "x", "han"), (8, "§§([0-9]+)", None)])).filter("slot >= 1000")
    inside = numbering.inline_numbers(rows, numbering.custom_inline([("", "han"), ("<<([0-9]+)>>", None)])).filter("slot >= 1000")
    columns = ("doc_id", "line_no", "slot", "level", "number", "value")
    return starts.select(*columns).unionByName(inside.withColumn("level", F.lit(None).cast("int")).select(*columns))


# paragraphs around a span

register("g18_around_spans", """WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
SELECT doc_id, concat('<before>', chr(10), p[1], chr(10), chr(10), p[2], chr(10), chr(10), p[2], chr(10), chr(10), left(p[3], 2), chr(10), '</before>', chr(10), chr(10), '<after>', chr(10), right(p[3], 2), chr(10), chr(10), p[4], chr(10), '</after>') AS context
FROM x WHERE len(p) > 4 AND len(list_filter(p[1:5], lambda z: NOT regexp_matches(z, '^\\S\\S.{3,}\\S\\S$'))) = 0""")(lambda s, d: _around(s, d))


def _around(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select("doc_id", F.split("text", "\n").alias("p")).filter("size(p) > 4").filter(~F.exists(F.slice("p", 1, 5), lambda z: ~z.rlike(r"^\S\S.{3,}\S\S\z")))
    start = F.length(F.get("p", F.lit(0))) + F.length(F.get("p", F.lit(1))) + 6
    rows = rows.select("doc_id", F.array_join("p", "\n\n").alias("text"), start.alias("start"), (start + F.length(F.get("p", F.lit(2))) - 4).alias("end"))
    return rows.select("doc_id", context.around_span(F.col("text"), F.col("start"), F.col("end"), 3, 2).alias("context"))


register("g06_length_in_context")(lambda s, d: context.by_length_in_context(md_docs(s, d)))

# parsed answers and hits

_ANSWER = """concat('Sure: {"lookups": [{"pointId": "a', doc_id, '", "dictId": "d", "candidates": [" x ", "", "y", "z", "w"], "why": "q"}, {"candidates": [" "]}, {"candidates": ["v"]}], "decisions": [{"refTag": "R1", "action": "drop", "score": 0.', doc_id, ', "reason": "r"}, {"refTag": "", "action": "drop"}, {"refTag": "R2", "action": "?"}], "mergeGroups": [{"keep": "R1", "drop": ["R2", "R3"]}, {"drop": ["R4"]}, {"keep": "R5"}]} done')"""
register("h12_lookup_plans", "SELECT doc_id, 'a' || doc_id AS point_id, 'd' AS dict_id, ['x', 'y', 'z'] AS candidates, 'exact' AS mode, 'q' AS why FROM documents UNION ALL SELECT doc_id, 'p-3', NULL, ['v'], 'exact', NULL FROM documents")(
    lambda s, d: parse.lookup_plan(documents(s, d).select("doc_id", F.expr(_ANSWER).alias("text")))
)
register("h13_decisions", "SELECT doc_id, 0 AS idx, 'R1' AS ref_tag, 'drop' AS action, ('0.' || doc_id)::DOUBLE AS score, 'r' AS reason FROM documents UNION ALL SELECT doc_id, 2, 'R2', 'keep', NULL, NULL FROM documents")(
    lambda s, d: parse.rerank_decisions(documents(s, d).select("doc_id", F.expr(_ANSWER).alias("text")))
)
register("h13_merge_groups", "SELECT doc_id, 0 AS idx, 'R1' AS keep, ['R2', 'R3'] AS drop FROM documents UNION ALL SELECT doc_id, 2, 'R5', []::VARCHAR[] FROM documents")(
    lambda s, d: parse.merge_groups(documents(s, d).select("doc_id", F.expr(_ANSWER).alias("text"))).drop("reason")
)
register("h04_cleaned_hits", """WITH h AS (SELECT doc_id, text FROM documents WHERE length(text) >= 400 AND NOT regexp_matches(text, '^\\s|\\s$|\\n\\s|\\s\\n|#'))
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '00:12' || chr(10) || text ELSE left(text, 500) END AS snippet, CASE doc_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN concat('<!-- m:grepHit begin x -->', chr(10), '【文献摘录】t', chr(10), chr(10), text, chr(10), '<!-- m:grepHit end -->') ELSE concat('see ', text, ' end') END AS reference_block FROM h""")(lambda s, d: _cleaned(s, d))


def _cleaned(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).filter("length(text) >= 400").filter(~F.col("text").rlike(r"^\s|\s\z|\n\s|\s\n|#"))
    rows = rows.selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'bm25' ELSE 'grep_md' END AS source", "concat('00:12\\n', text) AS snippet", "'' AS heading_path")
    block = F.expr("CASE doc_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN concat('<!-- m:grepHit begin x -->\\n【文献摘录】t\\nold\\n', snippet, '\\n<!-- m:grepHit end -->') ELSE concat('see ', snippet, ' end') END")
    return parse.cleaned_hits(rows.withColumn("reference_block", block), "m").select("doc_id", "snippet", "reference_block")


register("h23_joined_reference", f"WITH {HITS} SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY ordinal) AS reference FROM hits WHERE status = 'active' AND kind <> 'navigation_hint' GROUP BY query_id")(
    lambda s, d: parse.joined_reference(hits(s, d), by="query_id")
)
register("s10_word_errors", "SELECT DISTINCT l_returnflag || 'x' AS 错误词语, l_linestatus AS 正确词语, (l_suppkey % 40)::VARCHAR AS 错误词语所在小句, 2 AS 错词长度, 1 AS 正词长度 FROM lineitem")(
    lambda s, d: parse.word_errors(table(s, d, "lineitem").selectExpr("concat(l_returnflag, 'x') AS wrong", "l_linestatus AS correct", "string(l_suppkey % 40) AS clause").distinct())
)

# persons, words, claims, stored memory

_PERSONS = [("李白", "唐代诗人", "701—762"), ("杜甫", None, "712—770"), ("杜甫", "乐师", "前 99"), ("王勃", "诗人", "约650—676"), ("李白石", "画家", "1")]
_PERSON = """concat(text, CASE doc_id % 9 WHEN 0 THEN ' 李白（701—762）' WHEN 1 THEN ' 李 白( 唐代诗人， 701—762 )' WHEN 2 THEN ' 杜甫（712—770）' WHEN 3 THEN ' 杜甫（700）' WHEN 4 THEN ' 王勃（650）' WHEN 5 THEN ' 李白（700—762）' WHEN 6 THEN ' 李白石（画家）李白' WHEN 7 THEN ' 杜甫（前99）' ELSE ' 杜甫 x 李白（' END)"""
_VERDICTS = [(0, "李白（701—762）", "已核验", 1), (1, "李 白( 唐代诗人， 701—762 )", "已核验", 1), (2, "杜甫（712—770）", "已核验", 1), (2, "杜甫（712—770）", "多项备核", 1), (3, "杜甫（700）", "核验错误；多项备核", 1), (4, "王勃（650）", "备核", 1),
             (5, "李白（700—762）", "核验错误", 1), (6, "李白石（画家）", "已核验", 1), (6, "李白", "备核", 8), (7, "杜甫（前99）", "已核验", 1), (7, "杜甫（前99）", "多项备核", 1), (8, "杜甫", "备核", 1)]
register("j17_persons", f"SELECT doc_id, variant, preferred, 1::BIGINT AS n, length(text) + place AS first_pos FROM documents JOIN {sql_rows(_VERDICTS, 'k, variant, preferred, place')} ON k = doc_id % 9 WHERE text IS NOT NULL")(
    lambda s, d: persons.person_check(documents(s, d).select("doc_id", F.expr(_PERSON).alias("text")), s.createDataFrame(_PERSONS, "name string, label string, raw string"))
)
register("g25_words", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]') AS w FROM documents), x AS (SELECT doc_id, unnest(range(0, len(w))) AS idx, unnest(w) AS word FROM w)
SELECT doc_id, idx, word, CASE WHEN regexp_full_match(word, '\p{N}+') THEN 'm' WHEN regexp_matches(word, '[\p{L}\p{N}]') THEN 'n' ELSE 'x' END AS tag FROM x""")(lambda s, d: segment.words(documents(s, d)).select("doc_id", "idx", "word", "tag"))
register("g25_word_places", "SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")(
    lambda s, d: segment.words(documents(s, d)).join(documents(s, d), "doc_id").groupBy("doc_id").agg(F.min(F.expr("substring(text, start + 1, end - start) = word")).alias("same"))
)
_ENTITY = """concat('{"Q1": {"claims": {"P31": [{"mainsnak": {"datavalue": {"type": "wikibase-entityid", "value": {"id": "Q', doc_id % 3 + 2, '"}}}}], "P569": [{"rank": "normal", "mainsnak": {"datavalue": {"type": "time", "value": {"time": "+1000-01-01"}}}}, {"rank": "preferred", "mainsnak": {"datavalue": {"type": "time", "value": {"time": "+', 1000 + doc_id, '-01-01"}}}}], "P106": [{"mainsnak": {"datavalue": {"type": "string", "value": "poet"}}}], "P1": [{}], "P570": []}}, "Q2": {"labels": {"en": {"value": "man"}}}, "Q3": {"labels": {"en": {"value": "man"}, "zh": {"value": "人"}}}}')"""
register("f39_claims", "SELECT doc_id, concat('出生 ', left((1000 + doc_id)::VARCHAR, 4), '；类型 ', CASE doc_id % 3 WHEN 0 THEN 'man' WHEN 1 THEN '人' ELSE 'Q4' END, '；职业 poet') AS summary FROM documents")(
    lambda s, d: documents(s, d).select("doc_id", claims.claim_summary(F.expr(_ENTITY), F.lit("Q1")).alias("summary"))
)
register("h14_round_summaries", r"""WITH x AS (SELECT doc_id, text, regexp_replace(text, '\s+', ' ', 'g') AS o, list_filter(string_split(text, chr(10)), lambda z: true) AS ls FROM documents WHERE NOT regexp_matches(text, '^\s|\s$|\n\s|\s\n|  ') AND length(text) > 100),
p AS (SELECT *, concat('句式要点：', array_to_string(list_transform(ls[1:4], lambda z: concat('「', CASE WHEN length(z) > 70 THEN left(z, 70) || '…' ELSE z END, '」→「x」')), '；'), CASE WHEN len(ls) > 4 THEN concat('；共 ', len(ls), ' 处句式级改动') ELSE '' END) AS body FROM x)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '无文本差异。' WHEN 1 THEN '无实质改动（仅空白、转行等忽略不计）。' WHEN 2 THEN concat('「', left(o, 90), '…」→「new」（句粒度未分项）') ELSE CASE WHEN length(body) > 200 THEN left(body, 200) || '…' ELSE body END END AS summary FROM p""")(lambda s, d: _summaries(s, d))


def _summaries(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).filter(~F.col("text").rlike(r"^\s|\s\z|\n\s|\s\n|  ") & (F.length("text") > 100))
    pairs = F.when(F.col("doc_id") % 4 == 3, F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("before"), F.lit(" x").alias("after")))).otherwise(F.array().cast("array<struct<before: string, after: string>>"))
    final = F.expr("CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', '  ') ELSE 'new' END")
    return rows.select("doc_id", memory.round_summary(F.col("text"), final, pairs, 200).alias("summary"))


_STORED = """concat('{"version": ', CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END, ', "global": [{"original": "a', doc_id, '", "changedTo": "b", "weight": 5000, "id": "g"}, {"original": "x"}]', CASE WHEN doc_id % 2 = 0 THEN ', "currentRounds": [{"id": "r", "body": "t"}, {"id": "q"}]' ELSE ', "recent": [{"original": "c", "changedTo": "d", "weight": 2.7, "note": " "}], "current": [{"original": "e", "changedTo": "f", "note": "n", "id": "i", "createdAt": "then"}]' END, '}')"""
register("h16_migrated", """SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN concat('g now a', doc_id, ' b 1000') ELSE '' END AS entries, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'r now t' ELSE concat('new now c <changed to> d <weight> 2 [id:new] [at:now]', chr(10), 'e <changed to> f <weight> 0 <note> n [id:i] [at:then]') END AS rounds FROM documents""")(
    lambda s, d: documents(s, d).select("doc_id", memory.migrated(F.expr(_STORED), F.lit("new"), F.lit("now")).alias("m")).selectExpr(
        "doc_id", "array_join(transform(m.global, e -> concat_ws(' ', e.id, e.created_at, e.entry.original, e.entry.changed_to, string(e.entry.weight))), ';') AS entries", "array_join(transform(m.rounds, r -> concat_ws(' ', r.id, r.created_at, r.body)), ';') AS rounds")
)
