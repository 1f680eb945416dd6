"""Registered queries on text functions, sentences, headings, entries and caches over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, check, fuse, locate, rewrite, segment, select, stats
from .registry import documents, register, sql_rows
from .table_queries import HITS, hits
from .views import KEYED, MD_DOCS, SENTENCES, WS, md_docs, sql_trim, table

_TOKEN = r"[\p{L}\p{N}]+"

# text functions

register("f02_raw_index", """SELECT doc_id, length(text) // 2 + length(left(text, length(text) // 2)) - length(replace(left(text, length(text) // 2), chr(10), '')) AS raw_at FROM documents WHERE text IS NOT NULL""")(
    lambda s, d: documents(s, d).filter("text IS NOT NULL").select("doc_id", T.raw_index(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.floor(F.length("text") / 2).cast("int")).cast("long").alias("raw_at"))
)
register("f04_citation_norm", f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({sql_trim("regexp_replace(regexp_replace(text, '[[]\\^[^]]*[]]', '', 'g'), '\\^[^^]+\\^', '', 'g')")}, '{WS}', '', 'g'),
 '[0-9\\x{{FF10}}-\\x{{FF19}}\\x{{2460}}-\\x{{249B}}\\x{{24EA}}\\x{{24F5}}-\\x{{24FE}}\\x{{3280}}-\\x{{3289}}]', '', 'g'), '[A-Za-z\\x{{FF21}}-\\x{{FF3A}}\\x{{FF41}}-\\x{{FF5A}}]', '', 'g') AS norm FROM documents""")(
    lambda s, d: documents(s, d).select("doc_id", T.normalize(F.col("text"), T.CITATION).alias("norm"))
)
register("f07_word_ngrams", f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [''] WHEN len(w) < 3 THEN [array_to_string(w, '|')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || '|' || w[i + 1] || '|' || w[i + 2]) END)) AS grams FROM t""")(
    lambda s, d: documents(s, d).filter("text IS NOT NULL").select("doc_id", F.array_sort(T.word_ngrams(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)), 3)).alias("grams"))
)
register("f37_strip_fence", "SELECT doc_id, trim(text, ' ') AS text FROM documents WHERE NOT contains(text, '```') AND NOT regexp_matches(text, '^\\s|\\s$')")(
    lambda s, d: documents(s, d).filter(~F.col("text").contains("```") & ~F.col("text").rlike(r"^\s|\s\z")).select("doc_id", T.strip_fence(F.concat(F.lit("```JSON\n"), "text", F.lit("\n```"))).alias("text"))
)
register("f45_search_tokens", f"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\\S+'), lambda x: lower({sql_trim('x')})), lambda x: x <> '' AND NOT regexp_matches(x, '^[\\s\\p{{P}}\\p{{S}}]+$') AND NOT (length(x) = 1 AND NOT regexp_matches(x, '[a-z0-9]'))) AS tokens FROM documents WHERE text IS NOT NULL""")(
    lambda s, d: documents(s, d).filter("text IS NOT NULL").select("doc_id", F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), T.search_token), lambda x: x.isNotNull()).alias("tokens"))
)
register("f47_one_line", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), '  ') AS text FROM documents")(
    lambda s, d: documents(s, d).select("doc_id", T.multi_line_as_spaces(F.col("text")).alias("text"))
)
register("f48_tooltips", "WITH p AS (SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ') AS t FROM pages) SELECT page_id, CASE WHEN length(t) > 200 THEN left(t, 200) || '… 详见说明' ELSE t END AS tip FROM p")(
    lambda s, d: table(s, d, "pages").select("page_id", T.tooltip(F.col("html")).alias("tip"))
)
register("f33_reference_blocks", """SELECT doc_id, concat('<!-- lectern:grepHit begin sha1=', left(sha1(text), 12), ' -->', chr(10), '【文献摘录】', source, ':1', chr(10), chr(10), text, chr(10), '<!-- lectern:grepHit end -->') AS block FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")(
    lambda s, d: table(s, d, "documents").filter("text IS NOT NULL AND source IS NOT NULL").select("doc_id", T.reference_block("grep", F.concat("source", F.lit(":1")), F.col("text"), T.digest(F.col("text")), "lectern").alias("block"))
)
_HEADED = "concat('【文献摘录】', source, chr(10), ' ', chr(10), 'url: x', chr(10), '摘录：', text)"
register("h03_literature_text", r"SELECT doc_id, trim(text, ' ') AS text FROM documents WHERE NOT regexp_matches(text, '^\s|\s$') AND source IS NOT NULL")(
    lambda s, d: table(s, d, "documents").filter(~F.col("text").rlike(r"^\s|\s\z") & F.col("source").isNotNull()).select("doc_id", T.literature_text(F.expr(_HEADED.replace("chr(10)", "'\\n'")), F.lit(None).cast("string")).alias("text"))
)
register("h08_same_target", r"SELECT doc_id, doc_id % 3 <> 1 OR doc_id % 6 = 4 AS same FROM documents WHERE trim(text) <> ''")(
    lambda s, d: documents(s, d).filter("trim(text) <> ''").select("doc_id", T.same_target(F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('  ', replace(text, '\\n', ' \\n ')) WHEN doc_id % 6 = 4 THEN ' ' WHEN doc_id % 3 = 1 THEN concat(text, ' more') ELSE text END"), F.col("text")).alias("same"))
)
_ENTRY = "array_join(transform(split(text, '\\n'), (x, i) -> CASE i % 5 WHEN 1 THEN concat(x, '\\nCopyright 2020 by us') WHEN 2 THEN concat('返回目录\\n', x) WHEN 3 THEN concat(x, '\\nhttps://example.org/a') ELSE x END), '\\n')"
register("f30_clean_entries", r"""SELECT doc_id, regexp_replace(trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: true), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' '), CASE WHEN doc_id % 2 = 0 THEN '[ \t]+\n' ELSE '\x01' END, chr(10), 'g') AS text
FROM documents WHERE NOT regexp_matches(text, '^\s|\s$') AND NOT regexp_matches(text, '(?im)^(copyright|all rights reserved|https?://\S+$)|参见|audio')""")(
    lambda s, d: documents(s, d).filter(~F.col("text").rlike(r"^\s|\s\z") & ~F.col("text").rlike(r"(?im)^(copyright|all rights reserved|https?://\S+$)|参见|audio"))
    .select("doc_id", T.cleaned_entry(F.expr(_ENTRY), F.when(F.col("doc_id") % 4 == 0, "CiHai"), F.when(F.col("doc_id") % 4 == 2, F.array(F.lit("x"), F.lit("新辞海")))).alias("text"))
)

# sentences, headings, units

register("g09_structured_sentences", f"""WITH {MD_DOCS},
k AS (SELECT *, regexp_matches(ltrim(line), '^(?:#[ #]|[-*+] |[0-9]+[.)]\\s+)') AS own, {sql_trim('line')} = '' AS blank FROM md_lines),
l AS (SELECT *, last_value(CASE WHEN own THEN true WHEN blank THEN NULL ELSE false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM k),
n AS (SELECT *, sum((line_no > 1 AND (own OR (coalesce(after, false) AND NOT blank)))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM l),
i AS (SELECT doc_id, island, string_agg(line, chr(10) ORDER BY line_no) AS text, arg_min(own, line_no) AS own, max(line_no) AS till FROM n GROUP BY ALL),
e AS (SELECT *, max(island) OVER (PARTITION BY doc_id) AS last FROM i),
documents AS (SELECT doc_id * 1000000 + island AS doc_id, text FROM e WHERE NOT own), {SENTENCES},
a AS (SELECT doc_id // 1000000 AS doc_id, doc_id % 1000000 AS island, idx AS j, sentence FROM sentences UNION ALL SELECT doc_id, island, 0, CASE WHEN island < last THEN text || chr(10) ELSE text END FROM e WHERE own)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY island, j) - 1)::INT AS idx, sentence FROM a""".replace("ls FROM documents)", "ls FROM main.documents)"))(lambda s, d: segment.structured_sentences(md_docs(s, d)))
register("g07_by_mode", f"""WITH {MD_DOCS},
b AS (SELECT *, {sql_trim('line')} = '' AS blank, sum(({sql_trim('line')} = '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM md_lines)
SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS paragraph FROM b WHERE NOT blank GROUP BY doc_id, k""")(lambda s, d: segment.split(md_docs(s, d), "paragraph"))
register("k07_first_sentences", f"WITH {SENTENCES} SELECT doc_id, idx, sentence FROM sentences ORDER BY doc_id, idx LIMIT 50000")(lambda s, d: select.first_sentences(segment.sentences(documents(s, d))))
register("j04_anchor_sentences", f"""WITH {KEYED}, x AS (SELECT doc_id, idx, norm, norm LIKE '%a.%' AS ellipsis, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM normed),
t AS (SELECT *, CASE WHEN i > 0 AND i < n - 1 AND NOT ellipsis THEN 0 WHEN i > 0 AND i < n - 1 THEN 1 WHEN i = 0 THEN 2 END AS tier FROM x),
u AS (SELECT *, min(tier) OVER (PARTITION BY doc_id) AS best FROM t WHERE tier IS NOT NULL),
v AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY length(norm), i) AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM u WHERE tier = best)
SELECT doc_id, i::INT AS idx FROM v WHERE k = c // 2 + 1""")(
    lambda s, d: align.anchor_sentences(_blocks(s, d), block="doc_id")
)


def _blocks(s: SparkSession, d: str) -> DataFrame:
    long = segment.sentences(documents(s, d)).filter(F.length("sentence") >= 5).withColumn("norm", T.normalize(F.col("sentence")))
    return long.selectExpr("doc_id", "int(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1) AS idx", "norm", "norm LIKE '%a.%' AS ellipsis")


_HEADS = f"""{MD_DOCS}, heads AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos, 2 AS level, trim(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 2)) AS title FROM md_lines WHERE regexp_matches(line, '^#{{1,6}}\\s+'))"""
register("j23_heading_diagnosis", f"""WITH {_HEADS}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, level, title FROM heads WHERE pos <> 2 AND NOT (doc_id % 3 = 0 AND pos BETWEEN 3 AND 5)),
f AS (SELECT doc_id, min(pos) AS at, arg_min(CASE WHEN l.title IS NULL THEN 'extra' WHEN r.title IS NULL THEN 'missing' ELSE 'title' END, pos) AS reason FROM heads l FULL JOIN r USING (doc_id, pos) WHERE l.title IS DISTINCT FROM r.title GROUP BY doc_id),
ir AS (SELECT f.doc_id, min(o.pos - f.at) AS g FROM f JOIN heads h ON h.doc_id = f.doc_id AND h.pos = f.at JOIN r o ON o.doc_id = f.doc_id AND o.title = h.title AND o.pos > f.at AND o.pos < f.at + 8 GROUP BY f.doc_id),
il AS (SELECT f.doc_id, min(o.pos - f.at) AS g FROM f JOIN r h ON h.doc_id = f.doc_id AND h.pos = f.at JOIN heads o ON o.doc_id = f.doc_id AND o.title = h.title AND o.pos > f.at AND o.pos < f.at + 8 GROUP BY f.doc_id)
SELECT f.doc_id, f.at, f.reason, CASE WHEN reason = 'extra' THEN 'left' WHEN reason = 'missing' THEN 'right' WHEN ir.g = 1 THEN 'right' WHEN il.g = 1 THEN 'left' WHEN ir.g > 1 THEN 'right' WHEN il.g > 1 THEN 'left' ELSE 'both' END AS side,
CASE WHEN reason <> 'title' THEN 'down' WHEN ir.g = 1 OR il.g = 1 THEN 'here' WHEN ir.g > 1 OR il.g > 1 THEN 'up' ELSE 'here' END AS direction FROM f LEFT JOIN ir USING (doc_id) LEFT JOIN il USING (doc_id)""")(
    lambda s, d: (lambda h: check.heading_diagnosis(h, h.withColumn("pos", F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY line_no)")).filter("pos <> 2 AND NOT (doc_id % 3 = 0 AND pos BETWEEN 3 AND 5)").drop("pos")))(segment.headings(md_docs(s, d)))
)

# places, items and replacements

register("j26_exact_places", """SELECT doc_id, strpos(text, substring(text, length(text) // 2, 30)) - 1 AS start, strpos(text, substring(text, length(text) // 2, 30)) - 1 + length(substring(text, length(text) // 2, 30)) AS "end"
FROM documents WHERE length(text) > 40""")(
    lambda s, d: _exact_places(s, d)
)


def _exact_places(s: SparkSession, d: str) -> DataFrame:
    docs = documents(s, d).filter("length(text) > 40")
    items = docs.selectExpr("doc_id", "substring(text, int(length(text) / 2), 30) AS original")
    found = locate.anchored(items, docs, unit="doc_id", target="text")
    return found.select("doc_id", F.col("anchor.start").cast("long").alias("start"), F.col("anchor.end").cast("long").alias("end"))


register("e06_anchored_items", """SELECT item_id AS unit, length(text) AS n, 10 + length(regexp_extract(substring(text, 11, 40), '^[\\s\\p{P}]*')) AS start FROM benchmark WHERE length(text) > 60 AND strpos(text, substring(text, 11, 40)) = 11 AND regexp_matches(substring(text, 11, 40), '[a-z] [a-z]')""")(
    lambda s, d: (lambda b: locate.anchored(b.selectExpr("item_id AS unit", "length(text) AS n", "regexp_replace(substring(text, 11, 40), '([a-z]) ([a-z])', '$1  $2') AS original"), b.selectExpr("item_id AS unit", "text AS target")).select("unit", "n", F.col("anchor.start").cast("long").alias("start")))(
        table(s, d, "benchmark").filter("length(text) > 60 AND position(substring(text, 11, 40), text) = 11 AND substring(text, 11, 40) RLIKE '[a-z] [a-z]'"))
)
register("f36_parsed_items", "SELECT item_id, n.n::INT AS idx, CASE n.n WHEN 0 THEN text ELSE 'x' END AS original FROM benchmark, (SELECT unnest([0, 1]) AS n) n")(
    lambda s, d: locate.items_of(table(s, d, "benchmark").withColumn("raw", F.concat(F.lit("Here it is:\n```json\n{\"items\": ["), F.to_json(F.struct(F.col("text").alias("original"), F.lit("y").alias("corrected"))), F.lit(", {\"original\": \"x\"}, {\"note\": \"}\"}]}\n```\nDone {"))), key="item_id", text="raw")
    .select("item_id", "idx", F.col("item")["original"].alias("original"))
)
register("e04_word_changes", f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, a[len(a) // 2 + 1] AS wrong, a[len(a) // 2 + 1] || '☆' AS correct FROM w WHERE len(a) > 0""")(lambda s, d: _word_changes(s, d))


def _word_changes(s: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("array<struct<wrong: string, correct: string>>")
    def changes(before, after):
        import pandas as pd

        return pd.Series([[{"wrong": x, "correct": y} for x, y in rewrite.word_changes(list(a), list(b))] for a, b in zip(before, after)])

    words = documents(s, d).filter("text IS NOT NULL").select("doc_id", F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)).alias("a")).filter("size(a) > 0")
    changed = words.withColumn("b", F.transform("a", lambda x, i: F.when(i == F.floor(F.size("a") / 2), F.concat(x, F.lit("☆"))).otherwise(x)))
    return changed.select("doc_id", F.inline(changes("a", "b")))


register("e01_replaced_once", "SELECT doc_id, regexp_replace(regexp_replace(text, 'the', 'THE'), 'de', 'DE') AS text, (contains(text, 'the')::INT + contains(regexp_replace(text, 'the', 'THE'), 'de')::INT)::INT AS applied FROM documents WHERE text IS NOT NULL")(
    lambda s, d: rewrite.items_applied(documents(s, d).filter("text IS NOT NULL").withColumn("items", F.array(F.struct(F.lit("the").alias("old"), F.lit("THE").alias("new")), F.struct(F.lit("de").alias("old"), F.lit("DE").alias("new")), F.struct(F.lit("").alias("old"), F.lit("x").alias("new")))))
)
register("a11_distinct_replacements", "SELECT DISTINCT l_returnflag AS wrong, l_linestatus AS correct, (l_suppkey % 40)::VARCHAR AS clause FROM lineitem")(
    lambda s, d: stats.distinct_replacements(table(s, d, "lineitem").selectExpr("l_returnflag AS wrong", "l_linestatus AS correct", "string(l_suppkey % 40) AS clause"))
)
_RULES = [("the", "The", "article"), ("de", "De", None), ("und", "Und", "and")]
register("j15_literal_words", f"""SELECT doc_id, variant, preferred, count(*) AS n, any_value(comment) AS comment FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS w FROM documents) JOIN {sql_rows(_RULES, 'variant, preferred, comment')} ON w = variant GROUP BY doc_id, variant, preferred""")(
    lambda s, d: check.literal_words(documents(s, d), s.createDataFrame(_RULES, "find string, replace string, comment string"))
)
_CHARS = [("é", "e", "acute"), ("ü", "ue", None)]
register("j15_literal_characters", f"""SELECT doc_id, variant, preferred, count(*) AS n, min(pos)::INT AS first_pos, any_value(comment) AS comment FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(0, length(text))) AS pos FROM documents) JOIN {sql_rows(_CHARS, 'variant, preferred, comment')} ON ch = variant GROUP BY doc_id, variant, preferred""")(
    lambda s, d: check.literal_characters(documents(s, d), s.createDataFrame(_CHARS, "find string, replace string, comment string"))
)
_FOUND = f"f AS (SELECT doc_id, ch AS variant, upper(ch) AS preferred, count(*) AS n, min(pos) AS first_pos FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(0, length(text))) AS pos FROM documents) WHERE ch IN ('é', 'ü') GROUP BY ALL)"


def _found(s: SparkSession, d: str) -> DataFrame:
    return check.character_check(documents(s, d), s.createDataFrame([("é", "É"), ("ü", "Ü")], "variant string, preferred string"))


register("h19_earliest", f"WITH {_FOUND} SELECT variant, preferred, min(doc_id) AS doc_id, arg_min(first_pos, doc_id)::INT AS first_pos FROM f GROUP BY ALL")(lambda s, d: check.earliest(_found(s, d)))
register("h20_notes", f"WITH {_FOUND} SELECT doc_id, variant, CASE variant WHEN 'é' THEN 'of the preferred' ELSE 'of the variant' END AS note FROM f")(
    lambda s, d: check.with_notes(_found(s, d), s.createDataFrame([("É", "of the preferred"), ("é", "no"), ("ü", "of the variant")], "form string, note string")).select("doc_id", "variant", "note")
)
register("a14_total_places", f"WITH {_FOUND} SELECT coalesce(sum(n), 0)::BIGINT AS places FROM f")(lambda s, d: stats.total_places(_found(s, d)))

# counts, caches, scopes, channels

register("a09_alignment_counts", """SELECT l_orderkey, count(*) AS total, sum((k = 0)::INT)::BIGINT AS match, sum((k = 1)::INT)::BIGINT AS delete, sum((k = 2)::INT)::BIGINT AS insert, sum((k = 3)::INT)::BIGINT AS movein, sum((k = 4)::INT)::BIGINT AS moveout
FROM (SELECT l_orderkey, l_partkey % 6 AS k FROM lineitem) GROUP BY l_orderkey""")(
    lambda s, d: stats.alignment_counts(table(s, d, "lineitem").selectExpr("l_orderkey", "element_at(array('match', 'delete', 'insert', 'movein', 'moveout', 'other'), int(l_partkey % 6) + 1) AS type"), by=("l_orderkey",))
)
register("a13_folder_counts", "SELECT regexp_extract(url, '^(.*)/', 1) AS dir, count(*) AS n FROM pages GROUP BY ALL")(lambda s, d: stats.folder_counts(table(s, d, "pages"), path="url"))
register("h17_scaled_totals", f"""WITH f AS (SELECT 'text' AS field, coalesce(text, '') AS t FROM documents),
a AS (SELECT field, sum(length(t))::BIGINT AS chars, sum(ceil(round((length(t) - length(regexp_replace(t, '{WS}', '', 'g'))) * 0.15 + length(regexp_replace(t, '{WS}', '', 'g')) * 0.25, 6)))::BIGINT AS tokens FROM f GROUP BY field)
SELECT field, ceil(chars * 1.5)::BIGINT AS chars, ceil(tokens * 1.5)::BIGINT AS tokens FROM a""")(lambda s, d: stats.scaled_totals(stats.field_totals(table(s, d, "documents"), "text"), 1.5))
register("a19_cache_counts", f"WITH {HITS}, c AS (SELECT DISTINCT digest FROM hits WHERE hit_id % 3 = 0) SELECT source, sum((digest IN (FROM c))::INT)::BIGINT AS hits, sum((digest NOT IN (FROM c))::INT)::BIGINT AS misses FROM hits GROUP BY source")(
    lambda s, d: stats.cache_counts(hits(s, d), hits(s, d).filter("hit_id % 3 = 0"), key="digest")
)
register("r20_remembered", f"WITH {HITS}, c AS (SELECT query_id % 7 AS k, min(block) AS answer FROM hits WHERE query_id % 2 = 0 GROUP BY 1) SELECT hit_id, answer FROM hits JOIN c ON k = hit_id % 11")(
    lambda s, d: select.remembered(hits(s, d).selectExpr("hit_id", "hit_id % 11 AS key"), hits(s, d).filter("query_id % 2 = 0").groupBy(F.expr("query_id % 7 AS key")).agg(F.min("block").alias("answer")))[0].select("hit_id", "answer")
)
register("h10_revived", f"WITH {HITS} SELECT hit_id, 'q1' AS query_id, 'r2' AS round_id, 'active' AS status FROM hits")(lambda s, d: select.revived(hits(s, d), "q1", "r2").select("hit_id", "query_id", "round_id", "status"))
register("u02_channels", f"WITH {HITS} SELECT hit_id, CASE WHEN hit_id % 2 = 0 THEN 'bm25' ELSE 'web' END AS source, CASE WHEN hit_id % 2 = 0 THEN score END AS score, CASE WHEN hit_id % 2 = 1 THEN block END AS url FROM hits")(
    lambda s, d: fuse.united({"bm25": hits(s, d).filter("hit_id % 2 = 0").select("hit_id", "score"), "web": hits(s, d).filter("hit_id % 2 = 1").selectExpr("hit_id", "block AS url")})
)
register("r17_scope", "SELECT count(*) AS files, max(len(string_split(regexp_extract(url, '^(.*)/', 1), '/')))::INT AS depth, count(*) > 100 OR max(len(string_split(regexp_extract(url, '^(.*)/', 1), '/'))) > 4 AS needs_choice FROM pages WHERE url IS NOT NULL")(
    lambda s, d: select.scope_needs_choice(table(s, d, "pages").filter("url IS NOT NULL").withColumnRenamed("url", "file"), 3)
)
register("p06_like_scope", "SELECT page_id FROM pages WHERE url LIKE 'http_://m.%'")(lambda s, d: select.like_prefix(table(s, d, "pages"), "http_://m.", path="url").select("page_id"))
register("p14_no_disambiguation", "SELECT doc_id FROM labels WHERE toxic IS NULL OR toxic = 0")(lambda s, d: select.without_disambiguation(table(s, d, "labels").selectExpr("doc_id", "toxic = 1 AS disambiguation")).select("doc_id"))
_CITED = "c AS (SELECT l_orderkey AS doc_id, l_linenumber AS start_line, l_linenumber AS end_line, CASE WHEN l_partkey % 4 = 0 THEN 'no' ELSE 'cited text number ' || (l_partkey % 3) END AS text, CASE WHEN l_partkey % 5 > 0 THEN '[1]' END AS footnote FROM lineitem)"
register("p04_citations", f"WITH {_CITED} SELECT DISTINCT ON (doc_id, start_line, left(text, 20)) doc_id, start_line, text FROM c WHERE length(trim(text)) >= 5 AND footnote IS NOT NULL ORDER BY doc_id, start_line, left(text, 20), text")(
    lambda s, d: select.citation_rows(table(s, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS start_line", "l_linenumber AS end_line", "CASE WHEN l_partkey % 4 = 0 THEN 'no' ELSE concat('cited text number ', l_partkey % 3) END AS text", "CASE WHEN l_partkey % 5 > 0 THEN '[1]' END AS footnote"), ignored=("short", "noFootnote")).select("doc_id", "start_line", "text")
)
register("h07_asked_patterns", "SELECT DISTINCT c_nationkey AS session, unnest([c_mktsegment, left(c_mktsegment, 3)]) AS pattern FROM customer")(
    lambda s, d: select.asked_patterns(table(s, d, "customer").select(F.col("c_nationkey").alias("session"), F.array(F.struct(F.array("c_mktsegment", F.left("c_mktsegment", F.lit(3)), F.lit(" ")).alias("patterns"))).alias("queries")))
)
register("h08_sessions", f"""WITH {HITS}, r AS (SELECT c_custkey AS query_id, c_nationkey AS session, c_acctbal AS started_at, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS finished_at FROM customer),
h AS (SELECT session, sum((status = 'active')::INT) AS n FROM hits JOIN r USING (query_id) GROUP BY session)
SELECT session, coalesce(any_value(h.n), 0)::BIGINT AS active_hits, count(*) AS rounds, max(coalesce(finished_at, started_at)) AS updated_at FROM r LEFT JOIN h USING (session) GROUP BY session""")(
    lambda s, d: (lambda r: select.session_summary(hits(s, d).join(r.select("query_id", "session"), "query_id"), r))(
        table(s, d, "customer").selectExpr("c_custkey AS query_id", "c_nationkey AS session", "c_acctbal AS started_at", "CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS finished_at"))
)
