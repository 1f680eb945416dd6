"""Registered queries on numbers, titles, quotations and evidence in texts derived from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import headings as H
from ..functions import text as T
from ..operators import check, numbering, rewrite, segment, select
from .registry import documents, register, sql_rows
from .views import table

# numbers, spelled alike in both engines from a number n of 1 to 99

_HAN = "concat(CASE WHEN n >= 20 THEN substring('二三四五六七八九', n // 10 - 1, 1) ELSE '' END, CASE WHEN n >= 10 THEN '十' ELSE '' END, CASE WHEN n % 10 > 0 THEN substring('一二三四五六七八九', n % 10, 1) ELSE '' END)"
_ROMAN = "concat(CASE n // 10 WHEN 1 THEN 'X' WHEN 2 THEN 'XX' WHEN 3 THEN 'XXX' WHEN 4 THEN 'XL' WHEN 5 THEN 'L' WHEN 6 THEN 'LX' WHEN 7 THEN 'LXX' WHEN 8 THEN 'LXXX' WHEN 9 THEN 'XC' ELSE '' END, CASE n % 10 WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' WHEN 7 THEN 'VII' WHEN 8 THEN 'VIII' WHEN 9 THEN 'IX' ELSE '' END)"
_CIRCLED = "substring('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳', n % 20 + 1, 1)"
_LETTERS = "concat(substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', n % 26 + 1, 1), 'C')"


def _numbers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").selectExpr("doc_id", "int(doc_id % 99 + 1) AS n").selectExpr("doc_id", "n", *(f"{x.replace('//', 'div')} AS {name}" for x, name in ((_HAN, "h"), (_ROMAN, "r"), (_CIRCLED, "c"), (_LETTERS, "l"))))


register("f21_numbers", "SELECT doc_id, doc_id % 99 + 1 AS han, doc_id % 99 + 1 AS roman, (doc_id % 99 + 1) % 20 + 1 AS circled, ((doc_id % 99 + 1) % 26 + 1) * 26 + 3 AS letter FROM documents")(
    lambda s, d: _numbers(s, d).select("doc_id", T.han_number(F.col("h")).alias("han"), T.roman_number(F.col("r")).alias("roman"), T.circled_number(F.col("c")).cast("int").alias("circled"), T.letter_number(F.col("l")).alias("letter"))
)
register("f25_era_years", "SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE doc_id % 99 + 1 END AS year FROM documents")(
    lambda s, d: _numbers(s, d).select("doc_id", E.era_year(F.when(F.col("doc_id") % 10 == 0, "元").when(F.col("doc_id") % 10 == 1, "百").otherwise(F.col("h"))).alias("year"))
)

# numbered lines: chapters, parts, items, sub-items and letters in turn

_PREFIX = "CASE i % 5 WHEN 1 THEN concat('第', i, '章 ', x) WHEN 2 THEN concat('§ ', i, '.2 ', x) WHEN 3 THEN concat(i, '. ', x) WHEN 4 THEN concat('(', i, ') ', x) ELSE concat('AB. ', x) END"
_LINES = "l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"


def _numbered(s: SparkSession, d: str) -> DataFrame:
    lines = F.expr(f"transform(split(text, '\\n'), (x, j) -> {_PREFIX.replace('i %', '(j + 1) %').replace(', i,', ', j + 1,').replace('concat(i,', 'concat(j + 1,')})")
    return numbering.numbered_lines(documents(s, d).select("doc_id", F.array_join(lines, "\n").alias("text")))


register("w03_numbered_lines", f"""WITH {_LINES} SELECT doc_id, line_no, CASE line_no % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 13 WHEN 4 THEN 9 ELSE 12 END AS slot, CASE line_no % 5 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 7 END AS level,
CASE line_no % 5 WHEN 0 THEN 'AB' WHEN 2 THEN line_no || '.2' ELSE line_no::VARCHAR END AS number, CASE line_no % 5 WHEN 0 THEN 28 WHEN 2 THEN line_no * 10000 + 2 ELSE line_no END AS value, true AS heading FROM l""")(_numbered)
register("w02_number_tree", f"WITH {_LINES} SELECT doc_id, line_no, CASE WHEN line_no % 5 = 1 THEN 0 ELSE line_no - 1 END AS parent FROM l")(lambda s, d: numbering.tree(_numbered(s, d)).select("doc_id", "line_no", "parent"))
register("g23_toc", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
SELECT doc_id, line_no, ((line_no - 1) % 9 // 4 + 1)::INT AS level, trim(x) AS title FROM l WHERE regexp_matches(x, '\S')""")(
    lambda s, d: segment.toc_entries(documents(s, d).select("doc_id", F.array_join(F.expr("transform(split(text, '\\n'), (x, i) -> concat(repeat(' ', i % 9), element_at(array('- ', '* ', '+ '), i % 3 + 1), x))"), "\n").alias("text")))
)

# titles and lines

_WORD = r"regexp_extract(text, '[a-zA-Z]+', 0)"


def _words(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).selectExpr("doc_id", "text", _WORD + " AS w").filter("w <> ''")


_W = f"w AS (SELECT doc_id, text, {_WORD} AS w FROM documents WHERE {_WORD} <> '')"
register("f18_leading_serial", f"WITH {_W} SELECT doc_id, doc_id::VARCHAR AS serial, doc_id % 2 = 1 AS alone FROM w")(
    lambda s, d: (lambda t: _words(s, d).select("doc_id", H.leading_serial(t).alias("serial"), H.is_only_serial(t).alias("alone")))(F.expr("CASE WHEN doc_id % 2 = 1 THEN concat(doc_id, '.') ELSE concat('(', doc_id, ') ', w) END"))
)
register("f19_headings_equal", f"WITH {_W} SELECT doc_id, doc_id % 3 <> 1 AS by_serial, doc_id % 3 = 2 AS by_text FROM w")(lambda s, d: _equal(s, d))


def _equal(s: SparkSession, d: str) -> DataFrame:
    x = F.expr("CASE doc_id % 3 WHEN 2 THEN concat('X', w, ' ', w) ELSE concat('1. ', w) END")
    y = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('1) Z', w) WHEN 1 THEN concat('2. ', w) ELSE concat('X', w, w) END")
    return _words(s, d).select("doc_id", H.headings_equal(x, y).alias("by_serial"), H.headings_equal(x, y, True).alias("by_text"))


register("f24_line_levels", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents), k AS (SELECT * FROM l WHERE regexp_matches(x, '^[^\s#]'))
SELECT doc_id, line_no, CASE line_no % 4 WHEN 1 THEN '# ' || x WHEN 3 THEN '  # ' || x WHEN 0 THEN '##### ' || x END AS up, CASE line_no % 4 WHEN 1 THEN '### ' || x WHEN 2 THEN '# ' || x WHEN 3 THEN '  ## ' || x END AS down, CASE WHEN line_no % 4 = 3 THEN '  ### ' || x ELSE '### ' || x END AS title FROM k""")(
    lambda s, d: (lambda t: segment.lines(documents(s, d)).filter(F.col("line").rlike(r"^[^\s#]")).select("doc_id", "line_no", H.promoted(t).alias("up"), H.demoted(t).alias("down"), H.to_title(t, F.lit(2)).alias("title")))(
        F.expr("CASE line_no % 4 WHEN 1 THEN concat('## ', line) WHEN 2 THEN line WHEN 3 THEN concat('  # ', line) ELSE concat('###### ', line) END"))
)
register("j24_outline_difference", "WITH o AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE NOT regexp_matches(text, '^\\s|\\s$|\\n\\s|\\s\\n')) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE n - 1 END AS first_difference FROM o")(lambda s, d: _outlines(s, d))


def _outlines(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).filter(~F.col("text").rlike(r"^\s|\s\z|\n\s|\s\n"))
    x = "array_join(transform(split(text, '\\n'), z -> concat('## ', z)), '\\n')"
    return check.outline_difference(rows.selectExpr("doc_id", f"{x} AS x", f"CASE doc_id % 3 WHEN 0 THEN replace({x}, '## ', '##  ') WHEN 1 THEN concat('#', {x}) ELSE concat({x}, 'xyz') END AS y"))


# quotations and evidence

_UNQUOTED = "NOT regexp_matches(text, '[\"''“”‘’「」『』《》]')"
register("g20_quotes", f"""WITH w AS (SELECT doc_id, {_WORD} AS w FROM documents WHERE {_UNQUOTED})
SELECT doc_id, 1 AS start, length(w) + 7 AS "end", concat('“', w, '「b」c”') AS quote FROM w UNION ALL SELECT doc_id, length(w) + 8, 2 * length(w) + 10, concat('《', w, '》') FROM w WHERE w <> ''""".replace(f"FROM documents WHERE {_UNQUOTED}", f"FROM documents WHERE {_UNQUOTED} AND {_WORD} <> ''"))(
    lambda s, d: rewrite.quotes(_words(s, d).filter(~F.col("text").rlike("[\"'“”‘’「」『』《》]")).select("doc_id", F.expr("concat('x“', w, '「b」c”y《', w, '》”', text)").alias("text")))
)
register("f11_curled_quotes", f"WITH {_W} SELECT doc_id, concat('“', w, '” and “', w, '”') AS t FROM w")(lambda s, d: _words(s, d).select("doc_id", rewrite.curl(F.expr("""concat(' "', w, '" and "', w, '" ')""")).alias("t")))
register("f31_candidates", f"WITH {_W} SELECT doc_id, w || '李白' AS term FROM w")(
    lambda s, d: _words(s, d).select("doc_id", E.dictionary_candidate(F.expr("CASE WHEN doc_id % 2 = 0 THEN concat(w, ' 李 白（革命烈士）') ELSE concat(' ', w, '李白 [x]', '【y】(z) ') END")).alias("term"))
)
register("f40_quoted_patterns", f"WITH {_W} SELECT doc_id, left(w, 8) || '引文,' || left(w, 8) || '书名' AS patterns FROM w")(
    lambda s, d: _words(s, d).select("doc_id", F.array_join(E.quoted_patterns(F.expr("concat('「', left(w, 8), '引文」和《', left(w, 8), '书名》和「', left(w, 8), '引文」「x」')")), ",").alias("patterns"))
)
register("f41_anchor_terms", f"WITH {_W} SELECT doc_id, concat(w, '/李朴,', w, ',李朴') AS anchors, concat('entity;;d:', w, '/李朴') AS signature FROM (SELECT doc_id, lower(left(w, 3)) || '白' AS w FROM w)")(
    lambda s, d: (lambda t: _words(s, d).select("doc_id", F.array_join(E.anchor_terms(t), ",").alias("anchors"), E.query_signature(F.lit("entity"), d=t).alias("signature")))(F.array(F.expr("concat(lower(left(w, 3)), '白/李朴')")))
)
register("f34_clean_snippets", r"""SELECT doc_id, doc_id % 3 = 0 AS noisy, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS clean FROM documents WHERE length(text) >= 400 AND NOT regexp_matches(text, '^\s|\s$|\n\s|\s\n|#')""")(
    lambda s, d: (lambda t: documents(s, d).filter("length(text) >= 400").filter(~F.col("text").rlike(r"^\s|\s\z|\n\s|\s\n|#")).select("doc_id", E.is_noisy(t).alias("noisy"), E.clean_snippet(t).alias("clean")))(F.expr("CASE doc_id % 3 WHEN 0 THEN '02:42' WHEN 1 THEN concat('02:42\\n', text) ELSE text END"))
)
_SENSES = [(0, "地下党的电台 1949", "特工 延安", 0.95, 0.58), (1, "唐诗 诗人", "诗仙 盛唐", 0.95, 0.58), (2, "地下党的电台", "唐诗 诗人", 0.25, 0.05), (3, "plain", "特工", 0.55, 0.5)]
_BY = f"FROM documents JOIN {sql_rows(_SENSES, 'k, target, hit, fit, score')} ON k = doc_id % 4 WHERE NOT regexp_matches(text, '[0-9]{{4}}')"


def _senses(s: SparkSession, d: str) -> DataFrame:
    kinds = s.createDataFrame(_SENSES, "k long, target string, hit string, fit double, score double").drop("fit", "score")
    rows = documents(s, d).filter(~F.col("text").rlike("[0-9]{4}")).withColumn("k", F.col("doc_id") % 4).join(kinds, "k")
    return rows.selectExpr("doc_id AS hit_id", "concat(target, ' ', text) AS target", "concat(text, ' ', hit) AS text", "double(0.5) AS score")


register("f38_sense_fit", f"SELECT doc_id AS hit_id, fit {_BY}")(lambda s, d: _senses(s, d).select("hit_id", F.round(E.sense_fit(F.col("target"), F.col("text")), 6).alias("fit")))
register("r11_sense_adjusted", f"SELECT doc_id AS hit_id, score {_BY}")(lambda s, d: select.sense_adjusted(_senses(s, d)).select("hit_id", F.round("score", 6).alias("score")))
