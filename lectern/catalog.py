"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import align, check, duplicates, retrieve, rewrite, segment, stats
from .plans import batch_queries, derived_queries, document_queries, hit_queries, more_queries, place_queries, structure_queries, table_queries  # noqa: F401
from .plans.registry import ORACLE, QUERIES, Query, documents as _docs, register as _register, sql_rows as _sql_values, values as _values
from .plans.views import KEYED, MARKED, MD_DOCS, SENTENCES, WS, md_docs, sql_trim, table

# duplicates and sentences

_register("a01_exact_duplicates", f"""WITH {KEYED}
SELECT doc_id, match_key, count(*) AS n, min(idx) AS first_idx, left(arg_min(sentence, idx), 40) AS preview
FROM keyed WHERE match_key <> '' GROUP BY doc_id, match_key HAVING count(*) >= 2""")(
    lambda s, d: duplicates.exact_groups(duplicates.keyed_sentences(_docs(s, d)))
)
_PAIRS = f"""{KEYED},
u AS (SELECT doc_id, match_key, min(idx) AS idx, min(len_norm) AS len,
      CASE WHEN length(match_key) < 3 THEN [match_key] ELSE list_distinct(list_transform(range(1, length(match_key) - 1), lambda i: substring(match_key, i, 3))) END AS g
      FROM keyed WHERE match_key <> '' GROUP BY doc_id, match_key),
pairs AS (SELECT * FROM (SELECT a.doc_id, least(a.idx, b.idx) AS left_idx, greatest(a.idx, b.idx) AS right_idx,
      len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) AS score
  FROM u a JOIN u b ON a.doc_id = b.doc_id AND (a.len < b.len OR (a.len = b.len AND a.idx < b.idx)) AND b.len <= ceil(a.len * 1.2)) WHERE score >= 0.8)"""
_register("j01_similar_pairs", f"WITH {_PAIRS} SELECT doc_id, left_idx, right_idx, round(score, 6) AS score FROM pairs")(
    lambda s, d: duplicates.similar_pairs(duplicates.keyed_sentences(_docs(s, d))).withColumn("score", F.round("score", 6))
)
_register("a02_similar_groups", f"""WITH RECURSIVE {_PAIRS},
e AS (SELECT doc_id, left_idx AS x, right_idx AS y FROM pairs UNION SELECT doc_id, right_idx, left_idx FROM pairs),
r AS (SELECT doc_id, x AS idx, x AS m FROM e UNION SELECT r.doc_id, e.y, r.m FROM r JOIN e ON e.doc_id = r.doc_id AND e.x = r.idx),
g AS (SELECT doc_id, idx, min(m) AS group_id FROM r GROUP BY ALL),
b AS (SELECT p.doc_id, g.group_id, max(score) AS score FROM pairs p JOIN g ON g.doc_id = p.doc_id AND g.idx = p.left_idx GROUP BY ALL)
SELECT g.doc_id, g.idx::INT AS idx, g.group_id::INT AS group_id, round(b.score, 6) AS score FROM g JOIN b USING (doc_id, group_id)""")(
    lambda s, d: duplicates.similar_groups(duplicates.similar_pairs(duplicates.keyed_sentences(_docs(s, d)))).withColumn("score", F.round("score", 6))
)
_register("g08_sentences", f"WITH {SENTENCES} SELECT doc_id, idx, sentence FROM sentences")(lambda s, d: segment.sentences(_docs(s, d)))
_register("g10_sentence_spans", f"""WITH p AS (SELECT doc_id, list_filter(string_split({MARKED}, chr(1)), lambda x: x <> '') AS ss FROM documents),
u AS (SELECT doc_id, unnest(ss) AS s, unnest(range(0, len(ss))) AS idx FROM p), b AS (SELECT *, length(s) - length(replace(s, chr(10), '')) AS breaks FROM u),
o AS (SELECT *, coalesce(sum(length(s)) OVER w, 0)::INT AS pos, 1 + coalesce(sum(breaks) OVER w, 0)::INT AS line, regexp_extract(s, '^{WS}*') AS lead, regexp_replace(s, '{WS}+$', '') AS body FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, s AS sentence, (line + length(lead) - length(replace(lead, chr(10), '')))::INT AS start_line, (line + length(body) - length(replace(body, chr(10), '')))::INT AS end_line, pos AS start_offset, (pos + length(s))::INT AS end_offset FROM o WHERE body <> ''""")(lambda s, d: segment.sentence_spans(_docs(s, d)))
_register("g11_clauses", f"""WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^,;.]*[,;.]|[^,;.]+'), lambda x: {sql_trim('x')}), lambda x: x <> '') AS cs FROM documents)
SELECT doc_id, unnest(range(0, len(cs))) AS idx, unnest(cs) AS clause FROM c""")(lambda s, d: segment.clauses(_docs(s, d), ",;."))
_register("g24_rejoined", f"WITH {SENTENCES} SELECT doc_id, string_agg(sentence, chr(10) || chr(10) ORDER BY idx) AS text FROM sentences GROUP BY doc_id")(
    lambda s, d: segment.sentences(_docs(s, d)).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sentence"))), lambda x: x.sentence), "\n\n").alias("text"))
)

# segmentation of documents with headings

_register("g01_by_length", f"""WITH RECURSIVE {MD_DOCS},
st AS (SELECT doc_id, line_no, line, length(line) AS n, 0 AS idx, length(line) >= 600 AND {sql_trim('line')} = '' AS close FROM md_lines WHERE line_no = 1
 UNION ALL SELECT l.doc_id, l.line_no, l.line, CASE WHEN s.close THEN 0 ELSE s.n END + length(l.line), s.idx + s.close::INT,
  CASE WHEN s.close THEN 0 ELSE s.n END + length(l.line) >= 600 AND {sql_trim('l.line')} = '' FROM st s JOIN md_lines l ON l.doc_id = s.doc_id AND l.line_no = s.line_no + 1)
SELECT doc_id, idx, string_agg(line, chr(10) ORDER BY line_no) AS target FROM st GROUP BY doc_id, idx""")(lambda s, d: segment.by_length(md_docs(s, d)))
_register("g02_by_title", f"""WITH {MD_DOCS},
t AS (SELECT doc_id, line_no, line, sum((starts_with(line, '## '))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM md_lines),
p AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY line_no) AS target FROM t GROUP BY doc_id, k)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1) AS idx, target FROM p""")(lambda s, d: segment.by_title(md_docs(s, d)))
_filled = lambda source, limit: f"""st AS (SELECT k, line_no, line, length(line) AS n, 0 AS idx, length(line) >= {limit} AND {sql_trim('line')} = '' AS close FROM {source} WHERE line_no = 1
 UNION ALL SELECT l.k, l.line_no, l.line, CASE WHEN s.close THEN 0 ELSE s.n END + length(l.line), s.idx + s.close::INT,
  CASE WHEN s.close THEN 0 ELSE s.n END + length(l.line) >= {limit} AND {sql_trim('l.line')} = '' FROM st s JOIN {source} l ON l.k = s.k AND l.line_no = s.line_no + 1)"""  # noqa: E731
_SECTIONS = f"""{MD_DOCS},
t AS (SELECT doc_id, line_no, line, sum((starts_with(line, '## '))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM md_lines),
p AS (SELECT doc_id, g, string_agg(line, chr(10) ORDER BY line_no) AS target FROM t GROUP BY doc_id, g),
sections AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INT AS section, target FROM p),
sl AS (SELECT doc_id * 100000 + section AS k, unnest(string_split(target, chr(10))) AS line, unnest(range(1, len(string_split(target, chr(10))) + 1)) AS line_no FROM sections)"""
_register("g03_title_and_length", f"""WITH RECURSIVE {_SECTIONS}, {_filled('sl', 600)}
SELECT doc_id, section, idx, string_agg(line, chr(10) ORDER BY line_no) AS target, any_value(target) AS context FROM st JOIN sections ON k = doc_id * 100000 + section GROUP BY doc_id, section, idx""")(lambda s, d: segment.by_title_and_length(md_docs(s, d)))
_register("g04_resplit_long", f"""WITH RECURSIVE {_SECTIONS}, {_filled('sl', 800)}
SELECT doc_id, section AS idx, idx AS piece, string_agg(line, chr(10) ORDER BY line_no) AS target FROM st JOIN sections ON k = doc_id * 100000 + section WHERE length(sections.target) > 1500 GROUP BY doc_id, section, idx
UNION ALL SELECT doc_id, section, 0, target FROM sections WHERE length(target) <= 1500""")(lambda s, d: segment.resplit_long(segment.by_title(md_docs(s, d))))
_register("g05_merge_short", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
k AS (SELECT doc_id, i, x, coalesce(sum((length(x) >= 100)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM l)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1) AS idx, target FROM (SELECT doc_id, g, string_agg(x, chr(10) ORDER BY i) AS target FROM k GROUP BY doc_id, g)""")(
    lambda s, d: segment.merge_short(_docs(s, d).select("doc_id", F.split("text", "\n").alias("units")))
)
_register("g12_paragraphs", f"""WITH {MD_DOCS},
b AS (SELECT *, {sql_trim('line')} = '' AS blank, sum(({sql_trim('line')} = '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM md_lines)
SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS paragraph FROM b WHERE NOT blank GROUP BY doc_id, k""")(
    lambda s, d: segment.paragraphs(md_docs(s, d))
)
_HEADS = f"""{MD_DOCS},
heads AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 1)) AS level, trim(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 2)) AS title FROM md_lines WHERE regexp_matches(line, '^#{{1,6}}\\s+'))"""
_register("g14_headings", f"WITH {_HEADS} SELECT * FROM heads")(lambda s, d: segment.headings(md_docs(s, d)))
_register("g16_outline", f"WITH {_HEADS} SELECT doc_id, line_no, level, title, title AS heading_path FROM heads WHERE title <> ''")(lambda s, d: segment.outline(md_docs(s, d)))
_register("h01_segment_offsets", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS idx FROM documents)
SELECT doc_id, idx, coalesce(sum(length(x) + 5) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM l""")(
    lambda s, d: _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "x")).selectExpr(
        "doc_id", "idx", "CAST(coalesce(sum(length(x) + 5) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS long) AS start_offset")
)
# scalar functions

_register("f03_normalize", f"""SELECT doc_id, regexp_replace(regexp_replace({sql_trim('text')}, '{WS}', '', 'g'), '\\p{{P}}', '', 'g') AS norm FROM documents""")(
    lambda s, d: _docs(s, d).select("doc_id", T.normalize(F.col("text"), T.Normalization(punctuation=True)).alias("norm"))
)
_register("f06_ngrams", """SELECT doc_id, list_sort(list_distinct(CASE WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)) END)) AS grams
FROM (SELECT doc_id, text AS t FROM documents)""")(
    lambda s, d: _docs(s, d).select("doc_id", F.array_sort(T.ngrams(F.col("text"), 3)).alias("grams"))
)
_register("f09_token_estimate", rf"""WITH c AS (SELECT doc_id, length(text) AS n, length(text) - length(regexp_replace(text, '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{3000}}-\x{{303F}}\x{{FF00}}-\x{{FFEF}}]', '', 'g')) AS wide,
 length(text) - length(regexp_replace(text, '{WS}', '', 'g')) AS sp FROM documents)
SELECT doc_id, ceil(round(wide * 1.5 + sp * 0.15 + (n - wide - sp) * 0.25, 6))::BIGINT AS tokens FROM c""")(
    lambda s, d: _docs(s, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))
)
_register("f10_full_width", "SELECT doc_id, translate(text, ',;:!?()', '，；：！？（）') AS text FROM documents")(lambda s, d: _docs(s, d).select("doc_id", T.to_full_width(F.col("text")).alias("text")))
_register("f28_html_to_text", rf"""WITH a AS (SELECT page_id, regexp_replace(html, '<\s*script[^>]*>[\s\S]*?<\s*/\s*script\s*>|<\s*style[^>]*>[\s\S]*?<\s*/\s*style\s*>', '', 'gi') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '<\s*br\s*/?\s*>|<\s*/\s*p\s*>|<\s*/\s*div\s*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '&nbsp;', ' ', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&amp;', '&', 'gi'), '&quot;', '"', 'gi'), '&#39;', '''', 'gi') AS h FROM b),
e AS (SELECT page_id, regexp_replace(regexp_replace(h, '\r\n?', chr(10), 'g'), '[ \t\f\x0B]+', ' ', 'g') AS h FROM c),
f AS (SELECT page_id, regexp_replace(array_to_string(list_transform(string_split(h, chr(10)), lambda x: trim(x)), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g') AS h FROM e)
SELECT page_id, {sql_trim("regexp_replace(h, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')")} AS text FROM f""")(
    lambda s, d: table(s, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))
)
_register("f32_digest", "SELECT doc_id, substring(sha1(text), 1, 12) AS digest, CASE WHEN length(text) > 100 THEN left(text, 100) || '…' ELSE text END AS clip FROM documents")(
    lambda s, d: _docs(s, d).select("doc_id", T.digest(F.col("text")).alias("digest"), T.clipped(F.col("text"), 100).alias("clip"))
)
_register("f12_han_spaces", "SELECT * FROM (VALUES (1, '中文'), (2, '中  文'), (3, 'word test'), (4, '中a')) v(id, t)")(
    lambda s, d: _values([(1, "中 文"), (2, "中  文"), (3, "word test"), (4, "中 a")], "id int, x string")(s, d).select("id", T.squeeze_han_spaces(F.col("x")).alias("t"))
)

# statistics

_TOKEN = r"[\p{L}\p{N}]+"
_register("a03_word_frequency", f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_TOKEN}')) AS word FROM documents) GROUP BY word")(lambda s, d: stats.word_frequency(_docs(s, d)))
_register("a04_character_frequency", f"SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '{WS}', '', 'g'), '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")(
    lambda s, d: stats.character_frequency(_docs(s, d))
)
_register("a05_field_totals", f"""WITH f AS (SELECT 'text' AS field, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'source', coalesce(source, '') FROM documents)
SELECT field, sum(length(t))::BIGINT AS chars, sum(ceil(round((length(t) - length(regexp_replace(t, '{WS}', '', 'g'))) * 0.15 + length(regexp_replace(t, '{WS}', '', 'g')) * 0.25, 6)))::BIGINT AS tokens FROM f GROUP BY field""")(
    lambda s, d: stats.field_totals(table(s, d, "documents"), "text", "source")
)
_register("a06_segment_stats", f"""WITH {MD_DOCS}, l AS (SELECT length({sql_trim('line')}) AS n FROM md_lines) SELECT count(*) AS n, max(n) AS longest, min(n) AS shortest, sum(n)::BIGINT AS total FROM l""")(
    lambda s, d: stats.segment_stats(segment.lines(md_docs(s, d)), target="line")
)
_register("a07_modal_length", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
c AS (SELECT doc_id, length(x) AS n, count(*) AS k, min(i) AS f FROM l WHERE {sql_trim('x')} <> '' GROUP BY doc_id, length(x))
SELECT doc_id, arg_max(n, k * 1000000 - f) AS modal_length FROM c GROUP BY doc_id""")(lambda s, d: stats.modal_length(segment.lines(_docs(s, d))))
_register("a08_progress", "SELECT o_orderstatus AS status, count(*) AS items, round(sum(o_totalprice), 2) AS amount, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY o_orderstatus")(
    lambda s, d: stats.progress(table(s, d, "orders"), "o_orderstatus", "o_totalprice").withColumns({"amount": F.round("amount", 2), "share": F.round("share", 6)})
)
_register("t03_window_calls", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_window FROM events")(
    lambda s, d: stats.calls_in_window(table(s, d, "events")).select("event_id", "user_id", "in_window")
)

# retrieval

def _asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").filter("item_id % 100 = 0").selectExpr("item_id AS query_id", "text AS query")


_BM25 = f"""WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{_TOKEN}'))) AS term FROM documents),
k AS (SELECT * FROM t WHERE NOT (length(term) = 1 AND NOT regexp_matches(term, '[a-z0-9]'))),
l AS (SELECT doc_id, count(*) AS dl FROM k GROUP BY doc_id), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
q AS (SELECT DISTINCT item_id AS query_id, lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'))) AS term FROM benchmark WHERE item_id % 100 = 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM k WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
 FROM tf JOIN df USING (term) JOIN l USING (doc_id) JOIN q USING (term), s GROUP BY ALL)"""
_register("r01_bm25", f"""{_BM25} SELECT * FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x) WHERE rank <= 25""")(
    lambda s, d: retrieve.bm25(_docs(s, d), retrieve.tokens(_asked(s, d), key="query_id", text="query")).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
)
_register("a10_corpus_stats", f"""{_BM25} SELECT n AS n_docs, round(avgdl, 6) AS avg_len FROM s""")(
    lambda s, d: retrieve.corpus_stats(retrieve.tokens(_docs(s, d))).withColumn("avg_len", F.round("avg_len", 6))
)
_GRAMS = lambda src, key, text: f"(SELECT {key}, g, count(*) AS tf FROM (SELECT {key}, unnest(list_transform(range(1, length(t)), lambda i: substring(t, i, 2))) AS g FROM (SELECT {key}, regexp_replace({text}, '\\s+', '', 'g') AS t FROM {src})) GROUP BY ALL)"
_register("r03_bigram_cosine", f"""WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 100 = 0), dg AS {_GRAMS('documents', 'doc_id', 'text')}, qg AS {_GRAMS('q', 'query_id', 'query')},
dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS n FROM dg GROUP BY doc_id), qn AS (SELECT query_id, sqrt(sum(tf * tf)) AS m FROM qg GROUP BY query_id),
x AS (SELECT query_id, doc_id, sum(dg.tf * qg.tf) / (any_value(n) * any_value(m)) AS score FROM dg JOIN qg USING (g) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY ALL)
SELECT * FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x WHERE score >= 0.15) WHERE rank <= 20""")(
    lambda s, d: retrieve.bigram_cosine(_docs(s, d), _asked(s, d)).withColumn("score", F.round("score", 6))
)
_register("r04_dense_cosine", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS query FROM embeddings WHERE vec_id % 100 = 0),
x AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], query) AS score FROM embeddings JOIN q ON vec_id <> query_id)
SELECT * FROM (SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM x) WHERE rank <= 20""")(
    lambda s, d: retrieve.dense_cosine(table(s, d, "embeddings"), table(s, d, "embeddings").filter("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS query")).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")
)
_register("r05_grep", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l WHERE regexp_matches(line, '(?i)th[aeiou]n\\b')) WHERE k <= 80""".replace("\\\\", "\\"))(
    lambda s, d: retrieve.grep(_docs(s, d), r"th[aeiou]n\b")
)

# checks

_VARIANTS = [("é", "e"), ("è", "e"), ("ü", "ue"), ("ñ", "n")]
_DICT = lambda s: s.createDataFrame(_VARIANTS, "variant string, preferred string")
_register("j12_character_check", f"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(0, length(text))) AS pos FROM documents)
SELECT doc_id, variant, preferred, count(*) AS n, min(pos) AS first_pos FROM c JOIN {_sql_values(_VARIANTS, 'variant, preferred')} ON ch = variant GROUP BY ALL""")(lambda s, d: check.character_check(_docs(s, d), _DICT(s)))
_WORDS = [("the", "The"), ("de", "De"), ("und", "Und")]
_register("j10_word_check", f"""SELECT doc_id, variant, preferred, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS w FROM documents) JOIN {_sql_values(_WORDS, 'variant, preferred')} ON w = variant GROUP BY ALL""")(
    lambda s, d: check.word_check(_docs(s, d), s.createDataFrame(_WORDS, "variant string, preferred string"))
)
_register("j11_last_character", f"""SELECT doc_id, variant, preferred, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS w FROM documents) JOIN {_sql_values(_VARIANTS, 'variant, preferred')} ON right(w, 1) = variant GROUP BY ALL""")(
    lambda s, d: check.last_character_check(_docs(s, d), _DICT(s))
)
_register("j13_outside_characters", f"""SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE regexp_matches(ch, '\\p{{L}}') AND ch NOT IN (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyzéèü', ''))) GROUP BY ALL""")(
    lambda s, d: check.outside_characters(_docs(s, d), s.createDataFrame([(c,) for c in "abcdefghijklmnopqrstuvwxyzéèü"], "ch string"), r"\p{L}")
)
_register("j22_heading_difference", f"""WITH {_HEADS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM heads)
SELECT doc_id, min(k) AS "at", 'missing' AS reason FROM n WHERE k > 2 GROUP BY doc_id""")(
    lambda s, d: (lambda h: check.first_heading_difference(h, h.withColumn("k", F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY line_no)")).filter("k <= 2").drop("k")))(segment.headings(md_docs(s, d)))
)

# fusion



# alignment, citations and rewriting

_NORMED = f"""{KEYED}, refs AS (SELECT item_id AS ref_id, regexp_replace({sql_trim('text')}, '{WS}', '', 'g') AS norm FROM benchmark)"""


def _normed(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col("item_id").alias(key), T.normalize(F.col("text")).alias("norm"))


_register("j02_best_matches", f"""WITH {_NORMED.split(', refs AS')[0]}, r AS (SELECT doc_id * 100000 + idx AS ref_id, norm AS r, list_distinct(list_transform(range(1, greatest(length(norm) - 1, 2)), lambda i: substring(norm, i, 3))) AS gr FROM normed WHERE norm <> '' AND length(norm) >= 3),
a AS (SELECT item_id AS cite_id, norm AS a, list_distinct(list_transform(range(1, length(norm) - 1), lambda i: substring(norm, i, 3))) AS ga FROM (SELECT item_id, regexp_replace({sql_trim('text')}, '{WS}', '', 'g') AS norm FROM benchmark)),
x AS (SELECT cite_id, ref_id, CASE WHEN a = r THEN 1.0 ELSE len(list_intersect(ga, gr))::DOUBLE / len(list_distinct(list_concat(ga, gr))) END AS score FROM a JOIN r ON length(r) BETWEEN floor(length(a) * 0.8) AND ceil(length(a) * 1.2))
SELECT * FROM (SELECT cite_id, ref_id, round(score, 6) AS score, row_number() OVER (PARTITION BY cite_id ORDER BY score DESC, ref_id) AS rank FROM x WHERE score >= 0.2) WHERE rank <= 2""")(
    lambda s, d: align.best_matches(
        _normed(table(s, d, "benchmark"), "cite_id"),
        segment.sentences(_docs(s, d)).filter(F.length("sentence") >= 5).select((F.col("doc_id") * 100000 + F.col("idx")).alias("ref_id"), T.normalize(F.col("sentence")).alias("norm")).filter("length(norm) >= 3"),
        threshold=0.2,
    ).withColumn("score", F.round("score", 6))
)


@_register("j20_alignment")
def _aligned(s: SparkSession, d: str) -> DataFrame:
    left = segment.sentences(_docs(s, d))
    right = left.filter("idx % 7 <> 3").withColumn("sentence", F.when(F.col("idx") % 5 == 0, F.concat("sentence", F.lit(" x"))).otherwise(F.col("sentence")))
    return align.align(left, right)


_RULES = {"the": "THE", "they": "THEY", "de la": "DE-LA"}
_register("e02_apply_rules", "SELECT doc_id, replace(replace(replace(replace(replace(text, 'they', chr(2)), 'de la', chr(3)), 'the', 'THE'), chr(2), 'THEY'), chr(3), 'DE-LA') AS text FROM documents")(
    lambda s, d: rewrite.apply_rules(_docs(s, d), _RULES)
)
_register("j14_literal_check", f"""WITH p AS (SELECT doc_id, text, unnest(range(0, length(text))) AS start FROM documents), q AS (SELECT doc_id, start, substring(text, start + 1, 5) AS t FROM p WHERE substring(text, start + 1, 1) IN ('t', 'd'))
SELECT doc_id, variant, preferred, start::INT AS start, (start + length(variant))::INT AS "end" FROM q JOIN {_sql_values([('the', 'THE'), ('they', 'THEY'), ('de la', 'DE-LA')], 'variant, preferred')} ON starts_with(t, variant) AND NOT (variant = 'the' AND starts_with(t, 'they'))""")(lambda s, d: rewrite.literal_check(_docs(s, d), _RULES))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
