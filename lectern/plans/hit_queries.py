"""Registered queries on hits, evidence, dictionaries and years."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..operators import select
from .registry import documents, register, values
from .views import table

_PLAN = [(1, "entity", ["李白/李朴"]), (2, "entity", ["杜甫"]), (3, "fact", ["李白"])]
register("j27_unasked", "SELECT * FROM (VALUES (2), (3)) v(query_id)")(
    lambda s, d: select.unasked(values(_PLAN, "query_id int, intent string, terms array<string>")(s, d), values([("entity", ["李白/李华初"])], "intent string, terms array<string>")(s, d)).select("query_id")
)
register("r09_scope_match", """WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark)
SELECT item_id, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains('the people of this place were not the same in those years', x)))::DOUBLE / len(w) ELSE 0 END, 6) AS score FROM t""")(
    lambda s, d: table(s, d, "benchmark").select("item_id", F.round(E.contained_share(E.match_tokens(F.col("text")), F.lit("the people of this place were not the same in those years")), 6).alias("score"))
)
register("r12_relevance", "SELECT * FROM (VALUES (1, 0.583333e0), (2, 0.0e0), (3, 1.0e0)) v(id, score)")(
    lambda s, d: values([(1, "other words", "key", "nothing", ["key"]), (2, "", "k", "x", []), (3, "key", "key", "x", ["key"])], "id int, t string, h string, b string, c array<string>")(s, d).select(
        "id", F.round(E.relevance(F.col("t"), F.col("h"), F.col("b"), F.col("c")), 6).alias("score"))
)
register("w09_top_per_group", """SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")(
    lambda s, d: select.top_per_group(table(s, d, "orders"), 3, group="o_custkey", score="o_totalprice", tie="o_orderkey").select("o_custkey", "o_orderkey", "rank")
)
register("w15_newest", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k <= 5")(
    lambda s, d: select.newest(table(s, d, "events"), 5, group="user_id", at="ts", tie="event_id").select("event_id")
)
register("k02_by_confidence", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_totalprice > 100000 THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS rank FROM orders")(
    lambda s, d: select.by_confidence(table(s, d, "orders").withColumn("c", F.expr("CASE WHEN o_totalprice > 100000 THEN o_totalprice END")), group="o_custkey", confidence="c", tie="o_orderkey").select("o_orderkey", "rank")
)
register("p08_confident", "SELECT event_id FROM events WHERE value IS NULL OR value >= 50")(lambda s, d: table(s, d, "events").filter("value IS NULL OR value >= 50").select("event_id"))
register("a12_hit_counts", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) AS n_patterns, count(*) OVER (PARTITION BY l_orderkey) AS n_in_file FROM lineitem")(
    lambda s, d: select.hit_counts(table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey AS unit_key", "l_orderkey AS file", "array('p') AS patterns")).select("l_orderkey", "l_linenumber", "n_patterns", "n_in_file")
)
register("s18_packed", "SELECT substring(sha1(lower(text)), 1, 2) AS digest, arg_min(doc_id, (-length(text), text, doc_id)) AS doc_id FROM documents GROUP BY 1")(
    lambda s, d: select.packed(documents(s, d).select(F.substring(F.sha1(F.lower("text")), 1, 2).alias("digest"), F.col("text").alias("body"), "doc_id")).join(documents(s, d), F.col("body") == F.col("text")).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
)
_TABLE = [("a", [None, "b"]), ("cc", ["cc"]), ("d", [None]), ("e", ["e", "f"])]
register("s15_dictionary_view", "SELECT * FROM (VALUES ('a', 'b')) v(variant, preferred)")(lambda s, d: select.dictionary_view(values(_TABLE, "variant string, preferred array<string>")(s, d), True, 1))
