"""Operators that no query over the tables covers, and odd rows of those that one does."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import align, fuse, order, segment, select
from lectern.sources import files


def test_strengths():
    assert select.strength("light")["selected"] == 3 and select.strength("unknown") == select.STRENGTHS["standard"]
    assert select.strength("thorough", rounds=-2, queries=None) == select.STRENGTHS["thorough"] | {"rounds": 0}
    with pytest.raises(ValueError):
        select.strength("light", nothing=1)


def test_classes_are_written_out():
    assert T.expanded_classes(r"\c+x") == "[一-鿿]+x"


def test_greedy_pairs_use_each_clause_once():
    assert align.greedy_pairs(["abcd", "abcd", "zz"], ["abce", "abcd", "qq"]) == [(0, 1), (1, 0)]
    assert align.greedy_pairs(["ab", "cd"], ["xab", "ab"], threshold=0.5) == [(0, 1)]
    assert align.greedy_pairs([], ["a"]) == [] == align.greedy_pairs(["a"], [])


def test_best_matches_by_index_equal_the_join(spark, monkeypatch):
    texts = ["abcabd", "abcabe", "ab", "ab", "b", "", "xyzxyz", "abcab", "日本語の文", "日本語の本", "abcabd"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, norm string")
    cites, refs = rows.withColumnRenamed("i", "cite_id"), rows.withColumnRenamed("i", "ref_id")
    monkeypatch.setattr(align, "CITATIONS", 4)
    found = align.best_matches(cites, refs, 0.2)
    want = align.bucket_matches(cites, refs, 0.2, 0.2, 3, 2)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_follow_the_order(spark):
    frame = spark.range(300).selectExpr("id % 17 AS x", "id AS y").unionAll(spark.createDataFrame([(None, -1)], "x long, y long"))
    found = order.numbered(frame, "x", parts=7).orderBy("nth").collect()
    assert [r.nth for r in found] == list(range(1, 302)) and found[0].y == -1 and [r.x for r in found[1:]] == sorted(r.x for r in found[1:])
    assert order.numbered(frame.limit(0), "x").count() == 0


def test_a_long_document_is_cut_in_linear_time(spark):
    text = "\n\n".join(f"paragraph {i} of many." for i in range(3000))
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    paragraphs = segment.paragraphs(frame).orderBy("start_line").collect()
    assert len(paragraphs) == 3000 and paragraphs[-1].start_line == paragraphs[-1].end_line == 5999
    pieces = segment.by_length(frame.filter("doc_id = 1")).orderBy("idx").collect()
    assert "\n".join(p.target for p in pieces) == text and all(len(p.target) >= 600 for p in pieces[:-1])
    assert [r.target for r in segment.merge_short(spark.createDataFrame([(1, ["a", "b" * 100, "c", "d"]), (2, [])], "doc_id int, units array<string>")).orderBy("idx").collect()] == ["a\n" + "b" * 100, "c\nd"]
    spans = segment.sentence_spans(frame.filter("doc_id = 1")).orderBy("start_offset").collect()
    assert all(text[r.start_offset : r.end_offset] == r.sentence for r in spans)


def test_structured_sentences(spark):
    text = "One. Two.\n# Head. line\n\n\nThree.\n- item a. b\n1) next\nFour"
    found = [r.sentence for r in segment.structured_sentences(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("idx").collect()]
    assert found == ["One.", "Two.", "# Head. line\n\n\n", "Three.", "- item a. b\n", "1) next\n", "Four"] or found[2].startswith("# Head. line\n")
    assert "".join(found).count("Three.") == 1 and "- item a. b\n" in found


def test_a_body_is_one_text(spark):
    units = spark.createDataFrame([("# H", "c"), ("x", "c")], "target string, context string")
    one = spark.createDataFrame([("body",)], "text string")
    assert {tuple(r) for r in align.body_into_units(units, one, levels=(1,)).collect()} == {("# H", "c"), ("x", "body")}
    with pytest.raises(ValueError):
        align.body_into_units(units, one.unionAll(one))


def test_soft_selection_lets_the_first_hit_exceed_the_budget(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 500), (1, 2, 0.8, 1), (2, 3, 0.1, 1)], "query_id int, hit_id int, score double, chars int")
    assert {(r.hit_id, r.suggested) for r in fuse.soft_selected(rows, 0.3, 3, 100).collect()} == {(1, True), (2, False), (3, False)}


def test_refresh_sets_and_entry_scores(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "file string") for xs in (["a", "b", "b"], ["b", "c"]))
    assert {tuple(r) for r in files.vanished_and_new(a, b).collect()} == {("a", "deleted"), ("c", "added")}
    entry = spark.createDataFrame([("key word", "key", "a key", ["key"], 0.4)], "target string, matched_key string, cleaned string, candidates array<string>, priority double")
    scored = select.entry_scores(entry).first()
    assert scored.final_score == max(0.2, scored.relevance) and 0 <= scored.relevance <= 1
    assert select.entry_scores(entry.select("target", "matched_key", "cleaned", "candidates", F.lit(5.0).alias("priority"))).first().final_score == 2.5


def test_exact_entries_spread_a_frequent_key(spark, monkeypatch):
    monkeypatch.setattr(select, "ENTRIES", 8, raising=False)
    monkeypatch.setattr(select, "TERMS", 16, raising=False)
    asked = [(i, "often") for i in range(200)] + [(200, "once"), (201, "none"), (202, None), (203, " o​nce")]
    known = [("often", i % 60) for i in range(120)] + [("once", 1), ("once", 1), (None, 2), ("other", 3)]
    terms, entries = spark.createDataFrame(asked, "id long, term string"), spark.createDataFrame(known, "headword string, body long")
    found = select.exact_entries(terms, entries)
    assert found.columns == ["id", "term", "headword", "body"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = found.withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = [(i, t, h, b) for i, t in asked if t for h, b in known if h and t.replace("​", "").strip() == h]
    assert sorted((r.id, r.term, r.headword, r.body) for r in rows) == sorted(want)
    assert len({r["at"] for r in rows if r.headword == "often"}) > 1
