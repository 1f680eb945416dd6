"""Files, streams and the in-order text functions."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import align, rewrite, segment
from lectern.sources import files
from lectern.streaming import state


def test_folder_scan_catalog_and_rules(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "a" / "x.md").write_text("# One\ntext\n## Two")
    (tmp_path / "a" / ".git" / "no.md").write_text("# hidden")
    (tmp_path / "a" / "y.txt").write_text("plain")
    (tmp_path / "a" / "z.bin").write_text("no")
    found = files.documents(spark, str(tmp_path))
    assert sorted(r.file.rsplit("/", 1)[1] for r in found.collect()) == ["x.md", "y.txt"]
    assert [(r.n_files, r.n_headings) for r in files.catalog(found).collect()] == [(2, 2)]
    (tmp_path / "rules.cfg").write_text("a\\=b=c#note\n# only a comment\nx=\n")
    assert [tuple(r) for r in files.rules(spark, str(tmp_path / "rules.cfg")).collect()] == [("a=b", "c", "note"), ("x", "", "")]


def test_memory_stream(spark, tmp_path):
    ops = [(1, 1, "add", "x", 1, "b"), (1, 2, "add", "y", 5, "b"), (1, 3, "bump", "x", 9, ""), (1, 4, "add", "z", 7, "c"), (1, 5, "set", "z", 0, "d"), (2, 1, "add", "q", 1, "e"), (2, 2, "remove", "q", 0, "")]
    schema = "key long, seq int, op string, id string, weight int, body string"
    spark.createDataFrame(ops, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = state.memory(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), cap=2)
    query = out.writeStream.outputMode("update").format("memory").queryName("memory_out").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("memory_out").collect()) == [(1, "x", 10, "b"), (1, "z", 7, "d")]


def test_dedupe_and_windows_on_a_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).limit(200)
    events.unionByName(events).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    query = state.fresh(stream, ["event_id"], "ts", "1 hour").writeStream.format("memory").queryName("fresh_out").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("fresh_out").count() == events.count()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcdef", min_size=1, max_size=8), max_size=12), st.lists(st.text(alphabet="abcdef", min_size=1, max_size=8), max_size=12))
def test_alignment_covers_every_sentence_once(a, b):
    out = align.aligned(a, b)
    left = sorted(i for t, ia, _, _ in out for i in ia)
    right = sorted(j for t, _, jb, _ in out for j in jb)
    assert left == list(range(len(a))) and right == list(range(len(b)))
    kinds = [t for t, *_ in out]
    assert kinds.count("moveout") == kinds.count("movein")
    matched = [jb[0] for t, _, jb, _ in out if t == "match"]
    assert matched == sorted(matched)


def test_alignment_of_equal_texts_is_all_matches():
    assert [r[0] for r in align.aligned(["abc", "def", "ghi"], ["abc", "def", "ghi"])] == ["match"] * 3


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c", max_size=30), st.lists(st.text(alphabet="ab", min_size=1, max_size=3), max_size=4))
def test_literal_matches_are_disjoint_and_right(text, finds):
    found = rewrite.literal_matches(text, finds)
    assert all(text[a:b] == f for f, a, b in found)
    assert all(x[2] <= y[1] for x, y in zip(found, found[1:]))


def test_replacements():
    assert rewrite.replaced_spans("abcdef", [(0, 2, "X"), (1, 3, "Y"), (4, 5, "Z")]) == "aYdZf"
    assert rewrite.replaced_once("aa b", [("a", "x"), ("q", "z")]) == ("xa b", 1)
    assert rewrite.word_changes("a b c".split(), "a x c".split()) == [("b", "x")]
    assert rewrite.overlap_kept(["abcd", "abcd", "xyz"]) == [True, False, True]


def test_one_changed_word_is_found_among_repeats():
    words = "a b a b c a b a b a a".split()
    for at, word in enumerate(words):
        assert rewrite.word_changes(words, words[:at] + [word + "☆"] + words[at + 1 :]) == [(word, word + "☆")]
    assert rewrite.word_changes(["a"] * 5, ["a", "a", "x", "a", "a"]) == [("a", "x")] and rewrite.word_changes([], ["a"]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_common_places_are_longest(a, b):
    found = rewrite.common_places(a, b)
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
    assert len(found) == longest[-1][-1] and all(a[i] == b[j] for i, j in found)
    assert all(p < q and r < s for (p, r), (q, s) in zip(found, found[1:]))


def test_sentences_restore_the_text(spark):
    texts = ["一。二！”\n\n三？ in 1999. Next... end\n \n　\nA.B", "no stop", "", "a!?\n\n\nb"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    out = rows.select("text", F.translate(segment.marked_sentences(F.col("text")), segment.CUT, "").alias("back")).collect()
    assert all(r.text == r.back for r in out)
    spans = segment.sentence_spans(rows).collect()
    assert all(texts[r.doc_id][r.start_offset : r.end_offset] == r.sentence for r in spans)


def test_normalization_options(spark):
    row = spark.createDataFrame([("　a1①[^2]，^x^ b　",)], "t string").select(T.normalize(F.col("t"), T.CITATION).alias("c"), T.trimmed(F.col("t")).alias("p")).first()
    assert row.c == "，" and row.p == "a1①[^2]，^x^ b"


def test_units_are_written_in_order(spark, tmp_path):
    from lectern.sources import files

    rows = [(k, i, None if i == 3 else f"unit {k}.{i}\n\nend") for k in (2, 1) for i in (4, 0, 3, 2, 1)]
    files.write_units(spark.createDataFrame(rows, "doc_id int, idx int, target string").repartition(5), str(tmp_path))
    joined = "".join(p.read_text() for p in sorted((tmp_path / "joined").glob("part-*")))
    assert joined == "".join(("" if i == 3 else f"unit {k}.{i}\n\nend") + files.UNIT_BREAK for k in (1, 2) for i in range(5))
    assert spark.read.json(str(tmp_path / "units")).count() == 10
    assert {(r.doc_id, r.units, r.longest, r.shortest, r.chars) for r in spark.read.json(str(tmp_path / "stats")).collect()} == {(1, 5, 13, 0, 52), (2, 5, 13, 0, 52)}
