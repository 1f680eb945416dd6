"""Hand-computed cases of scalar functions and numbered lines."""

from pyspark.sql import functions as F

from lectern.functions import evidence as E
from lectern.functions import headings as H
from lectern.functions import text as T
from lectern.operators import check, numbering, persons, rewrite, segment


def results(spark, inputs, of):
    rows = [(i, x) for i, x in enumerate(inputs)]
    return [r.v for r in spark.createDataFrame(rows, "i int, x string").select("i", of(F.col("x")).alias("v")).orderBy("i").collect()]


def test_numbers(spark):
    assert results(spark, ["二十一", "十"], T.han_number) == [21, 10]
    assert results(spark, ["MCMXCIV", "IV"], T.roman_number) == [1994, 4]
    assert results(spark, ["AB", "a"], T.letter_number) == [28, 1]
    assert results(spark, ["③", "⑳"], T.circled_number) == [3, 20]
    assert results(spark, ["1.2", "1"], T.multi_level) == [10002, 1]
    assert results(spark, ["元", "十", "十五", "二十", "九十九", "百", "三"], E.era_year) == [1, 10, 15, 20, 99, None, 3]


def test_titles(spark):
    titles = ["1.", "（一）", "4. A. x", "12.a)y", "A.z", "十. q", "plain", " ( 3 ) ", ""]
    assert results(spark, titles, H.leading_serial) == ["1", "一", "4", "12", "A", "十", None, "3", None]
    assert results(spark, titles, H.is_only_serial) == [True, True, False, False, False, False, False, True, False]
    lines = ["## a", "b", "  # c", "###### d"]
    assert results(spark, lines, H.promoted) == ["# a", None, "  # c", "##### d"]
    assert results(spark, lines, H.demoted) == ["### a", "# b", "  ## c", None]
    assert results(spark, lines, lambda x: H.to_title(x, F.lit(2))) == ["### a", "### b", "  ### c", "### d"]


def test_numbered_lines_and_their_tree(spark):
    text = "第一章 a\n一、b\n（一）c\n1. d\n2. e\n1.2.3 f\n二、g\n① h\nplain\n# 第2节 i\n    § 3.1 j\nAB. k"
    rows = numbering.tree(numbering.numbered_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))).orderBy("line_no").collect()
    assert [(r.line_no, r.slot, r.level, r.number, r.value, r.parent) for r in rows] == [
        (1, 1, 0, "一", 1, 0), (2, 4, 2, "一", 1, 1), (3, 5, 3, "一", 1, 2), (4, 13, 4, "1", 1, 3), (5, 13, 4, "2", 2, 3), (6, 7, 6, "1.2.3", 100020003, 5),
        (7, 4, 2, "二", 2, 1), (8, 11, 6, "①", 1, 7), (10, 3, 1, "2", 2, 1), (11, 2, 1, "3.1", 30001, 1), (12, 12, 7, "AB", 28, 11),
    ]


def test_contents_outlines_and_quotes(spark):
    toc = segment.toc_entries(spark.createDataFrame([(1, "- One\n    - Two\n        * Three\n    - Two b\n- Four\nplain")], "doc_id int, text string"))
    assert [(r.line_no, r.level, r.title) for r in toc.orderBy("line_no").collect()] == [(1, 1, "One"), (2, 2, "Two"), (3, 3, "Three"), (4, 2, "Two b"), (5, 1, "Four")]
    pairs = spark.createDataFrame([(1, "# a\n## b\n## c", "# a\n##  b\n## d"), (2, "# a", "## a"), (3, "# a", "# a")], "doc_id int, x string, y string")
    assert {r.doc_id: r.first_difference for r in check.outline_difference(pairs).collect()} == {1: 2, 2: 0, 3: -1}
    quotes = rewrite.quotes(spark.createDataFrame([(1, "x“a「b」c”y《t》”")], "doc_id int, text string")).orderBy("start").collect()
    assert [(r.start, r.end, r.quote) for r in quotes] == [(1, 8, "“a「b」c”"), (9, 12, "《t》")]


def test_evidence(spark):
    long = "a line that is long enough to be kept as it stands, with more than forty-eight characters"
    snippets = ["02:42", "02:42\n李白（701—762），字太白，号青莲居士，唐代诗人。", "目录\n作品原文\n词句注释", "short", long, "02:42\n" + long]
    assert results(spark, snippets, E.is_noisy) == [True, True, True, True, False, True]
    assert results(spark, snippets, E.clean_snippet) == ["", "", "", "", long, long]
    odd = ["  \n" + long, "12:34:56\n" + long + "\n 作品名称 x", "# Head\n" + long, "# Head", "#\nabcdefghijklmnop", "视频 x\n配乐\n" + long, "a　b" * 90 + "\n\n1:02", None, " \n "]
    assert results(spark, odd, E.is_noisy) == [False, True, True, True, True, True, False, True, True]
    assert results(spark, odd, E.clean_snippet) == [long, long, long, "", "", long, "a　b" * 90, "", ""]
    plan = spark.range(1).select(E.clean_snippet(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 20  # each line is judged once, not once for each test of the snippet
    assert results(spark, ["李 白（革命烈士）", " 李白 [x]", "a b(c)"], E.dictionary_candidate) == ["李白", "李白", "a b"]
    terms = spark.createDataFrame([(["李白/李朴"],), (["杜甫"],)], "t array<string>").select(E.anchor_terms(F.col("t")).alias("a")).collect()
    assert [r.a for r in terms] == [["李白/李朴", "李白", "李朴"], ["杜甫"]]


def test_persons_of_odd_rows(spark):
    known = spark.createDataFrame([("李白", None, "701"), ("李白", None, "？"), ("", "x", "y"), (None, "x", "y")], "name string, label string, raw string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "李白"), (4, "李白（"), (5, "李白（）李白（701）李　白")], "doc_id int, text string")
    rows = {(r.doc_id, r.variant, r.preferred): (r.n, r.first_pos) for r in persons.person_check(docs, known).collect()}
    assert rows == {(3, "李白", persons.HINT): (1, 0), (5, "李白（）", persons.HINT): (1, 0), (5, "李白（701）", persons.OK): (1, 4), (5, "李白（701）", persons.SEVERAL): (1, 4), (5, "李　白", persons.HINT): (1, 11)}
    none = spark.createDataFrame([], "name string, label string, raw string")
    assert persons.person_check(docs, none).count() == 0


def test_words_by_a_segmenter(spark):
    docs = spark.createDataFrame([(1, "ab  cd!"), (2, None), (3, "")], "doc_id int, text string")
    pairs = lambda t: [(t[i], "y") for i in range(len(t)) if t[i] != " "]
    assert [(r.word, r.tag, r.start, r.end) for r in segment.words(docs, pairs).orderBy("idx").collect()] == [("a", "y", 0, 1), ("b", "y", 1, 2), ("c", "y", 4, 5), ("d", "y", 5, 6), ("!", "y", 6, 7)]
    assert [(r.word, r.tag, r.start) for r in segment.words(docs).orderBy("idx").collect()] == [("ab", "n", 0), ("cd", "n", 4), ("!", "x", 6)]
