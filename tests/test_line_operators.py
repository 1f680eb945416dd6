"""Edge cases of line, selection and rewriting operators."""

import pytest

from lectern.functions.headings import heading_levels
from lectern.operators import numbering, rewrite, sections, select


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_empty_and_null_texts_have_no_quotes_or_numbers(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert rows(sections.blockquotes(docs)) == []
    assert rows(numbering.tree(numbering.numbered_lines(docs))) == []
    assert rows(rewrite.pattern_check(docs, [("a", "b")])) == []
    assert rows(sections.blockquotes(docs.limit(0))) == []


def test_spacing_keeps_the_last_line_and_blank_texts(spark):
    docs = spark.createDataFrame([(1, "a long first line of text\nshort.\na long third line of text"), (2, " \n ")], "doc_id int, text string")
    found = dict(rows(sections.spaced_paragraphs(docs)))
    assert found[2] == " \n "
    assert found[1].replace("\n\n", "\n") == "a long first line of text\nshort.\na long third line of text"
    assert not found[1].endswith("\n")


def test_prefix_longer_than_the_stored_prefixes(spark):
    long = "a" * 80
    entries = spark.createDataFrame([(long + "b", "1"), ("a" * 70, "2"), (None, "3")], "headword string, body string")
    terms = spark.createDataFrame([(long,), ("a" * 70,), ("a",)], "term string")
    assert rows(select.prefix_entries(terms, entries)) == [("a" * 70, "a" * 70, "2"), (long, long + "b", "1")]


def test_anchors_outside_the_document_are_dropped(spark):
    docs = spark.createDataFrame([(1, "a\n\nb")], "doc_id int, text string")
    anchors = spark.createDataFrame([(1, 0), (1, 3), (1, 4), (2, 1)], "doc_id int, line_no int")
    assert rows(sections.expand(docs, anchors, "md_paragraph")) == [(1, 3, 3, 3, "b")]


def test_heading_levels():
    assert heading_levels("1，2, 4,2") == [1, 2, 4]
    for bad in ("", "0", "7", "x", "1.5"):
        with pytest.raises(ValueError):
            heading_levels(bad)
