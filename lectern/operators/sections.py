"""Quotes, paragraph breaks, units around a line and titles: operators on the lines of a document.

Windows are partitioned by document, so no partition holds more than one document needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headings import clean_title
from ..functions.text import SPACE, line_endings, trimmed
from .segment import lines, sentence_spans
from .stats import modal_length

# What ends a line of a paragraph, and what may begin the next paragraph.
LINE_END = r"[。！？：；—…]+[’”）]*$"
NEW_START = "^[A-Z0-9一二三四五六七八九十]"


def _joined(rows: str, field: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", rows))), lambda x: x[rows]), "\n").alias(field)


def line_paragraphs(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, paragraph): the number, from 0, of the paragraph that holds the line; 0 for blank lines."""
    order = Window.partitionBy(key).orderBy("line_no")
    blank = trimmed(F.col("line")) == ""
    first = ~F.col("blank") & F.coalesce(F.lag("blank").over(order), F.lit(True))
    rows = lines(df, key=key, text=text).withColumn("blank", blank).withColumn("first", first.cast("int"))
    return rows.select(key, "line_no", F.when(F.col("blank"), 0).otherwise(F.sum("first").over(order) - 1).cast("long").alias("paragraph"))


def blockquotes(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_line, end_line, quote): runs of lines that begin with a quote mark, marks removed."""
    order = Window.partitionBy(key).orderBy("line_no")
    rows = lines(df, key=key, text=text).withColumn("quoted", F.col("line").rlike(rf"^{SPACE}*>")).withColumn("run", F.sum((~F.col("quoted")).cast("int")).over(order))
    bare = rows.filter("quoted").withColumn("line", F.regexp_replace("line", "^" + SPACE[:-1] + ">]*", ""))
    return bare.groupBy(key, "run").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), _joined("line", "quote")).drop("run")


def quote_sentences(quotes: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, sentence, start_line, end_line) of block quotes, with line numbers of the document."""
    whole = quotes.select(F.struct(key, "start_line").alias("place"), F.col("quote").alias("text"))
    found = sentence_spans(whole, key="place")
    shift = lambda c: (F.col(c) + F.col("place.start_line") - 1).alias(c)
    return found.select(F.col(f"place.{key}").alias(key), trimmed(F.col("sentence")).alias("sentence"), shift("start_line"), shift("end_line"))


def paragraph_ends(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, score): how likely a line ends a paragraph, from its length against the document's most
    frequent one, its last mark, and the indent and length of the next line. Blank lines have no score."""
    rows = lines(df, key=key, text=text)
    rows = rows.join(modal_length(rows, key=key), key, "left")
    n, mode, off = F.length("line"), F.col("modal_length"), F.length("line") - F.col("modal_length")
    stop, near = trimmed(F.col("line")).rlike(LINE_END), F.abs(off) <= 3
    after = F.lead("line").over(Window.partitionBy(key).orderBy("line_no"))
    nxt, follows = F.col("next"), F.coalesce(trimmed(F.col("next")) != "", F.lit(False))
    short_by = mode - F.length(nxt)
    indented = nxt.rlike(r"^\s{3,4}") | (short_by.between(2, 3) & ~nxt.rlike(r"^\s"))
    score = (
        F.when(off < -3, 2).when(off > 3, 1).when(~stop, -2).otherwise(0)
        + F.when(stop, F.when(near, 1).otherwise(3)).otherwise(0)
        + F.when(follows & indented, 2 + trimmed(nxt).rlike(NEW_START).cast("int")).otherwise(0)
        + F.when(follows & (F.length(nxt) * 10 > n * 12), 2).when(follows & (F.length(nxt) * 10 > n * 11), 1).otherwise(0)
    )
    return rows.withColumn("next", after).select(key, "line_no", "line", F.when(trimmed(F.col("line")) != "", score).alias("score"))


def spaced_paragraphs(df: DataFrame, least: int = 3, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with a blank line after each line of at least that score, but for the last line that is not blank."""
    last = F.max(F.when(F.col("score").isNotNull(), F.col("line_no"))).over(Window.partitionBy(key))
    ends = paragraph_ends(df, key=key, text=text).withColumn("last", last)
    spaced = F.when((F.col("score") >= least) & (F.col("line_no") < F.col("last")), F.concat("line", F.lit("\n"))).otherwise(F.col("line"))
    return ends.withColumn("line", spaced).groupBy(key).agg(_joined("line", "text"))


def _level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s+", 1))


def expand(df: DataFrame, anchors: DataFrame, unit: str = "line_context", context: int = 2, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, start_line, end_line, snippet) around each anchor line (key, line_no).

    unit: line_context, md_paragraph, heading_section or file_outline. A blank line has no paragraph and gets its
    context. A section runs from the last heading to the next of its own level or a higher one, level 1 where the
    anchor is no heading itself. Anchors outside the document are dropped.
    """
    at, n = F.col("line_no"), F.size("ls")
    rows = df.select(key, F.split(line_endings(F.col(text)), "\n").alias("ls")).join(anchors.select(key, "line_no"), key).filter((at >= 1) & (at <= n))
    near = (F.greatest(at - context, F.lit(1)), F.least(at + context, n))
    places = lambda test: F.filter(F.transform("ls", lambda x, i: F.when(test(x), i + 1)), lambda p: p.isNotNull())
    if unit == "file_outline":
        start, end = at, at
    elif unit == "md_paragraph":
        blanks = places(lambda x: trimmed(x) == "")
        blank = trimmed(F.element_at("ls", at)) == ""
        start = F.when(blank, near[0]).otherwise(F.coalesce(F.array_max(F.filter(blanks, lambda p: p < at)), F.lit(0)) + 1)
        end = F.when(blank, near[1]).otherwise(F.coalesce(F.array_min(F.filter(blanks, lambda p: p > at)), n + 1) - 1)
    elif unit == "heading_section":
        own = _level(F.element_at("ls", at))
        rows = rows.withColumn("start", F.coalesce(F.array_max(F.filter(places(lambda x: _level(x) > 0), lambda p: p <= at)), at)).withColumn("own", F.when(own > 0, own).otherwise(1))
        start = F.col("start")
        close = places(lambda x: _level(x).between(1, F.col("own")))
        end = F.coalesce(F.array_min(F.filter(close, lambda p: p > F.col("start"))), n + 1) - 1
    else:
        start, end = near
    out = rows.withColumn("start_line", start).withColumn("end_line", end)
    return out.select(key, "line_no", "start_line", "end_line", F.array_join(F.slice("ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("snippet"))


def mark_titles(df: DataFrame, toc: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, level): lines whose cleaned title is in the table of contents (title, level) become headings.

    Every match is rewritten; of several entries with one title the highest level number wins. Other lines have no level.
    """
    bare = F.regexp_replace(trimmed(F.col("line")), r"^#+\s+", "")
    rows = lines(df, key=key, text=text).withColumn("bare", bare).withColumn("title", clean_title(F.col("bare")))
    found = rows.join(toc.groupBy("title").agg(F.max("level").alias("level")), "title", "left")
    return found.select(key, "line_no", F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("bare"))).otherwise(F.col("line")).alias("line"), "level")


def missing_titles(df: DataFrame, toc: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Entries of the table of contents that no line has."""
    titles = lines(df, key=key, text=text).select(clean_title(F.regexp_replace(trimmed(F.col("line")), r"^#+\s+", "")).alias("title")).distinct()
    return toc.join(titles, "title", "left_anti")


