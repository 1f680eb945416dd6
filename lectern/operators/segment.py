"""Splitting documents into lines, chunks, sections, sentences, clauses and paragraphs.

Every operator takes rows (key, text) and returns rows (key, idx, ...); a document is split
inside its own row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, bound, line_endings, trimmed

# What may close a sentence after its stop, and what ends a clause.
CLOSERS = r"""["')）\]】」』”’]"""
CLAUSE_ENDS = "，；。？！"
CUT = "\u0001"


def lines(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line), numbered from 1."""
    return df.select(key, F.posexplode(F.split(line_endings(F.col(text)), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def _pieces(df: DataFrame, key: str, pieces: Column, name: str) -> DataFrame:
    return df.select(key, F.posexplode(pieces).alias("idx", name))


def _blank(line: Column) -> Column:
    return trimmed(line) == ""


def _at(items: Column, starts: Column) -> Column:
    """The items in runs that begin at the given places (from 1, ascending, 1 the first), joined by line breaks; items and starts are read once."""
    ends = lambda b, i: F.when(i + 1 < F.size(b), F.get(b, i + 1)).otherwise(F.size(items) + 1)
    return bound(starts, lambda b: F.transform(b, lambda a, i: F.array_join(F.slice(items, a, ends(b, i) - a), "\n")))


def _starting(items: Column, starts) -> Column:
    """Runs that begin at the first item and at every later one for which starts(item)."""
    return bound(items, lambda xs: F.when(F.size(xs) > 0, _at(xs, F.filter(F.sequence(F.lit(1), F.size(xs)), lambda i: (i == 1) | starts(F.get(xs, i - 1))))).otherwise(xs))


def _closing(items: Column, ends) -> Column:
    """Runs that end with every item for which ends(item)."""
    return bound(items, lambda xs: F.when(F.size(xs) > 0, _at(xs, F.filter(F.sequence(F.lit(1), F.size(xs)), lambda i: (i == 1) | ends(F.get(xs, i - 2))))).otherwise(xs))


def _filled(items: Column, limit: int) -> Column:
    """Runs that close at the first blank item once they hold limit characters; only the places of the breaks are carried along."""

    def step(a: Column, x: Column) -> Column:
        n = a.n + F.length(x)
        close = (n >= limit) & _blank(x)
        return F.struct(F.when(close, F.concat(a.starts, F.array(a["at"] + 1))).otherwise(a.starts).alias("starts"), F.when(close, 0).otherwise(n).alias("n"), (a["at"] + 1).alias("at"))

    begin = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(0).alias("n"), F.lit(1).alias("at"))
    found = lambda xs: F.aggregate(xs, begin, step, lambda a: F.filter(a.starts, lambda k: k <= F.size(xs)))
    return bound(items, lambda xs: F.when(F.size(xs) > 0, _at(xs, found(xs))).otherwise(xs))


def by_length(df: DataFrame, cut_by: int = 600, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks that close at the first blank line once their lines hold cut_by characters (50 at least)."""
    return _pieces(df, key, chunks_of(line_endings(F.col(text)), cut_by), "target")


def chunks_of(text: Column, cut_by: int) -> Column:
    return _filled(F.split(text, "\n"), max(50, cut_by))


def by_title(df: DataFrame, levels: tuple[int, ...] = (2,), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections that begin at a line of exactly one of the heading levels."""
    title = lambda x: F.lit(False) if not levels else x.rlike("^(?:" + "|".join("#" * n for n in levels) + ") ")
    return _pieces(df, key, _starting(F.split(line_endings(F.col(text)), "\n"), title), "target")


def by_title_and_length(df: DataFrame, levels: tuple[int, ...] = (2,), cut_by: int = 600, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, idx, target, context): each section cut by length, with the section as context."""
    sections = by_title(df, levels, key=key, text=text).withColumnsRenamed({"idx": "section", "target": "context"})
    limit = max(50, cut_by)
    pieces = _filled(F.split("context", "\n"), limit)
    return sections.select(key, "section", "context", F.posexplode(pieces).alias("idx", "target")).select(key, "section", "idx", "target", "context")


def resplit_long(df: DataFrame, threshold: int = 1500, cut_by: int = 800, *, key: str = "doc_id", target: str = "target") -> DataFrame:
    """Units (key, idx, target) with those over the threshold cut again: (key, idx, piece, target)."""
    limit = max(50, cut_by)
    cut = _filled(F.split(F.col(target), "\n"), limit)
    pieces = F.when(F.length(target) > threshold, cut).otherwise(F.array(F.col(target)))
    return df.select(key, "idx", F.posexplode(pieces).alias("piece", target))


def merge_short(df: DataFrame, least: int = 100, *, key: str = "doc_id", units: str = "units") -> DataFrame:
    """Short units join the next long one; short ones at the end form one unit. units is an array column."""
    return _pieces(df, key, _closing(F.col(units), lambda x: F.length(x) >= least), "target")


def marked_sentences(text: Column) -> Column:
    """The text with U+0001 after each sentence; without the marks it is the text again."""
    out = F.regexp_replace(line_endings(text), rf"([。！？…]+{CLOSERS}*|[.!?]+{CLOSERS}*)", f"$1{CUT}")
    out = F.regexp_replace(out, rf"([0-9][.!?]*\.){CUT}", "$1")
    out = F.regexp_replace(out, rf"{CUT}((?:\n[ \t]*\n)*\n?)", f"$1{CUT}")
    return F.regexp_replace(out, rf"(\n(?:{SPACE}*\n)+)", f"$1{CUT}")


def sentences(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, sentence): trimmed sentences that are not blank."""
    found = F.filter(F.transform(F.split(marked_sentences(F.col(text)), CUT), trimmed), lambda s: s != "")
    return _pieces(df, key, found, "sentence")


def sentence_spans(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, sentence, start_line, end_line, start_offset, end_offset): untrimmed spans that tile the text.

    A span's start line is that of its first visible character. Blank spans are left out.
    """
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    # Marks and line breaks by place: a mark's place among both tells the lines before it, its place among marks how far it shifts the text.
    signs = lambda m: F.filter(F.transform(F.split(m, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda e: e.c.isin(CUT, "\n"))
    marks = lambda m: F.filter(F.transform(signs(m), lambda e, j: F.struct(e.c.alias("c"), e.i.alias("i"), j.alias("j"))), lambda e: e.c == CUT)
    begin = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"))
    places = lambda m: F.concat(F.array(begin), F.transform(marks(m), lambda e, k: F.struct((e.i - k).alias("at"), (e.j - k + 1).alias("line"))))
    each = lambda z: F.struct(z.s.alias("s"), z.p["at"].alias("at"), z.p.line.alias("line"))
    spans = bound(marked_sentences(F.translate(F.col(text), CUT, " ")), lambda m: F.transform(F.arrays_zip(F.split(m, CUT).alias("s"), places(m).alias("p")), each))
    rows = df.select(key, F.inline(F.filter(spans, lambda x: trimmed(x.s) != "")))
    lead = F.regexp_extract("s", rf"^{SPACE}*", 0)
    body = F.regexp_replace("s", rf"{SPACE}+$", "")
    return rows.select(
        key,
        F.col("s").alias("sentence"),
        (F.col("line") + breaks(lead)).alias("start_line"),
        (F.col("line") + breaks(body)).alias("end_line"),
        F.col("at").alias("start_offset"),
        (F.col("at") + F.length("s")).alias("end_offset"),
    )


def clauses(df: DataFrame, ends: str = CLAUSE_ENDS, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, clause): the mark stays with the clause before it; clauses are trimmed, blanks dropped."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"[^{ends}]*[{ends}]|[^{ends}]+"), F.lit(0))
    return _pieces(df, key, F.filter(F.transform(found, trimmed), lambda s: s != ""), "clause")


def paragraph_runs(text: Column) -> Column:
    """Array of (start_line, end_line, paragraph)."""

    def runs(xs: Column) -> Column:
        blank = lambda i: (i < 1) | (i > F.size(xs)) | _blank(F.get(xs, i - 1))
        places = F.sequence(F.lit(1), F.size(xs))
        starts = F.filter(places, lambda i: ~blank(i) & blank(i - 1))
        ends = F.filter(places, lambda i: ~blank(i) & blank(i + 1))
        each = lambda z: F.struct(z.a.alias("start_line"), z.b.alias("end_line"), F.array_join(F.slice(xs, z.a, z.b - z.a + 1), "\n").alias("paragraph"))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), each)

    return bound(F.split(line_endings(text), "\n"), runs)


def paragraphs(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_line, end_line, paragraph): runs of lines that are not blank, numbered from 1."""
    return df.select(key, F.inline(paragraph_runs(F.col(text))))


def headings(df: DataFrame, levels: tuple[int, ...] = (1, 2, 3, 4, 5, 6), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, level, title) of ATX headings."""
    found = lines(df, key=key, text=text).withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6})\s+(.*)$", 1)))
    return found.filter(F.col("level").isin(*levels)).select(key, "line_no", "level", F.trim(F.regexp_extract("line", r"^(#{1,6})\s+(.*)$", 2)).alias("title"))


def outline(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, level, title, heading_path): headings outside code fences, with their ancestors.

    A heading's ancestor at a smaller level is the last one there, if none of a still smaller level came after it. Only headings are shuffled, by key.
    """
    rows = F.split(line_endings(F.col(text)), "\n")
    fences = F.array_join(F.transform(rows, lambda x: F.when(x.startswith("```"), "f").otherwise("p")), "")
    outside = F.split(F.array_join(F.transform(F.split(fences, "f"), lambda x, i: F.when(i % 2 == 1, F.translate(x, "p", "c")).otherwise(x)), "f"), "")
    found = F.filter(F.transform(F.arrays_zip(rows.alias("line"), outside.alias("kind")), lambda z, i: F.struct((i + 1).alias("line_no"), z.line.alias("line"), z.kind.alias("kind"))), lambda z: (z.kind == "p") & z.line.startswith("#"))
    heads = df.select(key, F.inline(found)).withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6})\s+(.+?)\s*$", 1)))
    heads = heads.withColumn("title", F.trim(F.regexp_replace(F.regexp_extract("line", r"^(#{1,6})\s+(.+?)\s*$", 2), r"\s+#+\s*$", ""))).filter("level > 0 AND title <> ''")
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == n, F.struct("line_no", "title")), ignorenulls=True).over(before).alias(f"_{n}") for n in range(1, 6)]
    heads = heads.select(key, "line_no", "level", "title", *last)
    newest = lambda n: F.greatest(F.lit(0), F.lit(0), *(F.coalesce(F.col(f"_{m}.line_no"), F.lit(0)) for m in range(1, n)))
    above = F.array_compact(F.array(*(F.when((F.col("level") > n) & (F.col(f"_{n}.line_no") > newest(n)), F.col(f"_{n}.title")) for n in range(1, 6))))
    return heads.select(key, "line_no", "level", "title", F.array_join(F.concat(above, F.array("title")), " > ").alias("heading_path"))


def toc_entries(df: DataFrame, base: int = 1, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, level, title) of a bulleted table of contents: four columns of indent are a level."""
    found = lines(df, key=key, text=text).filter(F.col("line").rlike(r"^\s*[-*+]\s+\S"))
    indent = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    return found.select(key, "line_no", (F.floor(indent / 4) + base).cast("int").alias("level"), F.trim(F.regexp_replace("line", r"^\s*[-*+]\s+", "")).alias("title"))


def split(df: DataFrame, mode: str, *, levels: tuple[int, ...] = (2,), cut_by: int = 600, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments by mode: length, title, title_length or paragraph."""
    if mode == "length":
        return by_length(df, cut_by, key=key, text=text)
    if mode == "title":
        return by_title(df, levels, key=key, text=text)
    if mode == "title_length":
        return by_title_and_length(df, levels, cut_by, key=key, text=text)
    if mode == "paragraph":
        return paragraphs(df, key=key, text=text)
    raise ValueError(f"unknown mode {mode!r}")


def first_segment(df: DataFrame, mode: str, start, *, levels: tuple[int, ...] = (2,), cut_by: int = 600, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, target): the first segment by length or title of the text from offset ``start`` on."""
    rest = df.select(key, F.substring(F.col(text), start + 1, F.length(text)).alias("text"))
    return split(rest, mode, levels=levels, cut_by=cut_by, key=key).filter("idx = 0").select(key, "target")


def structured_sentences(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, sentence): headings and list items are whole sentences with the blank lines after them, untrimmed; the rest is split as by sentences().

    Only the places where such a line, or the text after one, begins are carried along.
    """
    special = lambda x: F.ltrim(x).rlike(r"^(?:#[ #]|[-*+] |[0-9]+[.)]\s+)")

    def step(a: Column, x: Column) -> Column:
        own, blank = special(x), _blank(x)
        new = (own | (a.special & ~blank)) & (a["at"] > 1)
        return F.struct(F.when(new, F.concat(a.starts, F.array(a["at"]))).otherwise(a.starts).alias("starts"), (own | (a.special & blank)).alias("special"), (a["at"] + 1).alias("at"))

    begin = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(False).alias("special"), F.lit(1).alias("at"))
    split_text = lambda t: F.filter(F.transform(F.split(marked_sentences(t), CUT), trimmed), lambda s: s != "")

    def islands(xs: Column) -> Column:
        parts = bound(F.aggregate(xs, begin, step, lambda a: a.starts), lambda b: _at(xs, b))
        each = lambda ps: F.flatten(F.transform(ps, lambda p, i: F.when(special(p), F.array(F.when(i + 1 < F.size(ps), F.concat(p, F.lit("\n"))).otherwise(p))).otherwise(split_text(p))))
        return bound(parts, each)

    return _pieces(df, key, bound(F.split(line_endings(F.col(text)), "\n"), islands), "sentence")


# Runs of letters and digits; any other visible character is a word of its own.
WORD = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def words(df: DataFrame, segmenter=None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, word, tag, start, end): words by place, from 0.

    segmenter is a function from a text to its (word, tag) pairs in order, which together with white space make the text again, and runs in Arrow batches;
    without one, words are those of WORD, tagged m for digits, x for other signs and n for the rest.
    """
    if segmenter is None:
        marked = F.regexp_replace(F.translate(F.col(text), CUT, " "), WORD, f"{CUT}$0")
        at = F.filter(F.transform(F.split(marked, ""), lambda c, i: F.when(c == CUT, i)), lambda i: i.isNotNull())
        found = F.arrays_zip(F.regexp_extract_all(F.translate(F.col(text), CUT, " "), F.lit(WORD), F.lit(0)).alias("word"), F.transform(at, lambda i, k: i - k).alias("start"))
        rows = df.select(key, F.posexplode(found).alias("idx", "_w")).select(key, "idx", "_w.word", "_w.start")
        tag = F.when(F.col("word").rlike(r"^\p{N}+$"), "m").when(F.col("word").rlike(r"^[^\p{L}\p{N}]$"), "x").otherwise("n")
        return rows.select(key, "idx", "word", tag.alias("tag"), "start", (F.col("start") + F.length("word")).alias("end"))

    @F.pandas_udf("array<struct<word: string, tag: string, start: int, end: int>>")
    def cut(texts):
        import pandas as pd

        out = []
        for t in texts:
            rows, at = [], 0
            for word, tag in segmenter(t or ""):
                at = t.index(word, at)
                rows.append({"word": word, "tag": tag, "start": at, "end": at + len(word)})
                at += len(word)
            out.append(rows)
        return pd.Series(out, dtype=object)

    return df.select(key, F.posexplode(cut(text)).alias("idx", "_w")).select(key, "idx", "_w.*")
