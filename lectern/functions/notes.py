"""Note marks beside citations, citations from a selection, and summaries of outlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, bound

# The forms of a note mark.
NOTE = r"\[\^[^\]]*\]|\^[^\^]+\^|[\x{2460}-\x{2473}]+"
_CUT = "\u0001"


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def note_after(text: Column) -> Column:
    """The mark at the start of the text, after white space."""
    return _found(text, rf"^{SPACE}*({NOTE})")


def note_at_end(text: Column) -> Column:
    """The mark at the end of the text, before white space."""
    return _found(text, rf"({NOTE}){SPACE}*\z")


def note_of_quote(text: Column, start: Column, end: Column) -> Column:
    """The mark of the quotation [start, end): behind it or behind the first sentence's end in the rest of its line, else before it."""
    from ..operators.segment import marked_sentences

    rest = F.substring_index(F.substr(text, end + 1), "\n", 1)
    first = F.substring_index(marked_sentences(rest), _CUT, 1)
    return F.coalesce(note_after(rest), note_after(F.substr(rest, F.length(first) + 1)), note_at_end(F.left(text, start)))


def selected_citation(raw: Column, stripped: Column, start_line: Column, end_line: Column) -> Column:
    """A selection as one citation; lines count from 0 and are given from 1."""
    kind = F.when(raw.rlike(rf"(?m)^(?:{SPACE}|>)*>"), "blockquote").otherwise("quote")
    return F.struct(stripped.alias("text"), (start_line + 1).alias("start_line"), (end_line + 1).alias("end_line"), kind.alias("type"), F.lit("citation").alias("confidence"))


def outline_summary(name_a: Column, name_b: Column, a: Column, b: Column) -> Column:
    """Struct of ok and message on two outlines, arrays of structs of level, title and line_no: where they differ first."""
    same = lambda i: (F.get(a, i)["level"] == F.get(b, i)["level"]) & (F.get(a, i)["title"] == F.get(b, i)["title"])
    least = F.least(F.size(a), F.size(b))
    differing = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b))), lambda i: (i >= least) | ~same(i))
    size = lambda x: F.size(x).cast("string")
    one = lambda xs, i: bound(F.get(xs, i), lambda h: F.coalesce(F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["title"], F.lit("（第 "), h["line_no"].cast("string"), F.lit(" 行）")), F.lit("（无）")))
    counts = F.when(F.size(a) != F.size(b), F.concat(F.lit("标题数量不同（"), name_a, F.lit(" "), size(a), F.lit(" 个，"), name_b, F.lit(" "), size(b), F.lit(" 个）。"))).otherwise(F.concat(F.lit("标题数量相同（各 "), size(a), F.lit(" 个）。")))

    def told(at: Column) -> Column:
        ok = (at == F.size(a)) & (at == F.size(b))
        equal = F.concat(F.lit("两个文件标题一致（各 "), size(a), F.lit(" 个）："), name_a, F.lit(" 与 "), name_b, F.lit("。"))
        differ = F.concat(counts, F.lit("第 "), (at + 1).cast("string"), F.lit(" 处不一致：\n"), name_a, F.lit("："), one(a, at), F.lit("\n"), name_b, F.lit("："), one(b, at))
        return F.struct(ok.alias("ok"), F.when(ok, equal).otherwise(differ).alias("message"))

    return bound(F.get(differing, 0), told)
