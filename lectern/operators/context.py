"""Paragraphs around a span, and paragraphs written on one line."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, bound, line_endings, trimmed
from .segment import chunks_of

# Which trimmed lines open or close code (f), are list items (l) or stand alone (s).
KINDS = ((r"^```", "f"), (rf"^(?:[-*+]|[0-9]+\.){SPACE}", "l"), (rf"^(?:#{{1,6}}|>){SPACE}|^[-*]{{3,}}$|^\|.*\|$", "s"))
_WHITE = "\t\n\v\f\r       　﻿" + "".join(map(chr, range(0x2000, 0x200B)))


def joined_paragraphs(text: Column) -> Column:
    """Lines of plain paragraphs are trimmed and joined by a space; headings, lists with the lines that go on from them, quotes, code, rules, tables and blank lines stay.

    The kinds of the lines are spelled as one letter each, so code and lists are found by patterns over that word.
    """
    kind = lambda x: F.coalesce(F.when(x == "", "b"), *(F.when(x.rlike(p), k) for p, k in KINDS), F.lit("p"))

    def joined(lines: Column) -> Column:
        kinds = F.array_join(F.transform(lines, lambda x: kind(trimmed(x))), "")
        kinds = F.array_join(F.transform(F.split(kinds, "f"), lambda x, i: F.when(i % 2 == 1, F.translate(x, "blsp", "cccc")).otherwise(x)), "f")
        return bound(F.split(F.regexp_replace(kinds, r"(?:(?<=l)|(?!^)\G)p", "q"), ""), lambda ks: runs(lines, ks))

    def runs(lines: Column, ks: Column) -> Column:
        plain = lambda i: F.get(ks, i - 1) == "p"
        starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | ~(plain(i) & plain(i - 1)))
        end = lambda b, i: F.when(i + 1 < F.size(b), F.get(b, i + 1)).otherwise(F.size(lines) + 1)
        whole = lambda b, a, i: F.array_join(F.transform(F.slice(lines, a, end(b, i) - a), trimmed), " ")
        return F.array_join(bound(starts, lambda b: F.transform(b, lambda a, i: F.when(plain(a), whole(b, a, i)).otherwise(F.get(lines, a - 1)))), "\n")

    return F.when(trimmed(text) == "", text).otherwise(bound(F.split(text, "\n"), joined))


class Paragraphs:
    """The paragraphs of one text: runs of lines that are not blank."""

    def __init__(self, text: str):
        self.text, self.lines = text, text.split("\n")
        self.blank = [not line.strip(_WHITE) for line in self.lines]
        self.starts = [0, *accumulate(len(line) + 1 for line in self.lines)]
        edges = [i for i, b in enumerate(self.blank) if not b]
        self.first = [i for i in edges if i == 0 or self.blank[i - 1]]
        self.last = [i for i in edges if i + 1 == len(self.blank) or self.blank[i + 1]]

    def around(self, start: int, end: int, before: int, after: int) -> str:
        """What stands before and after [start, end), tagged: first the rest of its own paragraph, then whole paragraphs.

        An earlier paragraph is given with all that lies between it and the span's own paragraph.
        """
        top = bisect_right(self.starts, start) - 1
        bottom = max(top, min(top + self.text.count("\n", start, end), len(self.lines) - 1))
        while bottom > top and self.blank[bottom]:
            bottom -= 1
        while top and not self.blank[top - 1]:
            top -= 1
        while bottom + 1 < len(self.lines) and not self.blank[bottom + 1]:
            bottom += 1
        lead = self.text[self.starts[top] : start].rstrip(_WHITE)
        earlier = bisect_left(self.last, top)
        wanted = max(0, before - bool(lead))
        parts = [self._whole(a, top) for a in self.first[max(0, earlier - wanted) : earlier]] + ([lead] if lead else [])
        tail = self.text[end : self.starts[bottom] + len(self.lines[bottom])].strip(_WHITE)
        later = bisect_right(self.first, bottom)
        rest = ([tail] if tail else []) + ["\n".join(self.lines[a : b + 1]) for a, b in zip(self.first[later:], self.last[later : later + max(0, after - bool(tail))])]
        tagged = [f"<{tag}>\n" + "\n\n".join(x) + f"\n</{tag}>" for tag, x in (("before", parts), ("after", rest)) if x]
        return "\n\n".join(tagged)

    def _whole(self, a: int, top: int) -> str:
        while self.blank[top - 1]:
            top -= 1
        return "\n".join(self.lines[a:top])


def around_span(text: Column, start: Column, end: Column, before: int = 2, after: int = 2) -> Column:
    """The tagged context of a span; see Paragraphs.around."""

    @F.pandas_udf("string")
    def found(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else Paragraphs(t).around(int(a), int(b), before, after) for t, a, b in zip(texts, starts, ends)], dtype=object)

    return found(line_endings(text), start, end)


def by_length_in_context(df: DataFrame, cut_by: int = 600, before: int = 1, after: int = 1, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, target, context): chunks by length with the paragraphs around the first place where their text occurs."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series, pieces: pd.Series) -> pd.Series:
        out = []
        for t, targets in zip(texts, pieces):
            known = Paragraphs(t or "")
            at = [known.text.find(x) for x in targets] if targets is not None else []
            out.append([known.around(a, a + len(x), before, after) if a >= 0 else "" for a, x in zip(at, targets)] if at else [])
        return pd.Series(out, dtype=object)

    cut = df.select(key, line_endings(F.col(text)).alias("_t")).withColumn("target", chunks_of(F.col("_t"), cut_by))
    both = F.arrays_zip("target", found("_t", "target").alias("context"))
    return cut.select(key, F.posexplode(both).alias("idx", "_u")).select(key, "idx", F.col("_u")["target"].alias("target"), F.col("_u")["context"].alias("context"))
