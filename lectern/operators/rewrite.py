"""Operators that scan or rewrite a text in order: quotes, literal rules, replacements, word changes."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The quote pairs.
PAIRS = {"“": "”", "‘": "’", "「": "」", "『": "』", "《": "》", "〈": "〉"}


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Outermost quoted spans as half-open offsets; a closing mark is tried before an opening one."""
    open_marks: list[tuple[str, int]] = []
    spans = []
    for at, ch in enumerate(text):
        if open_marks and ch == PAIRS[open_marks[-1][0]]:
            _, begin = open_marks.pop()
            if not open_marks:
                spans.append((begin, at + 1))
        elif ch in PAIRS:
            open_marks.append((ch, at))
    return spans


def curled(text: str) -> str:
    """Straight double quotes of each paragraph turned alternately into opening and closing ones; escaped ones stay."""
    out = []
    for paragraph in text.split("\n"):
        opening, done, escaped = True, [], False
        for ch in paragraph:
            if ch == '"' and not escaped:
                done.append("“" if opening else "”")
                opening = not opening
            else:
                done.append(ch)
            escaped = ch == "\\" and not escaped
        out.append("".join(done))
    return "\n".join(out).strip()


def literal_matches(text: str, finds: list[str]) -> list[tuple[str, int, int]]:
    """(find, start, end) of literals, the longest first; a place that one has taken is closed to the others."""
    taken = bytearray(len(text))
    out = []
    for find in sorted(filter(None, set(finds)), key=lambda f: (-len(f), f)):
        at = text.find(find)
        while at >= 0:
            end = at + len(find)
            if any(taken[at:end]):
                at = text.find(find, at + 1)
            else:
                taken[at:end] = b"\1" * len(find)
                out.append((find, at, end))
                at = text.find(find, end)
    return sorted(out, key=lambda m: m[1])


def replaced_spans(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Edits (start, end, new) applied back to front; of two that overlap the later start wins."""
    limit = len(text) + 1
    for start, end, new in sorted(edits, reverse=True):
        if end <= limit and start >= 0:
            text = text[:start] + new + text[end:]
            limit = start
    return text


def replaced_once(text: str, items: list[tuple[str, str]]) -> tuple[str, int]:
    """(text, applied): each item's first occurrence replaced, one item after the other."""
    applied = 0
    for old, new in items:
        if old and old in text:
            text, applied = text.replace(old, new, 1), applied + 1
    return text, applied


def common_places(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places (in a, in b) of a longest common subsequence, in order: a bit for each word of a, one row for each word of b."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    every = (1 << len(a)) - 1
    row, rows = every, []
    for word in b:
        own = row & places.get(word, 0)
        row = (row + own | row & ~own) & every
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> i - 1 & 1:  # as long without this word of a
            i -= 1
            continue
        j -= 1
        if not j or rows[j - 1] >> i - 1 & 1:  # shorter without this word of b
            i -= 1
            out.append((i, j))
    return out[::-1]


def word_changes(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """Pairs where exactly one word gave way to exactly one, in a least edit: what both begin and end with is taken off first."""
    most = min(len(before), len(after))
    head = next((i for i in range(most) if before[i] != after[i]), most)
    tail = next((i for i in range(most - head) if before[-1 - i] != after[-1 - i]), most - head)
    a, b = before[head : len(before) - tail], after[head : len(after) - tail]
    out, i, j = [], 0, 0
    for p, q in [*common_places(a, b), (len(a), len(b))]:
        if p - i == q - j == 1:
            out.append((a[i], b[j]))
        i, j = p + 1, q + 1
    return out


def overlap_kept(texts: list[str], most: float = 0.85) -> list[bool]:
    """Keep a text unless an earlier kept one shares ``most`` of their characters (shared over the larger set)."""
    kept: list[set[str]] = []
    out = []
    for text in texts:
        own = set(text)
        fine = all(len(own & other) < most * max(len(own), len(other), 1) for other in kept)
        out.append(fine)
        if fine:
            kept.append(own)
    return out


def quotes(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, quote)."""

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def spans(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: [{"start": a, "end": b} for a, b in quoted_spans(t or "")])

    return df.select(key, F.col(text).alias("_t"), F.inline(spans(F.col(text)))).select(key, "start", "end", F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")).alias("quote"))


def curl(column):
    @F.pandas_udf("string")
    def convert(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else curled(t))

    return convert(column)


def literal_check(df: DataFrame, rules: dict[str, str], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, variant, preferred, start, end) by literal rules; the rule table is part of the plan, so keep it small."""
    finds = list(rules)

    @F.pandas_udf("array<struct<variant: string, start: int, end: int>>")
    def found(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: [{"variant": f, "start": a, "end": b} for f, a, b in literal_matches(t or "", finds)])

    preferred = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))
    return df.select(key, F.inline(found(F.col(text)))).select(key, "variant", preferred[F.col("variant")].alias("preferred"), "start", "end")


def apply_rules(df: DataFrame, rules: dict[str, str], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with every literal match replaced."""
    finds = list(rules)

    @F.pandas_udf("string")
    def done(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else replaced_spans(t, [(a, b, rules[f]) for f, a, b in literal_matches(t, finds)]))

    return df.select(key, done(F.col(text)).alias("text"))


def inserted(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with additions (array of struct end, addition) put after their ends, last first, so offsets stay right."""
    from_end = F.reverse(F.array_sort(F.transform("additions", lambda x: F.struct(x["end"].alias("end"), x.addition.alias("addition")))))
    put = lambda t, x: F.concat(F.left(t, x["end"]), x.addition, F.substring(t, x["end"] + 1, F.length(t)))
    return df.select(key, F.aggregate(from_end, F.col(text), put).alias("text"))


def pattern_check(df: DataFrame, rules: list[tuple[str, str]], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rule, start, end, found, preferred): regular-expression rules in order; a place that an earlier rule or
    match took is not matched again. Null texts have no matches. Patterns are Python's, \\1 in a replacement is a group."""
    compiled = [(n, re.compile(find), by) for n, (find, by) in enumerate(rules)]

    def scan(batches):
        for batch in batches:
            out = []
            for k, t in zip(batch["k"], batch["t"]):
                taken: list[tuple[int, int]] = []
                for n, find, by in compiled:
                    for m in find.finditer(t or ""):
                        at = bisect.bisect_left(taken, m.span())
                        clear = (at == 0 or taken[at - 1][1] <= m.start()) and (at == len(taken) or m.end() <= taken[at][0])
                        if clear and m.end() > m.start():
                            taken.insert(at, m.span())
                            out.append((k, n, m.start(), m.end(), m.group(), m.expand(by)))
            yield pd.DataFrame(out, columns=["k", "rule", "start", "end", "found", "preferred"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(scan, f"k {kind}, rule int, start int, end int, found string, preferred string")
    return rows.withColumnRenamed("k", key)


def items_applied(df: DataFrame, *, key: str = "doc_id", text: str = "text", items: str = "items") -> DataFrame:
    """(key, text, applied): items (array of struct old, new) applied one after the other, each to its first place."""

    @F.pandas_udf("struct<text: string, applied: int>")
    def done(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = [(None, 0) if t is None else replaced_once(t, [(x["old"], x["new"]) for x in (xs if xs is not None else [])]) for t, xs in zip(texts, lists)]
        return pd.DataFrame(out, columns=["text", "applied"])

    return df.select(key, done(F.col(text), F.col(items)).alias("d")).select(key, "d.text", "d.applied")
