"""Scalar functions for heading lines, serial numbers and units, and predicates on them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, line_endings, replaced, trimmed

# The leading serial of a title (Han digits, digits, or letters with a closing mark) and what titles are compared without.
SERIAL = r"^(?:[、（(]*([一二三四五六七八九十〇]+)|[.(]*([0-9]+)|[.(]*([a-zA-Z]+)[.)])"
SERIAL_ONLY = r"^(?:[、（(]*[一二三四五六七八九十〇]+[、）)]*|[.(]*[0-9]+[.)]*|[.(]*[a-zA-Z]+[.)]+)$"
TITLE_NOISE = (r"\[\s*\^[0-9a-zA-Z]+\s*\]", r"\^[0-9a-zA-Z]+\^", r"[\s.…0-9\x{2460}-\x{2473}\x{3251}-\x{325F}]")
HEADING_LINE = r"^(\s*)(#{1,6}\s+)?(.*)$"


def squeezed(title: Column) -> Column:
    return replaced(title, SPACE)


def clean_title(title: Column) -> Column:
    """Without note marks, white space, dots, digits and circled numbers."""
    for pattern in TITLE_NOISE:
        title = replaced(title, pattern)
    return trimmed(title)


def is_only_serial(title: Column) -> Column:
    return squeezed(title).rlike(SERIAL_ONLY)


def leading_serial(title: Column) -> Column:
    """The leftmost serial without its marks; null if there is none."""
    parts = (F.regexp_extract(squeezed(title), SERIAL, n) for n in (1, 2, 3))
    return F.coalesce(*(F.when(p != "", p) for p in parts))


def normal_heading(title: Column, full_text: bool = False) -> Column:
    return squeezed(title) if full_text else F.coalesce(leading_serial(title), squeezed(title))


def headings_equal(left: Column, right: Column, full_text: bool = False) -> Column:
    """Equal serials if both sides have one, else equal texts without white space."""
    whole = squeezed(left) == squeezed(right)
    a, b = leading_serial(left), leading_serial(right)
    return whole if full_text else F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(whole)


def heading_levels(given: str) -> list[int]:
    """Levels 1 to 6 from "1,2，4", repeats dropped, in the order given; ValueError for anything else."""
    parts = [p.strip() for p in re.split("[,，]", given) if p.strip()]
    if not parts or not all(re.fullmatch("[0-9]+", p) and 1 <= int(p) <= 6 for p in parts):
        raise ValueError(f"heading levels are numbers from 1 to 6: {given!r}")
    return list(dict.fromkeys(map(int, parts)))


def hash_count(line: Column) -> Column:
    return F.length(F.rtrim(F.regexp_extract(line, HEADING_LINE, 2)))


def with_hashes(line: Column, n: Column) -> Column:
    """The line with n hash marks in place of those it has; its indent stays."""
    body = F.ltrim(F.regexp_extract(line, HEADING_LINE, 3))
    return F.concat(F.regexp_extract(line, HEADING_LINE, 1), F.when(n > 0, F.concat(F.repeat(F.lit("#"), n), F.lit(" "))).otherwise(""), body)


def to_title(line: Column, level: Column) -> Column:
    """Level 0 gives one mark; the marks stay within 1 and 6."""
    return with_hashes(line, F.least(F.greatest(level + 1, F.lit(1)), F.lit(6)))


def promoted(line: Column) -> Column:
    """One mark fewer, but at least one; null for a line that is no heading."""
    return F.when(hash_count(line) > 0, with_hashes(line, F.greatest(hash_count(line) - 1, F.lit(1))))


def demoted(line: Column) -> Column:
    """One mark more; null at six."""
    return F.when(hash_count(line) < 6, with_hashes(line, hash_count(line) + 1))


def starts_with_heading(unit: Column, levels: tuple[int, ...]) -> Column:
    """Whether the first line that is not blank is a heading of one of the levels."""
    first = F.filter(F.split(line_endings(unit), "\n"), lambda x: trimmed(x) != "")
    found = F.get(first, 0).rlike("^(?:" + "|".join("#" * n for n in levels) + ") ") if levels else F.lit(False)
    return F.coalesce(found, F.lit(False))


def in_heading_place(line: Column, most: int = 4) -> Column:
    """Whether the indent is small enough for a heading; otherwise a number stands inside the text."""
    return F.length(F.regexp_extract(line, rf"^{SPACE}*", 0)) <= most


def citation_confidence(text: Column, least: int = 5) -> Column:
    """likely_not for short texts and for texts of which 90 % are digits, punctuation or white space."""
    t = trimmed(text)
    noise = F.length(t) - F.length(replaced(t, r"[0-9０-９\p{P}" + SPACE[1:]))
    return F.when((F.length(t) < least) | (noise * 10 >= F.length(t) * 9), "likely_not").otherwise("citation")


def differs(before: Column, after: Column) -> Column:
    """Whether two texts differ in more than white space."""
    return replaced(before, SPACE) != replaced(after, SPACE)


def without_comments(block: Column, marker: str = "") -> Column:
    """The block without markup comments that begin with the marker; runs of blank lines become one."""
    return trimmed(replaced(replaced(block, rf"<!--{marker}[^>]*-->{SPACE}*"), r"\n{3,}", "\n\n"))
