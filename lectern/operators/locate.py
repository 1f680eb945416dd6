"""Places of items in their segments, and items read from free-form output."""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The lengths of a candidate window as shares of the item's, and the least similarity.
SHORTEST, LONGEST, LEAST = 0.7, 1.5, 0.85
_SPACE = re.compile(r"[\s   -     　﻿]")


def _kept(text: str) -> list[int]:
    """Places of the characters that are neither white space nor punctuation."""
    import unicodedata

    return [i for i, c in enumerate(text) if not _SPACE.match(c) and not unicodedata.category(c).startswith("P")]


def _ignoring_punctuation(text: str, item: str, least: int, most: int) -> tuple[int, int] | None:
    """The shortest window, then the first, whose kept characters are the item's."""
    places, wanted = _kept(text), "".join(item[i] for i in _kept(item))
    if not wanted:
        return None
    plain = "".join(text[i] for i in places)
    best, at = None, plain.find(wanted)
    while at >= 0:
        first, last = places[at], places[at + len(wanted) - 1] + 1
        before = places[at - 1] + 1 if at else 0
        after = places[at + len(wanted)] if at + len(wanted) < len(places) else len(text)
        size = max(least, last - first)
        if size <= most and size <= after - before:
            start = max(before, last - size)
            found = size, start, start + size
            best = found if best is None or found < best else best
        at = plain.find(wanted, at + 1)
    return best and (best[1], best[2])


def _similar(text: str, item: str, least: int, most: int, threshold: float) -> tuple[int, int] | None:
    """The window of the greatest bigram similarity above the threshold, of equals the shortest, then the first; windows slide with running counts."""
    grams = lambda s: [s[i : i + 2] for i in range(len(s) - 1)] or [s]
    wanted, best = set(grams(item)), None
    for size in range(least, most + 1):
        held: Counter = Counter()
        shared = 0
        for start in range(len(text) - size + 1):
            window = text[start : start + size]
            if size < 2:
                held, shared = Counter([window]), int(window in wanted)
            elif start == 0:
                held = Counter(grams(window))
                shared = len(wanted & held.keys())
            else:
                old, new = text[start - 1 : start + 1], text[start + size - 2 : start + size]
                held[old] -= 1
                if not held[old]:
                    del held[old]
                    shared -= old in wanted
                if new not in held:
                    shared += new in wanted
                held[new] += 1
            score = 1.0 if window == item else shared / (len(held) + len(wanted) - shared)
            if score > threshold:
                threshold, best = score, (start, start + size)
    return best


def locate(text: str | None, item: str | None, threshold: float = LEAST) -> tuple[int, int] | None:
    """(start, end) of the item: as it stands, else without punctuation and white space, else the most similar window."""
    if not text or not item:
        return None
    at = text.find(item)
    if at >= 0:
        return at, at + len(item)
    if not _kept(item):
        return None
    least, most = max(1, int(len(item) * SHORTEST)), min(len(text), -int(-len(item) * LONGEST // 1))
    return _ignoring_punctuation(text, item, least, most) or _similar(text, item, least, most, threshold)


def anchored(items: DataFrame, segments: DataFrame, *, unit: str = "unit", original: str = "original", target: str = "target", threshold: float = LEAST) -> DataFrame:
    """items (unit, original, ...) with anchor, the place of original in the segment (unit, target), null where there is none."""

    @F.pandas_udf("struct<start: int, end: int>")
    def places(texts: pd.Series, originals: pd.Series) -> pd.DataFrame:
        found = [locate(t, o, threshold) or (None, None) for t, o in zip(texts, originals)]
        return pd.DataFrame({"start": pd.array([a for a, _ in found], "Int32"), "end": pd.array([b for _, b in found], "Int32")})

    met = items.join(segments.select(F.col(unit).alias("_unit"), F.col(target).alias("_target")), F.col(unit) == F.col("_unit"), "left")
    own = [F.col(c) for c in items.columns]
    # The exact place is found by the engine; only the rest goes to Python.
    at = F.expr(f"position(`{original}`, _target) - 1")
    exact = F.struct(at.cast("int").alias("start"), (at + F.length(original)).cast("int").alias("end"))
    placed = met.withColumn("_exact", F.when((F.col(original) != "") & (at >= 0), exact))
    found = placed.withColumn("_loose", places(F.when(F.col("_exact").isNull(), F.col("_target")), F.when(F.col("_exact").isNull(), F.col(original))))
    anchor = F.coalesce("_exact", F.when(F.col("_loose.start").isNotNull(), F.col("_loose")))
    return found.select(*own, anchor.alias("anchor"))


def balanced_object(text: str) -> str | None:
    """The first balanced {...}, braces inside strings not counted."""
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if quoted:
            escaped, quoted = c == "\\" and not escaped, c != '"' or escaped
        elif c == '"':
            quoted, escaped = True, False
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    return None


def parsed_items(raw: str | None) -> list[dict]:
    """The items of free-form output: in code fences, as a whole, or as the first balanced object; [] where none parse."""
    text = (raw or "").strip().lstrip("﻿")
    fences = re.findall(r"```[^\n`]*\n?(.*?)```", text, re.S)
    for part in [*fences, text]:
        for body in (part.strip(), balanced_object(part)):
            try:
                read = json.loads(body) if body else None
            except ValueError:
                continue
            listed = read.get("items") if isinstance(read, dict) else read
            if isinstance(listed, list):
                return [{k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in x.items() if v is not None} for x in listed if isinstance(x, dict) and isinstance(x.get("original"), str)]
    return []


def items_of(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, item): item is a map of the fields as text."""

    @F.pandas_udf("array<map<string, string>>")
    def read(batch: pd.Series) -> pd.Series:
        return batch.map(parsed_items)

    return df.select(key, F.posexplode(read(F.col(text))).alias("idx", "item"))
