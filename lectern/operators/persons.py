"""Names with a bracketed note, held against a table of known persons; names without one."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.memory import one_line
from ..functions.text import bound
from .context import _WHITE

# The verdicts, and what marks a doubtful note.
OK, HINT, SEVERAL, WRONG, BOTH = "已核验", "备核", "多项备核", "核验错误", "核验错误；多项备核"
DOUBT = "[约或？?]"
#: Most names that are sent to every task.
NAMES = 1_000_000
_SPACE, _OPEN, _CLOSE = re.compile(f"[{_WHITE}]*"), "（(", "）)"


class Names:
    """Finds names, whose characters may stand apart by white space."""

    def __init__(self, names: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for name in names:
            self.automaton.add_word(name, len(name))
        if names:
            self.automaton.make_automaton()
        self.empty = not names

    def places(self, text: str) -> list[dict]:
        """Names with a closed bracket behind them, then names without a bracket outside those; leftmost and longest first."""
        spots = [i for i, c in enumerate(text) if c not in _WHITE]
        squeezed = "".join(text[i] for i in spots)
        starting = defaultdict(list)
        if not self.empty and squeezed:
            for end, size in self.automaton.iter(squeezed):
                starting[end - size + 1].append(size)
        found = [(spots[a], [(squeezed[a : a + n], spots[a + n - 1] + 1) for n in sorted(starting[a], reverse=True)]) for a in sorted(starting)]
        closers = [i for i, c in enumerate(text) if c in _CLOSE]
        noted, bare, upto = [], [], 0
        for start, ends in found:
            if start < upto:
                continue
            for name, end in ends:
                at = _SPACE.match(text, end).end()
                shut = bisect_right(closers, at)
                if at < len(text) and text[at] in _OPEN and shut < len(closers):
                    upto = closers[shut] + 1
                    noted.append({"name": name, "matched": text[start:upto], "start": start, "end": upto, "inner": text[at + 1 : closers[shut]]})
                    break
        taken, upto = [x["end"] for x in noted], 0
        for start, ends in found:
            if start < upto:
                continue
            for name, end in ends:
                at = _SPACE.match(text, end).end()
                if at < len(text) and text[at] in _OPEN:
                    continue
                upto, near = end, bisect_right(taken, start)
                if near == len(noted) or noted[near]["start"] >= end:
                    bare.append({"name": name, "matched": text[start:end], "start": start, "end": end, "inner": None})
                break
        return noted + bare


def _folded(text: Column) -> Column:
    """The text in its compatibility form, on one line."""

    @F.pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKC")

    return one_line(nfkc(text))


def _years(text: Column) -> Column:
    return F.regexp_replace(one_line(text), r"前\s+([0-9]+)", "前$1")


def person_check(df: DataFrame, persons: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, variant, preferred, n, first_pos): every form of a known name with its verdict, counted.

    persons has rows of name, label and raw. A bracket holds "label, raw", or either alone. Names are sent to every task, up to
    NAMES of them; the notes of a name meet its rows in a join. Null texts and names give nothing.
    """
    listed = [r.name for r in persons.select("name").filter("name <> ''").distinct().limit(NAMES + 1).collect()]
    if len(listed) > NAMES:
        raise ValueError(f"more than {NAMES} names")
    shared = df.sparkSession.sparkContext.broadcast(sorted(listed))
    made: list[Names] = []

    @F.pandas_udf("array<struct<name: string, matched: string, start: int, end: int, inner: string>>")
    def places(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Names(shared.value))
        return pd.Series([made[0].places(t) if t else [] for t in texts], dtype=object)

    note = F.regexp_extract(one_line(F.col("inner")), "(?s)^([^,，]+)[,，](.+)$", 1)
    rest = F.regexp_extract(one_line(F.col("inner")), "(?s)^([^,，]+)[,，](.+)$", 2)
    found = df.select(key, F.inline(places(text)))
    found = found.withColumns({"label": F.trim(note), "raw": F.when(rest != "", one_line(rest)).otherwise(one_line(F.col("inner")))})
    found = found.withColumns({"label_key": _folded(F.col("label")), "raw_key": _years(F.col("raw")), "alone_key": _folded(F.col("raw"))})
    known = persons.filter("name <> ''").select("name", F.coalesce("label", F.lit("")).alias("l"), F.coalesce("raw", F.lit("")).alias("r"))
    known = known.withColumns({"lk": _folded(F.col("l")), "rk": _years(F.col("r"))})
    known = known.groupBy("name").agg(F.collect_list(F.struct("lk", "rk")).alias("rows"), F.max(F.concat("l", "r").rlike(DOUBT)).alias("doubtful"))
    both = (F.col("label") != "") & (F.col("raw") != "")
    same = lambda x: F.when(both, (x.rk == F.col("raw_key")) & (x.lk != "") & (x.lk == F.col("label_key"))).otherwise((x.rk == F.col("raw_key")) | (x.lk != "") & (x.lk == F.col("alone_key")))
    joined = found.join(known, "name")
    matched = (F.col("raw") != "") & F.exists("rows", same)
    several = F.size("rows") > 1
    doubt = F.col("doubtful") | F.concat("label", "raw").rlike(DOUBT)
    verdict = F.when(F.col("inner").isNull(), F.array(F.lit(HINT))).otherwise(
        bound(matched, lambda m: F.when(m & ~several, F.array(F.lit(OK))).when(m, F.array(F.lit(OK), F.lit(SEVERAL))).when(doubt, F.array(F.lit(HINT))).when(several, F.array(F.lit(BOTH))).otherwise(F.array(F.lit(WRONG))))
    )
    return joined.select(key, F.col("matched").alias("variant"), "start", F.explode(verdict).alias("preferred")).groupBy(key, "variant", "preferred").agg(F.count("*").alias("n"), F.min("start").alias("first_pos"))
