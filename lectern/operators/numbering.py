"""Numbered lines and the tree they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headings import in_heading_place
from ..functions.text import circled_number, han_number, letter_number, multi_level
from .segment import lines, paragraph_runs

_SIGN = "\u0001"

_HAN = "[一二三四五六七八九十百千]+"
_CHAPTER = f"([壹贰叁肆伍陆柒捌玖拾佰仟]+|{_HAN}|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]+|[0-9]+)"
_PARTS = r"[0-9]+(?:[.．][0-9]+)*"

# Fixed values, first match wins: slot, base level, kind of number, pattern after the indent and heading marks (group 1 is the number).
SLOTS = (
    (1, 1, "han", rf"第{_CHAPTER}章"),
    (2, 1, "parts", rf"§\s*({_PARTS})"),
    (3, 2, "han", rf"第{_CHAPTER}节"),
    (4, 3, "han", rf"({_HAN})、"),
    (15, 3, "han", rf"第({_HAN})[，,]"),
    (16, 3, "han", rf"其({_HAN})[，,]"),
    (5, 4, "han", rf"[(（﹙]({_HAN})[)）﹚]"),
    (6, 4, "circled", r"([\x{3220}-\x{325F}])"),
    (13, 5, "arabic", r"([0-9]+)\.(?![0-9])"),
    (14, 5, "letter", r"([A-Z])\.(?![A-Z])"),
    (7, 5, "parts", rf"([0-9]+(?=[.．])(?:[.．][0-9]+)*)"),
    (8, 5, "circled", r"([\x{2488}-\x{249B}])"),
    (9, 6, "arabic", r"[(（﹙]([0-9]+)[)）﹚]"),
    (10, 6, "circled", r"([\x{2474}-\x{2487}])"),
    (11, 7, "circled", r"([\x{2460}-\x{2473}\x{3251}-\x{325F}\x{32B1}-\x{32BF}])"),
    (12, 8, "letter", r"([A-Z]+)[.．]"),
)
# Numbers of custom slots, at line starts and inside lines.
CUSTOM, CUSTOM_INLINE = 1000, 1100
# Fixed values, in the order that ties at one place keep: slot, kind of number, pattern inside a line.
_NOT_HAN = r"(?<![\x{4e00}-\x{9fa5}])"
INLINE = (
    (4, "han", rf"{_NOT_HAN}({_HAN})、"),
    (15, "han", rf"{_NOT_HAN}第({_HAN})[，,]"),
    (16, "han", rf"{_NOT_HAN}其({_HAN})[，,]"),
    (13, "arabic", r"(?<![0-9])([0-9]+)\.(?![0-9])"),
    (14, "letter", r"(?<![A-Z])([A-Z])\.(?![A-Z])"),
    (5, "han", rf"[(（﹙]({_HAN})[)）﹚]"),
    (6, "circled", r"([\x{3220}-\x{325F}])"),
    (9, "arabic", r"[(（﹙]([0-9]+)[)）﹚]"),
    (10, "circled", r"([\x{2474}-\x{2487}])"),
    (11, "circled", r"([\x{2460}-\x{2473}\x{3251}-\x{325F}\x{32B1}-\x{32BF}])"),
)
LEVELS = 24


def custom_slots(given: list[tuple[int, str, str]]) -> tuple[tuple[int, int, str, str], ...]:
    """Slots of one's own from (level, pattern, kind): levels are held to 1 to 8; rows without a level or pattern are left out."""
    wanted = [x for x in given if x[0] is not None and x[1]]
    return tuple((CUSTOM + i, max(1, min(8, level)), kind or "arabic", pattern) for i, (level, pattern, kind) in enumerate(wanted))


def custom_inline(given: list[tuple[str, str]]) -> tuple[tuple[int, str, str], ...]:
    """Patterns of one's own inside lines from (pattern, kind)."""
    return tuple((CUSTOM_INLINE + i, kind or "arabic", pattern) for i, (pattern, kind) in enumerate(x for x in given if x[0]))


def _value(kind: Column, number: Column) -> Column:
    return (
        F.when(kind.isin("arabic", "parts") | number.rlike("^[0-9]+$"), multi_level(F.translate(number, "．", ".")))
        .when(kind == "han", han_number(number))
        .when(kind == "circled", circled_number(number))
        .otherwise(letter_number(number))
        .cast("long")
    )


def inline_numbers(df: DataFrame, custom: tuple[tuple[int, str, str], ...] = (), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, start, slot, number, matched, value): every number inside a line, by place (from 0)."""
    patterns = INLINE + tuple(custom)
    rows = lines(df, key=key, text=text).withColumn("line", F.translate("line", _SIGN, " "))
    rows = rows.filter(F.col("line").rlike("|".join(p for _, _, p in patterns)))

    def places(order: int, slot: int, kind: str, pattern: str) -> Column:
        marked = F.split(F.regexp_replace("line", pattern, f"{_SIGN}$0"), "")
        at = F.filter(F.transform(marked, lambda c, i: F.when(c == _SIGN, i)), lambda i: i.isNotNull())
        whole, number = (F.regexp_extract_all("line", F.lit(pattern), F.lit(g)) for g in (0, 1))
        each = lambda z, k: F.struct((z.a - k).alias("start"), F.lit(order).alias("o"), F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), z.n.alias("number"), z.w.alias("matched"))
        return F.transform(F.arrays_zip(at.alias("a"), number.alias("n"), whole.alias("w")), each)

    found = F.array_sort(F.concat(*(places(i, *p) for i, p in enumerate(patterns))))
    return rows.select(key, "line_no", F.inline(found)).select(key, "line_no", "start", "slot", F.trim("number").alias("number"), "matched", _value(F.col("kind"), F.col("number")).alias("value"))


def segment_numbers(df: DataFrame, custom: tuple[tuple[int, str, str], ...] = (), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, segment, start_line, end_line, preview, line_no, start, slot, number): numbers inside the lines of each paragraph, headings left out.

    Segments and lines count from 1. The first number of a segment goes when no other one there has its slot.
    """
    runs = df.select(F.col(key).alias("_key"), F.posexplode(paragraph_runs(F.col(text))).alias("_i", "_p"))
    first = F.substring_index("_p.paragraph", "\n", 1)
    preview = F.when(F.length(first) > 20, F.concat(F.left(first, F.lit(20)), F.lit("…"))).otherwise(first)
    of = F.struct(F.col("_key"), (F.col("_i") + 1).alias("segment"), F.col("_p.start_line").alias("start_line"), F.col("_p.end_line").alias("end_line"), preview.alias("preview"))
    plain = F.array_join(F.transform(F.split("_p.paragraph", "\n"), lambda x: F.when(x.rlike(r"^\s*#{1,6}\s"), "").otherwise(x)), "\n")
    found = inline_numbers(runs.select(of.alias("_s"), plain.alias("_t")), custom, key="_s", text="_t")
    segment = Window.partitionBy("_s._key", "_s.segment")
    ranked = found.withColumn("_n", F.row_number().over(segment.orderBy("line_no", "start"))).withColumn("_c", F.count("*").over(Window.partitionBy("_s._key", "_s.segment", "slot")))
    kept = ranked.filter((F.col("_n") > 1) | (F.col("_c") > 1))
    return kept.select(F.col("_s._key").alias(key), "_s.segment", "_s.start_line", "_s.end_line", "_s.preview", (F.col("line_no") + F.col("_s.start_line") - 1).alias("line_no"), "start", "slot", "number")


def numbered_lines(df: DataFrame, custom: tuple[tuple[int, int, str, str], ...] = (), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, slot, level, number, value, heading): lines that begin with a number of a slot.

    custom slots are tried after the fixed ones, on the line without its heading marks and white space. A number of several parts stands one level lower for each further part.
    """
    rows, slots = lines(df, key=key, text=text), SLOTS + tuple(custom)
    bare = F.regexp_replace(F.regexp_replace("line", r"^\s*(?:#{1,6}\s+)?", ""), r"\s+", "")
    shape = lambda n, p: (bare, f"^(?:{p})") if n >= CUSTOM else (F.col("line"), rf"^\s*(?:#{{1,6}}\s+)?{p}")
    slot = F.coalesce(*(F.when(shape(n, p)[0].rlike(shape(n, p)[1]), n) for n, _, _, p in slots))
    rows = rows.withColumn("slot", slot).filter("slot IS NOT NULL")
    pick = lambda of: F.coalesce(*(F.when(F.col("slot") == s[0], of(s)) for s in slots))
    rows = rows.withColumn("number", pick(lambda s: F.regexp_extract(*shape(s[0], s[3]), 1))).withColumn("kind", pick(lambda s: F.lit(s[2])))
    number = F.col("number")
    dotted = F.translate(number, "．", ".")
    depth = F.when(F.col("kind") == "parts", F.size(F.split(dotted, r"\.")) - 1).otherwise(0)
    return rows.select(key, "line_no", "slot", (pick(lambda s: F.lit(s[1])) - 1 + depth).alias("level"), "number", _value(F.col("kind"), number).alias("value"), in_heading_place(F.col("line")).alias("heading"))


def tree(numbered: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """numbered lines with parent: the last line before of a smaller level; 0 for roots.

    Levels beyond LEVELS - 1 count as LEVELS - 1 in the search for a parent.
    """
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    level = F.least("level", F.lit(LEVELS - 1))
    last = F.array(*(F.max(F.when(level == n, F.col("line_no"))).over(before) for n in range(LEVELS)))
    rows = numbered.withColumn("last", last)
    return rows.withColumn("parent", F.coalesce(F.array_max(F.slice("last", F.lit(1), level)), F.lit(0))).drop("last")
