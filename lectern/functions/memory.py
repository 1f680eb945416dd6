"""Editing memory as text: entries, rounds and the block given to a checker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, bound, clipped, line_endings, normalize, trimmed

# Most characters of a field, of all entries and of all rounds; the greatest weight; the mark of a cut.
FIELD, ENTRIES, ROUNDS, HEAVIEST = 800, 5_500, 16_000, 1000
CUT = "\n…(截断)"


def entry(original: Column, changed_to: Column, weight: Column, note: Column) -> Column:
    """Struct of clipped fields with a whole weight from 0 to HEAVIEST; a blank note is null."""
    clip = lambda x: clipped(trimmed(x), FIELD)
    bounded = F.greatest(F.lit(0), F.least(F.lit(HEAVIEST), F.coalesce(F.floor(weight), F.lit(0)))).cast("int")
    said = F.when(trimmed(note) != "", clip(note))
    return F.struct(clip(F.coalesce(original, F.lit(""))).alias("original"), clip(F.coalesce(changed_to, F.lit(""))).alias("changed_to"), bounded.alias("weight"), said.alias("note"))


def one_line(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, f"{SPACE}+", " "))


def entry_line(entry: Column, id: Column, created_at: Column) -> Column:
    note = F.when(F.coalesce(trimmed(entry.note), F.lit("")) != "", F.concat(F.lit(" <note> "), one_line(entry.note))).otherwise("")
    return F.concat(one_line(entry.original), F.lit(" <changed to> "), one_line(entry.changed_to), F.lit(" <weight> "), entry.weight.cast("string"), note, F.lit(" [id:"), id, F.lit("] [at:"), created_at, F.lit("]"))


def rounds_text(rounds: Column) -> Column:
    """Numbered rounds; each is a struct of id, created_at and body."""
    shown = lambda r, i: F.concat(F.lit("[第"), (i + 1).cast("string"), F.lit("次·"), r.created_at, F.lit(" id:"), r["id"], F.lit("]\n"), trimmed(r.body))
    return F.array_join(F.transform(rounds, shown), "\n\n---\n\n")


def memory_block(lines: Column, rounds: Column, document: Column, line: Column) -> Column:
    """Entries and rounds, each clipped and left out when blank, then the place of the selection (its line from 0)."""
    part = lambda name, text, most: F.when(trimmed(text) != "", F.concat(F.lit(f"\n<{name}>\n"), trimmed(clipped(text, most, CUT)), F.lit(f"\n</{name}>"))).otherwise("")
    place = F.concat(F.lit("\n<editorial_proofread_context>\ndocument: "), document, F.lit("\nselection: "), F.coalesce(F.concat(F.lit("L"), (line + 1).cast("string")), F.lit("")),
                     F.lit("\nnote: 用户框选的校对范围；以下 target 即该范围全文。\n</editorial_proofread_context>"))
    return F.concat(part("editorial_memory_global", F.array_join(lines, "\n"), ENTRIES), part("editorial_memory_current_rounds", rounds_text(rounds), ROUNDS), place)


# Most characters of one side of a pair, pairs that are spelled out, most characters of a summary, and of a side without pairs.
SIDE, SHOWN, SUMMARY, WHOLE = 70, 4, 900, 90


def round_summary(original: Column, final: Column, pairs: Column, most: int = SUMMARY) -> Column:
    """One sentence on a round: its first pairs of (before, after) and how many there are; without pairs the clipped texts."""
    a, b = line_endings(original), line_endings(final)
    most = max(120, min(most, SUMMARY))
    shown = lambda x, n: F.concat(F.lit("「"), clipped(one_line(line_endings(x)), n), F.lit("」"))
    arrow = F.concat(shown(a, WHOLE), F.lit("→"), shown(b, WHOLE), F.lit("（句粒度未分项）"))
    parts = F.array_join(F.transform(F.slice(pairs, 1, SHOWN), lambda p: F.concat(shown(p.before, SIDE), F.lit("→"), shown(p.after, SIDE))), "；")
    body = F.concat(F.lit("句式要点："), parts, F.when(F.size(pairs) > SHOWN, F.concat(F.lit("；共 "), F.size(pairs).cast("string"), F.lit(" 处句式级改动"))).otherwise(""))
    return (
        F.when((trimmed(a) == "") & (trimmed(b) == ""), "空选区，无校对内容。")
        .when(a == b, "无文本差异。")
        .when(normalize(a) == normalize(b), "无实质改动（仅空白、转行等忽略不计）。")
        .otherwise(clipped(F.when(F.size(pairs) > 0, body).otherwise(arrow), most))
    )


_ENTRY = "array<struct<id: string, createdAt: string, original: string, changedTo: string, weight: double, note: string>>"
_STORED = f"version int, global {_ENTRY}, recent {_ENTRY}, current {_ENTRY}, currentRounds array<struct<id: string, createdAt: string, body: string>>"


def migrated(raw: Column, new_id: Column, now: Column) -> Column:
    """Stored memory as (global, rounds): entries need both texts, rounds an id and a body. Older recent and current entries become the lines of one round.

    new_id and now stand in where an id or a time is missing. Anything but version 2 is empty.
    """

    def entries(rows: Column) -> Column:
        whole = F.filter(F.coalesce(rows, F.array().cast(_ENTRY)), lambda e: e.original.isNotNull() & e.changedTo.isNotNull())
        return F.transform(whole, lambda e: F.struct(
            F.coalesce(F.nullif(trimmed(e["id"]), F.lit("")), new_id).alias("id"), F.when(trimmed(e.createdAt) != "", e.createdAt).otherwise(now).alias("created_at"), entry(e.original, e.changedTo, e.weight, e.note).alias("entry")))

    def moved(s: Column) -> Column:
        rounds = F.transform(F.filter(s.currentRounds, lambda r: r["id"].isNotNull() & r.body.isNotNull()), lambda r: F.struct(r["id"].alias("id"), F.coalesce(r.createdAt, now).alias("created_at"), r.body.alias("body")))
        lines = F.transform(F.concat(entries(s.recent), entries(s.current)), lambda e: entry_line(e.entry, e["id"], e.created_at))
        round_ = F.struct(new_id.alias("id"), now.alias("created_at"), F.array_join(lines, "\n").alias("body"))
        none = F.array().cast("array<struct<id: string, created_at: string, body: string>>")
        old = F.when(F.size(lines) > 0, F.array(round_)).otherwise(none)
        of = "array<struct<id: string, created_at: string, entry: struct<original: string, changed_to: string, weight: int, note: string>>>"
        is_two = F.coalesce(s.version == 2, F.lit(False))
        return F.struct(F.when(is_two, entries(s["global"])).otherwise(F.array().cast(of)).alias("global"), F.when(is_two, F.coalesce(rounds, old)).otherwise(none).alias("rounds"))

    return bound(F.from_json(raw, _STORED), moved)
