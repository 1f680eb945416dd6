"""Dictionary checks, numbering checks and heading comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sizes import small


def characters(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, ch), positions from 0."""
    return df.select(key, F.posexplode(F.split(F.col(text), "")).alias("pos", "ch")).filter("ch <> ''")


def character_check(df: DataFrame, dictionary: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, variant, preferred, n, first_pos) for single-character variants (variant, preferred)."""
    found = characters(df, key=key, text=text).join(small(dictionary), F.col("ch") == F.col("variant"))
    return found.groupBy(key, "variant", "preferred").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def word_check(df: DataFrame, dictionary: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, variant, preferred, n) for whole words (variant, preferred)."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    return words.join(small(dictionary), F.col("w") == F.col("variant")).groupBy(key, "variant", "preferred").agg(F.count("*").alias("n"))


def last_character_check(df: DataFrame, dictionary: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, variant, preferred, n) for words whose last character is a variant."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    return words.join(small(dictionary), F.right("w", F.lit(1)) == F.col("variant")).groupBy(key, "variant", "preferred").agg(F.count("*").alias("n"))


def outside_characters(df: DataFrame, allowed: DataFrame, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ch, n): characters of the pattern that the allowed list (ch) lacks."""
    return characters(df, key=key, text=text).filter(F.col("ch").rlike(pattern)).join(small(allowed), "ch", "left_anti").groupBy(key, "ch").agg(F.count("*").alias("n"))


def merged_entries(entries: DataFrame) -> DataFrame:
    """(variant, preferred, n, label): entries (ordinal, label, variant, preferred, n) of several checks; the first label wins."""
    return entries.groupBy("variant", "preferred").agg(F.sum("n").alias("n"), F.min_by("label", "ordinal").alias("label"))


def sibling_issues(nodes: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, parent, slot, level, line_no, issue): gaps, repeats, disorder and lone numbers among siblings.

    nodes: (key, parent, slot, level, line_no, value).
    """
    among = Window.partitionBy(key, "parent", "slot", "level")
    ahead = among.orderBy("line_no")
    step = F.col("value") - F.lag("value").over(ahead)
    issue = (
        F.when(F.count("*").over(among) == 1, "isolated")
        .when((F.row_number().over(ahead) == 1) & (F.col("value") != 1), "start")
        .when(step == 0, "duplicate")
        .when(step < 0, "order")
        .when(step > 1, "gap")
    )
    return nodes.withColumn("issue", issue).filter("issue IS NOT NULL").select(key, "parent", "slot", "level", "line_no", "issue")


def mixed_slots(nodes: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, level, n_slots): levels numbered in more than one style."""
    return nodes.groupBy(key, "level").agg(F.countDistinct("slot").alias("n_slots")).filter("n_slots > 1")


def first_heading_difference(left: DataFrame, right: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, at, reason) of the first differing heading (key, line_no, level, title) of each document."""
    numbered = lambda df, s: df.select(key, F.row_number().over(Window.partitionBy(key).orderBy("line_no")).alias("at"), F.col("level").alias(f"level_{s}"), F.col("title").alias(f"title_{s}"))
    both = numbered(left, "l").join(numbered(right, "r"), [key, "at"], "full")
    reason = F.when(F.col("level_l").isNull(), "extra").when(F.col("level_r").isNull(), "missing").when(F.col("level_l") != F.col("level_r"), "level").when(F.col("title_l") != F.col("title_r"), "title")
    return both.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy(key).agg(F.min("at").alias("at"), F.min_by("reason", "at").alias("reason"))


def sorted_entries(entries: DataFrame, ascending: bool = False, *, key: str = "doc_id") -> DataFrame:
    """Entries (key, n, first_pos) with rank in their document: by count, then by first place."""
    n = F.col("n").asc() if ascending else F.col("n").desc()
    return entries.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(n, "first_pos")))


def outline_difference(pairs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, first_difference) of two texts (key, x, y): the index from 0 of the first heading whose level or title,
    with white space squeezed, differs; the shorter outline's length where one ends early; -1 for equal outlines."""
    titles = lambda c: F.transform(F.filter(F.split(c, "\n"), lambda l: l.rlike(r"^#{1,6}\s+\S")), lambda l: F.trim(F.regexp_replace(l, r"\s+", " ")))
    places = F.transform(F.arrays_zip(titles("x").alias("a"), titles("y").alias("b")), lambda z, i: F.when(z.a.eqNullSafe(z.b), None).otherwise(i))
    return pairs.select(key, F.coalesce(F.array_min(places), F.lit(-1)).alias("first_difference"))


def literal_words(df: DataFrame, rules: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, variant, preferred, n, comment) of rules (find, replace, comment) that name whole words."""
    found = word_check(df, rules.select(F.col("find").alias("variant"), F.col("replace").alias("preferred")), key=key, text=text)
    return found.join(small(rules.groupBy(F.col("find").alias("variant")).agg(F.max("comment").alias("comment"))), "variant", "left")


def literal_characters(df: DataFrame, rules: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, variant, preferred, n, first_pos, comment) of rules (find, replace, comment) that are single characters."""
    found = character_check(df, rules.select(F.col("find").alias("variant"), F.col("replace").alias("preferred")), key=key, text=text)
    return found.join(small(rules.groupBy(F.col("find").alias("variant")).agg(F.max("comment").alias("comment"))), "variant", "left")


def earliest(entries: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(variant, preferred, key, first_pos): where an entry stands first, by document, then place."""
    at = F.struct(key, "first_pos")
    return entries.groupBy("variant", "preferred").agg(F.min(at).alias("at")).select("variant", "preferred", f"at.{key}", "at.first_pos")


def with_notes(entries: DataFrame, notes: DataFrame) -> DataFrame:
    """Entries (variant, preferred) with the note of their preferred form, or else of their variant; notes: (form, note)."""
    one = small(notes.groupBy("form").agg(F.min("note").alias("note")))
    by = lambda c, name: one.select(F.col("form").alias(c), F.col("note").alias(name))
    return entries.join(by("preferred", "_p"), "preferred", "left").join(by("variant", "_v"), "variant", "left").withColumn("note", F.coalesce("_p", "_v")).drop("_p", "_v")


def heading_diagnosis(left: DataFrame, right: DataFrame, ahead: int = 8, *, key: str = "doc_id") -> DataFrame:
    """(key, at, reason, side, direction) for the first difference of two heading lists (key, line_no, level, title): where to look for the fault.

    Each item at the difference is sought among the next of the other side, fewer than ``ahead`` places on, by equi-joins on level and title.
    """
    numbered = lambda df: df.select(key, F.row_number().over(Window.partitionBy(key).orderBy("line_no")).alias("pos"), "level", "title")
    a, b = numbered(left), numbered(right)
    first = first_heading_difference(left, right, key=key)

    def found(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        here = first.join(own, key).filter(F.col("pos") == F.col("at")).select(key, "at", "level", "title")
        met = here.join(other.withColumnRenamed("pos", "there"), [key, "level", "title"])
        near = met.filter((F.col("there") == F.col("at") + 1) | ((F.col("there") >= F.col("at") + 2) & (F.col("there") < F.col("at") + ahead)))
        return near.groupBy(key).agg((F.min("there") - F.first("at")).alias(name))

    rows = first.join(found(a, b, "in_right"), key, "left").join(found(b, a, "in_left"), key, "left")
    both = ~F.col("reason").isin("extra", "missing")
    side = (
        F.when(F.col("reason") == "extra", "left").when(F.col("reason") == "missing", "right")
        .when(F.col("in_right") == 1, "right").when(F.col("in_left") == 1, "left").when(F.col("in_right") > 1, "right").when(F.col("in_left") > 1, "left").otherwise("both")
    )
    up = both & ((F.col("in_right") > 1) | (F.col("in_left") > 1)) & ~(F.coalesce(F.col("in_right") == 1, F.lit(False)) | F.coalesce(F.col("in_left") == 1, F.lit(False)))
    return rows.select(key, "at", "reason", side.alias("side"), F.when(~both, "down").when(F.coalesce(up, F.lit(False)), "up").otherwise("here").alias("direction"))
