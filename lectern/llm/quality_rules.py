"""Quality rules kept as a bitmask ledger, in DataFrame functions only.

Each rule is evaluated once a document. The ledger holds the measurements and one long whose bit
r is set where rule r fails. A policy is a versioned mask: a document is kept where
``failed & mask`` is zero. Ablations read the ledger, never the text: bitwise
aggregation counts what a policy would keep without each of its rules.

Edge cases: a null text is the empty text (no words: the length rule fails); a text of
any length is handled inside its row; repeated rows are judged independently; a measurement equal to a rule's limit passes it; an
empty table gives an empty ledger; other columns pass through, except that columns
named like a ledger column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """Fails where the SQL condition over the measurements is true."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


#: The position of a rule is its bit; rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("capitals", "n_letters >= 50 AND 10 * n_capitals > 6 * n_letters"),
    Rule("few_letters", "2 * n_letters < word_chars"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = (BASE, Policy("v1", ("few_words", "repeated_windows", "symbols", "repeated_lines")), Policy("v2", tuple(r.name for r in RULES)))


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    names = [r.name for r in rules]
    return sum(1 << names.index(name) for name in policy.rules)


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with name bound to value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def ledger_sql(text: str, rules: Sequence[Rule] = RULES, window: int = 5) -> str:
    """One SQL expression: a struct of the measurements and failed_bits.

    Repeated windows are found by sorting the window hashes inside the row; texts without any are
    recognised first, by counting distinct hashes.
    """
    hashed = ", ".join(f"w[i + {k}]" for k in range(window))
    again = "filter(o, (x, k) -> (k > 0 AND o[k - 1].h = x.h) OR (k < size(o) - 1 AND o[k + 1].h = x.h))"
    covered = f"""CASE WHEN o IS NULL THEN 0L ELSE aggregate(sort_array(transform({again}, x -> x.i)), struct(0L AS n, -{window} AS last),
        (a, s) -> struct(a.n + least({window}, s - a.last) AS n, s AS last)).n END"""
    measures = rf"""struct(
        CAST(size(w) AS long) AS n_words,
        CAST(length(regexp_replace(t, r'[\x20\x09-\x0D]+', '')) AS long) AS word_chars,
        CAST(regexp_count(t, r'[#*$%&|<>]') AS long) AS n_symbols,
        CAST(size(l) - size(array_distinct(l)) AS long) AS n_dup_lines,
        {covered} AS n_repeat_words,
        CAST(size(l) AS long) AS n_lines,
        CAST(length(regexp_replace(t, r'\P{{L}}+', '')) AS long) AS n_letters,
        CAST(length(regexp_replace(t, r'\P{{Lu}}+', '')) AS long) AS n_capitals)"""
    own = lambda sql: re.sub(rf"\b({'|'.join(MEASURES)})\b", r"m.\1", sql)
    bits = " | ".join(f"CASE WHEN {own(r.fails)} THEN {1 << k}L ELSE 0L END" for k, r in enumerate(rules))
    out = _let("m", measures, f"struct({', '.join(f'm.{c} AS {c}' for c in MEASURES)}, {bits} AS failed_bits)")
    out = _let("o", "CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS h, i AS i))) END", out)
    out = _let("h", f"CASE WHEN size(w) > {window} THEN transform(sequence(0, size(w) - {window}), i -> xxhash64({hashed})) END", out)
    out = _let("l", rf"filter(split(t, '\n', -1), l -> l RLIKE r'{WORD}')", out)
    out = _let("w", rf"regexp_extract_all(t, r'{WORD}', 0)", out)
    return _let("t", f"coalesce(`{text}`, '')", out)


def ledger(df: DataFrame, *, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """df with the measurements and the failure bits: one narrow pass, no shuffle."""
    names = (*MEASURES, "failed_bits")
    held = [c for c in df.columns if c not in names]
    judged = df.withColumn("_ledger", F.expr(ledger_sql(text, rules)))
    return judged.select(*held, *(F.col(f"_ledger.{c}").alias(c) for c in names))


def passes(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablations(kept: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(version, rule, n_docs, n_kept, n_failed, n_only, union_bits): what each rule costs a policy.

    n_only counts the documents that the rule alone rejects, so n_kept + n_only is what the policy
    keeps without it; union_bits holds every bit seen among the rejected. The ledger is first
    aggregated to its distinct bit patterns, at most 2^rules rows.
    """
    patterns = kept.groupBy("failed_bits").agg(F.count("*").alias("n"))
    plan = [(p.version, name, mask(p, rules), 1 << [r.name for r in rules].index(name)) for p in policies for name in p.rules]
    plans = kept.sparkSession.createDataFrame(plan, "version string, rule string, mask long, bit long")
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    return (
        patterns.join(F.broadcast(plans), F.col("mask").isNotNull())  # a fixed handful of policy rows
        .groupBy("version", "rule")
        .agg(
            F.sum("n").alias("n_docs"),
            F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"),
            F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.expr("bit_or(failed_bits & mask)").alias("union_bits"),
        )
    )
