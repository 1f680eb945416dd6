"""Language identification by Bayesian evidence fusion.

Three kinds of evidence meet in one posterior: the likelihood of the text under byte-trigram
models, the language that the markup declares, and a host prior. The prior is hierarchical: declared languages
counted by host are smoothed by those of the address suffix, and these by the whole corpus, all by
grouped aggregation over every row.

The trigram models are fitted on labelled rows, about ``sample_rows`` of them, dealt evenly over the labels and chosen by a hash of
id and text (a documented bound of the classifier); every label has a model, and everything else covers all rows. Labels and declarations
are compared by their primary subtag in lower case.

Edge cases: a null or empty text carries no text evidence and is rejected; missing declarations,
hosts and suffixes carry none either; texts of any length are read whole; ties go to the language first in
alphabetical order; with no labelled row at all every document is rejected as "und"; more than LANGUAGES labels are an
error, none is dropped; an empty table gives an empty result; columns named like the results are replaced, others, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_text

BITS = 15
BINS = 1 << BITS
#: Labelled rows that the trigram models are fitted on, about, and most languages that the broadcast of models allows for.
SAMPLE_ROWS, LANGUAGES = 20_000, 1000
#: Pseudo-counts of the trigram models, of a host's prior and of a suffix's prior; how often a declaration is wrong.
SMOOTH, HOST_WEIGHT, SUFFIX_WEIGHT, WRONG = 0.05, 20.0, 50.0, 0.02
#: Hosts whose priors are broadcast; more are joined by shuffle.
SMALL_HOSTS = 100_000
SPAN = 1 << 20
#: A text is no language at all where its best model is this much worse, in nats a trigram, than a uniform one.
MARGIN = -3.0
RESULTS = ("language", "confidence", "text_language", "fit", "kept")


def trigram_bins(text: str) -> Iterator[np.ndarray]:
    """Hashed byte trigrams of the text with A-Z folded, a span at a time."""
    raw = np.frombuffer(b" " + text.encode().lower() + b" ", np.uint8)
    for low in range(0, max(0, len(raw) - 2), SPAN):
        part = raw[low : low + SPAN + 2].astype(np.uint32)
        code = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        yield (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def quotas(counts: dict[str, int], rows: int) -> dict[str, float]:
    """The share of each label's rows to take: all of a rare label, an even part of ``rows`` of the others."""
    shares, left = {}, rows
    for n, (name, count) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        part = min(count, left / (len(counts) - n))
        shares[name], left = part / count, left - part
    return shares


def fit(df: DataFrame, *, text: str = "text", label: str = "lang", key: str | None = "doc_id", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [language, bin]). The driver receives at most LANGUAGES * BINS counts."""
    ids = [F.col(key)] if key in df.columns else []
    labelled = df.select(_declared(label).alias("label"), whole_text(text).alias("t"), *(c.alias("k") for c in ids)).filter("label <> ''")
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"column {label} holds more than {LANGUAGES} languages")
    if not counts:
        return [], np.zeros((0, BINS), np.float32)
    names = sorted(counts)
    share = F.element_at(F.create_map(*(F.lit(x) for pair in quotas(counts, sample_rows).items() for x in pair)), F.col("label"))
    drawn = F.pmod(F.xxhash64("t", *(["k"] if ids else [])), F.lit(1 << 30)) < share * (1 << 30)
    chosen = labelled if sum(counts.values()) <= sample_rows else labelled.filter(drawn)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.label, batch.t):
                into = tables.setdefault(name, np.zeros(BINS, np.int64))
                for bins in trigram_bins(t):
                    into += np.bincount(bins, minlength=BINS)
        for name, into in tables.items():
            used = np.nonzero(into)[0]
            yield pd.DataFrame({"label": name, "bin": used.astype(np.int32), "n": into[used]})

    sums = chosen.select("label", "t").mapInPandas(counted, "label string, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    tables = np.full((len(names), BINS), SMOOTH)
    for n, name in enumerate(names):
        own = sums[sums.label == name]
        tables[n, own.bin.to_numpy()] += own.n.to_numpy()
    return names, np.log(tables / tables.sum(axis=1, keepdims=True)).astype(np.float32)


def likelihoods(text: Column, model: np.ndarray) -> Column:
    """Mean log-likelihood of a trigram under each language, then their number."""

    @F.pandas_udf("array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                total, n = np.zeros(len(model)), 0
                if t.strip():
                    for bins in trigram_bins(t):
                        total += model[:, bins].sum(axis=1, dtype=np.float64)
                        n += len(bins)
                out.append([*(total / max(n, 1)), float(n)])
            yield pd.Series(out)

    return scored(text)


def _declared(column: str) -> Column:
    """The primary subtag in lower case."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(column).cast("string"), F.lit("")), "^[A-Za-z]+", 0))


def _array(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _smoothed(counts: Column, parent: Column, weight: float) -> Column:
    """(counts + weight * parent) / (total + weight), elementwise."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda c, p: (c + weight * p) / (total + weight))


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text", declared: str | None = None, host: str | None = None, suffix: str | None = None, least: float = 0.5) -> DataFrame:
    """df with language, confidence, text_language, fit and kept.

    fit is the mean log-likelihood of the best language less that of a uniform one; a document is kept where
    it has text, fit exceeds MARGIN and the posterior reaches ``least``. The texts are read once and not
    shuffled while the hosts number at most SMALL_HOSTS (counted first); beyond that rows meet priors by a join on the host.
    """
    names, tables = model
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in RESULTS))
    own_columns = [f"`{c}`" for c in df.columns]
    u = "_"  # begins the names of columns made here, and those of no others
    while any(c.startswith(u) for c in df.columns):
        u += "_"
    if not names:
        nothing = F.lit(None).cast("string")
        return df.withColumns({"language": F.lit("und"), "confidence": F.lit(0.0), "text_language": nothing, "fit": F.lit(0.0), "kept": F.lit(False)})
    labels = F.array(*(F.lit(n) for n in names))
    flat = _array([1 / len(names)] * len(names))
    prior, rows, shared = flat, df, []
    if declared and (host or suffix):
        levels = [c for c in (suffix, host) if c]
        counted = df.select(*(F.col(c).alias(f"{u}{c}") for c in levels), _declared(declared).alias(f"{u}d")).filter(F.col(f"{u}d").isin(names))
        tally = materialize(counted.groupBy(*(f"{u}{c}" for c in levels), f"{u}d").agg(F.count("*").alias("n")))
        as_counts = F.transform(labels, lambda l: F.coalesce(F.element_at(f"{u}m", l), F.lit(0)).cast("double"))
        sums = {r[0]: r.n for r in tally.groupBy(f"{u}d").agg(F.sum("n").alias("n")).collect()}
        total = sum(sums.values())
        prior = _array([(sums.get(n, 0) + 1) / (total + len(names)) for n in names])
        for level, weight in ((suffix, SUFFIX_WEIGHT), (host, HOST_WEIGHT)):
            if level:
                own = tally.filter(F.col(f"{u}{level}").isNotNull()).groupBy(f"{u}{level}", f"{u}d").agg(F.sum("n").alias("n"))
                own = own.groupBy(f"{u}{level}").agg(F.map_from_entries(F.collect_list(F.struct(f"{u}d", "n"))).alias(f"{u}m"))  # a languages' worth of entries
                shared.append((level, own.select(f"{u}{level}", as_counts.alias(f"{u}{level}_n")), weight))
        for level, own, weight in shared:
            small = own.count() <= SMALL_HOSTS
            rows = rows.join(F.broadcast(own) if small else own, rows[level] == own[f"{u}{level}"], "left").drop(f"{u}{level}")
            prior = _smoothed(F.coalesce(F.col(f"{u}{level}_n"), F.array_repeat(F.lit(0.0), len(names))), prior, weight)
    rows = rows.withColumn(f"{u}score", likelihoods(whole_text(text), tables)).withColumn(f"{u}prior", prior)
    size = F.element_at(f"{u}score", -1)
    said = _declared(declared) if declared else F.lit("")
    rows = rows.withColumn(f"{u}said", said)
    # Each byte lies in three trigrams, so a third of the sum is the text's share.
    logs = F.transform(
        labels,
        lambda l, i: F.col(f"{u}score")[i] * size / 3
        + F.log(F.col(f"{u}prior")[i])
        + F.when(F.col(f"{u}said") == l, F.lit(float(np.log(1 - WRONG)))).otherwise(F.when(F.col(f"{u}said").isin(names), F.lit(float(np.log(WRONG / max(1, len(names) - 1))))).otherwise(F.lit(0.0))),
    )
    rows = rows.withColumn(f"{u}logs", logs)
    best = F.array_max(f"{u}logs")
    odds = F.aggregate(f"{u}logs", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    texts = F.slice(f"{u}score", 1, len(names))
    rows = rows.withColumns(
        {
            "language": F.element_at(labels, F.array_position(f"{u}logs", best).cast("int")),
            "confidence": 1 / odds,
            "text_language": F.when(size > 0, F.element_at(labels, F.array_position(texts, F.array_max(texts)).cast("int"))),
            "fit": F.when(size > 0, F.array_max(texts) + F.lit(float(np.log(BINS)))).otherwise(0.0),
        }
    )
    kept = (size > 0) & (F.col("fit") > MARGIN) & (F.col("confidence") >= least)
    return rows.withColumn("kept", kept).withColumn("language", F.when(kept, F.col("language")).otherwise("und")).select(*own_columns, *RESULTS)


def page_evidence(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """pages with text (markup dropped), declared (the html element's lang), host and suffix (its last label).

    A null html has no text and no declaration, a null or hostless url neither host nor suffix; those columns are replaced where they exist.
    """
    raw = F.coalesce(F.col(html), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.withColumns(
        {
            "text": F.regexp_replace(F.regexp_replace(raw, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " "),
            "declared": F.nullif(F.regexp_extract(raw, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1), F.lit("")),
            "host": F.nullif(host, F.lit("")),
            "suffix": F.nullif(F.regexp_extract(host, r"([^.]+)$", 1), F.lit("")),
        }
    )
