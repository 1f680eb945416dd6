"""Sharding and language queries against plain loops over all rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lectern.llm import language_id, queries, sharding


def kd(rows, dims, shards):
    """The shard of each row by exact weighted medians."""
    spread = lambda part, i: max(r[2][i] >> 32 for r in part) - min(r[2][i] >> 32 for r in part)
    base, out = [max(1, spread(rows, i)) for i in range(dims)], {}

    def split(part, first, many):
        if many == 1 or not part:
            out.update({r[0]: first for r in part})
            return
        i = max(range(dims), key=lambda d: (spread(part, d) / base[d], -d))
        goal, before, bytes_at = sum(r[1] for r in part) * (many // 2) / many, 0, Counter()
        for r in part:
            bytes_at[r[2][i]] += r[1]
        for cut in sorted(bytes_at):
            upto = before + bytes_at[cut]
            if upto >= goal:
                break
            before = upto
        if goal - before < upto - goal:
            cut -= 1
        split([r for r in part if r[2][i] <= cut], first, many // 2)
        split([r for r in part if r[2][i] > cut], first + many // 2, many - many // 2)

    split(rows, 0, shards)
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_shards_equal_exact_medians(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    meta = sharding.metadata(docs, key="doc_id", text="text", columns=("source", "lang")).collect()
    want = kd([(r.doc_id, r["size"], (r.d0, r.d1, r.d2)) for r in meta], 3, 16)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    found = queries.op7_kd_sharding(spark, folder).collect()
    assert {r.doc_id: r.shard for r in found} == want
    assert {r.doc_id: (r["size"], r.text_crc32) for r in found} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in texts.items()}


def trigrams(text):
    raw = b" " + text.encode().lower() + b" "
    return Counter(((int.from_bytes(raw[i : i + 3], "big") * 2654435761) % (1 << 32)) >> (32 - language_id.BITS) for i in range(len(raw) - 2))


def subtag(label):
    return re.match("[A-Za-z]*", label or "")[0].lower()


def fused(rows, training):
    """{id: (language, text_language, confidence, fit, kept)} of rows (id, text, declared, host, suffix)."""
    counts = defaultdict(Counter)
    for text, label in training:
        if subtag(label):
            counts[subtag(label)] += trigrams(text or "")
    names = sorted(counts)
    whole = {n: sum(counts[n].values()) + language_id.SMOOTH * language_id.BINS for n in names}
    log = {n: lambda b, n=n: math.log((counts[n][b] + language_id.SMOOTH) / whole[n]) for n in names}
    levels = [defaultdict(Counter), defaultdict(Counter), Counter()]
    for _, _, said, host, suffix in rows:
        if subtag(said) in names:
            levels[2][subtag(said)] += 1
            for level, at in ((levels[0], host), (levels[1], suffix)):
                if at is not None:
                    level[at][subtag(said)] += 1
    top = sum(levels[2].values())
    out = {}
    for key, text, said, host, suffix in rows:
        bins = trigrams(text) if (text or "").strip() else Counter()
        size = sum(bins.values())
        like = {n: sum(k * log[n](b) for b, k in bins.items()) for n in names}
        logs = {}
        for n in names:
            prior = (levels[2][n] + 1) / (top + len(names))
            for own, weight in ((levels[1].get(suffix, Counter()), language_id.SUFFIX_WEIGHT), (levels[0].get(host, Counter()), language_id.HOST_WEIGHT)):
                prior = (own[n] + weight * prior) / (sum(own.values()) + weight)
            mark = subtag(said)
            logs[n] = like[n] / 3 + math.log(prior) + (0 if mark not in names else math.log(1 - language_id.WRONG) if mark == n else math.log(language_id.WRONG / (len(names) - 1)))
        best = max(names, key=lambda n: (logs[n], [-ord(c) for c in n]))
        sure = 1 / sum(math.exp(x - logs[best]) for x in logs.values())
        by_text = max(names, key=lambda n: (like[n], [-ord(c) for c in n])) if size else None
        fit = like[by_text] / size + math.log(language_id.BINS) if size else 0.0
        kept = size > 0 and fit > language_id.MARGIN and sure >= 0.5
        out[key] = (best if kept else "und", by_text, sure, fit, kept)
    return out


def agree(found, want):
    assert found.keys() == want.keys()
    for key, (language, by_text, sure, fit, kept) in want.items():
        r = found[key]
        assert (r.language, r.text_language, r.kept) == (language, by_text, kept)
        assert r.confidence == pytest.approx(sure, rel=1e-4) and r.fit == pytest.approx(fit, abs=1e-4)


def test_languages_equal_a_plain_posterior(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    last = lambda s: s.rsplit(".", 1)[1] if s and re.search(r"\.[^.]+$", s) else None
    want = fused([(r.doc_id, r.text, r.lang, r.source, last(r.source)) for r in docs], [(r.text, r.lang) for r in docs])
    agree({r.doc_id: r for r in queries.op6_language_id(spark, small).collect()}, want)


def test_page_languages_equal_a_plain_posterior(spark, small):
    docs, pages = (spark.read.parquet(f"{small}/{t}.parquet").collect() for t in ("documents", "pages"))
    rows = []
    for p in pages:
        raw = p.html or ""
        host = (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", p.url or "") or [None, ""])[1].lower()
        said = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", raw, re.I)
        text = re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", raw))
        rows.append((p.page_id, text, said and said[1], host or None, host.rsplit(".", 1)[-1] or None))
    want = fused(rows, [(r.text, r.lang) for r in docs])
    agree({r.page_id: r for r in queries.language_id_pages(spark, small).collect()}, want)
