"""Brute-force comparisons and edge cases of the corpus operators."""

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import chat_format, decontamination, html_extraction, language_id, lm_scoring, packing, quality_rules, sharding, simhash, token_counts
from lectern.llm.components import components
from lectern.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, _words string"
LONG = "lorem ipsum dolor sit amet " * 40_000
TEXTS = ["", None, " \n\t ", "One two three four five six seven eight nine ten eleven", LONG, "x" * 300_000, "Ünï côdé 漢字 😀 " * 20, "a\x1cb\x85c d", "same text here for ties"]


def rows(spark, texts=TEXTS):
    data = [(i, t, ["en", "fr", None][i % 3], ["s1", None, "s2"][i % 3], None, "clash", 7, "clash") for i, t in enumerate(texts)]
    data += [data[-1], (None, "no id at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def merger():
    with open(tokenizer_file(), encoding="utf-8") as f:
        return token_counts.PairMerger(json.load(f))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab'sll \n\t.,<|endoftx>1é　", max_size=60))
def test_token_counts_equal_the_library(text):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_token_counts_equal_the_library, "lib") else test_token_counts_equal_the_library.lib
    test_token_counts_equal_the_library.lib = lib
    if not hasattr(test_token_counts_equal_the_library, "own"):
        test_token_counts_equal_the_library.own = token_counts.PairMerger(json.load(open(tokenizer_file(), encoding="utf-8")))
    assert test_token_counts_equal_the_library.own.count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_odd_rows(spark, library):
    found = token_counts.count_tokens(rows(spark), tokenizer_file()).collect()
    assert len(found) == len(TEXTS) + 3
    for r in found:
        text = r.text or ""
        assert r.n_bytes == len(text.encode())
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert r.over_limit == (r.n_tokens > 512)
    assert token_counts.count_tokens(empty(spark), tokenizer_file()).count() == 0


def test_special_strings_count_once(merger, library):
    text = "a<|endoftext|><|endoftext|> b"
    assert merger.count(text) == len(library.encode(text, add_special_tokens=False).ids)


# simhash


def brute_print(text, width=3):
    ws = words(folded(text))
    shingles = [" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints, radius):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if bin(prints[i] ^ prints[j]).count("1") <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints(spark):
    for text in TEXTS[:4] + TEXTS[6:]:
        assert simhash.fingerprint(text or "") == brute_print(text)
    assert xxhash.xxh64_intdigest(b"a b c", 42) == spark.sql("SELECT xxhash64('a b c')").first()[0] % (1 << 64)


def test_covering_masks_reveal_every_pair_within_the_radius():
    masks = [m % (1 << 64) for m in simhash.covering_masks(3)]
    rng = random.Random(3)
    for _ in range(5000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not difference & m for m in masks)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(25)]
    for t in list(texts[:12]):
        for _ in range(4):
            ws = t.split()
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            texts.append(" ".join(ws))
    texts += [texts[0]] * 5 + ["", " ", None]
    rng.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in simhash.near_duplicates(frame).collect()}
    want = brute_components([brute_print(t) for t in texts], 3)
    assert [found[i].component_id for i in range(len(texts))] == want
    kept = sorted(r.doc_id for r in simhash.deduplicate(frame).collect())
    assert kept == sorted(set(want))


def test_blocks_of_a_large_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for seed in list(prints)[:3]:
        walk = seed
        for _ in range(60):
            walk ^= sum(1 << b for b in rng.sample(range(12), rng.randint(1, 4)))
            prints.add(walk)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, root long")
    edges = components(simhash.near_pairs(frame, 3)).collect()
    label = list(range(len(prints)))
    for r in edges:
        label[r.node] = r.component
    assert label == brute_components(prints, 3)


def test_near_duplicates_of_odd_rows(spark):
    found = simhash.near_duplicates(rows(spark)).collect()
    assert len(found) == len(TEXTS) + 3
    by_id = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert by_id[0] == by_id[1] == by_id[2] == 0
    kept = [r.doc_id for r in simhash.deduplicate(rows(spark)).collect()]
    assert kept.count(8) == 1 and kept.count(None) == 2 and 1 not in kept
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.deduplicate(empty(spark)).count() == 0


# quality rules


def brute_quality(text, window=5):
    ws = words(text)
    seen = Counter(tuple(ws[i : i + window]) for i in range(len(ws) - window + 1))
    held = {i + k for i in range(len(ws) - window + 1) if seen[tuple(ws[i : i + window])] > 1 for k in range(window)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(held)


@pytest.mark.parametrize("seed", range(3))
def test_quality_measures_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "a b c d e f ", "## ", "|", "É\t", "\n", "x y\n"]) for _ in range(rng.randint(0, 80))) for _ in range(60)] + TEXTS[:4]
    found = {r.doc_id: r for r in quality_rules.ledger(rows(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text), text


def test_quality_policies_and_ablations(spark):
    ledger = quality_rules.ledger(rows(spark)).cache()
    assert ledger.count() == len(TEXTS) + 3 and ledger.filter("doc_id = 1").first().failed_bits & 1
    table = {(r.version, r.rule): r for r in quality_rules.ablations(ledger).collect()}
    data = [r.failed_bits for r in ledger.collect()]
    for policy in quality_rules.POLICIES:
        mask = quality_rules.mask(policy)
        for name in policy.rules:
            bit = 1 << [r.name for r in quality_rules.RULES].index(name)
            row = table[policy.version, name]
            assert row.n_kept == sum(not b & mask for b in data)
            assert row.n_kept + row.n_only == sum(not b & mask & ~bit for b in data)
    assert quality_rules.ledger(empty(spark)).count() == 0


# sharding


def test_shards_are_near_equal_and_gapless(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = sharding.kd_shards(docs).toPandas()
    assert len(found) == docs.count() and sorted(found.shard.unique()) == list(range(16))
    sizes = found.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * found["size"].max()
    for _, g in found.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    for r in docs.limit(20).collect():
        assert found[found.doc_id == r.doc_id].text_crc32.iloc[0] == zlib.crc32(r.text.encode())


def test_shards_of_odd_rows(spark):
    found = sharding.kd_shards(rows(spark)).toPandas()
    assert len(found) == len(TEXTS) + 3 and found.shard.between(0, 15).all() and set(found[found.doc_id == 1]["size"]) == {1}
    for _, g in found.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.kd_shards(empty(spark)).count() == 0
    by_target = sharding.assign(sharding.metadata(rows(spark), key="doc_id", text="text", columns=("source",)), shards=None, target_bytes=400_000)
    assert by_target.select("shard").distinct().count() >= 2


def test_equal_rows_are_split_evenly(spark):
    same = spark.range(3200).selectExpr("id AS doc_id", "'same' AS text", "'hot' AS source", "'en' AS lang")
    assert {r["count"] for r in sharding.kd_shards(same).groupBy("shard").count().collect()} <= {199, 200, 201}


# decontamination


def edit_search(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    ends = row[1:]  # a place ends after at least one character
    return (min(ends), ends.index(min(ends)) + 1) if ends else (len(item), 0)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=20), st.text(alphabet="abc ", max_size=60), st.integers(0, 6))
def test_myers_equals_dynamic_programming(item, text, most):
    best, end = edit_search(item, text)
    found = decontamination.nearest(decontamination.alphabet_masks(item), len(item), text, most)
    assert found == ((best, end) if best <= most and text else None) or (not text and found is None)


def test_planted_items_are_found_with_their_edits(spark):
    rng = random.Random(2)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [make(30) for _ in range(20)]
    texts, want = [], set()
    for i in range(60):
        base = make(60)
        if i % 2:
            n = rng.randrange(20)
            t = list(items[n])
            for _ in range(int(0.05 * len(t)) if i % 4 == 1 else 0):
                t[rng.randrange(len(t))] = rng.choice(["", "z", "zz"])
            planted = base[:50] + "  " + "".join(t).upper() + "\n" + base[50:]
            if edit_search(decontamination.normalized(items[n]), decontamination.normalized(planted))[0] <= int(0.05 * len(decontamination.normalized(items[n]))):
                want.add((i, n))
            texts.append(planted)
        else:
            texts.append(base)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate([*items, "", None, "short"])), "item_id int, text string")
    found = decontamination.matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) >= 15
    for r in found:
        own = decontamination.normalized(texts[r.doc_id])
        assert edit_search(decontamination.normalized(items[r.item_id]), own)[0] == r.edits
    kept = {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()}
    assert kept == set(range(60)) - {i for i, _ in want}


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "nine ten eleven"), (2, "one two three four five six seven eight"), (None, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.start, r.end) for r in decontamination.matches(rows(spark), bench).orderBy("item_id").collect()] == [(3, 1, 40, 55), (3, 2, 0, 39)]
    short = spark.createDataFrame([(1, "ten ele"), (2, "One"), (3, "x"), (4, " "), (5, "TIES")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.start, r.end) for r in decontamination.matches(rows(spark), short).distinct().orderBy("item_id").collect()] == [(3, 2, 0, 3), (8, 5, 19, 23)]
    assert decontamination.decontaminate(rows(spark), bench).count() == len(TEXTS) + 2
    assert decontamination.matches(empty(spark), bench).count() == 0
    assert decontamination.decontaminate(rows(spark), bench.limit(0)).count() == len(TEXTS) + 3


# packing


def brute_pack(lengths, sources, clusters, capacity):
    pieces = sorted(((min(capacity, n - p * capacity), r, p) for r, n in enumerate(lengths) for p in range(max(1, -(-n // capacity)))), key=lambda x: (-x[0], x[1], x[2]))
    bins, out = [], []
    for size, r, p in pieces:
        fits = [b for b in bins if 0 < b["left"] and b["left"] >= size and (sources[r] is None or sources[r] not in b["s"]) and (clusters[r] is None or clusters[r] not in b["c"])]
        if fits:
            b = min(fits, key=lambda b: (b["left"], b["n"]))
        else:
            b = {"n": len(bins), "left": capacity, "s": set(), "c": set()}
            bins.append(b)
        out.append((r, p, p * capacity, size, b["n"], capacity - b["left"]))
        b["left"] -= size
        b["s"].add(sources[r])
        b["c"].add(clusters[r])
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 35), st.sampled_from([None, "a", "b", "c", "d", "e"]), st.integers(0, 8)), max_size=40))
def test_packing_equals_brute_force(docs):
    lengths, sources, clusters = ([d[i] for d in docs] for i in range(3))
    assert packing.pack(lengths, sources, clusters, 12) == brute_pack(lengths, sources, clusters, 12)


def test_packing_of_odd_rows(spark):
    found = packing.best_fit(rows(spark)).toPandas()
    texts = {i: len(t or "") for i, t in enumerate(TEXTS)}
    for i, n in texts.items():
        own = found[found.doc_id == i]
        assert own.length.sum() == n * (2 if i == len(TEXTS) - 1 else 1)
    assert (found.groupby("bin").length.sum() <= packing.CAPACITY).all()
    assert packing.best_fit(empty(spark)).count() == 0


# language


def test_languages_are_told_apart_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fit_on, held = docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0")
    model = language_id.fit(fit_on)
    assert language_id.identify(held, model, host="source").filter("text_language = lang").count() >= 0.95 * held.count()
    assert language_id.identify(held, model, declared="lang", host="source").filter("kept").count() >= 0.99 * held.count()


def test_priors_are_smoothed_up_the_hierarchy(spark):
    model = (["de", "en"], np.zeros((2, language_id.BINS), np.float32))
    data = [(i, "abc def", "en", "h1", "com") for i in range(30)] + [(30, "abc def", None, "h1", "com"), (31, "abc def", None, "h2", "com"), (32, "abc def", "de", "h3", "org")]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, host string, suffix string")
    found = {r.doc_id: r for r in language_id.identify(frame, model, declared="lang", host="host", suffix="suffix").collect()}
    prior = np.array([2, 31]) / 33
    com = (np.array([0, 30]) + language_id.SUFFIX_WEIGHT * prior) / (30 + language_id.SUFFIX_WEIGHT)
    host = (np.array([0, 30]) + language_id.HOST_WEIGHT * com) / (30 + language_id.HOST_WEIGHT)
    assert found[30].confidence == pytest.approx(host[1]) and found[31].confidence == pytest.approx(com[1])


def test_language_of_odd_rows(spark):
    model = language_id.fit(rows(spark))
    found = {r.doc_id: r for r in language_id.identify(rows(spark), model, declared="lang", host="source").collect()}
    assert not found[0].kept and not found[1].kept and found[1].language == "und"
    assert language_id.identify(empty(spark), language_id.fit(empty(spark)), declared="lang", host="source").count() == 0
    assert {r.kept for r in language_id.identify(rows(spark), ([], np.zeros((0, 1))), declared="lang").collect()} == {False}


def test_page_evidence(spark):
    frame = spark.createDataFrame([("HTTPS://u@A.Example.FR:80/x", '<HTML class="a" LANG=fr-CA><script>no</script><p>oui</p>'), (None, None), ("nothing", "")], "url string, html string")
    first, second, _ = language_id.page_evidence(frame).collect()
    assert (first.host, first.suffix, first.declared, first.text.strip()) == ("a.example.fr", "fr", "fr", "oui") and second.host is None


# scoring


def test_bit_predictions_sum_to_one_over_words():
    rng = np.random.default_rng(1)
    drawn = lambda bits: rng.normal(0, 3, 1 << bits).astype(np.float32)
    levels = lambda bits, most: rng.integers(0, most, 1 << bits).astype(np.uint8)
    rungs = np.tile(1 / (1 + np.exp(-np.linspace(-12, 12, lm_scoring.MAP))), (lm_scoring.GATES, 1)).astype(np.float32)
    mixer = lm_scoring.Frozen(drawn(lm_scoring.SLOT_BITS), levels(lm_scoring.SLOT_BITS, 3), drawn(lm_scoring.PREFIX_BITS), levels(lm_scoring.PREFIX_BITS, 6) * 3, rng.normal(0, 0.3, (lm_scoring.GATES, lm_scoring.INPUTS)).astype(np.float32), rungs)
    first = [bytes([b]) for b in range(256) if b != lm_scoring.STOP]
    ends = 10 ** mixer.costs([b""], np.zeros(1, np.int64))[0]
    longer = 0.0
    for b in first:
        one = 10 ** mixer.costs([b], np.zeros(1, np.int64))[0]
        longer += one
    assert 0 < ends < 1 and 0 < ends + longer < 1
    mixed = [b"", b"word", b"a-much-longer-word-than-the-others-are", b"x" * 1000]
    together = mixer.costs(mixed, np.zeros(4, np.int64))
    assert together == pytest.approx([mixer.costs([w], np.zeros(1, np.int64))[0] for w in mixed])


def brute_base(docs):
    counts = Counter()
    tokens = {}
    for i, text in docs:
        tokens[i] = words(folded(text)) + [""]
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    return {i: (len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in tokens.items()}


def test_scores_beat_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lm_scoring.score_texts(docs, top_words=1 << 10).toPandas().set_index("doc_id")
    want = brute_base([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    for i, (n, known, total, base) in want.items():
        r = found.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    full = lm_scoring.score_texts(docs).toPandas()
    held = full[full.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_scoring_of_odd_rows(spark):
    found = lm_scoring.score_texts(rows(spark)).collect()
    assert len(found) == len(TEXTS) + 3 and all(r.n_tokens == len(words(t)) + 1 for t, r in zip(TEXTS, sorted((r for r in found if r.doc_id is not None), key=lambda r: r.doc_id)))
    assert all(r.score < 0 for r in found)
    assert lm_scoring.score_texts(empty(spark)).count() == 0


# extraction

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="post"><h2>Head%d</h2><p>First &amp; <b>bo</b>ld %s.</p><p>Second para %s<br>line<script>var x="</p>";</script></p>
<p>Read more at our site.</p></div><div class="comments"><p>reader says %s</p></div></div><aside>side</aside><footer>foot</footer></body></html>"""


def test_slot_and_template_are_induced(spark):
    data = [(i, "http://h.example.com/%d" % i, PAGE % (i, "a%d" % i * 5, "b%d" % i * 30, i)) for i in range(8)]
    data += [(100 + i, "http://h.example.com/c", data[0][2]) for i in range(20)]
    frame = spark.createDataFrame(data, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extraction.extract(frame).collect()}
    for i in range(8):
        assert found[i] == f"Head{i} First & bold {'a%d' % i * 5}. Second para {'b%d' % i * 30} line"
    assert found[110] == found[0]


def test_simple_tree_matching_keeps_order():
    a = html_extraction.outline_tree(["/b/x", "/b/y", "/b/z/p"])
    b = html_extraction.outline_tree(["/b/y", "/b/x", "/b/z/p"])
    size, pairs = html_extraction.simple_tree_matching(a, b)
    assert size == 5 and ("/b/z/p", "/b/z/p") in pairs


def test_extraction_of_odd_pages(spark):
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    odd = [None, "", "plain words", "<article><p>open <b>bold<br><p>next", deep, "<p>a&nbsp;b &lt;tag&gt; &#233; &amp&amp;</p>", "<!-- only", "<script>x", "</p></div>text", "<table><tr><td>one<td>two</table>", '<p class="x>broken', "<article><p>" + LONG + "</p></article>"]
    frame = spark.createDataFrame([(i, None if i % 2 else "http://x.example/%d" % i, h, "clash") for i, h in enumerate(odd)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    found = {r.page_id: r.text for r in html_extraction.extract(frame).collect()}
    assert found[0] == found[1] == found[6] == found[7] == "" and found[2] == "plain words" and found[3] == "open bold next"
    assert found[4] == "deep text" and found[5] == "a b <tag> é &&" and found[9] == "one two" and found[11] == " ".join(LONG.split())
    assert html_extraction.extract(frame.limit(0)).count() == 0


# chat


def brute_cost(roles):
    best = {0: 0.0}
    for role in roles:
        new = {}
        for s, c in best.items():
            for s2, o, action, _ in chat_format.STEPS:
                if s2 == s:
                    new[o] = min(new.get(o, math.inf), c + chat_format.step_cost(role, o, action))
        best = new
    return min(c + chat_format.closing(s)[1] for s, c in best.items())


def parsed(text):
    return re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", text, re.S)


@pytest.mark.parametrize("block", [2, 1024])
def test_repaired_conversations_are_legal_and_cheapest(spark, monkeypatch, block):
    monkeypatch.setattr(chat_format, "BLOCK", block)
    rng = random.Random(4)
    data = []
    for conv in range(60):
        for turn in range(rng.randint(1, 7)):
            data.append((conv, turn, rng.choice(["user", "assistant", "system", "Human", "bot", None, "tool"]), rng.choice(["hi", "", None, "a <|end|> b", "line\nline"])))
    found = chat_format.repair(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).toPandas()
    for conv, own in found.groupby("conv_id"):
        turns = [d for d in data if d[0] == conv]
        text = "".join(own.sort_values(["turn", "piece"]).rendered)
        out = parsed(text)
        assert "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in out) == text
        roles = [r for r, _ in out]
        roles = roles[1:] if roles[0] == "system" else roles
        assert roles == ["user", "assistant"] * (len(roles) // 2)
        assert own.cost.iloc[0] == pytest.approx(brute_cost([chat_format.role_code(d[2]) for d in turns]))
        kept = "".join(t.replace("\n\n", "") for _, t in out)
        assert kept == "".join(chat_format.shielded(d[3] or "").replace("\n\n", "") for d in sorted(turns, key=lambda d: d[1]))


def test_chat_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, k string, b string"
    frame = spark.createDataFrame([(None, None, None, None, "x", "y"), (1, None, "user", "a", "", ""), (1, 0, "user", "a", "", ""), (1, 0, "user", "a", "", ""), (2, 5, "assistant", LONG, "", "")], schema)
    found = chat_format.repair(frame).toPandas()
    assert len(found[found.role_in.notna() | (found.action != "insert")]) == 5
    assert chat_format.repair(frame.limit(0)).count() == 0
