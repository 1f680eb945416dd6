"""The model of op3 learns from every counted word, and its scores equal a plain sum bit by bit."""

import math
import tracemalloc
import zlib

import numpy as np
import pytest

lm_scoring = pytest.importorskip("lectern.llm.lm_scoring")

from .test_operators import folded, words  # noqa: E402


def vocabulary_of(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = sorted({r.lang or "" for r in docs.select("lang").distinct().collect()})
    vocabulary = lm_scoring.word_counts(docs, names, text="text", label="lang").cache()
    return names, vocabulary, vocabulary.toPandas()


def listed(held, names):
    counts = held[[f"n_{i}" for i in range(len(names))]].to_numpy()
    at, cls = np.nonzero(counts)
    spelled = [w.encode() for w in held.word]
    return [spelled[i] for i in at], cls, counts[at, cls].astype(float)


def test_every_counted_word_is_learnt(spark, small):
    names, vocabulary, held = vocabulary_of(spark, small)
    given, cls, n = listed(held, names)
    learner = lm_scoring.Learner()
    learner.take(given, cls, n)
    bits = sum(8 * (len(w) + 1) * k for w, k in zip(given, n))
    assert learner.bits.sum() == pytest.approx(bits) and learner.shown[1].sum() == pytest.approx(bits)
    assert learner.counts.sum() == pytest.approx(5 * bits)
    whole = lm_scoring.learn(vocabulary, names)
    alone = lm_scoring.frozen(learner.sums())
    assert np.allclose(whole.logits, alone.logits, atol=1e-4) and np.array_equal(whole.prefix_levels, alone.prefix_levels)


def test_the_driver_never_holds_the_counts(spark, small):
    names, vocabulary, held = vocabulary_of(spark, small)
    lm_scoring.learn(vocabulary.limit(100), names)  # imports and caches
    tracemalloc.start()
    model = lm_scoring.learn(vocabulary, names)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * lm_scoring.SLOTS  # the counts alone are 16 bytes a slot, the model 5
    learner = lm_scoring.Learner()
    learner.take(*listed(held, names))
    alone = lm_scoring.frozen(learner.sums())
    assert np.array_equal(model.levels, alone.levels) and np.allclose(model.prefix_logits, alone.prefix_logits, atol=1e-4)


def test_learnt_weights_lower_the_cost_of_words_not_seen(spark, small):
    names, _, held = vocabulary_of(spark, small)
    given, cls, n = listed(held, names)
    half = [i for i in range(len(given)) if zlib.crc32(given[i]) % 2]
    rest = [i for i in range(len(given)) if not zlib.crc32(given[i]) % 2]
    learner = lm_scoring.Learner()
    start = learner.weights.copy()
    learner.take([given[i] for i in half], cls[half], n[half])
    model = lm_scoring.frozen(learner.sums())
    new = [given[i] for i in rest]
    learnt = (n[rest] * model.costs(new, cls[rest])).sum()
    model.weights = start.astype(np.float32)
    assert learnt > (n[rest] * model.costs(new, cls[rest])).sum()


def plain_cost(model, word, cls):
    """log10 probability of one word, one bit after the other."""
    total = 0.0
    for _, bit, slots, prefix in lm_scoring.bit_slots([word], np.array([cls])):
        for b in range(len(bit)):
            gate = int(model.prefix_levels[prefix[b]]) + int(model.levels[slots[2][b]])
            inputs = [float(model.logits[slots[k][b]]) for k in range(4)] + [float(model.prefix_logits[prefix[b]]), lm_scoring.BIAS]
            s = max(-lm_scoring.LIMIT, min(lm_scoring.LIMIT, sum(x * float(w) for x, w in zip(inputs, model.weights[gate]))))
            place = (s + lm_scoring.LIMIT) / (2 * lm_scoring.LIMIT) * (lm_scoring.MAP - 1)
            low = min(int(place), lm_scoring.MAP - 2)
            shown = float(model.ladder[gate][low]) * (1 - place + low) + float(model.ladder[gate][low + 1]) * (place - low)
            p = (1 / (1 + math.exp(-s)) + shown) / 2
            total += math.log10(p if bit[b] else 1 - p)
    return total


@pytest.mark.parametrize("top", [1 << 17, 50])
def test_scores_equal_a_plain_sum(spark, small, monkeypatch, top):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 60")
    kept = {}
    whole = lm_scoring.learn

    def watched(vocabulary, names):
        kept["names"], kept["model"] = names, whole(vocabulary, names)
        return kept["model"]

    monkeypatch.setattr(lm_scoring, "learn", watched)
    found = {r.doc_id: r for r in lm_scoring.score_texts(docs, top_words=top).collect()}
    rows = docs.collect()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10]
    sizes = np.array([sum((r.lang or "") == name for r in train) for name in kept["names"]], float) + 0.5
    memory = {}

    def cost(word, cls):
        if (word, cls) not in memory:
            memory[word, cls] = plain_cost(kept["model"], word.encode(), cls)
        return memory[word, cls]

    for r in rows[:12]:
        own = words(folded(r.text)) + [""]
        sums = [math.log10(sizes[c] / sizes.sum()) + sum(cost(w, c) for w in own) for c in range(len(sizes))]
        assert any(found[r.doc_id].score == pytest.approx(s, rel=1e-4) for s in sums)
        if top > 50:
            assert found[r.doc_id].score == pytest.approx(max(sums), rel=1e-3)
