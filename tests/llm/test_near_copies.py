"""Near copies against all pairs by brute force."""

import random

import pytest

near_copies = pytest.importorskip("lectern.llm.near_copies")

from .test_operators import TEXTS, empty, folded, rows, words  # noqa: E402


def brute_set(text, width=5):
    ws = words(folded(text))
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def brute_labels(texts, least=0.8):
    sets = [brute_set(t) for t in texts]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
    label, changed = list(range(len(texts))), True
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(60, 200))] for _ in range(20)]
    for base in texts[:8]:
        last = base
        for n in range(14):
            copy = list(last if n % 2 else base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
            last = copy
    texts = [" ".join(t) for t in texts] + ["", " ", None, "a b", "A  b", "a b c"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block, star", [(256, 64), (4, 2)])
def test_near_copies_equal_brute_force(spark, monkeypatch, block, star):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "STAR", star)
    texts = corpus(5)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()}
    want = brute_labels(texts)
    assert [found[i] for i in range(len(texts))] == want
    assert sorted(r.doc_id for r in near_copies.deduplicate(frame).collect()) == sorted(set(want))


def test_blocks_lose_no_link_between_groups():
    rng = random.Random(6)
    texts = [t for t in corpus(6) if brute_set(t)]
    sets = [near_copies.shingles(t) for t in texts]
    want = brute_labels(texts)
    groups = [i if rng.random() < 0.7 else want[i] for i in range(len(texts))]
    label = list(groups)
    links = near_copies.forest(near_copies.np.arange(len(texts)), near_copies.np.array(groups), sets, 0.8)
    for _ in texts:
        for a, b in [(r["u"], r["v"]) for r in links] + list(enumerate(groups)):
            label[a] = label[b] = min(label[a], label[b])
    assert label == want


def test_stage_drops_a_near_copy_beyond_three_bits(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from lectern.llm import simhash

    rng = random.Random(1)
    base = ["w%d" % rng.randrange(10_000) for _ in range(100)]
    copies = []
    while len(copies) < 20:
        copy = list(base)
        for at in rng.sample(range(5, 95), 2):
            copy[at] = "changed%d" % rng.randrange(10_000)
        copies.append(" ".join(copy))
    first = simhash.fingerprint(" ".join(base))
    far = [c for c in copies if bin(first ^ simhash.fingerprint(c)).count("1") > 3]
    assert far and len(brute_set(far[0]) & brute_set(" ".join(base))) >= 0.8 * len(brute_set(far[0]) | brute_set(" ".join(base)))
    frame = spark.createDataFrame([(0, " ".join(base)), (1, far[0])], "doc_id long, text string")
    assert [r.doc_id for r in pipeline.drop_near_duplicates(spark, frame, "").collect()] == [0]


def test_near_copies_of_odd_rows(spark):
    found = near_copies.near_copies(rows(spark)).collect()
    assert len(found) == len(TEXTS) + 3
    by_id = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert by_id[0] == by_id[1] == by_id[2] == 0
    kept = [r.doc_id for r in near_copies.deduplicate(rows(spark)).collect()]
    assert kept.count(8) == 1 and kept.count(None) == 2 and 1 not in kept
    assert near_copies.deduplicate(empty(spark)).count() == 0


def test_pipeline_drops_every_near_copy(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    from lectern.llm import decontamination, language_id

    from .test_pipeline import passes

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in language_id.identify(docs, language_id.fit(docs), declared="lang", host="source").filter("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept and passes(r.text)}
    ids = sorted(texts)
    label = brute_labels([texts[i] for i in ids])
    items = [decontamination.normalized(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = {i for n, i in enumerate(ids) if label[n] == n and not any(item in decontamination.normalized(texts[i]) for item in items)}
    assert {r.doc_id for r in pipeline.run(spark, small).select("doc_id").distinct().collect()} == want and len(want) > 100


def test_fingerprints_gather_the_copies(spark, monkeypatch):
    """SimHash tables and radius alone connect every pair of near copies, in buckets of any size."""
    texts = [t for t in corpus(7) if brute_set(t)]
    sets = [near_copies.shingles(t) for t in texts]
    want = brute_labels(texts)
    frame = spark.createDataFrame([(i, bytearray(near_copies.fingerprint(s))) for i, s in enumerate(sets)], "fp long, print binary")
    for bucket, prints in ((2048, 4096), (8, 4096), (8, 4), (2048, 16)):
        monkeypatch.setattr(near_copies, "BUCKET", bucket)
        monkeypatch.setattr(near_copies, "PRINTS", prints)
        chosen = near_copies.tables(len(sets), 0.8)
        assert (chosen.shape[1] > 0) == (bucket == 8) and len(chosen) >= 1
        label = list(range(len(sets)))
        edges = near_copies.sketch_links(frame, chosen, near_copies.sketch_radius(0.8)).collect()
        for _ in texts:
            for u, v in edges:
                label[u] = label[v] = min(label[u], label[v])
        assert all(label[i] == label[w] for i, w in enumerate(want))
        assert len(set(label)) > 10


def test_similar_sets_differ_in_few_bits():
    rng = near_copies.np.random.default_rng(8)
    bits = 64 * (near_copies.SKETCH + near_copies.WIDE)
    apart = []
    for _ in range(30):
        pool = rng.integers(0, 1 << 63, 540, dtype=near_copies.np.uint64)
        one, other, far = pool[:180], near_copies.np.concatenate([pool[:160], pool[180:200]]), pool[360:]
        prints = [near_copies.np.frombuffer(near_copies.fingerprint(x), near_copies.np.uint8) for x in (one, other, far)]
        apart.append([near_copies.np.bitwise_count(prints[0] ^ p).sum() / bits for p in prints[1:]])
    near, far = near_copies.np.mean(apart, axis=0)
    assert abs(near - near_copies.flips(0.8)) < 0.02 and abs(far - 0.5) < 0.02
    assert near_copies.fingerprint(near_copies.shingles("")) == b""


def test_a_group_of_copies_has_few_links(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BUCKET", 32)
    rng = random.Random(9)
    base = ["w%d" % rng.randrange(1000) for _ in range(300)]
    texts = [" ".join(base[:at] + ["x%d" % at] + base[at + 1 :]) for at in range(256)]
    frame = spark.createDataFrame([(i, bytearray(near_copies.fingerprint(near_copies.shingles(t)))) for i, t in enumerate(texts)], "fp long, print binary")
    edges = near_copies.sketch_links(frame, near_copies.tables(256, 0.8), near_copies.sketch_radius(0.8)).collect()
    assert 255 <= len(edges) <= 400 and {x for e in edges for x in e} == set(range(256))
