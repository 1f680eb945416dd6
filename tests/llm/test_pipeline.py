"""The pipeline against a brute-force version of each stage."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from lectern.llm import decontamination, language_id, quality_rules  # noqa: E402

from .test_near_copies import brute_labels  # noqa: E402
from .test_operators import SCHEMA, brute_quality, empty, rows  # noqa: E402


def passes(text):
    n_words, chars, symbols, dup, repeat = brute_quality(text)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    letters = sum(c.isalpha() for c in text or "")
    capitals = sum(c.isupper() for c in text or "")
    failed = (
        n_words < 10,
        100 * repeat > 20 * n_words,
        10 * symbols > 3 * n_words,
        2 * dup > len(lines),
        chars < 2 * n_words or chars > 20 * n_words,
        letters >= 50 and 10 * capitals > 6 * letters,
        2 * letters < chars,
    )
    assert len(failed) == len(quality_rules.RULES)
    return not any(failed)


def test_pipeline_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in language_id.identify(docs, language_id.fit(docs), declared="lang", host="source").filter("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept and passes(r.text)}
    ids = sorted(texts)
    label = brute_labels([texts[i] for i in ids])
    texts = {i: texts[i] for n, i in enumerate(ids) if label[n] == n}
    items = [decontamination.normalized(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = {i for i, t in texts.items() if not any(item in decontamination.normalized(t) for item in items)}
    found = pipeline.run(spark, small).toPandas()
    assert set(found.doc_id) == clean and len(clean) > 100
    for i, own in found.groupby("doc_id"):
        assert own.length.sum() == len(texts[i])


def test_stages_survive_odd_rows(spark, tmp_path):
    for frame in (rows(spark), empty(spark)):
        docs = frame.select("doc_id", "text", "lang", "source", "n_chars")
        spark.createDataFrame([(1, "a test item that is long enough to be used as evidence")], "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
        for n, (_, stage) in enumerate(pipeline.STAGES):
            place = str(tmp_path / f"{frame.count()}-{n}")
            stage(spark, docs, str(tmp_path)).write.parquet(place)
            docs = spark.read.parquet(place)
    assert SCHEMA
