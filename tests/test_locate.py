"""Places of items against a scan of all windows, and items of free-form output."""

import math
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators import locate


def brute(text, item, threshold=0.85):
    plain = lambda s: "".join(c for c in s if not c.isspace() and not unicodedata.category(c).startswith("P"))
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or {s}
    if not text or not item:
        return None
    if item in text:
        return text.index(item), text.index(item) + len(item)
    if not plain(item):
        return None
    sizes = range(max(1, math.floor(len(item) * 0.7)), min(len(text), math.ceil(len(item) * 1.5)) + 1)
    windows = [(a, a + n) for n in sizes for a in range(len(text) - n + 1)]
    for a, b in windows:
        if plain(text[a:b]) == plain(item):
            return a, b
    best = None
    for a, b in windows:
        x, y = grams(item), grams(text[a:b])
        score = len(x & y) / len(x | y)
        if score > threshold:
            threshold, best = score, (a, b)
    return best


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab, .x", max_size=24), st.text(alphabet="ab, .x", max_size=9), st.sampled_from([0.3, 0.6, 0.85]))
def test_places_equal_a_scan_of_all_windows(text, item, threshold):
    assert locate.locate(text, item, threshold) == brute(text, item, threshold)


def test_anchors(spark):
    items = spark.createDataFrame([(1, "b c", "x"), (1, "b，c", "x"), (1, "zz", "x"), (2, "a", "x"), (1, None, "x"), (1, "", "x")], "unit int, original string, _exact string")
    segments = spark.createDataFrame([(1, "a b c"), (3, "a")], "unit int, target string")
    found = {r.original: r.anchor and tuple(r.anchor) for r in locate.anchored(items.drop("_exact"), segments).collect()}
    assert found == {"b c": (2, 5), "b，c": (2, 5), "zz": None, "a": None, None: None, "": None}


def test_items_of_output(spark):
    texts = ['```json\n{"items": [{"original": "a", "corrected": "b"}]}\n```', 'say {"items": [{"original": "q}\\"", "n": 1}]} end', '[{"original": "x"}, {"other": 1}]', "none", "", None, '{"items": 3}', "``` ```"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = [(r.doc_id, r.idx, r.item) for r in locate.items_of(frame).orderBy("doc_id", "idx").collect()]
    assert found == [(0, 0, {"original": "a", "corrected": "b"}), (1, 0, {"original": 'q}"', "n": "1"}), (2, 0, {"original": "x"})]
