"""Places in texts against plain loops, and edge cases of the operators around them."""

from pyspark.sql import functions as F

from lectern.functions import memory, notes, private_use
from lectern.operators import context, numbering, parse, segment
from lectern.plans.views import md_docs


def around(text, start, end, before, after):
    """Line by line, without any index."""
    lines, at = text.split("\n"), [0]
    for line in lines:
        at.append(at[-1] + len(line) + 1)
    blank = lambda i: not (0 <= i < len(lines)) or not lines[i].strip()
    top = max(i for i in range(len(lines)) if at[i] <= start)
    bottom = top + text[start:end].count("\n")
    while bottom > top and blank(bottom):
        bottom -= 1
    while not blank(top - 1):
        top -= 1
    while not blank(bottom + 1):
        bottom += 1
    lead, tail = text[at[top] : start].rstrip(), text[end : at[bottom + 1] - 1].strip()
    heads, tails = [lead] if lead else [], [tail] if tail else []
    for i in range(top - 1, -1, -1):
        if not blank(i) and blank(i - 1) and len(heads) < before:
            heads.insert(0, "\n".join(lines[i:top]).rstrip())
    for i in range(bottom + 1, len(lines)):
        if not blank(i) and blank(i - 1) and len(tails) < after:
            j = i
            while not blank(j + 1):
                j += 1
            tails.append("\n".join(lines[i : j + 1]))
    return "\n\n".join(f"<{t}>\n" + "\n\n".join(x) + f"\n</{t}>" for t, x in (("before", heads), ("after", tails)) if x)


def test_chunks_in_context_equal_a_plain_loop(spark, small):
    docs = md_docs(spark, small)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = context.by_length_in_context(docs, 300, 2, 2).collect()
    assert len({r.doc_id for r in rows}) == len(texts)
    for r in rows:
        at = texts[r.doc_id].find(r.target)
        assert r.context == (around(texts[r.doc_id], at, at + len(r.target), 2, 2) if at >= 0 else "")


def test_spans_everywhere(spark):
    texts = ["a\nb\n\nc d\ne\n\n \nf\n", "", "x", "\n\nx\n\n", "a\n\nb\n\nc\n\nd"]
    rows = [(t, a, b) for t in texts for a in range(len(t) + 1) for b in range(a, len(t) + 1)]
    found = spark.createDataFrame(rows, "t string, a int, b int").select("t", "a", "b", context.around_span(F.col("t"), F.col("a"), F.col("b"), 2, 1).alias("c")).collect()
    for r in found:
        assert r.c == around(r.t, r.a, r.b, 2, 1), r


def test_joined_paragraphs_by_hand(spark):
    cases = {
        "a\n b \n\nc": "a b\n\nc",
        "- x\n y\nz\n\nw\nv": "- x\n y\nz\n\nw v",
        "a\n```\nb\nc\n```\nd\ne": "a\n```\nb\nc\n```\nd e",
        "```\na\nb": "```\na\nb",
        "a\n| t |\nb\nc\n---\nd": "a\n| t |\nb c\n---\nd",
        "1. x\n# h\na\nb": "1. x\n# h\na b",
        " \n": " \n",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", context.joined_paragraphs(F.col("t")).alias("j")).collect()
    assert {r.t: r.j for r in rows} == {**cases, None: None}


def test_private_numbers_by_hand(spark):
    spell = lambda *places: "".join(chr(0x100000 + p) for p in places)
    cases = {spell(0xCA, 2 + 7): "⑦", spell(0xCA, 0x48 + 2, 0x52 + 1): "㉑", spell(0xCA, 0x8E + 1, 0x98, 0xA2 + 5): "[105]", spell(0xCA, 2): spell(0xCA, 2), spell(0xB64, 0xB65): spell(0xB64, 0xB65), spell(0xB60, 0xB61, 0xA81, 0xA81) + "x": "x", spell(0xCA, 3, 4): "①" + spell(4), None: None, "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", private_use.decoded(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == cases
    numbers = spark.range(0, 10_001).select("id", private_use.decoded(private_use.encoded(F.col("id")), True).alias("d")).collect()
    assert all(r.d == (f"[{r.id}]" if 1 <= r.id <= 9999 else None) for r in numbers)


def test_inline_numbers_by_hand(spark):
    text = "甲一、乙 （三）①x\u00018. 3.5 B.\n其二，（4）\n\n第一，a"
    rows = numbering.inline_numbers(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert [(r.line_no, r.start, r.slot, r.number, r.value) for r in rows] == [(1, 5, 5, "三", 3), (1, 8, 11, "①", 1), (1, 11, 13, "8", 8), (1, 18, 14, "B", 2), (2, 0, 16, "二", 2), (2, 3, 9, "4", 4), (4, 0, 15, "一", 1)]
    kept = numbering.segment_numbers(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line_no", "start").collect()
    assert [(r.segment, r.line_no, r.slot) for r in kept] == [(1, 1, 11), (1, 1, 13), (1, 1, 14), (1, 2, 16), (1, 2, 9)]


def test_parsed_answers_without_an_object(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "no"), (4, "{broken"), (5, "{}"), (6, '{"decisions": 3, "lookups": []}')], "doc_id int, text string")
    assert not parse.lookup_plan(rows).count() and not parse.rerank_decisions(rows).count() and not parse.merge_groups(rows).count()


def test_notes_and_memory_of_nothing(spark):
    row = spark.range(1).select(
        notes.note_of_quote(F.lit("“a” b\n①"), F.lit(0), F.lit(3)).alias("next_line"), notes.note_at_end(F.lit("x ^1^ ")).alias("end"), notes.note_after(F.lit("")).alias("none"),
        memory.entry(F.lit(None).cast("string"), F.lit("b"), F.lit(None).cast("double"), F.lit(None).cast("string")).alias("e"),
    ).first()
    assert (row.next_line, row.end, row.none) == (None, "^1^", None)
    assert (row.e.original, row.e.changed_to, row.e.weight, row.e.note) == ("", "b", 0, None)


def test_outline_equals_a_stack(spark):
    import random

    draw, texts = random.Random(3), []
    for _ in range(40):
        texts.append("\n".join(draw.choice(["x", "", "```", "#" * draw.randint(1, 7) + " " + draw.choice("abc") + draw.choice(["", " ##"]), "# "]) for _ in range(draw.randint(0, 30))))
    want = []
    for k, text in enumerate(texts):
        fence, stack = False, []
        for n, line in enumerate(text.split("\n"), 1):
            if line.startswith("```"):
                fence = not fence
                continue
            hashes = len(line) - len(line.lstrip("#"))
            title = line[hashes:].strip().removesuffix(" ##").strip()
            if fence or not 1 <= hashes <= 6 or not title or line[hashes] != " ":
                continue
            stack = [h for h in stack if h[0] < hashes] + [(hashes, title)]
            want.append((k, n, hashes, title, " > ".join(t for _, t in stack)))
    found = segment.outline(spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id int, text string")).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.line_no, r.level, r.title, r.heading_path) for r in found] == want


def test_long_texts_are_cut_in_linear_time(spark):
    import time

    long = spark.createDataFrame([(1, "# a\nOne is. Two are! Three\n\n" * 40_000)], "doc_id int, text string")
    began = time.perf_counter()
    assert segment.sentence_spans(long).count() == 40_000 * 3
    assert segment.outline(long).count() == 40_000
    assert time.perf_counter() - began < 30
