"""Wrapper induction against a brute-force alignment, and the parser on markup that misleads."""

import random
from collections import defaultdict
from functools import cache
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

X = pytest.importorskip("lectern.llm.html_extraction")

SCHEMA = "page_id long, url string, html string, _host string, shape int, row string"


def page(rng, n):
    """A page without article or main: every part of it is optional, so nearly every outline of the host differs."""
    said = lambda k: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(999)) for _ in range(k))
    body, text = "", []
    if rng.random() < 0.5:
        body += "<div><p>Your daily read since 1950, brought to you by everyone here.</p></div>"
    if rng.random() < 0.5:
        body += f"<div class=box><ul><li>{said(2)}</ul></div>"
    inner = f"<h2>{(head := said(4))}</h2>"
    text.append(head)
    for kind in rng.choices(["p", "ul", "pre", "blockquote", "section"], [6, 1, 1, 1, 1], k=rng.randrange(3, 9)):
        part = said(25)
        text.append(part)
        inner += f"<{kind}><{'li' if kind == 'ul' else 'p' if kind == 'section' else 'b'}>{part}</{'li' if kind == 'ul' else 'p' if kind == 'section' else 'b'}></{kind}>"
        if rng.random() < 0.6:
            inner += "<p>Read more at our site.</p>"
    body += f"<div class=mid>{inner}</div>"
    if rng.random() < 0.7:
        body += "<div><p>All words are ours and may be read by all who come here to read them.</p></div>"
    if rng.random() < 0.5:
        body += f'<div class="comment-list"><div><p>{said(30)}</p></div></div>'
    return f"<html><body>{body}</body></html>", " ".join(text)


def table(spark, seed=5, hosts=4, pages=25):
    rng, rows, want = random.Random(seed), [], {}
    for host in range(hosts):
        for _ in range(pages):
            html, text = page(rng, len(rows))
            want[len(rows)] = text
            rows.append((len(rows), f"http://h{host}.example/{len(rows)}", html, "x", 1, "y"))
    copies = [(1000 + i, "http://h0.example/copy", rows[0][2], None, None, None) for i in range(60)]
    want.update({1000 + i: want[0] for i in range(60)})
    return spark.createDataFrame(rows + copies, SCHEMA).repartition(5), want


def brute(rows):
    """Texts by exhaustive matching and plain counting, page by page."""

    def best(a, b):
        @cache
        def go(x, y):
            if known[x].label != known[y].label:
                return 0, ()
            top = (1, ((known[x].path, known[y].path),))
            m, n = kids[x], kids[y]
            for size in range(1, min(len(m), len(n)) + 1):
                for left in combinations(m, size):
                    for right in combinations(n, size):
                        parts = [go(i, j) for i, j in zip(left, right)]
                        if all(p[0] for p in parts) and 1 + sum(p[0] for p in parts) > top[0]:
                            top = 1 + sum(p[0] for p in parts), ((known[x].path, known[y].path), *(q for p in parts for q in p[1]))
            return top

        known, kids = {}, {}

        def walk(tree, mark):
            key = (mark, tree.path)
            known[key] = tree
            kids[key] = tuple(walk(k, mark) for k in tree.kids)
            return key

        return go(walk(a, 0), walk(b, 1))

    by_host = defaultdict(list)
    for key, url, html in rows:
        by_host[url.split("/")[2]].append((key, X.blocks(html)))
    out = {}
    for pages in by_host.values():
        differing = {tuple(found): found for _, found in pages}
        outlines = defaultdict(int)
        for found in differing.values():
            outlines["\n".join(X.outline(found))] += 1
        template = max(outlines, key=lambda o: (outlines[o], len(o), X.digest(o)))
        names = {}
        for own in outlines:
            matched = {b: a for a, b in best(X.outline_tree(template.split("\n")), X.outline_tree(own.split("\n")))[1]}
            for path in own.split("\n"):
                up, rest = path, []
                while up not in matched:
                    up, _, last = up.rpartition("/")
                    rest.insert(0, last)
                boxes = [x for x in rest if X.tag_of(f"/{x}") not in X.LEAVES]
                node = matched[up]
                if boxes and not X.in_part(node):  # pooled below the node: parts apart from the rest
                    named = next((i for i, x in enumerate(boxes) if X.MARK in x), None)
                    node += "/+" if named is None else "/+!" if named == 0 else "/+/+!"
                names[own, path] = node, matched[up] + "".join("/" + (x if x not in boxes else "+" + x) for x in rest)
        shown, on, nodes = defaultdict(set), defaultdict(set), {}
        for k, found in enumerate(differing.values()):
            own = "\n".join(X.outline(found))
            for path, text, _ in found:
                node, name = names[own, path]
                shown[name, text].add(k)
                on[name].add(k)
                nodes[name] = min(node, nodes.get(name, node))
        constant = {(name, text) for (name, text), ks in shown.items() if len(ks) + 1 >= X.CONSTANT * (len(on[name]) + 2)}
        mass = defaultdict(float)
        for (name, text), ks in shown.items():
            mass[nodes[name]] += 0 if (name, text) in constant else len(text) * len(ks)
        root = X.slot(mass)
        for key, found in pages:
            own = "\n".join(X.outline(found))
            out[key] = " ".join(t for p, t, _ in found if X.inside(names[own, p][0], root) and (names[own, p][1], t) not in constant and not X.in_part(p))
    return out


def test_hosts_of_many_outlines_equal_brute_force(spark):
    frame, want = table(spark)
    rows = [(r.page_id, r.url, r.html) for r in frame.collect()]
    outlines = {(u.split("/")[2], tuple(X.outline(X.blocks(h)))) for _, u, h in rows}
    assert len(outlines) > 60
    found = {r.page_id: r.text for r in X.extract(frame).collect()}
    assert found == brute(rows)
    assert found == want


def test_without_the_wrappers_the_result_differs(spark):
    frame, want = table(spark)
    alone = {r.page_id: X.main_text(X.blocks(r.html), None, False, set()) for r in frame.collect()}
    assert sum(alone[i] != want[i] for i in want) > len(want) / 2


@pytest.mark.parametrize("limits", [{"SMALL_BYTES": 0}, {"SMALL_ROWS": 0}, {"SMALL_BYTES": 0, "SMALL_ROWS": 0}])
def test_joins_and_broadcasts_agree(spark, monkeypatch, limits):
    frame, want = table(spark, hosts=2)
    for name, value in limits.items():
        monkeypatch.setattr(X, name, value)
    found = X.extract(frame)
    assert found.columns == [*frame.columns, "text"]
    assert {r.page_id: (r.text, r._host) for r in found.collect()} == {i: (want[i], "x" if i < 1000 else None) for i in want}


def test_names_and_clashing_columns_pass_through(spark):
    frame, want = table(spark, hosts=1)
    renamed = frame.withColumnsRenamed({"html": "raw.html", "url": "host"}).withColumnRenamed("raw.html", "root")
    found = X.extract(renamed, url="host", html="root", into="page")
    assert {r.page_id: r.page for r in found.collect()} == want


def test_copies_are_no_template(spark):
    html = "<body><div class=x><p>%s</p></div><div class=mid><h2>One head</h2><p>%s</p><p>%s</p></div></body>"
    same = "the very same long paragraph of an article that was copied over and over again " * 5
    frame = spark.createDataFrame([(i, "http://c.example/", html % (f"advert {i}", same, same[::-1])) for i in range(9)], "page_id long, url string, html string")
    for r in X.extract(frame).collect():
        assert r.text == f"One head {same.strip()} {' '.join(same[::-1].split())}"


MISLEADING = {
    '<main><p title="The hidden truth">Kept one.</p><p>Two.</p></main>': "Kept one. Two.",
    '<main><p data-id="comment-12">Kept one.</p><p>Two.</p></main>': "Kept one. Two.",
    '<div class="post no-sidebar comments-open share-enabled"><p>Kept one.</p><p>Two.</p></div>': "Kept one. Two.",
    "<main><p title=it's>Don't go.</p><p>Two.</p></main>": "Don't go. Two.",
    "<div><main>" + "<div>" * 300 + "deep" + "</div>" * 300 + "<p>rest</p></main></div>": "deep rest",
    "<article><p>One.</p><div class=comments><p>reader says</p></div></article>": "One.",
    "<article><header><h1>Head</h1></header><p hidden>no</p><p>One <a href='>'>two</a>.</p></article>": "Head One two.",
    "<body><div class=ad>buy this now</div><div class=story><p>One two three four five.</p></div></body>": "One two three four five.",
    "<p a='b": "",
}


@pytest.mark.parametrize("html", list(MISLEADING))
def test_markup_that_misleads(html):
    assert X.main_text(X.blocks(html), None, False, set()) == MISLEADING[html]


def trees(depth):
    return st.lists(st.sampled_from("abc"), max_size=3).flatmap(lambda names: st.tuples(*(st.tuples(st.just(n), trees(depth - 1)) for n in names)) if depth else st.just(()))


@settings(max_examples=60, deadline=None)
@given(trees(3), trees(3))
def test_matching_is_largest(left, right):
    def built(kids, path):
        node = X.Tree(path.rpartition("/")[2].partition("~")[0], path)
        node.kids = [built(below, f"{path}/{name}~{n}") for n, (name, below) in enumerate(kids)]
        return node

    def most(a, b):
        if not a or not b:
            return 0
        same = 1 + most(a[0][1], b[0][1]) + most(a[1:], b[1:]) if a[0][0] == b[0][0] else 0
        return max(same, most(a[1:], b), most(a, b[1:]))

    size, pairs = X.simple_tree_matching(built(left, ""), built(right, ""))
    assert size == 1 + most(left, right) == len(pairs)
