"""Main-text extraction by wrapper induction over same-host pages.

A page is parsed into a tree without the elements that are never article text (menus, page headers, footers,
sidebars, forms, scripts, styles and other embedded matter). Its outline is the ordered list of paths of its
elements with text, where siblings of one shape are folded into one. A host elects one template, the outline
that most of its pages have, and every outline of the host is aligned with it by simple tree matching. Texts are
then counted at aligned nodes over all pages of the host, whatever their outlines: a text that nearly all pages
with the node show is constant, so template; the rest varies. The content slot is found by walking the template
down to the container that holds the varying text, and a page's main text is what varies in its own copy of the slot.

Names of classes, ids and roles (a comment list, an advert) only rank slots that vary: a part so named is no content
while other nodes hold a tenth of the host's varying text. Copies never pass for a template: where constants would
leave less than a tenth of a host's text, or are more than half of its slot, the pages are copies and nothing is constant.

Pages are read twice and never shuffled while the wrappers are small (measured in bytes): the first pass sends hashes and lengths of
blocks, the second applies the wrapper of each page's host and outline. Beyond that pages meet wrappers in a salted join.

Edge cases: null or empty html gives the empty text; broken markup is closed as browsers do; nesting
below DEPTH is read as part of the element there; a null or hostless url is a host of its own with every other such page;
a page whose outline lacks its host's slot, like one of a host with a single page, is walked by its own text; ties between outlines go to the
longer one, then by hash, between slots to the first path; pages of any length are read whole; repeated rows are extracted each and counted once; an
empty table gives an empty result; a column named like ``into`` is replaced, all others, whatever their names, pass through untouched.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

DEPTH = 200
#: Share of the pages with a node that must show a text for it to be template, by the rule of succession: (shown + 1) / (pages + 2).
CONSTANT = 0.8
#: A container is entered where it holds this share of the varying text around it, unless headings or this share of other text lie beside it.
SLOT, BESIDE = 0.7, 0.05
#: Least share of the varying text outside named parts, and of all text that must vary at a host.
OUTSIDE, VARYING = 0.1, 0.1
#: Bytes of wrappers and rows of templates that are broadcast; salts of the joins beyond.
SMALL_BYTES, SMALL_ROWS, SALTS = 64_000_000, 100_000, 32

# Element names of the markup language, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe button select option input textarea svg canvas dialog menu object embed audio video map title noembed noframes xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody", "thead"}}
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote td th tr tbody thead table figcaption figure".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "option": {"select"}}

# Words in class, id and role that name a part beside the article, and words that make such a name a state of something else.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu sidebar breadcrumb breadcrumbs "
    "footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search share sharing social "
    "related recommended recommendations comment comments commentlist respond reply replies discussion disqus pagination pager widget toolbar skip copyright complementary contentinfo".split()
)
STATES = frozenset("no not non has have with without is are can open opened closed enabled disabled on off allow allowed show shown hide layout page body type template format single post entry".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
WORDS = re.compile(r"[a-z]+")
#: Ends the label of a node that names a part.
MARK = "!"


class Node:
    __slots__ = ("dropped", "kids", "label", "shape", "tag")

    def __init__(self, tag: str, label: str, dropped: bool):
        self.tag, self.label, self.dropped, self.kids, self.shape = tag, label, dropped, [], None


def names_part(token: str) -> bool:
    words = WORDS.findall(token)
    return not PARTS.isdisjoint(words) and STATES.isdisjoint(words)


def described(tag: str, attributes: str) -> tuple[str, bool]:
    """(label, whether it is hidden or an element that is never article text)."""
    label, dropped, part = tag, tag in DROPPED, False
    if attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role"):
                tokens = unescape(value.strip("\"'")).lower().split()
                if name != "role":
                    label += ("." if name == "class" else "#") + ".".join(re.sub(r"\d+", "0", t) for t in tokens)
                part = part or any(map(names_part, tokens))
            elif name == "hidden" or name == "aria-hidden" and value.strip("\"'").lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
                dropped = True
    label = label.replace("/", ".").replace("~", ".").replace("\n", ".").replace(MARK, ".")
    return label + MARK if part and tag not in ("body", "html", "main") else label, dropped


def parse(html: str) -> Node:
    root = Node("", "", False)
    stack, at, size = [root], 0, len(html)
    unpushed: Counter = Counter()
    while at < size:
        found = TOKEN.search(html, at)
        if found is None:
            stack[-1].kids.append(html[at:])
            break
        if found.start() > at:
            stack[-1].kids.append(html[at : found.start()])
        at = found.end()
        closing, opening, attributes = found.groups()
        if opening:
            tag = opening.lower()
            if tag in CLOSES_P:
                close(stack, {"p"}, {"td", "th", "button", "object"})
            if tag in CLOSED_BY:
                close(stack, CLOSED_BY[tag], SCOPES[tag])
            node = Node(tag, *described(tag, attributes))
            if tag == "header" and not any(x.tag in ("article", "main") for x in stack):
                node.dropped = True
            stack[-1].kids.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                node.kids.append(html[at : end.start() if end else size])
                at = end.end() if end else size
            elif tag not in VOID and not (attributes or "").endswith("/"):
                if len(stack) < DEPTH:
                    stack.append(node)
                else:
                    unpushed[tag] += 1
        elif closing:
            tag = closing.lower()
            if unpushed[tag]:
                unpushed[tag] -= 1
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    unpushed.clear()
                    break
                if stack[depth].tag in ("table", "body") and tag not in ("html", "body", "article", "main"):
                    break
    return root


def close(stack: list[Node], tags: set[str], scope: set[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in tags:
            del stack[depth:]
            return
        if stack[depth].tag in scope:
            return


def shape_of(node: Node) -> tuple:
    """The labels below a node, siblings of one shape once: what must agree for two siblings to be folded."""
    if node.shape is None:
        kids = (k for k in node.kids if not isinstance(k, str) and not k.dropped and k.tag not in INLINE and k.tag not in VOID)
        node.shape = (node.label,) if node.tag in LEAVES else (node.label, *dict.fromkeys(map(shape_of, kids)))
    return node.shape


def blocks(html: str | None) -> list[tuple[str, str, int]]:
    """(path, text, characters within links) of each block with text, in page order.

    Leaves of one label share a path under their parent; containers are told apart by their place among those of their label, runs of one shape folded.
    """
    if not html:
        return []
    out: list[tuple[str, str, int]] = []
    held: list[str] = []
    linked = [0]

    def flush(path: str) -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append((path, text, min(linked[0], len(text))))
        held.clear()
        linked[0] = 0

    def visit(node: Node, path: str, link: bool) -> None:
        runs: Counter = Counter()
        last = None
        for kid in node.kids:
            if isinstance(kid, str):
                text = unescape(kid) if "&" in kid else kid
                held.append(text)
                if link:
                    linked[0] += len(text.strip())
            elif kid.dropped:
                if kid.tag not in INLINE:
                    flush(path)
            elif kid.tag in INLINE:
                visit(kid, path, link or kid.tag == "a")
            elif kid.tag in VOID:
                held.append(" ")
                if kid.tag == "hr":
                    flush(path)
            else:
                flush(path)
                below = f"{path}/{kid.label}"
                if kid.tag not in LEAVES:
                    if shape_of(kid) != last:
                        runs[kid.label] += 1
                        last = kid.shape
                    if runs[kid.label] > 1:
                        below += f"~{runs[kid.label]}"
                visit(kid, below, link)
                flush(below)

    visit(parse(html), "", False)
    flush("")
    return out


class Tree:
    """An outline as a tree of distinct paths."""

    __slots__ = ("kids", "label", "path", "size")

    def __init__(self, label: str, path: str):
        self.label, self.path, self.kids, self.size = label, path, [], 1


def outline_tree(paths: Iterable[str]) -> Tree:
    root = Tree("", "")
    known = {"": root}
    for path in paths:
        step = ""
        for name in path.split("/")[1:]:
            parent, step = known[step], f"{step}/{name}"
            if step not in known:
                known[step] = Tree(name.partition("~")[0], step)
                parent.kids.append(known[step])
    return root


def simple_tree_matching(a: Tree, b: Tree, memory: dict | None = None) -> tuple[int, list[tuple[str, str]]]:
    """(size of the largest order-preserving mapping that keeps labels and parents, its pairs of paths)."""
    if a.label != b.label:
        return 0, []
    memory = {} if memory is None else memory
    m, n = len(a.kids), len(b.kids)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    own = [[(0, [])] * n for _ in range(m)]
    for i in range(m):
        for j in range(n):
            key = (a.kids[i].path, b.kids[j].path)
            if key not in memory:
                memory[key] = simple_tree_matching(a.kids[i], b.kids[j], memory)
            own[i][j] = memory[key]
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + own[i][j][0])
    pairs, i, j = [(a.path, b.path)], m, n
    while i and j:
        size, inner = own[i - 1][j - 1]
        if size and best[i][j] == best[i - 1][j - 1] + size:
            pairs += inner
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, pairs


def tag_of(path: str) -> str:
    return re.split(r"[.#~!]", path.rpartition("/")[2], maxsplit=1)[0]


def in_part(path: str) -> bool:
    return MARK in path


def unmatched(node: str, name: str) -> str:
    """Where a container's text counts that the matching leaves out below node: with all such, parts on their own, never as node's own text."""
    if MARK in name:
        return node if in_part(node) else f"{node}/+{MARK}"
    return node if in_part(node) or node.endswith("/+") else f"{node}/+"


def aligned(template: Tree, paths: list[str]) -> dict[str, tuple[str, str]]:
    """For each path of an outline, and each above them: (template node that its text counts for, name at the host).

    A node that the matching leaves out is named by its nearest matched ancestor and its own way from there; a container on that way never takes the
    name of a template node, a leaf takes that of its like under the same parent.
    """
    matched = {b: a for a, b in simple_tree_matching(template, outline_tree(paths))[1]}
    out = {"": ("", "")}
    for path in paths:
        step = ""
        for name in path.split("/")[1:]:
            above, step = out[step], f"{step}/{name}"
            if step not in out:
                if step in matched:
                    out[step] = matched[step], matched[step]
                elif tag_of(step) in LEAVES:
                    out[step] = above[0], f"{above[1]}/{name}"
                else:
                    out[step] = unmatched(above[0], name), f"{above[1]}/+{name}"
    return out


def inside(path: str, root: str) -> bool:
    return not root or path == root or path.startswith(root + "/")


def honoured(mass: dict[str, float]) -> bool:
    """Whether names of parts count: enough varying text lies outside them."""
    return sum(m for p, m in mass.items() if not in_part(p)) >= OUTSIDE * sum(mass.values())


def slot(mass: dict[str, float]) -> str:
    """The container that a walk down the tree ends in: always the child with most of the varying text, while it holds SLOT of it.

    A container that itself holds headings or a fair share of text is the article; so is the article or main element around the end of the walk.
    """
    if honoured(mass):
        mass = {p: m for p, m in mass.items() if not in_part(p)}
    upto: dict[str, float] = defaultdict(float)
    below: dict[str, set[str]] = defaultdict(set)
    for path, chars in mass.items():
        step = path
        upto[step] += chars
        while step:
            above = step.rpartition("/")[0]
            below[above].add(step)
            upto[above] += chars
            step = above
    at = ""
    while True:
        kids = sorted(below[at], key=lambda p: (-upto[p], p))
        boxes = [p for p in kids if tag_of(p) not in LEAVES]
        beside = mass.get(at, 0.0) + sum(upto[p] for p in kids if tag_of(p) in LEAVES)
        headed = any(tag_of(p) in HEADS and upto[p] > 0 for p in kids)
        if not boxes or not upto[at] or headed or beside > BESIDE * upto[at] or upto[boxes[0]] < SLOT * upto[at]:
            break
        at = boxes[0]
    steps = at.split("/")
    for kind in ("article", "main"):
        for depth in range(len(steps), 1, -1):
            if tag_of("/" + steps[depth - 1]) == kind:
                return "/".join(steps[:depth])
    return at


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def outline(found: list[tuple[str, str, int]]) -> list[str]:
    return list(dict.fromkeys(path for path, _, _ in found))


def main_text(found: list[tuple[str, str, int]], root: str | None, parts: bool, constants: frozenset | set) -> str:
    """What varies in the slot; with no slot, or an empty one, the page is walked by its own text. parts: whether their names count."""
    held = [] if root is None else [(p, t) for p, t, _ in found if inside(p, root)]
    if not held:
        mass: dict[str, float] = defaultdict(float)
        for path, text, links in found:
            mass[path] += len(text) - links
        root, parts = slot(mass), honoured(mass)
        held = [(p, t) for p, t, _ in found if inside(p, root)]
    if parts:
        held = [(p, t) for p, t in held if not in_part(p[len(root) :])]
    if constants:
        held = [(p, t) for p, t in held if digest(f"{p}\n{t}") not in constants]
    return " ".join(t for _, t in held)


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def met(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", small: bool = True) -> DataFrame:
    """many joined with few, at most a handful of whose rows share a key: broadcast, or else salted, so that no key is hot."""
    if small:
        return many.join(F.broadcast(few), on, how)
    salted = many.withColumn("_salt", (F.rand(7) * SALTS).cast("int"))
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to one row for each node and text of a page; the first row of a page carries its outline."""
    names = ["host", "shape", "page", "path", "text", "mark", "chars", "links", "outline"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        for host, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = blocks(raw)
            if not found:
                continue
            joined = "\n".join(outline(found))
            shape, page = digest(joined), digest(" ".join(t for _, t, _ in found))
            for n, ((path, text), links) in enumerate({(p, t): k for p, t, k in found}.items()):
                row = (host, shape, page, path, digest(text), digest(f"{path}\n{text}"), len(text), links, None if n else joined)
                for column, value in zip(columns, row):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, shape, outline, template) to (host, shape, path, node, name) of every node of the outline."""
    for batch in batches:
        out = []
        for host, shape, own, template in zip(batch.host, batch["shape"], batch.outline, batch.template):
            named = aligned(outline_tree(template.split("\n")), own.split("\n"))
            out += [(host, shape, path, node, name) for path, (node, name) in named.items()]
        yield pd.DataFrame(out, columns=["host", "shape", "path", "node", "name"])


def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, nodes), nodes holding varying and constant text, to (host, root, parts, template): the slot, whether parts and constants count."""
    for batch in batches:
        out = []
        for host, nodes in zip(batch.host, batch.nodes):
            vary = {n["node"]: float(n["vary"]) for n in nodes}
            fixed = {n["node"]: float(n["fixed"]) for n in nodes}
            template = sum(vary.values()) >= VARYING * (sum(vary.values()) + sum(fixed.values()))
            mass = vary if template else {p: vary[p] + fixed[p] for p in vary}
            root = slot(mass)
            template = template and sum(fixed[p] for p in fixed if inside(p, root)) <= sum(vary[p] for p in vary if inside(p, root))
            out.append((host, root, honoured(mass), template))
        yield pd.DataFrame(out, columns=["host", "root", "parts", "template"])


def induce(pages: DataFrame, *, url: str, html: str) -> DataFrame:
    """(host, shape, root, parts, constants): the wrapper of every outline of every host.

    What is grouped by host is aggregated before it is shuffled, and what meets in one row is a template's nodes, as many as a page has.
    """
    seen = pages.select(host_of(url).alias("host"), F.col(html).alias("h")).mapInArrow(facts, "host string, shape long, page long, path string, text long, mark long, chars int, links int, outline string")
    once = materialize(seen.groupBy("host", "shape", "page", "path", "text", "mark").agg(F.max("chars").alias("chars"), F.max("links").alias("links"), F.max("outline").alias("outline")))
    shapes = once.filter("outline IS NOT NULL").groupBy("host", "shape").agg(F.count("*").alias("n"), F.first("outline").alias("outline"))
    elected = F.max_by("outline", F.struct("n", F.length("outline"), "shape")).alias("template")
    templates = materialize(shapes.groupBy("host").agg(elected))
    size = templates.agg(F.count("*"), F.coalesce(F.sum(F.length("template")), F.lit(0))).first()
    small = size[0] <= SMALL_ROWS and size[1] <= SMALL_BYTES
    named = materialize(met(shapes.drop("n"), templates, ["host"], small=small).mapInPandas(ways, "host string, shape long, path string, node string, name string"))
    few = named.agg(F.count("*"), F.coalesce(F.sum(F.length("path") + F.length("node") + F.length("name") + F.length("host")), F.lit(0))).first()
    few = few[0] <= SMALL_ROWS and few[1] <= SMALL_BYTES
    placed = met(once.drop("outline"), named, ["host", "shape", "path"], small=few)
    texts = placed.groupBy("host", "name", "text").agg(F.count_distinct("page").alias("shown"), F.max(F.col("chars") - F.col("links")).alias("chars"), F.min("node").alias("node"))
    nodes = placed.groupBy("host", "name").agg(F.count_distinct("page").alias("pages"))
    constant = (F.col("shown") + 1) >= CONSTANT * (F.col("pages") + 2)
    judged = materialize(met(texts, nodes, ["host", "name"], small=few).withColumn("constant", constant).drop("pages"))
    amount = F.col("chars") * F.col("shown")
    sums = judged.groupBy("host", "node").agg(F.sum(F.when(F.col("constant"), 0).otherwise(amount)).alias("vary"), F.sum(F.when(F.col("constant"), amount).otherwise(0)).alias("fixed"))
    found = materialize(sums.groupBy("host").agg(F.collect_list(F.struct("node", "vary", "fixed")).alias("nodes")).mapInPandas(slots, "host string, root string, parts boolean, template boolean"))
    within = lambda path: (F.col("root") == "") | (F.col(path) == F.col("root")) | F.startswith(F.col(path), F.concat("root", F.lit("/")))
    own = met(named.filter("node = name"), found, ["host"], small=small).filter("node = root").select("host", "shape", F.col("path").alias("root"), "parts")
    inner = materialize(met(judged.filter("constant").select("host", "name", "text"), found.filter("template"), ["host"], small=small).filter(within("name")).select("host", "name", "text"))
    if not inner.count():
        return own.withColumn("constants", F.array().cast("array<long>"))
    shown = placed.select("host", "shape", "name", "text", "mark").join(inner, ["host", "name", "text"], "left_semi")
    marks = shown.groupBy("host", "shape").agg(F.collect_set("mark").alias("constants"))  # as many as a page of the outline has blocks, or a quarter more
    return own.join(marks, ["host", "shape"], "left").withColumn("constants", F.coalesce("constants", F.array().cast("array<long>")))


def extract(pages: DataFrame, *, url: str = "url", html: str = "html", into: str = "text") -> DataFrame:
    """pages with their main text. Wrappers are broadcast while they hold at most SMALL_BYTES; beyond, they join in a salted shuffle."""
    wrappers = materialize(induce(pages, url=url, html=html))
    keep = [F.col(f"`{c}`") for c in pages.columns if c != into]
    held = wrappers.agg(F.coalesce(F.sum(F.length("host") + F.length("root") + 8 * F.size("constants") + 64), F.lit(0))).first()[0]
    if held <= SMALL_BYTES:
        known = {(r.host, r.shape): (r.root, r.parts, frozenset(r.constants)) for r in wrappers.toLocalIterator()}
        shared = pages.sparkSession.sparkContext.broadcast(known)

        @F.pandas_udf("string")
        def cut(hosts: pd.Series, raws: pd.Series) -> pd.Series:
            out = []
            for host, raw in zip(hosts, raws):
                found = blocks(raw)
                out.append(main_text(found, *shared.value.get((host, digest("\n".join(outline(found)))), (None, False, frozenset()))))
            return pd.Series(out, dtype=object)

        return pages.select(*keep, cut(host_of(url), F.col(html)).alias(into))

    @F.pandas_udf("long")
    def shaped(raws: pd.Series) -> pd.Series:
        return pd.Series([digest("\n".join(outline(blocks(raw)))) for raw in raws], dtype="int64")

    @F.pandas_udf("string")
    def cut_joined(roots: pd.Series, parts: pd.Series, constants: pd.Series, raws: pd.Series) -> pd.Series:
        out = [main_text(blocks(raw), root, bool(part), frozenset() if marks is None else frozenset(marks.tolist())) for root, part, marks, raw in zip(roots, parts, constants, raws)]
        return pd.Series(out, dtype=object)

    # The page travels as one struct, so that its column names meet no others.
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), host_of(url).alias("host"), shaped(F.col(html)).alias("shape"))
    joined = met(rows, wrappers, ["host", "shape"], "left", small=False)
    text = cut_joined("root", "parts", "constants", F.col("row").getField(html)).alias(into)
    return joined.select(*(F.col("row").getField(c).alias(c) for c in pages.columns if c != into), text)
