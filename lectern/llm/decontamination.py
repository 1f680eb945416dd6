"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and white-space runs become one space. An item of m characters may differ
by k = floor(rate * m) edits. Cut into k + 1 pieces, any occurrence within k edits holds at least one
piece unchanged, so an automaton over all pieces proposes places, and Myers' bit-parallel distance
verifies each of them over the whole item.

Edge cases: a null text or item is the empty text, and an empty item never matches; an item under ``shortest`` normalized
characters allows no edits and counts only where it stands as whole words, so that it is not found inside others; a text of any length is scanned whole, in one row; repeated
rows are reported each; of several places the one with fewest edits, then the leftmost, is reported;
an empty table on either side gives no match; other columns pass through untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import whole_text

#: Share of an item's characters that may differ, and the characters below which an item must stand exactly, as whole words.
RATE, SHORTEST = 0.05, 32
#: Bytes of items matched in one pass; a larger test set takes more passes, each of bounded memory.
BLOCK_BYTES = 8_000_000


def normalized(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def alphabet_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        masks[ch] |= 1 << i
    return dict(masks)


def nearest(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best substring of text, leftmost end first; None beyond ``most``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, ch in enumerate(text):
        eq = masks.get(ch, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        rise = minus | (full & ~(diagonal | plus))
        fall = plus & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1, fall << 1
        vertical = eq | minus
        plus = (fall | ~(vertical | rise)) & full
        minus = rise & vertical & full
        if score <= most:
            best, most = (score, j + 1), score - 1
            if score == 0:
                break
    return best


class Matcher:
    """One block of items, ready to be searched in texts."""

    def __init__(self, items: list[tuple[object, str]], rate: float, shortest: int):
        texts = [(key, normalized(raw)) for key, raw in items]
        self.items = [(key, t, int(rate * len(t))) if len(t) >= shortest else (key, f" {t} ", 0) for key, t in texts if t]
        self.short = {n for n, (_, t, _) in enumerate(self.items) if t[0] == " "}
        self.masks: dict[int, tuple[dict, dict]] = {}
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            cuts = [i * len(t) // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[t[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def verify(self, n: int, text: str, starts: list[int]) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best place of item n near the proposed starts."""
        _, item, k = self.items[n]
        m = len(item)
        for at in sorted(starts):
            if at >= 0 and text.startswith(item, at):
                return 0, at, at + m
        if n not in self.masks:
            self.masks[n] = alphabet_masks(item), alphabet_masks(item[::-1])
        forward, backward = self.masks[n]
        windows: list[list[int]] = []
        for at in sorted(starts):
            low, high = max(0, at - k), min(len(text), at + m + k)
            if windows and low <= windows[-1][1]:
                windows[-1][1] = high
            else:
                windows.append([low, high])
        best = None
        for low, high in windows:
            found = nearest(forward, m, text[low:high], k if best is None else best[0] - 1)
            if found:
                end = low + found[1]
                back = nearest(backward, m, text[max(0, end - m - k) : end][::-1], found[0])
                best = found[0], end - back[1], end
        return best

    def find(self, raw: str | None) -> list[tuple[object, int, int, int]]:
        """(item key, edits, start, end) of every item that occurs; places are in the normalized text."""
        if not self.items:
            return []
        text, proposed = normalized(raw), defaultdict(set)
        if self.short:
            text = f" {text} "
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                proposed[n].add(end - size + 1 - offset)
        hits = [(n, hit) for n in sorted(proposed) if (hit := self.verify(n, text, proposed[n]))]
        if not self.short:
            return [(self.items[n][0], *hit) for n, hit in hits]
        size = len(text) - 2  # places without the blanks around the text and around short items
        return [(self.items[n][0], edits, min(size, max(0, start - 1 + (n in self.short))), min(size, end - 1 - (n in self.short))) for n, (edits, start, end) in hits]

    def any(self, raw: str | None) -> bool:
        return bool(self.find(raw))


def blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of BLOCK_BYTES: what is sent to executors at once never grows with the test set."""
    block, held = [], 0
    for row in benchmark.select(F.col(key).alias("k"), whole_text(text).alias("t")).orderBy("k").toLocalIterator():
        block.append((row.k, row.t))
        held += len(row.t.encode())
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = RATE, shortest: int = SHORTEST) -> DataFrame:
    """(key, item_key, edits, start, end): one row for each document and item that occurs in it. No shuffle of documents."""
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, key), (benchmark, item_key))]
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, edits int, start long, `end` long"
    rows = docs.select(key, whole_text(text).alias("t"))
    id_type = to_arrow_type(benchmark.schema[item_key].dataType)
    found = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, item_key, item_text):

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate, shortest)
            for batch in batches:
                at, hits = [], []
                for n, raw in enumerate(batch.column(1).to_pylist()):
                    for hit in matcher.find(raw):
                        at.append(n)
                        hits.append(hit)
                if hits:
                    ids, edits, starts, ends = (list(x) for x in zip(*hits))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, id_type), pa.array(edits, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                        names=[key, item_key, "edits", "start", "end"],
                    )

        found = found.unionByName(rows.mapInArrow(search, schema))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = RATE, shortest: int = SHORTEST) -> DataFrame:
    """The documents in which no item occurs, filtered in place: a narrow pass for each block of items."""
    where = docs.columns.index(text)
    for block in blocks(benchmark, item_key, item_text):

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate, shortest)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.any(raw) for raw in batch.column(where).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
