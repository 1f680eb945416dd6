"""Token counting by heap-and-linked-list byte-pair merging.

A pre-token starts as one symbol per UTF-8 byte, kept in a doubly linked list.
A heap yields the adjacent pair of lowest rank; each pop that is still valid joins
two symbols. The count is the number of initial symbols minus the merges; no
identifier is ever produced.

Edge cases: a null or empty text has 0 bytes and 0 tokens; a text of any length
is split at single spaces, so memory follows the longest run without a space;
repeated rows are counted independently, and there are no ties to break; an empty table gives an
empty result; columns named n_bytes, n_tokens or over_limit are replaced, others pass through untouched.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most counts remembered by one Python worker, and the longest remembered chunk.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value.

    Printable Latin-1 bytes stand for themselves; the others are numbered from
    U+0100 on in byte order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PairMerger:
    """Counts tokens under one byte-level merge table."""

    def __init__(self, definition: dict):
        self.ranks = {tuple(pair if isinstance(pair, list) else pair.split(" ")): rank for rank, pair in enumerate(definition["model"]["merges"])}
        special = sorted((t["content"] for t in definition.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PRETOKEN)
        self.alphabet = byte_alphabet()
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merged_length(self, piece: str) -> int:
        symbols: list[str | None] = [self.alphabet[b] for b in piece.encode()]
        size, ranks = len(symbols), self.ranks
        after = [*range(1, size), -1]
        before = list(range(-1, size - 1))
        heap = []
        for at in range(size - 1):
            rank = ranks.get((symbols[at], symbols[at + 1]))
            if rank is not None:
                heap.append((rank, at, symbols[at], symbols[at + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, at, left, right = heapq.heappop(heap)
            other = after[at]
            if symbols[at] != left or other < 0 or symbols[other] != right:
                continue  # one of the two has been merged since
            symbols[at], symbols[other] = left + right, None
            beyond = after[at] = after[other]
            merges += 1
            if beyond >= 0:
                before[beyond] = at
                rank = ranks.get((symbols[at], symbols[beyond]))
                if rank is not None:
                    heapq.heappush(heap, (rank, at, symbols[at], symbols[beyond]))
            ahead = before[at]
            if ahead >= 0:
                rank = ranks.get((symbols[ahead], symbols[at]))
                if rank is not None:
                    heapq.heappush(heap, (rank, ahead, symbols[ahead], symbols[at]))
        return size - merges

    def piece_count(self, piece: str) -> int:
        found = self.pieces.get(piece)
        if found is None:
            found = self.merged_length(piece)
            if len(piece) <= CACHE_CHARS:
                if len(self.pieces) >= CACHE_ENTRIES:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def chunk_count(self, chunk: str) -> int:
        found = self.chunks.get(chunk)
        if found is None:
            found = sum(map(self.piece_count, self.pattern.findall(chunk)))
            if len(chunk) <= CACHE_CHARS:
                if len(self.chunks) >= CACHE_ENTRIES:
                    self.chunks.clear()
                self.chunks[chunk] = found
        return found

    def span_count(self, text: str) -> int:
        """Tokens of a text without special strings.

        No pre-token crosses a single space between two visible characters, so
        such spaces cut the text into chunks that are counted once per distinct chunk.
        """
        if not text:
            return 0
        chunks = text.split(" ")
        first = chunks[0]
        tally = Counter(chunks)
        for chunk in tally:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                return sum(n * self.piece_count(p) for p, n in Counter(self.pattern.findall(text)).items())
        tally[first] -= 1
        lookup, total = self.chunks.get, self.chunk_count(first)
        for chunk, n in tally.items():
            if n:
                spaced = " " + chunk
                known = lookup(spaced)
                total += n * (self.chunk_count(spaced) if known is None else known)
        return total

    def count(self, text: str) -> int:
        if self.special is None:
            return self.span_count(text)
        spans = self.special.split(text)
        return len(spans) - 1 + sum(map(self.span_count, spans))


_merger: tuple[int, PairMerger] | None = None


def merger_for(definition: str) -> PairMerger:
    """One merger for each Python worker."""
    global _merger
    if _merger is None or _merger[0] != hash(definition):
        _merger = (hash(definition), PairMerger(json.loads(definition)))
    return _merger[1]


def count_tokens(df: DataFrame, tokenizer_file: str, *, text: str = "text", limit: int = 512) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) to each row.

    The vocabulary file is read once by the driver and broadcast: its size is fixed
    (1.6 MB), whatever the corpus. One narrow pass; nothing is shuffled.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merger = merger_for(shared.value)
        for batch in batches:
            yield pd.Series([merger.count(x) for x in batch], dtype="int64")

    return (
        df.withColumn("n_bytes", F.octet_length(whole_text(text)).cast("long"))
        .withColumn("n_tokens", tokens(whole_text(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
