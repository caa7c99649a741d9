"""Token counts: heap-and-linked-list byte-pair merging without identifiers.

A text is cut where the vocabulary's own pattern always cuts it: before a lone space or line
break between two non-space characters.  Each distinct piece is counted once per worker and
remembered in a table of bounded size, so the merging runs on distinct pieces only.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, batch_of, small_batches

#: Fixed value: the pattern that the byte-level vocabulary splits text by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of the pieces that a worker remembers.
TABLE_BYTES = 160 << 20
#: str.split and str.isspace take these for white space, the pattern doesn't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_OUT = [("n_bytes", pa.int64()), ("n_tokens", pa.int64())]


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Irregular(Exception):
    """A piece that begins or ends with white space: the quick cut does not hold for its text."""


class Merges:
    """Ranks of adjacent pairs, read from a public vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.vocab = model["vocab"]
        self.symbols = byte_symbols()
        self.special = [t["content"] for t in told["added_tokens"]]

    def spell(self, piece: str) -> list[str]:
        return [self.symbols[b] for b in piece.encode("utf-8")]


def merged_parts(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """What is left of the symbols after all merges, in n log n steps.

    The symbols form a doubly linked list; a heap holds (rank, place) of adjacent pairs.  An
    entry is stale, and skipped, when a neighbour has merged since it was pushed.
    """
    n = len(symbols)
    text: list[str | None] = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, k) for k in range(n - 1) if (r := rank.get((symbols[k], symbols[k + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, k = heapq.heappop(heap)
        if text[k] is None or (j := after[k]) >= n or rank.get((text[k], text[j])) != r:
            continue
        text[k] += text[j]
        text[j] = None
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
            if (q := rank.get((text[k], text[after[k]]))) is not None:
                heapq.heappush(heap, (q, k))
        if before[k] >= 0 and (q := rank.get((text[before[k]], text[k]))) is not None:
            heapq.heappush(heap, (q, before[k]))
    return [t for t in text if t is not None]


def merged_count(symbols: list[str], rank: dict[tuple[str, str], int]) -> int:
    """Initial symbols minus merges."""
    return len(merged_parts(symbols, rank))


@functools.lru_cache(1)
def _merges(vocabulary: str) -> Merges:
    """A worker reads the file once."""
    return Merges(vocabulary)


class PieceCounts(Remembered):
    """Tokens of a piece; a piece that starts with a line break stands for itself, others follow a space."""

    def __init__(self, merges: Merges) -> None:
        super().__init__(TABLE_BYTES)
        self.merges = merges
        self.find = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, merges.special)) + ")") if merges.special else None

    def count(self, text: str) -> int:
        """Of any text, special strings counted as one token each."""
        parts = self.cut.split(text) if self.cut else [text]
        total = len(parts) // 2
        for part in parts[::2]:
            for word in self.find(part):
                total += merged_count(self.merges.spell(word), self.merges.rank)
        return total

    def __missing__(self, piece: str) -> int:
        body = piece[1:] if piece[:1] == "\n" else piece
        if not body or body[0].isspace() or body[-1].isspace():
            raise _Irregular
        return self.keep(piece, self.count(piece if piece[0] == "\n" else " " + piece))

    def of(self, text: str) -> int:
        if not text:
            return 0
        if not any(c in text for c in _SEPARATORS):
            first, *rest = text.replace("\n", " \n").split(" ")
            try:
                # The first piece follows no space, unless the text starts with white space.
                if first and not first[0].isspace() and not first[-1].isspace():
                    return self.count(first) + sum(map(self.__getitem__, rest))
            except _Irregular:
                pass
        return self.count(text)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, for a byte-level BPE vocabulary file.

    Null texts count as empty (0 tokens); repeated rows, null ids and extra columns are no
    matter: each input row gives one row.  An empty table gives an empty one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(_merges(vocabulary))
        for b in small_batches(batches):
            texts = b.column(1).to_pylist()
            out = batch_of(_OUT, [len(t.encode("utf-8")) for t in texts], [counts.of(t) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), *out.columns], names=["doc_id", *out.schema.names])

    kept = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    counted = kept.mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
