"""Document fingerprints from prefix polynomial hashes.

For a text c_0 .. c_{n-1} the prefix array S holds S[i] = sum of c_j * B^j, j < i, modulo
2^31 - 1.  The hash of the span [i, j) is (S[j] - S[i]) * B^-i: equal spans have equal hashes
wherever they lie, in any text.  Two uses are made of the arrays here:

* the fingerprint: the hash of the whole text under two moduli, then, for each of SLOTS
  classes of span hashes, a byte of the smallest one (a one-permutation sketch of all spans
  of SPAN code points, so its agreement estimates the share of common spans);
* the longest common prefix of two texts, by binary search over equal prefixes.

Spans count as equal if their hashes agree to both of two bases, 62 bits in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, small_batches

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 790_973_861)
SPAN = 16
SLOTS = 128
_MIX, _REMIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_P, _31 = np.uint64(PRIME), np.uint64(31)
_TOPS = np.arange(SLOTS, dtype=np.uint64) << np.uint64(57)
_FULL = "0" * 16


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x < 2^62, in [0, 2^31 - 1)."""
    x = (x & _P) + (x >> _31)
    x = (x & _P) + (x >> _31)
    return np.where(x >= _P, x - _P, x)


class Powers:
    """B^i and B^-i modulo the prime, as far as the longest text so far."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, PRIME - 2, PRIME)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, _fold(self.up * np.uint64(pow(self.base, k, PRIME)))])
            self.down = np.concatenate([self.down, _fold(self.down * np.uint64(pow(self.inverse, k, PRIME)))])
        return self.up[:n], self.down[:n]


class PrefixHash:
    """Prefix arrays of texts: span hashes, equality of spans, longest common extensions."""

    def __init__(self) -> None:
        self.powers = [Powers(b) for b in BASES]

    def prefixes(self, text: str, which: int = 0) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        codes += np.uint64(1)
        terms = codes * self.powers[which].to(len(codes))[0]
        terms = (terms & _P) + (terms >> _31)
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(terms, out=out[1:])
        return out

    def spans(self, prefixes: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all spans of that length."""
        n = len(prefixes) - 1
        inner = prefixes[length:] - prefixes[: n - length + 1]
        inner = (inner & _P) + (inner >> _31)
        return _fold(inner * self.powers[0].to(n - length + 1)[1])

    def both(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Prefix arrays to both bases."""
        return self.prefixes(text, 0), self.prefixes(text, 1)

    def same_span(self, a: tuple[np.ndarray, np.ndarray], i: int, b: tuple[np.ndarray, np.ndarray], j: int, length: int) -> bool:
        for powers, p, q in zip(self.powers, a, b, strict=True):
            down = powers.to(max(i, j) + 1)[1]
            x, y = (int(s[k + length] - s[k]) % PRIME * int(down[k]) % PRIME for s, k in ((p, i), (q, j)))
            if x != y:
                return False
        return True

    def common_extension(self, a: tuple[np.ndarray, np.ndarray], i: int, b: tuple[np.ndarray, np.ndarray], j: int) -> int:
        """Code points that agree from a[i:] and b[j:] on, by binary search over equal spans."""
        low, high = 0, min(len(a[0]) - 1 - i, len(b[0]) - 1 - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same_span(a, i, b, j, mid) else (low, mid - 1)
        return low

    def fingerprint(self, text: str) -> tuple[str, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Hexadecimal digits, the sketch's bytes (0: no span in the class), and the prefix arrays."""
        first, second = arrays = self.both(text)
        if not text:
            return _FULL + "00" * SLOTS, np.zeros(SLOTS, np.uint8), arrays
        whole = int(first[-1]) % PRIME << 32 | int(second[-1]) % PRIME
        mixed = np.sort(self.spans(first, min(SPAN, len(text))) * _MIX)
        at = np.searchsorted(mixed, _TOPS)
        ends = np.append(at[1:], len(mixed))
        least = mixed[np.minimum(at, len(mixed) - 1)]
        sketch = np.where(at < ends, (least * _REMIX >> np.uint64(56)) % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8)
        return f"{whole:016x}{sketch.tobytes().hex()}", sketch, arrays


def likeness(a: str, sketch_a: np.ndarray, b: str, sketch_b: np.ndarray) -> float:
    """1 for equal fingerprints; else the share of classes in which both have the same byte."""
    if a == b:
        return 1.0
    used = (sketch_a | sketch_b) != 0
    n = int(used.sum())
    return float((used & (sketch_a == sketch_b)).sum() / n) if n else 0.0


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
_ROWS_OUT = 1000


class _Pairs:
    """Result rows of (document, next document) pairs; the next one's fingerprint is kept for its own turn."""

    def __init__(self) -> None:
        self.hash = PrefixHash()
        self.last: tuple[str, tuple] | None = None

    def _of(self, text: str) -> tuple:
        if self.last is None or self.last[0] is not text:
            self.last = text, self.hash.fingerprint(text)
        return self.last[1]

    def row(self, doc_id: int | None, text: str, after: str) -> tuple:
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        own, sketch, prefixes = self._of(text)
        other, other_sketch, other_prefixes = self.hash.fingerprint(edited)
        common = self.hash.common_extension(prefixes, 0, other_prefixes, 0)
        following, following_sketch, _ = self._of(after)
        return (
            doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other,
            likeness(own, sketch, other, other_sketch), likeness(own, sketch, following, following_sketch), common,
        )


def _table(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)] if rows else [pa.array([], t) for t in _TYPES]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The next document is the next row by descending doc_id (null ids last, equal ids by
    descending XXH64 of the text); after the last row comes the first.  Null texts count as empty:
    their fingerprint is all zeros, equal to that of any empty text.  Each input row gives one row.

    Rows are range-partitioned and sorted by that order, so a text meets its neighbour in its own
    task; a random number parts rows of one id and text, however many there are.  The first and last text of each partition are kept aside and met in a second,
    small step of two rows a partition.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.rand(11).alias("salt"))
    order = [F.desc_nulls_last("doc_id"), F.desc("hash"), F.asc("salt")]
    ordered = kept.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pairs, rows = TaskContext.get().partitionId(), _Pairs(), []
        held: tuple[int | None, str] | None = None

        def made(rows: list[tuple], edge: str | None, ids: list, texts: list) -> pa.RecordBatch:
            n = len(rows) or len(ids)
            columns = _table(rows) if rows else [pa.array(ids, pa.int64()), *[pa.nulls(n, t) for t in _TYPES[1:]]]
            extra = [pa.array([part] * n, pa.int64()), pa.array([edge] * n, pa.string()), pa.array(texts or [None] * n, pa.string())]
            return pa.RecordBatch.from_arrays(columns + extra, names=[*_NAMES, "part", "edge", "text"])

        for b in small_batches(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held is None:
                    yield made([], "first", [doc_id], [text])
                else:
                    rows.append(pairs.row(*held, text))
                held = doc_id, text
                if len(rows) >= _ROWS_OUT:
                    yield made(rows, None, [], [])
                    rows = []
        if rows:
            yield made(rows, None, [], [])
        if held is not None:
            yield made([], "last", [held[0]], [held[1]])

    done = materialize(ordered.mapInArrow(inside, _OUT + ", part long, edge string, text string"), "fingerprints")

    # Two rows a partition: the text after a partition's last row is the next partition's first.
    firsts = done.where("edge = 'first'").select("part", F.col("text").alias("after"))
    parts = firsts.select("part")
    nexts = parts.withColumn("next_part", F.lead("part").over(Window.orderBy("part")))
    nexts = nexts.withColumn("next_part", F.coalesce("next_part", F.min("part").over(Window.partitionBy())))
    open_rows = done.where("edge = 'last'").select("part", "doc_id", "text").join(nexts, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "after")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs()
        for b in batches:
            yield pa.RecordBatch.from_arrays(_table([pairs.row(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]), names=_NAMES)

    return done.where("edge is null").select(*_NAMES).unionByName(open_rows.mapInArrow(across, _OUT))
