"""Phrase collocations by mergeable Misra-Gries summaries and an exact second count.

Words and phrases of a block of texts are numpy arrays of 64-bit hashes: a word's polynomial hash comes
from one running sum over the bytes, a phrase's from its prefix and its last word.  A task sorts
the hashes of some million occurrences and sends, for each range of hashes, a summary: distinct
hashes with their counts, packed into two binary values.  Where summaries of a range meet they are
added; when more counters than the capacity are left, the largest count beyond it is taken from all
(Misra-Gries).  Over a mass m a range keeps more than m / threshold - 1 counters, so less than the
threshold is ever taken from any count, and each phrase as frequent as the threshold survives.

Survivors of all ranges form a bitmap.  The second pass counts, as text and exactly, what the
bitmaps let through; hashes only choose what is counted.  Words come first, then pairs of frequent
words, then longer phrases all of whose pairs are frequent: others can't be.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import places
from .common import batch_of, discard, few, materialize, small_batches

#: Words of a phrase at most; occurrences that make it frequent; rows of the result for each lang.
WORDS, THRESHOLD, TOP = 5, 100, 2000
#: Bytes of text that are arrays at a time, and occurrences that a task summarises at a time.
BLOCK, OCCURRENCES = 1 << 20, 1 << 21
#: Counters that wait to be added, beside the capacity of their range.
PENDING = 1 << 20
#: Leading bits of a hash that summaries keep: two phrases with the same are counted as one there, so both survive.
KEY = 48
#: Bits of a bitmap at most: 32 MB.  A fuller one lets more through to the exact count, and no less.
BITS = 28

_LOWER = bytes(range(256)).lower()
_SEPARATOR = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_U = np.uint64
#: Two odd multipliers; their powers are the weights of a word's bytes.
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_NEXT = _U(0xC2B2AE3D27D4EB4F)


@lru_cache(2)
def _powers(k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    base = int(_BASES[k])
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, _U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Block:
    """The words of some texts: where they are, in which piece and text; data is lower case."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Block:
        data = b"\n".join(texts).lower()  # bytes: only A-Z change
        raw = np.frombuffer(data, np.uint8)
        kind = _CLASS[raw]
        edge = np.diff(np.concatenate([[0], (kind == 0).view(np.int8), [0]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        return cls(data, starts, ends, piece, text)

    def word_hashes(self, k: int, seeds: np.ndarray) -> np.ndarray:
        """Hashes of all words by the k-th base, with a seed for each text."""
        raw = np.frombuffer(self.data, np.uint8)
        size = 1 << max(20, len(raw).bit_length())
        power, inverse = _powers(k, size)
        total = np.zeros(len(raw) + 1, _U)
        np.cumsum((raw.astype(_U) + _U(1)) * power[: len(raw)], out=total[1:])
        return _mixed((total[self.ends] - total[self.starts]) * inverse[self.starts] ^ seeds[self.text])


@dataclass(frozen=True)
class Bitmap:
    """Which leading bits of a hash some survivor has."""

    bits: int
    data: bytes

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> _U(64 - self.bits)).astype(np.int64)
        return np.frombuffer(self.data, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def phrases_of(words: np.ndarray, piece: np.ndarray, longest: int, frequent: list[Bitmap]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n the hashes of the n words from each place on, and the places where they may be a frequent phrase.

    They are of one piece and, as far as the bitmaps of words and pairs are there, no word and no pair is rare.
    """
    fine = frequent[0].has(words) if frequent else np.ones(len(words), bool)
    hashes, every, pairs = words, fine, fine
    for n in range(1, min(longest, len(words)) + 1):
        if n > 1:
            hashes = _mixed(hashes[:-1] * _NEXT + words[n - 1 :])
        if n == 2:
            pairs = fine[:-1] & fine[1:] & (piece[:-1] == piece[1:])
            if len(frequent) > 1:
                pairs[pairs] = frequent[1].has(hashes[pairs])
            every = pairs
        elif n > 2:
            every = every[:-1] & pairs[n - 2 :]
        yield n, hashes, np.flatnonzero(every)


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at a separator, so that no phrase is cut."""
    begin = 0
    while len(text) - begin > BLOCK and (end := _SEPARATOR.search(text, begin + BLOCK)):
        yield text[begin : end.end()]
        begin = end.end()
    yield text[begin:]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list[str], np.ndarray]]:
    """Blocks of (lang, text) rows with the lang of each text and its seed."""
    texts: list[bytes] = []
    langs: list[str] = []
    size = 0

    def made() -> tuple[Block, list[str], np.ndarray]:
        return Block.of(texts), langs, np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in langs], _U)

    for b in small_batches(batches, 256):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            for part in _parts(text.as_py()):
                texts.append(part)
                langs.append(lang)
                size += len(part) + 1
                if size >= BLOCK:
                    yield made()
                    texts, langs, size = [], [], 0
    if texts:
        yield made()


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and how often each occurs."""
    hashes = np.sort(hashes)
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.diff(np.append(first, len(hashes)))


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counters with the same key become one."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class MisraGries:
    """Counters of one range whose mass is known: at most `capacity` of them, beside those that wait."""

    def __init__(self, mass: int, threshold: int, pending: int | None = None) -> None:
        self.capacity = mass // threshold + 1
        self.threshold, self.pending = threshold, PENDING if pending is None else pending
        self.keys, self.counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        self.waiting = self.taken = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > self.pending:
            self.reduce()

    def reduce(self) -> None:
        keys, counts = added(np.concatenate(self.keys), np.concatenate(self.counts))
        if len(keys) > self.capacity:
            # The largest count beyond the capacity, taken from capacity + 1 counters or more.
            cut = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            keys, counts = keys[counts > cut], counts[counts > cut] - cut
            self.taken += cut
        self.keys, self.counts, self.waiting = [keys], [counts], 0

    def survivors(self) -> np.ndarray:
        """Every key of at least `threshold` occurrences, and perhaps more."""
        self.reduce()
        assert self.taken < self.threshold
        return self.keys[0][self.counts[0] + self.taken >= self.threshold]


_SUMMARY = [("part", pa.int32()), ("kind", pa.int32()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("lang", pa.string())]
_MASS, _DATA, _LANG = 0, 1, 2
_SUMMARY_SCHEMA = "part int, kind int, mass long, keys binary, counts binary, lang string"


def _log2(x: float) -> int:
    return max(0, math.ceil(math.log2(max(1, x))))


def range_bits(mass: int) -> int:
    """Bits of a hash that name its range: a million occurrences a range, over 4096 ranges up to a billion."""
    return max(min(_log2(mass / 2**20), 12), _log2(mass / 2**30))


def packed_keys(keys: np.ndarray, start: int) -> bytes:
    """Keys in order as steps from one to the next, in four bytes each if they fit."""
    steps = np.diff(keys, prepend=_U(start))
    return steps.astype("<u4" if steps.max() < 1 << 32 else "<u8").tobytes()


def packed_counts(counts: np.ndarray) -> bytes:
    return counts.astype("<u1" if counts.max() < 256 else "<u4").tobytes()


def unpacked(keys: bytes, counts: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    """What packed_keys and packed_counts packed; a width is told by the number of keys, which both have."""
    for key, count in (("<u4", "<u1"), ("<u4", "<u4"), ("<u8", "<u1"), ("<u8", "<u4")):
        if len(keys) * np.dtype(count).itemsize == len(counts) * np.dtype(key).itemsize:
            n = np.frombuffer(counts, count).astype(np.int64)
            return np.cumsum(np.frombuffer(keys, key).astype(_U), dtype=_U) + _U(start), n
    raise ValueError("keys and counts don't belong together")


def summaries(docs: DataFrame, lengths: range, bits: int, frequent: list[Broadcast]) -> DataFrame:
    """Summaries of phrases of these lengths by range of hash; with the mass of each, and words of each lang."""

    def packed(hashes: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = counted(np.concatenate(hashes) >> _U(64 - KEY))
        part = (keys >> _U(KEY - bits)).astype(np.int64)
        at = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(keys)) if len(keys) else [0]
        rows = [(int(part[a]), counts[a:b], keys[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        mass = [(p, _MASS, int(c.sum()), None, None, None) for p, c, _ in rows]
        data = [(p, _DATA, None, packed_keys(k, p << (KEY - bits)), packed_counts(c), None) for p, c, k in rows]
        return batch_of(_SUMMARY, *(zip(*mass, *data, strict=True) if rows else [[]] * len(_SUMMARY)))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b.value for b in frequent]
        hashes, held, totals = [np.zeros(0, _U)], 0, {}
        for block, langs, seeds in blocks(batches):
            for k, n in zip(*np.unique(block.text, return_counts=True), strict=True):
                totals[langs[k]] = totals.get(langs[k], 0) + int(n)
            for n, found, at in phrases_of(block.word_hashes(0, seeds), block.piece, lengths[-1], kept):
                if n in lengths:
                    hashes.append(found[at])
                    held += len(at)
            if held >= OCCURRENCES:
                yield packed(hashes)
                hashes, held = [np.zeros(0, _U)], 0
        yield packed(hashes)
        yield batch_of(_SUMMARY, *zip(*[(-1, _LANG, n, None, None, lang) for lang, n in totals.items()], strict=True)) if totals else batch_of(_SUMMARY, *[[]] * len(_SUMMARY))

    return docs.mapInArrow(made, _SUMMARY_SCHEMA)


def survivors(told: DataFrame, bits: int, threshold: int, mass: int) -> Bitmap:
    """The bitmap of all hashes that may be frequent, from the summaries of `bits` bits of range.

    Each range is merged in one task, in which its masses come before its counters; ranges are of
    about equal mass, for a phrase that holds a third of all is one counter of each summary.
    """
    size = min(BITS, max(bits + 3, 16, _log2(16 * mass / threshold)))

    def chunk(part: int, merged: MisraGries) -> pa.RecordBatch:
        out = np.zeros(1 << (size - bits), np.uint8)
        out[(merged.survivors() >> _U(KEY - size)).astype(np.int64) - (part << (size - bits))] = 1
        return batch_of([("part", pa.int32()), ("bitmap", pa.binary())], [part], [np.packbits(out, bitorder="little").tobytes()])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mass, merged = None, 0, None
        for b in batches:
            for part, kind, m, keys, counts, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != at:
                    if merged:
                        yield chunk(at, merged)
                    at, mass, merged = part, 0, None
                if kind == _MASS:
                    mass += m
                else:
                    merged = merged or MisraGries(mass, threshold)
                    merged.add(*unpacked(keys, counts, part << (KEY - bits)))
        if merged:
            yield chunk(at, merged)

    dealt = told.where(F.col("kind") < _LANG).repartition(1 << bits, "part").sortWithinPartitions("part", "kind")
    width = 1 << (size - bits - 3)
    data = bytearray(width << bits)
    for r in dealt.mapInArrow(made, "part int, bitmap binary").collect():  # 32 MB at most in all
        data[r.part * width : (r.part + 1) * width] = r.bitmap
    return Bitmap(size, bytes(data))


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct pair of hashes, of 128 bits together, and how often it occurs."""
    if not len(one):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(one)
    new = np.concatenate([[True], one[order[1:]] != one[order[:-1]]])
    if ((two[order[1:]] != two[order[:-1]]) & ~new[1:]).any():  # two phrases with one hash
        order = np.lexsort((two, one))
        new = np.concatenate([[True], (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def exact_counts(docs: DataFrame, words: Broadcast, pairs: Broadcast, longer: Broadcast, longest: int, threshold: int, bits: int) -> DataFrame:
    """lang, words, phrase, f: exact counts of all phrases of 1 to `longest` words that the bitmaps let through, if `threshold` or more.

    A task's counts go out in 2^bits rows, by hash of the phrase; a range is added up in one task.
    """
    lists = [("part", pa.int32()), ("lang", pa.list_(pa.string())), ("words", pa.list_(pa.int32())), ("phrase", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))]
    kinds = [("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())]

    def dealt(seen: dict) -> pa.RecordBatch:
        by_part: dict[int, list] = {}
        for (lang, n, p), c in seen.items():
            by_part.setdefault(xxhash.xxh64_intdigest(p, 11) >> (64 - bits), []).append((lang, n, p.decode(), c))
        return batch_of(lists, list(by_part), *([[r[k] for r in rows] for rows in by_part.values()] for k in range(4)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, bytes], int] = {}
        kept = [words.value, pairs.value]
        for block, langs, seeds in blocks(batches):
            second = phrases_of(block.word_hashes(1, seeds), block.piece, longest, [])
            for (n, one, at), (_, two, _) in zip(phrases_of(block.word_hashes(0, seeds), block.piece, longest, kept), second, strict=True):
                if n > 2:
                    at = at[longer.value.has(one[at])]
                which, often = distinct(one[at], two[at])
                for a, c in zip(at[which].tolist(), often.tolist(), strict=True):
                    key = (langs[block.text[a]], n, b" ".join(block.data[block.starts[a] : block.ends[a + n - 1]].split()))
                    seen[key] = seen.get(key, 0) + c
            if len(seen) > PENDING // 4:
                yield dealt(seen)
                seen = {}
        yield dealt(seen)

    def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, {}

        def told() -> pa.RecordBatch:
            return batch_of(kinds, *(zip(*[(*k, f) for k, f in seen.items() if f >= threshold], strict=True) if any(f >= threshold for f in seen.values()) else [[]] * 4))

        for b in batches:
            for part, *columns in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != at:
                    yield told()
                    at, seen = part, {}
                for lang, n, phrase, c in zip(*columns, strict=True):
                    key = lang, n, phrase
                    seen[key] = seen.get(key, 0) + c
        yield told()

    parts = docs.mapInArrow(counts, "part int, lang array<string>, words array<int>, phrase array<string>, n array<long>")
    return parts.repartition(1 << bits, "part").sortWithinPartitions("part").mapInArrow(added_up, "lang string, words int, phrase string, f long")


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, longest: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases with f >= threshold, and (lang, n) of all langs, as written tables."""
    docs = texts_of(docs)
    context = docs.sparkSession.sparkContext
    # Only to choose the number of ranges; capacities come from exact masses.
    guess = (docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0) // 4
    told = materialize(summaries(docs, range(1, 2), range_bits(guess), []), "word_summaries")
    totals = materialize(told.where(F.col("kind") == _LANG).groupBy("lang").agg(F.sum("mass").alias("n")), "lang_words")
    n = totals.agg(F.sum("n")).collect()[0][0] or 0
    bitmaps = [context.broadcast(survivors(told, range_bits(guess), threshold, n))]
    discard(told)
    for lengths in (range(2, 3), range(3, longest + 1)):
        mass = len(lengths) * n
        bitmaps.append(context.broadcast(survivors(summaries(docs, lengths, range_bits(mass), bitmaps), range_bits(mass), threshold, mass)))
    return materialize(exact_counts(docs, *bitmaps, longest, threshold, range_bits(n)), "phrases"), totals


def _exact(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)")


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if few(df) else df


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, n, score of phrases of two words or more: the cut of the lowest score.

    Products are decimals of 38 digits, so the quotient is exact.
    """
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("f"))
    cut = phrases.where(F.col("words") > 1).select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"), F.split("phrase", " ").alias("w"))
    cut = cut.withColumns({"first": F.array_join(F.slice("w", 1, F.col("k")), " "), "rest": F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ")}).drop("w")
    cut = cut.join(_sent(known).withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"]).join(_sent(known).withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    cut = cut.join(_sent(totals), "lang").withColumns({"up": _exact("a") * 1000 * _exact("n"), "down": _exact("l") * _exact("r")})
    lowest = F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("cut")
    return cut.groupBy("lang", "words", "phrase", "a", "n").agg(lowest).select("lang", "words", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")


def without_contained(phrases: DataFrame, candidates: DataFrame, share: int = 100) -> DataFrame:
    """Candidates that lie in no longer phrase of at least `share` hundredths of their occurrences."""
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    long = phrases.where(F.col("words") > 2).select("lang", "words", "f", F.split("phrase", " ").alias("w")).select("lang", "f", F.explode(inner).alias("phrase"))
    most = long.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each lang.

    Null texts are empty and a null lang is `und`; ids play no part, so repeated rows and null ids count each
    time; further columns are no matter; an empty table gives an empty result.  Ties of score go to the larger
    count, then to the phrase that is smaller in bytes.
    """
    phrases, totals = frequent_phrases(docs, threshold, longest)
    candidates = materialize(without_contained(phrases, scored(phrases, totals)), "collocations")
    discard(phrases, totals)
    best = places(candidates, "score", [F.desc("a"), F.col("phrase")], "rank", by=["lang"], upto=top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase FROM w, range(1, 6) r(m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f AS a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS s FROM f WHERE m > 1),
s AS (SELECT c.lang, c.m, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(s[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(s[k + 1 : c.m], ' ') JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND q.m > b.m AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * q.f >= 100 * b.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""
