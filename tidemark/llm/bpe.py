"""BPE encoding and decoding over a contiguous array of part boundaries and ranks.

A word is a short array of boundaries with, beside each, the rank of the pair that starts
there.  The smallest rank is found by a scan, its boundary deleted and the two neighbouring
ranks refreshed.  That suits short words; longer ones, of over SHORT symbols, are merged over a
heap and a linked list instead, with the same parts as result.  White space never lies inside a token of this vocabulary, so a text is cut
at white space and each distinct chunk is encoded once per worker, in a table of bounded size.

The words that are new in some texts are merged together: a row of parts and a row of ranks for each
word, and every step takes the smallest rank of every row at once.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, batch_of, small_batches
from .token_counts import byte_symbols, merged_parts

#: Fixed value: the pattern of the vocabulary with word ends.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: str.split takes \x1c-\x1f for white space too; texts that hold one are cut by this instead.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Bytes of the chunks that a worker remembers.
TABLE_BYTES = 160 << 20
#: Symbols of the longest word that is merged by scans of its ranks; longer ones would take quadratic time.
SHORT = 256
#: Characters of the texts whose new words are merged together; a longer text stands alone.
TOGETHER = 1 << 20
#: Chunks that are made together, and symbols of the words whose rows are merged together, at most.
CHUNKS, CELLS = 1 << 16, 1 << 20
#: Bytes that a new chunk takes in the table, about.
NEW_BYTES = 450
_NONE = 1 << 60
_NO_RANK = np.iinfo(np.int32).max
#: Symbols of the widest row of words that are merged together, from one group of words to the next.
_WIDTHS = (0, 6, 8, 10, 12, 16, 24, 32, 64, 128, SHORT)


def chunks(text: str) -> list[str]:
    if any(c in text for c in _SEPARATORS):
        return [c for c in _SPACE.split(text) if c]
    return text.split()


def words_of(part: str, find: Callable[[str], list[str]]) -> list[str]:
    """Words of a text without special strings: NFC, lower case letter by letter, the pattern."""
    if part.isascii():
        lower = part.lower()
        return [lower] if part.isalpha() else find(lower)
    return find(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())


def stable(word: str) -> bool:
    """Whether a word of words_of() is the same where it is a chunk by itself; lower case may undo NFC."""
    return word.isascii() or (unicodedata.is_normalized("NFC", word) and word.lower() == word)


def spelled(word: str, symbols: list[str]) -> str:
    """One symbol for each byte; printable ASCII stands for itself."""
    return word if word.isascii() and word.isprintable() else "".join([symbols[b] for b in word.encode("utf-8")])


def _stretches(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of stretches of an array, one stretch after another."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class WordBpe:
    """Encoder and decoder of a vocabulary file with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.ids = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.symbols = byte_symbols()
        self.find = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        # Parts as numbers, for words that are merged together; what has no id, and the end of a row, is `absent`.
        self.absent = max(self.tokens) + 1
        pair_keys = np.array([self._key(self.ids[a], self.ids[b]) for a, b in pairs], np.int64)
        self.pair_rank = np.append(np.argsort(pair_keys), _NO_RANK).astype(np.int32)
        self.pair_keys = np.append(np.sort(pair_keys), np.iinfo(np.int64).max)
        self.merged = np.array([self.ids[a + b] for a, b in pairs], np.int32)
        self.inner, self.last = (
            np.array([self.ids.get(x + end, self.absent) for x in self.symbols], np.int32) for end in ("", self.end)
        )

    def _key(self, left, right):
        return left * (self.absent + 1) + right

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left.astype(np.int64), right)
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], np.int32(_NO_RANK))

    def _merge_rows(self, parts: np.ndarray) -> np.ndarray:
        """Rows of parts after all merges, leftmost smallest rank first; the last column must be absent."""
        out = np.full_like(parts, self.absent)
        rows, ranks = np.arange(len(parts)), self._ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            k = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), k]
            more = least != _NO_RANK
            out[rows[~more], : parts.shape[1]] = parts[~more]
            rows, parts, ranks, k, least = (x[more] for x in (rows, parts, ranks, k, least))
            column, n = np.arange(parts.shape[1] - 1), np.arange(len(rows))
            parts = np.take_along_axis(parts, column + (column > k[:, None]), 1)
            ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= k[:, None]), 1)
            parts[n, k] = self.merged[least]
            ranks[n, k] = self._ranks(parts[n, k], parts[n, k + 1])
            n, k = n[k > 0], k[k > 0]
            ranks[n, k - 1] = self._ranks(parts[n, k - 1], parts[n, k])
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and the ids of all of them one after another."""
        spelt = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        order = np.argsort(sizes, kind="stable")
        n, ids = np.zeros(len(words), np.int64), [np.zeros(0, np.int32)]
        group = itertools.pairwise(np.searchsorted(sizes[order], _WIDTHS, "right").tolist())
        for width, (low, high) in zip(_WIDTHS[1:], group, strict=True):
            for begin in range(low, high, CELLS // width):
                these = order[begin : min(high, begin + CELLS // width)]
                size = sizes[these]
                symbols = np.frombuffer(b"".join([spelt[k] for k in these.tolist()]), np.uint8)
                parts = np.full((len(these), size[-1] + 1), self.absent, np.int32)
                parts[np.arange(size[-1] + 1) < size[:, None]] = self.inner[symbols]
                parts[np.arange(len(these)), size - 1] = self.last[symbols[np.cumsum(size) - 1]]
                parts = self._merge_rows(parts)
                there = parts != self.absent
                n[these] = there.sum(1)
                ids.append(parts[there])
        for k in order[np.searchsorted(sizes[order], SHORT, "right") :].tolist():
            ids.append(np.array(self.word_ids(words[k]), np.int32))
            n[k] = len(ids[-1])
        begins = np.zeros_like(n)
        begins[order] = np.cumsum(n[order]) - n[order]
        return n, np.concatenate(ids)[_stretches(begins, n)]

    def word(self, word: str) -> list[str]:
        """Parts of one word, after its merges."""
        rank, shown = self.rank.get, spelled(word, self.symbols)
        n = len(shown)
        if n > SHORT:
            return merged_parts([*shown[:-1], shown[-1] + self.end], self.rank)
        shown += self.end
        bounds = [*range(n), len(shown)]
        ranks = [rank((shown[k], shown[k + 1]), _NONE) for k in range(n - 2)]
        if n > 1:
            ranks.append(rank((shown[n - 2], shown[n - 1 :]), _NONE))
        while ranks and (least := min(ranks)) != _NONE:
            k = ranks.index(least)
            del bounds[k + 1], ranks[k]
            merged = shown[bounds[k] : bounds[k + 1]]
            if k < len(ranks):
                ranks[k] = rank((merged, shown[bounds[k + 1] : bounds[k + 2]]), _NONE)
            if k:
                ranks[k - 1] = rank((shown[bounds[k - 1] : bounds[k]], merged), _NONE)
        return [shown[x:y] for x, y in itertools.pairwise(bounds)]

    def word_ids(self, word: str) -> list[int]:
        return [i for p in self.word(word) if (i := self.ids.get(p)) is not None]

    def encode(self, text: str) -> list[int]:
        """Ids of any text: special strings first, then NFC, lower case letter by letter, words, merges."""
        out: list[int] = []
        for k, piece in enumerate(self.cut.split(text) if any(c in text for c in self.special) else [text]):
            if k % 2:
                out.append(self.special[piece])
                continue
            for word in words_of(piece, self.find):
                out += self.word_ids(word)
        return out

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space: the file names no decoder."""
        return " ".join([t for i in ids if (t := self.tokens.get(i)) is not None])


@functools.lru_cache(1)
def _coder(vocabulary: str) -> WordBpe:
    """A worker reads the file once."""
    return WordBpe(vocabulary)


class _Chunks(Remembered):
    """chunk -> (number of ids, ids as text, tokens as text); both texts end with a space.

    A word is a chunk too, so the words of a chunk are looked up in the same table.
    """

    def __init__(self, bpe: WordBpe) -> None:
        super().__init__(TABLE_BYTES)
        self.bpe = bpe
        self.find_lines = regex.compile(PATTERN + r"|\n").findall
        # An id as text and its token, each with a space; `absent` ends a chunk.
        ids = range(bpe.absent)
        self.shown = [*[f"{i} " for i in ids], "\n"], [*[bpe.tokens.get(i, "") + " " for i in ids], "\n"]

    def learn(self, texts: list[list[str]]) -> None:
        """Makes the chunks of these texts that are not known yet, all their words together."""
        new = set(itertools.filterfalse(self.__contains__, itertools.chain.from_iterable(texts)))
        if self.held + len(new) * NEW_BYTES > self.most:
            self.clear()  # now, rather than amid the words that are about to be used
            self.held, new = 0, set(itertools.chain.from_iterable(texts))
        cut = [c for c in new if len(c) <= self.LONG]
        if self.bpe.cut.search("\n".join(cut)):
            cut = [c for c in cut if not self.bpe.cut.search(c)]
        for begin in range(0, len(cut), CHUNKS):
            self._learn(cut[begin : begin + CHUNKS])

    def _learn(self, cut: list[str]) -> None:
        found = words_of("\n".join(cut) + "\n", self.find_lines)
        words = list(dict.fromkeys(["\n", *found]))
        numbers = dict(zip(words, itertools.count()))
        at = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
        n, ids = self.bpe.words(words[1:])
        n, ids = np.append(1, n), np.append(np.int32(self.bpe.absent), ids)
        ids = ids[_stretches((np.cumsum(n) - n)[at], n[at])]
        counts = np.diff(np.flatnonzero(ids == self.bpe.absent), prepend=-1) - 1
        shown, tokens = ("".join(map(x.__getitem__, ids.tolist())).split("\n")[:-1] for x in self.shown)
        size = len(cut) * self.SLOT + sum(map(sys.getsizeof, itertools.chain(cut, shown, tokens)))
        if self.held + size <= self.most:  # what finds no room is made one by one
            self.update(zip(cut, zip(counts.tolist(), shown, tokens, strict=True), strict=True))
            self.held += size

    def _kept(self, chunk: str, made: tuple[int, str, str]) -> tuple[int, str, str]:
        return self.keep(chunk, made, *made[1:])

    def _made(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), "".join([f"{i} " for i in ids]), self.bpe.decode(ids) + " " * bool(ids)

    def _word(self, word: str) -> tuple[int, str, str]:
        if not stable(word):
            return self._made(self.bpe.word_ids(word))
        known = self.get(word)
        return self._kept(word, self._made(self.bpe.word_ids(word))) if known is None else known

    def __missing__(self, chunk: str) -> tuple[int, str, str]:
        if any(c in chunk for c in self.bpe.special):
            return self._kept(chunk, self._made(self.bpe.encode(chunk)))
        words = words_of(chunk, self.bpe.find)
        if len(words) == 1:
            made = self._made(self.bpe.word_ids(chunk)) if words[0] == chunk else self._word(words[0])
        else:
            n, ids, tokens = zip(*map(self._word, words), strict=True) if words else ((), (), ())
            made = sum(n), "".join(ids), "".join(tokens)
        return self._kept(chunk, made)


def learnt(texts: list[str], known: _Chunks) -> Iterator[list[str]]:
    """Chunks of each text, after the table has learnt those of about TOGETHER characters of texts."""
    begin, size = 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= TOGETHER or end == len(texts):
            cut = [chunks(t) for t in texts[begin:end]]
            known.learn(cut)
            yield from cut
            begin, size = end, 0


_DIGEST = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def encode_and_decode(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; with keep_ids also ids, decoded.

    Null texts count as empty: no ids, and the digests of the empty string.  Each input row
    gives one row, whatever its id or further columns; an empty table gives an empty one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Chunks(_coder(vocabulary))
        sha = hashlib.sha256
        for b in small_batches(batches):
            n, ids_sha, text_sha, ids, texts = [], [], [], [], []
            for cut in learnt(b.column(1).to_pylist(), known):
                parts = list(map(known.__getitem__, cut))
                shown = "".join([p[1] for p in parts])[:-1]
                decoded = "".join([p[2] for p in parts])[:-1]
                n.append(sum([p[0] for p in parts]))
                ids_sha.append(sha(shown.encode()).hexdigest())
                text_sha.append(sha(decoded.encode()).hexdigest())
                if keep_ids:
                    ids.append(list(map(int, shown.split())))
                    texts.append(decoded)
            out = [b.column(0), *batch_of(_DIGEST, n, ids_sha, text_sha).columns]
            names = ["doc_id", *[x for x, _ in _DIGEST]]
            if keep_ids:
                out += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kept = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return kept.mapInArrow(rows, schema + ", ids array<int>, decoded string" * keep_ids)
