"""Best-fit packing with certified numbers of sequences.

Documents become token ids, an end id is appended, and what is longer than a sequence is cut.
Pieces are dealt to partitions; each packs its pieces by best-fit decreasing and computes lower
bounds from dual-feasible functions.  A partition whose number of sequences equals its bound
is certified: no packing of its pieces has fewer, so it is not packed again.  A partition with
a gap gives the pieces of its unfilled sequences to an exchange with other such partitions,
and they are packed anew in fewer partitions.  The same bounds over the lengths of all pieces
certify the whole: when the sequences of all partitions are as few as that, nothing is
exchanged at all.  There is no number of rounds after which pieces are left as they are; the
exchange ends when all is certified, when one partition has packed what was left, or when an
exchange no longer saves a sequence.

Best fit on lengths up to the capacity needs a table of the open sequences by space left, so
a partition of n pieces costs n table steps, whatever their sizes.
"""

from __future__ import annotations

import contextlib
import functools
import logging
import os
import re
import threading
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, chunks, spelled, stable, words_of
from .common import materialize, small_batches
from .token_counts import byte_symbols

CAPACITY = 4096
END_ID = 1
#: Pieces that one partition packs; the exchange aims at this many in each partition.
PIECES = 40_000
#: Bytes of remembered chunks in a worker; then it starts anew.  Idle for RELEASE seconds, it forgets all.
TABLE_BYTES, RELEASE = 192 << 20, 2.0
#: Bytes of an entry, about; chunks of more than LONG characters are not remembered, so that this holds.
ENTRY, LONG = 170, 64
_LOG = logging.getLogger(__name__)


class ChunkIds(dict):
    """The ids of a chunk between white space, as little-endian 32-bit bytes, by the tokenizers library.

    Special strings, NFC, lower case and words come first, as the vocabulary file says; each new
    word then goes to the library's merge model.  A word is a chunk too, so one table holds both.
    """

    def __init__(self, vocabulary: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.merge = self.library.model.tokenize
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.find = regex.compile(PATTERN).findall
        self.symbols = byte_symbols()
        self.coded = [i.to_bytes(4, "little") for i in range(1 + max(self.library.get_vocab().values()))]
        self.bound(TABLE_BYTES)

    def bound(self, table_bytes: int) -> None:
        self.most = max(1, table_bytes // ENTRY)

    def _kept(self, chunk: str, coded: bytes) -> bytes:
        if len(chunk) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = coded
        return coded

    def _merged(self, word: str) -> bytes:
        return b"".join([self.coded[t.id] for t in self.merge(spelled(word, self.symbols))])

    def _word(self, word: str) -> bytes:
        if not stable(word):
            return self._merged(word)
        known = self.get(word)
        return self._kept(word, self._merged(word)) if known is None else known

    def __missing__(self, chunk: str) -> bytes:
        if "<" in chunk:
            out = []
            for k, part in enumerate(self.cut(chunk)):
                out += [self.coded[self.special[part]]] if k % 2 else map(self._merged, words_of(part, self.find))
            return self._kept(chunk, b"".join(out))
        words = words_of(chunk, self.find)
        if len(words) == 1 and words[0] == chunk:
            return self._kept(chunk, self._merged(chunk))
        return self._kept(chunk, b"".join(map(self._word, words)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, without an end id."""
        for text in texts:
            yield b"".join(map(self.__getitem__, chunks(text)))


@functools.lru_cache(1)
def _table(vocabulary: str) -> ChunkIds:
    return ChunkIds(vocabulary)


_waiting: list[threading.Timer] = []


@contextlib.contextmanager
def chunk_ids(vocabulary: str, table_bytes: int = TABLE_BYTES) -> Iterator[ChunkIds]:
    """The worker's table, kept from task to task and emptied where no task asks for it for a while."""
    while _waiting:
        _waiting.pop().cancel()
    known = _table(vocabulary)
    known.bound(table_bytes)
    try:
        yield known
    finally:
        timer = threading.Timer(RELEASE, known.clear)
        timer.daemon = True
        timer.start()
        _waiting.append(timer)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row; null texts count as empty."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        step = 4 * capacity
        with chunk_ids(vocabulary, table_bytes) as known:
            for b in small_batches(batches):
                out: list[tuple] = []
                ids = b.column(0).to_pylist()
                for doc_id, coded in zip(ids, known.encode(b.column(1).to_pylist()), strict=True):
                    coded += end
                    for k, at in enumerate(range(0, len(coded), step)):
                        part = coded[at : at + step]
                        out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.mapInArrow(made, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound of two families of dual-feasible functions: no packing has fewer bins.

    u_k takes x to floor((k + 1) x) / k unless (k + 1) x is whole, and f_e, for e up to half a
    bin, takes x above 1 - e to 1, x below e to 0 and leaves the rest.  Sums of either over all
    items bound the number of bins from below.
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """lower_bound of counts[x] items of each length x."""
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0
    n = counts[sizes]
    best = -(-int((sizes * n).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # in 1 / (k * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    every, weight = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    e = np.arange(1, capacity // 2 + 1)
    large = every[-1] - every[capacity - e]
    middle = weight[capacity - e] - weight[e - 1]
    return max(best, int((large + -(-middle // capacity)).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item its bin and its place in the bin; every item goes where least space stays.

    space[s] holds the open bins with s left; `open_` marks the s that have any, as bits of
    one number, so the best fit is the lowest bit at or above the length.
    """
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    space: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, n_bins = 0, 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        above = open_ >> need
        if above:
            left = need + (above & -above).bit_length() - 1
            b = space[left].pop()
            if not space[left]:
                open_ &= ~(1 << left)
        else:
            left, b = capacity, n_bins
            n_bins += 1
        bins[k], places[k] = b, capacity - left
        if left := left - need:
            space[left].append(b)
            open_ |= 1 << left
    return bins, places


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_COLUMNS = [c.split()[0] for c in _PACKED.split(", ")]
_INFO = ", goes boolean, bins long, bound long, leaving long"


def leaving(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Which bins of a partition give their items to an exchange, and the partition's bound.

    With more bins than the bound: all that are not full.  With as many as the bound the
    partition is certified and stays as it is, but for its emptiest bin: bounds of partitions
    round up, and what they round up by can only be won back where several partitions meet.
    """
    fill = np.bincount(bins, weights=lengths)
    bound = lower_bound(lengths, capacity)
    if len(fill) > bound:
        return fill < capacity, bound
    out = np.zeros(len(fill), bool)
    if len(fill):
        emptiest = int(fill.argmin())
        out[emptiest] = fill[emptiest] < capacity
    return out, bound


def pack_round(rows: DataFrame, parts: int, round_: int, capacity: int) -> DataFrame:
    """One best-fit run in each of `parts` partitions of pieces.

    goes: the piece's sequence would take part in an exchange.  bins, bound and leaving, on one
    row of each partition only: its number of sequences, a number that no packing of its pieces
    can go below, and how many sequences would take part.
    """

    def made(key: tuple, group: pa.Table) -> pa.Table:
        lengths = group["length"].to_numpy()
        bins, places = best_fit_decreasing(lengths, capacity)
        goes, bound = leaving(bins, lengths, capacity)
        head = np.arange(len(lengths)) == 0
        more = {
            "sequence_id": (round_ << 48) + (key[0].as_py() << 20) + bins,
            "offset": places,
            "goes": goes[bins],
            "bins": np.where(head, len(goes), 0),
            "bound": np.where(head, bound, 0),
            "leaving": np.where(head, goes.sum(), 0),
        }
        out = group.select(_PIECE)
        for name, values in more.items():
            out = out.append_column(name, pa.array(values))
        return out

    # Dealt by the rows' place in the written table, so that copies of a row spread too.
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_)), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(made, _PACKED + _INFO)


@dataclass(frozen=True)
class Packing:
    """Placed pieces, their number of sequences, the bound of all pieces, and the runs of best fit."""

    rows: DataFrame
    sequences: int
    bound: int
    rounds: int

    @property
    def certified(self) -> bool:
        return self.sequences == self.bound


def pack(rows: DataFrame, capacity: int = CAPACITY) -> Packing:
    """Places every piece (doc_id, piece, start, length, ids_crc32) in a sequence.

    Repeated rows are pieces of their own.  Lengths are 1 to capacity; the driver gets one count
    for each of them and three sums of each round.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r.length] = r["count"]
    bound, sequences = bound_of_counts(counts, capacity), int(counts[capacity])
    # A piece that fills a sequence needs no search.
    done = rows.where(F.col("length") == capacity).withColumn("sequence_id", F.bitwise_not(F.monotonically_increasing_id())).withColumn("offset", F.lit(0).cast("long")).select(*_COLUMNS)
    rest, left = rows.where(F.col("length") < capacity), int(counts[:capacity].sum())
    parts, round_, before = max(1, -(-left // PIECES)), 0, None
    while left:
        round_ += 1
        packed = materialize(pack_round(rest, parts, round_, capacity), "packed")
        told = packed.agg(F.sum("bins").alias("bins"), F.sum("bound").alias("bound"), F.sum("leaving").alias("leaving"), F.sum(F.col("goes").cast("long")).alias("left")).collect()[0]
        _LOG.info("round %d: %d partitions, %d sequences, their bounds %d, exchanged %d", round_, parts, told.bins, told.bound, told.leaving)
        saved = before is None or told.bins < before[1]
        if not saved:  # the arrangement before this exchange had no more sequences
            packed, told_bins = before
            done, sequences = done.unionByName(packed.select(*_COLUMNS)), sequences + told_bins
            break
        if sequences + told.bins == bound or parts == 1 or not told.left or told.leaving < 2:
            done, sequences = done.unionByName(packed.select(*_COLUMNS)), sequences + told.bins
            break
        done, sequences = done.unionByName(packed.where("not goes").select(*_COLUMNS)), sequences + told.bins - told.leaving
        going = packed.where("goes")
        before, rest, left = (going, told.leaving), going.select(*_PIECE), told.left
        parts = max(1, min(parts - 1, -(-left // PIECES)))
    _LOG.info("%d sequences, bound %d, gap %d after %d rounds", sequences, bound, sequences - bound, round_)
    return Packing(done, sequences, bound, round_)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    A null or empty text is its end id alone, one token.  Repeated rows and equal ids are
    packed one by one, null ids too; further columns are no matter; an empty table gives an
    empty one.
    """
    return pack(materialize(pieces(docs, vocabulary, capacity, table_bytes), "pieces"), capacity).rows
