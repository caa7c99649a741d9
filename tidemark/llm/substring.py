"""Substring dedup: words covered by a window of 50 words that a document with a smaller id has too.

A difference cover D modulo a period v holds, for any two places i and j, a shift k < v that
takes both into the cover: (i + k) mod v and (j + k) mod v are in D.  So two equal windows of
50 words share an aligned anchor, a run of 50 - v + 1 equal words that starts at cover places
of both texts.  The work runs in three steps, each linear in the words it touches:

1. hash anchors at cover places only (6 of 31 places).  An anchor counts as shared if it
   starts in two rows.  Anchors meet by hash range, once for each batch of rows, so a common
   passage weighs as much as the number of batches, not of its copies;
2. extend: the windows around anchors that may be shared are hashed to 96 bits, and the
   smallest doc_id of each is found.  "May be": the shared anchors go to all tasks as a bitmap of
   fixed size.  A bit that another anchor has set too only means that some more windows are hashed;
3. cut the covered words.

No group is gathered: smallest ids are partial aggregates, and hot keys are joined as a small
table whose size is bounded (`_lookup`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, with_row_key

WINDOW = 50
#: Period and difference cover: every residue is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: The bitmap of shared anchors has 2^28 bits, 32 MB in each worker.
FILTER_BITS = 28
#: Anchors that one range gathers, about; a text has one for every ANCHOR_BYTES bytes at least.
RANGE, ANCHOR_BYTES = 1 << 21, 16
#: A key is hot if it has more than this share of all rows, so there are at most 1 / HOT hot keys.
HOT = 1 / 2000
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Windows:
    """Hashes of runs of words, from prefix sums modulo 2^64 over the halves of XXH3-128 of the words."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64)] * 2
        self.down = [np.ones(1, np.uint64)] * 2

    def _powers(self, half: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up[half]) < n:
            k = len(self.up[half])
            for kept, base in ((self.up, _BASES[half]), (self.down, _INVERSES[half])):
                kept[half] = np.concatenate([kept[half], kept[half] * np.uint64(pow(base, k, 1 << 64))])
        return self.up[half][:n], self.down[half][:n]

    def words(self, words: list[bytes]) -> np.ndarray:
        """Both halves of the hash of each word."""
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)

    def prefixes(self, hashed: np.ndarray, half: int = 0) -> np.ndarray:
        out = np.zeros(len(hashed) + 1, np.uint64)
        np.cumsum(hashed[:, half] * self._powers(half, len(hashed))[0], out=out[1:])
        return out

    def runs(self, prefixes: np.ndarray, at: np.ndarray, length: int, half: int = 0) -> np.ndarray:
        """Hash of the run of that length at each place; equal runs have equal hashes wherever they lie."""
        return (prefixes[at + length] - prefixes[at]) * self._powers(half, len(prefixes))[1][at]


def _anchor_places(n_words: int) -> np.ndarray:
    places = np.arange(max(0, n_words - ANCHOR + 1)) if n_words >= WINDOW else np.arange(0)
    return places[_IN_COVER[places % PERIOD]]


def _pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values: differences, one byte plane after the other, compressed."""
    return zstandard.compress(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _shared_anchors(rows: DataFrame, bits: int) -> dict[int, bytes]:
    """The bitmap of the anchors that start in two rows, in compressed pieces by range of hashes.

    2^bits bits at most, whatever the input.  An anchor's hash has 48 bits; its first ones are
    its range and its place in the bitmap.
    """
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0].n
    range_bits = min(max(bits - 3, 3), max(6, (4 * wanted - 1).bit_length(), (size // ANCHOR_BYTES // RANGE).bit_length()))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for b in batches:
            for begin in range(0, b.num_rows, 1 << 15):
                found = []
                for k, text in enumerate(b.column(0).slice(begin, 1 << 15).cast(pa.binary()).to_pylist()):
                    words = text.split()
                    at = _anchor_places(len(words))
                    if len(at):
                        hashes = windows.runs(windows.prefixes(windows.words(words)), at, ANCHOR)
                        found.append((hashes & ~np.uint64(0xFFFF)) | np.uint64(k))
                if not found:
                    continue
                found = np.sort(np.concatenate(found))
                first = np.flatnonzero(np.diff(found >> np.uint64(16), prepend=np.uint64(1 << 63)))
                last = np.append(first[1:], len(found)) - 1
                # A hash, then 1 if two rows of this batch have it.
                entries = (found[first] >> np.uint64(16) << np.uint64(1)) | (found[first] != found[last]).astype(np.uint64)
                cuts = np.searchsorted(entries, np.arange(1 << range_bits, dtype=np.uint64) << np.uint64(49 - range_bits))
                ends = np.append(cuts[1:], len(entries))
                full = np.flatnonzero(cuts < ends)
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([_pack(entries[cuts[r] : ends[r]]) for r in full], pa.binary())], names=["range", "blob"])

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        entries = np.sort(np.concatenate([_unpack(x) for x in group["blob"]]))
        hashes = entries >> np.uint64(1)
        again = np.flatnonzero(hashes[1:] == hashes[:-1])
        shared = np.concatenate([hashes[again], hashes[(entries & np.uint64(1)) == 1]])
        field = np.zeros(1 << max(bits - range_bits, 3), bool)
        field[(shared >> np.uint64(48 - bits)) & np.uint64((1 << (bits - range_bits)) - 1)] = True
        return pd.DataFrame({"range": [key[0]], "field": [zstandard.compress(np.packbits(field).tobytes())]}) if len(shared) else pd.DataFrame({"range": np.array([], np.int32), "field": []})

    ranges = rows.select("text").mapInArrow(made, "range int, blob binary").groupBy("range").applyInPandas(meet, "range int, field binary")
    return {r["range"]: bytes(r["field"]) for r in ranges.collect()}  # 32 MB at most, and compressed


class Bitmap:
    """Which anchors may be shared."""

    def __init__(self, pieces: dict[int, bytes], bits: int) -> None:
        self.bits = bits
        self.field = np.zeros((1 << bits) // 8, np.uint8)
        if pieces:
            some = zstandard.decompress(next(iter(pieces.values())))
            for r, piece in pieces.items():
                self.field[r * len(some) : (r + 1) * len(some)] = np.frombuffer(zstandard.decompress(piece), np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.field[at >> np.uint64(3)] << (at & np.uint64(7)).astype(np.uint8)) & 128 != 0


def _lookup(rows: DataFrame, groups: DataFrame, hot_from: float) -> DataFrame:
    """rows with the `least` of their window, whatever the sizes of the groups.

    Groups of more than hot_from rows are few, 1 / HOT at most; they go to every task as a
    small table.  The other rows meet their group in a shuffle in which no key is large: rows
    that are done already are dealt at random.
    """
    hot = groups.where(F.col("n") > hot_from).select("h", "g", F.col("least").alias("hot_least"))
    rest = groups.where(F.col("n") <= hot_from).select(F.col("h").alias("key"), "g", "least")
    dealt = rows.join(F.broadcast(hot), ["h", "g"], "left").withColumn("key", F.when(F.col("hot_least").isNull(), F.col("h")).otherwise(F.xxhash64("doc_id", "place")))
    return dealt.join(rest, ["key", "g"], "left").select("doc_id", "text_hash", "place", F.coalesce("hot_least", "least").alias("least"))


def _windows(rows: DataFrame, shared: Broadcast, bits: int) -> DataFrame:
    """(h, g, doc_id, text_hash, place) of the windows around anchors that may be shared; h and g are the window's hash."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, bitmap = Windows(), Bitmap(shared.value, bits)
        for b in small_batches(batches):
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            hashes, others, places, of = [], [], [], []
            for k, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                words = text.split()
                anchors = _anchor_places(len(words))
                if not len(anchors):
                    continue
                hashed = windows.words(words)
                prefixes = windows.prefixes(hashed)
                anchors = anchors[bitmap.has(windows.runs(prefixes, anchors, ANCHOR))]
                if not len(anchors):
                    continue
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, np.maximum(anchors - PERIOD + 1, 0), 1)
                np.add.at(edge, anchors + 1, -1)
                at = np.flatnonzero(np.cumsum(edge[: len(words) - WINDOW + 1]))
                hashes.append(windows.runs(prefixes, at, WINDOW))
                others.append((windows.runs(windows.prefixes(hashed, 1), at, WINDOW, 1) >> np.uint64(32)).astype(np.uint32))
                places.append(at)
                of.append(np.full(len(at), k))
            if hashes:
                which = np.concatenate(of)
                columns = [np.concatenate(hashes).view(np.int64), np.concatenate(others).view(np.int32), ids[which], keys[which], np.concatenate(places).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "g", "doc_id", "text_hash", "place"])

    return rows.mapInArrow(made, "h long, g int, doc_id long, text_hash long, place int")


def repeated_windows(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, text_hash, starts: the windows of each row's text that start in a smaller doc_id too.

    Rows without any are left out.  Null ids are neither smaller nor larger than others.
    """
    rows = with_row_key(docs).where("doc_id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(_shared_anchors(rows, bits))
    windows = _windows(rows, shared, bits)
    groups = windows.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").select("h", "g", "least", "n")
    groups = materialize(groups, "windows")
    hot_from = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0].n * HOT
    later = _lookup(windows, groups, hot_from).where(F.col("doc_id") > F.col("least"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("starts"))


def _covered(n_words: int, starts: np.ndarray) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:n_words]) > 0


def _with_starts(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of the window starts to cut, under a name that docs has not."""
    name = "starts"
    while name in docs.columns:
        name += "_"
    found = repeated_windows(docs).select(F.col("doc_id").alias(f"{name}i"), F.col("text_hash").alias(f"{name}h"), F.col("starts").alias(name))
    same = (docs["doc_id"].cast("long") == found[f"{name}i"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found[f"{name}h"])
    return docs.join(found, same, "left").drop(f"{name}i", f"{name}h"), name


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    Null texts have no words.  Texts of fewer than 50 words, and rows with a null id, keep all
    their words; repeated rows and equal ids are judged alike, since only a smaller id counts.
    An empty table gives an empty one.
    """
    joined, starts = _with_starts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, sha = [], [], []
            for text, at in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                gone = 0
                if at.is_valid:
                    cut = _covered(len(words), at.values.to_numpy(zero_copy_only=False))
                    gone = int(cut.sum())
                    words = [words[k] for k in np.flatnonzero(~cut)]
                n_removed.append(gone)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.select("doc_id", "text", starts).mapInArrow(made, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_text(text: str, starts: np.ndarray) -> str:
    """The text without the covered words and the white space before each; the rest as it was."""
    data = text.encode("utf-8")
    spans = [m.span() for m in _WORD.finditer(data)]
    kept, at = [], 0
    for (begin, end), gone in zip(spans, _covered(len(spans), starts), strict=True):
        if not gone:
            kept.append(data[at:end])
        at = end
    return (b"".join(kept) + data[at:]).decode("utf-8").lstrip(" \t\n\r\x0b\x0c")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The same rows and columns; covered words are cut, texts without any stay as they are.

    n_chars, where there, is counted anew for changed texts.
    """
    joined, starts = _with_starts(docs)

    @F.pandas_udf("string")
    def cut(texts, places):
        return type(texts)([t if p is None else cut_text(t, np.asarray(p)) for t, p in zip(texts, places, strict=True)])

    text = F.when(F.col(starts).isNull(), F.col("text")).otherwise(cut("text", starts))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(starts).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


#: The same rows by brute force, for DuckDB.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50),
s AS (SELECT r, doc_id, k, md5(array_to_string(w[k:k+49], ' ')) AS h FROM p),
m AS (SELECT r, k, doc_id > min(doc_id) OVER (PARTITION BY h) AS later FROM s),
c AS (SELECT DISTINCT r, unnest(range(k, k + 50)) AS j FROM m WHERE later),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
g AS (SELECT x.r, count(*) AS n, string_agg(word, ' ' ORDER BY x.j) AS kept FROM x ANTI JOIN c ON x.r = c.r AND x.j = c.j GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""
