"""Token ids in training order: fixed-stride records at permuted slots.

Every sequence has a dense index, its place in the tokenised table.  A keyed Feistel network
permutes the smallest even-bit domain that holds all indices, and walks along its cycle until
the value is an index again, so it permutes 0 .. n-1 exactly.  The permuted index is the
sequence's slot.  Slots are dealt to range partitions; each holds whole shards in order, every
record takes the same number of bytes, and so a reader finds slot s at byte (s mod shard) *
stride of shard s // shard and can go on from any slot.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .packing import END_ID, chunk_ids

#: Tokens of a record, and records of a shard.
STRIDE, SHARD = 512, 4096
#: Bytes of records that one range partition holds, about.
PART_BYTES = 128 << 20
ROUNDS = 6


class Feistel:
    """A keyed permutation of 0 .. n-1."""

    def __init__(self, n: int, key: str) -> None:
        self.n = n
        self.half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        digest = hashlib.sha256(key.encode()).digest()
        self.keys = np.frombuffer(digest + hashlib.sha256(digest).digest(), "<u8")[:ROUNDS]

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._mixed(right, key)
        return left << self.half | right

    def __call__(self, index: np.ndarray) -> np.ndarray:
        out = self._once(np.asarray(index, np.uint64))
        while (beyond := out >= self.n).any():  # at most four domains' worth of steps on average
            out[beyond] = self._once(out[beyond])
        return out.astype(np.int64)


def tokenized(docs: DataFrame, vocabulary: str, stride: int) -> DataFrame:
    """part, row, doc_id, piece, length, ids (packed, without padding) of every sequence; null texts count as empty.

    A document is its ids and an end id, cut into pieces of `stride`.
    """
    names = ["part", "row", "doc_id", "piece", "length", "ids"]

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        with chunk_ids(vocabulary) as known:
            kind = _kind(known.library.get_vocab_size())
            for b in small_batches(batches):
                out = []
                for doc_id, coded in zip(b.column(0).to_pylist(), known.encode(b.column(1).to_pylist()), strict=True):
                    ids = np.append(np.frombuffer(coded, "<u4"), END_ID).astype(kind)
                    for k, at in enumerate(range(0, len(ids), stride)):
                        piece = ids[at : at + stride]
                        out.append((part, row, doc_id, k, len(piece), piece.tobytes()))
                        row += 1
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.mapInArrow(made, "part int, row long, doc_id long, piece int, length int, ids binary")


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def training_order(docs: DataFrame, vocabulary: str, key: str = "epoch-0", stride: int = STRIDE, shard: int = SHARD) -> DataFrame:
    """slot, shard, place, index, doc_id, piece, length, ids_crc32, record of every sequence, in slot order.

    `record` has the same number of bytes in every row: ids in 2 bytes each (4 for vocabularies
    of over 65536), little-endian, filled up with the end id; `length` ids are the sequence's
    own, and ids_crc32 is of the record.  A null or empty text is its end id alone.  Repeated
    rows and null ids are sequences like others; an empty table gives an empty one.
    """
    table = materialize(tokenized(docs, vocabulary, stride), "tokens")
    # One row for each input partition: where its sequences start.
    sizes = table.groupBy("part").agg((F.max("row") + 1).alias("n")).orderBy("part").collect()
    starts, n = [], 0
    for r in sizes:
        starts.append((r.part, n))
        n += r.n
    offsets = docs.sparkSession.createDataFrame(starts, "part int, first long")
    order = Feistel(n, key)

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(order(index.to_numpy()))

    @F.pandas_udf("record binary, ids_crc32 long")
    def padded(ids: pd.Series, length: pd.Series) -> pd.DataFrame:
        width = len(ids.iloc[0]) // int(length.iloc[0]) if len(ids) else 2
        fill = np.full(stride, END_ID, f"<u{width}").tobytes()
        records = [x + fill[len(x) :] for x in ids]
        return pd.DataFrame({"record": records, "ids_crc32": [zlib.crc32(x) for x in records]})

    placed = table.join(F.broadcast(offsets), "part").withColumn("index", F.col("first") + F.col("row"))
    placed = placed.withColumn("slot", slot_of("index")).withColumn("shard", F.floor(F.col("slot") / shard).cast("long"))
    shards = max(1, -(-n // shard))
    parts = min(shards, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * stride * 4 // PART_BYTES)))
    # Range partitions of whole shards: slots are uniform, so these are even without sampling.
    dealt = placed.repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int")).sortWithinPartitions("slot")
    filled = dealt.withColumn("filled", padded("ids", "length"))
    return filled.select("slot", "shard", (F.col("slot") % shard).cast("int").alias("place"), "index", "doc_id", "piece", "length", "filled.ids_crc32", "filled.record")


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Writes shard-<number>.bin files to a folder all machines share; returns shard, records, crc32 of each.

    A shard is written under a name of its own try and then renamed, so a repeated or doubled
    task leaves the same file, and one that is there whole is not written again: a run that was
    broken off goes on where it stopped.  The folder is a URI that pyarrow knows; a plain path
    serves local sessions only.
    """
    if "://" not in folder and not ordered.sparkSession.sparkContext.master.startswith("local["):
        raise ValueError(f"{folder}: shards go to a URI that all machines share")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
        where.create_dir(at, recursive=True)
        current, records = None, []

        def done() -> pa.RecordBatch:
            data, name = b"".join(records), f"{at}/shard-{current:08d}.bin"
            there = where.get_file_info(name)
            if there.type != pa.fs.FileType.File or there.size != len(data):
                trial = f"{name}.{TaskContext.get().taskAttemptId()}"
                with where.open_output_stream(trial) as f:
                    f.write(data)
                where.move(trial, name)
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([len(records)]), pa.array([zlib.crc32(data)])], names=["shard", "records", "crc32"])

        for b in batches:
            for shard, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if shard != current:
                    if records:
                        yield done()
                    current, records = shard, []
                records.append(record)
        if records:
            yield done()

    return ordered.select("shard", "record").mapInArrow(made, "shard long, records long, crc32 long")


def read_records(folder: str, slot: int, n: int, stride: int = STRIDE, shard: int = SHARD, width: int = 2) -> np.ndarray:
    """n records from a slot on, as a matrix of ids: what a resumed reader does."""
    where, at = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
    out = []
    while n > 0:
        name, place = f"{at}/shard-{slot // shard:08d}.bin", slot % shard
        take = min(n, shard - place)
        with where.open_input_file(name) as f:
            f.seek(place * stride * width)
            out.append(f.read(take * stride * width))
        slot, n = slot + take, n - take
    return np.frombuffer(b"".join(out), f"<u{width}").reshape(-1, stride)
