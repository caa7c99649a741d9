"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh

#: White space that ends a word: [\x20\x09-\x0D].  bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of ids and hashes, of some 32 bytes each, that may be sent to every task.
BROADCAST_ROWS = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; lost executors cannot take it away."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing still to be run reads."""
    for table in tables:
        at = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop(table))
        at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def with_row_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text; rows equal in both are the same row twice."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that few texts are Python strings at a time."""
    for b in batches:
        for begin in range(0, b.num_rows, rows):
            yield b.slice(begin, rows)
    pa.default_memory_pool().release_unused()  # the worker waits for its next task without these pages


def slices(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about `size` bytes that end at white space, so that few of its words exist at a time."""
    begin = 0
    while len(text) - begin > size:
        end = begin + size
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[begin:end]
        begin = end
    yield text[begin:]


class Remembered(dict):
    """A worker's table of what it has made of its words, bounded in bytes; a full one starts anew.

    Words of over LONG characters are not kept: they hardly come again, and what is made of them is large.
    """

    LONG = 64
    #: Bytes of a slot of the table and of a tuple or number, about.
    SLOT = 180

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.held = most, 0

    def keep(self, word: str, made, *parts: str):
        """Remembers `made`, of which `parts` are the strings, and returns it."""
        if len(word) <= self.LONG:
            size = self.SLOT + sys.getsizeof(word) + sum(map(sys.getsizeof, parts))
            if self.held + size > self.most:
                self.clear()
                self.held = 0
            self[word] = made
            self.held += size
        return made


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table of ids and hashes has at most so many rows: then it may go to every task."""
    return df.count() <= rows


def beside(big: DataFrame, small: DataFrame, on, how: str) -> DataFrame:
    """big joined with a written table of ids; big is not shuffled while that table is small."""
    return big.join(F.broadcast(small) if few(small) else small, on, how)


def batch_of(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    """A record batch of lists, arrays or Arrow arrays in the order of the schema."""
    made = [c if isinstance(c, pa.Array) else pa.array(c, type=kind) for c, (_, kind) in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=[name for name, _ in schema])
