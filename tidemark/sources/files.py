"""Scans with declared schemas and sinks that never overwrite."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.parse import RAW_COLUMNS

RAW_SCHEMA = ", ".join(f"{c} string" for c in RAW_COLUMNS)
#: Fixed value: the sixteen columns of an experiment file.
EXPERIMENT_SCHEMA = ", ".join([*(f"f{k} string" for k in range(12)), "treatment string", "conversion string", "visit string", "exposure string"])


def scan_strict_csv(spark: SparkSession, path: str, schema: str = RAW_SCHEMA, line_separator: str | None = None) -> DataFrame:
    """All-string CSV: the header must be the schema's names, any bad record is an error, empty stays ''.

    Quoted fields may span lines.  Column pruning is off for this read, so that FAILFAST sees
    every field of every record.
    """
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True)
    reader = reader.option("emptyValue", "").option("columnPruning", False).option("escape", '"')
    rows = (reader.option("lineSep", line_separator) if line_separator else reader).csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])  # an empty field is no null


def scan_rct_csv(spark: SparkSession, path: str) -> DataFrame:
    """The experiment file, every field of it seen."""
    return scan_strict_csv(spark, path, EXPERIMENT_SCHEMA)


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_parquet_list(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """Exactly these files, each of exactly this schema (nullability aside)."""
    named = lambda s: [(f.name, f.dataType.simpleString()) for f in s]
    for p in paths:
        if named(spark.read.parquet(p).schema) != named(schema):
            raise ValueError(f"{p}: schema differs from the declared one")
    return spark.read.schema(schema).parquet(*paths)


def scan_union_periods(sources: list[DataFrame], columns: list[str], date: str, first: str, before: str) -> DataFrame:
    """Several periods' tables as one; columns and dates are chosen within each branch, so they reach its scan."""
    parts = [s.where((F.col(date) >= F.lit(first)) & (F.col(date) < F.lit(before))).select(*columns) for s in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_delimited_members(spark: SparkSession, path: str, schema: str = "ordinal long, row_id string, treatment int, split string") -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").csv(path)


def literal_relation(spark: SparkSession, rows: list[tuple], schema: str, most: int = 10_000) -> DataFrame:
    """Parameters as a table; refuses what is too large to be one."""
    if len(rows) > most:
        raise ValueError(f"{len(rows)} rows are no parameters")
    return F.broadcast(spark.createDataFrame(rows, schema))


def sink_parquet_exclusive(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes once, never over anything, and reads back with the same schema."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sink_identity_value_split(cohort: DataFrame, folder: str) -> tuple[str, str]:
    """Two tables: key with identity, key with values but no user; sorted by key within files."""
    identity, values = f"{folder}/identity", f"{folder}/values"
    ordered = cohort.sortWithinPartitions("cohort_key")
    ordered.select("cohort_key", "scope_id", "user_id").write.mode("errorifexists").option("compression", "zstd").parquet(identity)
    ordered.drop("scope_id", "user_id").write.mode("errorifexists").option("compression", "zstd").parquet(values)
    return identity, values


def sink_report_csv(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small aggregate as one CSV file; arrays, structs and maps become JSON."""
    shown = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    if shown.limit(most + 1).count() > most:
        raise ValueError(f"a report has at most {most} rows")
    shown.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def bounded_fetch(df: DataFrame, most: int) -> list[Row]:
    """All rows, or an error if there are more than `most`: never a part."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def stream_fetch(df: DataFrame) -> Iterator[Row]:
    """Rows of a bounded aggregate one partition at a time."""
    return df.toLocalIterator()


#: Modulus and the two bases of the digests of files; any fixed values will do, as long as they stay.
PRIME, BASES = (1 << 61) - 1, (1_000_000_007 * 998_244_353, 1_000_000_009 * 754_974_721)
#: Names that the readers of text unpack; such a file is read as it lies, by one task, and has at most 2 GB.
_PACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst|zstd)$"
_RANGE = "file string, begin long, bytes long, h0 long, h1 long, step0 long, step1 long"


class _Fold:
    """Lines of one range of a file, folded in their order; ranges fold together in the same way."""

    def __init__(self, file: str, begin: int) -> None:
        self.file, self.begin, self.bytes, self.lines, self.held = file, begin, 0, 0, [0, 0]

    def add(self, line: bytes) -> None:
        told = hashlib.sha256(line).hexdigest()
        self.held = [(h * b + int(told[15 * k : 15 * k + 15], 16)) % PRIME for k, (h, b) in enumerate(zip(self.held, BASES, strict=True))]
        self.bytes += len(line) + 1
        self.lines += 1

    def row(self) -> tuple:
        return self.file, self.begin, self.bytes, *self.held, *(pow(b, self.lines, PRIME) for b in BASES)


def _lines_of(content: bytes) -> Iterator[bytes]:
    """Lines as a reader of text gives them: a leading byte order mark and the last line's end are left out."""
    at = 3 if content.startswith(b"\xef\xbb\xbf") else 0
    while at < len(content):
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        yield content[at:end]
        at = end + 1


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range, whose lines follow one another in the batches of its task."""
    fold = None
    rows = []
    for b in batches:
        for file, begin, line, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if fold is None or (fold.file, fold.begin) != (file, begin):
                rows += [fold.row()] if fold else []
                fold = _Fold(file, begin)
            for part in [line] if content is None else _lines_of(content):
                fold.add(part)
    rows += [fold.row()] if fold else []
    names = [c.split()[0] for c in _RANGE.split(", ")]
    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([(n, pa.string() if n == "file" else pa.int64()) for n in names]))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and digest of every file below a folder, of any size.

    A file is read in ranges, each by a task of its own: lines cut at line feeds, the SHA-256 of
    each line taken as two numbers of 60 bits, and these folded to two polynomials modulo PRIME.
    The polynomials of ranges fold together like those of lines, so the digest, a SHA-256 of both
    and of the length, does not depend on where a file was cut.  Bytes without a line feed are a
    line too, of at most 2 GB.  A leading byte order mark counts by the length only, and a file
    of nothing else has polynomials of zero.  Empty files are not listed: Spark's scans skip them.
    """
    scan = lambda kind: spark.read.format(kind).option("recursiveFileLookup", True)
    file = F.col("_metadata.file_path")
    listed = scan("binaryFile").load(path).select(file.alias("path"), F.col("_metadata.file_size").alias("length"))
    lines = scan("text").option("lineSep", "\n").load(path).where(~file.rlike(_PACKED))
    lines = lines.select(file.alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("line"), F.lit(None).cast("binary").alias("content"))
    packed = scan("binaryFile").load(path).where(file.rlike(_PACKED))
    packed = packed.select(file.alias("file"), F.lit(0).cast("long").alias("begin"), F.lit(None).cast("binary").alias("line"), "content")
    ranges = lines.mapInArrow(_folded, _RANGE).unionByName(packed.mapInArrow(_folded, _RANGE))
    whole = ranges.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("begin", "h0", "h1", "step0", "step1"))).alias("ranges"))
    number = "decimal(19,0)"
    folded = lambda k: F.coalesce(
        F.aggregate("ranges", F.lit(0).cast(number), lambda h, r: ((h * r[f"step{k}"].cast(number) + r[f"h{k}"].cast(number)) % F.lit(PRIME).cast(number)).cast(number)), F.lit(0).cast(number)
    )
    # With or without an end of the last line, and a byte order mark that the reader leaves out.
    seen = (F.coalesce("bytes", F.lit(0)) - F.col("length")).isin(0, 1, -3, -2)
    digest = F.sha2(F.concat_ws(":", folded(0).cast("string"), folded(1).cast("string"), F.col("length").cast("string")), 256)
    found = listed.join(whole, listed["path"] == whole["file"], "left")
    return found.select("path", "length", F.when(seen, digest).otherwise(F.raise_error(F.concat(F.lit("not all bytes were read: "), "path"))).alias("digest"))


def content_manifest(spark: SparkSession, path: str, named: str = r"([^/]+)$") -> DataFrame:
    """Files by content: copies under other names, and names that come with different contents.

    named: a pattern whose first group, found in a path, is the name; files whose path has none are
    left out.  No file is held in one row, but for packed ones (`file_digests`).
    """
    held = file_digests(spark, path).withColumn("name", F.regexp_extract("path", named, 1)).where("name != ''")
    contents = F.size(F.collect_set("digest"))
    names = held.groupBy("name").agg((contents > 1).alias("conflict"))
    by_content = held.join(names, "name").groupBy("digest", "length")
    return by_content.agg(F.array_sort(F.collect_list("path")).alias("paths"), F.max("conflict").alias("name_conflict")).select(
        "digest", "length", "paths", (F.size("paths") > 1).alias("copied"), "name_conflict"
    )
