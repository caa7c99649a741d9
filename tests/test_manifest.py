"""Digests of files in ranges, against a loop over the whole file; copies and conflicts."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files


def by_a_loop(content: bytes) -> str:
    body = content.removeprefix(b"\xef\xbb\xbf")
    lines = body.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    held = [0, 0]
    for line in lines:
        told = hashlib.sha256(line).hexdigest()
        for k, base in enumerate(files.BASES):
            held[k] = (held[k] * base + int(told[15 * k : 15 * k + 15], 16)) % files.PRIME
    return hashlib.sha256(f"{held[0]}:{held[1]}:{len(content)}".encode()).hexdigest()


@pytest.fixture(scope="module")
def contents():
    rng = random.Random(3)
    text = "\n".join(f"{k},{rng.random()}" for k in range(4000)).encode()
    noise = rng.randbytes(90_000)
    return {
        "text": text, "ended": text + b"\n", "twice": text + b"\n\n", "swapped": text[50_000:] + text[:50_000], "noise.bin": noise, "noise_end": noise + b"\n",
        "no_feed": b"x" * 70_000, "empty": b"", "feed": b"\n", "feeds": b"\n" * 5000, "returns": b"a\r\nb\rc\r\n" * 3000, "mark": b"\xef\xbb\xbf" + text, "only_mark": b"\xef\xbb\xbf",
        "packed.gz": gzip.compress(text, mtime=0), "packed": gzip.compress(text, mtime=0), "latin": "äöü\n".encode("latin-1") * 2000, "nul": b"\0\n\0" * 4000,
    }


@pytest.mark.parametrize("cut", [10_007, 1 << 27])
def test_ranges_do_not_change_a_digest(spark, tmp_path, contents, cut):
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        spark.conf.set("spark.sql.files.openCostInBytes", 64)
        if cut < 1 << 20:
            blocks = spark.read.option("lineSep", "\n").text(str(tmp_path / "text")).select(F.col("_metadata.file_block_start")).distinct().count()
            assert blocks > 5
        found = {r.path.rsplit("/", 1)[-1]: r for r in files.file_digests(spark, str(tmp_path)).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {n: (r.digest, r.length) for n, r in found.items()} == {n: (by_a_loop(c), len(c)) for n, c in contents.items() if c}
    assert len({r.digest for r in found.values()}) == len(found) - 1  # packed.gz and packed are one content


def test_copies_and_conflicts(spark, tmp_path):
    for path, content in (("a/x", "1\n"), ("b/x", "1\n"), ("b/y", "1"), ("c/y", "2"), ("c/z", ""), ("d/w", "3")):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(content)
    found = {tuple(p[-3:] for p in r.paths): (r.length, r.copied, r.name_conflict) for r in files.content_manifest(spark, str(tmp_path)).collect()}
    assert found == {("a/x", "b/x"): (2, True, False), ("b/y",): (1, False, True), ("c/y",): (1, False, True), ("d/w",): (1, False, False)}
    some = files.content_manifest(spark, str(tmp_path), r"/b/(.)$").collect()
    assert sorted(p[-3:] for r in some for p in r.paths) == ["b/x", "b/y"]
