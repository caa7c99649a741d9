import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import training_order as to

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 257, 4097, 70_001])
def test_permutation(n):
    order = to.Feistel(n, "k")
    out = order(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    if n > 100:
        assert (out != to.Feistel(n, "other")(np.arange(n))).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), out)[0, 1]) < 0.3


def want(rows, stride):
    library = Tokenizer.from_file(VOCABULARY)
    out = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), stride):
            part = ids[k : k + stride]
            out[i, k // stride, len(part), zlib.crc32(np.array(part + [1] * (stride - len(part)), "<u2").tobytes())] += 1
    return out


def test_sample_documents(spark, sample, tmp_path):
    docs = spark.read.parquet(f"{sample}/documents.parquet").repartition(3)
    df = to.training_order(docs, VOCABULARY, stride=256, shard=50)
    rows = df.collect()
    n = len(rows)
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows) == want([(r.doc_id, r.text) for r in docs.collect()], 256)
    assert [r.slot for r in rows] == list(range(n)) and sorted(r["index"] for r in rows) == list(range(n))
    assert [r.slot for r in rows] == to.Feistel(n, "epoch-0")(np.array([r["index"] for r in rows])).tolist()
    assert all((r.shard, r.place) == divmod(r.slot, 50) and len(r.record) == 512 for r in rows)
    told = to.write_shards(df, str(tmp_path / "out")).collect()
    assert sum(r.records for r in told) == n and {r.shard for r in told} == set(range(-(-n // 50)))
    whole = {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()}
    first, *rest = sorted((tmp_path / "out").iterdir())
    first.write_bytes(b"torn")
    rest[0].unlink()
    held = {f.name: f.stat().st_mtime_ns for f in rest[1:]}
    to.write_shards(df, str(tmp_path / "out")).collect()  # goes on where it was broken off
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()} == whole and all((tmp_path / "out" / f).stat().st_mtime_ns == t for f, t in held.items())
    got = to.read_records(str(tmp_path / "out"), 37, 100, stride=256, shard=50)
    assert got.tobytes() == b"".join(bytes(r.record) for r in rows[37:137])


def test_edge_rows(make_docs):
    rows = [(1, None), (2, ""), (3, "word " * 3000), (3, "word " * 3000), (None, "é <|endoftext|>"), (4, " \n")]
    out = to.training_order(make_docs(rows, extra=True), VOCABULARY).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == want(rows, to.STRIDE)
    assert to.training_order(make_docs([]), VOCABULARY).count() == 0
