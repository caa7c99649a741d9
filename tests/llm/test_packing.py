import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """The optimum, by trying all assignments."""
    best = len(lengths)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= capacity:
                bins[b] += lengths[k]
                put(k + 1, bins)
                bins[b] -= lengths[k]
        put(k + 1, [*bins, lengths[k]])

    put(0, [])
    return best if lengths else 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_bounds_never_exceed_the_optimum(lengths):
    items = np.array(lengths, np.int64)
    best = fewest(lengths, 20)
    assert packing.lower_bound(items, 20) <= best
    bins, places = packing.best_fit_decreasing(items, 20)
    assert best <= len(set(bins.tolist()))
    for b in set(bins.tolist()):
        spans = sorted(zip(places[bins == b].tolist(), items[bins == b].tolist(), strict=True))
        assert [s for s, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1] and sum(n for _, n in spans) <= 20


def check_places(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1]
        assert sum(n for _, n in spans) <= capacity
    return len(by)


def test_sample_documents(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for d in docs.collect():
        ids = np.array([*library.encode(d.text, add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[d.doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    least = packing.lower_bound(np.array([r.length for r in rows]), 4096)
    assert check_places(rows) == least


def given(spark, lengths):
    return spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")


def test_exchange_between_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 60)
    rnd = random.Random(2)
    lengths = [rnd.choice([1, 7, 30, 51, 52, 99, 100, 33]) for _ in range(1500)] + [40] * 20
    found = packing.pack(given(spark, lengths), 100)
    rows = found.rows.collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    assert found.bound == packing.lower_bound(np.array(lengths), 100)
    assert found.bound <= found.sequences == check_places(rows, 100) <= found.bound * 1.02 + 1


def test_bounds_certify_pieces_of_over_half_a_sequence(spark, monkeypatch):
    # 360 sequences by volume; only the dual-feasible bound says that 600 are due, and ends the search.
    monkeypatch.setattr(packing, "PIECES", 60)
    found = packing.pack(given(spark, [60] * 600), 100)
    assert found.certified and found.rounds == 1 and found.sequences == found.bound == 600
    assert check_places(found.rows.collect(), 100) == 600


def test_only_partitions_with_a_gap_exchange():
    certified = np.array([60, 60, 60, 30])
    bins, _ = packing.best_fit_decreasing(certified, 100)
    goes, bound = packing.leaving(bins, certified, 100)
    assert bound == 3 and goes.sum() == 1  # the emptiest, for the rounding of the bound
    gap = np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6, 20])
    bins = np.array([0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 2])
    goes, bound = packing.leaving(bins, gap, 100)
    assert bound == 2 and goes.all()
    goes, bound = packing.leaving(np.arange(3), np.array([100, 100, 100]), 100)
    assert bound == 3 and not goes.any()


def test_the_exchange_saves_what_partitions_round_up(spark, monkeypatch):
    # Every partition is certified, with half a sequence left: only together they need fewer.
    monkeypatch.setattr(packing, "PIECES", 7)
    found = packing.pack(given(spark, [50] * 200 + [100] * 3), 100)
    assert found.certified and found.sequences == 103 and check_places(found.rows.collect(), 100) == 103


def test_an_exchange_that_saves_nothing_is_taken_back(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 12)
    rnd = random.Random(7)
    lengths = [rnd.choice([34, 36, 51, 26]) for _ in range(240)]
    found = packing.pack(given(spark, lengths), 100)
    rows = found.rows.collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    assert found.bound <= found.sequences == check_places(rows, 100)


def test_the_table_is_bounded_and_forgotten(monkeypatch):
    known = packing.ChunkIds(VOCABULARY)
    known.bound(packing.ENTRY * 30)
    list(known.encode([" ".join(f"w{k}x" for k in range(500)), "y" * 500]))
    assert len(known) <= 30
    monkeypatch.setattr(packing, "RELEASE", 0.05)
    with packing.chunk_ids(VOCABULARY) as kept:
        list(kept.encode(["some words"]))
    for t in packing._waiting:
        t.join()
    assert not kept


def test_edge_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "a" * 30_000), (4, "word " * 9000), (4, "word " * 9000), (None, "é\x1cb <|endoftext|>"), (6, " \n")]
    out = packing.pack_documents(make_docs(rows, extra=True), VOCABULARY).collect()
    library = Tokenizer.from_file(VOCABULARY)
    total = Counter()
    for i, t in rows:
        total[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in out:
        got[r.doc_id] += r.length
    assert got == total
    check_places(out)
    assert packing.pack_documents(make_docs([]), VOCABULARY).count() == 0
