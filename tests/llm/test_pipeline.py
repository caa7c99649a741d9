import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_pii import brute as pii_spans  # noqa: E402
from test_substring import brute as repeats  # noqa: E402

from tidemark.llm.common import materialize  # noqa: E402


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def staged(spark, sample):
    docs = [spark.read.parquet(f"{sample}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], sample), name))
    return [[r.asDict() for r in d.collect()] for d in docs]


def test_stages_in_order(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "personal_data", "best_fit_packing"]
    for rows in staged[1:5]:
        assert list(rows[0]) == list(staged[0][0])


def test_language_stage_keeps_clean_documents(staged):
    assert len(staged[1]) >= 0.99 * len(staged[0])


def test_near_dedup_against_all_pairs(staged):
    before, after = {r["doc_id"]: r["text"] for r in staged[1]}, {r["doc_id"]: r["text"] for r in staged[2]}
    sets = {i: shingles(t) for i, t in before.items()}
    kept = sorted(after)
    for i in set(before) - set(after):  # what went has something like it that stayed
        assert any(jaccard(sets[i], sets[j]) >= 0.8 for j in kept)
    pairs = [(i, j) for i in before for j in before if i < j and jaccard(sets[i], sets[j]) >= 0.8]
    missed = [(i, j) for i, j in pairs if i in after and j in after]
    assert len(missed) <= 0.05 * max(1, len(pairs))
    assert all(after[i] == before[i] for i in after)


def test_substring_stage(staged):
    before, after = [(r["doc_id"], r["text"]) for r in staged[2]], {r["doc_id"]: r["text"] for r in staged[3]}
    for i, n, gone, _ in repeats(before):
        assert len(after[i].split()) == n - gone
    for i, t in before:
        assert len(t.split()) != len(after[i].split()) or t == after[i]


def test_private_data_is_gone(staged):
    for a, b in zip(sorted(staged[3], key=lambda r: r["doc_id"]), sorted(staged[4], key=lambda r: r["doc_id"]), strict=True):
        assert pii_spans(b["text"])[:4] == (0, 0, 0, 0)
        assert pii_spans(a["text"])[:4] != (0, 0, 0, 0) or a["text"] == b["text"] or "[IBAN]" in b["text"] or "[SSN]" in b["text"]
        assert b["n_chars"] == len(b["text"])


def test_all_documents_are_packed(staged):
    assert {r["doc_id"] for r in staged[5]} == {r["doc_id"] for r in staged[4]}
    fill = Counter()
    for r in staged[5]:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096


def test_empty_and_odd_documents(spark, make_docs, sample, tmp_path):
    rows = [(1, None), (2, ""), (3, "the cat " * 200), (3, "the cat " * 200), (None, "The cat sat. mail a@b.cd")]
    for given in (rows, []):
        docs = make_docs(given)
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sample), name)
        assert {r.doc_id for r in docs.collect()} == ({3, None} if given else set())
