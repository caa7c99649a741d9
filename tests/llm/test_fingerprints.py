import hashlib

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import fingerprints as fp


@given(st.text(alphabet="ab", max_size=60), st.text(alphabet="ab", max_size=60))
def test_prefix_arrays_answer_spans_and_extensions(a, b):
    h = fp.PrefixHash()
    p, q = h.both(a), h.both(b)
    for i in range(0, len(a), 7):
        for j in range(0, len(b), 7):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert h.common_extension(p, i, q, j) == n
    for k in (1, 5, 16):
        if len(a) >= k:
            one = h.spans(p[0], k)
            groups = {}
            for i in range(len(a) - k + 1):
                groups.setdefault(a[i : i + k], set()).add(int(one[i]))
            assert all(len(v) == 1 for v in groups.values()) and len({x for v in groups.values() for x in v}) == len(groups)


def in_order(rows):
    signed = lambda t: (x := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64) * (x >> 63)
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -signed(r[1] or "")))


def plain_fingerprint(text):
    """The whole text's hashes and, of each class of span hashes, a byte of the smallest; in whole numbers only."""
    p, codes = 2**31 - 1, [ord(c) + 1 for c in text]
    sums = [sum(c * pow(base, k, p) for k, c in enumerate(codes)) % p for base in fp.BASES]
    n = min(16, len(text))
    least = {}
    for k in range(len(text) - n + 1) if text else ():
        span = sum(c * pow(fp.BASES[0], j, p) for j, c in enumerate(codes[k : k + n])) % p
        mixed = span * 0x9E3779B97F4A7C15 % 2**64
        slot = mixed >> 57
        least[slot] = min(least.get(slot, mixed), mixed)
    sketch = [(least[s] * 0xBF58476D1CE4E5B9 % 2**64 >> 56) % 255 + 1 if s in least else 0 for s in range(128)]
    return f"{sums[0] << 32 | sums[1]:016x}" + bytes(sketch).hex(), sketch


def plain_likeness(a, b):
    (x, s), (y, t) = plain_fingerprint(a), plain_fingerprint(b)
    used = [k for k in range(128) if s[k] or t[k]]
    return 1.0 if x == y else sum(s[k] == t[k] for k in used) / len(used) if used else 0.0


def brute(rows):
    rows = in_order(rows)
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in df.collect()), key=str)


def test_fingerprints_and_likeness_by_the_definition(spark, make_docs):
    rows = [(1, "ab" * 30 + "cd"), (2, "the cat sat on the mat and the dog"), (3, "the cat sat on the mat and the hog"), (4, "é😀x"), (5, ""), (6, None), (7, "x" * 40)]
    out = {r.doc_id: r for r in fp.fingerprint_documents(make_docs(rows)).collect()}
    ordered = in_order(rows)
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = out[i]
        assert r.fingerprint == plain_fingerprint(t)[0] and r.edited_fingerprint == plain_fingerprint(edited)[0]
        assert abs(r.near_edited - plain_likeness(t, edited)) < 1e-12 and abs(r.near_next - plain_likeness(t, after)) < 1e-12
        assert r.common_prefix == next((k for k, (x, y) in enumerate(zip(t, edited)) if x != y), min(len(t), len(edited)))


def test_one_id_and_text_in_many_rows(spark, make_docs):
    rows = [(None, "same text")] * 600 + [(9, "another")] * 600 + [(5, f"text {k}") for k in range(600)]
    df = fp.fingerprint_documents(make_docs(rows).repartition(5))
    assert got(df) == brute(rows)


def test_edited_texts_of_sample(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").repartition(7)
    out = fp.fingerprint_documents(docs)
    assert got(out) == brute([(r.doc_id, r.text) for r in docs.collect()])
    rows = out.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    same = {}
    for r in rows:
        same.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in same.values()) and len({x for v in same.values() for x in v}) == len(same)
    long = [r for r in rows if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


def test_edge_rows(spark, make_docs):
    rows = [(3, None), (3, ""), (2, "xyz"), (2, "abc😀def"), (None, "tail"), (1, "q" * 50_000), (1, "q" * 50_000), (7, "é")]
    out = fp.fingerprint_documents(make_docs(rows, extra=True))
    assert got(out) == brute(rows)
    assert got(fp.fingerprint_documents(make_docs([(5, "alone here")]))) == brute([(5, "alone here")])
    assert fp.fingerprint_documents(make_docs([])).count() == 0
    empty = [r for r in out.collect() if r.n_chars == 0]
    assert {r.fingerprint for r in empty} == {r.edited_fingerprint for r in empty} and len({r.fingerprint for r in empty}) == 1
