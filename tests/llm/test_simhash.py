import random

import numpy as np
import xxhash

from tidemark.llm import simhash as sh
from tidemark.llm.components import components


def fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(ids, fps, tau):
    """Smallest id reachable from each row, by comparing all pairs."""
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                parent[root(i)] = root(j)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min((x for x in (least.get(root(k)), i) if x is not None), default=None)
    return [least[root(k)] for k in range(len(fps))]


def check(df, rows):
    fps = [fingerprint(t) for _, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, closed([i for i, _ in rows], fps, 3), strict=True)), key=str)
    assert sorted([tuple(r) for r in sh.linked_documents(df).collect()], key=str) == want


def test_sample_documents(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_edge_rows(spark, make_docs):
    rows = [(9, None), (4, ""), (7, " \t"), (1, "A b"), (2, "a B"), (2, "a b"), (3, "x" * 100_000), (None, "A b"), (5, "É é É é"), (6, "é É é É")]
    check(make_docs(rows, extra=True), rows)
    assert sh.linked_documents(make_docs([])).count() == 0


def test_links_of_chosen_fingerprints(spark, monkeypatch):
    rnd = random.Random(3)
    fps = []
    for _ in range(40):  # balls, chains, and a crowd on a few bits
        centre = rnd.getrandbits(64)
        fps += [centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 6))) for _ in range(12)]
    crowd = rnd.getrandbits(64)
    fps += [crowd ^ (rnd.getrandbits(10) << 20) for _ in range(300)]
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in signed], "node long, f0 long")
    for tau in (0, 1, 3, 7):
        want = closed(signed, fps, tau)
        for block in (4096, 16):
            monkeypatch.setattr(sh, "BLOCK", block)
            found = {r.node: r.component for r in components(sh.links(nodes, tau)).collect()}
            assert [found.get(s, s) for s in signed] == want


def test_every_plan_keeps_the_pigeonhole():
    rnd = np.random.default_rng(1)
    bits = (rnd.random((500, 64)) < rnd.random(64)).astype(float)
    for n in (10, 10**5, 10**8):
        for tau in (0, 3, 7):
            plan = sh.make_plan(n, bits.T @ bits * n / 500, tau)
            assert sum(t for _, t in plan.parts) == tau - len(plan.parts) + 1
            assert sorted(b for part, _ in plan.parts for b in part) == list(range(64))


def test_near_copies_go_and_clean_texts_stay(spark, make_docs):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(5))
    rows = []
    for k in range(30):
        words = [word() for _ in range(400)]
        rows.append((10 * k, " ".join(words)))
        words[rnd.randrange(400)] = "changed"
        rows.append((10 * k + 1, " ".join(words)))
        rows.append((10 * k + 2, rows[-2][1]))
        rows.append((10 * k + 3, " ".join(words[:200] + [word() for _ in range(200)])))
    rows += [(9000, None), (9001, ""), (9002, "lone"), (9002, "lone"), (None, rows[0][1])]
    df = make_docs(rows, extra=True)
    out = sh.keep_one_of_each_group(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == sorted([-1, *(10 * k for k in range(30)), *(10 * k + 3 for k in range(30)), 9000, 9002])
    assert sh.keep_one_of_each_group(make_docs([])).count() == 0


def sequential(rows, like):
    """In the order of the ids, a row stays unless one that stays is like it."""
    kept = []
    for i, t in sorted(rows):
        w = t.lower().split()
        own = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        if not any(len(own & o) / len(own | o) >= like for _, o in kept):
            kept.append((i, own))
    return [i for i, _ in kept]


def test_no_set_of_candidates_is_left_undecided(spark, make_docs, monkeypatch):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(5))
    base, rows = [word() for _ in range(400)], []
    for k in range(12):  # a family: no two of its originals reach 0.8, each has a near and an exact copy
        text = list(base)
        for _ in range(17):
            text[rnd.randrange(400)] = word()
        rows += [(k, " ".join(text)), (200 + k, " ".join(text))]
        text[rnd.randrange(400)] = "changed"
        rows.append((100 + k, " ".join(text)))
    want = sequential(rows, 0.8)
    assert len(want) > 6  # more than four leaders have to be found
    monkeypatch.setattr(sh, "_groups", lambda fps, node, tau, planes: fps.select(node.alias("node")).distinct().selectExpr("node", "0L as component"))
    for limit in (8 << 20, 7000):  # one task decides the set, or rounds of a few rows each
        monkeypatch.setattr(sh, "BLOCK_BYTES", limit)
        assert sorted(r.doc_id for r in sh.keep_one_of_each_group(make_docs(rows)).collect()) == want


def test_large_sets_are_cut_where_no_two_rows_are_alike(spark, make_docs, monkeypatch):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(5))
    passage, rows = [word() for _ in range(200)], []
    for k in range(40):  # all share a passage of two thirds, but only copies are alike
        text = passage + [word() for _ in range(100)]
        rows += [(k, " ".join(text)), (200 + k, " ".join(text + ["more"]))]
    rows += [(500, "  "), (501, "\n"), (502, "lone")]
    want = sequential(rows, 0.8)
    rounds = []
    judge = sh._judge
    monkeypatch.setattr(sh, "_judge", lambda *a: rounds.append(1) or judge(*a))
    monkeypatch.setattr(sh, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(sh, "_groups", lambda fps, node, tau, planes: fps.select(node.alias("node")).distinct().selectExpr("node", "0L as component"))
    assert sorted(r.doc_id for r in sh.keep_one_of_each_group(make_docs(rows)).collect()) == want
    assert len(rounds) == 2  # the components that were small at once, and the finer sets
    given = make_docs(rows).selectExpr("doc_id", "xxhash64(text) as text_hash", "7L as component", "text")
    sets = {}
    for r in sh._finer(given, 5, 0.8).collect():
        sets.setdefault(r.component, set()).add(r.doc_id)
    assert sorted(map(sorted, sets.values())) == sorted([[k, 200 + k] for k in range(40)] + [[500, 501]])


def test_leaders_miss_no_similar_set():
    rnd = np.random.default_rng(2)
    for _ in range(2000):
        n = int(rnd.integers(1, 40))
        a = np.unique(rnd.integers(0, 60, n).astype(np.uint64))
        b = np.unique(np.where(rnd.random(len(a)) < 0.1, rnd.integers(0, 60, len(a)).astype(np.uint64), a))
        leaders = sh._Leaders(0.8)
        leaders.add(a)
        assert leaders.like(b) == (len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8)
