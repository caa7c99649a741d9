"""Filter audit against the definition: every order applied filter by filter, document by document."""

import itertools
import math
import random
import re
from fractions import Fraction

import duckdb
import pytest

from tidemark.llm import filter_audit
from tidemark.llm.common import slices
from tidemark.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"


def failed(rows):
    """Pattern of each row, by the conditions as they are stated."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append({c for c, bad in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), copy), strict=True) if bad})
    return out


def brute(rows, labels):
    fails = failed(rows)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    out = {}
    for part in {lang or "" for *_, lang in rows}:
        docs = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        told, share = {}, dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, c in enumerate(order, 1):
                gone = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                share[c] += len(gone)
                fine = (len(left), len(gone), sum(c in f for _, f in docs) - len(gone), sum(f == {c} for _, f in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                told[part, order, step] = fine
        out |= {k: (*v, share[k[1][k[2] - 1]]) for k, v in told.items()}
    return out


def some_rows(n=60, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rnd.choice(["one", "Two", "THREE", "vier"]) + (str(rnd.randrange(500)) if rnd.random() < 0.9 else "") for _ in range(rnd.choice([0, 5, 99, 100, 130]))]
        text = rnd.choice([" ", "\n", "\t \r"]).join(words) + rnd.choice(["", "", " #", "é" * 40, "\x1c|"])
        rows.append((i, text, rnd.choice(["en", "en", "de", None, ""])))
    rows += [(100 + i, rows[i % 7][1], "en") for i in range(20)]
    rows += [(3, rows[3][1], "en"), (3, rows[3][1], "en"), (None, rows[3][1], "de"), (None, None, None), (7, None, "fr"), (8, "", "fr"), (2, None, "fr")]
    return rows


def result(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_all_orders_by_the_definition(spark):
    rows = some_rows()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as bits", "'x' as part", "true as first", "2 as n")
    got = result(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS).selectExpr("*", "'y' as digest")))
    want = brute(rows, labels)
    assert len(got) == 600 * 4 and got == want


def test_an_empty_table_and_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, none).count() == 0
    one = spark.createDataFrame([(1, "a b", "en")], docs.schema)
    assert result(filter_audit.audit(one, none)) == brute([(1, "a b", "en")], [])


def test_long_texts_are_counted_in_slices():
    text = (" ".join(str(k * k % 977) for k in range(500_000)) + " \n" + "x" * 3_000_000 + " y").encode()
    assert filter_audit.word_counts(text) == (len(text.split()), len(set(text.split())))
    parts = list(slices(b"ab cd  ef\ngh", 3))
    assert b"".join(parts) == b"ab cd  ef\ngh" and [x.split() for x in parts] == [[b"ab", b"cd"], [b"ef"], [b"gh"]]
    assert list(slices(b"")) == [b""] and b"".join(slices(b"xxxx", 2)) == b"xxxx"


@pytest.mark.parametrize("m", [2, 3, 5])
def test_shares_are_the_mean_over_orders(m):
    rnd = random.Random(m)
    removed = filter_audit.coalitions([rnd.randrange(10**12) for _ in range(1 << m)])
    want = [Fraction(0)] * m
    for order in itertools.permutations(range(m)):
        before = 0
        for k in order:
            want[k] += Fraction(removed[before | 1 << k] - removed[before], math.factorial(m))
            before |= 1 << k
    assert filter_audit.shapley(removed) == want and sum(want) == removed[-1]


def test_same_as_sql(spark, sample):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sample}/{t}.parquet'")
    rel = con.execute(filter_audit.ORACLE_SQL)
    names = [c[0] for c in rel.description]
    want = sorted(rel.fetchall())
    got = sorted(tuple(r) for r in QUERIES["op12_filter_audit"](spark, sample).select(*names).collect())
    assert got == want and len(want) % 600 == 0
