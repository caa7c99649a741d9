"""Places by ranges against a plain sort: ties, heavy values, nulls, groups, and a limit."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.places import places


def rows_of(seed, n=3000):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind = rnd.random()
        score = 0.25 if kind < 0.4 else None if kind < 0.45 else float(rnd.randrange(5)) if kind < 0.6 else rnd.gauss(0, 1)
        out.append((i, rnd.choice(["a", "b", None]), score))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = rows_of(3)
    return rows, spark.createDataFrame(rows, "id long, part string, score double").withColumn("tie", F.sha2(F.col("id").cast("string"), 256)).persist()


def order(tie):
    return lambda r: (r[2] is None, -(r[2] or 0.0), tie[r[0]])


def test_one_order(table):
    rows, df = table
    tie = {r.id: r.tie for r in df.collect()}
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=order(tie)), 1)}
    placed = places(df, "score", [F.col("tie"), F.col("id")], tie=F.col("tie"), ranges=16)
    assert {r.id: r.place for r in placed.collect()} == want
    assert placed.columns == [*df.columns, "place"]
    top = places(df, "score", [F.col("tie")], tie=F.col("tie"), upto=700, ranges=16).collect()
    assert {r.id: r.place for r in top} == {i: k for i, k in want.items() if k <= 700}


def test_orders_within_groups(table):
    rows, df = table
    want = {}
    for part in ("a", "b", None):
        inside = [r for r in rows if r[1] == part]
        want |= {r[0]: k for k, r in enumerate(sorted(inside, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0])), 1)}
    placed = places(df, "score", [F.col("id")], "rank", by=["part"], ranges=8)
    assert {r.id: r["rank"] for r in placed.collect()} == want


def test_no_range_holds_a_heavy_value(table, spark):
    rows, df = table
    plan = places(df, "score", [F.col("tie")], tie=F.col("tie"), ranges=16)
    # A value of 40% of all rows is dealt to cells: the window's largest group is a small share.
    text = plan._jdf.queryExecution().toString()
    assert "SinglePartition" not in text.split("== Physical Plan ==")[-1]


def test_empty(spark):
    none = spark.createDataFrame([], "id long, score double")
    assert places(none, "score", [F.col("id")]).count() == 0
