"""Mechanisms that keep work small: bucketed alignment, digests of buckets, signatures of batches."""

import datetime as dt
import re

from pyspark.sql import functions as F

from tidemark.operators import checks, gates
from tidemark.plans import targeting_queries
from tidemark.operators import targeting


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_alignment_has_no_exchange_above_its_scans(spark, sample):
    records, members = targeting_queries._aligned(spark, sample)
    joined = targeting.align_members(records, members)
    text = plan(joined)
    below = text[text.index("SortMergeJoin"):]
    assert "Exchange" not in below and below.count("Bucketed: true") == 2, text


def pairs(rows):
    return sorted((str(r[0]), str(r[1]), r[-1]) for r in rows)


def test_difference_of_multisets_by_digests(spark):
    rows = [(k % 700 if k % 11 else None, None if k % 5 == 0 else f"v{k % 300}") for k in range(5000)]
    left = spark.createDataFrame(rows, "a int, b string").repartition(3)
    changed = rows[:-3] + [(1, None), (None, "1"), (None, None), (9999, "x"), rows[0], rows[0]]
    right = spark.createDataFrame(changed, "a int, b string").repartition(5)
    want = left.exceptAll(right).withColumn("in_left", F.lit(True)).unionByName(right.exceptAll(left).withColumn("in_left", F.lit(False)))
    for buckets in (1, 64, 4096):
        assert pairs(checks.multiset_diff(left, right, buckets).collect()) == pairs(want.collect())
    # Only buckets that differ are counted against each other: at most one for each planted row.
    assert 1 <= checks.differing_buckets(left, right, 4096).count() <= 9
    same = rows[:]
    assert checks.differing_buckets(left, spark.createDataFrame(same[::-1], "a int, b string"), 64).count() == 0
    assert checks.multiset_diff(left, left.repartition(2)).count() == 0
    # Equal values in other columns are no equal rows.
    one, other = spark.createDataFrame([(1, None)], "a int, b int"), spark.createDataFrame([(None, 1)], "a int, b int")
    assert checks.multiset_diff(one, other).count() == 2
    empty = left.limit(0)
    assert checks.multiset_diff(left, empty).count() == 5000 and checks.multiset_diff(empty, empty).count() == 0


def test_batches_by_literals(spark):
    day = lambda k: dt.date(2024, 1, k)
    rows = [("s", "a", day(1), 1, "x", "hash"), ("s", "a", day(2), 2, "y", "hash"), ("s", "b", day(2), 2, "y", "hash"), ("s", "b", day(3), 3, "z", "hash"), ("s", "c", day(8), 2, "y", "hash"), ("s", "c", day(9), 1, "x", "hash"), ("s", "d", day(20), 5, None, "prefix"), ("t", "a", day(1), 1, "x", "hash")]
    records = spark.createDataFrame(rows, "series string, batch string, day date, k int, v string, rule string")
    out = {(r.series, r.batch, r.other): (r.same_content, r.redefined, r.shared_days, r.equal_days, r.status) for r in gates.batch_conflicts(gates.batch_days(records.repartition(4), ["rule"], ["k", "v"])).collect()}
    assert out == {
        ("s", "a", "b"): (False, False, 1, 1, "date_overlap"),
        ("s", "a", "c"): (True, False, 0, 0, "same_content"),
        ("s", "a", "d"): (False, True, 0, 0, "series_definition_conflict"),
    }


def test_readiness_by_literals(spark):
    rows = [(dt.date(2024, 1, d), d != 8, d not in (8, 15)) for d in range(1, 31) if d != 2]
    seen = spark.createDataFrame(rows, "utc_date date, count_allowed boolean, amount_allowed boolean")
    got = {(r.utc_date.day, r.purpose): r for r in gates.history_readiness(seen, "2024-01-01", "2024-01-30").collect()}
    r = got[29, "count"]
    assert (r.history_dates, r.history_count, r.status) == ("2024-01-22,2024-01-15,2024-01-01", 3, "history_available_not_evaluated") and r.reason == "quality_blocked:2024-01-08"
    r = got[29, "amount"]
    assert (r.history_count, r.status, r.reason) == (2, "insufficient_history", "quality_blocked:2024-01-15;quality_blocked:2024-01-08")
    r = got[2, "count"]
    assert r.status == "current_date_unavailable" and r.reason.startswith("outside_observation:2023-12-26;") and r.reason.endswith(";current_date_missing_or_blocked")
    assert got[9, "count"].reason.startswith("missing_date:2024-01-02;outside_observation:2023-12-26")
    assert len(got) == 60 and not re.search("quantity", r.reason)
