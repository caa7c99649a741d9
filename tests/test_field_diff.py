"""Differences of fields against the registered SQL on small tables: values absent on one side, on both, and in whole columns."""

import datetime as dt
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks
from tidemark.plans import registry  # noqa: F401  loads all queries
from tidemark.plans.metric_queries import _FIELD_SQL

FIELDS = ("active_users", "buyers", "purchase_amount")
SCHEMA = "scope_id string, utc_date date, active_users long, buyers long, purchase_amount decimal(38,2)"


def row(scope, day, users, buyers, amount):
    return scope, dt.date(2024, 1, day), users, buyers, None if amount is None else Decimal(amount)


CASES = {
    "no amount at all": ([row("s", d, 10 + d, d, None) for d in range(1, 6)], [row("s", d, 11 + d, d, None) for d in range(2, 7)]),
    "amounts on one side only": ([row("s", d, 5, 0, "3.50") for d in (1, 2)], [row("s", d, 5, 0, None) for d in (1, 2)]),
    "some absent, some off": ([row("s", 1, 8, 4, "10.00"), row("s", 2, 3, 0, None), row("s", 3, 0, 0, "0.00")], [row("s", 1, 9, 4, "10.50"), row("s", 2, 3, 0, "7.00"), row("s", 3, 0, 0, "0.00")]),
    "no common key": ([row("s", 1, 8, 4, "10.00")], [row("t", 1, 8, 0, None)]),
}


@pytest.mark.parametrize("case", CASES)
def test_field_diff_as_in_sql(spark, case):
    left, right = CASES[case]
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (left, right)]
    out = checks.field_diff(*frames, ["scope_id", "utc_date"], list(FIELDS), absolute=0.6)
    got = out.withColumns({n: F.round(n, 6) for n in ("max_absolute_error", "max_relative_error")})
    con = duckdb.connect()
    for name, rows in (("daily", left), ("dm", right)):
        con.execute(f"create table {name} (scope_id varchar, utc_date date, active_users bigint, buyers bigint, purchase_amount decimal(38,2))")
        con.executemany(f"insert into {name} values (?, ?, ?, ?, ?)", rows)
    rel = con.execute(" union all ".join(_FIELD_SQL.format(f=f) for f in FIELDS))
    assert sorted(map(tuple, got.select(*[c[0] for c in rel.description]).collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_text_has_no_errors(spark):
    left, right = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "a"), (2, None)], [(1, "b"), (2, None)]))
    r = checks.field_diff(left, right, ["k"], ["v"]).collect()[0]
    assert (r.mismatches, r.max_absolute_error, r.max_relative_error) == (1, None, None)
