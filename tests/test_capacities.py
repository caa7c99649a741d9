"""Capacities of more rows than a product in 32 bits can tell."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import uplift


def test_capacities_of_many_rows(spark):
    placed = spark.range(1, 9).select(F.lit("random").alias("policy"), F.col("id").cast("string").alias("row_id"), (F.col("id") % 2).cast("int").alias("treatment"), (F.col("id") % 3 == 0).cast("int").alias("conversion"), F.col("id").alias("place"))
    for n in (3_000_000, 30_000_000_000):
        got = {r.capacity: r for r in uplift.capacities(placed, n).collect()}
        assert {c: r.selected for c, r in got.items()} == {c: c * n // 100 for c in (10, 20, 30, 50, 100)}
        assert got[20].gain == pytest.approx(2000 * got[20].delta)
