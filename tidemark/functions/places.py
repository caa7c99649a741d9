"""Places of rows in a total order, without one task for all and without a sampled layout.

Bounds between ranges of the score are written first.  A row's range then depends on its score
and the written bounds alone, so a task that runs again after a lost executor puts it into the
same one.  The ranges are counted, a running sum over the counts tells how many rows come
before each, and the place within a range is numbered in a window over that range.

A score that many rows share would fill one range.  Bounds are quantiles of the score, so such a
value is a bound; each bound is a range of its own, and those are cut further by the leading
digits of a hash that the order uses to break ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import hold

#: Ranges of one order, and cells of one value; the running sum is over RANGES x CELLS counts at most.
RANGES, CELLS = 128, 256


def places(rows: DataFrame, score: str, then: list[Column], name: str = "place", by: list[str] | None = None, tie: Column | None = None, upto: int | None = None, ranges: int = RANGES) -> DataFrame:
    """Adds each row's place, from 1, by falling score (nulls last), then by the columns of `then`, within `by`.

    tie: a hash in lower-case hexadecimal digits, the first column of `then`; rows of one score are cut
    into cells by its first two digits.  upto: only places up to this one are returned, and ranges
    beyond it are not numbered at all.  The rows are read three times, so they should be a written table.
    """
    by = by or []
    value = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    at = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    bounds = rows.groupBy(*by).agg(F.sort_array(F.array_distinct(F.percentile_approx(value, at, F.lit(20 * ranges)))).alias("bounds_"))
    bounds = hold(bounds.withColumnsRenamed({c: f"by_{k}_" for k, c in enumerate(by)}))
    same = [F.col(c).eqNullSafe(F.col(f"by_{k}_")) for k, c in enumerate(by)]
    told = rows.join(F.broadcast(bounds), same, "left") if by else rows.crossJoin(F.broadcast(bounds))
    over = F.size(F.filter("bounds_", lambda b: b > value))
    # Even: above a bound and below the next; odd: at a bound.  Both numbers rise as the score falls.
    range_ = 2 * over + F.when(F.array_contains("bounds_", value), 1).otherwise(0)
    cell = F.when(range_ % 2 == 1, F.conv(F.substring(tie, 1, 2), 16, 10).cast("int")).otherwise(0) if tie is not None else F.lit(0)
    told = told.withColumns({"range_": range_, "cell_": cell}).drop("bounds_", *[f"by_{k}_" for k in range(len(by))])
    counts = told.groupBy(*by, "range_", "cell_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy("range_", "cell_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before_", before).drop("n_")
    starts = hold((starts if upto is None else starts.where(F.col("before_") < upto)).withColumnsRenamed({c: f"by_{k}_" for k, c in enumerate(by)} | {"range_": "r_", "cell_": "c_"}))
    found = told.join(F.broadcast(starts), [*same, F.col("range_") == F.col("r_"), F.col("cell_") == F.col("c_")])
    inner = F.row_number().over(Window.partitionBy(*by, "range_", "cell_").orderBy(F.col(score).desc_nulls_last(), *then))
    out = found.withColumn(name, (inner + F.col("before_")).cast("long")).drop("range_", "cell_", "r_", "c_", "before_", *[f"by_{k}_" for k in range(len(by))])
    return out if upto is None else out.where(F.col(name) <= upto)
