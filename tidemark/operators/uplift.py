"""Policies that rank by a continuous score: places, capacities, Qini curves and their areas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_where
from ..functions.places import places
from .targeting import CAPACITIES

#: The score that each learned policy orders by; `random` has none and follows the hash alone.
SCORES = {"random": None, "response": "response", "s_learner": "s_uplift", "t_learner": "t_uplift"}


def policy_places(scores: DataFrame, policies: dict[str, str | None] = SCORES) -> DataFrame:
    """policy, row_id, treatment, conversion, place: every row once a policy, best first, ties by hash, then id.

    scores: a written table with the hash as `tie`.  Places see scores, hashes and ids only.  Hash and row_id are in
    lower-case hexadecimal digits; they are shuffled as bytes, which sort alike.
    """
    parts = []
    for policy, score in policies.items():
        kept = scores.select(F.unhex("row_id").alias("id_"), F.unhex("tie").alias("tie_"), "treatment", "conversion", (F.lit(0.0) if score is None else F.col(score)).alias("score"))
        placed = places(kept, "score", [F.col("tie_"), F.col("id_")], tie=F.hex(F.substring("tie_", 1, 1)))
        parts.append(placed.select(F.lit(policy).alias("policy"), F.lower(F.hex("id_")).alias("row_id"), "treatment", "conversion", "place"))
    return reduce(DataFrame.unionByName, parts)


def _counts(rows: DataFrame, *by) -> DataFrame:
    t, y = F.col("treatment"), F.col("conversion")
    return rows.groupBy(*by).agg(count_where(t == 1).alias("n1"), count_where(t == 0).alias("n0"), count_where((t == 1) & (y == 1)).alias("y1"), count_where((t == 0) & (y == 1)).alias("y0"))


def curves(placed: DataFrame, n: int) -> DataFrame:
    """policy, percent: Q and its reference over the first floor(percent n / 100) rows of each policy's order.

    Rows are counted by the percent that first holds them, in one aggregate for all policies; the
    running sums are over 101 rows each.
    """
    # The least percent p with floor(p n / 100) >= place.
    percent = F.ceil(F.col("place") * 100 / F.lit(n)).cast("int")
    counted = _counts(placed, "policy", percent.alias("percent"))
    spine = placed.select("policy").distinct().select("policy", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("percent"))
    run = Window.partitionBy("policy").orderBy("percent").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = spine.join(counted, ["policy", "percent"], "left").select("policy", "percent", *[F.coalesce(F.sum(c).over(run), F.lit(0)).cast("long").alias(c) for c in ("n1", "n0", "y1", "y0")])
    size = F.col("n1") + F.col("n0")
    q = F.when(size == 0, F.lit(0.0)).when(F.col("n0") > 0, F.col("y1") - F.col("y0") * F.col("n1") / F.col("n0").cast("double"))
    cum = cum.withColumns({"selected": size, "share": size / F.lit(float(n)), "q": q})
    line = F.last("q").over(Window.partitionBy("policy").orderBy("percent").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.col("share")
    sparse = (size > 0) & (F.least(F.col("y0"), F.col("n0") - F.col("y0"), F.col("y1"), F.col("n1") - F.col("y1")) < 10)
    status = F.when(size == 0, "origin").when(F.col("q").isNull(), "no_control_prefix").otherwise("point_estimate_only")
    return cum.withColumns({"reference": line, "sparse": sparse, "status": status})


def areas(curve: DataFrame) -> DataFrame:
    """policy, area: trapezoids between curve and reference over the shares that are really selected; null if the curve has a gap."""
    w = Window.partitionBy("policy").orderBy("percent")
    gap = F.col("q") - F.col("reference")
    part = (F.col("share") - F.lag("share").over(w)) * (gap + F.lag(gap).over(w)) / 2
    return curve.select("policy", part.alias("part"), gap.isNull().alias("gap")).groupBy("policy").agg(F.when(~F.bool_or("gap"), F.sum("part")).alias("area"))


def capacities(placed: DataFrame, n: int) -> DataFrame:
    """policy, capacity: both arms of the first floor(capacity n / 100) rows, their rates, and the gain per 10,000 rows of all."""
    at = F.array(*[F.struct(F.lit(c).alias("capacity"), F.lit(c * n // 100).cast("long").alias("k")) for c in CAPACITIES])
    inside = placed.select("policy", "treatment", "conversion", F.explode(F.filter(at, lambda x: F.col("place") <= x["k"])).alias("x")).select("*", "x.*")
    out = _counts(inside, "policy", "capacity", "k")
    p = lambda a: F.try_divide(F.col(f"y{a}").cast("double"), F.col(f"n{a}").cast("double"))
    delta = p(1) - p(0)
    least = F.least(F.col("y0"), F.col("n0") - F.col("y0"), F.col("y1"), F.col("n1") - F.col("y1"))
    status = F.when(delta.isNull(), "zero_denominator").when(least < 10, "sparse").otherwise("ok")
    return out.select("policy", "capacity", F.col("k").alias("selected"), "n1", "n0", "y1", "y0", delta.alias("delta"), (10000 * F.col("k") / F.lit(float(n)) * delta).alias("gain"), status.alias("status"))
