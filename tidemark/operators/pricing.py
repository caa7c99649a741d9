"""Price pairs of the same product, date-standardised comparison, margins, and basket fees."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import resample
from ..functions.columns import count_where

FLAGS = ("paths_ok", "users_ok", "days_ok", "coverage_ok", "gap_ok")


def exclusions(paths: DataFrame) -> DataFrame:
    """Paths by price state; states without paths are zeros."""
    state = F.when(F.col("price").isNull(), "missing").when(F.col("price") < 0, "negative").when(F.col("price") == 0, "zero").otherwise("usable")
    spine = paths.sparkSession.createDataFrame([(s,) for s in ("missing", "negative", "zero", "usable")], "state string")
    return F.broadcast(spine).join(paths.groupBy(state.alias("state")).agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def support(paths: DataFrame) -> DataFrame:
    """Paths, users and days of each product and price, the price's rank and the product's total; outcomes have no part."""
    counts = paths.groupBy("product_id", "price").agg(F.count("*").alias("paths"), F.countDistinct("user_id").alias("users"), F.countDistinct("day").alias("days"))
    rank = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("paths"), "price"))
    return counts.withColumns({"price_rank": rank, "total_paths": F.sum("paths").over(Window.partitionBy("product_id"))})


def pairs(support_: DataFrame, min_paths: int, min_users: int, min_days: int, coverage: str = "0.70", gap: tuple[str, str] = ("0.02", "0.30")) -> DataFrame:
    """The two best supported prices of each product that has two, and which of five conditions both of them meet."""
    side = F.struct("price", "paths", "users", "days")
    two = support_.where("price_rank <= 2").groupBy("product_id").agg(F.array_sort(F.collect_list(side)).alias("side"), F.first("total_paths").alias("total_paths")).where(F.size("side") == 2)
    every = lambda field, least: F.forall("side", lambda x: x[field] >= least)
    smaller = lambda field: F.array_min(F.transform("side", lambda x: x[field]))
    low, high, both = F.col("side")[0]["price"], F.col("side")[1]["price"], F.col("side")[0]["paths"] + F.col("side")[1]["paths"]
    share = lambda text: F.lit(text).cast("decimal(4,2)")
    return two.select(
        "product_id", low.alias("low_price"), high.alias("high_price"), *[smaller(f).alias(f"min_{f}") for f in ("paths", "users", "days")], both.alias("pair_paths"), "total_paths",
        every("paths", min_paths).alias("paths_ok"), every("users", min_users).alias("users_ok"), every("days", min_days).alias("days_ok"),
        (both >= share(coverage) * F.col("total_paths")).alias("coverage_ok"), (high - low).between(share(gap[0]) * high, share(gap[1]) * high).alias("gap_ok"),
    )


def feasibility(pairs_: DataFrame) -> DataFrame:
    """How many pairs meet each condition, alone and with all before it."""
    aggs, so_far = [], F.lit(True)
    for k, f in enumerate(FLAGS):
        so_far = so_far & F.col(f)
        aggs.append(F.struct(F.lit(k).alias("step"), F.lit(f).alias("flag"), count_where(F.col(f)).alias("alone"), count_where(so_far).alias("cumulative")))
    return pairs_.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def candidates(pairs_: DataFrame, k: int) -> DataFrame:
    met = pairs_
    for f in FLAGS:
        met = met.where(F.col(f))
    return met.orderBy(F.desc("min_users"), F.desc("min_paths"), "product_id").limit(k)


def _sides(paths: DataFrame, chosen: DataFrame) -> DataFrame:
    told = F.broadcast(chosen.select("product_id", "low_price", "high_price"))
    side = F.when(F.col("price") == F.col("low_price"), "low").when(F.col("price") == F.col("high_price"), "high")
    return paths.join(told, "product_id").withColumn("side", side).where("side is not null")


def pair_support(paths: DataFrame, chosen: DataFrame) -> DataFrame:
    return _sides(paths, chosen).groupBy("product_id", "side").agg(F.count("*").alias("paths"), F.countDistinct("user_id").alias("users"), count_where(F.col("success")).alias("successes"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def compact(paths: DataFrame, chosen: DataFrame) -> DataFrame:
    """Paths and successes of each user, date and side: all that comparison and resampling need."""
    return _sides(paths, chosen).groupBy("product_id", "user_id", "day", "side").agg(F.count("*").alias("n"), count_where(F.col("success")).alias("y"))


def compare(compact_: DataFrame, min_paths: int = 10, min_days: int = 3) -> DataFrame:
    """Raw and date-standardised rates of both prices over their common dates."""
    low, high = F.col("side") == "low", F.col("side") == "high"
    s = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    days = compact_.groupBy("product_id", "day").agg(s("n", low).alias("nl"), s("n", high).alias("nh"), s("y", low).alias("yl"), s("y", high).alias("yh"))
    raw = days.groupBy("product_id").agg(*[F.sum(c).cast("double").alias(f"all_{c}") for c in ("nl", "nh", "yl", "yh")])
    common = days.where((F.col("nl") >= min_paths) & (F.col("nh") >= min_paths))
    weight = (F.col("nl") + F.col("nh")) / F.sum(F.col("nl") + F.col("nh")).over(Window.partitionBy("product_id")).cast("double")
    weighted = common.withColumn("w", weight).groupBy("product_id").agg(F.count("*").alias("common_days"), F.sum(F.col("w") * F.col("yl") / F.col("nl")).alias("std_low"), F.sum(F.col("w") * F.col("yh") / F.col("nh")).alias("std_high"))
    out = raw.join(weighted, "product_id", "left").withColumn("common_days", F.coalesce("common_days", F.lit(0)).cast("long"))
    ok = F.col("common_days") >= min_days
    return out.select(
        "product_id", "common_days", F.round(F.try_divide("all_yl", "all_nl"), 6).alias("raw_low"), F.round(F.try_divide("all_yh", "all_nh"), 6).alias("raw_high"), F.round(F.when(ok, F.col("std_low")), 6).alias("std_low"), F.round(F.when(ok, F.col("std_high")), 6).alias("std_high"),
        F.round(F.when(ok, 100 * (F.col("std_low") - F.col("std_high"))), 4).alias("difference_pp"), F.when(ok, "defined").otherwise("date_comparison_not_supported").alias("status"),
    )


def cluster_bootstrap(compact_: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """Intervals of the raw difference by Poisson weights of users, the same over all dates and both prices.

    A user's weight in a repetition is a hash of (seed, block of repetitions, user), so sums by
    product and repetition need no gathering of a product's users and are added up before any shuffle.
    """
    lanes = range(resample.LANES)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-repetitions // resample.LANES) - 1))).alias("block")
    rows = compact_.select("product_id", "user_id", "side", "n", "y", blocks).withColumn("h", resample.block_hash(seed, F.col("block"), F.col("user_id")))
    rows = rows.select("product_id", "block", "side", "n", "y", *[resample.digits(F.col("h"), k).alias(f"d{k}") for k in lanes])
    rows = rows.select("product_id", "block", "side", "n", "y", *[resample.poisson_one(F.col(f"d{k}")).alias(f"w{k}") for k in lanes])
    total = lambda side, c, k: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c) * F.col(f"w{k}"))), F.lit(0)).cast("double")
    sums = rows.groupBy("product_id", "block").agg(*[F.struct(F.lit(k).alias("lane"), total("low", "n", k).alias("nl"), total("high", "n", k).alias("nh"), total("low", "y", k).alias("yl"), total("high", "y", k).alias("yh")).alias(f"x{k}") for k in lanes])
    drawn = sums.select("product_id", "block", F.explode(F.array(*[F.col(f"x{k}") for k in lanes])).alias("x")).select("product_id", "block", "x.*").where(F.col("block") * resample.LANES + F.col("lane") < repetitions)
    drawn = drawn.withColumn("difference", F.try_divide("yl", "nl") - F.try_divide("yh", "nh"))
    return drawn.groupBy("product_id").agg(F.percentile("difference", F.lit(0.025)).alias("ci_low"), F.percentile("difference", F.lit(0.975)).alias("ci_high"), F.count_if(F.col("difference").isNull()).alias("invalid"))


def margin_threshold(compared: DataFrame, gaps: DataFrame, margins: list[float]) -> DataFrame:
    """What the lower price must sell to pay for itself, for each margin: m / (m - d)."""
    m, d = F.col("m"), F.col("d")
    grid = compared.join(F.broadcast(gaps), "product_id").withColumn("m", F.explode(F.array(*map(F.lit, margins))))
    need = F.when(m > d, F.try_divide(m, m - d))
    low = F.col("std_high") * need
    status = F.when(m <= d, "unit_contribution_nonpositive").when(F.col("std_high") == 0, "zero_high_rate_no_relative_threshold").when(low > 1, "required_probability_unattainable").otherwise("defined")
    return grid.select("product_id", "m", F.round("d", 6).alias("d"), F.round(F.when(F.col("std_high") > 0, need), 6).alias("required_rate_ratio"), F.round(F.when(F.col("std_high") > 0, low), 6).alias("required_low_rate"), F.round(F.col("std_low") * (m - d) - F.col("std_high") * m, 6).alias("contribution_difference"), status.alias("status"))


#: The six ways to handle a fee for each category of a basket, as
#: (name, whether the fee is due, share of it that the price takes on, goods added, categories added).
STRATEGIES = (
    ("REFERENCE", 0, "none", False, 0),
    ("ABSORB", 1, "none", False, 0),
    ("PASS_HALF", 1, "half", False, 0),
    ("PASS_FULL", 1, "full", False, 0),
    ("ADD_SAME_CATEGORY", 1, "none", True, 0),
    ("ADD_NEW_CATEGORY", 1, "none", True, 1),
)


def basket_strategies(baskets: DataFrame, fee: str = "3", half: str = "0.50", add_factor: str = "1.25", add_fulfilment: str = "5") -> DataFrame:
    """Unit contribution of each basket (basket_id, s0, m0, h, l0; decimals) under each strategy, in decimals.

    One formula serves all: goods times their factor plus the fee that the price takes on, less
    the goods' cost at margin m0, the fulfilment and the fee for each category.  Added goods have
    a factor and a fulfilment cost of their own.
    """
    exact = lambda text: Decimal(text).quantize(Decimal("0.01"))
    taken = {"none": "0", "half": half, "full": "1"}
    rows = [(name, exact(fee) * due, exact(taken[share]), exact(add_factor if added else "1"), exact(add_fulfilment) if added else None, more) for name, due, share, added, more in STRATEGIES]
    table = baskets.sparkSession.createDataFrame(rows, "strategy string, fee decimal(6,2), taken decimal(4,2), factor decimal(4,2), fulfilment decimal(9,2), more int")
    each = baskets.crossJoin(F.broadcast(table))  # six rows
    goods = (F.col("s0") * F.col("factor")).cast("decimal(26,7)")
    price = (goods + (F.col("fee") * F.col("taken")).cast("decimal(12,4)") * F.col("h")).cast("decimal(26,7)")
    charge = (F.col("fee") * (F.col("h") + F.col("more"))).cast("decimal(18,2)")
    cost = (goods * (1 - F.col("m0")).cast("decimal(4,2)")).cast("decimal(30,9)")
    left = (price - cost - F.coalesce("fulfilment", "l0") - charge).cast("decimal(30,9)")
    return each.select("basket_id", "strategy", price.alias("s"), charge.alias("charge"), left.alias("contribution"))


def basket_thresholds(contributions: DataFrame, retention: list[float]) -> DataFrame:
    """How much of the demand each strategy must keep against the reference, and whether grid values do."""
    ref = contributions.where("strategy = 'REFERENCE'").select("basket_id", F.col("contribution").alias("reference"))
    joined = contributions.where("strategy <> 'REFERENCE'").join(ref, "basket_id").withColumn("retention", F.explode(F.array(*map(F.lit, retention))))
    a, b = F.col("reference").cast("double"), F.col("contribution").cast("double")
    r = F.when((a > 0) & (b > 0), F.try_divide(a, b))
    status = F.when(a <= 0, "reference_nonpositive").when(b <= 0, "strategy_nonpositive").when(r <= 1, "decline_bound_or_no_decline").otherwise("lift_required")
    return joined.select("basket_id", "strategy", "retention", F.round(r, 6).alias("required_ratio"), status.alias("status"), F.round(F.col("retention") * b - a, 4).alias("contribution_change"))
