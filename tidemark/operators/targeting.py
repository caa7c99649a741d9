"""Splits, group rules, treatment policies at fixed capacity, and their evaluation."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import resample
from ..functions.columns import FOUR_FIFTHS, TENTH, THREE_FIFTHS, count_where, hash16, ratio
from ..functions.quantiles import exact_quantiles
from ..sources.scratch import hold

CAPACITIES = (10, 20, 30, 50, 100)
POLICIES = ("random", "response", "incremental")


def row_identity(rows: DataFrame, key: list[str], order: list[str], source: str) -> DataFrame:
    """row_id: a hash of the key and the row's place among rows of that key, so equal rows get ids of their own."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("row_id", F.sha2(F.concat_ws("|", F.lit("row-v2"), F.lit(source), *key, nth.cast("string")), 256))


def split(rows: DataFrame, seed: str = "split-v1") -> DataFrame:
    """train, valid or test (60/20/20) by a hash of seed, arm and id; features and outcomes have no part in it."""
    h = hash16(f"{seed}|", F.col("treatment"), "|", F.col("row_id"))
    return rows.withColumn("split", F.when(h < THREE_FIFTHS, "train").when(h < FOUR_FIFTHS, "valid").otherwise("test"))


def split_qc(rows: DataFrame, shares: dict[str, float] | None = None, slack: float = 0.02) -> DataFrame:
    """Size, outcomes, rate and share of each split, by arm and in all (arm -1), and whether the share is as declared."""
    shares = shares or {"train": 0.6, "valid": 0.2, "test": 0.2}
    fine = rows.groupBy("split", "treatment").agg(F.count("*").alias("n"), F.sum("conversion").alias("conversions"))  # six rows
    parts = fine.groupingSets([["split"], ["split", "treatment"]], "split", "treatment").agg(F.grouping("treatment").alias("all"), F.sum("n").alias("n"), F.sum("conversions").cast("long").alias("conversions"))
    parts = parts.select("split", F.when(F.col("all") == 1, -1).otherwise(F.col("treatment")).alias("treatment"), "n", "conversions")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("treatment")).cast("double")
    due = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v))])[F.col("split")]
    return parts.withColumns({"rate": F.round(F.col("conversions") / F.col("n"), 6), "share": F.round(share, 6), "share_ok": F.abs(share - due) <= slack})


def early_stop(rows: DataFrame) -> DataFrame:
    """A tenth of the training rows, by another hash."""
    return rows.where("split = 'train'").withColumn("early_stop", hash16("early-v1|", F.col("row_id")) < TENTH)


def align_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Records joined to a membership table, with what does not match counted.

    Where both were written in equal buckets of row_id, the join reads bucket by bucket and nothing is shuffled.
    """
    told = members.select("row_id", F.col("treatment").alias("member_treatment"), "split")
    both = rows.join(told, "row_id", "full_outer")
    here, there = F.col("treatment").isNotNull(), F.col("split").isNotNull()
    return both.agg(F.count("*").alias("rows"), count_where(here & ~there).alias("without_member"), count_where(there & ~here).alias("without_record"), count_where(here & there & (F.col("treatment") != F.col("member_treatment"))).alias("arm_mismatch"))


def train_cuts(rows: DataFrame, features: list[str]) -> DataFrame:
    """Quartiles of each feature on train, without repeats and without the ends of its range: a row a feature."""
    held = rows.where("split = 'train'")
    found = exact_quantiles(held, features, [0.25, 0.5, 0.75])
    ends = held.agg(*[x for f in features for x in (F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"))]).collect()[0]  # a second look at two columns
    cuts = [(f, sorted({q for q in found[f] if q is not None and ends[f"lo_{f}"] < q < ends[f"hi_{f}"]})) for f in features]
    return rows.sparkSession.createDataFrame(cuts, "feature string, cuts array<double>")


def bin_group(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """group_id = 4 * bin(f0) + bin(f1), bins closed on the right; cuts are two short lists."""
    one = cuts.groupBy().agg(F.max(F.when(F.col("feature") == "f0", F.col("cuts"))).alias("c0"), F.max(F.when(F.col("feature") == "f1", F.col("cuts"))).alias("c1"))
    place = lambda f, c: F.size(F.filter(c, lambda x: x < F.col(f)))
    return rows.crossJoin(F.broadcast(one)).withColumn("group_id", place("f0", "c0") * 4 + place("f1", "c1")).drop("c0", "c1")


def group_rates(grouped: DataFrame, support: int) -> DataFrame:
    """For each of 16 groups the rates of both arms; groups of little support take the whole table's scores.

    The response score is the rate without treatment, the incremental score what treatment adds to it.
    score_y1 / score_n1 and score_y0 / score_n0 are the rates that the scores rest on.
    """
    train = grouped.where("split = 'train'")
    t, y = F.col("treatment"), F.col("conversion")
    names = ["n1", "n0", "y1", "y0"]
    aggs = [count_where(t == 1).alias("n1"), count_where(t == 0).alias("n0"), count_where((t == 1) & (y == 1)).alias("y1"), count_where((t == 0) & (y == 1)).alias("y0")]
    spine = grouped.sparkSession.range(16).select(F.col("id").cast("int").alias("group_id"))
    joined = spine.join(train.groupBy("group_id").agg(*aggs).withColumn("seen", F.lit(True)), "group_id", "left").fillna(0, names)
    joined = joined.select("*", *[F.sum(c).over(Window.partitionBy()).alias(f"all_{c}") for c in names])  # 16 rows
    fallback = F.least("n1", "n0") < support
    reason = F.when(F.col("seen").isNull(), "unobserved").when(fallback, "low_support").otherwise("own_rates")
    told = joined.select("group_id", *names, fallback.alias("fallback"), reason.alias("reason"), *[F.when(fallback, F.col(f"all_{c}")).otherwise(F.col(c)).alias(f"score_{c}") for c in names])
    rate = lambda a: F.col(f"score_y{a}") / F.when(F.col(f"score_n{a}") > 0, F.col(f"score_n{a}")).cast("double")
    return told.withColumns({"response_score": F.round(rate(0), 9), "incremental_score": F.round(rate(1) - rate(0), 9)})


def score_ranks(rates: DataFrame) -> DataFrame:
    """Dense ranks of both scores, best first, of the 16 groups: scores are compared as fractions, so only equal ones tie."""
    rows = rates.collect()  # a row a group: parameters from here on
    rate = lambda r, a: Fraction(r[f"score_y{a}"], r[f"score_n{a}"]) if r[f"score_n{a}"] else Fraction(-1)
    ranks = []
    for scores in ([rate(r, 0) for r in rows], [rate(r, 1) - rate(r, 0) for r in rows]):
        best = sorted(set(scores), reverse=True)
        ranks.append([best.index(x) + 1 for x in scores])
    schema = StructType([*rates.schema.fields, StructField("response_rank", IntegerType()), StructField("incremental_rank", IntegerType())])
    return rates.sparkSession.createDataFrame([(*r, *both) for r, *both in zip(rows, *ranks, strict=True)], schema)


def apply_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Scores of held-out rows from frozen rules.  Outcomes travel along, as `outcome`, and order nothing."""
    told = rules.select("group_id", "response_rank", "incremental_rank", "fallback")
    sealed = rows.withColumn("outcome", F.struct("conversion", "visit")).drop("conversion", "visit")
    return sealed.join(F.broadcast(told), "group_id")


def tie_hash(row_id: str = "row_id") -> Column:
    """What orders rows of one score."""
    return F.sha2(F.concat(F.lit("target-v1|"), F.col(row_id)), 256)


def cell_digits(n: int, rows: int = 1 << 14) -> int:
    """Leading hexadecimal digits of the hash that leave about `rows` rows in a cell; four of them, 65,536 cells, at most."""
    return min(4, max(1, math.ceil(math.log(max(1, n / rows), 16))))


def policy_places(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """place_<policy>: each row's place in the total order of each policy, ties by hash (tie), then id; n_all: all rows.

    Ranks take few values and the hash is uniform, so (rank, hash) cuts into equal cells: a
    place is the number of rows in cells before, plus the place within the cell.  One aggregate
    counts the cells of all policies (a row a group and cell, so 16 x 65,536 at most), and
    all three places come from one exchange by cell.
    """
    digits = digits or cell_digits(scored.count())
    base = scored.withColumn("cell", F.conv(F.substring("tie", 1, digits), 16, 10).cast("int"))
    sizes = hold(base.groupBy("cell", "response_rank", "incremental_rank").agg(F.count("*").alias("n")))
    out = base.repartition("cell").crossJoin(F.broadcast(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"))))
    for policy in POLICIES:
        rank = F.lit(0) if policy == "random" else F.col(f"{policy}_rank")
        cells = sizes.groupBy(rank.alias("rank_"), "cell").agg(F.sum("n").alias("size_"))
        order = Window.orderBy("rank_", "cell").rowsBetween(Window.unboundedPreceding, -1)  # ranks x cells
        before = cells.select("rank_", "cell", F.coalesce(F.sum("size_").over(order), F.lit(0)).alias("before_"))
        inner = F.row_number().over(Window.partitionBy("cell", "rank_").orderBy("tie", "row_id"))
        out = out.withColumn("rank_", rank).join(F.broadcast(before), ["cell", "rank_"]).withColumn(f"place_{policy}", (inner + F.col("before_")).cast("long")).drop("rank_", "before_")
    return out.drop("cell")


def unseal(placed: DataFrame) -> DataFrame:
    """Outcomes as columns again, when all places are known."""
    return placed.select("*", "outcome.*").drop("outcome")


def capacity_masks(places: DataFrame, n: Column) -> DataFrame:
    """mask: a bit for each policy and capacity whose floor(c n / 100) best rows hold the row."""
    mask = F.lit(0).cast("long")
    for p, policy in enumerate(POLICIES):
        for c, capacity in enumerate(CAPACITIES):
            inside = F.col(f"place_{policy}") <= F.floor(n * capacity / 100)
            mask = mask + F.when(inside, F.lit(1 << (p * len(CAPACITIES) + c))).otherwise(F.lit(0))
    return places.withColumn("mask", mask)


def joint_types(masked: DataFrame) -> DataFrame:
    """Rows of each arm, outcome, mask and kind of score: all that the evaluations need, a few thousand rows at most."""
    return masked.groupBy("treatment", "conversion", "mask", "fallback").agg(F.count("*").alias("n"))


def coverage(types: DataFrame) -> DataFrame:
    """Rates and gain of each policy at each capacity, from joint types (a few thousand rows at most)."""
    cells = [F.struct(F.lit(policy).alias("policy"), F.lit(capacity).alias("capacity"), F.lit(1 << (p * len(CAPACITIES) + c)).alias("bit")) for p, policy in enumerate(POLICIES) for c, capacity in enumerate(CAPACITIES)]
    long = types.select("*", F.explode(F.array(*cells)).alias("x")).select("*", "x.*").where(F.col("mask").bitwiseAND(F.col("bit").cast("long")) != 0)
    s = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    t, y = F.col("treatment"), F.col("conversion")
    g = long.groupBy("policy", "capacity").agg(s(t == 1).alias("n1"), s(t == 0).alias("n0"), s((t == 1) & (y == 1)).alias("y1"), s((t == 0) & (y == 1)).alias("y0"), s(F.col("fallback")).alias("fallback_n"))
    whole = types.agg(F.sum("n").alias("whole"))
    delta = F.col("y1") / F.when(F.col("n1") > 0, F.col("n1")).cast("double") - F.col("y0") / F.when(F.col("n0") > 0, F.col("n0")).cast("double")
    share = (F.col("n1") + F.col("n0")) / F.col("whole").cast("double")
    status = F.when((F.col("n1") == 0) | (F.col("n0") == 0), "zero_arm").when(F.least("y1", "y0") < 5, "sparse").otherwise("ok")
    return g.crossJoin(F.broadcast(whole)).select("policy", "capacity", "n1", "n0", "y1", "y0", F.round(delta, 6).alias("delta"), F.round(10000 * share * delta, 4).alias("gain"), F.round(F.col("n1") / (F.col("n1") + F.col("n0")), 6).alias("treatment_share"), "fallback_n", status.alias("status"))


def by_stratum(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """Counts of both arms by split and group (a row each) beside the frozen ranks; 32 rows, also of groups without records."""
    told = rules.select("group_id", "fallback", "reason", "response_rank", "incremental_rank", F.explode(F.array(F.lit("train"), F.lit("valid"))).alias("split"))
    return told.join(counts, ["split", "group_id"], "left").fillna(0, ["n1", "n0", "k1", "k0"])


def contrasts(coverage_: DataFrame) -> DataFrame:
    """Differences in gain between policies at the same capacity."""
    a, b = coverage_.select("capacity", F.col("policy").alias("a"), F.col("gain").alias("ga")), coverage_.select(F.col("capacity").alias("cap"), F.col("policy").alias("b"), F.col("gain").alias("gb"))
    return a.join(b, (F.col("capacity") == F.col("cap")) & (F.col("a") < F.col("b"))).select("capacity", "a", "b", F.round(F.col("ga") - F.col("gb"), 4).alias("gain_difference"))


def overlap(types: DataFrame) -> DataFrame:
    """Rows that two policies both choose, or either, at each capacity."""
    cells = []
    for i, a in enumerate(POLICIES):
        for j, b in enumerate(POLICIES):
            if i < j:
                for c, capacity in enumerate(CAPACITIES):
                    cells.append(F.struct(F.lit(capacity).alias("capacity"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(1 << (i * 5 + c)).alias("x"), F.lit(1 << (j * 5 + c)).alias("y")))
    long = types.select("n", "mask", F.explode(F.array(*cells)).alias("z")).select("n", "mask", "z.*")
    in_a, in_b = F.col("mask").bitwiseAND(F.col("x").cast("long")) != 0, F.col("mask").bitwiseAND(F.col("y").cast("long")) != 0
    s = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return long.groupBy("capacity", "a", "b").agg(s(in_a & in_b).alias("both"), s(in_a | in_b).alias("either")).withColumns({"rate": ratio(F.col("both"), F.col("either")), "identical": F.col("both") == F.col("either")})


def joint_bootstrap(types: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """policy, capacity, repetition, gain: paired resamples of the joint types, each a cell of like records.

    Weights come from a hash of (seed, block of repetitions, cell), so every run draws the same.  The
    types are a few thousand cells, whatever the number of records; all policies of a repetition share its weights.
    """
    cells = types.groupBy("treatment", "conversion", "mask").agg(F.sum("n").cast("long").alias("n"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-repetitions // resample.LANES) - 1))).alias("block")
    one_by_one = F.col("n") <= resample.FEW
    unit = F.explode(F.when(one_by_one, F.sequence(F.lit(1), F.col("n").cast("int"))).otherwise(F.array(F.lit(0)))).alias("unit")
    drawn = cells.select("*", unit).select("*", blocks).withColumn("h", resample.block_hash(seed, *map(F.col, ("block", "treatment", "conversion", "mask", "unit"))))
    # Stages, so that no digits, logarithms or roots are made anew for each place that they stand in.
    lanes = range(resample.LANES)
    drawn = drawn.withColumns({f"d{k}": resample.digits(F.col("h"), k) for k in lanes}).drop("h")
    drawn = drawn.withColumns({f"u{k}": F.when(~one_by_one, resample.uniform(F.col(f"d{k}"))) for k in lanes})
    drawn = drawn.withColumns({f"t{k}": resample.tail(F.col(f"u{k}")) for k in lanes})
    drawn = drawn.withColumns({f"z{k}": resample.normal_point(F.col(f"u{k}"), F.col(f"t{k}")) for k in lanes})
    drawn = drawn.select("block", "treatment", "conversion", "mask", *[F.when(one_by_one, resample.poisson_one(F.col(f"d{k}"))).otherwise(resample.poisson_many(F.col(f"z{k}"), F.col("n"))).alias(f"w{k}") for k in lanes])
    drawn = drawn.groupBy("block", "treatment", "conversion", "mask").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(resample.LANES)])
    drawn = drawn.select("block", "treatment", "conversion", "mask", F.posexplode(F.array(*[F.col(f"w{k}") for k in range(resample.LANES)])).alias("lane", "w"))
    drawn = drawn.withColumn("repetition", F.col("block") * resample.LANES + F.col("lane")).where(F.col("repetition") < repetitions)
    inside = lambda p, c: F.col("mask").bitwiseAND(F.lit(1 << (p * len(CAPACITIES) + c)).cast("long")) != 0
    t, y = F.col("treatment"), F.col("conversion")
    s = lambda when: F.coalesce(F.sum(F.when(when, F.col("w"))), F.lit(0)).cast("double")
    places_ = [(p, c) for p in range(len(POLICIES)) for c in range(len(CAPACITIES))]
    sums = drawn.groupBy("repetition").agg(*[F.struct(F.lit(POLICIES[p]).alias("policy"), F.lit(CAPACITIES[c]).alias("capacity"), s(inside(p, c) & (t == 1)).alias("n1"), s(inside(p, c) & (t == 0)).alias("n0"), s(inside(p, c) & (t == 1) & (y == 1)).alias("y1"), s(inside(p, c) & (t == 0) & (y == 1)).alias("y0")).alias(f"x{p}_{c}") for p, c in places_])
    # The share of all records is that of the capacity, not of the draw.
    share = cells.agg(F.sum("n").cast("double").alias("whole"), *[F.sum(F.when(inside(p, c), F.col("n"))).cast("double").alias(f"k{p}_{c}") for p, c in places_])
    share = share.select(F.explode(F.array(*[F.struct(F.lit(POLICIES[p]).alias("of"), F.lit(CAPACITIES[c]).alias("at"), (F.coalesce(F.col(f"k{p}_{c}"), F.lit(0.0)) / F.col("whole")).alias("share")) for p, c in places_])).alias("z")).select("z.*")
    long = sums.select("repetition", F.explode(F.array(*[F.col(f"x{p}_{c}") for p, c in places_])).alias("x")).select("repetition", "x.*")
    long = long.join(F.broadcast(share), (F.col("policy") == F.col("of")) & (F.col("capacity") == F.col("at")))
    gain = F.when((F.col("n1") > 0) & (F.col("n0") > 0), 10000 * F.col("share") * (F.try_divide("y1", "n1") - F.try_divide("y0", "n0")))
    return long.select("policy", "capacity", "repetition", gain.alias("gain"))


def bootstrap_intervals(draws: DataFrame) -> DataFrame:
    return draws.groupBy("policy", "capacity").agg(F.percentile("gain", F.lit(0.025)).alias("ci_low"), F.percentile("gain", F.lit(0.975)).alias("ci_high"), count_where(F.col("gain").isNull()).alias("invalid"))


def qini(rows: DataFrame, place: str, n: Column) -> DataFrame:
    """Q at 0 .. 100% of the order: y1 - y0 n1 / n0 over the prefix, beside the straight line.

    Rows fall into 101 buckets by place; the curve is a running sum over these.
    """
    bucket = F.ceil(F.col(place) * 100 / n).cast("int")
    t, y = F.col("treatment"), F.col("conversion")
    counted = rows.groupBy(bucket.alias("percent")).agg(count_where(t == 1).alias("n1"), count_where(t == 0).alias("n0"), count_where((t == 1) & (y == 1)).alias("y1"), count_where((t == 0) & (y == 1)).alias("y0"))
    spine = rows.sparkSession.range(101).select(F.col("id").cast("int").alias("percent"))
    run = Window.orderBy("percent").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 101 rows
    cum = spine.join(counted, "percent", "left").select("percent", *[F.coalesce(F.sum(c).over(run), F.lit(0)).cast("long").alias(c) for c in ("n1", "n0", "y1", "y0")])
    q = F.when(F.col("percent") == 0, F.lit(0.0)).when(F.col("n0") > 0, F.col("y1") - F.col("y0") * F.col("n1") / F.col("n0").cast("double"))
    line = F.last(q).over(Window.orderBy("percent").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.col("percent") / 100
    return cum.select("percent", "n1", "n0", "y1", "y0", F.round(q, 6).alias("q"), F.round(line, 6).alias("reference"), F.when(q.isNull(), "no_control_in_prefix").otherwise("defined").alias("status"))


def qini_area(curve: DataFrame) -> DataFrame:
    """Trapezoids between curve and line; null if the curve has a gap."""
    w = Window.orderBy("percent")
    gap = F.col("q") - F.col("reference")
    part = (gap + F.lag(gap).over(w)) / 200
    return curve.select(part.alias("part"), F.col("q").isNull().alias("gap")).agg(F.round(F.when(~F.bool_or("gap"), F.sum("part")), 6).alias("area"))


def factual_logloss(scored: DataFrame) -> DataFrame:
    """Mean log loss of `p` for the observed outcome, of the whole table's rate and of the arm's, by arm."""
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = lambda p: -(F.col("conversion") * F.ln(clip(p)) + (1 - F.col("conversion")) * F.ln(1 - clip(p)))
    whole = scored.agg(F.avg("conversion").alias("rate"))
    arms = scored.groupBy("treatment").agg(F.avg("conversion").alias("arm_rate"))
    told = scored.join(F.broadcast(arms), "treatment").crossJoin(F.broadcast(whole))
    return told.groupBy("treatment").agg(F.count("*").alias("n"), F.round(F.avg(loss(F.col("p"))), 6).alias("loss"), F.round(F.avg(loss(F.col("rate"))), 6).alias("constant_loss"), F.round(F.avg(loss(F.col("arm_rate"))), 6).alias("arm_loss"))
