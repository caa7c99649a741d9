"""Assignment by hash, tests on aggregates, and planning grids; every test works on many series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import HALF, count_where, hash16, wilson

#: Fixed value: the 97.5% point of the normal distribution.
Z = 1.959963984540054


def assign(users: DataFrame, experiment: Column, key: Column, prefix: str = "assign-v1|") -> DataFrame:
    """arm: 1 for the upper half of the hash range of (experiment, key)."""
    return users.withColumn("arm", (hash16(prefix, experiment, "|", key) >= HALF).cast("int"))


def key_checks(users: DataFrame, key: str) -> DataFrame:
    """Keys that are not 64 hexadecimal digits, are missing, or come twice."""
    k = F.col(key)
    return users.agg(F.count("*").alias("rows"), count_where(k.isNull() | (k == "")).alias("missing"), count_where(~k.rlike(r"\A[0-9a-f]{64}\z")).alias("malformed"), (F.count(k) - F.countDistinct(k)).alias("repeated"))


def arm_counts(rows: DataFrame, by: list[str], outcome: Column) -> DataFrame:
    """n and k of both arms in one row for each series."""
    one, zero = F.col("arm") == 1, F.col("arm") == 0
    return rows.groupBy(*by).agg(count_where(one).alias("n1"), count_where(zero).alias("n0"), count_where(one & outcome).alias("k1"), count_where(zero & outcome).alias("k0"))


def srm(counts: DataFrame) -> DataFrame:
    """Chi-square of one degree for equal arms; `flag` above the 0.001 point."""
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    chi = F.when(n1 + n0 > 0, (n1 - n0) * (n1 - n0) / (n1 + n0))
    return counts.withColumn("chi_square", chi).withColumn("srm_status", F.when(F.col("chi_square").isNull(), "empty").when(F.col("chi_square") > 10.827566170662733, "flag").otherwise("ok"))


def test_proportions(counts: DataFrame, sparse_below: int = 10) -> DataFrame:
    """Unpooled Wald test of two rates: states first, then difference, SE, z and interval where ok."""
    n1, n0, k1, k0 = (F.col(c).cast("double") for c in ("n1", "n0", "k1", "k0"))
    p1, p0 = k1 / F.when(n1 > 0, n1), k0 / F.when(n0 > 0, n0)
    least = F.least(F.col("k1"), F.col("n1") - F.col("k1"), F.col("k0"), F.col("n0") - F.col("k0"))
    variance = p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0
    status = F.when((n1 == 0) | (n0 == 0), "empty_group").when((n1 < 2) | (n0 < 2), "insufficient_n").when(least < sparse_below, "sparse_cells").when(variance <= 0, "zero_variance").otherwise("ok")
    out = counts.withColumns({"p1": p1, "p0": p0, "status": status, "difference": p1 - p0, "se_": F.sqrt(variance)})
    ok = F.col("status") == "ok"
    d, se = F.col("difference"), F.col("se_")
    return out.withColumns({
        "difference_pp": d * 100, "per_10k": d * 10000, "relative": F.when(F.col("p0") > 0, d / F.col("p0")), "se": F.when(ok, se), "z": F.when(ok, d / se),
        "ci_low": F.when(ok, d - Z * se), "ci_high": F.when(ok, d + Z * se),
    }).drop("se_")


def arm_moments(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    arm = lambda a: F.when(F.col("arm") == a, value)
    return rows.groupBy(*by).agg(*[x for a in (1, 0) for x in (F.count(arm(a)).alias(f"n{a}"), F.avg(arm(a)).alias(f"m{a}"), F.var_samp(arm(a)).alias(f"v{a}"))])


def test_welch(moments: DataFrame) -> DataFrame:
    """Welch's t and its degrees of freedom."""
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    status = F.when((F.col("n1") == 0) | (F.col("n0") == 0), "empty_group").when((F.col("n1") < 2) | (F.col("n0") < 2), "insufficient_n").when(a + b <= 0, "zero_variance").otherwise("ok")
    out = moments.withColumns({"status": status, "difference": F.col("m1") - F.col("m0")})
    ok = F.col("status") == "ok"
    df = (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))
    return out.withColumns({"se": F.when(ok, F.sqrt(a + b)), "t": F.when(ok, F.col("difference") / F.sqrt(a + b)), "df": F.when(ok, df)})


def test_ratio_delta(rows: DataFrame, by: list[str], num: Column, den: Column) -> DataFrame:
    """Difference of ratios of sums between arms, with the delta-method standard error."""
    parts = []
    for a in (1, 0):
        x, y = F.when(F.col("arm") == a, num), F.when(F.col("arm") == a, den)
        parts += [F.count(x).alias(f"n{a}"), F.avg(x).alias(f"x{a}"), F.avg(y).alias(f"y{a}"), F.var_samp(x).alias(f"vx{a}"), F.var_samp(y).alias(f"vy{a}"), F.covar_samp(x, y).alias(f"c{a}")]
    m = rows.groupBy(*by).agg(*parts)
    r = lambda a: F.col(f"x{a}") / F.col(f"y{a}")
    v = lambda a: (F.col(f"vx{a}") + r(a) * r(a) * F.col(f"vy{a}") - 2 * r(a) * F.col(f"c{a}")) / (F.col(f"n{a}") * F.col(f"y{a}") * F.col(f"y{a}"))
    return m.select(*by, r(1).alias("ratio1"), r(0).alias("ratio0"), (r(1) - r(0)).alias("difference"), F.sqrt(v(1) + v(0)).alias("se"))


#: Two-sided normal points of p = 0.01, 0.05, 0.1 and 0.5.
P_POINTS = (("001", 2.5758293035489004), ("005", Z), ("01", 1.6448536269514722), ("05", 0.6744897501960817))


def critical(point: float, df: Column) -> Column:
    """The two-sided point of Student's t for a normal one, to second order in 1 / df; df null: the normal point itself."""
    z = point
    first, second = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    return F.lit(z) + F.coalesce(F.lit(first) / df + F.lit(second) / (df * df), F.lit(0.0))


def aa_audit(users: DataFrame, key: str, outcome: Column, amount: Column, experiments: int) -> DataFrame:
    """Many assignments of the same users, each tested on a rate and on an amount: two rows an experiment.

    The ids are a parameter, so the product grows with the users alone; it is summed by
    experiment before anything is shuffled.  statistic is Wald's z (df null) or Welch's t.
    """
    ids = F.explode(F.sequence(F.lit(0), F.lit(experiments - 1)))
    each = assign(users.select(key, outcome.alias("outcome"), amount.alias("amount"), ids.alias("experiment")), F.col("experiment"), F.col(key))
    one, zero = F.col("arm") == 1, F.col("arm") == 0
    arm = lambda c: F.when(F.col("arm") == c, F.col("amount"))
    sums = each.groupBy("experiment").agg(
        count_where(one).alias("n1"), count_where(zero).alias("n0"), count_where(one & F.col("outcome")).alias("k1"), count_where(zero & F.col("outcome")).alias("k0"),
        *[x for c in (1, 0) for x in (F.avg(arm(c)).alias(f"m{c}"), F.var_samp(arm(c)).alias(f"v{c}"))],
    )
    counts = srm(sums)
    shared = ["experiment", "n1", "n0", "srm_status", "status", "difference", "se"]
    rate = test_proportions(counts).select(*shared, F.col("z").alias("statistic"), F.lit(None).cast("double").alias("df"), F.lit("rate").alias("metric"))
    mean = test_welch(counts).select(*shared, F.col("t").alias("statistic"), "df", F.lit("amount").alias("metric"))
    return rate.unionByName(mean)


def aa_summary(audit: DataFrame) -> DataFrame:
    """For each metric, over all experiments and over those that pass SRM: false positives by sign with a Wilson interval,
    quantiles of the difference, how often the interval covers zero, a histogram of p by its points, and failures."""
    scoped = audit.select("*", F.explode(F.when(F.col("srm_status") == "ok", F.array(F.lit("all"), F.lit("srm_pass"))).otherwise(F.array(F.lit("all")))).alias("scope"))
    ok, size = F.col("status") == "ok", F.abs(F.col("statistic"))
    point = {name: critical(z, F.col("df")) for name, z in P_POINTS}
    up, down = ok & (F.col("statistic") > point["005"]), ok & (F.col("statistic") < -point["005"])
    covered = ok & (F.abs(F.col("difference")) <= point["005"] * F.col("se"))
    held = F.when(ok, F.col("difference"))
    out = scoped.groupBy("metric", "scope").agg(
        F.count("*").alias("attempted"), count_where(ok).alias("experiments"), count_where(up).alias("rejected_up"), count_where(down).alias("rejected_down"), count_where(~ok).alias("failures"), count_where(F.col("srm_status") == "flag").alias("srm_flags"),
        *[F.percentile(held, F.lit(q)).alias(name) for name, q in (("difference_q025", 0.025), ("difference_median", 0.5), ("difference_q975", 0.975))], count_where(covered).alias("zero_covered"),
        count_where(ok & (size > point["001"])).alias("p_0_001"), count_where(ok & (size <= point["001"]) & (size > point["005"])).alias("p_001_005"), count_where(ok & (size <= point["005"]) & (size > point["01"])).alias("p_005_01"),
        count_where(ok & (size <= point["01"]) & (size > point["05"])).alias("p_01_05"), count_where(ok & (size <= point["05"])).alias("p_05_1"),
    )
    rejected, n = F.col("rejected_up") + F.col("rejected_down"), F.when(F.col("experiments") > 0, F.col("experiments"))
    low, high = wilson(rejected, F.col("experiments"))
    return out.withColumns({"fpr": rejected / n, "fpr_low": low, "fpr_high": high, "zero_coverage": F.col("zero_covered") / n})


def assignment_overlap(users: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """The 2x2 table of two assignments and their correlation."""
    both = assign(assign(users, F.lit(a), F.col(key)).withColumnRenamed("arm", "arm_a"), F.lit(b), F.col(key)).withColumnRenamed("arm", "arm_b")
    cell = lambda x, y: count_where((F.col("arm_a") == x) & (F.col("arm_b") == y)).alias(f"n{x}{y}")
    return both.agg(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1), F.corr("arm_a", "arm_b").alias("phi"))


def itt_counts(rows: DataFrame, outcomes: list[str]) -> DataFrame:
    """Records, outcomes and labels that are not 0 or 1, by arm, in one scan."""
    return rows.groupBy("treatment").agg(F.count("*").alias("n"), *[F.sum(o).cast("long").alias(o) for o in outcomes], *[count_where(~F.col(o).isin(0, 1)).alias(f"{o}_invalid") for o in outcomes])


def itt_effects(counts: DataFrame, outcomes: list[str], described: list[str] = ()) -> DataFrame:
    """Effects of being assigned, one row for each outcome.

    What happens after the assignment, such as exposure, is only described: rates and their
    difference, no test.
    """
    long = counts.unpivot(["treatment", "n"], [*outcomes, *described], "metric", "k")
    by = lambda t, c: F.max(F.when(F.col("treatment") == t, F.col(c)))
    wide = long.groupBy("metric").agg(by(1, "n").alias("n1"), by(0, "n").alias("n0"), by(1, "k").alias("k1"), by(0, "k").alias("k0"))
    tested = test_proportions(wide, sparse_below=5)
    told = tested.withColumns({"per_10k_low": F.col("ci_low") * 10000, "per_10k_high": F.col("ci_high") * 10000})
    after = F.col("metric").isin(*described) if described else F.lit(False)
    unsaid = ("per_10k", "relative", "se", "z", "ci_low", "ci_high", "per_10k_low", "per_10k_high")
    return told.withColumns({"status": F.when(after, "descriptive_post_treatment_only").otherwise(F.col("status")), **{c: F.when(~after, F.col(c)) for c in unsaid}})


def inject_effect(rows: DataFrame, key: str, outcome: str, base: float, effect: float, prefix: str = "inject-v1|") -> DataFrame:
    """A planted effect: zeros of arm 1 become ones where the key's hash is below a share that adds `effect`.

    A one never turns back.  The truth stands beside the outcome as `planted`.
    """
    share = effect / (1 - base)
    below = f"{min(int(share * 2**64), 2**64 - 1):016x}"
    planted = (F.col("arm") == 1) & (F.col(outcome) == 0) & (hash16(prefix, F.col(key)) < below)
    return rows.withColumn("planted", planted).withColumn("injected", F.when(planted, 1).otherwise(F.col(outcome)))


def planted_estimates(planted: DataFrame, outcome: str) -> DataFrame:
    """scenario (none, planted): the test of each outcome beside the truth, from rows of inject_effect; two rows.

    truth: what was planted, as a share of arm 1; error: the estimate less the truth; covered: whether the interval holds
    the truth; increment: how much the planted estimate exceeds the other, which is the truth exactly.
    """
    arm = lambda a: F.col("arm") == a
    told = planted.agg(*[x for a in (1, 0) for x in (count_where(arm(a)).alias(f"n{a}"), count_where(arm(a) & (F.col(outcome) == 1)).alias(f"x{a}"), count_where(arm(a) & (F.col("injected") == 1)).alias(f"z{a}"))], count_where(F.col("planted")).alias("flips"))
    one = lambda name, k, flips: F.struct(F.lit(name).alias("scenario"), F.col(f"{k}1").alias("k1"), F.col(f"{k}0").alias("k0"), flips.alias("k_planted"))
    long = told.select("n1", "n0", F.explode(F.array(one("none", "x", F.lit(0).cast("long")), one("planted", "z", F.col("flips")))).alias("s")).select("n1", "n0", "s.*")
    out = test_proportions(long).withColumn("truth", F.col("k_planted") / F.when(F.col("n1") > 0, F.col("n1")).cast("double"))
    first = F.max(F.when(F.col("scenario") == "none", F.col("difference"))).over(Window.partitionBy())  # two rows
    return out.withColumns({"error": F.col("difference") - F.col("truth"), "covered": (F.col("ci_low") <= F.col("truth")) & (F.col("truth") <= F.col("ci_high")), "increment": F.col("difference") - first})


def segment_sample_size(rates: DataFrame, mdes: list[float]) -> DataFrame:
    """Users an arm needs to find relative changes at 5% and 80% power, for each segment's rate."""
    p = F.col("rate")
    q = p * (1 + F.col("mde"))
    ok = (p > 0) & (p < 1) & (q < 1)
    n = F.ceil(F.lit((Z + 0.8416212335729143) ** 2) * (p * (1 - p) + q * (1 - q)) / ((q - p) * (q - p)))
    grid = rates.withColumn("mde", F.explode(F.array(*map(F.lit, mdes))))
    return grid.withColumns({"status": F.when(ok, "ok").otherwise("invalid_rate"), "n_per_arm": F.when(ok, n.cast("long"))})


def coupon_break_even(rates: DataFrame, burdens: list[float]) -> DataFrame:
    """Lift of the rate that pays for a coupon of a share k of the value: k / (1 - k)."""
    k = F.col("burden")
    grid = rates.withColumn("burden", F.explode(F.array(*map(F.lit, burdens))))
    return grid.withColumns({"break_even_lift": k / (1 - k), "break_even_rate": F.col("rate") / (1 - k), "status": F.when(F.col("rate") / (1 - k) <= 1, "attainable").otherwise("unattainable")})
