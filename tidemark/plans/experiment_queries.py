"""Experiments over customers and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tails
from ..functions.columns import wilson
from ..operators import experiments as ex
from ..sources.scratch import hold
from ..sources.tables import EXPERIMENT_SQL, experiment, table
from .registry import query

_USERS_SQL = "u AS (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS key, c_acctbal AS balance, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal > 5000 AS rich FROM customer), a AS (SELECT *, CAST(substr(sha256('assign-v1|' || 'exp-1' || '|' || key), 1, 16) >= '8000000000000000' AS INTEGER) AS arm FROM u)"
_WALD_SQL = """CASE WHEN n1 = 0 OR n0 = 0 THEN 'empty_group' WHEN n1 < 2 OR n0 < 2 THEN 'insufficient_n' WHEN least(k1, n1 - k1, k0, n0 - k0) < {s} THEN 'sparse_cells' WHEN p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0 <= 0 THEN 'zero_variance' ELSE 'ok' END"""


def _users(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") > 5000).alias("rich"))


def _assigned(spark, sf_dir):
    return ex.assign(_users(spark, sf_dir), F.lit("exp-1"), F.col("key"))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"WITH {_USERS_SQL} SELECT key, arm FROM a")
def assign_hash(spark, sf_dir):
    return _assigned(spark, sf_dir).select("key", "arm")


@query(f"WITH {_USERS_SQL} SELECT count(*) AS rows, count(*) FILTER (key IS NULL OR key = '') AS missing, count(*) FILTER (NOT regexp_full_match(key, '[0-9a-f]{{64}}')) AS malformed, count(key) - count(DISTINCT key) AS repeated FROM u")
def assign_key_checks(spark, sf_dir):
    return ex.key_checks(_users(spark, sf_dir), "key")


_COUNTS_SQL = "count(*) FILTER (arm = 1) AS n1, count(*) FILTER (arm = 0) AS n0, count(*) FILTER (arm = 1 AND rich) AS k1, count(*) FILTER (arm = 0 AND rich) AS k0"


@query(f"WITH {_USERS_SQL}, c AS (SELECT segment, {_COUNTS_SQL} FROM a GROUP BY 1) SELECT segment, n1, n0, round((n1 - n0) * (n1 - n0) / CAST(n1 + n0 AS DOUBLE), 6) AS chi_square, CASE WHEN (n1 - n0) * (n1 - n0) / CAST(n1 + n0 AS DOUBLE) > 10.827566170662733 THEN 'flag' ELSE 'ok' END AS srm_status FROM c")
def srm(spark, sf_dir):
    counts = ex.arm_counts(_assigned(spark, sf_dir), ["segment"], F.col("rich"))
    return _rounded(ex.srm(counts), "chi_square").select("segment", "n1", "n0", "chi_square", "srm_status")


def _wald_sql(by: str, source: str, sparse: int) -> str:
    return f"""c AS ({source}), p AS (SELECT *, k1 / CAST(n1 AS DOUBLE) AS p1, k0 / CAST(n0 AS DOUBLE) AS p0 FROM c), s AS (SELECT *, {_WALD_SQL.format(s=sparse)} AS status, p1 - p0 AS d, sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) AS e FROM p)
SELECT {by}, n1, n0, k1, k0, status, round(p1, 6) AS p1, round(p0, 6) AS p0, round(d * 100, 6) AS difference_pp, round(CASE WHEN p0 > 0 THEN d / p0 END, 6) AS relative, round(CASE WHEN status = 'ok' THEN e END, 6) AS se, round(CASE WHEN status = 'ok' THEN d / e END, 6) AS z,
  round(CASE WHEN status = 'ok' THEN d - 1.959963984540054 * e END, 6) AS ci_low, round(CASE WHEN status = 'ok' THEN d + 1.959963984540054 * e END, 6) AS ci_high FROM s"""


_WALD = ["n1", "n0", "k1", "k0", "status", "p1", "p0", "difference_pp", "relative", "se", "z", "ci_low", "ci_high"]


@query(f"WITH {_USERS_SQL}, {_wald_sql('segment', f'SELECT segment, {_COUNTS_SQL} FROM a GROUP BY 1', 10)}")
def test_proportions(spark, sf_dir):
    counts = ex.arm_counts(_assigned(spark, sf_dir), ["segment"], F.col("rich"))
    return _rounded(ex.test_proportions(counts), "p1", "p0", "difference_pp", "relative", "se", "z", "ci_low", "ci_high").select("segment", *_WALD)


_MOMENTS_SQL = "count(balance) FILTER (arm = 1) AS n1, count(balance) FILTER (arm = 0) AS n0, avg(balance) FILTER (arm = 1) AS m1, avg(balance) FILTER (arm = 0) AS m0, var_samp(balance) FILTER (arm = 1) / count(*) FILTER (arm = 1) AS q1, var_samp(balance) FILTER (arm = 0) / count(*) FILTER (arm = 0) AS q0"


@query(f"WITH {_USERS_SQL}, m AS (SELECT segment, {_MOMENTS_SQL} FROM a GROUP BY 1) SELECT segment, n1, n0, 'ok' AS status, round(m1 - m0, 4) AS difference, round(sqrt(q1 + q0), 4) AS se, round((m1 - m0) / sqrt(q1 + q0), 4) AS t, round((q1 + q0) * (q1 + q0) / (q1 * q1 / (n1 - 1) + q0 * q0 / (n0 - 1)), 4) AS df FROM m")
def test_welch(spark, sf_dir):
    out = ex.test_welch(ex.arm_moments(_assigned(spark, sf_dir), ["segment"], F.col("balance")))
    return out.select("segment", "n1", "n0", "status", *[F.round(c, 4).alias(c) for c in ("difference", "se", "t", "df")])


@query(f"""WITH RECURSIVE {_USERS_SQL},
k AS (SELECT segment AS key, (n1_ - n0_) * (n1_ - n0_) / CAST(n1_ + n0_ AS DOUBLE) AS chi, (k1 / n1_ - k0 / n0_) / sqrt(k1 / n1_ * (1 - k1 / n1_) / n1_ + k0 / n0_ * (1 - k0 / n0_) / n0_) AS z, (m1 - m0) / sqrt(q1 + q0) AS t, (q1 + q0) * (q1 + q0) / (q1 * q1 / (n1 - 1) + q0 * q0 / (n0 - 1)) AS df, least(k1, n1_ - k1, k0, n0_ - k0) >= 10 AS enough
  FROM (SELECT segment, CAST(count(*) FILTER (arm = 1) AS DOUBLE) AS n1_, CAST(count(*) FILTER (arm = 0) AS DOUBLE) AS n0_, count(*) FILTER (arm = 1 AND rich) AS k1, count(*) FILTER (arm = 0 AND rich) AS k0, {_MOMENTS_SQL} FROM a GROUP BY 1)),
kc AS (SELECT key, sqrt(chi / 2) AS x FROM k), kz AS (SELECT key, CASE WHEN enough THEN abs(z) / sqrt(2.0::DOUBLE) END AS x FROM k), kt AS (SELECT key, df / 2 AS a, CAST(0.5 AS DOUBLE) AS b, df / (df + t * t) AS x FROM k),
{tails.erfc_sql("pc", "kc")}, {tails.erfc_sql("pz", "kz")}, {tails.incomplete_beta_sql("pt", "kt")}
SELECT k.key AS segment, round(pc.p, 9) AS p_srm, round(pz.p, 9) AS p_rate, round(pt.p, 9) AS p_mean FROM k LEFT JOIN pc USING (key) LEFT JOIN pz USING (key) LEFT JOIN pt USING (key)""")
def test_p_values(spark, sf_dir):
    """Tails of the three tests."""
    users = _assigned(spark, sf_dir)
    counts = ex.test_proportions(ex.srm(ex.arm_counts(users, ["segment"], F.col("rich"))))
    welch = ex.test_welch(ex.arm_moments(users, ["segment"], F.col("balance"))).select("segment", "t", "df")
    # A written table: the expansions repeat their arguments, which must not be counted anew each time.
    joined = hold(counts.join(welch, "segment").select("segment", "chi_square", "z", "t", "df"))
    return joined.select("segment", F.round(tails.chi_square_one("chi_square"), 9).alias("p_srm"), F.round(tails.normal_two_sided("z"), 9).alias("p_rate"), F.round(tails.student_two_sided("t", "df"), 9).alias("p_mean"))


_DELTA_SQL = "avg(x) FILTER (arm = {a}) AS x{a}, avg(y) FILTER (arm = {a}) AS y{a}, var_samp(x) FILTER (arm = {a}) AS vx{a}, var_samp(y) FILTER (arm = {a}) AS vy{a}, covar_samp(x, y) FILTER (arm = {a}) AS c{a}, count(*) FILTER (arm = {a}) AS n{a}"
_DELTA_V = "(vx{a} + (x{a} / y{a}) * (x{a} / y{a}) * vy{a} - 2 * (x{a} / y{a}) * c{a}) / (n{a} * y{a} * y{a})"


@query(f"WITH {_USERS_SQL}, b AS (SELECT segment, arm, balance AS x, CAST(nation + 1 AS DOUBLE) AS y FROM a), m AS (SELECT segment, {_DELTA_SQL.format(a=1)}, {_DELTA_SQL.format(a=0)} FROM b GROUP BY 1) SELECT segment, round(x1 / y1, 4) AS ratio1, round(x0 / y0, 4) AS ratio0, round(x1 / y1 - x0 / y0, 4) AS difference, round(sqrt({_DELTA_V.format(a=1)} + {_DELTA_V.format(a=0)}), 4) AS se FROM m")
def test_ratio_delta(spark, sf_dir):
    out = ex.test_ratio_delta(_assigned(spark, sf_dir), ["segment"], F.col("balance"), (F.col("nation") + 1).cast("double"))
    return out.select("segment", *[F.round(c, 4).alias(c) for c in ("ratio1", "ratio0", "difference", "se")])


@query(f"WITH {_USERS_SQL}, c AS (SELECT segment, count(*) FILTER (rich) AS k, count(*) AS n, 1.959963984540054 AS z FROM u GROUP BY 1) SELECT segment, k, n, round((k / CAST(n AS DOUBLE) + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(k / CAST(n AS DOUBLE) * (1 - k / CAST(n AS DOUBLE)) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 6) AS low, round((k / CAST(n AS DOUBLE) + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(k / CAST(n AS DOUBLE) * (1 - k / CAST(n AS DOUBLE)) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 6) AS high FROM c")
def wilson_interval(spark, sf_dir):
    counts = _users(spark, sf_dir).groupBy("segment").agg(F.count_if("rich").alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return counts.select("segment", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


AA_EXPERIMENTS = 300
_AA_SQL = f"""{_USERS_SQL}, aa0 AS (SELECT key, rich, balance, CAST(e AS INTEGER) AS experiment, CAST(substr(sha256('assign-v1|' || e || '|' || key), 1, 16) >= '8000000000000000' AS INTEGER) AS arm FROM u, range({AA_EXPERIMENTS}) r(e)),
aac AS (SELECT experiment, {_COUNTS_SQL}, avg(balance) FILTER (arm = 1) AS m1, avg(balance) FILTER (arm = 0) AS m0, var_samp(balance) FILTER (arm = 1) / count(*) FILTER (arm = 1) AS a, var_samp(balance) FILTER (arm = 0) / count(*) FILTER (arm = 0) AS b FROM aa0 GROUP BY 1),
aas AS (SELECT *, CASE WHEN (n1 - n0) * (n1 - n0) / CAST(n1 + n0 AS DOUBLE) > 10.827566170662733 THEN 'flag' ELSE 'ok' END AS srm_status, k1 / CAST(n1 AS DOUBLE) AS p1, k0 / CAST(n0 AS DOUBLE) AS p0 FROM aac),
aaw AS (SELECT *, p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0 AS va, CASE WHEN n1 = 0 OR n0 = 0 THEN 'empty_group' WHEN n1 < 2 OR n0 < 2 THEN 'insufficient_n' END AS short FROM aas),
aar AS (SELECT experiment, n1, n0, srm_status, coalesce(short, CASE WHEN least(k1, n1 - k1, k0, n0 - k0) < 10 THEN 'sparse_cells' WHEN va <= 0 THEN 'zero_variance' ELSE 'ok' END) AS status, p1 - p0 AS difference, sqrt(va) AS se_, CAST(NULL AS DOUBLE) AS df_, 'rate' AS metric FROM aaw
  UNION ALL SELECT experiment, n1, n0, srm_status, coalesce(short, CASE WHEN a + b <= 0 THEN 'zero_variance' ELSE 'ok' END), m1 - m0, sqrt(a + b), (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)), 'amount' FROM aaw),
aa AS (SELECT experiment, metric, n1, n0, srm_status, status, difference, CASE WHEN status = 'ok' THEN se_ END AS se, CASE WHEN status = 'ok' THEN difference / se_ END AS statistic, CASE WHEN status = 'ok' THEN df_ END AS df FROM aar)"""
_AA_POINTS_SQL = ", ".join(f"{z!r} + coalesce({(z**3 + z) / 4!r} / df + {(5 * z**5 + 16 * z**3 + 3 * z) / 96!r} / (df * df), 0) AS c{name}" for name, z in ex.P_POINTS)


@query(f"WITH {_AA_SQL} SELECT experiment, metric, n1, n0, srm_status, status, round(difference, 6) AS difference, round(se, 6) AS se, round(statistic, 6) AS statistic, round(df, 4) AS df FROM aa")
def aa_audit(spark, sf_dir):
    out = ex.aa_audit(_users(spark, sf_dir), "key", F.col("rich"), F.col("balance"), AA_EXPERIMENTS)
    return _rounded(out, "difference", "se", "statistic").withColumn("df", F.round("df", 4))


@query(f"""WITH {_AA_SQL}, sc AS (SELECT 'all' AS scope, * FROM aa UNION ALL SELECT 'srm_pass', * FROM aa WHERE srm_status = 'ok'),
pt AS (SELECT *, {_AA_POINTS_SQL}, status = 'ok' AS ok, abs(statistic) AS t FROM sc),
g AS (SELECT metric, scope, count(*) AS attempted, count(*) FILTER (ok) AS experiments, count(*) FILTER (ok AND statistic > c005) AS rejected_up, count(*) FILTER (ok AND statistic < -c005) AS rejected_down, count(*) FILTER (NOT ok) AS failures, count(*) FILTER (srm_status = 'flag') AS srm_flags,
  round(quantile_cont(difference, 0.025) FILTER (ok), 6) AS difference_q025, round(quantile_cont(difference, 0.5) FILTER (ok), 6) AS difference_median, round(quantile_cont(difference, 0.975) FILTER (ok), 6) AS difference_q975, count(*) FILTER (ok AND abs(difference) <= c005 * se) AS zero_covered,
  count(*) FILTER (ok AND t > c001) AS p_0_001, count(*) FILTER (ok AND t <= c001 AND t > c005) AS p_001_005, count(*) FILTER (ok AND t <= c005 AND t > c01) AS p_005_01, count(*) FILTER (ok AND t <= c01 AND t > c05) AS p_01_05, count(*) FILTER (ok AND t <= c05) AS p_05_1 FROM pt GROUP BY ALL),
r AS (SELECT *, (rejected_up + rejected_down) / CAST(experiments AS DOUBLE) AS f, CAST(experiments AS DOUBLE) AS n, 1.959963984540054 AS z FROM g)
SELECT * EXCLUDE (f, n, z), round(f, 6) AS fpr, round((f + z * z / (2 * n) - z * sqrt(f * (1 - f) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS fpr_low, round((f + z * z / (2 * n) + z * sqrt(f * (1 - f) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS fpr_high,
  round(zero_covered / n, 6) AS zero_coverage FROM r""")
def aa_summary(spark, sf_dir):
    out = ex.aa_summary(ex.aa_audit(_users(spark, sf_dir), "key", F.col("rich"), F.col("balance"), AA_EXPERIMENTS))
    return _rounded(out, "difference_q025", "difference_median", "difference_q975", "fpr", "fpr_low", "fpr_high", "zero_coverage")


@query(f"WITH {_USERS_SQL}, b AS (SELECT arm AS x, CAST(substr(sha256('assign-v1|' || 'exp-2' || '|' || key), 1, 16) >= '8000000000000000' AS INTEGER) AS y FROM a) SELECT count(*) FILTER (x = 0 AND y = 0) AS n00, count(*) FILTER (x = 0 AND y = 1) AS n01, count(*) FILTER (x = 1 AND y = 0) AS n10, count(*) FILTER (x = 1 AND y = 1) AS n11, round(corr(x, y), 6) AS phi FROM b")
def assignment_overlap(spark, sf_dir):
    return _rounded(ex.assignment_overlap(_users(spark, sf_dir), "key", "exp-1", "exp-2"), "phi")


@query(f"WITH {EXPERIMENT_SQL} SELECT treatment, count(*) AS n, CAST(sum(conversion) AS BIGINT) AS conversion, CAST(sum(v) AS BIGINT) AS visit, count(*) FILTER (conversion NOT IN (0, 1)) AS conversion_invalid, count(*) FILTER (v NOT IN (0, 1)) AS visit_invalid FROM (SELECT *, CASE WHEN row_id < '08' THEN 2 ELSE visit END AS v FROM x) GROUP BY 1")
def itt_counts(spark, sf_dir):
    """With some labels that are neither 0 nor 1."""
    rows = experiment(spark, sf_dir)
    return ex.itt_counts(rows.withColumn("visit", F.when(F.col("row_id") < "08", 2).otherwise(F.col("visit"))), ["conversion", "visit"])


_ITT_SQL = " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER (treatment = 1) AS n1, count(*) FILTER (treatment = 0) AS n0, count(*) FILTER (treatment = 1 AND {m} = 1) AS k1, count(*) FILTER (treatment = 0 AND {m} = 1) AS k0 FROM x" for m in ("conversion", "visit", "exposure"))


@query(f"""WITH {EXPERIMENT_SQL}, c AS ({_ITT_SQL}), r AS (SELECT *, k1 / CAST(n1 AS DOUBLE) AS p1, k0 / CAST(n0 AS DOUBLE) AS p0, metric = 'exposure' AS after FROM c), v AS (SELECT *, p1 - p0 AS d, sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) AS s FROM r),
t AS (SELECT *, CASE WHEN after THEN 'descriptive_post_treatment_only' WHEN n1 = 0 OR n0 = 0 THEN 'empty_group' WHEN n1 < 2 OR n0 < 2 THEN 'insufficient_n' WHEN least(k1, n1 - k1, k0, n0 - k0) < 5 THEN 'sparse_cells' WHEN s <= 0 THEN 'zero_variance' ELSE 'ok' END AS status FROM v)
SELECT metric, n1, n0, k1, k0, status, round(p1, 6) AS p1, round(p0, 6) AS p0, round(d * 100, 6) AS difference_pp, round(CASE WHEN NOT after THEN d * 10000 END, 6) AS per_10k, round(CASE WHEN NOT after AND p0 > 0 THEN d / p0 END, 6) AS relative,
  round(CASE WHEN status = 'ok' THEN s END, 6) AS se, round(CASE WHEN status = 'ok' THEN d / s END, 6) AS z, round(CASE WHEN status = 'ok' THEN d - 1.959963984540054 * s END, 6) AS ci_low, round(CASE WHEN status = 'ok' THEN d + 1.959963984540054 * s END, 6) AS ci_high,
  round(CASE WHEN status = 'ok' THEN (d - 1.959963984540054 * s) * 10000 END, 6) AS per_10k_low, round(CASE WHEN status = 'ok' THEN (d + 1.959963984540054 * s) * 10000 END, 6) AS per_10k_high FROM t""")
def itt_effects(spark, sf_dir):
    """Conversion and visit are tested; exposure comes after the assignment and is only described."""
    names = ["conversion", "visit"]
    out = ex.itt_effects(ex.itt_counts(experiment(spark, sf_dir), [*names, "exposure"]), names, ["exposure"])
    numbers = ("p1", "p0", "difference_pp", "per_10k", "relative", "se", "z", "ci_low", "ci_high", "per_10k_low", "per_10k_high")
    return _rounded(out, *numbers).select("metric", "n1", "n0", "k1", "k0", "status", *numbers)


@query(f"""WITH {_USERS_SQL}, i AS (SELECT key, arm, rich, arm = 1 AND NOT rich AND substr(sha256('inject-v1|' || key), 1, 16) < '1999999999999999' AS planted FROM a)
SELECT arm, count(*) AS n, count(*) FILTER (rich) AS before, count(*) FILTER (rich OR planted) AS after, count(*) FILTER (planted) AS planted FROM i GROUP BY 1""")
def inject_effect(spark, sf_dir):
    users = _assigned(spark, sf_dir).withColumn("outcome", F.col("rich").cast("int"))
    planted = ex.inject_effect(users, "key", "outcome", base=0.5, effect=0.05)
    return planted.groupBy("arm").agg(F.count("*").alias("n"), F.sum("outcome").alias("before"), F.sum("injected").cast("long").alias("after"), F.count_if("planted").alias("planted"))


@query(f"""WITH {_USERS_SQL}, i AS (SELECT arm, rich, arm = 1 AND NOT rich AND substr(sha256('inject-v1|' || key), 1, 16) < '1999999999999999' AS planted FROM a),
sc AS (SELECT s AS scenario, count(*) FILTER (arm = 1) AS n1, count(*) FILTER (arm = 0) AS n0, count(*) FILTER (arm = 1 AND (rich OR (planted AND s = 'planted'))) AS k1, count(*) FILTER (arm = 0 AND rich) AS k0, count(*) FILTER (planted AND s = 'planted') AS k_planted FROM i, (VALUES ('none'), ('planted')) v(s) GROUP BY 1),
wa AS (WITH {_wald_sql("scenario, k_planted, d, e", "SELECT * FROM sc", 10)}), tr AS (SELECT *, k_planted / CAST(n1 AS DOUBLE) AS t FROM wa)
SELECT scenario, n1, n0, k1, k0, k_planted, status, round(d, 9) AS difference, ci_low, ci_high, round(t, 9) AS truth, round(d - t, 9) AS error, CASE WHEN status = 'ok' THEN d - 1.959963984540054 * e <= t AND t <= d + 1.959963984540054 * e END AS covered,
  round(d - max(d) FILTER (scenario = 'none') OVER (), 9) AS increment FROM tr""")
def inject_estimate(spark, sf_dir):
    """What the test finds of a planted effect, beside the truth."""
    users = _assigned(spark, sf_dir).withColumn("outcome", F.col("rich").cast("int"))
    out = ex.planted_estimates(ex.inject_effect(users, "key", "outcome", base=0.5, effect=0.05), "outcome")
    out = out.withColumns({c: F.round(c, 9) for c in ("difference", "truth", "error", "increment")} | {c: F.round(c, 6) for c in ("ci_low", "ci_high")})
    return out.select("scenario", "n1", "n0", "k1", "k0", "k_planted", "status", "difference", "ci_low", "ci_high", "truth", "error", "covered", "increment")


_RATES_SQL = "r AS (SELECT c_mktsegment AS segment, count(*) FILTER (c_acctbal > 5000) / CAST(count(*) AS DOUBLE) AS rate FROM customer GROUP BY 1)"


def _rates(spark, sf_dir):
    return _users(spark, sf_dir).groupBy("segment").agg((F.count_if("rich") / F.count("*").cast("double")).alias("rate"))


@query(f"WITH {_RATES_SQL}, g AS (SELECT segment, rate, m AS mde, rate * (1 + m) AS q FROM r, (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.2)) v(m)) SELECT segment, mde, round(rate, 6) AS rate, CASE WHEN rate > 0 AND rate < 1 AND q < 1 THEN 'ok' ELSE 'invalid_rate' END AS status, CASE WHEN rate > 0 AND rate < 1 AND q < 1 THEN CAST(ceil(pow(1.959963984540054 + 0.8416212335729143, 2) * (rate * (1 - rate) + q * (1 - q)) / ((q - rate) * (q - rate))) AS BIGINT) END AS n_per_arm FROM g")
def segment_sample_size(spark, sf_dir):
    return _rounded(ex.segment_sample_size(_rates(spark, sf_dir), [0.05, 0.1, 0.2]), "rate")


@query(f"WITH {_RATES_SQL} SELECT segment, CAST(k AS DOUBLE) AS burden, round(rate, 6) AS rate, round(k / (1 - k), 6) AS break_even_lift, round(rate / (1 - k), 6) AS break_even_rate, CASE WHEN rate / (1 - k) <= 1 THEN 'attainable' ELSE 'unattainable' END AS status FROM r, (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.6)) v(k)")
def coupon_break_even(spark, sf_dir):
    return _rounded(ex.coupon_break_even(_rates(spark, sf_dir), [0.05, 0.1, 0.6]), "rate", "break_even_lift", "break_even_rate")
