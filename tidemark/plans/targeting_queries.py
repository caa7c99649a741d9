"""Targeting over the experiment rows of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import resample
from ..functions.columns import ratio
from ..operators import experiments as ex
from ..operators import boosting, models, uplift
from ..operators import targeting as tg
from ..sources.scratch import bucketed, once, remembered
from ..sources.tables import EXPERIMENT_SQL, experiment, table
from .experiment_queries import _wald_sql
from .registry import query

SUPPORT = 50

SPLIT_SQL = EXPERIMENT_SQL + r""",
sp0 AS (SELECT *, substr(sha256('split-v1|' || treatment || '|' || row_id), 1, 16) AS h FROM x), sp AS (SELECT * EXCLUDE (h), CASE WHEN h < '9999999999999999' THEN 'train' WHEN h < 'cccccccccccccccc' THEN 'valid' ELSE 'test' END AS split FROM sp0)"""
GROUP_SQL = SPLIT_SQL + r""",
q AS (SELECT 'f0' AS feature, quantile_cont(f0, [0.25, 0.5, 0.75]) AS q, min(f0) AS lo, max(f0) AS hi FROM sp WHERE split = 'train' UNION ALL SELECT 'f1', quantile_cont(f1, [0.25, 0.5, 0.75]), min(f1), max(f1) FROM sp WHERE split = 'train'),
cuts AS (SELECT feature, list_sort(list_distinct(list_filter(q, lambda c: c > lo AND c < hi))) AS cuts FROM q),
gr AS (SELECT sp.*, CAST(len(list_filter((SELECT cuts FROM cuts WHERE feature = 'f0'), lambda c: c < f0)) * 4 + len(list_filter((SELECT cuts FROM cuts WHERE feature = 'f1'), lambda c: c < f1)) AS INTEGER) AS group_id FROM sp),
gc AS (SELECT group_id, count(*) FILTER (treatment = 1) AS n1, count(*) FILTER (treatment = 0) AS n0, count(*) FILTER (treatment = 1 AND conversion = 1) AS y1, count(*) FILTER (treatment = 0 AND conversion = 1) AS y0 FROM gr WHERE split = 'train' GROUP BY 1),
ga AS (SELECT sum(n1) AS n1, sum(n0) AS n0, sum(y1) AS y1, sum(y0) AS y0 FROM gc),
gs AS (SELECT CAST(i AS INTEGER) AS group_id, coalesce(gc.n1, 0) AS n1, coalesce(gc.n0, 0) AS n0, coalesce(gc.y1, 0) AS y1, coalesce(gc.y0, 0) AS y0, least(coalesce(gc.n1, 0), coalesce(gc.n0, 0)) < 50 AS fallback FROM range(16) r(i) LEFT JOIN gc ON group_id = i),
gp AS (SELECT gs.*, CAST(CASE WHEN fallback THEN ga.n1 ELSE gs.n1 END AS DOUBLE) AS a1, CAST(CASE WHEN fallback THEN ga.n0 ELSE gs.n0 END AS DOUBLE) AS a0, CAST(CASE WHEN fallback THEN ga.y1 ELSE gs.y1 END AS DOUBLE) AS b1, CAST(CASE WHEN fallback THEN ga.y0 ELSE gs.y0 END AS DOUBLE) AS b0 FROM gs, ga),
rates AS (SELECT group_id, n1, n0, y1, y0, fallback, CASE WHEN n1 + n0 = 0 THEN 'unobserved' WHEN fallback THEN 'low_support' ELSE 'own_rates' END AS reason,
  CAST(b1 AS BIGINT) AS score_y1, CAST(a1 AS BIGINT) AS score_n1, CAST(b0 AS BIGINT) AS score_y0, CAST(a0 AS BIGINT) AS score_n0, round(b0 / a0, 9) AS response_score, round(b1 / a1 - b0 / a0, 9) AS incremental_score FROM gp),
ex AS (SELECT *, CAST(score_n1 AS HUGEINT) * score_n0 AS den, CAST(score_y1 AS HUGEINT) * score_n0 - CAST(score_y0 AS HUGEINT) * score_n1 AS num FROM rates),
rules AS (SELECT ex.* EXCLUDE (den, num), CAST(1 + (SELECT count(DISTINCT (o.score_y0 / gcd(o.score_y0, o.score_n0), o.score_n0 / gcd(o.score_y0, o.score_n0))) FROM ex o WHERE CAST(o.score_y0 AS HUGEINT) * ex.score_n0 > CAST(ex.score_y0 AS HUGEINT) * o.score_n0) AS INTEGER) AS response_rank,
  CAST(1 + (SELECT count(DISTINCT (o.num // gcd(o.num, o.den), o.den // gcd(o.num, o.den))) FROM ex o WHERE o.num * ex.den > ex.num * o.den) AS INTEGER) AS incremental_rank FROM ex)"""
PLACE_SQL = GROUP_SQL + r""",
va AS (SELECT row_id, treatment, conversion, response_rank, incremental_rank, fallback, sha256('target-v1|' || row_id) AS tie FROM gr JOIN rules USING (group_id) WHERE split = 'valid'),
pl AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY tie, row_id) AS place_random, row_number() OVER (ORDER BY response_rank, tie, row_id) AS place_response, row_number() OVER (ORDER BY incremental_rank, tie, row_id) AS place_incremental FROM va),
mk AS (SELECT *, """ + " + ".join(f"CASE WHEN place_{p} <= floor(n * {c} / 100) THEN {1 << (i * 5 + j)} ELSE 0 END" for i, p in enumerate(tg.POLICIES) for j, c in enumerate(tg.CAPACITIES)) + r""" AS mask FROM pl),
jt AS (SELECT treatment, conversion, CAST(mask AS BIGINT) AS mask, fallback, count(*) AS n FROM mk GROUP BY ALL),
cells AS (SELECT * FROM (VALUES """ + ", ".join(f"('{p}', {c}, {1 << (i * 5 + j)})" for i, p in enumerate(tg.POLICIES) for j, c in enumerate(tg.CAPACITIES)) + r""") v(policy, capacity, bit)),
cv0 AS (SELECT policy, capacity, CAST(coalesce(sum(n) FILTER (treatment = 1), 0) AS BIGINT) AS n1, CAST(coalesce(sum(n) FILTER (treatment = 0), 0) AS BIGINT) AS n0, CAST(coalesce(sum(n) FILTER (treatment = 1 AND conversion = 1), 0) AS BIGINT) AS y1, CAST(coalesce(sum(n) FILTER (treatment = 0 AND conversion = 1), 0) AS BIGINT) AS y0, CAST(coalesce(sum(n) FILTER (fallback), 0) AS BIGINT) AS fallback_n FROM jt JOIN cells ON (mask & bit) <> 0 GROUP BY ALL),
cv1 AS (SELECT *, y1 / CAST(n1 AS DOUBLE) - y0 / CAST(n0 AS DOUBLE) AS dl, (n1 + n0) / CAST((SELECT sum(n) FROM jt) AS DOUBLE) AS sh FROM cv0),
cov AS (SELECT policy, CAST(capacity AS INTEGER) AS capacity, n1, n0, y1, y0, round(dl, 6) AS delta, round(10000 * sh * dl, 4) AS gain, round(n1 / CAST(n1 + n0 AS DOUBLE), 6) AS treatment_share, fallback_n, CASE WHEN n1 = 0 OR n0 = 0 THEN 'zero_arm' WHEN least(y1, y0) < 5 THEN 'sparse' ELSE 'ok' END AS status FROM cv1)"""


def _study(spark, sf_dir):
    """The split rows with the hash that breaks ties, written once and read by all queries here."""
    return once(spark, "study", sf_dir, lambda: tg.split(experiment(spark, sf_dir)).withColumn("tie", tg.tie_hash()))


def _aligned(spark, sf_dir):
    """Records and members, written once in equal buckets."""

    def make():
        told = _split(spark, sf_dir)
        members = told.where("split <> 'test'").withColumn("treatment", F.when(F.col("row_id") < "1", 1 - F.col("treatment")).otherwise(F.col("treatment")))
        strange = told.where("row_id >= 'f8'").withColumn("row_id", F.concat(F.lit("x"), "row_id"))
        kept = ["row_id", "treatment", "split"]
        return bucketed(told.select("row_id", "treatment"), "records", "row_id"), bucketed(members.unionByName(strange).select(*kept), "members", "row_id")

    return remembered(spark, "aligned", sf_dir, make)


def _split(spark, sf_dir):
    return _study(spark, sf_dir).drop("tie")


def _cuts(spark, sf_dir):
    return once(spark, "cuts", sf_dir, lambda: tg.train_cuts(_study(spark, sf_dir), ["f0", "f1"]))


def _grouped(spark, sf_dir):
    return tg.bin_group(_study(spark, sf_dir), _cuts(spark, sf_dir))


def _rules(spark, sf_dir):
    """The frozen rules, 16 rows."""
    return once(spark, "rules", sf_dir, lambda: tg.score_ranks(tg.group_rates(_grouped(spark, sf_dir), SUPPORT)))


def _places(spark, sf_dir):
    """Every held-out row's place under each policy, and its outcome, which the places don't see."""
    valid = _grouped(spark, sf_dir).where("split = 'valid'")
    return once(spark, "places", sf_dir, lambda: tg.unseal(tg.policy_places(tg.apply_rules(valid, _rules(spark, sf_dir)))).select("row_id", "treatment", "conversion", "fallback", *[f"place_{p}" for p in tg.POLICIES], "n_all"))


def _masked(spark, sf_dir):
    return tg.capacity_masks(_places(spark, sf_dir), F.col("n_all"))


def _types(spark, sf_dir):
    return once(spark, "types", sf_dir, lambda: tg.joint_types(_masked(spark, sf_dir)))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, sha256(concat_ws('|', 'row-v2', 'lineitem', l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate))) AS row_id FROM lineitem")
def row_identity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return tg.row_identity(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate"], "lineitem")


@query(f"WITH {SPLIT_SQL} SELECT row_id, split FROM sp")
def split_stratified_hash(spark, sf_dir):
    return _split(spark, sf_dir).select("row_id", "split")


@query(f"WITH {SPLIT_SQL}, g AS (SELECT split, CASE WHEN grouping(treatment) = 1 THEN -1 ELSE treatment END AS treatment, count(*) AS n, CAST(sum(conversion) AS BIGINT) AS conversions FROM sp GROUP BY GROUPING SETS ((split), (split, treatment))) SELECT *, round(conversions / CAST(n AS DOUBLE), 6) AS rate, round(n / CAST(sum(n) OVER (PARTITION BY treatment) AS DOUBLE), 6) AS share, abs(n / CAST(sum(n) OVER (PARTITION BY treatment) AS DOUBLE) - CASE split WHEN 'train' THEN 0.6 ELSE 0.2 END) <= 0.02 AS share_ok FROM g")
def split_qc(spark, sf_dir):
    return tg.split_qc(_split(spark, sf_dir))


@query(f"WITH {SPLIT_SQL} SELECT row_id, substr(sha256('early-v1|' || row_id), 1, 16) < '1999999999999999' AS early_stop FROM sp WHERE split = 'train'")
def early_stop_member(spark, sf_dir):
    return tg.early_stop(_split(spark, sf_dir)).select("row_id", "early_stop")


@query(f"""WITH {SPLIT_SQL}, m AS (SELECT row_id, CASE WHEN row_id < '1' THEN 1 - treatment ELSE treatment END AS arm FROM sp WHERE split <> 'test' UNION ALL SELECT 'x' || row_id, treatment FROM sp WHERE row_id >= 'f8')
SELECT count(*) AS rows, count(*) FILTER (m.row_id IS NULL) AS without_member, count(*) FILTER (sp.row_id IS NULL) AS without_record, count(*) FILTER (arm <> treatment) AS arm_mismatch FROM sp FULL JOIN m USING (row_id)""")
def align_members(spark, sf_dir):
    """Members without the test split, some with the other arm, and some that no record has; both tables in buckets of row_id."""
    return tg.align_members(*_aligned(spark, sf_dir))


@query(f"WITH {SPLIT_SQL}, i AS (SELECT f0, f1, treatment FROM sp WHERE split = 'train' INTERSECT SELECT f0, f1, treatment FROM sp WHERE split = 'valid') SELECT treatment, count(*) AS shared FROM i GROUP BY 1")
def split_shared_features(spark, sf_dir):
    """Distinct feature rows that two splits have in common, by arm; ids never are."""
    rows = _split(spark, sf_dir)
    part = lambda name: rows.where(F.col("split") == name).select("f0", "f1", "treatment")
    return part("train").intersect(part("valid")).groupBy("treatment").agg(F.count("*").alias("shared"))


@query(f"WITH {GROUP_SQL} SELECT feature, array_to_string(list_transform(cuts, lambda c: printf('%.4f', c)), ',') AS cuts FROM cuts")
def train_cuts(spark, sf_dir):
    return _cuts(spark, sf_dir).select("feature", F.array_join(F.transform("cuts", lambda c: F.format_string("%.4f", c)), ",").alias("cuts"))


@query(f"WITH {GROUP_SQL} SELECT row_id, group_id FROM gr")
def bin_group(spark, sf_dir):
    return _grouped(spark, sf_dir).select("row_id", "group_id")


@query(f"WITH {GROUP_SQL} SELECT * FROM rates")
def group_rates(spark, sf_dir):
    return tg.group_rates(_grouped(spark, sf_dir), SUPPORT)


@query(f"WITH {GROUP_SQL} SELECT group_id, response_rank, incremental_rank FROM rules")
def score_ranks(spark, sf_dir):
    return _rules(spark, sf_dir).select("group_id", "response_rank", "incremental_rank")


@query(f"WITH {PLACE_SQL} SELECT row_id, response_rank, incremental_rank, fallback FROM va")
def apply_frozen(spark, sf_dir):
    grouped = _grouped(spark, sf_dir)
    return tg.apply_rules(grouped.where("split = 'valid'"), _rules(spark, sf_dir)).select("row_id", "response_rank", "incremental_rank", "fallback")


@query(f"WITH {GROUP_SQL} SELECT row_id, response_rank AS simple_response, incremental_rank AS simple_incremental FROM gr JOIN rules USING (group_id)")
def simple_scores(spark, sf_dir):
    grouped = _grouped(spark, sf_dir)
    return tg.apply_rules(grouped, _rules(spark, sf_dir)).select("row_id", F.col("response_rank").alias("simple_response"), F.col("incremental_rank").alias("simple_incremental"))


@query(f"WITH {PLACE_SQL} SELECT row_id, place_random, place_response, place_incremental FROM pl")
def rank_policies(spark, sf_dir):
    return _places(spark, sf_dir).select("row_id", "place_random", "place_response", "place_incremental")


@query(f"WITH {PLACE_SQL} SELECT row_id, CAST(mask AS BIGINT) AS mask FROM mk")
def capacity_select(spark, sf_dir):
    return _masked(spark, sf_dir).select("row_id", "mask")


@query(f"WITH {PLACE_SQL} SELECT * FROM jt")
def joint_types(spark, sf_dir):
    return _types(spark, sf_dir)


@query(f"WITH {PLACE_SQL} SELECT * FROM cov")
def coverage_eval(spark, sf_dir):
    return tg.coverage(_types(spark, sf_dir))


@query(f"WITH {PLACE_SQL} SELECT x.capacity, x.policy AS a, y.policy AS b, round(x.gain - y.gain, 4) AS gain_difference FROM cov x JOIN cov y ON x.capacity = y.capacity AND x.policy < y.policy")
def policy_contrasts(spark, sf_dir):
    return tg.contrasts(tg.coverage(_types(spark, sf_dir)))


@query(f"""WITH {PLACE_SQL}, o AS (SELECT x.capacity, x.policy AS a, y.policy AS b, x.bit AS p, y.bit AS q FROM cells x JOIN cells y ON x.capacity = y.capacity AND x.bit < y.bit),
s AS (SELECT CAST(capacity AS INTEGER) AS capacity, a, b, CAST(coalesce(sum(n) FILTER ((mask & p) <> 0 AND (mask & q) <> 0), 0) AS BIGINT) AS both, CAST(coalesce(sum(n) FILTER ((mask & p) <> 0 OR (mask & q) <> 0), 0) AS BIGINT) AS either FROM jt, o GROUP BY ALL) SELECT *, round(CASE WHEN either > 0 THEN "both" / CAST(either AS DOUBLE) END, 6) AS rate, "both" = either AS identical FROM s""")
def policy_overlap(spark, sf_dir):
    return tg.overlap(_types(spark, sf_dir))


_DRAWS, _SEED = 1000, 20260921
_h = resample.block_hash_sql(_SEED, "b", "treatment", "conversion", "mask", "u")


@query(f"""WITH {PLACE_SQL}, jc AS (SELECT treatment, conversion, mask, CAST(sum(n) AS BIGINT) AS n FROM jt GROUP BY ALL),
un AS (SELECT *, unnest(CASE WHEN n <= {resample.FEW} THEN range(1, n + 1) ELSE [0] END) AS u FROM jc), bh AS (SELECT un.*, b, {_h} AS h FROM un, range({_DRAWS // resample.LANES}) r(b)),
bu AS (SELECT bh.*, lane, {resample.uniform_sql("h", "lane")} AS v FROM bh, range({resample.LANES}) l(lane)), bz AS (SELECT *, {resample.normal_point_sql("v")} AS z FROM bu),
bw AS (SELECT b * {resample.LANES} + lane AS repetition, treatment, conversion, mask, CASE WHEN n <= {resample.FEW} THEN {resample.poisson_one_sql("h", "lane")} ELSE {resample.poisson_many_sql("z", "n")} END AS w FROM bz),
bs AS (SELECT repetition, policy, capacity, sum(w) FILTER (treatment = 1) AS n1, sum(w) FILTER (treatment = 0) AS n0, coalesce(sum(w) FILTER (treatment = 1 AND conversion = 1), 0) AS y1, coalesce(sum(w) FILTER (treatment = 0 AND conversion = 1), 0) AS y0 FROM bw JOIN cells ON (mask & bit) <> 0 GROUP BY ALL),
bc AS (SELECT policy, capacity, sum(n) / CAST((SELECT sum(n) FROM jc) AS DOUBLE) AS share FROM jc JOIN cells ON (mask & bit) <> 0 GROUP BY ALL),
bg AS (SELECT policy, capacity, CASE WHEN n1 > 0 AND n0 > 0 THEN 10000 * share * (y1 / CAST(n1 AS DOUBLE) - y0 / CAST(n0 AS DOUBLE)) END AS gain FROM bs JOIN bc USING (policy, capacity))
SELECT policy, CAST(capacity AS INTEGER) AS capacity, round(quantile_cont(gain, 0.025), 6) AS ci_low, round(quantile_cont(gain, 0.975), 6) AS ci_high, count(*) FILTER (gain IS NULL) AS invalid FROM bg GROUP BY ALL""")
def joint_bootstrap(spark, sf_dir):
    """Intervals of all gains from a thousand resamples."""
    out = tg.bootstrap_intervals(tg.joint_bootstrap(_types(spark, sf_dir), _DRAWS, _SEED))
    return out.withColumns({"ci_low": F.round("ci_low", 6), "ci_high": F.round("ci_high", 6)})


@query(f"""WITH {GROUP_SQL}, spine AS (SELECT split, group_id, fallback, reason, response_rank, incremental_rank FROM rules, (VALUES ('train'), ('valid')) v(split)),
co AS (SELECT split, group_id, count(*) FILTER (treatment = 1) AS n1, count(*) FILTER (treatment = 0) AS n0, count(*) FILTER (treatment = 1 AND conversion = 1) AS k1, count(*) FILTER (treatment = 0 AND conversion = 1) AS k0 FROM gr WHERE split <> 'test' GROUP BY ALL),
wa AS (WITH {_wald_sql("split, group_id", "SELECT split, group_id, coalesce(n1, 0) AS n1, coalesce(n0, 0) AS n0, coalesce(k1, 0) AS k1, coalesce(k0, 0) AS k0 FROM spine LEFT JOIN co USING (split, group_id)", 10)})
SELECT wa.*, round(CASE WHEN n1 + n0 > 0 THEN n1 / CAST(n1 + n0 AS DOUBLE) END, 6) AS treatment_share, fallback, reason, response_rank, incremental_rank FROM wa JOIN spine USING (split, group_id)""")
def stratum_report(spark, sf_dir):
    """Train and valid rates of every group beside its frozen ranks; groups without rows are there."""
    rows = _grouped(spark, sf_dir).where("split <> 'test'").withColumn("arm", F.col("treatment"))
    out = ex.test_proportions(tg.by_stratum(ex.arm_counts(rows, ["split", "group_id"], F.col("conversion") == 1), _rules(spark, sf_dir)))
    out = out.withColumn("treatment_share", ratio(F.col("n1"), F.col("n1") + F.col("n0"))).withColumns({n: F.round(n, 6) for n in ("p1", "p0", "difference_pp", "relative", "se", "z", "ci_low", "ci_high")})
    return out.select("split", "group_id", "n1", "n0", "k1", "k0", "status", "p1", "p0", "difference_pp", "relative", "se", "z", "ci_low", "ci_high", "treatment_share", "fallback", "reason", "response_rank", "incremental_rank")


_QINI_SQL = r"""qb AS (SELECT CAST(ceil(place_response * 100 / CAST(n AS DOUBLE)) AS INTEGER) AS percent, treatment, conversion FROM pl), qs AS (SELECT CAST(i AS INTEGER) AS percent FROM range(101) r(i)),
qc AS (SELECT qs.percent, CAST(sum(count(*) FILTER (treatment = 1)) OVER w AS BIGINT) AS n1, CAST(sum(count(*) FILTER (treatment = 0)) OVER w AS BIGINT) AS n0, CAST(sum(count(*) FILTER (treatment = 1 AND conversion = 1)) OVER w AS BIGINT) AS y1, CAST(sum(count(*) FILTER (treatment = 0 AND conversion = 1)) OVER w AS BIGINT) AS y0 FROM qs LEFT JOIN qb USING (percent) GROUP BY qs.percent WINDOW w AS (ORDER BY qs.percent)),
qq AS (SELECT *, CASE WHEN percent = 0 THEN 0.0 WHEN n0 > 0 THEN y1 - y0 * n1 / CAST(n0 AS DOUBLE) END AS qv FROM qc), curve AS (SELECT percent, n1, n0, y1, y0, round(CAST(qv AS DOUBLE), 6) AS q, round((SELECT CAST(qv AS DOUBLE) FROM qq WHERE percent = 100) * percent / 100, 6) AS reference, CASE WHEN qv IS NULL THEN 'no_control_in_prefix' ELSE 'defined' END AS status FROM qq)"""


def _curve(spark, sf_dir):
    return tg.qini(_places(spark, sf_dir), "place_response", F.col("n_all").cast("double"))


@query(f"WITH {PLACE_SQL}, {_QINI_SQL} SELECT * FROM curve")
def qini_curve(spark, sf_dir):
    return _curve(spark, sf_dir)


@query(f"WITH {PLACE_SQL}, {_QINI_SQL}, l AS (SELECT q, ((q - reference) + lag(q - reference) OVER (ORDER BY percent)) / 200 AS p FROM curve) SELECT round(CASE WHEN NOT bool_or(q IS NULL) THEN sum(p) END, 6) AS area FROM l")
def qini_area(spark, sf_dir):
    return tg.qini_area(_curve(spark, sf_dir))


@query(f"""WITH {GROUP_SQL}, s AS (SELECT treatment, conversion, response_score AS p FROM gr JOIN rules USING (group_id) WHERE split = 'valid'), w AS (SELECT avg(conversion) AS rate FROM s), a AS (SELECT treatment, avg(conversion) AS arm_rate FROM s GROUP BY 1)
SELECT treatment, count(*) AS n, round(avg(-(conversion * ln(p) + (1 - conversion) * ln(1 - p))), 6) AS loss, round(avg(-(conversion * ln(rate) + (1 - conversion) * ln(1 - rate))), 6) AS constant_loss, round(avg(-(conversion * ln(arm_rate) + (1 - conversion) * ln(1 - arm_rate))), 6) AS arm_loss FROM s JOIN a USING (treatment), w GROUP BY 1""")
def factual_logloss(spark, sf_dir):
    grouped = _grouped(spark, sf_dir)
    rules = _rules(spark, sf_dir).select("group_id", F.col("response_score").alias("p"))
    return tg.factual_logloss(grouped.where("split = 'valid'").join(F.broadcast(rules), "group_id"))


@query(f"WITH {SPLIT_SQL}, e AS (SELECT *, CASE WHEN substr(sha256('early-v1|' || row_id), 1, 16) < '1999999999999999' THEN 'early_stop' ELSE 'fit' END AS part FROM sp WHERE split = 'train') SELECT part, treatment, count(*) AS n, CAST(sum(conversion) AS BIGINT) AS positives, sum(conversion) > 0 AND sum(conversion) < count(*) AS supported FROM e GROUP BY ALL")
def training_frame(spark, sf_dir):
    return models.training_frame(tg.early_stop(_split(spark, sf_dir)))


def _all_features(spark, sf_dir):
    return tg.split(experiment(spark, sf_dir, all_features=True))


def _train(spark, sf_dir):
    """What the learners see of the training rows: twelve features, arm, outcome, part, and the id's hash that samples cut points."""
    kept = [*models.FEATURES, "treatment", "conversion", "early_stop"]
    return once(spark, "train", sf_dir, lambda: tg.early_stop(_all_features(spark, sf_dir)).select(*kept, boosting.cut_hash().alias("cut_hash")))


def _held_out(spark, sf_dir):
    """The held-out rows."""
    kept = ["row_id", "treatment", "conversion", *models.FEATURES]
    return _all_features(spark, sf_dir).where("split = 'valid'").select(*kept)


def _models(spark, sf_dir, roles=models.ROLES):
    """The classifiers of these roles, each fitted once an application and folder."""
    known = remembered(spark, "models", sf_dir, dict)
    missing = tuple(r for r in roles if r not in known)
    if missing:
        known |= models.learn(*remembered(spark, "binned", sf_dir, lambda: models.binned(_train(spark, sf_dir))), roles=missing)
    return {r: known[r] for r in roles}


def _scores(spark, sf_dir):
    """The stored score table of the held-out rows, with the hash that breaks ties; all evaluations read it."""
    rows = _held_out(spark, sf_dir).withColumn("tie", tg.tie_hash())
    return once(spark, "scores", sf_dir, lambda: models.score(_models(spark, sf_dir), rows).drop(*models.FEATURES))


def _conditions(spark, sf_dir):
    """Ids and scores of the one model that knows the arm."""
    return once(spark, "conditions", sf_dir, lambda: models.score(_models(spark, sf_dir, ("s",)), _held_out(spark, sf_dir)).select("row_id", "s1", "s0", "s_uplift"))


def _trees(spark, sf_dir, *roles):
    fitted = _models(spark, sf_dir, roles)
    rows = [(role, *r) for role in roles for r in boosting.tree_rows(fitted[role])]
    return spark.createDataFrame(rows, f"role string, {boosting.TREE_SCHEMA}")


@query()
def fit_response(spark, sf_dir):
    """The trees of the classifier of all rows; a test holds the learner against plain NumPy."""
    return _trees(spark, sf_dir, "response")


@query()
def fit_s_learner(spark, sf_dir):
    """The trees of the classifier that has the arm as a thirteenth feature."""
    return _trees(spark, sf_dir, "s")


@query()
def fit_t_learner(spark, sf_dir):
    """The trees of the classifiers of either arm."""
    return _trees(spark, sf_dir, "t1", "t0")


@query()
def predict_conditions(spark, sf_dir):
    """Both conditional probabilities of every held-out row, and their difference."""
    return _conditions(spark, sf_dir).select("row_id", F.col("s1").alias("p1"), F.col("s0").alias("p0"), "s_uplift")


@query()
def uplift_scores(spark, sf_dir):
    """The scores of the three learners side by side for every held-out row."""
    return _scores(spark, sf_dir).select("row_id", "s_uplift", "t_uplift", "response")


def _learned_places(spark, sf_dir):
    return once(spark, "learned_places", sf_dir, lambda: uplift.policy_places(_scores(spark, sf_dir)))


def _learned_curves(spark, sf_dir):
    return uplift.curves(_learned_places(spark, sf_dir), _scores(spark, sf_dir).count())


@query()
def learner_places(spark, sf_dir):
    """Every held-out row's place in the order of each learner; a test holds them against SQL over the stored scores."""
    return _learned_places(spark, sf_dir)


@query()
def learner_qini_curve(spark, sf_dir):
    return _learned_curves(spark, sf_dir)


@query()
def learner_qini_area(spark, sf_dir):
    return uplift.areas(_learned_curves(spark, sf_dir))


@query()
def learner_capacity(spark, sf_dir):
    return uplift.capacities(_learned_places(spark, sf_dir), _scores(spark, sf_dir).count())


@query()
def learner_logloss(spark, sf_dir):
    return models.losses(_scores(spark, sf_dir), models.fit_rates(_train(spark, sf_dir)))
