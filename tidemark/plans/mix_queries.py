"""Product mix, price pairs and baskets over line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import resample
from ..operators import mix, pricing
from ..sources.tables import table
from .registry import query

FOCUS = "ECONOMY"
TARGET, HISTORY = "1998-03-18", ["1998-03-11", "1998-03-04", "1998-02-25", "1998-02-18"]

#: Sales: month buckets of days stand for dates, a seventh of the lines of odd parts sit in another category.
SALES_SQL = r"""
sales AS (SELECT CAST(l_shipdate AS DATE) - CAST(dayofmonth(l_shipdate) - 1 AS INTEGER) AS utc_date, p_brand AS product_id, CASE WHEN l_orderkey % 97 = 0 THEN 'unknown' ELSE p_type END AS category, CAST(l_suppkey AS VARCHAR) AS user_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey),
fs AS (SELECT * FROM sales WHERE category = 'ECONOMY'), pd AS (SELECT utc_date, product_id, count(*) AS purchases, CAST(sum(amount) AS DECIMAL(38,2)) AS amount, min(amount) AS least, max(amount) AS most FROM fs GROUP BY ALL),
pc AS (SELECT product_id, category, count(*) AS records FROM sales WHERE product_id IN (SELECT product_id FROM fs) GROUP BY ALL)"""
MONTH, BEFORE = "1998-03-01", ["1998-02-01", "1998-01-01", "1997-12-01"]
#: Products are classed by whether their records outside the focus are few types; two classes occur.
CLASS_SQL = "cl AS (SELECT product_id, CAST(count(DISTINCT category) AS INTEGER) AS categories, CASE WHEN bool_or(category = 'unknown') THEN 'unknown' WHEN count(DISTINCT category) > 1 THEN 'other_known' ELSE 'stable' END AS stability FROM pc WHERE records >= {few} GROUP BY 1)"
COMPARE_SQL = """w AS (SELECT product_id, CAST(coalesce(sum(purchases) FILTER (CAST(utc_date AS VARCHAR) = '1998-03-01'), 0) AS DOUBLE) AS n1, CAST(coalesce(sum(purchases) FILTER (CAST(utc_date AS VARCHAR) <> '1998-03-01'), 0) AS DOUBLE) / 3 AS n0, CAST(coalesce(sum(amount) FILTER (CAST(utc_date AS VARCHAR) = '1998-03-01'), 0) AS DOUBLE) AS v1, CAST(coalesce(sum(amount) FILTER (CAST(utc_date AS VARCHAR) <> '1998-03-01'), 0) AS DOUBLE) / 3 AS v0
  FROM pd WHERE CAST(utc_date AS VARCHAR) IN ('1998-03-01', '1998-02-01', '1998-01-01', '1997-12-01') GROUP BY 1),
w2 AS (SELECT w.*, CASE WHEN NOT (CAST(substr(product_id, 7) AS INTEGER) % 5 <> 0) THEN 'unstable' WHEN n1 > 0 AND n0 > 0 THEN 'common' WHEN n0 > 0 THEN 'history_only' ELSE 'current_only' END AS part FROM w),
cmp AS (SELECT product_id, part, round(n1, 6) AS n1, round(n0, 6) AS n0, round(v1, 4) AS v1, round(v0, 4) AS v0, round(v1 - v0, 4) AS change, round(CASE WHEN part = 'common' THEN (n1 - n0) * (v1 / n1 + v0 / n0) / 2 END, 4) AS quantity_effect, round(CASE WHEN part = 'common' THEN (v1 / n1 - v0 / n0) * (n1 + n0) / 2 END, 4) AS amount_effect FROM w2)"""


def _sales(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.to_date(F.trunc("l_shipdate", "month")).alias("utc_date"), F.col("p_brand").alias("product_id"), F.when(F.col("l_orderkey") % 97 == 0, "unknown").otherwise(F.col("p_type")).alias("category"), F.col("l_suppkey").cast("string").alias("user_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))


def _focus(spark, sf_dir):
    return _sales(spark, sf_dir).where(F.col("category") == FOCUS)


def _compared(spark, sf_dir):
    daily = mix.product_daily(_focus(spark, sf_dir))
    stable = F.substring("product_id", 7, 9).cast("int") % 5 != 0
    classes = daily.select("product_id", F.when(stable, "stable").otherwise("other_known").alias("stability")).distinct()
    return mix.product_compare(daily, classes, MONTH, BEFORE)


@query(f"WITH {SALES_SQL} SELECT * FROM pc")
def product_categories(spark, sf_dir):
    return mix.product_categories(_sales(spark, sf_dir), FOCUS)


@query(f"WITH {SALES_SQL} SELECT * FROM pd")
def product_daily(spark, sf_dir):
    return mix.product_daily(_focus(spark, sf_dir))


@query(f"WITH {SALES_SQL} SELECT utc_date, count(*) AS purchases, CAST(sum(amount) AS DECIMAL(38,2)) AS amount, count(DISTINCT product_id) AS products, count(DISTINCT user_id) AS users, count(*) FILTER (amount < 0 OR amount IS NULL) AS bad_amounts, count(*) FILTER (product_id IS NULL) AS bad_ids FROM fs GROUP BY 1")
def category_check(spark, sf_dir):
    return mix.category_check(_focus(spark, sf_dir))


@query(f"WITH {SALES_SQL}, {CLASS_SQL.format(few=20)} SELECT * FROM cl")
def classify_products(spark, sf_dir):
    return mix.classify_products(mix.product_categories(_sales(spark, sf_dir), FOCUS).where("records >= 20"), FOCUS)


@query(f"WITH {SALES_SQL}, {COMPARE_SQL} SELECT * FROM cmp")
def product_compare(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(f"WITH {SALES_SQL}, {COMPARE_SQL} SELECT part, count(*) AS products, round(coalesce(sum(change), 0), 3) AS change, round(coalesce(sum(quantity_effect), 0), 3) AS quantity_effect, round(coalesce(sum(amount_effect), 0), 3) AS amount_effect FROM cmp GROUP BY 1")
def mix_parts(spark, sf_dir):
    return mix.mix_parts(_compared(spark, sf_dir))


@query(f"""WITH {SALES_SQL}, {COMPARE_SQL}, f AS ((SELECT product_id, 'decline' AS role FROM cmp WHERE change < 0 ORDER BY change, product_id LIMIT 5) UNION ALL (SELECT product_id, 'offset' FROM cmp WHERE change > 0 ORDER BY change DESC, product_id LIMIT 2)), t AS (SELECT unnest(['1998-03-01', '1998-02-01', '1998-01-01', '1997-12-01']) AS day)
SELECT f.product_id, role, day, coalesce(purchases, 0) AS purchases, CAST(coalesce(amount, 0) AS DECIMAL(38,2)) AS amount FROM f CROSS JOIN t LEFT JOIN pd ON pd.product_id = f.product_id AND CAST(utc_date AS VARCHAR) = day""")
def focus_products(spark, sf_dir):
    return mix.focus_products(_compared(spark, sf_dir), mix.product_daily(_focus(spark, sf_dir)), [MONTH, *BEFORE])


@query(f"""WITH {SALES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY utc_date ORDER BY amount DESC, product_id) AS nth FROM pd)
SELECT utc_date, CAST(sum(purchases) AS BIGINT) AS purchases, round(CAST(sum(amount) AS DOUBLE) / CAST(sum(purchases) AS DOUBLE), 4) AS mean_amount, round(CAST(sum(amount) FILTER (nth <= 1) AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 6) AS top1_share, round(CAST(sum(amount) FILTER (nth <= 5) AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 6) AS top5_share FROM r GROUP BY 1""")
def mix_daily_rows(spark, sf_dir):
    return mix.mix_daily_rows(mix.product_daily(_focus(spark, sf_dir)))


#: Price paths: the state of a price is 10 - 10 * discount, a success is a return.
PATH_SQL = r"""
pp AS (SELECT p_brand AS product_id, CAST(10 - 10 * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS price, CAST(l_suppkey AS VARCHAR) AS user_id, CAST(date_trunc('year', l_shipdate) AS DATE) AS day, l_returnflag = 'R' AS success, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey),
sc AS (SELECT product_id, price, count(*) AS paths, count(DISTINCT user_id) AS users, count(DISTINCT day) AS days FROM pp GROUP BY ALL),
su AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY paths DESC, price) AS INTEGER) AS price_rank, CAST(sum(paths) OVER (PARTITION BY product_id) AS BIGINT) AS total_paths FROM sc),
p2 AS (SELECT product_id, min(price) AS low_price, max(price) AS high_price, min(paths) AS min_paths, min(users) AS min_users, min(days) AS min_days, CAST(sum(paths) AS BIGINT) AS pair_paths, max(total_paths) AS total_paths FROM su WHERE price_rank <= 2 GROUP BY 1 HAVING count(*) = 2),
pairs AS (SELECT *, min_paths >= 30 AS paths_ok, min_users >= 5 AS users_ok, min_days >= 3 AS days_ok, pair_paths >= total_paths * 0.15 AS coverage_ok, high_price - low_price >= high_price * 0.02 AND high_price - low_price <= high_price * 0.30 AS gap_ok FROM p2),
cd AS (SELECT * FROM pairs WHERE paths_ok AND users_ok AND days_ok AND coverage_ok AND gap_ok ORDER BY min_users DESC, min_paths DESC, product_id LIMIT 8),
sd AS (SELECT pp.*, CASE WHEN price = low_price THEN 'low' WHEN price = high_price THEN 'high' END AS side FROM pp JOIN cd USING (product_id) WHERE price IN (low_price, high_price)),
co AS (SELECT product_id, user_id, day, side, count(*) AS n, count(*) FILTER (success) AS y FROM sd GROUP BY ALL),
dy AS (SELECT product_id, day, coalesce(sum(n) FILTER (side = 'low'), 0) AS nl, coalesce(sum(n) FILTER (side = 'high'), 0) AS nh, coalesce(sum(y) FILTER (side = 'low'), 0) AS yl, coalesce(sum(y) FILTER (side = 'high'), 0) AS yh FROM co GROUP BY ALL),
ra AS (SELECT product_id, sum(nl) AS nl, sum(nh) AS nh, sum(yl) AS yl, sum(yh) AS yh FROM dy GROUP BY 1),
cm AS (SELECT *, (nl + nh) / CAST(sum(nl + nh) OVER (PARTITION BY product_id) AS DOUBLE) AS w FROM dy WHERE nl >= 10 AND nh >= 10),
sw AS (SELECT product_id, count(*) AS k, sum(w * yl / CAST(nl AS DOUBLE)) AS sl, sum(w * yh / CAST(nh AS DOUBLE)) AS sh FROM cm GROUP BY 1),
cp AS (SELECT product_id, coalesce(k, 0) AS common_days, round(yl / CAST(nl AS DOUBLE), 6) AS raw_low, round(yh / CAST(nh AS DOUBLE), 6) AS raw_high, round(CASE WHEN k >= 3 THEN sl END, 6) AS std_low, round(CASE WHEN k >= 3 THEN sh END, 6) AS std_high, round(CASE WHEN k >= 3 THEN 100 * (sl - sh) END, 4) AS difference_pp, CASE WHEN k >= 3 THEN 'defined' ELSE 'date_comparison_not_supported' END AS status FROM ra LEFT JOIN sw USING (product_id))"""


def _paths(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price = (10 - 10 * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,2)")
    return rows.select(F.col("p_brand").alias("product_id"), price.alias("price"), F.col("l_suppkey").cast("string").alias("user_id"), F.to_date(F.trunc("l_shipdate", "year")).alias("day"), (F.col("l_returnflag") == "R").alias("success"), "l_orderkey")


def _pairs(spark, sf_dir):
    return pricing.pairs(pricing.support(_paths(spark, sf_dir)), 30, 5, 3, coverage="0.15")


def _chosen(spark, sf_dir):
    return pricing.candidates(_pairs(spark, sf_dir), 8)


def _compact(spark, sf_dir):
    return pricing.compact(_paths(spark, sf_dir), _chosen(spark, sf_dir))


@query(f"WITH {PATH_SQL}, o AS (SELECT CASE WHEN l_orderkey % 31 = 0 THEN NULL WHEN l_orderkey % 37 = 0 THEN -price WHEN l_orderkey % 41 = 0 THEN 0 ELSE price END AS price FROM pp), s AS (SELECT CASE WHEN price IS NULL THEN 'missing' WHEN price < 0 THEN 'negative' WHEN price = 0 THEN 'zero' ELSE 'usable' END AS state FROM o) SELECT v.s AS state, count(s.state) AS n FROM (VALUES ('missing'), ('negative'), ('zero'), ('usable')) v(s) LEFT JOIN s ON s.state = v.s GROUP BY 1")
def price_exclusions(spark, sf_dir):
    k = F.col("l_orderkey")
    odd = F.when(k % 31 == 0, F.lit(None)).when(k % 37 == 0, -F.col("price")).when(k % 41 == 0, F.lit(0)).otherwise(F.col("price"))
    return pricing.exclusions(_paths(spark, sf_dir).withColumn("price", odd))


@query(f"WITH {PATH_SQL} SELECT * FROM su")
def price_support(spark, sf_dir):
    return pricing.support(_paths(spark, sf_dir))


@query(f"WITH {PATH_SQL} SELECT * FROM pairs")
def price_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


_STEPS = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS step, '{f}' AS flag, count(*) FILTER ({f}) AS alone, count(*) FILTER ({' AND '.join(pricing.FLAGS[: k + 1])}) AS cumulative FROM pairs" for k, f in enumerate(pricing.FLAGS))


@query(f"WITH {PATH_SQL} {_STEPS}")
def price_feasibility(spark, sf_dir):
    return pricing.feasibility(_pairs(spark, sf_dir))


@query(f"WITH {PATH_SQL} SELECT * FROM cd")
def price_candidates(spark, sf_dir):
    return _chosen(spark, sf_dir)


@query(f"WITH {PATH_SQL} SELECT product_id, side, count(*) AS paths, count(DISTINCT user_id) AS users, count(*) FILTER (success) AS successes, min(day) AS first_day, max(day) AS last_day FROM sd GROUP BY ALL")
def price_pair_support(spark, sf_dir):
    return pricing.pair_support(_paths(spark, sf_dir), _chosen(spark, sf_dir))


@query(f"WITH {PATH_SQL} SELECT * FROM co")
def price_compact(spark, sf_dir):
    return _compact(spark, sf_dir)


@query(f"WITH {PATH_SQL} SELECT * FROM cp")
def price_compare(spark, sf_dir):
    return pricing.compare(_compact(spark, sf_dir))


@query(f"""WITH {PATH_SQL}, bh AS (SELECT product_id, side, n, y, b, {resample.block_hash_sql(7, "b", "user_id")} AS h FROM co, range({1000 // resample.LANES}) r(b)),
bw AS (SELECT product_id, side, n, y, b * {resample.LANES} + lane AS repetition, {resample.poisson_one_sql("h", "lane")} AS w FROM bh, range({resample.LANES}) l(lane)),
bs AS (SELECT product_id, repetition, coalesce(sum(n * w) FILTER (side = 'low'), 0) AS nl, coalesce(sum(n * w) FILTER (side = 'high'), 0) AS nh, coalesce(sum(y * w) FILTER (side = 'low'), 0) AS yl, coalesce(sum(y * w) FILTER (side = 'high'), 0) AS yh FROM bw GROUP BY ALL),
bd AS (SELECT product_id, CASE WHEN nl > 0 AND nh > 0 THEN yl / CAST(nl AS DOUBLE) - yh / CAST(nh AS DOUBLE) END AS d FROM bs)
SELECT product_id, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high, count(*) FILTER (d IS NULL) AS invalid FROM bd GROUP BY 1""")
def price_cluster_bootstrap(spark, sf_dir):
    out = pricing.cluster_bootstrap(_compact(spark, sf_dir), 1000, 7)
    return out.withColumns({"ci_low": F.round("ci_low", 6), "ci_high": F.round("ci_high", 6)})


@query(f"""WITH {PATH_SQL}, g AS (SELECT cp.*, m, CAST((high_price - low_price) AS DOUBLE) / CAST(high_price AS DOUBLE) AS d FROM cp JOIN cd USING (product_id), (VALUES (CAST(0.05 AS DOUBLE)), (0.2), (0.5)) v(m))
SELECT product_id, CAST(m AS DOUBLE) AS m, round(d, 6) AS d, round(CASE WHEN std_high > 0 AND m > d THEN m / (m - d) END, 6) AS required_rate_ratio, round(CASE WHEN std_high > 0 AND m > d THEN std_high * (m / (m - d)) END, 6) AS required_low_rate, round(std_low * (m - d) - std_high * m, 6) AS contribution_difference,
  CASE WHEN m <= d THEN 'unit_contribution_nonpositive' WHEN std_high = 0 THEN 'zero_high_rate_no_relative_threshold' WHEN std_high * (m / (m - d)) > 1 THEN 'required_probability_unattainable' ELSE 'defined' END AS status FROM g""")
def margin_threshold(spark, sf_dir):
    gaps = _chosen(spark, sf_dir).select("product_id", ((F.col("high_price") - F.col("low_price")).cast("double") / F.col("high_price").cast("double")).alias("d"))
    return pricing.margin_threshold(pricing.compare(_compact(spark, sf_dir)), gaps, [0.05, 0.2, 0.5])


BASKET_SQL = r"""
bk AS (SELECT l_orderkey AS basket_id, CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(20,5)) AS s0, CAST(0.3 AS DECIMAL(4,2)) AS m0, CAST(count(DISTINCT p_type) AS INTEGER) AS h, CAST(4 AS DECIMAL(9,2)) AS l0
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
st AS (SELECT strategy, CAST(fee AS DECIMAL(6,2)) AS fee, CAST(taken AS DECIMAL(4,2)) AS taken, CAST(factor AS DECIMAL(4,2)) AS factor, CAST(l AS DECIMAL(9,2)) AS l, more FROM (VALUES ('REFERENCE', 0, 0, 1, NULL, 0), ('ABSORB', 3, 0, 1, NULL, 0),
  ('PASS_HALF', 3, 0.5, 1, NULL, 0), ('PASS_FULL', 3, 1, 1, NULL, 0), ('ADD_SAME_CATEGORY', 3, 0, 1.25, 5, 0), ('ADD_NEW_CATEGORY', 3, 0, 1.25, 5, 1)) v(strategy, fee, taken, factor, l, more)),
bs AS (SELECT bk.*, st.*, CAST(s0 * factor AS DECIMAL(26,7)) AS goods, CAST(fee * (h + more) AS DECIMAL(18,2)) AS charge FROM bk, st),
bp AS (SELECT *, CAST(goods + CAST(fee * taken AS DECIMAL(12,4)) * h AS DECIMAL(26,7)) AS s FROM bs),
con AS (SELECT basket_id, strategy, s, charge, CAST(s - CAST(goods * (1 - m0) AS DECIMAL(30,9)) - coalesce(l, l0) - charge AS DECIMAL(30,9)) AS contribution FROM bp)"""


def _baskets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    goods = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)") * F.lit("0.001").cast("decimal(4,3)")
    fixed = lambda text, kind: F.lit(text).cast(kind)
    return rows.groupBy(F.col("l_orderkey").alias("basket_id")).agg(goods.cast("decimal(20,5)").alias("s0"), F.countDistinct("p_type").cast("int").alias("h")).withColumns({"m0": fixed("0.3", "decimal(4,2)"), "l0": fixed("4", "decimal(9,2)")})


@query(f"WITH {BASKET_SQL} SELECT * FROM con")
def basket_strategies(spark, sf_dir):
    return pricing.basket_strategies(_baskets(spark, sf_dir))


@query(f"""WITH {BASKET_SQL}, j AS (SELECT a.basket_id, a.strategy, CAST(a.contribution AS DOUBLE) AS b, CAST(r.contribution AS DOUBLE) AS a, CAST(t AS DOUBLE) AS retention FROM con a JOIN con r ON a.basket_id = r.basket_id AND r.strategy = 'REFERENCE' AND a.strategy <> 'REFERENCE', (VALUES (CAST(0.8 AS DOUBLE)), (0.9)) v(t))
SELECT strategy, retention, CASE WHEN a <= 0 THEN 'reference_nonpositive' WHEN b <= 0 THEN 'strategy_nonpositive' WHEN a / b <= 1 THEN 'decline_bound_or_no_decline' ELSE 'lift_required' END AS status, count(*) AS baskets, round(avg(CASE WHEN a > 0 AND b > 0 THEN a / b END), 3) AS mean_required_ratio FROM j GROUP BY ALL""")
def basket_thresholds(spark, sf_dir):
    out = pricing.basket_thresholds(pricing.basket_strategies(_baskets(spark, sf_dir)), [0.8, 0.9])
    return out.groupBy("strategy", "retention", "status").agg(F.count("*").alias("baskets"), F.round(F.avg("required_ratio"), 3).alias("mean_required_ratio"))
