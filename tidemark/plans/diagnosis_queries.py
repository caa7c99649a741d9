"""Screening over days of orders (amount o_totalprice) and of events, and attribution of one day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import money
from ..operators import diagnosis, metrics
from ..operators.profile import calendar
from ..sources.tables import table
from .metric_queries import BASE_SQL, Tables
from .registry import query

#: A day whose history is complete in the order dates.
DAY = "1998-03-18"

#: Days of orders by priority; the amount of a day is blocked where its day of year is divisible by 29.
DAYS_SQL = r"""
od AS (SELECT CAST(o_orderdate AS DATE) AS utc_date, o_orderpriority AS prio, CAST(o_totalprice AS DECIMAL(18,2)) AS a, o_custkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01'),
days AS (SELECT utc_date, count(DISTINCT o_custkey) AS active_users, count(DISTINCT o_custkey) FILTER (o_orderstatus <> 'P') AS buyers, count(*) AS event_records, count(*) FILTER (o_orderstatus <> 'P') AS purchase_events, CAST(coalesce(sum(a) FILTER (o_orderstatus <> 'P'), 0) AS DECIMAL(38,2)) AS purchase_amount, TRUE AS count_allowed, dayofyear(utc_date) % 29 <> 0 AS amount_allowed FROM od GROUP BY 1),
cal AS (SELECT CAST(unnest(range(DATE '1998-01-01', DATE '1998-07-01', INTERVAL 1 DAY)) AS DATE) AS utc_date)"""


def _screen_sql(days: str, out: str) -> str:
    return f"""{out}_h AS (SELECT c.utc_date, c.utc_date - o.n AS d, CASE WHEN c.utc_date - o.n < DATE '1998-01-01' THEN 'outside_observation:' WHEN b.utc_date IS NULL THEN 'missing_date:' WHEN NOT b.amount_allowed THEN 'quality_blocked:' END AS why, b.purchase_amount AS x FROM cal c, (VALUES (7), (14), (21), (28)) o(n) LEFT JOIN {days} b ON b.utc_date = c.utc_date - o.n),
{out}_c AS (SELECT utc_date, count(*) FILTER (why IS NULL) AS n, median(CAST(x AS DOUBLE)) FILTER (why IS NULL) AS m, min(x) FILTER (why IS NULL) AS lo, count(*) FILTER (why IN ('missing_date:', 'quality_blocked:')) AS gaps, coalesce(string_agg(why || CAST(d AS VARCHAR), ';' ORDER BY d DESC), '') AS reason FROM {out}_h GROUP BY 1),
{out}_m AS (SELECT h.utc_date, median(abs(CAST(x AS DOUBLE) - m)) AS mad FROM {out}_h h JOIN {out}_c USING (utc_date) WHERE why IS NULL GROUP BY 1),
{out}_s AS (SELECT c.*, mad, b.amount_allowed AS ok, b.purchase_amount AS a, CAST(b.purchase_amount AS DOUBLE) AS v FROM {out}_c c LEFT JOIN {out}_m USING (utc_date) LEFT JOIN {days} b USING (utc_date)),
{out}_t AS (SELECT *, CASE WHEN ok IS NULL THEN 'current_date_missing' WHEN NOT ok THEN 'current_quality_blocked' WHEN n < 3 THEN CASE WHEN gaps > 0 THEN 'insufficient_history_with_gaps' ELSE 'insufficient_history' END WHEN v < 0 OR lo < 0 THEN 'negative_amount_invalid' WHEN m <= 0 THEN 'zero_baseline' WHEN mad = 0 THEN 'zero_scale' WHEN gaps > 0 THEN 'evaluated_with_history_gaps' ELSE 'evaluated' END AS status FROM {out}_s),
{out} AS (SELECT utc_date, status, n AS history_count, reason, a AS current_amount, round(CASE WHEN ok AND n >= 3 THEN m END, 4) AS median_amount, round(CASE WHEN ok AND n >= 3 THEN mad END, 4) AS mad, round(CASE WHEN status LIKE 'evaluated%' THEN (v - m) / (mad * 1.4826) END, 6) AS score, round(CASE WHEN status LIKE 'evaluated%' OR status = 'zero_scale' THEN (v - m) / m END, 6) AS relative_change,
  round(CASE WHEN ok AND n >= 3 THEN v - m END, 4) AS amount_difference, status LIKE 'evaluated%' OR status = 'zero_scale' AS comparable, coalesce(status LIKE 'evaluated%' AND abs((v - m) / (mad * 1.4826)) > 3 AND abs((v - m) / m) >= 0.1, FALSE) AS candidate FROM {out}_t)"""


def _days(spark, sf_dir, *by):
    d = F.col("o_orderdate")
    held = table(spark, sf_dir, "orders").where((d >= F.lit("1998-01-01").cast("timestamp_ntz")) & (d < F.lit("1998-07-01").cast("timestamp_ntz")))
    f = F.col("o_orderstatus") != "P"
    days = held.groupBy(F.to_date(d).alias("utc_date"), *by).agg(
        F.countDistinct("o_custkey").alias("active_users"), F.countDistinct(F.when(f, F.col("o_custkey"))).alias("buyers"), F.count("*").alias("event_records"), F.count_if(f).alias("purchase_events"),
        money(F.coalesce(F.sum(F.when(f, F.col("o_totalprice").cast("decimal(18,2)"))), F.lit(0))).alias("purchase_amount"),
    )
    return days.withColumn("count_allowed", F.lit(True)).withColumn("amount_allowed", F.dayofyear("utc_date") % 29 != 0)


def _calendar(spark):
    return calendar(spark, "1998-01-01", "1998-06-30", "utc_date")


@query(f"WITH {DAYS_SQL}, {_screen_sql('days', 's')} SELECT * FROM s")
def screen_changes(spark, sf_dir):
    return diagnosis.screen(_days(spark, sf_dir), _calendar(spark))


@query(f"""WITH {DAYS_SQL}, {_screen_sql('days', 's')}, k AS (SELECT *, CASE WHEN candidate AND amount_difference < 0 THEN 0 WHEN candidate THEN 1 WHEN comparable THEN 2 END AS kind FROM s)
SELECT utc_date, amount_difference, CASE kind WHEN 0 THEN 'downward_candidate' WHEN 1 THEN 'other_candidate' ELSE 'descriptive_not_candidate' END AS selection FROM k WHERE kind IS NOT NULL ORDER BY kind, abs(amount_difference) DESC, utc_date LIMIT 1""")
def select_case(spark, sf_dir):
    return diagnosis.select_case(diagnosis.screen(_days(spark, sf_dir), _calendar(spark)))


_ROLE_SQL = f"CASE WHEN utc_date = DATE '{DAY}' THEN 'now' WHEN DATE '{DAY}' - utc_date IN (7, 14, 21, 28) THEN 'then' END"


@query(f"""WITH {DAYS_SQL}, r AS (SELECT *, {_ROLE_SQL} AS role FROM days WHERE amount_allowed),
f AS (SELECT avg(active_users) FILTER (role = 'now') AS u1, avg(active_users) FILTER (role = 'then') AS u0, avg(buyers) FILTER (role = 'now') AS b1, avg(buyers) FILTER (role = 'then') AS b0, avg(CAST(purchase_amount AS DOUBLE)) FILTER (role = 'now') AS v1, avg(CAST(purchase_amount AS DOUBLE)) FILTER (role = 'then') AS v0 FROM r),
l AS (SELECT 'U' AS factor, u1 AS a, u0 AS b, ln(v1 / v0) AS t FROM f UNION ALL SELECT 'B', b1, b0, ln(v1 / v0) FROM f UNION ALL SELECT 'R', b1 / u1, b0 / u0, ln(v1 / v0) FROM f UNION ALL SELECT 'M', v1 / b1, v0 / b0, ln(v1 / v0) FROM f UNION ALL SELECT 'V', v1, v0, ln(v1 / v0) FROM f)
SELECT factor, round(a, 6) AS current, round(b, 6) AS history_mean, round(ln(a / b), 6) AS log_change, round(CASE WHEN factor IN ('U', 'R', 'M') AND abs(t) > 1e-10 THEN ln(a / b) / t END, 6) AS log_share FROM l""")
def decompose_uRM(spark, sf_dir):
    return diagnosis.decompose(_days(spark, sf_dir), DAY)


#: Two dimensions of the orders of usable days.
DIMS_SQL = r"""
dm AS (SELECT utc_date, 'category_l1' AS dim_name, CASE WHEN prio LIKE '5%' THEN 'bucket:unknown' ELSE prio END AS dim_value_key, a, o_orderstatus FROM od UNION ALL SELECT utc_date, 'customer', 'c' || (o_custkey % 9), a, o_orderstatus FROM od),
dims AS (SELECT utc_date, dim_name, dim_value_key, count(*) AS event_records, count(*) FILTER (o_orderstatus <> 'P') AS purchase_events, CASE WHEN dayofyear(utc_date) % 29 <> 0 THEN CAST(coalesce(sum(a) FILTER (o_orderstatus <> 'P'), 0) AS DECIMAL(38,2)) END AS purchase_amount FROM dm GROUP BY utc_date, dim_name, dim_value_key)"""

ATTR_SQL = f"""{DIMS_SQL}, g AS (SELECT *, DATE '{DAY}' - utc_date AS gap FROM dims WHERE purchase_amount IS NOT NULL AND DATE '{DAY}' - utc_date IN (0, 7, 14, 21, 28)),
hn AS (SELECT count(DISTINCT utc_date) AS hd FROM g WHERE gap > 0), c1 AS (SELECT dim_name, dim_value_key, CAST(coalesce(sum(purchase_amount) FILTER (gap = 0), 0) AS DECIMAL(38,2)) AS current_amount, CAST(coalesce(sum(purchase_amount) FILTER (gap > 0), 0) AS DOUBLE) / any_value(hd) AS b FROM g, hn GROUP BY dim_name, dim_value_key),
c2 AS (SELECT *, CAST(current_amount AS DOUBLE) AS a, CAST(current_amount AS DOUBLE) - b AS ch, sum(CAST(current_amount AS DOUBLE)) OVER (PARTITION BY dim_name) AS ta, sum(b) OVER (PARTITION BY dim_name) AS tb FROM c1),
c3 AS (SELECT *, ta - tb AS dl, abs(ta - tb) <= 1e-10 * greatest(abs(ta), abs(tb), 1) AS near FROM c2),
c4 AS (SELECT *, CASE WHEN near AND abs(ch) > 1e-9 THEN 'total_near_zero' WHEN abs(ch) <= 1e-9 THEN 'unchanged' WHEN ch * dl > 0 THEN 'same_direction' ELSE 'offsetting' END AS direction,
  CASE WHEN ta > 0 AND tb > 0 THEN 0.5 * (CASE WHEN a > 0 THEN a / ta * log2(2 * (a / ta) / (a / ta + b / tb)) ELSE 0 END + CASE WHEN b > 0 THEN b / tb * log2(2 * (b / tb) / (a / ta + b / tb)) ELSE 0 END) END AS js FROM c3),
attr AS (SELECT dim_name, dim_value_key, current_amount, round(b, 6) AS history_mean, round(ch, 6) AS amount_difference, round(CASE WHEN NOT near THEN ch / dl END, 6) AS signed_contribution, direction,
  CASE WHEN direction IN ('same_direction', 'offsetting') THEN CAST(row_number() OVER w AS INTEGER) END AS direction_rank, round(CASE WHEN direction = 'same_direction' THEN sum(abs(ch)) OVER (w ROWS UNBOUNDED PRECEDING) / sum(abs(ch)) OVER (PARTITION BY dim_name, direction) END, 6) AS cumulative_share, round(js, 9) AS js_component
  FROM c4 WINDOW w AS (PARTITION BY dim_name, direction ORDER BY round(abs(ch), 6) DESC, dim_value_key))"""


def _dims(spark, sf_dir):
    d = F.col("o_orderdate")
    held = table(spark, sf_dir, "orders").where((d >= F.lit("1998-01-01").cast("timestamp_ntz")) & (d < F.lit("1998-07-01").cast("timestamp_ntz")))
    prio = F.when(F.col("o_orderpriority").startswith("5"), "bucket:unknown").otherwise(F.col("o_orderpriority"))
    cell = F.explode(F.array(F.struct(F.lit("category_l1").alias("dim_name"), prio.alias("dim_value_key")), F.struct(F.lit("customer").alias("dim_name"), F.concat(F.lit("c"), (F.col("o_custkey") % 9).cast("string")).alias("dim_value_key"))))
    f = F.col("o_orderstatus") != "P"
    known = money(F.coalesce(F.sum(F.when(f, F.col("o_totalprice").cast("decimal(18,2)"))), F.lit(0)))
    long = held.select(F.to_date(d).alias("utc_date"), "o_orderstatus", "o_totalprice", cell.alias("x")).select("*", "x.*")
    return long.groupBy("utc_date", "dim_name", "dim_value_key").agg(F.count("*").alias("event_records"), F.count_if(f).alias("purchase_events"), known.alias("known")).withColumn("purchase_amount", F.when(F.dayofyear("utc_date") % 29 != 0, F.col("known"))).drop("known")


@query(f"WITH {DAYS_SQL}, {ATTR_SQL} SELECT * FROM attr")
def attribute_dim(spark, sf_dir):
    return diagnosis.attribute(_dims(spark, sf_dir), DAY)


@query(f"WITH {DAYS_SQL}, {ATTR_SQL} SELECT dim_name, round(sum(js_component), 6) AS js_divergence, CASE WHEN count(js_component) = 0 THEN 'zero_distribution' ELSE 'defined' END AS js_status FROM attr GROUP BY 1")
def js_divergence(spark, sf_dir):
    return diagnosis.js_divergence(diagnosis.attribute(_dims(spark, sf_dir), DAY))


@query(f"""WITH {DAYS_SQL}, {ATTR_SQL} SELECT dim_name, CAST(sum(current_amount) AS DECIMAL(38,2)) AS current_total, round(sum(history_mean), 4) AS history_total, round(coalesce(sum(abs(amount_difference)) FILTER (direction = 'same_direction'), 0), 4) AS same_direction, round(coalesce(sum(abs(amount_difference)) FILTER (direction = 'offsetting'), 0), 4) AS offsetting, min(direction_rank) FILTER (cumulative_share >= 0.67) AS buckets_to_part FROM attr GROUP BY 1""")
def attribute_summary(spark, sf_dir):
    return diagnosis.attribute_summary(diagnosis.attribute(_dims(spark, sf_dir), DAY))


@query(f"""WITH {DAYS_SQL}, {DIMS_SQL}, g AS (SELECT *, CASE WHEN utc_date = DATE '{DAY}' THEN 'current' ELSE 'history' END AS period, dim_value_key = 'bucket:unknown' AS un FROM dims WHERE dim_name = 'category_l1' AND purchase_amount IS NOT NULL AND DATE '{DAY}' - utc_date IN (0, 7, 14, 21, 28))
SELECT period, round(1 - coalesce(sum(event_records) FILTER (un), 0) / CAST(sum(event_records) AS DOUBLE), 6) AS events_known, round(1 - coalesce(sum(purchase_events) FILTER (un), 0) / CAST(sum(purchase_events) AS DOUBLE), 6) AS purchases_known, round(1 - CAST(coalesce(sum(purchase_amount) FILTER (un), 0) AS DOUBLE) / CAST(sum(purchase_amount) AS DOUBLE), 6) AS amount_known FROM g GROUP BY 1""")
def case_coverage(spark, sf_dir):
    return diagnosis.case_coverage(_dims(spark, sf_dir), DAY)


@query(f"""WITH {DAYS_SQL}, {DIMS_SQL}, g AS (SELECT dim_value_key AS k, DATE '{DAY}' - utc_date AS gap, purchase_amount AS x, utc_date FROM dims WHERE dim_name = 'category_l1' AND purchase_amount IS NOT NULL AND DATE '{DAY}' - utc_date IN (0, 7, 14, 21, 28)), n AS (SELECT count(DISTINCT utc_date) AS n FROM g WHERE gap > 0),
c AS (SELECT k, CAST(coalesce(sum(x) FILTER (gap = 0), 0) AS DOUBLE) AS a, CAST(coalesce(sum(x) FILTER (gap > 0), 0) AS DOUBLE) / any_value(n.n) AS m FROM g, n GROUP BY k), w AS (SELECT sum(a) / sum(m) - 1 AS t FROM c)
SELECT k AS category_key, round(m, 4) AS history_mean, round(CASE WHEN m > 0 THEN a / m - 1 END, 6) AS relative_change, round(100 * (CASE WHEN m > 0 THEN a / m - 1 END - t), 4) AS points_vs_total, CASE WHEN m > 0 THEN 'defined' ELSE 'zero_history' END AS status FROM c, w""")
def compare_categories(spark, sf_dir):
    days = _dims(spark, sf_dir).where("dim_name = 'category_l1'").withColumnRenamed("dim_value_key", "category_key")
    return diagnosis.compare_categories(days, _calendar(spark), DAY)


@query(f"WITH {DAYS_SQL} SELECT utc_date, purchase_amount FROM days WHERE isodow(utc_date) = 5 AND utc_date >= DATE '1998-02-01'")
def weekday_filter(spark, sf_dir):
    return diagnosis.weekday_filter(_days(spark, sf_dir), 4, "1998-02-01").select("utc_date", "purchase_amount")


@query(f"""WITH {DAYS_SQL}, days2 AS (SELECT * REPLACE (amount_allowed AND utc_date NOT IN (DATE '1998-03-04', DATE '1998-04-01') AS amount_allowed) FROM days), {_screen_sql('days', 's')}, {_screen_sql('days2', 's2')}
SELECT s.utc_date, s.status AS status_all, s.score AS score_all, s2.status AS status_without, s2.score AS score_without FROM s JOIN s2 USING (utc_date)""")
def sensitivity_exclude_dates(spark, sf_dir):
    return diagnosis.sensitivity_exclude_dates(_days(spark, sf_dir), _calendar(spark), ["1998-03-04", "1998-04-01"])
