"""Cohorts over orders (a purchase is an order of status F), and first-cart windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import count_where, money
from ..operators import cohorts
from ..sources.tables import FACT_SQL, facts, table
from .registry import query

PRE, POST, END = "1998-01-01", "1998-07-01", "1999-01-01"

ORDERS_SQL = r"""
u AS (SELECT 'orders' AS scope_id, CAST(o_orderdate AS DATE) AS utc_date, CAST(o_custkey AS VARCHAR) AS user_id, count(*) AS event_records, count(*) FILTER (o_orderstatus = 'F') AS purchase_events,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 97 = 0) AS purchase_amount_bad, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 97 <> 0) AS purchase_amount_valid,
  CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F' AND o_orderkey % 97 <> 0), 0) AS DECIMAL(38,2)) AS purchase_amount, TRUE AS amount_allowed FROM orders GROUP BY ALL),
pre AS (SELECT user_id, sum(event_records) AS n, sum(purchase_events) AS p, sum(purchase_amount_bad) AS bad, sum(purchase_amount_valid) AS valid, sum(purchase_amount) AS a FROM u WHERE utc_date >= DATE '1998-01-01' AND utc_date < DATE '1998-07-01' GROUP BY 1),
post AS (SELECT user_id, sum(event_records) AS n, sum(purchase_events) AS p, sum(purchase_amount_bad) AS bad, sum(purchase_amount_valid) AS valid, sum(purchase_amount) AS a FROM u WHERE utc_date >= DATE '1998-07-01' AND utc_date < DATE '1999-01-01' GROUP BY 1),
cohort AS (SELECT sha256('cohort-key-v1|6:orders' || length(pre.user_id) || ':' || pre.user_id) AS cohort_key, 'orders' AS scope_id, pre.user_id, CAST(pre.n AS BIGINT) AS pre_event_records, CAST(pre.p AS BIGINT) AS pre_purchase_events,
  CAST(CASE WHEN pre.bad = 0 THEN pre.a END AS DECIMAL(38,2)) AS pre_purchase_amount, CASE WHEN pre.bad > 0 THEN CASE WHEN pre.valid > 0 THEN 'partial_observed' ELSE 'unknown' END WHEN pre.p = 0 THEN 'no_purchases' ELSE 'complete_observed' END AS pre_amount_status,
  CAST(post.user_id IS NOT NULL AS INTEGER) AS post_active, CAST(coalesce(post.p, 0) > 0 AS INTEGER) AS post_converted, CAST(coalesce(post.n, 0) AS BIGINT) AS post_event_records, CAST(coalesce(post.p, 0) AS BIGINT) AS post_purchase_events,
  CAST(CASE WHEN coalesce(post.bad, 0) = 0 THEN coalesce(post.a, 0) END AS DECIMAL(38,2)) AS post_purchase_amount, CASE WHEN coalesce(post.bad, 0) > 0 THEN CASE WHEN post.valid > 0 THEN 'partial_observed' ELSE 'unknown' END WHEN coalesce(post.p, 0) = 0 THEN 'no_purchases' ELSE 'complete_observed' END AS post_amount_status
  FROM pre LEFT JOIN post USING (user_id))"""


def _users(spark, sf_dir):
    f = F.col("o_orderstatus") == "F"
    bad = F.col("o_orderkey") % 97 == 0
    return table(spark, sf_dir, "orders").groupBy(F.lit("orders").alias("scope_id"), F.to_date("o_orderdate").alias("utc_date"), F.col("o_custkey").cast("string").alias("user_id")).agg(
        F.count("*").alias("event_records"), count_where(f).alias("purchase_events"), count_where(f & bad).alias("purchase_amount_bad"), count_where(f & ~bad).alias("purchase_amount_valid"),
        money(F.coalesce(F.sum(F.when(f & ~bad, F.col("o_totalprice").cast("decimal(18,2)"))), F.lit(0))).alias("purchase_amount"),
    ).withColumn("amount_allowed", F.lit(True))


def _cohort(spark, sf_dir):
    return cohorts.pre_post(_users(spark, sf_dir), PRE, POST, END)


@query(f"WITH {ORDERS_SQL} SELECT * FROM cohort")
def cohort_pre_post(spark, sf_dir):
    return _cohort(spark, sf_dir)


@query(f"""WITH {ORDERS_SQL} SELECT count(*) AS enrolled, CAST(sum(post_active) AS BIGINT) AS returned, CAST(sum(post_converted) AS BIGINT) AS post_buyers, round(sum(post_converted) / CAST(count(*) AS DOUBLE), 6) AS buyers_per_enrolled,
  round(CASE WHEN sum(post_active) > 0 THEN sum(post_converted) / CAST(sum(post_active) AS DOUBLE) END, 6) AS buyers_per_returned, CASE WHEN bool_and(post_purchase_amount IS NOT NULL) THEN CAST(sum(post_purchase_amount) AS DECIMAL(38,2)) END AS post_amount FROM cohort""")
def cohort_summary(spark, sf_dir):
    return cohorts.summary(_cohort(spark, sf_dir))


@query(f"WITH {ORDERS_SQL} SELECT 'orders' AS scope_id, user_id FROM post WHERE NOT EXISTS (SELECT 1 FROM pre WHERE pre.user_id = post.user_id)")
def cohort_post_only(spark, sf_dir):
    return cohorts.post_only(_users(spark, sf_dir), PRE, POST, END)


@query(f"WITH {ORDERS_SQL} SELECT (SELECT count(*) FROM (SELECT user_id FROM cohort EXCEPT SELECT user_id FROM pre)) AS extra, (SELECT count(*) FROM (SELECT user_id FROM pre EXCEPT SELECT user_id FROM cohort)) AS missing")
def cohort_membership_check(spark, sf_dir):
    return cohorts.membership_check(_cohort(spark, sf_dir), _users(spark, sf_dir), PRE, POST)


@query(f"WITH {ORDERS_SQL} SELECT count(*) AS returned, CAST(sum(n) AS BIGINT) AS event_records, CAST(sum(p) AS BIGINT) AS purchase_events FROM post WHERE user_id IN (SELECT user_id FROM pre)")
def cohort_semijoin_ref(spark, sf_dir):
    return cohorts.semijoin_reference(_cohort(spark, sf_dir), _users(spark, sf_dir), POST, END)


@query(f"WITH {ORDERS_SQL} SELECT count(*) FILTER (user_id IS NULL OR utc_date IS NULL) AS null_keys, count(*) FILTER (purchase_amount_bad + purchase_amount_valid <> purchase_events) AS amount_mismatch, count(*) FILTER (purchase_amount IS NULL) AS gate_mismatch, count(*) - count(DISTINCT (utc_date, user_id)) AS repeated_keys FROM u")
def user_day_validity(spark, sf_dir):
    return cohorts.user_day_validity(_users(spark, sf_dir))


CART_SQL = FACT_SQL + r""",
an AS (SELECT user_id, min(ts) AS t FROM fact WHERE ok AND kind = 'cart' GROUP BY 1),
jn AS (SELECT an.user_id, t, count(*) FILTER (f.ts <= t + INTERVAL 24 HOUR) AS w, count(*) FILTER (f.ts > t + INTERVAL 24 HOUR) AS n, count(*) FILTER (f.ts > t + INTERVAL 24 HOUR AND NOT paid) AS bad, CAST(coalesce(sum(price) FILTER (paid AND f.ts > t + INTERVAL 24 HOUR), 0) AS DECIMAL(38,2)) AS a
  FROM an LEFT JOIN fact f ON f.user_id = an.user_id AND f.ok AND f.kind = 'purchase' AND f.ts >= t AND f.ts <= t + INTERVAL 48 HOUR GROUP BY ALL),
cart AS (SELECT 'events' AS scope_id, user_id, t AS t_cart, t + INTERVAL 24 HOUR AS t0, t + INTERVAL 48 HOUR AS outcome_end, t >= TIMESTAMP '2024-01-01' AND t < TIMESTAMP '2024-01-03' AS window_complete, w AS waiting_purchase_events, n AS outcome_purchase_events, bad AS outcome_bad_amount_events,
  CASE WHEN NOT (t >= TIMESTAMP '2024-01-01' AND t < TIMESTAMP '2024-01-03') THEN 'right_censored' WHEN w > 0 THEN 'waiting_purchase_excluded' ELSE 'eligible' END AS eligibility_status, a FROM jn),
rec AS (SELECT * EXCLUDE (a), CASE WHEN eligibility_status = 'eligible' THEN CAST(outcome_purchase_events > 0 AS INTEGER) END AS purchased_24h, CASE WHEN eligibility_status = 'eligible' AND outcome_bad_amount_events = 0 THEN a END AS purchase_amount_24h,
  CASE WHEN eligibility_status <> 'eligible' THEN 'not_applicable' WHEN outcome_purchase_events = 0 THEN 'no_purchases' WHEN outcome_bad_amount_events = outcome_purchase_events THEN 'unknown' WHEN outcome_bad_amount_events > 0 THEN 'partial_observed' ELSE 'complete_observed' END AS amount_status FROM cart)"""


def _windows(spark, sf_dir):
    return cohorts.cart_recovery(facts(spark, sf_dir), "2024-01-01 00:00:00", "2024-01-03 00:00:00")


@query(f"WITH {CART_SQL} SELECT * FROM rec")
def cart_recovery(spark, sf_dir):
    return _windows(spark, sf_dir)


@query(f"""WITH {CART_SQL} SELECT count(*) AS cart_users, count(*) FILTER (eligibility_status = 'right_censored') AS censored, count(*) FILTER (eligibility_status = 'waiting_purchase_excluded') AS waiting_excluded, count(*) FILTER (eligibility_status = 'eligible') AS eligible, count(*) FILTER (purchased_24h = 1) AS buyers,
  round(CASE WHEN count(*) FILTER (eligibility_status = 'eligible') > 0 THEN count(*) FILTER (purchased_24h = 1) / CAST(count(*) FILTER (eligibility_status = 'eligible') AS DOUBLE) END, 6) AS p_hist, CAST(coalesce(sum(purchase_amount_24h), 0) AS DECIMAL(38,2)) AS known_amount,
  round(CASE WHEN count(*) FILTER (eligibility_status = 'eligible') > 0 THEN CAST(coalesce(sum(purchase_amount_24h), 0) AS DOUBLE) / count(*) FILTER (eligibility_status = 'eligible') END, 6) AS amount_per_eligible FROM rec""")
def cart_recovery_summary(spark, sf_dir):
    return cohorts.cart_recovery_summary(_windows(spark, sf_dir))
