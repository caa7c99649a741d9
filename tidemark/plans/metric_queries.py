"""Behaviour metrics, and checks on their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, gates, metrics, parse
from ..sources.tables import facts, table
from .event_queries import _GATES_SQL
from .registry import query

FIRST, LAST = "2024-01-01", "2024-02-02"

BASE_SQL = _GATES_SQL + r""",
e AS (SELECT * FROM fact WHERE ok), seen AS (SELECT user_id, min(ts) AS first_ts, min(d) AS first_d FROM e GROUP BY 1),
ud AS (SELECT 'events' AS scope_id, e.d AS utc_date, e.user_id, count(*) AS event_records, count(*) FILTER (kind = 'view') AS view_events, count(*) FILTER (kind = 'cart') AS cart_events, count(*) FILTER (kind = 'remove_from_cart') AS remove_from_cart_events,
  count(*) FILTER (kind = 'purchase') AS purchase_events, count(DISTINCT sess) FILTER (NOT no_sess) AS sessions, count(DISTINCT sess) FILTER (NOT no_sess AND kind = 'purchase') AS purchase_sessions,
  count(*) FILTER (kind = 'purchase' AND NOT paid) AS purchase_amount_bad, count(*) FILTER (paid) AS purchase_amount_valid, count(*) FILTER (paid AND price = 0) AS purchase_zero_events, any_value(g.count_allowed) AS count_allowed, any_value(g.amount_allowed) AS amount_allowed,
  count(*) FILTER (kind = 'purchase') > 0 AS is_buyer, any_value(first_d) = e.d AS is_first_seen_day, CASE WHEN any_value(g.amount_allowed) THEN CAST(coalesce(sum(price) FILTER (paid), 0) AS DECIMAL(38,2)) END AS purchase_amount,
  CASE WHEN count(*) FILTER (kind = 'purchase') = 0 THEN 'no_purchases' WHEN count(*) FILTER (kind = 'purchase' AND NOT paid) = 0 THEN 'complete_observed' WHEN count(*) FILTER (paid) > 0 THEN 'partial_observed' ELSE 'unknown' END AS amount_status
  FROM e JOIN seen USING (user_id) JOIN gates g ON g.utc_date = e.d GROUP BY e.d, e.user_id),
daily AS (SELECT scope_id, utc_date, count(*) AS active_users, count(*) FILTER (is_buyer) AS buyers, count(*) FILTER (is_first_seen_day) AS first_seen_users, CAST(sum(event_records) AS BIGINT) AS event_records, CAST(sum(purchase_events) AS BIGINT) AS purchase_events,
  CAST(sum(purchase_amount_bad) AS BIGINT) AS purchase_amount_bad, CAST(sum(purchase_amount_valid) AS BIGINT) AS purchase_amount_valid, CASE WHEN bool_and(amount_allowed) THEN CAST(sum(purchase_amount) AS DECIMAL(38,2)) END AS purchase_amount,
  CASE WHEN sum(purchase_events) = 0 THEN 'no_purchases' WHEN sum(purchase_amount_bad) = 0 THEN 'complete_observed' WHEN sum(purchase_amount_valid) > 0 THEN 'partial_observed' ELSE 'unknown' END AS amount_status, bool_and(count_allowed) AS count_allowed, bool_and(amount_allowed) AS amount_allowed
  FROM ud GROUP BY ALL),
topb AS (SELECT brand, count(*) AS records FROM e WHERE brand <> '' AND d BETWEEN DATE '2024-01-01' AND DATE '2024-01-07' GROUP BY 1 ORDER BY records DESC, brand LIMIT 5),
dimd AS (SELECT e.*, first_d = d AS is_new, CASE WHEN regexp_full_match(code, '[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*') THEN 'category:' || split_part(code, '.', 1) ELSE 'bucket:unknown' END AS category_key,
  CASE WHEN e.brand = '' THEN 'bucket:unknown' WHEN t.brand IS NOT NULL THEN 'brand:' || e.brand ELSE 'bucket:other' END AS brand_key,
  CASE WHEN price IS NULL OR price < 0 THEN 'bucket:unknown' WHEN price < 20 THEN 'band:[0,20)' WHEN price < 50 THEN 'band:[20,50)' WHEN price < 200 THEN 'band:[50,200)' ELSE 'band:[200,+inf)' END AS price_key
  FROM e JOIN seen USING (user_id) LEFT JOIN topb t ON e.brand = t.brand),
long AS (SELECT d, user_id, kind, paid, price, 'category_l1' AS dim_name, category_key AS dim_value_key FROM dimd UNION ALL SELECT d, user_id, kind, paid, price, 'brand_group', brand_key FROM dimd
  UNION ALL SELECT d, user_id, kind, paid, price, 'price_band', price_key FROM dimd UNION ALL SELECT d, user_id, kind, paid, price, 'is_first_seen_day', CASE WHEN is_new THEN 'first_seen:true' ELSE 'first_seen:false' END FROM dimd),
dims AS (SELECT 'events' AS scope_id, d AS utc_date, dim_name, dim_value_key, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (kind = 'purchase') AS buyers, count(*) AS event_records, count(*) FILTER (kind = 'purchase') AS purchase_events,
  CASE WHEN any_value(amount_allowed) THEN CAST(coalesce(sum(price) FILTER (paid), 0) AS DECIMAL(38,2)) END AS purchase_amount,
  CASE WHEN count(*) FILTER (kind = 'purchase') = 0 THEN 'no_purchases' WHEN count(*) FILTER (kind = 'purchase' AND NOT paid) = 0 THEN 'complete_observed' WHEN count(*) FILTER (paid) > 0 THEN 'partial_observed' ELSE 'unknown' END AS amount_status
  FROM long JOIN gates ON utc_date = d GROUP BY ALL)"""


class Tables:
    """The derived tables of one run; nothing is computed before it is asked for."""

    def __init__(self, spark, sf_dir) -> None:
        self.facts = facts(spark, sf_dir)
        self.events = metrics.eligible(self.facts)

    @property
    def gates(self):
        return gates.date_gates(self.facts, FIRST, LAST)

    @property
    def seen(self):
        return metrics.first_seen(self.events)

    @property
    def users(self):
        return metrics.user_daily(self.events, self.gates, self.seen)

    @property
    def days(self):
        return metrics.daily_from_user(self.users)

    @property
    def brands(self):
        return metrics.brand_topk(self.events, "2024-01-01", "2024-01-07", 5)

    @property
    def dimensioned(self):
        return parse.dimensions(self.events, self.seen, self.brands)

    @property
    def dims(self):
        return metrics.daily_dim(self.dimensioned, self.gates)


_PLACE = "event_id, category_key, brand_key, price_key"


@query(f"WITH {BASE_SQL} SELECT event_id, brand_key FROM dimd")
def brand_bucket(spark, sf_dir):
    return Tables(spark, sf_dir).dimensioned.select("event_id", "brand_key")


@query(f"WITH {BASE_SQL} SELECT {_PLACE}, is_new AS is_first_seen_day FROM dimd")
def event_dimensions(spark, sf_dir):
    return Tables(spark, sf_dir).dimensioned.select("event_id", "category_key", "brand_key", "price_key", "is_first_seen_day")


@query(f"WITH {BASE_SQL} SELECT 'events' AS scope_id, user_id, first_ts AS first_seen_utc, first_d AS first_seen_date_utc FROM seen")
def first_seen(spark, sf_dir):
    return Tables(spark, sf_dir).seen


@query(f"WITH {BASE_SQL} SELECT brand, records, CAST(row_number() OVER (ORDER BY records DESC, brand) AS INTEGER) AS rank FROM topb")
def brand_topk(spark, sf_dir):
    return Tables(spark, sf_dir).brands


@query(f"WITH {BASE_SQL} SELECT * FROM ud")
def user_daily(spark, sf_dir):
    return Tables(spark, sf_dir).users


@query(f"WITH {BASE_SQL} SELECT * FROM daily")
def daily_from_user(spark, sf_dir):
    return Tables(spark, sf_dir).days


@query(f"WITH {BASE_SQL} SELECT * FROM daily")
def daily_direct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.daily_direct(t.events, t.gates, t.seen)


_RATIOS_SQL = """SELECT * EXCLUDE (count_allowed, amount_allowed), round(buyers / CAST(active_users AS DOUBLE), 6) AS buyer_rate, 'defined' AS buyer_rate_status, round(CASE WHEN buyers > 0 THEN CAST(purchase_amount AS DOUBLE) / buyers END, 6) AS amount_per_buyer,
  CASE WHEN purchase_amount IS NULL THEN 'amount_unavailable' WHEN buyers > 0 THEN 'defined' ELSE 'zero_denominator' END AS amount_per_buyer_status, round(first_seen_users / CAST(active_users AS DOUBLE), 6) AS first_seen_ratio, 'defined' AS first_seen_ratio_status FROM daily"""


@query(f"WITH {BASE_SQL} {_RATIOS_SQL}")
def daily_ratios(spark, sf_dir):
    return metrics.daily_ratios(Tables(spark, sf_dir).days)


@query(f"WITH {BASE_SQL} SELECT * FROM dims")
def daily_dim(spark, sf_dir):
    return Tables(spark, sf_dir).dims


_PERIOD_SQL = "count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (kind = 'purchase') AS buyers"
_AMOUNT_SQL = "CAST(coalesce(sum(price) FILTER (paid), 0) AS DECIMAL(38,2))"


@query(f"WITH {BASE_SQL} SELECT {_PERIOD_SQL}, count(DISTINCT (user_id, sess)) FILTER (NOT no_sess) AS sessions, count(*) AS events, {_AMOUNT_SQL} AS amount FROM e")
def period_totals(spark, sf_dir):
    return metrics.period_totals(Tables(spark, sf_dir).events)


@query(f"WITH {BASE_SQL} SELECT dim_name, CAST(sum(event_records) AS BIGINT) AS event_records, CAST(sum(purchase_events) AS BIGINT) AS purchase_events, CAST(sum(purchase_amount) AS DECIMAL(38,2)) AS purchase_amount FROM dims WHERE dim_value_key = 'bucket:unknown' GROUP BY 1")
def unknown_coverage(spark, sf_dir):
    return metrics.unknown_coverage(Tables(spark, sf_dir).dims)


@query(f"WITH {BASE_SQL} SELECT d AS utc_date, {_PERIOD_SQL}, count(*) AS events, count(*) FILTER (kind = 'purchase') AS purchases, CASE WHEN any_value(amount_allowed) THEN {_AMOUNT_SQL} END AS amount FROM e JOIN gates ON utc_date = d AND count_allowed GROUP BY d")
def daily_minimal(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.daily_minimal(t.events, t.gates)


_CATDAY_SQL = f"SELECT d AS utc_date, category_key, count(*) AS events, {_PERIOD_SQL}, count(*) FILTER (kind = 'purchase') AS purchases, CASE WHEN any_value(amount_allowed) THEN {_AMOUNT_SQL} END AS amount FROM dimd JOIN gates ON utc_date = d AND count_allowed GROUP BY d, category_key"


@query(f"WITH {BASE_SQL} {_CATDAY_SQL}")
def category_daily(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.category_daily(t.dimensioned, t.gates)


_CATPERIOD_SQL = f"SELECT category_key, {_PERIOD_SQL}, count(*) AS events, count(*) FILTER (kind = 'purchase') AS purchases, {_AMOUNT_SQL} AS amount FROM dimd GROUP BY 1"


@query(f"WITH {BASE_SQL} {_CATPERIOD_SQL}")
def category_period_distinct(spark, sf_dir):
    return metrics.category_period_distinct(Tables(spark, sf_dir).dimensioned)


@query(f"WITH {BASE_SQL}, b AS (SELECT category_key, d, count(DISTINCT user_id) AS u FROM dimd GROUP BY ALL), c AS (SELECT category_key, count(DISTINCT user_id) AS users FROM dimd GROUP BY 1) SELECT category_key, any_value(users) AS users, CAST(sum(u) AS BIGINT) AS user_days, TRUE AS users_ok, TRUE AS amount_ok FROM b JOIN c USING (category_key) GROUP BY 1")
def category_daynotmonth(spark, sf_dir):
    return metrics.category_day_not_month(Tables(spark, sf_dir).dimensioned)


@query(f"WITH {BASE_SQL}, p AS ({_CATPERIOD_SQL}), w AS (SELECT category_key, amount, row_number() OVER o AS r, sum(amount) OVER o AS run, sum(amount) OVER () AS tot FROM p WINDOW o AS (ORDER BY amount DESC, category_key)) SELECT category_key, amount, CAST(r AS INTEGER) AS rank, round(CAST(amount AS DOUBLE) / CAST(tot AS DOUBLE), 6) AS share, round(CAST(run AS DOUBLE) / CAST(tot AS DOUBLE), 6) AS cumulative_share FROM w")
def category_concentration(spark, sf_dir):
    return metrics.category_concentration(metrics.category_period_distinct(Tables(spark, sf_dir).dimensioned))


_HOUR_SQL = f"SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS purchases, count(DISTINCT user_id) AS users, {_AMOUNT_SQL} AS amount FROM e WHERE kind = 'purchase' GROUP BY 1"


@query(f"WITH {BASE_SQL} {_HOUR_SQL}")
def hourly_purchase(spark, sf_dir):
    return metrics.hourly_purchase(Tables(spark, sf_dir).events)


@query(f"WITH {BASE_SQL}, h AS ({_HOUR_SQL}), f AS (SELECT CAST(x AS INTEGER) AS hour, coalesce(purchases, 0) AS purchases, coalesce(users, 0) AS users, CAST(coalesce(amount, 0) AS DECIMAL(38,2)) AS amount FROM range(24) r(x) LEFT JOIN h ON hour = x) SELECT *, round(purchases / CAST(sum(purchases) OVER () AS DOUBLE), 6) AS share, 'defined' AS status FROM f")
def hourly_complete(spark, sf_dir):
    return metrics.hourly_complete(metrics.hourly_purchase(Tables(spark, sf_dir).events))


@query(f"WITH {BASE_SQL} SELECT CASE WHEN grouping(d) = 1 THEN '__all__' ELSE CAST(d AS VARCHAR) END AS day, kind AS event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM e GROUP BY GROUPING SETS ((kind), (d, kind))")
def behavior_coverage(spark, sf_dir):
    return metrics.behavior_coverage(Tables(spark, sf_dir).events)


@query(f"""WITH {BASE_SQL}, u AS (UNPIVOT (SELECT CAST(utc_date AS VARCHAR) AS d, CAST(active_users AS DOUBLE) AS active_users, CAST(buyers AS DOUBLE) AS buyers, CAST(event_records AS DOUBLE) AS event_records, CAST(purchase_events AS DOUBLE) AS purchase_events FROM daily) ON active_users, buyers, event_records, purchase_events INTO NAME metric VALUE v),
s AS (SELECT metric, min(v) AS min, median(v) AS median, max(v) AS max, count(*) AS n FROM u GROUP BY 1)
SELECT metric, s.min, s.median, s.max, s.n, string_agg(d, ',' ORDER BY d) FILTER (v = s.min) AS min_dates, string_agg(d, ',' ORDER BY d) FILTER (v = s.max) AS max_dates FROM u JOIN s USING (metric) GROUP BY ALL""")
def daily_stats(spark, sf_dir):
    return metrics.daily_stats(Tables(spark, sf_dir).days)


@query(f"""WITH {BASE_SQL}, cd AS ({_CATDAY_SQL}), n AS (SELECT strftime(utc_date, '%Y-%m') AS month, count(DISTINCT utc_date) AS days FROM cd GROUP BY 1), t AS (SELECT strftime(utc_date, '%Y-%m') AS month, category_key, CAST(sum(events) AS BIGINT) AS events, CAST(sum(purchases) AS BIGINT) AS purchases FROM cd GROUP BY ALL)
SELECT month, category_key, events, purchases, round(events / CAST(days AS DOUBLE), 6) AS events_per_day, round(events / CAST(sum(events) OVER (PARTITION BY month) AS DOUBLE), 6) AS event_share FROM t JOIN n USING (month)""")
def period_daily_means(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.period_daily_means(metrics.category_daily(t.dimensioned, t.gates), F.date_format("utc_date", "yyyy-MM"))


@query(f"""WITH {BASE_SQL} SELECT utc_date, round(1 - coalesce(sum(event_records) FILTER (dim_value_key = 'bucket:unknown'), 0) / CAST(sum(event_records) AS DOUBLE), 6) AS events_known,
  round(CASE WHEN sum(purchase_events) > 0 THEN 1 - coalesce(sum(purchase_events) FILTER (dim_value_key = 'bucket:unknown'), 0) / CAST(sum(purchase_events) AS DOUBLE) END, 6) AS purchases_known,
  round(CASE WHEN bool_and(purchase_amount IS NOT NULL) AND sum(purchase_amount) > 0 THEN 1 - CAST(coalesce(sum(purchase_amount) FILTER (dim_value_key = 'bucket:unknown'), 0) AS DOUBLE) / CAST(sum(purchase_amount) AS DOUBLE) END, 6) AS amount_known FROM dims WHERE dim_name = 'category_l1' GROUP BY 1""")
def category_known_coverage(spark, sf_dir):
    return metrics.category_known_coverage(Tables(spark, sf_dir).dims)


# Checks run on copies with planted differences, so that they have something to find.


def _damaged(days):
    """Every seventh date is gone, every tenth there twice under another scope, some values are off."""
    day = F.dayofmonth("utc_date")
    held = days.select("scope_id", "utc_date", "active_users", "buyers", "purchase_amount").where(day % 7 != 0)
    off = held.withColumns({
        "active_users": F.col("active_users") + (day % 5 == 0).cast("long"),
        "purchase_amount": (F.col("purchase_amount") + F.when(day % 6 == 0, F.lit("0.50")).otherwise(F.lit("0")).cast("decimal(18,2)")).cast("decimal(38,2)"),
    })
    return off.unionByName(off.where(day % 10 == 0).withColumn("scope_id", F.lit("other")))


_DAMAGED_SQL = BASE_SQL + """,
dm0 AS (SELECT scope_id, utc_date, active_users + CAST(day(utc_date) % 5 = 0 AS INTEGER) AS active_users, buyers,
  CAST(purchase_amount + CASE WHEN day(utc_date) % 6 = 0 THEN 0.50 ELSE 0 END AS DECIMAL(38,2)) AS purchase_amount FROM daily WHERE day(utc_date) % 7 <> 0),
dm AS (SELECT * FROM dm0 UNION ALL SELECT 'other', * EXCLUDE (scope_id) FROM dm0 WHERE day(utc_date) % 10 = 0)"""


@query(f"""WITH {_DAMAGED_SQL}, l AS (SELECT utc_date, active_users FROM daily), r AS (SELECT utc_date, active_users FROM dm)
SELECT TRUE AS in_left, * FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT FALSE, * FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""")
def multiset_diff(spark, sf_dir):
    days = Tables(spark, sf_dir).days
    return checks.multiset_diff(*[df.select("utc_date", "active_users") for df in (days, _damaged(days))])


_FIELD_SQL = """SELECT '{f}' AS field, count(*) AS rows, count(*) FILTER (r.scope_id IS NULL) AS missing, count(*) FILTER (l.scope_id IS NULL) AS extra,
  count(*) FILTER (l.scope_id IS NOT NULL AND r.scope_id IS NOT NULL AND CASE WHEN l.{f} IS NULL OR r.{f} IS NULL THEN l.{f} IS DISTINCT FROM r.{f} ELSE abs(CAST(l.{f} AS DOUBLE) - CAST(r.{f} AS DOUBLE)) > 0.6 END) AS mismatches,
  round(max(abs(CAST(l.{f} AS DOUBLE) - CAST(r.{f} AS DOUBLE))), 6) AS max_absolute_error,
  round(max(CASE WHEN greatest(abs(l.{f}), abs(r.{f})) > 0 THEN abs(CAST(l.{f} AS DOUBLE) - CAST(r.{f} AS DOUBLE)) / greatest(abs(CAST(l.{f} AS DOUBLE)), abs(CAST(r.{f} AS DOUBLE))) ELSE 0 END), 6) AS max_relative_error, FALSE AS type_differs
  FROM daily l FULL JOIN dm r ON l.scope_id = r.scope_id AND l.utc_date = r.utc_date"""


@query(f"WITH {_DAMAGED_SQL} " + " UNION ALL ".join(_FIELD_SQL.format(f=f) for f in ("active_users", "buyers", "purchase_amount")))
def field_diff(spark, sf_dir):
    """Amounts are off by half a unit, within the tolerance of 0.6; users by one, beyond it."""
    days = Tables(spark, sf_dir).days
    out = checks.field_diff(days, _damaged(days), ["scope_id", "utc_date"], ["active_users", "buyers", "purchase_amount"], absolute=0.6)
    return out.withColumns({n: F.round(n, 6) for n in ("max_absolute_error", "max_relative_error")})


@query("""WITH k AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_orderkey END AS a, l_linenumber AS b FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 10 = 0),
g AS (SELECT a, b, count(*) AS n FROM k GROUP BY ALL) SELECT count(*) AS keys, count(*) FILTER (n > 1) AS duplicate_keys, CAST(coalesce(sum(n) FILTER (a IS NULL OR b IS NULL), 0) AS BIGINT) AS null_keys FROM g""")
def key_check(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    holes = lines.select(F.when(F.col("l_partkey") % 50 != 0, F.col("l_orderkey")).alias("l_orderkey"), "l_linenumber")
    return checks.key_check(holes.unionByName(lines.where("l_suppkey % 10 = 0").select("l_orderkey", "l_linenumber")), ["l_orderkey", "l_linenumber"])


_SIGNATURE_SQL = f"count(*) AS records, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (kind = 'purchase') AS buyers, {_AMOUNT_SQL} AS amount"


@query(f"""WITH {BASE_SQL}, ev AS (SELECT event_id, d, user_id, kind, paid, price FROM e), af AS (SELECT * FROM ev WHERE NOT (day(d) % 3 = 0 AND event_id % 40 = 0) UNION ALL SELECT * FROM ev WHERE day(d) % 4 = 0 AND event_id % 50 = 1),
b AS (SELECT CASE WHEN grouping(d) = 1 THEN '__all__' ELSE CAST(d AS VARCHAR) END AS day, {_SIGNATURE_SQL} FROM ev GROUP BY GROUPING SETS ((), (d))),
a AS (SELECT CASE WHEN grouping(d) = 1 THEN '__all__' ELSE CAST(d AS VARCHAR) END AS day, {_SIGNATURE_SQL} FROM af GROUP BY GROUPING SETS ((), (d)))
SELECT day, b.records AS records_before, a.* EXCLUDE (day), (a.records, a.users, a.buyers, a.amount) IS NOT DISTINCT FROM (b.records, b.users, b.buyers, b.amount) AS conserved FROM b FULL JOIN a USING (day)""")
def join_conservation(spark, sf_dir):
    """A join that loses records on some days and repeats some on others."""
    events = Tables(spark, sf_dir).events
    day, n = F.dayofmonth("event_date_utc"), F.col("event_id")
    after = events.where(~((day % 3 == 0) & (n % 40 == 0))).unionByName(events.where((day % 4 == 0) & (n % 50 == 1)))
    return checks.join_conservation(events, after)


@query(f"""WITH {BASE_SQL}, r AS (SELECT *, buyers / CAST(active_users AS DOUBLE) * CASE WHEN day(utc_date) % 9 = 0 THEN 1.01 ELSE 1 END AS br, CAST(purchase_amount AS DOUBLE) / CASE WHEN buyers > 0 THEN buyers END AS pb FROM daily)
SELECT 'value' AS "check", utc_date, abs(active_users * br * pb - CAST(purchase_amount AS DOUBLE)) <= 0.0001 * greatest(CAST(purchase_amount AS DOUBLE), 1) AS ok FROM r WHERE pb IS NOT NULL
UNION ALL SELECT 'first_seen', NULL, sum(first_seen_users) = (SELECT count(DISTINCT user_id) FROM e) FROM r""")
def identity_check(spark, sf_dir):
    """Stored ratios have six places, so they hold to 1e-4; on every ninth day one of them is off by a hundredth."""
    t = Tables(spark, sf_dir)
    stored = metrics.daily_ratios(t.days)
    off = F.when(F.dayofmonth("utc_date") % 9 == 0, F.col("buyer_rate") * 1.01).otherwise(F.col("buyer_rate"))
    return checks.identity_check(stored.withColumn("buyer_rate", off), t.events, relative=1e-4)


_HOLED_SQL = BASE_SQL + """,
hd AS (SELECT * FROM dims WHERE NOT (dim_name = 'brand_group' AND day(utc_date) % 8 = 0) AND NOT (dim_value_key = 'bucket:unknown' AND day(utc_date) % 5 = 0)
  UNION ALL SELECT * FROM dims WHERE dim_name = 'price_band' AND day(utc_date) % 9 = 0)"""


def _holed(dims):
    """A dimension is missing on some days, a value of two on others, and one dimension is there twice."""
    day = F.dayofmonth("utc_date")
    held = dims.where(~((F.col("dim_name") == "brand_group") & (day % 8 == 0)) & ~((F.col("dim_value_key") == "bucket:unknown") & (day % 5 == 0)))
    return held.unionByName(dims.where((F.col("dim_name") == "price_band") & (day % 9 == 0)))


@query(f"""WITH {_HOLED_SQL}, s AS (SELECT utc_date, dim_name, CAST(sum(event_records) AS BIGINT) AS n, CAST(sum(purchase_events) AS BIGINT) AS p, CAST(sum(purchase_amount) AS DECIMAL(38,2)) AS a, count(*) - count(DISTINCT dim_value_key) AS again FROM hd GROUP BY ALL),
x AS (SELECT dd.*, dim_name FROM daily dd, (SELECT DISTINCT dim_name FROM hd))
SELECT utc_date, dim_name, n AS dim_records, event_records AS day_records, coalesce(again, 0) AS repeated_keys,
  coalesce(n = event_records AND p = purchase_events AND a IS NOT DISTINCT FROM purchase_amount AND again = 0, FALSE) AS conserved FROM x FULL JOIN s USING (utc_date, dim_name)""")
def dim_conservation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return checks.dim_conservation(_holed(t.dims), t.days)


@query(f"""WITH {_HOLED_SQL}, a AS (SELECT dim_value_key AS category_key, CAST(sum(purchase_amount) AS DECIMAL(38,2)) AS amount FROM hd WHERE dim_name = 'category_l1' AND purchase_amount IS NOT NULL GROUP BY 1),
b AS (SELECT category_key, {_AMOUNT_SQL} AS own FROM dimd JOIN gates ON utc_date = d AND amount_allowed GROUP BY 1)
SELECT category_key, amount, amount IS NOT DISTINCT FROM own AS same FROM a FULL JOIN b USING (category_key)""")
def category_reconcile(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return checks.category_reconcile(_holed(t.dims), t.dimensioned, t.gates)


@query(f"""WITH {BASE_SQL}, h AS (SELECT amount_allowed, CASE WHEN day(utc_date) % 7 = 0 THEN NULL WHEN NOT amount_allowed AND day(utc_date) % 2 = 0 THEN 1 ELSE purchase_amount END AS a FROM daily)
SELECT count(*) AS rows, count(*) FILTER (amount_allowed AND a IS NULL) AS allowed_but_null, count(*) FILTER (NOT amount_allowed AND a IS NOT NULL) AS blocked_but_known FROM h""")
def nullability_by_gate(spark, sf_dir):
    """Some amounts are lost, some are there although their gate forbids them."""
    days, day = Tables(spark, sf_dir).days, F.dayofmonth("utc_date")
    planted = F.when(day % 7 == 0, F.lit(None)).when(~F.col("amount_allowed") & (day % 2 == 0), F.lit(1)).otherwise(F.col("purchase_amount"))
    return checks.nullability_by_gate(days.withColumn("purchase_amount", planted))


_CONCENTRATION_SQL = f"""p AS ({_CATPERIOD_SQL}), rk AS (SELECT *, row_number() OVER (ORDER BY amount DESC, category_key) AS r, sum(amount) OVER () AS tot FROM p)"""


@query(f"""WITH {BASE_SQL}, {_CONCENTRATION_SQL}
SELECT count(*) AS categories, {', '.join(f"round(CAST(sum(amount) FILTER (r <= {k}) AS DOUBLE) / CAST(any_value(tot) AS DOUBLE), 6) AS top{k}_share" for k in (1, 5, 10))},
  round(CAST(coalesce(sum(amount) FILTER (category_key = 'bucket:unknown'), 0) AS DOUBLE) / CAST(any_value(tot) AS DOUBLE), 6) AS unknown_share, (SELECT count(DISTINCT (user_id, d)) FROM dimd) AS user_days FROM rk""")
def category_concentration_summary(spark, sf_dir):
    events = Tables(spark, sf_dir).dimensioned
    return metrics.concentration_summary(metrics.category_concentration(metrics.category_period_distinct(events)), events)


@query(f"""WITH {BASE_SQL}, u AS (SELECT utc_date, unnest(from_json(reason_codes, '["VARCHAR"]')) AS reason FROM gates) SELECT reason, count(*) AS dates, min(utc_date) AS first_date FROM u GROUP BY 1""")
def gate_reasons(spark, sf_dir):
    """Dates by reason; the codes are read back from their JSON."""
    codes = F.from_json("reason_codes", "array<string>")
    return Tables(spark, sf_dir).gates.select("utc_date", F.explode(codes).alias("reason")).groupBy("reason").agg(F.count("*").alias("dates"), F.min("utc_date").alias("first_date"))
