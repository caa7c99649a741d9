"""Parsing, profiling, sampling, gates, duplicates and sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import columns as c
from ..operators import gates, parse, profile, quality
from ..sources.files import scan_union_periods as union_periods
from ..sources.scratch import once, written
from ..sources.tables import FACT_SQL, RAW_SQL, facts, raw_events, table
from .registry import query

_FLAGS = ["time_missing", "time_invalid", "user_id_missing", "user_id_invalid", "product_id_missing", "product_id_invalid", "category_id_missing", "category_id_invalid", "category_code_missing", "brand_missing", "session_missing", "event_type_unknown", "price_missing", "price_invalid", "price_nonfinite", "price_negative", "price_zero", "price_precision_exceeded", "price_scale_exceeded", "event_eligible", "amount_eligible"]

PARSED_SQL = RAW_SQL + r""",
p0 AS (SELECT * REPLACE (coalesce(brand, '') AS brand), regexp_full_match(event_time, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} UTC') AS shaped,
  regexp_full_match(price, '[+-]?[0-9]+(\.[0-9]+)?') AS num, regexp_full_match(lower(price), '[+-]?(s?nan|inf|infinity)') AS nonfin FROM raw),
p1 AS (SELECT *, CASE WHEN shaped THEN try_strptime(event_time, '%Y-%m-%d %H:%M:%S UTC') END AS tsu,
  num AND length(regexp_extract(price, '^[+-]?0*([0-9]*)', 1)) > 16 AS long_, num AND length(regexp_extract(price, '\.([0-9]+)$', 1)) > 2 AS fine_, num AND NOT regexp_matches(price, '[1-9]') AS zero_ FROM p0),
p2 AS (SELECT *, CASE WHEN num AND NOT long_ AND NOT fine_ THEN TRY_CAST(price AS DECIMAL(18,2)) END AS price_decimal FROM p1),
p3 AS (SELECT *, tsu AS event_timestamp_utc, CAST(tsu AS DATE) AS event_date_utc, trim(event_time) = '' AS time_missing, trim(event_time) <> '' AND tsu IS NULL AS time_invalid,
  trim(user_id) = '' AS user_id_missing, trim(user_id) <> '' AND NOT regexp_full_match(user_id, '[0-9]+') AS user_id_invalid,
  trim(product_id) = '' AS product_id_missing, trim(product_id) <> '' AND NOT regexp_full_match(product_id, '[0-9]+') AS product_id_invalid,
  trim(category_id) = '' AS category_id_missing, trim(category_id) <> '' AND NOT regexp_full_match(category_id, '[0-9]+') AS category_id_invalid,
  category_code = '' AS category_code_missing, brand = '' AS brand_missing, user_session = '' AS session_missing,
  event_type NOT IN ('view', 'cart', 'remove_from_cart', 'purchase') AS event_type_unknown,
  price = '' AS price_missing, price <> '' AND NOT num AND NOT nonfin AS price_invalid, nonfin AS price_nonfinite, num AND price LIKE '-%' AND NOT zero_ AS price_negative,
  zero_ AS price_zero, long_ AS price_precision_exceeded, fine_ AS price_scale_exceeded FROM p2),
parsed AS (SELECT *, tsu IS NOT NULL AND NOT user_id_missing AND NOT user_id_invalid AND NOT event_type_unknown AS event_eligible,
  tsu IS NOT NULL AND NOT user_id_missing AND NOT user_id_invalid AND event_type = 'purchase' AND price_decimal IS NOT NULL AND NOT price_negative AS amount_eligible FROM p3)"""


def _parsed(spark, sf_dir) -> DataFrame:
    return parse.parse_events(raw_events(spark, sf_dir))


def _picked(name: str, *cols: str) -> None:
    def run(spark, sf_dir):
        return _parsed(spark, sf_dir).select("event_id", *cols)

    run.__name__ = name
    query(f"WITH {PARSED_SQL} SELECT event_id, {', '.join(cols)} FROM parsed")(run)


_picked("parse_nulls_to_empty", "brand", "category_code")
_picked("parse_utc_timestamp", "event_timestamp_utc", "event_date_utc", "time_missing", "time_invalid")
_picked("parse_id_flags", *[f"{n}_{k}" for n in ("user_id", "product_id", "category_id") for k in ("missing", "invalid")])
_picked("parse_text_missing", "category_code_missing", "brand_missing", "session_missing")
_picked("parse_event_type", "event_type", "event_type_unknown")
_picked("parse_price_class", *[f for f in _FLAGS if f.startswith("price_")])
_picked("parse_price_decimal", "price_decimal")
_picked("event_eligible", "event_eligible")
_picked("amount_eligible", "amount_eligible")


@query(f"WITH {RAW_SQL} SELECT event_id, regexp_full_match(user_id, '[ \\t\\r\\n]*') AS user_blank, regexp_full_match(price, '[ \\t\\r\\n]*') AS price_blank FROM raw")
def parse_blank(spark, sf_dir):
    return raw_events(spark, sf_dir).select("event_id", c.blank(F.col("user_id")).alias("user_blank"), c.blank(F.col("price")).alias("price_blank"))


@query(f"WITH {PARSED_SQL} SELECT event_id, strftime(tsu, '%Y-%m-%dT%H:%M:%SZ') AS event_timestamp_utc, CAST(event_date_utc AS VARCHAR) AS event_date_utc, CAST(price_decimal AS VARCHAR) AS price_decimal FROM parsed")
def canonical_text(spark, sf_dir):
    return parse.canonical_text(_parsed(spark, sf_dir)).select("event_id", "event_timestamp_utc", "event_date_utc", "price_decimal")


@query(f"WITH {PARSED_SQL} SELECT event_id, 'events' AS source_id, 'v1' AS contract_version, event_eligible FROM parsed")
def stamp_lineage(spark, sf_dir):
    return parse.parse_events(raw_events(spark, sf_dir), {"source_id": "events", "contract_version": "v1"}).select("event_id", "source_id", "contract_version", "event_eligible")


@query(f"WITH {PARSED_SQL} SELECT event_id, CASE WHEN regexp_full_match(category_code, '[A-Za-z0-9_]+(\\.[A-Za-z0-9_]+)*') THEN 'category:' || split_part(category_code, '.', 1) ELSE 'bucket:unknown' END AS category_key FROM parsed")
def category_l1(spark, sf_dir):
    label = c.category(F.col("category_code"))
    return _parsed(spark, sf_dir).select("event_id", F.coalesce(F.concat(F.lit("category:"), label), F.lit("bucket:unknown")).alias("category_key"))


@query(f"WITH {PARSED_SQL} SELECT event_id, CASE WHEN price_decimal IS NULL OR price_decimal < 0 THEN 'unknown' WHEN price_decimal < 20 THEN '[0,20)' WHEN price_decimal < 50 THEN '[20,50)' WHEN price_decimal < 200 THEN '[50,200)' ELSE '[200,+inf)' END AS price_band FROM parsed")
def price_band(spark, sf_dir):
    return _parsed(spark, sf_dir).select("event_id", c.price_band(F.col("price_decimal")).alias("price_band"))


@query(f"""WITH {PARSED_SQL} SELECT count(*) AS records, count(DISTINCT CASE WHEN event_eligible THEN user_id END) AS users, count(DISTINCT CASE WHEN event_eligible AND event_type = 'purchase' THEN user_id END) AS buyers,
  {', '.join(f'count(*) FILTER ({f}) AS {f}' for f in _FLAGS)}, CAST(coalesce(sum(price_decimal) FILTER (amount_eligible), 0) AS DECIMAL(38,2)) AS amount FROM parsed""")
def profile_summary(spark, sf_dir):
    return profile.summary(_parsed(spark, sf_dir), _FLAGS)


@query(f"""WITH {PARSED_SQL} SELECT coalesce(CAST(event_date_utc AS VARCHAR), 'invalid') AS day, count(*) AS records, {', '.join(f'count(*) FILTER ({f}) AS {f}' for f in _FLAGS)},
  CAST(coalesce(sum(price_decimal) FILTER (amount_eligible), 0) AS DECIMAL(38,2)) AS amount FROM parsed GROUP BY 1""")
def profile_daily(spark, sf_dir):
    return profile.daily(_parsed(spark, sf_dir), _FLAGS)


@query(f"""WITH {PARSED_SQL}, cal AS (SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-01-21', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT 'day' AS part, CAST(day AS VARCHAR) AS value, count(event_id) AS n FROM cal LEFT JOIN parsed ON event_date_utc = day GROUP BY day
UNION ALL SELECT 'hour', CAST(hour(tsu) AS VARCHAR), count(*) FROM parsed WHERE tsu IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'type', event_type, count(*) FROM parsed GROUP BY ALL
UNION ALL SELECT 'empty:brand', '', count(*) FILTER (brand = '') FROM parsed UNION ALL SELECT 'empty:price', '', count(*) FILTER (price = '') FROM parsed UNION ALL SELECT 'empty:user_id', '', count(*) FILTER (user_id = '') FROM parsed
UNION ALL SELECT 'time:invalid', '', count(*) FILTER (time_invalid) FROM parsed UNION ALL SELECT 'user_id:leading_zero', '', count(*) FILTER (regexp_matches(user_id, '^0[0-9]')) FROM parsed
UNION ALL SELECT 'time:first', strftime(min(tsu), '%Y-%m-%d %H:%M:%S'), count(tsu) FROM parsed UNION ALL SELECT 'time:last', strftime(max(tsu), '%Y-%m-%d %H:%M:%S'), count(tsu) FROM parsed
UNION ALL SELECT 'time:outside', '', count(*) FILTER (event_date_utc NOT BETWEEN DATE '2024-01-01' AND DATE '2024-01-20') FROM parsed""")
def profile_source(spark, sf_dir):
    return profile.source(_parsed(spark, sf_dir), "2024-01-01", "2024-01-20", ["brand", "price", "user_id"])


_DOMAIN_SQL = "SELECT '{c}' AS field, count(*) AS records, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (CAST({c} AS VARCHAR) = '') AS empty, count(*) FILTER (regexp_full_match(CAST({c} AS VARCHAR), '[ ]+')) AS white_space, count(*) FILTER ({out}) AS outside, count(*) FILTER ({odd}) AS nonfinite FROM l"


@query("""WITH l AS (SELECT CASE l_returnflag WHEN 'A' THEN ' ' ELSE l_returnflag END AS l_returnflag, CASE WHEN l_partkey % 20 = 0 THEN NULL WHEN l_partkey % 20 = 1 THEN '' ELSE l_linestatus END AS l_linestatus,
  CASE WHEN l_partkey % 30 = 0 THEN CAST('nan' AS DOUBLE) WHEN l_partkey % 30 = 1 THEN CAST('inf' AS DOUBLE) ELSE l_quantity END AS l_quantity, l_extendedprice FROM lineitem)
""" + " UNION ALL ".join(_DOMAIN_SQL.format(c=c, out=out, odd=odd) for c, out, odd in (("l_returnflag", "l_returnflag NOT IN ('R', 'N')", "FALSE"), ("l_linestatus", "l_linestatus NOT IN ('O', 'F')", "FALSE"), ("l_quantity", "FALSE", "NOT isfinite(l_quantity)"), ("l_extendedprice", "FALSE", "NOT isfinite(l_extendedprice)"))))
def profile_rct(spark, sf_dir):
    """Line items with planted blanks, empty values, nulls and numbers that are not finite."""
    rows, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    planted = rows.select(
        F.when(F.col("l_returnflag") == "A", " ").otherwise(F.col("l_returnflag")).alias("l_returnflag"), F.when(k % 20 == 0, F.lit(None)).when(k % 20 == 1, "").otherwise(F.col("l_linestatus")).alias("l_linestatus"),
        F.when(k % 30 == 0, float("nan")).when(k % 30 == 1, float("inf")).otherwise(F.col("l_quantity")).alias("l_quantity"), "l_extendedprice",
    )
    return profile.experiment(planted, {"l_returnflag": ["R", "N"], "l_linestatus": ["O", "F"]}, ["l_quantity", "l_extendedprice"])


@query(f"WITH {RAW_SQL} SELECT event_id, user_id FROM raw WHERE trim(user_id) <> '' AND substr(sha256('sample-v1|' || user_id), 1, 16) < '1999999999999999'")
def sample_users_hash(spark, sf_dir):
    return profile.sample_users(raw_events(spark, sf_dir), "sample-v1|", c.TENTH).select("event_id", "user_id")


@query(f"""WITH {RAW_SQL}, s AS (SELECT * FROM raw WHERE trim(user_id) <> '' AND substr(sha256('sample-v1|' || user_id), 1, 16) < '1999999999999999')
SELECT count(*) AS sample_events, count(DISTINCT user_id) AS sample_users, (SELECT count(*) FROM raw) AS source_events, CAST(0 AS BIGINT) AS outside_rule,
  (SELECT count(*) FROM raw WHERE user_id IN (SELECT user_id FROM s)) - count(*) AS missing_events, round(count(*) / CAST((SELECT count(*) FROM raw) AS DOUBLE), 6) AS share FROM s""")
def sample_validate(spark, sf_dir):
    raw = raw_events(spark, sf_dir)
    return profile.validate_sample(raw, profile.sample_users(raw, "sample-v1|", c.TENTH), "sample-v1|", c.TENTH)


@query("SELECT event_id, ts, user_id FROM events ORDER BY event_id LIMIT 100")
def sample_prefix(spark, sf_dir):
    """A fixed prefix in key order is the feature here."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id").orderBy("event_id").limit(100)


_HOURS_SQL = "SELECT CAST(ts AS DATE) AS day, coalesce(hour(ts), -1) AS hour, count(*) AS n, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount FROM {t} WHERE event_type = 'purchase' GROUP BY GROUPING SETS ((CAST(ts AS DATE), hour(ts)), (CAST(ts AS DATE)), ())"


@query(f"""WITH src AS (SELECT ts, event_type, value AS v FROM events), st AS (SELECT ts, event_type, CASE WHEN event_id % 37 = 0 THEN value + 1 ELSE value END AS v FROM events WHERE event_id % 31 <> 0 OR day(ts) % 2 = 0),
a AS ({_HOURS_SQL.format(t="src")}), b AS ({_HOURS_SQL.format(t="st")}), spine AS (SELECT day, CAST(h AS INTEGER) AS hour FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), range(-1, 24) r(h) UNION ALL SELECT NULL, -1)
SELECT s.day, s.hour, coalesce(a.n, 0) AS source_n, coalesce(b.n, 0) AS stored_n, CAST(coalesce(a.amount, 0) AS DECIMAL(38,2)) AS source_amount, a.n IS NOT DISTINCT FROM b.n AND a.amount IS NOT DISTINCT FROM b.amount AS same
FROM spine s LEFT JOIN a ON s.day IS NOT DISTINCT FROM a.day AND s.hour = a.hour LEFT JOIN b ON s.day IS NOT DISTINCT FROM b.day AND s.hour = b.hour""")
def window_reconcile(spark, sf_dir):
    """A stored copy that lacks some records of odd days and has some values changed."""
    events, n = table(spark, sf_dir, "events"), F.col("event_id")
    stored = events.where((n % 31 != 0) | (F.dayofmonth("ts") % 2 == 0)).withColumn("value", F.when(n % 37 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return profile.reconcile_hours(events, stored)


@query("""WITH t AS (SELECT sha256(concat_ws('|', '+' || l_orderkey, '+' || l_linenumber, '+' || CAST(l_extendedprice AS DECIMAL(18,2)), '+' || l_returnflag, '+' || strftime(l_shipdate, '%Y-%m-%d'))) AS h FROM lineitem), b AS (SELECT CAST('0x' || substr(h, 1, 15) AS BIGINT) AS x FROM t)
SELECT count(*) AS records, CAST(coalesce(sum(x), 0) AS DECIMAL(38,0)) AS hash_sum, coalesce(bit_xor(x), 0) AS hash_xor FROM b""")
def sequence_fingerprint(spark, sf_dir):
    """Order-free sums over the text of the rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return profile.fingerprint(rows, rows.columns)


_GATES_SQL = FACT_SQL + r""",
day AS (SELECT d, count(*) AS n, count(*) FILTER (NOT ok) AS bad_core, count(*) FILTER (kind = 'purchase') AS purchases, count(*) FILTER (paid) AS paid_n, count(*) FILTER (no_sess) AS no_sess FROM fact GROUP BY d),
cal AS (SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS utc_date),
g0 AS (SELECT utc_date, day.d IS NULL AS unseen, coalesce(bad_core, 0) > 0 AS core, coalesce(purchases, 0) <> coalesce(paid_n, 0) AS part, coalesce(no_sess, 0) > 0 AS warn FROM cal LEFT JOIN day ON d = utc_date),
gates AS (SELECT utc_date, NOT unseen AND NOT core AS count_allowed, NOT unseen AND NOT core AND NOT part AS amount_allowed,
  CASE WHEN unseen OR core THEN 'blocked' WHEN part THEN 'count_only' WHEN warn THEN 'allowed_with_warnings' ELSE 'allowed' END AS status,
  '[' || concat_ws(',', CASE WHEN unseen THEN '"date_not_observed"' END, CASE WHEN core THEN '"core_user_id_missing"' END, CASE WHEN core THEN '"ineligible_events"' END, CASE WHEN part THEN '"purchase_amount_incomplete"' END) || ']' AS reason_codes FROM g0)"""


@query(f"WITH {_GATES_SQL} SELECT * FROM gates")
def date_gates(spark, sf_dir):
    return gates.date_gates(facts(spark, sf_dir), "2024-01-01", "2024-02-02")


def _report_sql(rows: str, scope: str) -> str:
    kinds = ("cart", "purchase", "remove_from_cart", "view")
    bad = "(" + " OR ".join(gates.PRICE_BAD) + ")"
    flags = ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in (*gates.CORE, *gates.WARNINGS))
    zeros = ", ".join(f"count(*) FILTER (price_zero AND event_type = '{k}') AS zero_price_{k}" for k in kinds)
    named = sorted([*gates.WARNINGS, *(f"zero_price_{k}" for k in kinds), "nonpurchase_price_quality"])
    warned = ", ".join(f"""CASE WHEN {"bad_price AND bad_paid = 0" if w.startswith("non") else w + " > 0"} THEN '"{w}":"' || {"'present'" if w.startswith("non") else w} || '"' END""" for w in named)
    reasons = ", ".join([
        "CASE WHEN outside THEN 'unassigned_or_outside_date' END", "CASE WHEN untimed THEN 'batch_time_unassignable' END", "CASE WHEN n IS NULL THEN 'date_not_observed' END",
        *(f"CASE WHEN {f} > 0 THEN 'core_{f}' END" for f in gates.CORE), "CASE WHEN eligible <> n THEN 'ineligible_events' END",
    ])
    return f"""SELECT '{scope}' AS scope, utc_date, len(c) = 0 AS count_allowed, len(c) = 0 AND NOT part AS amount_allowed,
  CASE WHEN len(c) > 0 THEN 'blocked' WHEN part THEN 'count_only' WHEN len(w) > 0 THEN 'allowed_with_warnings' ELSE 'allowed' END AS status,
  '[' || array_to_string(list_transform(list_sort(CASE WHEN part THEN list_append(c, 'purchase_amount_incomplete') ELSE c END), lambda x: '"' || x || '"'), ',') || ']' AS reason_codes,
  '{{' || array_to_string(w, ',') || '}}' AS warnings, coalesce(n, 0) AS record_count, coalesce(eligible, 0) AS event_eligible_records, coalesce(n - eligible, 0) AS core_ineligible_records,
  CASE WHEN n IS NULL THEN 'not_observed' WHEN bought = 0 THEN 'no_purchases' WHEN bought = paid THEN 'complete_observed' WHEN paid > 0 THEN 'partial_observed' ELSE 'unknown' END AS amount_status
  FROM (SELECT *, list_filter([{reasons}], lambda x: x IS NOT NULL) AS c, list_filter([{warned}], lambda x: x IS NOT NULL) AS w, coalesce(purchases <> paid OR bad_paid > 0, FALSE) AS part
  FROM (SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS utc_date) LEFT JOIN
  (SELECT event_date_utc AS utc_date, count(*) AS n, count(*) FILTER (event_eligible) AS eligible, {flags}, {zeros}, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'purchase' AND event_eligible) AS bought,
    count(*) FILTER (amount_eligible) AS paid, count(*) FILTER (event_type = 'purchase' AND {bad}) AS bad_paid, bool_or({bad}) AS bad_price FROM {rows} WHERE event_date_utc BETWEEN DATE '2024-01-01' AND DATE '2024-02-02' GROUP BY 1) USING (utc_date),
  (SELECT count(*) FILTER (event_date_utc IS NULL OR event_date_utc NOT BETWEEN DATE '2024-01-01' AND DATE '2024-02-02') > 0 AS outside, count(*) FILTER (time_missing OR time_invalid) > 0 AS untimed FROM {rows}))"""


@query(f"""WITH {PARSED_SQL}, timed AS (SELECT * FROM parsed WHERE event_date_utc BETWEEN DATE '2024-01-01' AND DATE '2024-02-02'), clean AS (SELECT * FROM timed WHERE event_eligible AND (event_type <> 'purchase' OR amount_eligible OR day(event_date_utc) % 3 = 0))
{_report_sql("parsed", "batch")} UNION ALL {_report_sql("timed", "timed")} UNION ALL {_report_sql("clean", "clean")}""")
def gate_report(spark, sf_dir):
    """The whole batch, which its untimed records block; its timed records; and only what may be counted."""
    parsed = _parsed(spark, sf_dir)
    timed = parsed.where("event_date_utc between date '2024-01-01' and date '2024-02-02'")
    clean = timed.where("event_eligible and (event_type <> 'purchase' or amount_eligible or day(event_date_utc) % 3 = 0)")
    parts = [gates.gate_report(df, "2024-01-01", "2024-02-02").select(F.lit(scope).alias("scope"), "*") for scope, df in (("batch", parsed), ("timed", timed), ("clean", clean))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {PARSED_SQL}, d AS (SELECT event_date_utc AS utc_date, count(*) AS n FROM parsed WHERE tsu IS NOT NULL GROUP BY 1)
SELECT utc_date, n, (SELECT count(*) FROM parsed WHERE tsu IS NULL) AS unassigned, (SELECT count(*) FROM parsed WHERE tsu IS NULL) = 0 AS batch_allowed FROM d""")
def gate_batch_time(spark, sf_dir):
    return gates.batch_time(_parsed(spark, sf_dir))


@query(f"WITH {_GATES_SQL} SELECT event_id, d AS event_date_utc FROM fact JOIN gates ON d = utc_date WHERE amount_allowed AND d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def gated_read(spark, sf_dir):
    df = facts(spark, sf_dir)
    return gates.gated_read(df, gates.date_gates(df, "2024-01-01", "2024-02-02"), "amount", "2024-01-05", "2024-01-20").select("event_id", "event_date_utc")


@query(f"""WITH {_GATES_SQL} SELECT d AS utc_date, CASE WHEN any_value(amount_allowed) THEN CAST(coalesce(sum(price) FILTER (paid), 0) AS DECIMAL(38,2)) END AS amount, any_value(amount_allowed) AS amount_allowed FROM fact JOIN gates ON d = utc_date GROUP BY d""")
def gated_amount(spark, sf_dir):
    df = facts(spark, sf_dir)
    return gates.gated_amount(df, gates.date_gates(df, "2024-01-01", "2024-02-02"))


@query(f"WITH {FACT_SQL} SELECT d AS utc_date, count(*) AS records, count(*) FILTER (ok) AS eligible, count(*) FILTER (paid) AS amount_eligible, count(*) FILTER (scope_id <> 'events') AS wrong_lineage FROM fact GROUP BY d")
def provenance_check(spark, sf_dir):
    return gates.provenance(facts(spark, sf_dir), "events")


@query("""WITH b AS (SELECT 'b' || (o_orderkey % 5) AS batch, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders GROUP BY 1)
SELECT x.batch AS batch, y.batch AS other, x.lo <= y.hi AND y.lo <= x.hi AS dates_overlap FROM b x JOIN b y ON x.batch < y.batch""")
def batch_overlap_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    batches = orders.groupBy(F.concat(F.lit("b"), (F.col("o_orderkey") % 5).cast("string")).alias("batch")).agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return gates.overlaps(batches)


#: Six batches of one series: two halves of the orders by key, a copy under another name, days with changed and days with equal records, another definition.
_BATCHES_SQL = """o AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders),
bt AS (SELECT 'orders' AS series, 'b' || (o_orderkey % 2) AS batch, day, o_orderkey AS k, o_totalprice AS v, 'hash' AS rule FROM o
  UNION ALL SELECT 'orders', 'c_copy', day + 36500, o_orderkey, o_totalprice, 'hash' FROM o WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 'orders', 'd_part', day, o_orderkey, CASE WHEN day(day) % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 'hash' FROM o WHERE o_orderkey % 2 = 1 AND month(day) = 3
  UNION ALL SELECT 'orders', 'e_new', day + 73000, o_orderkey, o_totalprice, 'prefix' FROM o WHERE o_orderkey % 7 = 0
  UNION ALL SELECT 'other', 'b0', day, o_orderkey, o_totalprice, 'hash' FROM o WHERE o_orderkey % 2 = 0)"""


@query(f"""WITH {_BATCHES_SQL}, dd AS (SELECT series, batch, day, md5(string_agg(k || '|' || v, ',' ORDER BY k, v)) AS h FROM bt GROUP BY ALL),
ww AS (SELECT series, batch, min(rule) AS rule, md5(string_agg(k || '|' || v, ',' ORDER BY k, v)) AS h FROM bt GROUP BY ALL),
sh AS (SELECT a.series, a.batch, b.batch AS other, count(*) AS shared_days, count(*) FILTER (a.h = b.h) AS equal_days FROM dd a JOIN dd b ON a.series = b.series AND a.day = b.day AND a.batch < b.batch GROUP BY ALL),
tw AS (SELECT a.series, a.batch, b.batch AS other, TRUE AS same_content FROM ww a JOIN ww b ON a.series = b.series AND a.h = b.h AND a.batch < b.batch),
fi AS (SELECT series, arg_min(rule, batch) AS declared, min(batch) AS batch FROM ww GROUP BY 1),
de AS (SELECT ww.series, fi.batch, ww.batch AS other, TRUE AS redefined FROM ww JOIN fi USING (series) WHERE rule <> declared)
SELECT series, batch, other, coalesce(same_content, FALSE) AS same_content, coalesce(redefined, FALSE) AS redefined, coalesce(shared_days, 0) AS shared_days, coalesce(equal_days, 0) AS equal_days,
  CASE WHEN redefined THEN 'series_definition_conflict' WHEN same_content THEN 'same_content' ELSE 'date_overlap' END AS status FROM sh FULL JOIN tw USING (series, batch, other) FULL JOIN de USING (series, batch, other)""")
def batch_content_check(spark, sf_dir):
    """Content twice, partial overlap and redefinition of a series among planted batches."""
    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("series"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit("hash").alias("rule"))
    even, odd = F.col("k") % 2 == 0, F.col("k") % 2 == 1
    named = lambda df, name: df.withColumn("batch", F.lit(name))
    changed = F.when(F.dayofmonth("day") % 2 == 0, F.col("v") + 1).otherwise(F.col("v"))
    parts = [
        o.withColumn("batch", F.concat(F.lit("b"), (F.col("k") % 2).cast("string"))), named(o.where(even).withColumn("day", F.date_add("day", 36500)), "c_copy"),
        named(o.where(odd & (F.month("day") == 3)).withColumn("v", changed), "d_part"), named(o.where(F.col("k") % 7 == 0).withColumns({"day": F.date_add("day", 73000), "rule": F.lit("prefix")}), "e_new"),
        named(o.where(even).withColumn("series", F.lit("other")), "b0"),
    ]
    return gates.batch_conflicts(written(gates.batch_days(reduce(DataFrame.unionByName, parts), ["rule"], ["k", "v"]), "batch_days"))


@query(f"""WITH {_GATES_SQL}, lo AS (SELECT DATE '2024-01-01' AS a, DATE '2024-02-10' AS b), seen AS (SELECT * FROM gates WHERE day(utc_date) % 9 <> 4),
al AS (SELECT CAST(unnest(range(a, b + 1, INTERVAL 1 DAY)) AS DATE) AS utc_date FROM lo), pu AS (SELECT utc_date, purpose FROM al, (VALUES ('count'), ('amount')) p(purpose)),
us AS (SELECT utc_date, 'count' AS purpose, count_allowed AS usable FROM seen UNION ALL SELECT utc_date, 'amount', count_allowed AND amount_allowed FROM seen),
w AS (SELECT pu.utc_date, pu.purpose, o.days, pu.utc_date - o.days AS past, us.usable FROM pu, (VALUES (0), (7), (14), (21), (28)) o(days) LEFT JOIN us ON us.utc_date = pu.utc_date - o.days AND us.purpose = pu.purpose),
r AS (SELECT w.*, CASE WHEN usable THEN NULL WHEN past < a OR past > b THEN 'outside_observation:' || past WHEN usable IS NULL THEN 'missing_date:' || past ELSE 'quality_blocked:' || past END AS why FROM w, lo),
g AS (SELECT utc_date, purpose, coalesce(string_agg(CAST(past AS VARCHAR), ',' ORDER BY days) FILTER (days > 0 AND usable), '') AS history_dates, count(*) FILTER (days > 0 AND usable) AS history_count, coalesce(bool_or(usable) FILTER (days = 0), FALSE) AS current,
  concat_ws(';', string_agg(why, ';' ORDER BY days) FILTER (days > 0), CASE WHEN NOT coalesce(bool_or(usable) FILTER (days = 0), FALSE) THEN 'current_date_missing_or_blocked' END) AS why FROM r GROUP BY ALL)
SELECT utc_date, purpose, history_dates, history_count, history_count >= 3 AS meets_min3, history_count = 4 AS meets_full4, CASE WHEN NOT current THEN 'current_date_unavailable' WHEN history_count >= 3 THEN 'history_available_not_evaluated' ELSE 'insufficient_history' END AS status,
  CASE WHEN why = '' THEN 'history_quantity_only' ELSE why END AS reason FROM g""")
def history_readiness(spark, sf_dir):
    """Some dates were not looked at, and the window goes on beyond the records."""
    seen = gates.date_gates(facts(spark, sf_dir), "2024-01-01", "2024-02-02").where(F.dayofmonth("utc_date") % 9 != 4)
    return gates.history_readiness(seen, "2024-01-01", "2024-02-10")


_DUP_SQL = "SELECT l_orderkey, l_linenumber, count(*) AS size, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount, CAST(max(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS retained FROM lineitem GROUP BY ALL"
_DUP_KEY = ["l_orderkey", "l_linenumber"]


@query("SELECT l_orderkey, l_linenumber, trim(trailing '.' FROM trim(trailing '0' FROM CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR))) || '|' || l_returnflag AS key FROM lineitem")
def dup_keys(spark, sf_dir):
    return quality.normalised_key(table(spark, sf_dir, "lineitem").select(*_DUP_KEY, "l_discount", "l_returnflag"), "l_discount", ["l_returnflag"]).select(*_DUP_KEY, "key")


@query(_DUP_SQL)
def dup_groups(spark, sf_dir):
    return quality.groups(table(spark, sf_dir, "lineitem"), _DUP_KEY, "l_extendedprice")


@query("""WITH k AS (SELECT *, trim(trailing '.' FROM trim(trailing '0' FROM CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR))) || '|' || l_returnflag || '|' || l_suppkey AS key FROM lineitem)
SELECT key, count(*) AS size, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount, CAST(max(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS retained FROM k GROUP BY 1""")
def dup_groups_normalised(spark, sf_dir):
    """Groups by the normalised key, in which 0.1 and 0.10 are the same."""
    rows = table(spark, sf_dir, "lineitem").select("l_discount", "l_returnflag", F.col("l_suppkey").cast("string").alias("l_suppkey"), "l_extendedprice")
    return quality.groups(quality.normalised_key(rows, "l_discount", ["l_returnflag", "l_suppkey"]), ["key"], "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS size FROM lineitem")
def dup_label(spark, sf_dir):
    return quality.label(table(spark, sf_dir, "lineitem"), _DUP_KEY, "l_extendedprice").select(*_DUP_KEY, "l_partkey", "l_suppkey", "l_shipdate", "size")


@query("""WITH g AS (SELECT l_returnflag AS kind, l_orderkey, l_linenumber, count(*) AS size, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS a, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS r FROM lineitem GROUP BY ALL)
SELECT CASE WHEN grouping(kind) = 1 THEN '__all__' ELSE kind END AS kind, count(*) FILTER (size > 1) AS groups, CAST(coalesce(sum(size) FILTER (size > 1), 0) AS BIGINT) AS involved, CAST(coalesce(sum(size - 1), 0) AS BIGINT) AS excess, CAST(coalesce(sum(a - r), 0) AS DECIMAL(38,2)) AS reduction
FROM g GROUP BY GROUPING SETS ((), (kind))""")
def dup_summary(spark, sf_dir):
    return quality.duplicate_summary(table(spark, sf_dir, "lineitem"), _DUP_KEY, "l_returnflag", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS n FROM lineitem) WHERE n = 1")
def dup_keep_one(spark, sf_dir):
    return quality.keep_one(table(spark, sf_dir, "lineitem"), _DUP_KEY, ["l_partkey", "l_suppkey", "l_shipdate"]).select(*_DUP_KEY, "l_partkey", "l_suppkey", "l_shipdate")


@query("SELECT day, count(*) FILTER (n > 1) AS groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS involved, CAST(sum(n - 1) AS BIGINT) AS excess FROM (SELECT CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY day")
def raw_duplicate_by_day(spark, sf_dir):
    return quality.duplicates_by_day(table(spark, sf_dir, "lineitem"), _DUP_KEY, F.to_date("l_shipdate"))


_SESSION_SQL = FACT_SQL + r""",
sessions AS (SELECT user_id, sess AS user_session, count(*) AS events, count(*) FILTER (kind = 'purchase') AS purchases, CAST(coalesce(sum(price) FILTER (paid), 0) AS DECIMAL(38,2)) AS amount,
  min(ts) AS first_time, max(ts) AS last_time, count(DISTINCT d) AS dates, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS span_seconds, count(*) > 12 AS heavy FROM fact WHERE ok AND NOT no_sess GROUP BY ALL)"""


@query(f"WITH {_SESSION_SQL} SELECT * FROM sessions")
def session_profile(spark, sf_dir):
    return quality.sessions(facts(spark, sf_dir), 12)


@query(f"WITH {_SESSION_SQL} SELECT f.event_id, s.events AS session_events, s.heavy FROM fact f LEFT JOIN sessions s ON f.ok AND NOT f.no_sess AND f.user_id = s.user_id AND f.sess = s.user_session")
def session_label(spark, sf_dir):
    return quality.label_sessions(facts(spark, sf_dir), 12).select("event_id", F.col("events").alias("session_events"), "heavy")


@query(f"""WITH {_SESSION_SQL} SELECT count(*) AS sessions, round(quantile_cont(events, 0.5), 6) AS events_p50, round(quantile_cont(events, 0.9), 6) AS events_p90, round(quantile_cont(events, 0.99), 6) AS events_p99, max(events) AS events_max,
  round(quantile_cont(span_seconds, 0.5), 6) AS span_p50, round(quantile_cont(span_seconds, 0.9), 6) AS span_p90, round(quantile_cont(span_seconds, 0.99), 6) AS span_p99, max(span_seconds) AS span_max, count(*) FILTER (heavy) AS heavy_sessions, CAST(coalesce(sum(events) FILTER (heavy), 0) AS BIGINT) AS heavy_events, count(DISTINCT user_id) FILTER (heavy) AS heavy_users,
  CAST(coalesce(sum(amount) FILTER (heavy), 0) AS DECIMAL(38,2)) AS heavy_amount, count(*) FILTER (dates > 1) AS cross_day FROM sessions""")
def session_summary(spark, sf_dir):
    return quality.session_summary(once(spark, "sessions", sf_dir, lambda: quality.sessions(facts(spark, sf_dir), 12)))


@query(f"WITH {_SESSION_SQL} SELECT f.event_id FROM fact f LEFT JOIN sessions s ON f.ok AND NOT f.no_sess AND f.user_id = s.user_id AND f.sess = s.user_session WHERE NOT coalesce(s.heavy, FALSE)")
def session_exclude_heavy(spark, sf_dir):
    return quality.exclude_heavy(quality.label_sessions(facts(spark, sf_dir), 12)).select("event_id")


_MEASURES = """count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN kind = 'purchase' THEN user_id END) AS buyers, count(*) FILTER (kind = 'purchase') AS purchases,
  CAST(coalesce(sum(price) FILTER (paid), 0) AS DECIMAL(38,2)) AS amount, count(*) FILTER (kind = 'view') AS views, count(*) FILTER (kind = 'cart') AS carts, count(*) FILTER (kind = 'remove_from_cart') AS removes, count(*) FILTER (no_sess) AS missing_session"""


@query(f"WITH {FACT_SQL} SELECT CASE WHEN grouping(d) = 1 THEN '__all__' ELSE CAST(d AS VARCHAR) END AS period, {_MEASURES} FROM fact GROUP BY GROUPING SETS ((), (d))")
def quality_measures(spark, sf_dir):
    return quality.measures(facts(spark, sf_dir))


_PERIODS_SQL = "SELECT CASE WHEN grouping(d) = 1 THEN '__all__' ELSE CAST(d AS VARCHAR) END AS period, " + _MEASURES + " FROM {t} GROUP BY GROUPING SETS ((), (d))"
_LONG_SQL = "UNPIVOT (SELECT period, " + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in quality.MEASURES) + " FROM {t}) ON " + ", ".join(quality.MEASURES) + " INTO NAME metric VALUE {v}"
_CHANGE_SQL = """SELECT '{s}' AS scenario, u.period, u.metric, round(baseline, 2) AS baseline, round(coalesce(cleaned, 0), 2) AS cleaned, round(coalesce(cleaned, 0) - baseline, 2) AS change,
  round(CASE WHEN baseline > 0 THEN (coalesce(cleaned, 0) - baseline) / baseline END, 6) AS relative, CASE WHEN baseline = 0 THEN 'baseline_zero' ELSE 'defined' END AS reason,
  CASE WHEN cleaned IS NULL THEN 'all_rows_removed_by_hypothesis' ELSE 'observed' END AS state FROM u LEFT JOIN {t} v ON u.period = v.period AND u.metric = v.metric"""


@query(f"""WITH {_SESSION_SQL}, kept AS (SELECT f.* FROM fact f LEFT JOIN sessions s ON f.ok AND NOT f.no_sess AND f.user_id = s.user_id AND f.sess = s.user_session WHERE NOT coalesce(s.heavy, FALSE)),
once AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY d, user_id, product_id, kind ORDER BY event_id) AS nth FROM fact) WHERE nth = 1),
a AS ({_PERIODS_SQL.format(t="fact")}), b AS ({_PERIODS_SQL.format(t="kept")}), c AS ({_PERIODS_SQL.format(t="once")}),
u AS ({_LONG_SQL.format(t="a", v="baseline")}), vb AS ({_LONG_SQL.format(t="b", v="cleaned")}), vc AS ({_LONG_SQL.format(t="c", v="cleaned")})
{_CHANGE_SQL.format(s="without_heavy_sessions", t="vb")} UNION ALL {_CHANGE_SQL.format(s="one_of_each_key", t="vc")}""")
def quality_sensitivity(spark, sf_dir):
    df = facts(spark, sf_dir)
    once = quality.keep_one(df, ["event_date_utc", "user_id", "product_id", "event_type"], ["event_id"])
    return quality.sensitivity(df, {"without_heavy_sessions": quality.exclude_heavy(quality.label_sessions(df, 12)), "one_of_each_key": once})


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09' AND event_type = 'purchase' UNION ALL SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09' AND event_type <> 'purchase'")
def scan_union_periods(spark, sf_dir):
    """Two sources with the same date predicate and columns in each branch."""
    events = table(spark, sf_dir, "events")
    return union_periods([events.where("event_type = 'purchase'"), events.where("event_type <> 'purchase'")], ["event_id", "ts", "user_id"], "ts", "2024-01-03", "2024-01-09")
