"""Funnels and the purchase audit, with product = props.k modulo 10 so that paths occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import funnel
from ..sources.scratch import written
from ..sources.tables import FACT_SQL, facts
from .registry import query

CENSORED = "2024-01-29 00:00:00"

PATHS_SQL = FACT_SQL + r""",
fe AS (SELECT * REPLACE (CAST(CAST(product_id AS BIGINT) % 10 AS VARCHAR) AS product_id), ok AND NOT no_sess AS valid FROM fact),
st AS (SELECT user_id, sess, product_id, min(ts) AS v FROM fe WHERE valid AND kind = 'view' GROUP BY ALL),
ln AS (SELECT fe.*, v, v + INTERVAL 24 HOUR AS deadline FROM fe LEFT JOIN st ON fe.valid AND fe.user_id = st.user_id AND fe.sess = st.sess AND fe.product_id = st.product_id),
ag AS (SELECT user_id, sess, product_id, v, min(ts) FILTER (kind = 'cart' AND ts > v AND ts <= deadline) AS c1, max(ts) FILTER (kind = 'purchase' AND ts > v AND ts <= deadline) AS b1, min(ts) FILTER (kind = 'cart' AND ts >= v AND ts <= deadline) AS c2, max(ts) FILTER (kind = 'purchase' AND ts >= v AND ts <= deadline) AS b2,
  count(*) FILTER (kind = 'view' AND ts = v AND (price IS NULL OR price < 0)) AS badp, count(DISTINCT price) FILTER (kind = 'view' AND ts = v AND price >= 0) AS np, min(price) FILTER (kind = 'view' AND ts = v AND price >= 0) AS p FROM ln WHERE v IS NOT NULL GROUP BY ALL),
cl AS (SELECT *, CASE WHEN c1 < b1 THEN 'view_cart_purchase' WHEN b1 IS NOT NULL THEN 'view_purchase_no_confirmed_intermediate_cart' WHEN c1 IS NOT NULL THEN 'view_cart_no_observed_purchase' ELSE 'view_only' END AS strict_class,
  CASE WHEN c2 <= b2 THEN 'view_cart_purchase' WHEN b2 IS NOT NULL THEN 'view_purchase_no_confirmed_intermediate_cart' WHEN c2 IS NOT NULL THEN 'view_cart_no_observed_purchase' ELSE 'view_only' END AS possible_class,
  CASE WHEN np > 1 THEN 'conflicting' WHEN badp > 0 OR np <> 1 THEN 'invalid_or_missing' ELSE 'unique_valid' END AS ps, v >= TIMESTAMP '2024-01-29 00:00:00' AS right_censored FROM ag),
paths AS (SELECT 'events' AS scope_id, user_id, sess AS user_session, product_id, v AS first_view_time, CAST(v AS DATE) AS start_date_utc, strict_class, possible_class, strict_class <> possible_class AS order_uncertain, right_censored,
  CASE WHEN right_censored THEN 'right_censored' WHEN strict_class <> possible_class THEN 'order_uncertain' ELSE 'formal' END AS release_status, c1 IS NOT NULL AS has_cart_after_view, b1 IS NOT NULL AS has_purchase_after_view, strict_class = 'view_cart_purchase' AS has_three_step,
  CASE WHEN ps = 'unique_valid' THEN p END AS first_view_price, ps AS first_view_price_status,
  CASE WHEN ps <> 'unique_valid' THEN 'unknown' WHEN p < 20 THEN '[0,20)' WHEN p < 50 THEN '[20,50)' WHEN p < 200 THEN '[50,200)' ELSE '[200,+inf)' END AS price_band FROM cl)"""


def _events(spark, sf_dir):
    return facts(spark, sf_dir).withColumn("product_id", (F.col("product_id").cast("long") % 10).cast("string"))


def path_table(spark, sf_dir):
    return funnel.paths(_events(spark, sf_dir), CENSORED)


@query(f"WITH {PATHS_SQL} SELECT 'events' AS scope_id, user_id, sess AS user_session, product_id, v AS first_view_time FROM st")
def funnel_starts(spark, sf_dir):
    return funnel.starts(_events(spark, sf_dir))


@query(f"WITH {PATHS_SQL} SELECT event_id, v AS first_view_time, deadline FROM ln")
def funnel_linked(spark, sf_dir):
    return funnel.linked(_events(spark, sf_dir)).select("event_id", "first_view_time", "deadline")


@query(f"WITH {PATHS_SQL} SELECT * FROM paths")
def funnel_paths(spark, sf_dir):
    return path_table(spark, sf_dir)


_COUNTS = """count(*) AS n_view, count(*) FILTER (has_cart_after_view) AS n_cart, count(*) FILTER (has_purchase_after_view) AS n_purchase, count(*) FILTER (has_three_step) AS n_three_step,
""" + ", ".join(f"count(*) FILTER (strict_class = '{c}') AS {c}" for c in funnel.CLASSES)
_NAMES = ["n_view", "n_cart", "n_purchase", "n_three_step", *funnel.CLASSES]


@query(f"""WITH {PATHS_SQL}, f AS (SELECT * FROM paths WHERE release_status = 'formal'), bc AS (SELECT price_band AS segment, {_COUNTS} FROM f GROUP BY 1),
w AS (SELECT 'overall' AS level, 'all' AS segment, {_COUNTS} FROM f UNION ALL SELECT 'start_day', CAST(start_date_utc AS VARCHAR), {_COUNTS} FROM f GROUP BY start_date_utc
  UNION ALL SELECT 'price_band', b.s, {', '.join(f'coalesce({n}, 0)' for n in _NAMES)} FROM (VALUES ('[0,20)'), ('[20,50)'), ('[50,200)'), ('[200,+inf)'), ('unknown')) b(s) LEFT JOIN bc ON segment = b.s)
SELECT *, round(CASE WHEN n_view > 0 THEN n_cart / CAST(n_view AS DOUBLE) END, 6) AS view_to_cart, round(CASE WHEN n_cart > 0 THEN n_three_step / CAST(n_cart AS DOUBLE) END, 6) AS cart_to_purchase_three_step,
  round(CASE WHEN n_view > 0 THEN n_purchase / CAST(n_view AS DOUBLE) END, 6) AS view_to_purchase, round(CASE WHEN n_view > 0 THEN n_three_step / CAST(n_view AS DOUBLE) END, 6) AS three_step_ratio,
  CASE WHEN n_view > 0 THEN 'defined' ELSE 'zero_denominator' END AS view_denominator_status, CASE WHEN n_cart > 0 THEN 'defined' ELSE 'zero_denominator' END AS cart_denominator_status FROM w""")
def funnel_summary(spark, sf_dir):
    return funnel.summary(path_table(spark, sf_dir))


@query(f"""WITH {PATHS_SQL}, k AS (SELECT count(*) AS n, count(*) FILTER (NOT ok) AS u, count(*) FILTER (ok AND no_sess) AS s, count(*) FILTER (ok AND NOT no_sess AND NOT valid) AS p, count(*) FILTER (valid) AS g, count(*) FILTER (no_sess) AS fs, count(*) FILTER (valid AND v IS NULL) AS nv FROM ln),
w AS (SELECT 'release' AS part, release_status AS value, count(*) AS n, (SELECT count(*) FROM paths) AS denominator FROM paths GROUP BY ALL
  UNION ALL SELECT 'price', first_view_price_status, count(*), (SELECT count(*) FROM paths) FROM paths GROUP BY ALL
  UNION ALL SELECT 'flag', 'order_uncertain', count(*) FILTER (order_uncertain), count(*) FROM paths UNION ALL SELECT 'flag', 'right_censored', count(*) FILTER (right_censored), count(*) FROM paths
  UNION ALL SELECT 'key', 'user_id', u, n FROM k UNION ALL SELECT 'key', 'session', s, n FROM k UNION ALL SELECT 'key', 'product_id', p, n FROM k UNION ALL SELECT 'key', 'valid', g, n FROM k
  UNION ALL SELECT 'key_flag', 'user_id', u, n FROM k UNION ALL SELECT 'key_flag', 'session', fs, n FROM k UNION ALL SELECT 'view', 'valid_key_without_view', nv, n FROM k)
SELECT *, round(CASE WHEN denominator > 0 THEN n / CAST(denominator AS DOUBLE) END, 6) AS ratio, CASE WHEN denominator > 0 THEN 'defined' ELSE 'zero_denominator' END AS ratio_status FROM w""")
def funnel_exclusions(spark, sf_dir):
    return funnel.exclusions(_events(spark, sf_dir), path_table(spark, sf_dir))


@query(f"""WITH {PATHS_SQL}, r AS (SELECT CAST(d AS VARCHAR) AS day, CASE WHEN NOT valid THEN 'invalid_path_key' WHEN v IS NULL THEN 'no_view_same_key' WHEN ts <= v THEN 'purchase_at_or_before_first_view'
  WHEN NOT (v >= TIMESTAMP '2024-01-01 00:00:00' AND v < TIMESTAMP '2024-01-29 00:00:00') THEN 'start_outside_formal_range' WHEN ts > deadline THEN 'beyond_24_hours' ELSE 'within_path_window' END AS reason FROM ln WHERE kind = 'purchase')
SELECT day, reason, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT '__all__', reason, count(*) FROM r GROUP BY ALL""")
def purchase_audit(spark, sf_dir):
    return funnel.purchase_audit(_events(spark, sf_dir), "2024-01-01 00:00:00", CENSORED)


#: Paths with planted faults, by the last digit of the product and the user.
_DAMAGED_SQL = """dp0 AS (SELECT * REPLACE (
  CASE WHEN CAST(user_id AS BIGINT) % 11 = 3 THEN FALSE ELSE has_cart_after_view END AS has_cart_after_view, CASE WHEN CAST(user_id AS BIGINT) % 13 = 5 THEN FALSE ELSE has_purchase_after_view END AS has_purchase_after_view,
  CASE WHEN CAST(user_id AS BIGINT) % 17 = 6 THEN 'other' ELSE strict_class END AS strict_class, CASE WHEN CAST(user_id AS BIGINT) % 19 = 7 THEN NULL ELSE first_view_price END AS first_view_price,
  CASE WHEN CAST(user_id AS BIGINT) % 5 = 1 THEN 'formal' ELSE release_status END AS release_status, CASE WHEN CAST(user_id AS BIGINT) % 23 = 8 THEN start_date_utc + 1 ELSE start_date_utc END AS start_date_utc) FROM paths),
dp AS (SELECT * FROM dp0 UNION ALL SELECT * FROM dp0 WHERE CAST(user_id AS BIGINT) % 29 = 9)"""


def _damaged(paths):
    """The same faults in Spark."""
    u = F.col("user_id").cast("long")
    out = paths.withColumns({
        "has_cart_after_view": (u % 11 != 3) & F.col("has_cart_after_view"), "has_purchase_after_view": (u % 13 != 5) & F.col("has_purchase_after_view"), "strict_class": F.when(u % 17 == 6, "other").otherwise(F.col("strict_class")),
        "first_view_price": F.when(u % 19 != 7, F.col("first_view_price")), "release_status": F.when(u % 5 == 1, "formal").otherwise(F.col("release_status")), "start_date_utc": F.when(u % 23 == 8, F.date_add("start_date_utc", 1)).otherwise(F.col("start_date_utc")),
    })
    return out.unionByName(out.where(u % 29 == 9))


_INVARIANTS_SQL = f"""count(*) FILTER (has_three_step AND NOT has_cart_after_view) AS three_step_without_cart, count(*) FILTER (has_three_step AND NOT has_purchase_after_view) AS three_step_without_purchase,
  count(*) FILTER (strict_class NOT IN ({", ".join(f"'{c}'" for c in funnel.CLASSES)})) AS unknown_class, count(*) - count(DISTINCT (user_id, user_session, product_id)) AS repeated_keys, count(*) FILTER (first_view_price IS NULL AND price_band <> 'unknown') AS band_without_price,
  count(*) FILTER (has_three_step <> (strict_class = '{funnel.CLASSES[0]}')) AS class_against_steps, count(*) FILTER (release_status = 'formal' AND (order_uncertain OR right_censored)) AS formal_without_order,
  count(*) FILTER (start_date_utc <> CAST(first_view_time AS DATE)) AS day_against_time, count(*) FILTER (user_id IS NULL OR user_session IS NULL OR product_id IS NULL) AS null_keys"""


@query(f"WITH {PATHS_SQL}, {_DAMAGED_SQL} SELECT 'paths' AS scope, {_INVARIANTS_SQL} FROM paths UNION ALL SELECT 'damaged', {_INVARIANTS_SQL} FROM dp")
def funnel_invariants(spark, sf_dir):
    """The paths, which break nothing, and a copy with planted faults."""
    paths = written(path_table(spark, sf_dir), "paths")
    both = [funnel.invariants(df).select(F.lit(scope).alias("scope"), "*") for scope, df in (("paths", paths), ("damaged", _damaged(paths)))]
    return both[0].unionByName(both[1])


@query(f"""WITH {PATHS_SQL}, {_DAMAGED_SQL}, f AS (SELECT * FROM dp WHERE release_status = 'formal'), w AS (SELECT 'overall' AS level, {_COUNTS} FROM f UNION ALL SELECT 'start_day', {_COUNTS} FROM f GROUP BY start_date_utc UNION ALL SELECT 'price_band', {_COUNTS} FROM f GROUP BY price_band),
s AS (SELECT level, {", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in _NAMES)}, CAST(sum(abs(n_view - ({" + ".join(funnel.CLASSES)}))) AS BIGINT) AS class_sum, count(*) FILTER (n_three_step > least(n_cart, n_purchase) OR greatest(n_cart, n_purchase) > n_view) AS bounds FROM w GROUP BY 1),
u AS (UNPIVOT s ON {", ".join(_NAMES)}, class_sum, bounds INTO NAME "column" VALUE total), e AS (SELECT *, CASE WHEN "column" IN ('class_sum', 'bounds') THEN 0 ELSE max(total) FILTER (level = 'overall') OVER (PARTITION BY "column") END AS expected FROM u)
SELECT level, "column", total, CAST(expected AS BIGINT) AS expected, total = expected AS holds FROM e""")
def funnel_conservation(spark, sf_dir):
    """Sums over days and bands, and class sums, of the damaged paths: what the planted classes break shows."""
    return funnel.conservation(funnel.summary(_damaged(path_table(spark, sf_dir))))
