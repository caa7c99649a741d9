"""Event facts and raw event strings from the driver's `events` table, in Spark and in SQL.

The table lacks some columns of an event log; they are derived by rules on event_id that both
engines can repeat.  Rules that spoil a value are there so that every state occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import EVENT_TYPES, blank, digits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(n: int):
    return F.col("event_id") % n == 0


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and the nine strings of a raw record."""
    k = F.get_json_object("props", "$.k").cast("long")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    price = F.col("value").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(_every(101), "").when(_every(103), "2024-02-30 00:00:00 UTC").when(_every(107), F.concat(text, F.lit(" UTC\n"))).otherwise(F.concat(text, F.lit(" UTC"))).alias("event_time"),
        F.when(_every(109), "View").when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type")).alias("event_type"),
        F.when(_every(131), "").otherwise(k.cast("string")).alias("product_id"),
        F.when(_every(137), "1a").otherwise((k * 10).cast("string")).alias("category_id"),
        F.when(k % 11 == 0, "").when(k % 29 == 0, ".bad").otherwise(F.concat(F.lit("c"), (k % 7).cast("string"), F.lit(".x"))).alias("category_code"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("b"), (k % 10).cast("string"))).alias("brand"),
        F.when(_every(139), "NaN").when(_every(149), "-1.50").when(_every(151), "0.00").when(_every(157), "1.234").when(_every(163), "12345678901234567.00").when(_every(167), "abc").when(_every(173), "").otherwise(price).alias("price"),
        F.when(_every(113), " ").when(_every(127), F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(_every(17), "").otherwise(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")).alias("user_session"),
    )


RAW_SQL = r"""
src AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events),
raw AS (SELECT event_id,
  CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 103 = 0 THEN '2024-02-30 00:00:00 UTC' WHEN event_id % 107 = 0 THEN t || ' UTC' || chr(10) ELSE t || ' UTC' END AS event_time,
  CASE WHEN event_id % 109 = 0 THEN 'View' WHEN event_type = 'click' THEN 'cart' ELSE event_type END AS event_type,
  CASE WHEN event_id % 131 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS product_id,
  CASE WHEN event_id % 137 = 0 THEN '1a' ELSE CAST(k * 10 AS VARCHAR) END AS category_id,
  CASE WHEN k % 11 = 0 THEN '' WHEN k % 29 = 0 THEN '.bad' ELSE 'c' || (k % 7) || '.x' END AS category_code,
  CASE WHEN k % 13 = 0 THEN NULL ELSE 'b' || (k % 10) END AS brand,
  CASE WHEN event_id % 139 = 0 THEN 'NaN' WHEN event_id % 149 = 0 THEN '-1.50' WHEN event_id % 151 = 0 THEN '0.00' WHEN event_id % 157 = 0 THEN '1.234'
    WHEN event_id % 163 = 0 THEN '12345678901234567.00' WHEN event_id % 167 = 0 THEN 'abc' WHEN event_id % 173 = 0 THEN '' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS price,
  CASE WHEN event_id % 113 = 0 THEN ' ' WHEN event_id % 127 = 0 THEN 'u' || user_id ELSE CAST(user_id AS VARCHAR) END AS user_id,
  CASE WHEN event_id % 17 = 0 THEN '' ELSE strftime(date_trunc('week', ts), '%Y-%m-%d') END AS user_session
FROM src)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed events of the known types, with flags; most days are clean, some are not."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type"))
    base = table(spark, sf_dir, "events").select(
        "event_id", F.lit("events").alias("scope_id"), F.col("ts").alias("event_timestamp_utc"), F.to_date("ts").alias("event_date_utc"),
        F.when(_every(997), "").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(_every(17), "").otherwise(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")).alias("user_session"),
        k.cast("string").alias("product_id"), kind.alias("event_type"),
        F.when(k % 11 == 0, "").when(k % 29 == 0, ".bad").otherwise(F.concat(F.lit("c"), (k % 7).cast("string"), F.lit(".x"))).alias("category_code"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("b"), (k % 10).cast("string"))).alias("brand"),
        F.when(_every(211), F.lit(None)).otherwise(F.col("value").cast("decimal(18,2)")).alias("price_decimal"),
    ).where(F.col("event_type").isin(*EVENT_TYPES))
    return with_flags(base)


def with_flags(base: DataFrame) -> DataFrame:
    user_ok = digits(F.col("user_id"))
    flagged = base.withColumns({
        "user_id_missing": blank(F.col("user_id")), "user_id_invalid": ~blank(F.col("user_id")) & ~user_ok,
        "session_missing": blank(F.col("user_session")), "brand_missing": blank(F.col("brand")), "category_missing": blank(F.col("category_code")),
        "event_eligible": user_ok, "price_zero": F.coalesce(F.col("price_decimal") == 0, F.lit(False)),
    })
    return flagged.withColumn("amount_eligible", F.col("event_eligible") & (F.col("event_type") == "purchase") & F.coalesce(F.col("price_decimal") >= 0, F.lit(False)))


FACT_SQL = r"""
src AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
fact0 AS (SELECT event_id, 'events' AS scope_id, ts, CAST(ts AS DATE) AS d, CASE WHEN event_id % 997 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS user_id,
  CASE WHEN event_id % 17 = 0 THEN '' ELSE strftime(date_trunc('week', ts), '%Y-%m-%d') END AS sess, CAST(k AS VARCHAR) AS product_id,
  CASE event_type WHEN 'click' THEN 'cart' ELSE event_type END AS kind,
  CASE WHEN k % 11 = 0 THEN '' WHEN k % 29 = 0 THEN '.bad' ELSE 'c' || (k % 7) || '.x' END AS code, CASE WHEN k % 13 = 0 THEN '' ELSE 'b' || (k % 10) END AS brand,
  CASE WHEN event_id % 211 = 0 THEN NULL ELSE CAST(value AS DECIMAL(18,2)) END AS price FROM src WHERE event_type IN ('view', 'click', 'purchase')),
fact AS (SELECT *, user_id <> '' AS ok, sess = '' AS no_sess, user_id <> '' AND kind = 'purchase' AND price IS NOT NULL AND price >= 0 AS paid FROM fact0)"""


def experiment(spark: SparkSession, sf_dir: str, all_features: bool = False) -> DataFrame:
    """One row for each line item: two features (or all twelve), a hashed arm (85% treated), an outcome, an exposure."""
    from ..functions.columns import hash16

    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem")
    ident = F.sha2(F.concat_ws("|", F.lit("row-v1"), *key, F.date_format("l_shipdate", "yyyy-MM-dd")), 256)
    out_columns = (ident.alias("row_id"), F.col("l_quantity").alias("f0"), F.col("l_extendedprice").alias("f1"), (F.col("l_returnflag") == "R").cast("int").alias("conversion"), (F.col("l_linestatus") == "O").cast("int").alias("visit"), (F.col("l_tax") > 0.04).alias("seen"))
    out = rows.select(*out_columns)
    if all_features:
        ship = F.col("l_shipdate")
        more = {
            "f2": F.col("l_discount"), "f3": F.col("l_tax"), "f4": F.col("l_linenumber"), "f5": F.col("l_partkey"), "f6": F.col("l_suppkey"), "f7": F.year(ship), "f8": F.month(ship), "f9": F.dayofweek(ship),
            "f10": F.col("l_extendedprice") / F.col("l_quantity"), "f11": F.col("l_orderkey") % 1000,
        }
        out = rows.select(*out_columns, *[c.cast("double").alias(f) for f, c in more.items()])
    # 0.85 of the 64-bit range.
    out = out.withColumn("treatment", (hash16("arm|", F.col("row_id")) < "d999999999999999").cast("int"))
    return out.withColumn("exposure", ((F.col("treatment") == 1) & F.col("seen")).cast("int")).drop("seen")


EXPERIMENT_SQL = r"""
x0 AS (SELECT sha256(concat_ws('|', 'row-v1', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'))) AS row_id,
  l_quantity AS f0, l_extendedprice AS f1, CAST(l_returnflag = 'R' AS INTEGER) AS conversion, CAST(l_linestatus = 'O' AS INTEGER) AS visit, l_tax > 0.04 AS seen FROM lineitem),
x1 AS (SELECT *, CAST(substr(sha256('arm|' || row_id), 1, 16) < 'd999999999999999' AS INTEGER) AS treatment FROM x0),
x AS (SELECT * EXCLUDE (seen), CAST(treatment = 1 AND seen AS INTEGER) AS exposure FROM x1)"""
