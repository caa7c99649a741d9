"""Profiles, hash samples and order-free fingerprints of event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank, count_where, hash16, money


def _flag_counts(flags: list[str]) -> list:
    return [count_where(F.col(f)).alias(f) for f in flags]


def _amount():
    return money(F.coalesce(F.sum(F.when(F.col("amount_eligible"), F.col("price_decimal"))), F.lit(0))).alias("amount")


def summary(parsed: DataFrame, flags: list[str]) -> DataFrame:
    """One row: records, distinct users and buyers, every flag, the known amount.

    Users come first, so that counting two kinds of them distinctly expands no rows.
    """
    bought = F.col("event_eligible") & (F.col("event_type") == "purchase")
    users = parsed.groupBy("user_id").agg(F.count("*").alias("records"), F.bool_or("event_eligible").alias("user"), F.bool_or(bought).alias("buyer"), *_flag_counts(flags), _amount())
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return users.agg(total("records"), count_where(F.col("user")).alias("users"), count_where(F.col("buyer")).alias("buyers"), *[total(f) for f in flags], money(F.coalesce(F.sum("amount"), F.lit(0))).alias("amount"))


def daily(parsed: DataFrame, flags: list[str]) -> DataFrame:
    """The same counts by day; records without a valid time have a bucket of their own."""
    day = F.coalesce(F.col("event_date_utc").cast("string"), F.lit("invalid")).alias("day")
    return parsed.groupBy(day).agg(F.count("*").alias("records"), *_flag_counts(flags), _amount())


def calendar(spark, first: str, last: str, name: str = "day") -> DataFrame:
    days = F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    return spark.range(1).select(days.alias(name))


def source(parsed: DataFrame, first: str, last: str, columns: list[str]) -> DataFrame:
    """Long form (part, value, n): per day with days without records, per hour, per type, anomalies, time range, records outside the dates."""
    timed = parsed.where("event_timestamp_utc is not null")
    days = timed.groupBy(F.col("event_date_utc").alias("day")).agg(F.count("*").alias("n"))
    by_day = calendar(parsed.sparkSession, first, last).join(days, "day", "left").select(F.lit("day").alias("part"), F.col("day").cast("string").alias("value"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    by_hour = timed.groupBy(F.hour("event_timestamp_utc").cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit("hour").alias("part"), "value", "n")
    by_type = parsed.groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("type").alias("part"), "value", "n")
    odd = {f"empty:{c}": F.col(c) == "" for c in columns} | {"time:invalid": F.col("time_invalid"), "user_id:leading_zero": F.col("user_id").rlike("^0[0-9]")}
    counted = parsed.agg(*[count_where(v).alias(k) for k, v in odd.items()])
    long = counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.lit("").alias("value"), F.col(f"`{k}`").alias("n")) for k in odd])).alias("x")).select("x.*")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    ends = timed.agg(F.count("*").alias("n"), text(F.min("event_timestamp_utc")).alias("first"), text(F.max("event_timestamp_utc")).alias("last"), count_where(~F.col("event_date_utc").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("outside"))
    row = lambda part, value, n: F.struct(F.lit(part).alias("part"), value.alias("value"), n.alias("n"))
    ranged = ends.select(F.explode(F.array(row("time:first", F.col("first"), F.col("n")), row("time:last", F.col("last"), F.col("n")), row("time:outside", F.lit(""), F.col("outside")))).alias("x")).select("x.*")
    return reduce(DataFrame.unionByName, [by_day, by_hour, by_type, long, ranged])


def experiment(rows: DataFrame, domains: dict[str, list], finite: list[str]) -> DataFrame:
    """For each column (field): records, nulls, empty and white-space values, values outside its domain, no finite numbers."""

    def told(name: str):
        c, text = F.col(name), F.col(name).cast("string")
        number = c.cast("double")
        outside = ~c.isin(*domains[name]) if name in domains else F.lit(False)
        odd = F.isnan(number) | (F.abs(number) == float("inf")) if name in finite else F.lit(False)
        return F.struct(F.lit(name).alias("field"), c.isNull().alias("null"), (text == "").alias("empty"), (blank(text) & (text != "")).alias("white"), outside.alias("outside"), odd.alias("odd"))

    long = rows.select(F.explode(F.array(*map(told, [*domains, *(f for f in finite if f not in domains)]))).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count("*").alias("records"), *[count_where(F.coalesce(a, F.lit(False))).alias(b) for a, b in (("null", "nulls"), ("empty", "empty"), ("white", "white_space"), ("outside", "outside"), ("odd", "nonfinite"))])


def sample_users(raw: DataFrame, prefix: str, below: str) -> DataFrame:
    """Every record of a user whose hash is below a share of the 64-bit range; blank ids never."""
    return raw.where(~blank(F.col("user_id")) & (hash16(prefix, F.col("user_id")) < below))


def validate_sample(raw: DataFrame, sample: DataFrame, prefix: str, below: str) -> DataFrame:
    """Whether the sample holds all records of its users and none by another rule."""
    users = sample.select("user_id").distinct()
    kept = raw.join(users, "user_id", "left_semi").agg(F.count("*").alias("all_events"))
    got = sample.agg(F.count("*").alias("sample_events"), F.countDistinct("user_id").alias("sample_users"), count_where(hash16(prefix, F.col("user_id")) >= below).alias("outside_rule"))
    whole = raw.agg(F.count("*").alias("source_events"))
    share = F.round(F.col("sample_events") / F.col("source_events").cast("double"), 6)
    return got.crossJoin(whole).crossJoin(kept).select("sample_events", "sample_users", "source_events", "outside_rule", (F.col("all_events") - F.col("sample_events")).alias("missing_events"), share.alias("share"))


def _hourly(events: DataFrame, name: str) -> DataFrame:
    """Purchases of every hour, of every day (hour -1) and in all (no day), from one aggregate by hour."""
    value = F.col("value").cast("decimal(18,2)")
    hours = events.where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.sum(value).alias("amount"))
    sets = hours.groupingSets([["day", "hour"], ["day"], []], "day", "hour").agg(F.sum("n").alias(f"{name}_n"), money(F.sum("amount")).alias(f"{name}_amount"))
    return sets.select("day", F.coalesce("hour", F.lit(-1)).alias("hour"), f"{name}_n", f"{name}_amount")


def reconcile_hours(source_events: DataFrame, stored: DataFrame) -> DataFrame:
    """Two copies of a record set compared hour by hour, day by day (hour -1) and in all (no day); hours without purchases are zeros."""
    hours = source_events.sparkSession.range(-1, 24).select(F.col("id").cast("int").alias("hour"))
    days = source_events.unionByName(stored).select(F.to_date("ts").alias("day")).distinct()
    spine = days.crossJoin(F.broadcast(hours))
    spine = spine.unionByName(spine.sparkSession.sql("SELECT CAST(NULL AS DATE) AS day, -1 AS hour"))
    here, there = _hourly(source_events, "source").withColumnsRenamed({"day": "d1", "hour": "h1"}), _hourly(stored, "stored").withColumnsRenamed({"day": "d2", "hour": "h2"})
    met = lambda d, h: F.col("day").eqNullSafe(F.col(d)) & (F.col("hour") == F.col(h))
    both = spine.join(here, met("d1", "h1"), "left").join(there, met("d2", "h2"), "left")
    same = F.col("source_n").eqNullSafe(F.col("stored_n")) & F.col("source_amount").eqNullSafe(F.col("stored_amount"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return both.select("day", "hour", zero(F.col("source_n")).alias("source_n"), zero(F.col("stored_n")).alias("stored_n"), money(F.coalesce("source_amount", F.lit(0))).alias("source_amount"), same.alias("same"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, sum and exclusive-or of 60-bit hashes of the rows' text: changes with any value or multiplicity, not with order.

    A null is told from an empty text by a sign before each value.
    """
    text = F.concat_ws("|", *[F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("records"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("hash_sum"), F.coalesce(F.bit_xor(h), F.lit(0).cast("long")).alias("hash_xor"))
