"""Duplicate records and heavy sessions: labelled, measured, never silently removed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import count_where, money, ratio
from ..functions.quantiles import exact_quantiles


def _cents(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


def normalised_key(rows: DataFrame, number: str, others: list[str]) -> DataFrame:
    """`key`: the number without trailing zeros, so that 1.0 and 1.00 agree, then the other fields."""
    text = F.regexp_replace(F.regexp_replace(_cents(number).cast("string"), "0+$", ""), r"\.$", "")
    return rows.withColumn("key", F.concat_ws("|", text, *others))


def groups(rows: DataFrame, key: list[str], amount: str) -> DataFrame:
    """Size, amount, and the amount if one record were kept, of each key."""
    return rows.groupBy(*key).agg(F.count("*").alias("size"), money(F.sum(_cents(amount))).alias("amount"), money(F.max(_cents(amount))).alias("retained"))


def label(rows: DataFrame, key: list[str], amount: str) -> DataFrame:
    """rows with the size of their group; null keys group with null keys."""
    sizes = groups(rows, key, amount).select(*[F.col(k).alias(f"{k}_of") for k in key], "size")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in key]
    return rows.join(sizes, same).drop(*[f"{k}_of" for k in key])


def duplicate_summary(rows: DataFrame, key: list[str], kind: str, amount: str) -> DataFrame:
    """Groups, involved and excess records and the hypothetical reduction, overall and for each kind, from one scan."""
    one = rows.groupBy(F.col(kind).alias("kind"), *key).agg(F.count("*").alias("size"), F.sum(_cents(amount)).alias("a"), F.max(_cents(amount)).alias("r"))
    many = F.col("size") > 1
    measures = [
        count_where(many).alias("groups"), F.coalesce(F.sum(F.when(many, F.col("size"))), F.lit(0)).cast("long").alias("involved"),
        F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).cast("long").alias("excess"), money(F.coalesce(F.sum(F.col("a") - F.col("r")), F.lit(0))).alias("reduction"),
    ]
    sets = one.groupingSets([["kind"], []], "kind").agg(F.grouping("kind").alias("all"), *measures)
    names = ["groups", "involved", "excess", "reduction"]
    named = sets.select(F.when(F.col("all") == 1, "__all__").otherwise(F.col("kind")).alias("kind"), *names)
    types = dict(named.dtypes)
    whole = rows.sparkSession.sql("SELECT '__all__' AS kind")  # over no rows the overall row is there too
    return whole.join(named, "kind", "full_outer").select("kind", *[F.coalesce(c, F.lit(0)).cast(types[c]).alias(c) for c in names])


def keep_one(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


def duplicates_by_day(rows: DataFrame, key: list[str], day: Column) -> DataFrame:
    sizes = rows.groupBy(day.alias("day"), *key).agg(F.count("*").alias("n"))
    return sizes.groupBy("day").agg(count_where(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("involved"), F.sum(F.col("n") - 1).cast("long").alias("excess"))


def _session_ok() -> Column:
    return ~F.col("session_missing") & ~F.col("user_id_missing") & ~F.col("user_id_invalid")


def sessions(facts: DataFrame, heavy_above: int) -> DataFrame:
    """One row for each valid (user, session); heavy means strictly more events than the threshold."""
    return facts.where(_session_ok()).groupBy("user_id", "user_session").agg(
        F.count("*").alias("events"), count_where(F.col("event_type") == "purchase").alias("purchases"),
        money(F.coalesce(F.sum(F.when(F.col("amount_eligible"), F.col("price_decimal"))), F.lit(0))).alias("amount"),
        F.min("event_timestamp_utc").alias("first_time"), F.max("event_timestamp_utc").alias("last_time"), F.countDistinct("event_date_utc").alias("dates"),
        (F.unix_timestamp(F.max("event_timestamp_utc").cast("timestamp")) - F.unix_timestamp(F.min("event_timestamp_utc").cast("timestamp"))).alias("span_seconds"),
        (F.count("*") > heavy_above).alias("heavy"),
    )


def label_sessions(facts: DataFrame, heavy_above: int) -> DataFrame:
    """facts with their session's size and weight; records of no valid session stay, unlabelled."""
    told = sessions(facts, heavy_above).select(F.col("user_id").alias("su"), F.col("user_session").alias("ss"), "events", "heavy")
    return facts.join(told, _session_ok() & (F.col("user_id") == F.col("su")) & (F.col("user_session") == F.col("ss")), "left").drop("su", "ss")


def exclude_heavy(labelled: DataFrame) -> DataFrame:
    return labelled.where(~F.coalesce("heavy", F.lit(False)))


def session_summary(sessions_: DataFrame) -> DataFrame:
    """Sizes and spans of sessions, their exact quantiles, and what is in heavy ones; sessions_ is a written table, for it is read several times."""
    heavy = F.col("heavy")
    points = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    found = exact_quantiles(sessions_, ["events", "span_seconds"], list(points.values()))
    rank = lambda c, k, name: F.round(F.lit(found[c][k]).cast("double"), 6).alias(name)
    ranks = lambda c, label: [rank(c, k, f"{label}_{p}") for k, p in enumerate(points)]
    return sessions_.agg(
        F.count("*").alias("sessions"), *ranks("events", "events"), F.max("events").alias("events_max"), *ranks("span_seconds", "span"), F.max("span_seconds").alias("span_max"), count_where(heavy).alias("heavy_sessions"),
        F.coalesce(F.sum(F.when(heavy, F.col("events"))), F.lit(0)).cast("long").alias("heavy_events"), F.countDistinct(F.when(heavy, F.col("user_id"))).alias("heavy_users"),
        money(F.coalesce(F.sum(F.when(heavy, F.col("amount"))), F.lit(0))).alias("heavy_amount"), count_where(F.col("dates") > 1).alias("cross_day"),
    )


MEASURES = ("events", "users", "buyers", "purchases", "amount", "views", "carts", "removes", "missing_session")


def measures(facts: DataFrame) -> DataFrame:
    """Nine measures overall and for each date, in one scan; over no records the overall row is there too."""
    kind = F.col("event_type")
    dated = facts.withColumn("period", F.col("event_date_utc").cast("string"))
    sets = dated.groupingSets([["period"], []], "period").agg(
        F.grouping("period").alias("all"), F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(kind == "purchase", F.col("user_id"))).alias("buyers"), count_where(kind == "purchase").alias("purchases"),
        money(F.coalesce(F.sum(F.when(F.col("amount_eligible"), F.col("price_decimal"))), F.lit(0))).alias("amount"),
        count_where(kind == "view").alias("views"), count_where(kind == "cart").alias("carts"), count_where(kind == "remove_from_cart").alias("removes"), count_where(F.col("session_missing")).alias("missing_session"),
    )
    named = sets.select(F.when(F.col("all") == 1, "__all__").otherwise(F.coalesce("period", F.lit(""))).alias("period"), *MEASURES)
    whole = facts.sparkSession.sql("SELECT '__all__' AS period")
    types = dict(named.dtypes)
    return whole.join(named, "period", "full_outer").select("period", *[F.coalesce(m, F.lit(0)).cast(types[m]).alias(m) for m in MEASURES])


def sensitivity(facts: DataFrame, cleanings: dict[str, DataFrame]) -> DataFrame:
    """What each hypothetical cleaning would change, by scenario, period and measure; the table itself stays as it is.

    reason: why there is no relative change; state: whether the cleaning left any record of the period.
    """
    long = lambda df, value: df.select("period", *[F.col(n).cast("double") for n in MEASURES]).unpivot("period", list(MEASURES), "metric", value)
    base = long(measures(facts), "baseline")
    parts = []
    for name, cleaned in cleanings.items():
        told = long(measures(cleaned), "after")
        both = base.join(told, ["period", "metric"], "left")
        after = F.coalesce("after", F.lit(0.0))
        change = after - F.col("baseline")
        parts.append(both.select(
            F.lit(name).alias("scenario"), "period", "metric", F.round("baseline", 2).alias("baseline"), F.round(after, 2).alias("cleaned"), F.round(change, 2).alias("change"), ratio(change, F.col("baseline")).alias("relative"),
            F.when(F.col("baseline") == 0, "baseline_zero").otherwise("defined").alias("reason"), F.when(F.col("after").isNull(), "all_rows_removed_by_hypothesis").otherwise("observed").alias("state"),
        ))
    return reduce(DataFrame.unionByName, parts)
