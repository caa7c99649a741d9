"""Behaviour metrics from event facts and date gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import amount_state, count_where, money, ratio, ratio_status


def _known() -> Column:
    return money(F.coalesce(F.sum(F.when(F.col("amount_eligible"), F.col("price_decimal"))), F.lit(0)))


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _bad() -> Column:
    return _is("purchase") & ~F.col("amount_eligible")


def eligible(facts: DataFrame) -> DataFrame:
    return facts.where("event_eligible")


def first_seen(facts: DataFrame) -> DataFrame:
    """Earliest time and date of each user over the whole observation."""
    return facts.groupBy("scope_id", "user_id").agg(F.min("event_timestamp_utc").alias("first_seen_utc"), F.min("event_date_utc").alias("first_seen_date_utc"))


def brand_topk(facts: DataFrame, first: str, last: str, k: int) -> DataFrame:
    """The k most frequent brands of a reference period; ties by name."""
    held = facts.where(~F.col("brand_missing") & F.col("event_date_utc").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    top = held.groupBy("brand").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "brand").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("records"), "brand"))  # k rows at most
    return top.withColumn("rank", rank)


def user_daily(facts: DataFrame, gates: DataFrame, seen: DataFrame) -> DataFrame:
    """One row for each user and day: counts, sessions, the gated amount and what is known of it."""
    session = F.when(~F.col("session_missing"), F.col("user_session"))
    days = facts.groupBy("scope_id", F.col("event_date_utc").alias("utc_date"), "user_id").agg(
        F.count("*").alias("event_records"), count_where(_is("view")).alias("view_events"), count_where(_is("cart")).alias("cart_events"),
        count_where(_is("remove_from_cart")).alias("remove_from_cart_events"), count_where(_is("purchase")).alias("purchase_events"),
        F.countDistinct(session).alias("sessions"), F.countDistinct(F.when(_is("purchase"), session)).alias("purchase_sessions"),
        count_where(_bad()).alias("purchase_amount_bad"), count_where(F.col("amount_eligible")).alias("purchase_amount_valid"),
        count_where(F.col("amount_eligible") & F.col("price_zero")).alias("purchase_zero_events"), _known().alias("known"),
    )
    joined = days.join(F.broadcast(gates.select("utc_date", "count_allowed", "amount_allowed")), "utc_date").join(seen.select("scope_id", "user_id", "first_seen_date_utc"), ["scope_id", "user_id"])
    return joined.withColumns({
        "is_buyer": F.col("purchase_events") > 0, "is_first_seen_day": F.col("utc_date") == F.col("first_seen_date_utc"),
        "purchase_amount": F.when(F.col("amount_allowed"), F.col("known")),
        "amount_status": amount_state(F.col("purchase_events"), F.col("purchase_amount_bad"), F.col("purchase_amount_valid")),
    }).drop("known", "first_seen_date_utc")


DAILY = ["active_users", "buyers", "first_seen_users", "event_records", "purchase_events", "purchase_amount_bad", "purchase_amount_valid", "purchase_amount", "amount_status"]


def daily_from_user(users: DataFrame) -> DataFrame:
    """Days from user-days: a user has one row a day, so rows count users."""
    total = lambda c: F.sum(c).cast("long").alias(c)
    days = users.groupBy("scope_id", "utc_date").agg(
        F.count("*").alias("active_users"), count_where(F.col("is_buyer")).alias("buyers"), count_where(F.col("is_first_seen_day")).alias("first_seen_users"),
        *[total(c) for c in ("event_records", "purchase_events", "purchase_amount_bad", "purchase_amount_valid")],
        F.bool_and("count_allowed").alias("count_allowed"), F.bool_and("amount_allowed").alias("amount_allowed"), money(F.sum("purchase_amount")).alias("known"),
    )
    return _finished(days)


def _finished(days: DataFrame) -> DataFrame:
    amount = F.when(F.col("amount_allowed"), F.col("known")).alias("purchase_amount")
    state = amount_state(F.col("purchase_events"), F.col("purchase_amount_bad"), F.col("purchase_amount_valid")).alias("amount_status")
    return days.select("scope_id", "utc_date", *[c for c in DAILY if c not in ("purchase_amount", "amount_status")], amount, state, "count_allowed", "amount_allowed")


def daily_direct(facts: DataFrame, gates: DataFrame, seen: DataFrame) -> DataFrame:
    """The same days straight from events."""
    held = facts.join(seen.select("scope_id", "user_id", "first_seen_date_utc"), ["scope_id", "user_id"])
    new = F.col("event_date_utc") == F.col("first_seen_date_utc")
    days = held.groupBy("scope_id", F.col("event_date_utc").alias("utc_date")).agg(
        F.countDistinct("user_id").alias("active_users"), F.countDistinct(F.when(_is("purchase"), F.col("user_id"))).alias("buyers"), F.countDistinct(F.when(new, F.col("user_id"))).alias("first_seen_users"),
        F.count("*").alias("event_records"), count_where(_is("purchase")).alias("purchase_events"), count_where(_bad()).alias("purchase_amount_bad"), count_where(F.col("amount_eligible")).alias("purchase_amount_valid"), _known().alias("known"),
    )
    return _finished(days.join(F.broadcast(gates.select("utc_date", "count_allowed", "amount_allowed")), "utc_date"))


def daily_ratios(days: DataFrame) -> DataFrame:
    """buyer_rate, amount_per_buyer and first_seen_ratio, each with its status."""
    u, b = F.col("active_users"), F.col("buyers")
    return days.select(
        "scope_id", "utc_date", *DAILY,
        ratio(b, u).alias("buyer_rate"), ratio_status(u).alias("buyer_rate_status"),
        ratio(F.col("purchase_amount"), b).alias("amount_per_buyer"), F.when(F.col("purchase_amount").isNull(), "amount_unavailable").otherwise(ratio_status(b)).alias("amount_per_buyer_status"),
        ratio(F.col("first_seen_users"), u).alias("first_seen_ratio"), ratio_status(u).alias("first_seen_ratio_status"),
    )


#: The four dimensions: name -> (key column, label column).
DIMENSIONS = {"category_l1": "category_key", "brand_group": "brand_key", "price_band": "price_key", "is_first_seen_day": "seen_key"}


def daily_dim(dimensioned: DataFrame, gates: DataFrame) -> DataFrame:
    """Days by each of four dimensions, in long form, from one pass over the events.

    Users are counted in two steps, user within bucket first, so that no plan expands rows
    for several distinct counts.
    """
    seen = F.when(F.col("is_first_seen_day"), "first_seen:true").otherwise("first_seen:false")
    named = dimensioned.withColumn("seen_key", seen)
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("dim_name"), F.col(k).alias("dim_value_key")) for n, k in DIMENSIONS.items()]))
    long = named.select("scope_id", F.col("event_date_utc").alias("utc_date"), "user_id", "event_type", "amount_eligible", "price_decimal", cells.alias("cell"))
    key = ["scope_id", "utc_date", "dim_name", "dim_value_key"]
    users = long.select("*", "cell.*").groupBy(*key, "user_id").agg(F.count("*").alias("n"), count_where(_is("purchase")).alias("p"), count_where(_bad()).alias("bad"), count_where(F.col("amount_eligible")).alias("valid"), _known().alias("known"))
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    days = users.groupBy(*key).agg(F.count("*").alias("users"), count_where(F.col("p") > 0).alias("buyers"), total("n", "event_records"), total("p", "purchase_events"), total("bad", "bad"), total("valid", "valid"), money(F.sum("known")).alias("known"))
    gated = days.join(F.broadcast(gates.select("utc_date", "amount_allowed")), "utc_date")
    return gated.select(*key, "users", "buyers", "event_records", "purchase_events", F.when(F.col("amount_allowed"), F.col("known")).alias("purchase_amount"), amount_state(F.col("purchase_events"), F.col("bad"), F.col("valid")).alias("amount_status"))


def period_totals(facts: DataFrame) -> DataFrame:
    """Distinct users, buyers and sessions of the whole period: not a sum of days."""
    session = F.when(~F.col("session_missing"), F.struct("user_id", "user_session"))
    return facts.agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(_is("purchase"), F.col("user_id"))).alias("buyers"), F.countDistinct(session).alias("sessions"), F.count("*").alias("events"), _known().alias("amount"))


def unknown_coverage(dims: DataFrame) -> DataFrame:
    return dims.where("dim_value_key = 'bucket:unknown'").groupBy("dim_name").agg(F.sum("event_records").cast("long").alias("event_records"), F.sum("purchase_events").cast("long").alias("purchase_events"), money(F.sum("purchase_amount")).alias("purchase_amount"))


def category_daily(dimensioned: DataFrame, gates: DataFrame) -> DataFrame:
    days = dimensioned.groupBy(F.col("event_date_utc").alias("utc_date"), "category_key").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(_is("purchase"), F.col("user_id"))).alias("buyers"), count_where(_is("purchase")).alias("purchases"), _known().alias("known"))
    return days.join(F.broadcast(gates.where("count_allowed").select("utc_date", "amount_allowed")), "utc_date").select("utc_date", "category_key", "events", "users", "buyers", "purchases", F.when(F.col("amount_allowed"), F.col("known")).alias("amount"))


def daily_minimal(facts: DataFrame, gates: DataFrame) -> DataFrame:
    days = facts.groupBy(F.col("event_date_utc").alias("utc_date")).agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(_is("purchase"), F.col("user_id"))).alias("buyers"), F.count("*").alias("events"), count_where(_is("purchase")).alias("purchases"), _known().alias("known"))
    return days.join(F.broadcast(gates.where("count_allowed").select("utc_date", "amount_allowed")), "utc_date").select("utc_date", "users", "buyers", "events", "purchases", F.when(F.col("amount_allowed"), F.col("known")).alias("amount"))


def category_period_distinct(dimensioned: DataFrame) -> DataFrame:
    """Users and buyers of a category over the whole period, each counted once."""
    users = dimensioned.groupBy("category_key", "user_id").agg(count_where(_is("purchase")).alias("p"), F.count("*").alias("n"), _known().alias("known"))
    return users.groupBy("category_key").agg(F.count("*").alias("users"), count_where(F.col("p") > 0).alias("buyers"), F.sum("n").cast("long").alias("events"), F.sum("p").cast("long").alias("purchases"), money(F.sum("known")).alias("amount"))


def category_day_not_month(dimensioned: DataFrame) -> DataFrame:
    """Whether distinct users stay below user-days, and amounts add up, for each category."""
    days = dimensioned.groupBy("category_key", "event_date_utc").agg(F.countDistinct("user_id").alias("u"), _known().alias("a"))
    summed = days.groupBy("category_key").agg(F.sum("u").cast("long").alias("user_days"), money(F.sum("a")).alias("day_amount"))
    whole = category_period_distinct(dimensioned).select("category_key", "users", "amount")
    return whole.join(summed, "category_key").select("category_key", "users", "user_days", (F.col("users") <= F.col("user_days")).alias("users_ok"), (F.col("amount") == F.col("day_amount")).alias("amount_ok"))


def category_concentration(periods: DataFrame) -> DataFrame:
    """Categories by amount, with share and running share; one row a category, so few."""
    by = Window.orderBy(F.desc("amount"), "category_key")
    whole = F.sum("amount").over(Window.partitionBy())
    running = F.sum("amount").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return periods.select("category_key", "amount", F.row_number().over(by).alias("rank"), ratio(F.col("amount"), whole).alias("share"), ratio(running, whole).alias("cumulative_share"))


def concentration_summary(ranked: DataFrame, dimensioned: DataFrame) -> DataFrame:
    """Shares of the 1, 5 and 10 largest categories and of unknown ones, beside all user-days; one row."""
    part = lambda when: ratio(F.coalesce(F.sum(F.when(when, F.col("amount"))), F.lit(0)), F.sum("amount"))
    tops = ranked.agg(F.count("*").alias("categories"), *[part(F.col("rank") <= k).alias(f"top{k}_share") for k in (1, 5, 10)], part(F.col("category_key") == "bucket:unknown").alias("unknown_share"))
    return tops.crossJoin(dimensioned.agg(F.countDistinct("user_id", "event_date_utc").alias("user_days")))


def hourly_purchase(facts: DataFrame) -> DataFrame:
    bought = facts.where(_is("purchase"))
    return bought.groupBy(F.hour("event_timestamp_utc").alias("hour")).agg(F.count("*").alias("purchases"), F.countDistinct("user_id").alias("users"), _known().alias("amount"))


def hourly_complete(hours: DataFrame) -> DataFrame:
    """All 24 hours with their share of purchases."""
    spine = hours.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    whole = F.sum("purchases").over(Window.partitionBy())
    filled = spine.join(hours, "hour", "left").select("hour", F.coalesce("purchases", F.lit(0)).cast("long").alias("purchases"), F.coalesce("users", F.lit(0)).cast("long").alias("users"), money(F.coalesce("amount", F.lit(0))).alias("amount"))
    return filled.select("*", ratio(F.col("purchases"), whole).alias("share"), ratio_status(whole).alias("status"))


def behavior_coverage(facts: DataFrame) -> DataFrame:
    """Events and users by type, for each day and overall, in one scan: users of a day first, then both sets over these."""
    users = facts.groupBy(F.col("event_date_utc").cast("string").alias("d"), "event_type", "user_id").agg(F.count("*").alias("n"))
    sets = users.groupingSets([["event_type"], ["event_type", "d"]], "event_type", "d").agg(F.grouping("d").alias("all"), F.sum("n").cast("long").alias("events"), F.countDistinct("user_id").alias("users"))
    return sets.select(F.when(F.col("all") == 1, "__all__").otherwise(F.col("d")).alias("day"), "event_type", "events", "users")


def daily_stats(days: DataFrame) -> DataFrame:
    """Smallest, middle and largest value of each metric and the dates of the extremes."""
    names = ["active_users", "buyers", "event_records", "purchase_events"]
    long = days.select(F.col("utc_date").cast("string").alias("d"), *[F.col(n).cast("double") for n in names]).unpivot("d", names, "metric", "v")
    ends = long.groupBy("metric").agg(F.min("v").alias("min"), F.median("v").alias("median"), F.max("v").alias("max"), F.count("*").alias("n"))
    dates = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col("v") == F.col(c), F.col("d")))), ",")
    return long.join(F.broadcast(ends), "metric").groupBy("metric", "min", "median", "max", "n").agg(dates("min").alias("min_dates"), dates("max").alias("max_dates"))


def period_daily_means(days: DataFrame, month: Column) -> DataFrame:
    """Month totals, mean of a day and share by category; months have as many days as are observed."""
    observed = days.select(month.alias("month"), "utc_date").distinct().groupBy("month").agg(F.count("*").alias("days"))
    total = days.groupBy(month.alias("month"), "category_key").agg(F.sum("events").cast("long").alias("events"), F.sum("purchases").cast("long").alias("purchases"))
    whole = F.sum("events").over(Window.partitionBy("month"))
    return total.join(F.broadcast(observed), "month").select("month", "category_key", "events", "purchases", ratio(F.col("events"), F.col("days")).alias("events_per_day"), ratio(F.col("events"), whole).alias("event_share"))


def category_known_coverage(dims: DataFrame) -> DataFrame:
    """Share of events, purchases and amount whose category is known, by date; of the amount only where all of it may be summed."""
    held = dims.where("dim_name = 'category_l1'")
    unknown = F.col("dim_value_key") == "bucket:unknown"
    known = lambda c: 1 - F.try_divide(F.coalesce(F.sum(F.when(unknown, F.col(c))), F.lit(0)).cast("double"), F.sum(c).cast("double"))
    return held.groupBy("utc_date").agg(F.round(known("event_records"), 6).alias("events_known"), F.round(F.when(F.sum("purchase_events") > 0, known("purchase_events")), 6).alias("purchases_known"), F.round(F.when(F.bool_and(F.col("purchase_amount").isNotNull()) & (F.sum("purchase_amount") > 0), known("purchase_amount")), 6).alias("amount_known"))
