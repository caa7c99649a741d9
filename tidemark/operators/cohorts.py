"""Pre/post cohorts and the windows after a first cart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_where, money, ratio


def pre_post(users: DataFrame, pre_start: str, post_start: str, post_end: str, pre_allowed: bool = True, post_allowed: bool = True) -> DataFrame:
    """One row for each user with any record before; what they did after never decides membership.

    users: scope_id, utc_date, user_id, event_records, purchase_events, purchase_amount_bad,
    purchase_amount_valid, purchase_amount.  One aggregation with conditions stands for the join
    of the two periods.  The key hashes length-framed scope and user, so no two pairs share one.
    """
    day = F.col("utc_date")
    held = users.where((day >= F.to_date(F.lit(pre_start))) & (day < F.to_date(F.lit(post_end)))).withColumn("before", day < F.to_date(F.lit(post_start)))
    aggs = []
    for name, when in (("pre", F.col("before")), ("post", ~F.col("before"))):
        total = lambda c, when=when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
        aggs += [
            count_where(when).alias(f"{name}_days"), total("event_records").cast("long").alias(f"{name}_event_records"), total("purchase_events").cast("long").alias(f"{name}_purchase_events"),
            total("purchase_amount_bad").cast("long").alias(f"{name}_bad"), total("purchase_amount_valid").cast("long").alias(f"{name}_valid"),
            count_where(when & F.col("purchase_amount").isNull()).alias(f"{name}_null_days"), money(total("purchase_amount")).alias(f"{name}_known"),
        ]
    wide = held.groupBy("scope_id", "user_id").agg(*aggs).where("pre_days > 0")

    def amount(p: str, allowed: bool) -> Column:
        return F.when(F.lit(allowed) & (F.col(f"{p}_bad") == 0) & (F.col(f"{p}_null_days") == 0), F.col(f"{p}_known"))

    def status(p: str, allowed: bool) -> Column:
        bad = F.when(F.col(f"{p}_valid") > 0, "partial_observed").otherwise("unknown")
        return F.when(F.col(f"{p}_bad") > 0, bad).when(F.lit(not allowed) | (F.col(f"{p}_null_days") > 0), "window_amount_blocked").when(F.col(f"{p}_purchase_events") == 0, "no_purchases").otherwise("complete_observed")

    framed = F.concat(F.lit("cohort-key-v1|"), F.length("scope_id"), F.lit(":"), F.col("scope_id"), F.length("user_id"), F.lit(":"), F.col("user_id"))
    return wide.select(
        F.sha2(framed, 256).alias("cohort_key"), "scope_id", "user_id", "pre_event_records", "pre_purchase_events", amount("pre", pre_allowed).alias("pre_purchase_amount"), status("pre", pre_allowed).alias("pre_amount_status"),
        (F.col("post_days") > 0).cast("int").alias("post_active"), (F.col("post_purchase_events") > 0).cast("int").alias("post_converted"), "post_event_records", "post_purchase_events",
        amount("post", post_allowed).alias("post_purchase_amount"), status("post", post_allowed).alias("post_amount_status"),
    )


def summary(cohort: DataFrame) -> DataFrame:
    """Two rates with different denominators; the amount only if every user's is known."""
    n, back, buyers = F.count("*"), F.sum("post_active").cast("long"), F.sum("post_converted").cast("long")
    known = F.bool_and(F.col("post_purchase_amount").isNotNull())
    return cohort.agg(n.alias("enrolled"), back.alias("returned"), buyers.alias("post_buyers"), ratio(buyers, n).alias("buyers_per_enrolled"), ratio(buyers, back).alias("buyers_per_returned"), F.when(known, money(F.sum("post_purchase_amount"))).alias("post_amount"))


def _window(users: DataFrame, first: str, before: str) -> DataFrame:
    return users.where((F.col("utc_date") >= F.to_date(F.lit(first))) & (F.col("utc_date") < F.to_date(F.lit(before))))


def post_only(users: DataFrame, pre_start: str, post_start: str, post_end: str) -> DataFrame:
    """Users of the later period that the earlier one has not."""
    later = _window(users, post_start, post_end).select("scope_id", "user_id").distinct()
    return later.join(_window(users, pre_start, post_start), ["scope_id", "user_id"], "left_anti")


def membership_check(cohort: DataFrame, users: DataFrame, pre_start: str, post_start: str) -> DataFrame:
    """Members that should not be, and users that should be members: both zero."""
    want = _window(users, pre_start, post_start).select("scope_id", "user_id").distinct()
    got = cohort.select("scope_id", "user_id")
    extra, missing = got.subtract(want).agg(F.count("*").alias("extra")), want.subtract(got).agg(F.count("*").alias("missing"))
    return extra.crossJoin(missing)


def semijoin_reference(cohort: DataFrame, users: DataFrame, post_start: str, post_end: str) -> DataFrame:
    """Totals of the later period for members, found another way."""
    held = _window(users, post_start, post_end).join(cohort, ["scope_id", "user_id"], "left_semi")
    return held.agg(F.countDistinct("user_id").alias("returned"), F.coalesce(F.sum("event_records"), F.lit(0)).cast("long").alias("event_records"), F.coalesce(F.sum("purchase_events"), F.lit(0)).cast("long").alias("purchase_events"))


def user_day_validity(users: DataFrame) -> DataFrame:
    """Violations of what a user-day table promises: all zero."""
    repeated = users.groupBy("scope_id", "utc_date", "user_id").agg(F.count("*").alias("n")).agg(count_where(F.col("n") > 1).alias("repeated_keys"))
    bad = users.agg(count_where(F.col("user_id").isNull() | F.col("utc_date").isNull()).alias("null_keys"), count_where(F.col("purchase_amount_bad") + F.col("purchase_amount_valid") != F.col("purchase_events")).alias("amount_mismatch"), count_where(F.col("amount_allowed") != F.col("purchase_amount").isNotNull()).alias("gate_mismatch"))
    return bad.crossJoin(repeated)


def cart_recovery(facts: DataFrame, complete_from: str, complete_before: str) -> DataFrame:
    """First cart of each user; a purchase within 24 hours excludes, one in the next 24 is the outcome.

    Waiting is closed at both ends, the outcome open on the left and closed on the right.
    Purchases meet their user's anchor by an equi join; the time range is what is left to test.
    """
    anchors = facts.where("event_eligible and event_type = 'cart'").groupBy("scope_id", "user_id").agg(F.min("event_timestamp_utc").alias("t_cart"))
    hours = lambda n: F.col("t_cart") + F.expr(f"INTERVAL {n} HOURS")
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    anchors = anchors.withColumns({"t0": hours(24), "outcome_end": hours(48), "window_complete": (F.col("t_cart") >= stamp(complete_from)) & (F.col("t_cart") < stamp(complete_before))})
    bought = facts.where("event_eligible and event_type = 'purchase'").select("scope_id", "user_id", F.col("event_timestamp_utc").alias("at"), "amount_eligible", "price_decimal")
    joined = anchors.join(bought, ["scope_id", "user_id"], "left")
    inside = F.col("at").between(F.col("t_cart"), F.col("outcome_end"))
    late = inside & (F.col("at") > F.col("t0"))
    counted = joined.groupBy("scope_id", "user_id", "t_cart", "t0", "outcome_end", "window_complete").agg(
        count_where(inside & (F.col("at") <= F.col("t0"))).alias("waiting_purchase_events"), count_where(late).alias("outcome_purchase_events"), count_where(late & ~F.col("amount_eligible")).alias("outcome_bad_amount_events"),
        money(F.coalesce(F.sum(F.when(late & F.col("amount_eligible"), F.col("price_decimal"))), F.lit(0))).alias("known"),
    )
    status = F.when(~F.col("window_complete"), "right_censored").when(F.col("waiting_purchase_events") > 0, "waiting_purchase_excluded").otherwise("eligible")
    counted = counted.withColumn("eligibility_status", status)
    eligible, n, bad = F.col("eligibility_status") == "eligible", F.col("outcome_purchase_events"), F.col("outcome_bad_amount_events")
    return counted.withColumns({
        "purchased_24h": F.when(eligible, (n > 0).cast("int")), "purchase_amount_24h": F.when(eligible & (bad == 0), F.col("known")),
        "amount_status": F.when(~eligible, "not_applicable").when(n == 0, "no_purchases").when(bad == n, "unknown").when(bad > 0, "partial_observed").otherwise("complete_observed"),
    }).drop("known")


def cart_recovery_summary(windows: DataFrame) -> DataFrame:
    is_ = lambda s: count_where(F.col("eligibility_status") == s)
    n, buyers = is_("eligible"), count_where(F.col("purchased_24h") == 1)
    known = money(F.coalesce(F.sum("purchase_amount_24h"), F.lit(0)))
    return windows.agg(F.count("*").alias("cart_users"), is_("right_censored").alias("censored"), is_("waiting_purchase_excluded").alias("waiting_excluded"), n.alias("eligible"), buyers.alias("buyers"), ratio(buyers, n).alias("p_hist"), known.alias("known_amount"), ratio(known, n).alias("amount_per_eligible"))
