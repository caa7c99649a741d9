"""Which dates may be used for counts and for amounts, and reads that hold to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import amount_state, count_where, money
from .profile import calendar


def date_gates(facts: DataFrame, first: str, last: str, core: tuple[str, ...] = ("user_id_missing", "user_id_invalid"), warn: tuple[str, ...] = ("session_missing",)) -> DataFrame:
    """For each date of the calendar: count_allowed, amount_allowed, status, reason_codes (JSON).

    A date without records is blocked, never zero.  Core flags or ineligible events block it;
    purchases without a valid amount block the amount alone; `warn` flags only show.
    """
    flags = [*core, *warn]
    day = facts.groupBy(F.col("event_date_utc").alias("utc_date")).agg(
        F.count("*").alias("n"), *[count_where(F.col(f)).alias(f) for f in flags], count_where(~F.col("event_eligible")).alias("ineligible"),
        count_where(F.col("event_type") == "purchase").alias("purchases"), count_where(F.col("amount_eligible")).alias("paid"),
    )
    joined = calendar(facts.sparkSession, first, last, "utc_date").join(day, "utc_date", "left")
    unseen = F.col("n").isNull()
    counted = F.array_compact(F.array(F.when(unseen, "date_not_observed"), *[F.when(F.col(f) > 0, f"core_{f}") for f in core], F.when(F.col("ineligible") > 0, "ineligible_events")))
    partial = F.array_compact(F.array(F.when(F.col("purchases") != F.col("paid"), "purchase_amount_incomplete")))
    warned = F.greatest(*[F.coalesce(F.col(f), F.lit(0)) for f in warn], F.lit(0)) > 0
    out = joined.select("utc_date", counted.alias("c"), partial.alias("a"), warned.alias("w"))
    may_count, may_sum = F.size("c") == 0, (F.size("c") == 0) & (F.size("a") == 0)
    status = F.when(~may_count, "blocked").when(~may_sum, "count_only").when(F.col("w"), "allowed_with_warnings").otherwise("allowed")
    return out.select("utc_date", may_count.alias("count_allowed"), may_sum.alias("amount_allowed"), status.alias("status"), F.to_json(F.concat("c", "a")).alias("reason_codes"))


#: Flags that block a date, flags that only warn, and flags that spoil a price.
CORE = ("time_missing", "time_invalid", "user_id_missing", "user_id_invalid", "event_type_unknown")
WARNINGS = ("brand_missing", "category_code_missing", "category_id_invalid", "category_id_missing", "product_id_invalid", "product_id_missing", "session_missing")
PRICE_BAD = ("price_missing", "price_invalid", "price_nonfinite", "price_negative", "price_precision_exceeded", "price_scale_exceeded")


def gate_report(parsed: DataFrame, first: str, last: str, evidence_ok: bool = True) -> DataFrame:
    """date_gates over parsed events with all flags: also counts, the amount's state, warnings, and what blocks a whole batch.

    A batch is blocked on all its dates by evidence that does not hold, by records outside the
    calendar or without a date, and by a time that is missing or invalid.  reason_codes is a
    sorted JSON list, warnings a JSON object of counts by name, both empty where there is nothing.
    """
    bought, zero = F.col("event_type") == "purchase", F.col("price_zero")
    bad_price = reduce(Column.__or__, [F.col(f) for f in PRICE_BAD])
    kinds = ("cart", "purchase", "remove_from_cart", "view")
    inside = F.col("event_date_utc").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
    day = parsed.where(inside).groupBy(F.col("event_date_utc").alias("utc_date")).agg(
        F.count("*").alias("n"), count_where(F.col("event_eligible")).alias("eligible"), *[count_where(F.col(f)).alias(f) for f in (*CORE, *WARNINGS)],
        *[count_where(zero & (F.col("event_type") == k)).alias(f"zero_price_{k}") for k in kinds], count_where(bought).alias("purchases"),
        count_where(bought & F.col("event_eligible")).alias("bought"), count_where(F.col("amount_eligible")).alias("paid"), count_where(bought & bad_price).alias("bad_paid"), F.bool_or(bad_price).alias("bad_price"),
    )
    whole = parsed.agg((~F.lit(evidence_ok)).alias("evidence"), (count_where(~F.coalesce(inside, F.lit(False))) > 0).alias("outside"), (count_where(F.col("time_missing") | F.col("time_invalid")) > 0).alias("untimed"))
    told = calendar(parsed.sparkSession, first, last, "utc_date").join(day, "utc_date", "left").crossJoin(F.broadcast(whole))
    unseen, n = F.col("n").isNull(), lambda c: F.coalesce(c, F.lit(0).cast("long"))
    batch = [F.when(F.col("evidence"), "invalid_batch_evidence"), F.when(F.col("outside"), "unassigned_or_outside_date"), F.when(F.col("untimed"), "batch_time_unassignable")]
    own = [F.when(unseen, "date_not_observed"), *[F.when(F.col(f) > 0, f"core_{f}") for f in CORE], F.when(F.col("eligible") != F.col("n"), "ineligible_events")]
    blocked = F.array_compact(F.array(*batch, *own))
    partial = F.array_compact(F.array(F.when((F.col("purchases") != F.col("paid")) | (F.col("bad_paid") > 0), "purchase_amount_incomplete")))
    named = [(f, F.when(F.col(f) > 0, F.col(f).cast("string"))) for f in (*WARNINGS, *(f"zero_price_{k}" for k in kinds))]
    named = sorted([*named, ("nonpurchase_price_quality", F.when(F.col("bad_price") & (F.col("bad_paid") == 0), "present"))], key=lambda x: x[0])
    warned = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in named]), lambda x: x["value"].isNotNull())
    out = told.select("*", blocked.alias("c"), partial.alias("a"), warned.alias("w"))
    may_count, may_sum = F.size("c") == 0, (F.size("c") == 0) & (F.size("a") == 0)
    status = F.when(~may_count, "blocked").when(~may_sum, "count_only").when(F.size("w") > 0, "allowed_with_warnings").otherwise("allowed")
    return out.select(
        "utc_date", may_count.alias("count_allowed"), may_sum.alias("amount_allowed"), status.alias("status"), F.to_json(F.array_sort(F.concat("c", "a"))).alias("reason_codes"), F.to_json(F.map_from_entries("w")).alias("warnings"),
        n(F.col("n")).alias("record_count"), n(F.col("eligible")).alias("event_eligible_records"), n(F.col("n") - F.col("eligible")).alias("core_ineligible_records"),
        F.when(unseen, "not_observed").otherwise(amount_state(F.col("bought"), F.col("bought") - F.col("paid"), F.col("paid"))).alias("amount_status"),
    )


def batch_time(parsed: DataFrame) -> DataFrame:
    """Days with the number of records of the batch that belong to no day: one such record blocks them all."""
    whole = parsed.agg(count_where(F.col("event_timestamp_utc").isNull()).alias("unassigned"))
    days = parsed.where("event_timestamp_utc is not null").groupBy(F.col("event_date_utc").alias("utc_date")).agg(F.count("*").alias("n"))
    return days.crossJoin(F.broadcast(whole)).withColumn("batch_allowed", F.col("unassigned") == 0)


def _permitted(gates: DataFrame, purpose: str, first: str, last: str) -> DataFrame:
    return gates.where(F.col(f"{purpose}_allowed") & F.col("utc_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def gated_read(facts: DataFrame, gates: DataFrame, purpose: str, first: str, last: str, strict: bool = False) -> DataFrame:
    """Records of the permitted dates asked for; with strict, any blocked date among them is an error."""
    permitted = _permitted(gates, purpose, first, last)
    if strict:
        asked = gates.where(F.col("utc_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
        blocked = [str(r.utc_date) for r in asked.join(permitted, "utc_date", "left_anti").orderBy("utc_date").limit(10).collect()]
        if blocked:
            raise ValueError(f"dates not permitted for {purpose}: {', '.join(blocked)}")
    wanted = facts.where(F.col("event_date_utc").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    return wanted.join(F.broadcast(permitted.select(F.col("utc_date").alias("event_date_utc"))), "event_date_utc", "left_semi")


def gated_amount(facts: DataFrame, gates: DataFrame) -> DataFrame:
    """Daily amount, null where the gate forbids it."""
    known = money(F.coalesce(F.sum(F.when(F.col("amount_eligible"), F.col("price_decimal"))), F.lit(0))).alias("known")
    days = facts.groupBy(F.col("event_date_utc").alias("utc_date")).agg(known)
    return days.join(F.broadcast(gates), "utc_date").select("utc_date", F.when(F.col("amount_allowed"), F.col("known")).alias("amount"), "amount_allowed")


def provenance(facts: DataFrame, scope: str) -> DataFrame:
    wrong = ~F.col("scope_id").eqNullSafe(F.lit(scope))
    return facts.groupBy(F.col("event_date_utc").alias("utc_date")).agg(F.count("*").alias("records"), count_where(F.col("event_eligible")).alias("eligible"), count_where(F.col("amount_eligible")).alias("amount_eligible"), count_where(wrong).alias("wrong_lineage"))


def overlaps(batches: DataFrame) -> DataFrame:
    """Pairs of registered batches (batch, lo, hi) and whether their dates overlap; batches are few."""
    other = batches.toDF("other", "other_lo", "other_hi")
    return batches.join(other, F.col("batch") < F.col("other")).select("batch", "other", ((F.col("lo") <= F.col("other_hi")) & (F.col("other_lo") <= F.col("hi"))).alias("dates_overlap"))


def batch_days(records: DataFrame, definition: list[str], content: list[str]) -> DataFrame:
    """For each series, batch and day: its definition, the number of its records, and their signature as a multiset.

    records: series, batch, day, the columns of the definition (constant in a batch) and of the content.
    Signatures are sums of two hashes of the content, so order, layout and retries don't matter.
    """
    columns = [x for c in content for x in (F.col(c), F.col(c).isNull())]
    exact = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")).cast("string")
    told = records.groupBy("series", "batch", "day").agg(F.min(F.to_json(F.struct(*definition))).alias("definition"), F.count("*").alias("n"), exact(1).alias("s1"), exact(2).alias("s2"))
    return told.select("series", "batch", "day", "definition", "n", F.concat_ws(":", F.col("n").cast("string"), "s1", "s2").alias("signature"))


def batch_conflicts(days: DataFrame) -> DataFrame:
    """Pairs of a series' batches that can't stand side by side, from batch_days (a row a batch and day).

    same_content: all records of both are the same, whatever their days are called; redefined: the
    series means another thing in the other batch; shared_days: days that both have, equal_days: those with
    the same records.  Pairs come from joins on what is shared, never from all pairs.
    """
    exact = lambda c: F.sum(F.split_part("signature", F.lit(":"), F.lit(c)).cast("decimal(38,0)")).cast("string")
    whole = days.groupBy("series", "batch").agg(F.min("definition").alias("definition"), F.concat_ws(":", exact(1), exact(2), exact(3)).alias("content"))
    a, b = days.alias("a"), days.alias("b")
    shared = a.join(b, (F.col("a.series") == F.col("b.series")) & (F.col("a.day") == F.col("b.day")) & (F.col("a.batch") < F.col("b.batch")))
    shared = shared.groupBy(F.col("a.series").alias("series"), F.col("a.batch").alias("batch"), F.col("b.batch").alias("other")).agg(F.count("*").alias("shared_days"), count_where(F.col("a.signature") == F.col("b.signature")).alias("equal_days"))
    x, y = whole.alias("x"), whole.alias("y")
    pair = [F.col("x.series").alias("series"), F.col("x.batch").alias("batch"), F.col("y.batch").alias("other")]
    twice = x.join(y, (F.col("x.series") == F.col("y.series")) & (F.col("x.content") == F.col("y.content")) & (F.col("x.batch") < F.col("y.batch"))).select(*pair, F.lit(True).alias("same_content"))
    # The first definition of a series is its own; batches that depart from it are few or an error in themselves.
    first = whole.groupBy("series").agg(F.min_by("definition", "batch").alias("declared"), F.min("batch").alias("batch"))
    departs = whole.select("series", F.col("batch").alias("other"), "definition").join(first, "series").where(F.col("definition") != F.col("declared")).select("series", "batch", "other", F.lit(True).alias("redefined"))
    keys = ["series", "batch", "other"]
    out = shared.join(twice, keys, "full_outer").join(departs, keys, "full_outer")
    no, zero = F.lit(False), F.lit(0).cast("long")
    out = out.select(*keys, F.coalesce("same_content", no).alias("same_content"), F.coalesce("redefined", no).alias("redefined"), F.coalesce("shared_days", zero).alias("shared_days"), F.coalesce("equal_days", zero).alias("equal_days"))
    return out.withColumn("status", F.when(F.col("redefined"), "series_definition_conflict").when(F.col("same_content"), "same_content").otherwise("date_overlap"))


def history_readiness(gates: DataFrame, first: str, last: str, offsets: tuple[int, ...] = (7, 14, 21, 28), least: int = 3) -> DataFrame:
    """For each purpose and date of the window: which of the dates some weeks before may be used, and why others may not.

    gates: the dates that were looked at, with count_allowed and amount_allowed; amounts need both.  A date that is
    outside the window, was not looked at, or is blocked gives its reason, in the order of the offsets.
    """
    purposes = F.array(F.struct(F.lit("count").alias("purpose"), F.col("count_allowed").alias("usable")), F.struct(F.lit("amount").alias("purpose"), (F.col("count_allowed") & F.col("amount_allowed")).alias("usable")))
    told = gates.select("utc_date", F.explode(purposes).alias("p")).select("utc_date", "p.*")
    dates = calendar(gates.sparkSession, first, last, "utc_date").select("utc_date", F.explode(F.array(F.lit("count"), F.lit("amount"))).alias("purpose"))
    asked = dates.select("*", F.posexplode(F.array(*map(F.lit, (0, *offsets)))).alias("nth", "days")).withColumn("then", F.expr("date_sub(utc_date, days)"))
    found = asked.join(told.withColumnsRenamed({"utc_date": "then"}), ["then", "purpose"], "left")
    text = F.col("then").cast("string")
    why = F.when(F.coalesce("usable", F.lit(False)), F.lit(None)).when(~F.col("then").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))), F.concat(F.lit("outside_observation:"), text)).when(F.col("usable").isNull(), F.concat(F.lit("missing_date:"), text)).otherwise(F.concat(F.lit("quality_blocked:"), text))
    got = found.groupBy("utc_date", "purpose").agg(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("usable", F.lit(False)).alias("usable"), text.alias("then"), why.alias("why")))).alias("all"))
    past = F.slice("all", 2, len(offsets))
    used = F.transform(F.filter(past, lambda x: x["usable"]), lambda x: x["then"])
    reasons = F.transform(F.filter(past, lambda x: ~x["usable"]), lambda x: x["why"])
    now = F.col("all")[0]["usable"]
    every = F.concat(reasons, F.when(now, F.array().cast("array<string>")).otherwise(F.array(F.lit("current_date_missing_or_blocked"))))
    n = F.size(used).cast("long")
    status = F.when(~now, "current_date_unavailable").when(n >= least, "history_available_not_evaluated").otherwise("insufficient_history")
    return got.select("utc_date", "purpose", F.array_join(used, ",").alias("history_dates"), n.alias("history_count"), (n >= least).alias("meets_min3"), (n == len(offsets)).alias("meets_full4"), status.alias("status"), F.when(F.size(every) > 0, F.array_join(every, ";")).otherwise("history_quantity_only").alias("reason"))
