"""Screening of daily amounts, decomposition of a change, and its attribution to dimensions.

All of it takes `by`, the columns of a series, so one plan screens many series at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import money, ratio

OFFSETS = (7, 14, 21, 28)
#: Median absolute deviations to standard deviations, and the two thresholds.
MAD_SCALE, SCORE_ABOVE, RELATIVE_FROM = 1.4826, 3.0, 0.10


def usable() -> Column:
    return F.col("count_allowed") & F.col("amount_allowed") & F.col("purchase_amount").isNotNull()


def history(days: DataFrame, calendar: DataFrame, by: list[str], offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """For each series and calendar date the dates some weeks before, with state and amount.

    state: outside (before the calendar), missing, blocked or usable.
    """
    ends = calendar.agg(F.min("utc_date").alias("lo"))
    series = days.select(*by).distinct() if by else None
    spine = calendar.select("utc_date") if series is None else series.crossJoin(F.broadcast(calendar.select("utc_date")))
    asked = spine.crossJoin(F.broadcast(ends)).withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("then", F.expr("date_sub(utc_date, offset)"))
    told = days.select(*by, F.col("utc_date").alias("then"), usable().alias("ok"), F.col("purchase_amount").alias("then_amount"))
    joined = asked.join(told, [*by, "then"], "left")
    state = F.when(F.col("then") < F.col("lo"), "outside").when(F.col("ok").isNull(), "missing").when(~F.col("ok"), "blocked").otherwise("usable")
    return joined.select(*by, "utc_date", "then", state.alias("state"), F.when(F.col("ok"), F.col("then_amount")).alias("then_amount"))


def screen(days: DataFrame, calendar: DataFrame, by: list[str] | None = None, least: int = 3) -> DataFrame:
    """Score of each date against the same weekday before: median, MAD, status, candidate."""
    by = by or []
    seen = history(days, calendar, by)
    key = [*by, "utc_date"]
    got = F.col("state") == "usable"
    reason = F.when(F.col("state") == "outside", "outside_observation:").when(F.col("state") == "missing", "missing_date:").otherwise("quality_blocked:")
    told = F.when(~got, F.struct(F.col("then").alias("d"), F.concat(reason, F.col("then").cast("string")).alias("r")))
    center = seen.groupBy(*key).agg(
        F.count_if(got).alias("history_count"), F.median(F.when(got, F.col("then_amount").cast("double"))).alias("median_amount"), F.min(F.when(got, F.col("then_amount"))).alias("least_amount"),
        F.count_if(F.col("state").isin("missing", "blocked")).alias("gaps"), F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(told))), lambda x: x["r"]), ";").alias("reason"),
    )
    spread = seen.where(got).join(center.select(*key, "median_amount"), key).groupBy(*key).agg(F.median(F.abs(F.col("then_amount").cast("double") - F.col("median_amount"))).alias("mad"))
    now = days.select(*key, usable().alias("now_ok"), F.col("purchase_amount").alias("current_amount"))
    all_ = center.join(spread, key, "left").join(now, key, "left")
    v, m = F.col("current_amount").cast("double"), F.col("median_amount")
    enough = F.col("history_count") >= least
    status = (
        F.when(F.col("now_ok").isNull(), "current_date_missing").when(~F.col("now_ok"), "current_quality_blocked")
        .when(~enough, F.when(F.col("gaps") > 0, "insufficient_history_with_gaps").otherwise("insufficient_history"))
        .when((v < 0) | (F.col("least_amount") < 0), "negative_amount_invalid").when(m <= 0, "zero_baseline").when(F.col("mad") == 0, "zero_scale")
        .when(F.col("gaps") > 0, "evaluated_with_history_gaps").otherwise("evaluated")
    )
    out = all_.withColumn("status", status)
    scored = F.col("status").startswith("evaluated")
    score, rel = F.try_divide(v - m, F.col("mad") * MAD_SCALE), F.try_divide(v - m, m)
    shown = F.col("now_ok") & enough
    comparable = scored | (F.col("status") == "zero_scale")
    out = out.withColumns({"comparable": comparable, "score": F.when(scored, score), "relative_change": F.when(comparable, rel), "amount_difference": F.when(shown, v - m)})
    candidate = F.coalesce(scored & (F.abs("score") > SCORE_ABOVE) & (F.abs("relative_change") >= RELATIVE_FROM), F.lit(False))
    return out.select(*key, "status", "history_count", "reason", "current_amount", F.round(F.when(shown, m), 4).alias("median_amount"), F.round(F.when(shown, F.col("mad")), 4).alias("mad"), F.round("score", 6).alias("score"), F.round("relative_change", 6).alias("relative_change"), F.round("amount_difference", 4).alias("amount_difference"), "comparable", candidate.alias("candidate"))


def select_case(flags: DataFrame) -> DataFrame:
    """The date to look into: the largest downward candidate, else any candidate, else any comparable date."""
    down = F.col("candidate") & (F.col("amount_difference") < 0)
    kind = F.when(down, 0).when(F.col("candidate"), 1).when(F.col("comparable"), 2)
    name = F.when(F.col("kind") == 0, "downward_candidate").when(F.col("kind") == 1, "other_candidate").otherwise("descriptive_not_candidate")
    return flags.withColumn("kind", kind).where("kind is not null").orderBy("kind", F.desc(F.abs("amount_difference")), "utc_date").limit(1).select("utc_date", "amount_difference", name.alias("selection"))


def _roles(days: DataFrame, day: str, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """Usable rows of the day (role now) and of its history (role then)."""
    date = F.to_date(F.lit(day))
    gap = F.datediff(date, F.col("utc_date"))
    role = F.when(gap == 0, "now").when(gap.isin(*offsets), "then")
    return days.where(usable()).withColumn("role", role).where("role is not null")


def decompose(days: DataFrame, day: str) -> DataFrame:
    """V = U * R * M: users, buyers per user, amount per buyer; log contributions of each factor."""
    held = _roles(days, day)
    m = lambda c, role: F.avg(F.when(F.col("role") == role, F.col(c).cast("double")))
    one = held.agg(*[m(c, r).alias(f"{n}_{r}") for n, c in (("U", "active_users"), ("B", "buyers"), ("V", "purchase_amount")) for r in ("now", "then")])
    one = one.withColumns({f"{n}_{r}": F.try_divide(F.col(f"{a}_{r}"), F.col(f"{b}_{r}")) for n, a, b in (("R", "B", "U"), ("M", "V", "B")) for r in ("now", "then")})
    total = F.ln(F.try_divide(F.col("V_now"), F.col("V_then")))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"{n}_now").alias("current"), F.col(f"{n}_then").alias("history_mean")) for n in "UBRMV"]))
    long = one.select(total.alias("total"), rows.alias("x")).select("total", "x.*")
    log = F.ln(F.try_divide(F.col("current"), F.col("history_mean")))
    share = F.when(F.col("factor").isin("U", "R", "M") & (F.abs("total") > 1e-10), F.try_divide(log, F.col("total")))
    return long.select("factor", F.round("current", 6).alias("current"), F.round("history_mean", 6).alias("history_mean"), F.round(log, 6).alias("log_change"), F.round(share, 6).alias("log_share"))


def attribute(dims: DataFrame, day: str) -> DataFrame:
    """Each bucket's part in the change of the day against the daily mean of its history.

    dims: utc_date, dim_name, dim_value_key, purchase_amount of usable dates.  An absent bucket
    is zero, since every dimension holds all of a day.  Contributions are null where the total
    hardly changes; ranks and running shares are within a direction.
    """
    date = F.to_date(F.lit(day))
    gap = F.datediff(date, F.col("utc_date"))
    held = dims.where(F.col("purchase_amount").isNotNull()).where(gap.isin(0, *OFFSETS))
    n = held.agg(F.countDistinct(F.when(gap > 0, F.col("utc_date"))).alias("history_days"))
    s = lambda when: money(F.coalesce(F.sum(F.when(when, F.col("purchase_amount"))), F.lit(0)))
    cells = held.groupBy("dim_name", "dim_value_key").agg(s(gap == 0).alias("current_amount"), s(gap > 0).alias("history_sum")).crossJoin(F.broadcast(n))
    a, b = F.col("a"), F.col("b")
    cells = cells.withColumns({"a": F.col("current_amount").cast("double"), "b": F.try_divide(F.col("history_sum").cast("double"), F.col("history_days"))})
    dim = Window.partitionBy("dim_name")
    cells = cells.withColumns({"ta": F.sum("a").over(dim), "tb": F.sum("b").over(dim), "change": a - b}).withColumn("delta", F.col("ta") - F.col("tb"))
    near = F.abs("delta") <= 1e-10 * F.greatest(F.abs("ta"), F.abs("tb"), F.lit(1.0))
    flat = F.abs("change") <= 1e-9
    direction = F.when(near & ~flat, "total_near_zero").when(flat, "unchanged").when(F.col("change") * F.col("delta") > 0, "same_direction").otherwise("offsetting")
    p, q = F.try_divide(a, F.col("ta")), F.try_divide(b, F.col("tb"))
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    js = F.when((F.col("ta") > 0) & (F.col("tb") > 0), 0.5 * (half(p, q) + half(q, p)))
    cells = cells.withColumns({"direction": direction, "js_component": js})
    way = Window.partitionBy("dim_name", "direction").orderBy(F.desc(F.round(F.abs("change"), 6)), "dim_value_key")
    ranked = F.col("direction").isin("same_direction", "offsetting")
    running = F.try_divide(F.sum(F.abs("change")).over(way.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.sum(F.abs("change")).over(Window.partitionBy("dim_name", "direction")))
    return cells.select(
        "dim_name", "dim_value_key", "current_amount", F.round("b", 6).alias("history_mean"), F.round("change", 6).alias("amount_difference"), F.round(F.when(~near, F.try_divide(F.col("change"), F.col("delta"))), 6).alias("signed_contribution"),
        "direction", F.when(ranked, F.row_number().over(way)).alias("direction_rank"), F.round(F.when(F.col("direction") == "same_direction", running), 6).alias("cumulative_share"), F.round("js_component", 9).alias("js_component"),
    )


def js_divergence(attributed: DataFrame) -> DataFrame:
    return attributed.groupBy("dim_name").agg(F.round(F.sum("js_component"), 6).alias("js_divergence"), F.when(F.count("js_component") == 0, "zero_distribution").otherwise("defined").alias("js_status"))


def attribute_summary(attributed: DataFrame, part: float = 0.67) -> DataFrame:
    """Totals of both directions and the number of buckets that make `part` of the change."""
    d = lambda name: F.coalesce(F.sum(F.when(F.col("direction") == name, F.abs("amount_difference"))), F.lit(0.0))
    hit = F.min(F.when(F.col("cumulative_share") >= part, F.col("direction_rank")))
    return attributed.groupBy("dim_name").agg(money(F.sum("current_amount")).alias("current_total"), F.round(F.sum("history_mean"), 4).alias("history_total"), F.round(d("same_direction"), 4).alias("same_direction"), F.round(d("offsetting"), 4).alias("offsetting"), hit.alias("buckets_to_part"))


def case_coverage(dims: DataFrame, day: str) -> DataFrame:
    """Share of known categories on the day and, pooled, over its history."""
    gap = F.datediff(F.to_date(F.lit(day)), F.col("utc_date"))
    held = dims.where("dim_name = 'category_l1' and purchase_amount is not null").where(gap.isin(0, *OFFSETS)).withColumn("period", F.when(gap == 0, "current").otherwise("history"))
    unknown = F.col("dim_value_key") == "bucket:unknown"
    share = lambda c: F.round(1 - F.try_divide(F.coalesce(F.sum(F.when(unknown, F.col(c))), F.lit(0)).cast("double"), F.sum(c).cast("double")), 6)
    return held.groupBy("period").agg(share("event_records").alias("events_known"), share("purchase_events").alias("purchases_known"), share("purchase_amount").alias("amount_known"))


def compare_categories(category_days: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """Each category's change against its own history, less the change of all together, in points."""
    gap = F.datediff(F.to_date(F.lit(day)), F.col("utc_date"))
    held = category_days.where(F.col("purchase_amount").isNotNull()).where(gap.isin(0, *OFFSETS))
    n = held.agg(F.countDistinct(F.when(gap > 0, F.col("utc_date"))).alias("n"))
    s = lambda when: F.coalesce(F.sum(F.when(when, F.col("purchase_amount"))), F.lit(0)).cast("double")
    own = held.groupBy("category_key").agg(s(gap == 0).alias("now"), s(gap > 0).alias("then"))
    both = own.unionByName(held.groupBy(F.lit("__all__").alias("category_key")).agg(s(gap == 0).alias("now"), s(gap > 0).alias("then"))).crossJoin(F.broadcast(n)).withColumn("mean", F.try_divide(F.col("then"), F.col("n")))
    rel = F.when(F.col("mean") > 0, F.col("now") / F.col("mean") - 1)
    whole = both.where("category_key = '__all__'").select(rel.alias("whole"))
    return both.where("category_key <> '__all__'").crossJoin(F.broadcast(whole)).select("category_key", F.round("mean", 4).alias("history_mean"), F.round(rel, 6).alias("relative_change"), F.round(100 * (rel - F.col("whole")), 4).alias("points_vs_total"), F.when(F.col("mean") > 0, "defined").otherwise("zero_history").alias("status"))


def weekday_filter(days: DataFrame, weekday: int, first: str) -> DataFrame:
    return days.where((F.weekday("utc_date") == weekday) & (F.col("utc_date") >= F.to_date(F.lit(first))))


def sensitivity_exclude_dates(days: DataFrame, calendar: DataFrame, dates: list[str]) -> DataFrame:
    """Screening with given dates blocked, beside screening as it is."""
    out = F.col("utc_date").cast("string").isin(*dates)
    blocked = days.withColumn("amount_allowed", F.col("amount_allowed") & ~out)
    a = screen(days, calendar).select("utc_date", F.col("status").alias("status_all"), F.col("score").alias("score_all"))
    return a.join(screen(blocked, calendar).select("utc_date", F.col("status").alias("status_without"), F.col("score").alias("score_without")), "utc_date")
