"""Time-bounded funnels from the first view of a (user, session, product), and an audit of purchases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import count_where, price_band, ratio, ratio_status

KEY = ["scope_id", "user_id", "user_session", "product_id"]
#: The four classes of a path.
CLASSES = ("view_cart_purchase", "view_purchase_no_confirmed_intermediate_cart", "view_cart_no_observed_purchase", "view_only")
BANDS = ("[0,20)", "[20,50)", "[50,200)", "[200,+inf)", "unknown")


def valid_key() -> Column:
    return F.col("event_eligible") & ~F.col("session_missing") & F.col("product_id").rlike(r"\A[0-9]+\z")


def starts(facts: DataFrame) -> DataFrame:
    return facts.where(valid_key() & (F.col("event_type") == "view")).groupBy(*KEY).agg(F.min("event_timestamp_utc").alias("first_view_time"))


def linked(facts: DataFrame, hours: int = 24) -> DataFrame:
    """Every event with the first view of its key and the deadline; events of no valid key stay."""
    told = starts(facts)
    keyed = facts.withColumn("path_key_valid", valid_key())
    same = reduce(lambda a, b: a & b, [keyed[k] == told[k] for k in KEY], keyed["path_key_valid"])
    joined = keyed.join(told, same, "left").select(keyed["*"], "first_view_time")
    return joined.withColumn("deadline", F.col("first_view_time") + F.expr(f"INTERVAL {hours} HOURS"))


def paths(facts: DataFrame, censored_from: str, hours: int = 24) -> DataFrame:
    """One row for each key with a view: class, order certainty, censoring, first-view price.

    Every step is the earliest cart or the latest purchase after the view and up to the
    deadline, so one aggregation finds whether a cart lies between: no self join.
    """
    t, v = F.col("event_timestamp_utc"), F.col("first_view_time")
    within = t <= F.col("deadline")
    at = lambda kind, after: F.when((F.col("event_type") == kind) & after & within, t)
    first = (F.col("event_type") == "view") & (t == v)
    priced = F.coalesce(F.col("price_decimal") >= 0, F.lit(False))
    steps = linked(facts, hours).where("first_view_time is not null").groupBy(*KEY, "first_view_time", "deadline").agg(
        F.min(at("cart", t > v)).alias("cart"), F.max(at("purchase", t > v)).alias("purchase"), F.min(at("cart", t >= v)).alias("cart_or_tie"), F.max(at("purchase", t >= v)).alias("purchase_or_tie"),
        count_where(first & ~priced).alias("bad_prices"), F.countDistinct(F.when(first & priced, F.col("price_decimal"))).alias("prices"), F.min(F.when(first & priced, F.col("price_decimal"))).alias("price"),
    )

    def classed(cart: str, purchase: str, strict: bool) -> Column:
        between = F.col(cart) < F.col(purchase) if strict else F.col(cart) <= F.col(purchase)
        return F.when(between, CLASSES[0]).when(F.col(purchase).isNotNull(), CLASSES[1]).when(F.col(cart).isNotNull(), CLASSES[2]).otherwise(CLASSES[3])

    status = F.when(F.col("prices") > 1, "conflicting").when((F.col("bad_prices") > 0) | (F.col("prices") != 1), "invalid_or_missing").otherwise("unique_valid")
    named = steps.withColumns({
        "start_date_utc": F.to_date("first_view_time"), "strict_class": classed("cart", "purchase", True), "possible_class": classed("cart_or_tie", "purchase_or_tie", False),
        "first_view_price_status": status, "first_view_price": F.when(status == "unique_valid", F.col("price")), "right_censored": v >= F.lit(censored_from).cast("timestamp_ntz"),
        "has_cart_after_view": F.col("cart").isNotNull(), "has_purchase_after_view": F.col("purchase").isNotNull(),
    })
    uncertain = F.col("strict_class") != F.col("possible_class")
    return named.withColumns({
        "has_three_step": F.col("strict_class") == CLASSES[0], "order_uncertain": uncertain, "price_band": price_band(F.col("first_view_price")),
        "release_status": F.when(F.col("right_censored"), "right_censored").when(uncertain, "order_uncertain").otherwise("formal"),
    }).select(*KEY, "first_view_time", "start_date_utc", "strict_class", "possible_class", "order_uncertain", "right_censored", "release_status", "has_cart_after_view", "has_purchase_after_view", "has_three_step", "first_view_price", "first_view_price_status", "price_band")


def summary(paths_: DataFrame) -> DataFrame:
    """Counts, classes and ratios of formal paths: overall, by start day, by band; absent bands are zeros.

    Paths are scanned once and counted by day and band; all three levels are sets over these counts.
    """
    names = ["n_view", "n_cart", "n_purchase", "n_three_step", *CLASSES]
    aggs = [F.count("*").alias("n_view"), count_where(F.col("has_cart_after_view")).alias("n_cart"), count_where(F.col("has_purchase_after_view")).alias("n_purchase"), count_where(F.col("has_three_step")).alias("n_three_step")]
    aggs += [count_where(F.col("strict_class") == c).alias(c) for c in CLASSES]
    cells = paths_.where("release_status = 'formal'").groupBy(F.col("start_date_utc").cast("string").alias("day"), F.col("price_band").alias("band")).agg(*aggs)
    sets = cells.groupingSets([[], ["day"], ["band"]], "day", "band").agg(F.grouping("day").alias("no_day"), F.grouping("band").alias("no_band"), *[F.sum(n).alias(n) for n in names])
    level = F.when(F.col("no_day") == 0, "start_day").when(F.col("no_band") == 0, "price_band").otherwise("overall")
    segment = F.when(F.col("no_day") == 0, F.col("day")).when(F.col("no_band") == 0, F.col("band")).otherwise("all")
    told = sets.select(level.alias("level"), segment.alias("segment"), *names)
    spine = paths_.sparkSession.createDataFrame([("overall", "all"), *[("price_band", b) for b in BANDS]], "level string, segment string")
    whole = spine.join(told, ["level", "segment"], "full_outer").select("level", "segment", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    n = F.col
    return whole.withColumns({
        "view_to_cart": ratio(n("n_cart"), n("n_view")), "cart_to_purchase_three_step": ratio(n("n_three_step"), n("n_cart")), "view_to_purchase": ratio(n("n_purchase"), n("n_view")),
        "three_step_ratio": ratio(n("n_three_step"), n("n_view")), "view_denominator_status": ratio_status(n("n_view")), "cart_denominator_status": ratio_status(n("n_cart")),
    })


def exclusions(facts: DataFrame, paths_: DataFrame, hours: int = 24) -> DataFrame:
    """Long form (part, value, n, denominator, ratio, ratio_status) of what is left out, and why.

    release: states of paths; flag: reasons that may hold together; price: states of the first
    view's price; key: the first reason why an event has no path; key_flag: reasons that may hold
    together; view: events of a valid key that has no view.
    """
    whole = paths_.agg(F.count("*").alias("denominator"))
    of_paths = lambda df: df.crossJoin(F.broadcast(whole))
    states = paths_.groupBy("release_status", "first_view_price_status", "order_uncertain", "right_censored").agg(F.count("*").alias("n"))  # a few rows
    by = lambda part, column: states.groupBy(F.lit(part).alias("part"), F.col(column).alias("value")).agg(F.sum("n").alias("n"))
    flags = states.agg(*[F.coalesce(F.sum(F.when(F.col(f), F.col("n"))), F.lit(0)).alias(f) for f in ("order_uncertain", "right_censored")])
    flags = flags.unpivot([], ["order_uncertain", "right_censored"], "value", "n").select(F.lit("flag").alias("part"), "value", "n")
    named = of_paths(by("release", "release_status").unionByName(by("price", "first_view_price_status")).unionByName(flags))

    user, product = ~F.col("event_eligible"), ~valid_key() & F.col("event_eligible") & ~F.col("session_missing")
    reason = F.when(user, "user_id").when(F.col("session_missing"), "session").when(product, "product_id").otherwise("valid")
    keys = linked(facts, hours).agg(
        F.count("*").alias("denominator"), *[count_where(reason == r).alias(f"key:{r}") for r in ("user_id", "session", "product_id", "valid")], count_where(user).alias("key_flag:user_id"), count_where(F.col("session_missing")).alias("key_flag:session"),
        count_where(F.col("path_key_valid") & F.col("first_view_time").isNull()).alias("view:valid_key_without_view"),
    )
    parts = [c for c in keys.columns if ":" in c]
    long = keys.select("denominator", F.explode(F.array(*[F.struct(F.lit(c.split(":")[0]).alias("part"), F.lit(c.split(":")[1]).alias("value"), F.col(f"`{c}`").alias("n")) for c in parts])).alias("x")).select("x.*", "denominator")
    both = named.unionByName(long)
    return both.select("part", "value", "n", "denominator", ratio(F.col("n"), F.col("denominator")).alias("ratio"), ratio_status(F.col("denominator")).alias("ratio_status"))


def purchase_audit(facts: DataFrame, formal_from: str, formal_before: str, hours: int = 24) -> DataFrame:
    """Every purchase in the first reason that holds of six, by day and in all."""
    t, v = F.col("event_timestamp_utc"), F.col("first_view_time")
    outside = ~((v >= F.lit(formal_from).cast("timestamp_ntz")) & (v < F.lit(formal_before).cast("timestamp_ntz")))
    reason = (
        F.when(~F.col("path_key_valid"), "invalid_path_key").when(v.isNull(), "no_view_same_key").when(t <= v, "purchase_at_or_before_first_view")
        .when(outside, "start_outside_formal_range").when(t > F.col("deadline"), "beyond_24_hours").otherwise("within_path_window")
    )
    bought = linked(facts, hours).where("event_type = 'purchase'").select(F.col("event_date_utc").cast("string").alias("day"), reason.alias("reason"))
    by_day = bought.groupBy("day", "reason").agg(F.count("*").alias("n"))
    sets = by_day.groupingSets([["reason"], ["reason", "day"]], "reason", "day").agg(F.grouping("day").alias("all"), F.sum("n").cast("long").alias("n"))
    return sets.select(F.when(F.col("all") == 1, "__all__").otherwise(F.col("day")).alias("day"), "reason", "n")


def invariants(paths_: DataFrame) -> DataFrame:
    """Numbers of paths that break what must hold; all zero where nothing is wrong."""
    three, cart, formal = F.col("has_three_step"), F.col("has_cart_after_view"), F.col("release_status") == "formal"
    return paths_.agg(
        count_where(three & ~cart).alias("three_step_without_cart"), count_where(three & ~F.col("has_purchase_after_view")).alias("three_step_without_purchase"),
        count_where(~F.coalesce(F.col("strict_class").isin(*CLASSES), F.lit(False))).alias("unknown_class"), (F.count("*") - F.countDistinct(*KEY)).alias("repeated_keys"),
        count_where(F.col("first_view_price").isNull() & (F.col("price_band") != "unknown")).alias("band_without_price"),
        count_where(three != (F.col("strict_class") == CLASSES[0])).alias("class_against_steps"), count_where(formal & (F.col("order_uncertain") | F.col("right_censored"))).alias("formal_without_order"),
        count_where(F.col("start_date_utc") != F.to_date("first_view_time")).alias("day_against_time"), count_where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in KEY])).alias("null_keys"),
    )


def conservation(summary_: DataFrame) -> DataFrame:
    """For each level and count of a summary: its sum over the segments against the overall count; and classes against views.

    column class_sum: views less the sum of all classes, and 0; bounds: segments in which steps exceed what comes before them.
    """
    names = ["n_view", "n_cart", "n_purchase", "n_three_step", *CLASSES]
    spread = F.col("n_view") - sum((F.col(c) for c in CLASSES), F.lit(0))
    bad = (F.col("n_three_step") > F.least("n_cart", "n_purchase")) | (F.greatest("n_cart", "n_purchase") > F.col("n_view"))
    sums = summary_.groupBy("level").agg(*[F.sum(n).alias(n) for n in names], F.sum(F.abs(spread)).alias("class_sum"), count_where(bad).alias("bounds"))
    columns = [*names, "class_sum", "bounds"]
    long = sums.select("level", *[F.col(c).cast("long") for c in columns]).unpivot("level", columns, "column", "total")
    # Three rows a column at most.
    overall = F.max(F.when(F.col("level") == "overall", F.col("total"))).over(Window.partitionBy("column"))
    own = F.col("column").isin("class_sum", "bounds")
    return long.withColumn("expected", F.when(own, F.lit(0)).otherwise(overall).cast("long")).withColumn("holds", F.col("total") == F.col("expected"))
