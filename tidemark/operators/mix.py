"""Product mix: how a category's change splits into products, quantities and amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import count_where, money, ratio


def product_categories(sales: DataFrame, focus: str) -> DataFrame:
    """All categories seen for products that were sold in the focus category."""
    inside = sales.where(F.col("category") == focus).select("product_id").distinct()
    return sales.join(inside, "product_id", "left_semi").groupBy("product_id", "category").agg(F.count("*").alias("records"))


def product_daily(sales: DataFrame) -> DataFrame:
    return sales.groupBy("utc_date", "product_id").agg(F.count("*").alias("purchases"), money(F.sum("amount")).alias("amount"), F.min("amount").alias("least"), F.max("amount").alias("most"))


def category_check(sales: DataFrame) -> DataFrame:
    """Daily totals of a category and what is wrong with its records."""
    return sales.groupBy("utc_date").agg(F.count("*").alias("purchases"), money(F.sum("amount")).alias("amount"), F.countDistinct("product_id").alias("products"), F.countDistinct("user_id").alias("users"), count_where(F.coalesce(F.col("amount") < 0, F.lit(True))).alias("bad_amounts"), count_where(F.col("product_id").isNull()).alias("bad_ids"))


def classify_products(categories: DataFrame, focus: str) -> DataFrame:
    """stable: only ever the focus category; other_known: others too; unknown: a bucket without a name among them."""
    seen = categories.groupBy("product_id").agg(F.array_sort(F.collect_set("category")).alias("seen"))
    kind = F.when(F.array_contains("seen", "unknown"), "unknown").when(F.size("seen") > 1, "other_known").otherwise("stable")
    return seen.select("product_id", F.size("seen").alias("categories"), kind.alias("stability"))


def product_compare(daily: DataFrame, classes: DataFrame, target: str, history: list[str]) -> DataFrame:
    """Each product's change between a date and the mean of others: its part, quantity and amount effects.

    Instability comes first, then common, history-only and current-only products.  Effects of
    common products use midpoints, so they sum to the change exactly.
    """
    day = F.col("utc_date").cast("string")
    held = daily.where(day.isin(target, *history))
    s = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("double")
    now, then = day == target, day.isin(*history)
    k = float(len(history))
    wide = held.groupBy("product_id").agg(s("purchases", now).alias("n1"), (s("purchases", then) / k).alias("n0"), s("amount", now).alias("v1"), (s("amount", then) / k).alias("v0"))
    joined = wide.join(classes.select("product_id", "stability"), "product_id", "left")
    part = F.when(F.coalesce("stability", F.lit("unknown")) != "stable", "unstable").when((F.col("n1") > 0) & (F.col("n0") > 0), "common").when(F.col("n0") > 0, "history_only").otherwise("current_only")
    both = F.col("part") == "common"
    p1, p0 = F.try_divide(F.col("v1"), F.col("n1")), F.try_divide(F.col("v0"), F.col("n0"))
    return joined.withColumn("part", part).select(
        "product_id", "part", F.round("n1", 6).alias("n1"), F.round("n0", 6).alias("n0"), F.round("v1", 4).alias("v1"), F.round("v0", 4).alias("v0"), F.round(F.col("v1") - F.col("v0"), 4).alias("change"),
        F.round(F.when(both, (F.col("n1") - F.col("n0")) * (p1 + p0) / 2), 4).alias("quantity_effect"), F.round(F.when(both, (p1 - p0) * (F.col("n1") + F.col("n0")) / 2), 4).alias("amount_effect"),
    )


def mix_parts(compared: DataFrame) -> DataFrame:
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 3).alias(c)
    return compared.groupBy("part").agg(F.count("*").alias("products"), total("change"), total("quantity_effect"), total("amount_effect"))


def focus_products(compared: DataFrame, daily: DataFrame, targets: list[str], declines: int = 5, offsets: int = 2) -> DataFrame:
    """The products of the largest falls and rises, followed over all target dates; absent days are zeros."""
    falls = compared.where("change < 0").orderBy("change", "product_id").limit(declines).select("product_id", F.lit("decline").alias("role"))
    rises = compared.where("change > 0").orderBy(F.desc("change"), "product_id").limit(offsets).select("product_id", F.lit("offset").alias("role"))
    dates = F.explode(F.array(*map(F.lit, targets)))
    spine = falls.unionByName(rises).select("*", dates.alias("day"))
    told = daily.select("product_id", F.col("utc_date").cast("string").alias("day"), "purchases", "amount")
    return F.broadcast(spine).join(told, ["product_id", "day"], "left").select("product_id", "role", "day", F.coalesce("purchases", F.lit(0)).cast("long").alias("purchases"), money(F.coalesce("amount", F.lit(0))).alias("amount"))


def mix_daily_rows(daily: DataFrame) -> DataFrame:
    """Mean record amount of each day and the share of its largest one and five products.

    Tasks keep their five largest products of a day before these are shuffled, so no task holds a day's products.
    """
    nth = F.row_number().over(Window.partitionBy("utc_date").orderBy(F.desc("amount"), "product_id"))
    top = lambda k: F.sum(F.when(F.col("nth") <= k, F.col("amount")))
    largest = daily.withColumn("nth", nth).where("nth <= 5").groupBy(F.col("utc_date").alias("day")).agg(top(1).alias("top1"), top(5).alias("top5"))
    totals = daily.groupBy("utc_date").agg(F.sum("purchases").cast("long").alias("purchases"), F.sum("amount").alias("total"))
    joined = totals.join(largest, F.col("utc_date").eqNullSafe(F.col("day")))
    return joined.select("utc_date", "purchases", ratio(F.col("total"), F.col("purchases"), 4).alias("mean_amount"), ratio(F.col("top1"), F.col("total")).alias("top1_share"), ratio(F.col("top5"), F.col("total")).alias("top5_share"))
