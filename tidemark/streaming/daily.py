"""Daily event counts and amounts kept up to date from a stream of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_where, money


def daily_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Records, purchases and amount of each day and type, from a streaming or batch DataFrame of facts.

    A day is final once the watermark has passed its end; later records are dropped.
    """
    stamped = events.withColumn("at", F.col("event_timestamp_utc").cast("timestamp")).withWatermark("at", late)
    amount = money(F.coalesce(F.sum(F.when(F.col("amount_eligible"), F.col("price_decimal"))), F.lit(0))).alias("amount")
    days = stamped.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("records"), count_where(F.col("event_type") == "purchase").alias("purchases"), amount)
    return days.select(F.to_date("w.start").alias("utc_date"), "event_type", "records", "purchases", "amount")
