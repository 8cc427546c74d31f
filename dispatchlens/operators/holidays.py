"""P10 with a calendar table: holidays are the days within its date ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days of a calendar that are broadcast at most.
BROADCAST_DAYS = 500_000


def holiday_days(calendar: DataFrame) -> DataFrame:
    """``day``: every day of the ranges of ``calendar(first, last)``, once; ranges without a first or that end before they begin have none, a null
    last is the first."""
    last = F.coalesce("last", "first")
    ranges = calendar.where(F.col("first").isNotNull() & (last >= F.col("first")))
    return ranges.select(F.explode(F.sequence(F.col("first").cast("date"), last.cast("date"), F.expr("INTERVAL 1 DAY"))).alias("day")).distinct()


def with_calendar_holidays(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """``facts`` with ``IsHoliday`` 1 on the calendar's days and 0 on all others and without a date.

    The days are counted: up to ``BROADCAST_DAYS`` they are broadcast, else both sides are shuffled by day."""
    days = holiday_days(calendar)
    near = F.broadcast(days) if days.count() <= BROADCAST_DAYS else days
    marked = near.select(F.col("day").alias("_holiday"))
    joined = facts.join(marked, facts["Order_Date"] == marked["_holiday"], "left")
    return joined.withColumn("IsHoliday", F.col("_holiday").isNotNull().cast("int")).drop("_holiday").select(*dict.fromkeys([*facts.columns, "IsHoliday"]))


def busiest_days(facts: DataFrame, per_year: int = 3) -> DataFrame:
    """A calendar from the orders themselves: each year's days of most orders (the earliest of equals), each with the day after it."""
    days = facts.where(F.col("Order_Date").isNotNull()).groupBy("Year", "Order_Date").agg(F.count(F.lit(1)).alias("orders"))
    order = Window.partitionBy("Year").orderBy(F.desc("orders"), "Order_Date")  # a year's days
    top = days.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_year)
    return top.select(F.col("Order_Date").alias("first"), F.date_add("Order_Date", 1).alias("last"))


def profit_by_holiday(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """Orders and mean profit on the calendar's days and on others."""
    return with_calendar_holidays(facts, calendar).groupBy("IsHoliday").agg(F.count(F.lit(1)).alias("orders"), F.avg("Profit").alias("profit_mean")).orderBy("IsHoliday")
