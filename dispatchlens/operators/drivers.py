"""Drivers and shifts (V1-V6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlens.params import DAY_NAMES, DELIVERIES_PER_DRIVER_HOUR, MIN_GROUP_ROWS, SHIFT_HOURS, SHIFT_NAMES


def _hour_day(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("DayOfWeek").isNotNull() & F.col("Order_Hour").isNotNull())


def hourly_demand(facts: DataFrame) -> DataFrame:
    """Order counts per (weekday, hour), long form, observed cells only."""
    return _hour_day(facts).groupBy("DayOfWeek", "Order_Hour").agg(F.count(F.lit(1)).alias("orders"))


def hourly_demand_matrix(facts: DataFrame) -> DataFrame:
    """V1: weekday x hour order counts, one column per hour 0-23, zero-filled.
    Explicit pivot values: no extra job to discover them, fixed schema."""
    wide = _hour_day(facts).groupBy("DayOfWeek").pivot("Order_Hour", list(range(24))).count().na.fill(0)
    return wide.select("DayOfWeek", *[F.col(str(h)).cast("long").alias(f"hour_{h}") for h in range(24)]).orderBy(
        "DayOfWeek"
    )


def drivers_needed(facts: DataFrame, per_driver_hour: int = DELIVERIES_PER_DRIVER_HOUR) -> DataFrame:
    """V2: drivers per (weekday, hour) = orders / capacity, rounded half to even,
    over observed weekdays x observed hours with missing cells as 0 orders."""
    cnt = hourly_demand(facts)
    days = cnt.select("DayOfWeek").distinct()
    hours = cnt.select("Order_Hour").distinct()
    # at most 7 x 24 cells: a fixed bound
    grid = days.crossJoin(hours).join(cnt, ["DayOfWeek", "Order_Hour"], "left")
    orders = F.coalesce(F.col("orders"), F.lit(0))
    return grid.select(
        "DayOfWeek", "Order_Hour", orders.alias("orders"),
        F.bround(orders / float(per_driver_hour), 0).cast("int").alias("drivers_needed"),
    ).orderBy("DayOfWeek", "Order_Hour")


def driver_metrics(facts: DataFrame) -> DataFrame:
    """V3: per driver totals and means; deliveries per day over the number of
    distinct order dates; profit per minute and per km (ratio of sums)."""
    n_days = facts.select(F.countDistinct("Order_Date")).scalar()
    g = facts.where(F.col("Delivery_person_ID").isNotNull()).groupBy("Delivery_person_ID").agg(
        F.count("Order_ID").alias("order_count"),
        F.sum("Time_taken_min").alias("time_sum"),
        F.avg("Time_taken_min").alias("time_mean"),
        F.sum("Distance_km").alias("distance_sum"),
        F.avg("Distance_km").alias("distance_mean"),
        F.sum("Profit").alias("profit_sum"),
        F.avg("Profit").alias("profit_mean"),
    )
    return g.select(
        "*",
        F.try_divide(F.col("order_count"), n_days.cast("double")).alias("deliveries_per_day"),
        F.try_divide(F.col("profit_sum"), F.col("time_sum")).alias("profit_per_minute"),
        F.try_divide(F.col("profit_sum"), F.col("distance_sum")).alias("profit_per_km"),
    ).orderBy(F.desc("profit_per_minute"), "Delivery_person_ID")


def high_rated_drivers(facts: DataFrame, min_rows: int = MIN_GROUP_ROWS) -> DataFrame:
    """V4: mean rating and rating count per driver, drivers with at least
    ``min_rows`` rated deliveries, best first."""
    g = facts.where(F.col("Delivery_person_ID").isNotNull()).groupBy("Delivery_person_ID").agg(
        F.avg("Delivery_person_Ratings").alias("rating_mean"),
        F.count("Delivery_person_Ratings").alias("rating_count"),
    )
    return g.where(F.col("rating_count") >= min_rows).orderBy(F.desc("rating_mean"), "Delivery_person_ID")


def shift_of_hour(h: F.Column) -> F.Column:
    """0 = morning 6-14, 1 = afternoon 14-22, 2 = night 22-6."""
    return F.when((h >= 6) & (h < 14), 0).when((h >= 14) & (h < 22), 1).otherwise(2)


def shift_allocation(
    facts: DataFrame, per_driver_hour: int = DELIVERIES_PER_DRIVER_HOUR, shift_hours: int = SHIFT_HOURS
) -> DataFrame:
    """V5: drivers per weekday and shift = max(1, floor(orders / (8 * 2))); all
    7 x 3 cells, a day without orders needs 1 driver per shift."""
    spark = facts.sparkSession
    per_shift = (
        _hour_day(facts)
        .groupBy("DayOfWeek", shift_of_hour(F.col("Order_Hour")).alias("shift_index"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    spine = spark.range(21).select(
        (F.col("id") / 3).cast("int").alias("DayOfWeek"), (F.col("id") % 3).cast("int").alias("shift_index")
    )
    days = F.array(*[F.lit(d) for d in DAY_NAMES])
    shifts = F.array(*[F.lit(s) for s in SHIFT_NAMES])
    orders = F.coalesce(F.col("orders"), F.lit(0))
    cap = per_driver_hour * shift_hours
    return (
        spine.join(per_shift, ["DayOfWeek", "shift_index"], "left")
        .select(
            "DayOfWeek",
            F.element_at(days, F.col("DayOfWeek") + 1).alias("day"),
            "shift_index",
            F.element_at(shifts, F.col("shift_index") + 1).alias("shift"),
            orders.cast("long").alias("orders"),
            F.greatest(F.lit(1), F.floor(orders / float(cap))).cast("int").alias("drivers_needed"),
        )
        .orderBy("DayOfWeek", "shift_index")
    )


def driver_leaderboard(facts: DataFrame, top: int = 10) -> DataFrame:
    """V6: per driver orders, mean time, profit and rating; top ``top`` by mean
    profit (a top-k report)."""
    g = facts.where(F.col("Delivery_person_ID").isNotNull()).groupBy("Delivery_person_ID").agg(
        F.count("Order_ID").alias("orders"),
        F.avg("Time_taken_min").alias("avg_time"),
        F.avg("Profit").alias("avg_profit"),
        F.avg("Delivery_person_Ratings").alias("rating"),
    )
    return g.orderBy(F.desc("avg_profit"), "Delivery_person_ID").limit(top)
