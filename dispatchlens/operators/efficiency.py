"""Efficiency and bottlenecks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlens.functions.quantiles import median_of, with_quantiles
from dispatchlens.functions.shapes import factor_long, present
from dispatchlens.params import EFFICIENCY_FACTORS, MIN_GROUP_ROWS

_T, _D = "Time_taken_min", "Distance_km"


def _row_kmph() -> F.Column:
    return F.try_divide(F.col(_D), F.col(_T) / 60.0)


def delivery_kpis(facts: DataFrame) -> DataFrame:
    """Mean and median delivery time, mean distance, mean of row speeds (km/h)."""
    base = facts.agg(
        F.avg(_T).alias("avg_delivery_time"),
        F.avg(_D).alias("avg_distance"),
        F.avg(_row_kmph()).alias("avg_speed_kmph"),
    )
    med = median_of(facts, [], _T, "median_delivery_time")
    return base.crossJoin(med).select("avg_delivery_time", "median_delivery_time", "avg_distance", "avg_speed_kmph")


def on_time_rate(facts: DataFrame, sla_minutes: float = 30.0) -> DataFrame:
    """Percent of orders delivered within ``sla_minutes`` (the reference
    hard-codes 30 as a placeholder; here it is measured)."""
    return facts.agg(
        (F.avg(F.coalesce(F.col(_T) <= sla_minutes, F.lit(False)).cast("int")) * 100.0).alias("on_time_rate")
    )


def efficiency_by_factor(facts: DataFrame, factors: Sequence[str] = EFFICIENCY_FACTORS) -> DataFrame:
    """Per factor value: time mean/median/std, distance mean, speed (km/min)
    mean/std and the ratio-of-means speed in km/h; one pass for all factors."""
    fs = present(facts, factors)
    long = factor_long(facts, fs, [_T, _D, "Delivery_Speed"])
    base = long.groupBy("factor", "value").agg(
        F.avg(_T).alias("time_mean"),
        F.stddev_samp(_T).alias("time_std"),
        F.avg(_D).alias("distance_mean"),
        F.avg("Delivery_Speed").alias("speed_mean"),
        F.stddev_samp("Delivery_Speed").alias("speed_std"),
    )
    out = with_quantiles(base, long, ["factor", "value"], [_T], (0.5,), ["median"])
    return out.select(
        "factor", "value", "time_mean", F.col(f"{_T}_median").alias("time_median"), "time_std",
        "distance_mean", "speed_mean", "speed_std",
        F.try_divide(F.col("distance_mean"), F.col("time_mean") / 60.0).alias("avg_speed_kmph"),
    ).orderBy("factor", "value")


def bottleneck_kpis(facts: DataFrame) -> DataFrame:
    """Mean wait and mean estimated preparation time."""
    return facts.agg(
        F.avg("Wait_Time_Minutes").alias("avg_wait_time"),
        F.avg("Restaurant_Prep_Time").alias("restaurant_prep_time"),
    )


def restaurant_efficiency_rank(facts: DataFrame) -> DataFrame:
    """E5: mean restaurant efficiency per restaurant, least efficient first."""
    return (
        facts.where(F.col("Restaurant_ID").isNotNull())
        .groupBy("Restaurant_ID")
        .agg(F.avg("Restaurant_Efficiency").alias("restaurant_efficiency"))
        .orderBy("restaurant_efficiency", "Restaurant_ID")
    )


def _delay_stats(facts: DataFrame, key: str, with_count: bool) -> DataFrame:
    f = facts.where(F.col(key).isNotNull())
    aggs = [F.avg("Order_To_Pickup_Minutes").alias("delay_mean")]
    aggs.append(F.count("Order_To_Pickup_Minutes").alias("delay_count") if with_count
                else F.stddev_samp("Order_To_Pickup_Minutes").alias("delay_std"))
    base = f.groupBy(key).agg(*aggs)
    return with_quantiles(base, f, [key], ["Order_To_Pickup_Minutes"], (0.5,), ["median"]).withColumnRenamed(
        "Order_To_Pickup_Minutes_median", "delay_median"
    )


def delay_by_hour(facts: DataFrame) -> DataFrame:
    """Unclipped order-to-pickup minutes (can be negative) by order hour."""
    return _delay_stats(facts, "Order_Hour", False).select(
        "Order_Hour", "delay_mean", "delay_median", "delay_std"
    ).orderBy("Order_Hour")


def restaurant_delays(facts: DataFrame, min_rows: int = MIN_GROUP_ROWS) -> DataFrame:
    """Order-to-pickup delay by restaurant, restaurants with at least
    ``min_rows`` orders, longest mean delay first."""
    return (
        _delay_stats(facts, "Restaurant_ID", True)
        .where(F.col("delay_count") >= min_rows)
        .select("Restaurant_ID", "delay_mean", "delay_median", "delay_count")
        .orderBy(F.desc("delay_mean"), "Restaurant_ID")
    )


TIME_FACTORS = ("Road_traffic_density", "Weatherconditions", "Type_of_vehicle")


def avg_time_by_factor_union(facts: DataFrame, factors: Sequence[str] = TIME_FACTORS) -> DataFrame:
    """Mean delivery time per value of traffic, weather and vehicle, stacked."""
    long = factor_long(facts, present(facts, factors), [_T])
    return long.groupBy(F.col("factor").alias("dimension"), F.col("value").alias("Factor")).agg(
        F.avg(_T).alias("Avg_Time")
    ).orderBy("dimension", "Factor")


def executive_kpis(facts: DataFrame) -> DataFrame:
    """Mean profit, % profitable, distinct orders, mean time and distance,
    ratio-of-means speed (km/h)."""
    orders = F.countDistinct("Order_ID") if "Order_ID" in facts.columns else F.count(F.lit(1))
    k = facts.agg(
        F.avg("Profit").alias("avg_profit"),
        (F.avg((F.col("Profit") > 0).cast("int")) * 100.0).alias("profitable_pct"),
        orders.alias("total_orders"),
        F.avg(_T).alias("avg_time"),
        F.avg(_D).alias("avg_distance"),
    )
    return k.withColumn("avg_speed_kmph", F.try_divide(F.col("avg_distance"), F.col("avg_time") / 60.0))
