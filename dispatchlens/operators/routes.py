"""Routes and hot zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlens.functions.quantiles import with_quantiles
from dispatchlens.session import written

_T, _D = "Time_taken_min", "Distance_km"


def city_vehicle_efficiency(facts: DataFrame, top: int | None = None) -> DataFrame:
    """T5: by City x vehicle: mean time, distance and profit; km/h and profit
    per hour from the means; most profitable per hour first."""
    f = facts.where(F.col("City").isNotNull() & F.col("Type_of_vehicle").isNotNull())
    g = f.groupBy("City", "Type_of_vehicle").agg(
        F.avg(_T).alias("time_mean"), F.avg(_D).alias("distance_mean"), F.avg("Profit").alias("profit_mean")
    )
    hours = F.col("time_mean") / 60.0
    out = g.select(
        "*",
        F.try_divide(F.col("distance_mean"), hours).alias("speed_kmph"),
        F.try_divide(F.col("profit_mean"), hours).alias("profit_per_hour"),
    ).orderBy(F.desc("profit_per_hour"), "City", "Type_of_vehicle")
    return out.limit(top) if top else out


def efficient_clusters(facts: DataFrame, cluster_col: str = "Restaurant_Cluster") -> DataFrame:
    """Per restaurant cluster: time and distance mean/median/std, profit
    mean/sum, centroid, profit per minute (ratio of means); best first."""
    f = facts.where(F.col(cluster_col).isNotNull())
    base = f.groupBy(cluster_col).agg(
        F.avg(_T).alias("time_mean"), F.stddev_samp(_T).alias("time_std"),
        F.avg(_D).alias("distance_mean"), F.stddev_samp(_D).alias("distance_std"),
        F.avg("Profit").alias("profit_mean"), F.sum("Profit").alias("profit_sum"),
        F.avg("Restaurant_latitude").alias("latitude_mean"), F.avg("Restaurant_longitude").alias("longitude_mean"),
    )
    out = with_quantiles(base, f, [cluster_col], [_T, _D], (0.5,), ["median"])
    return out.select(
        cluster_col, "time_mean", F.col(f"{_T}_median").alias("time_median"), "time_std",
        "distance_mean", F.col(f"{_D}_median").alias("distance_median"), "distance_std",
        "profit_mean", "profit_sum", "latitude_mean", "longitude_mean",
        F.try_divide(F.col("profit_mean"), F.col("time_mean")).alias("profit_per_minute"),
    ).orderBy(F.desc("profit_per_minute"), cluster_col)


def efficient_routes(facts: DataFrame) -> DataFrame:
    """Per route type: time mean/median/count, mean km and profit; km/min,
    profit/min, profit/km from the means; best profit per minute first."""
    # written, so that the aggregates' and medians' scans don't join the clusters to the facts again each
    f = written(facts.where(F.col("Route_Type").isNotNull()).select("Route_Type", _T, _D, "Profit"), "routes")
    base = f.groupBy("Route_Type").agg(
        F.avg(_T).alias("time_mean"), F.count(_T).alias("time_count"),
        F.avg(_D).alias("distance_mean"), F.avg("Profit").alias("profit_mean"),
    )
    out = with_quantiles(base, f, ["Route_Type"], [_T], (0.5,), ["median"])
    return out.select(
        "Route_Type", "time_mean", F.col(f"{_T}_median").alias("time_median"), "time_count",
        "distance_mean", "profit_mean",
        F.try_divide(F.col("distance_mean"), F.col("time_mean")).alias("speed_km_per_min"),
        F.try_divide(F.col("profit_mean"), F.col("time_mean")).alias("profit_per_min"),
        F.try_divide(F.col("profit_mean"), F.col("distance_mean")).alias("profit_per_km"),
    ).orderBy(F.desc("profit_per_min"), "Route_Type")
