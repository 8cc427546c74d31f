"""Profitability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchlens.functions.quantiles import exact_quantiles, with_quantiles
from dispatchlens.functions.shapes import epoch_seconds, factor_long, present
from dispatchlens.params import MIN_GROUP_ROWS, PROFIT_FACTORS

DESCRIBE_PROBS = (0.25, 0.5, 0.75)


def describe_columns(df: DataFrame) -> list[str]:
    """Numeric, date and timestamp columns (what pandas ``describe`` covers)."""
    ok = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, ok)]


def overall_metrics(facts: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count/mean/min/25%/50%/75%/max/std per column, one row per column.

    Exact percentiles (linear interpolation) via the distributed quantile
    operator; dates and timestamps are described as epoch seconds.
    """
    cols = list(columns) if columns is not None else describe_columns(facts)
    types = {f.name: f.dataType for f in facts.schema.fields}

    def as_double(c: str):
        t = types[c]
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return epoch_seconds(c, t)
        return F.col(c).cast("double")

    pairs = F.array(*[F.struct(F.lit(c).alias("column"), as_double(c).alias("v")) for c in cols])
    long = facts.select(F.inline(pairs)).where(F.col("v").isNotNull() & ~F.isnan("v"))
    base = long.groupBy("column").agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.stddev_samp("v").alias("std"),
    )
    out = with_quantiles(base, long, ["column"], ["v"], DESCRIBE_PROBS, ["p25", "p50", "p75"])
    return out.select(
        "column", "count", "mean", "min",
        F.col("v_p25").alias("p25"), F.col("v_p50").alias("p50"), F.col("v_p75").alias("p75"),
        "max", "std",
    )


def profitable_pct(facts: DataFrame) -> DataFrame:
    """R2: share of orders with positive profit, in percent."""
    return facts.agg((F.avg((F.col("Profit") > 0).cast("int")) * 100.0).alias("profitable_pct"))


def _profit_aggs():
    return [
        F.avg("Profit").alias("profit_mean"),
        F.stddev_samp("Profit").alias("profit_std"),
        F.count("Profit").alias("profit_count"),
        F.avg("Total_Cost").alias("total_cost_mean"),
        F.avg("Revenue").alias("revenue_mean"),
    ]


def _profit_table(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    base = facts.groupBy(*keys).agg(*_profit_aggs())
    out = with_quantiles(base, facts, keys, ["Profit"], (0.5,), ["median"])
    return out.withColumnRenamed("Profit_median", "profit_median")


def profit_by_factor(facts: DataFrame, factors: Sequence[str] = PROFIT_FACTORS) -> DataFrame:
    """Per factor value: profit mean/median/std/count, mean cost and revenue,
    margin %; long format (factor, value, ...), sorted by mean profit within
    factor. All factors are computed in one pass over the facts."""
    fs = present(facts, factors)
    long = factor_long(facts, fs, ["Profit", "Total_Cost", "Revenue"])
    t = _profit_table(long, ["factor", "value"])
    t = t.withColumn("profit_margin_pct", F.try_divide(F.col("profit_mean"), F.col("revenue_mean")) * 100.0)
    return t.select(
        "factor", "value", "profit_mean", "profit_median", "profit_std", "profit_count",
        "total_cost_mean", "revenue_mean", "profit_margin_pct",
    ).orderBy("factor", F.desc("profit_mean"), "value")


def profit_by_hour(facts: DataFrame) -> DataFrame:
    """Profit statistics by order hour."""
    f = facts.where(F.col("Order_Hour").isNotNull())
    return _profit_table(f, ["Order_Hour"]).select(
        "Order_Hour", "profit_mean", "profit_median", "profit_std", "profit_count",
        "total_cost_mean", "revenue_mean",
    ).orderBy("Order_Hour")


def profit_by_day(facts: DataFrame) -> DataFrame:
    """Profit statistics by weekday (Monday = 0), with the day name."""
    from dispatchlens.params import DAY_NAMES

    f = facts.where(F.col("DayOfWeek").isNotNull())
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    return _profit_table(f, ["DayOfWeek"]).select(
        "DayOfWeek",
        F.element_at(names, F.col("DayOfWeek") + 1).alias("day_name"),
        "profit_mean", "profit_median", "profit_std", "profit_count",
        "total_cost_mean", "revenue_mean",
    ).orderBy("DayOfWeek")


def cluster_profit(facts: DataFrame, cluster_col: str, lat: str, lon: str) -> DataFrame:
    """Profit mean/count and centroid per location cluster."""
    f = facts.where(F.col(cluster_col).isNotNull())
    return f.groupBy(cluster_col).agg(
        F.avg("Profit").alias("profit_mean"),
        F.count("Profit").alias("profit_count"),
        F.avg(lat).alias("latitude_mean"),
        F.avg(lon).alias("longitude_mean"),
    ).orderBy(cluster_col)


def restaurant_cluster_profit(facts: DataFrame) -> DataFrame:
    """R6."""
    return cluster_profit(facts, "Restaurant_Cluster", "Restaurant_latitude", "Restaurant_longitude")


def delivery_cluster_profit(facts: DataFrame) -> DataFrame:
    """R7."""
    return cluster_profit(facts, "Delivery_Cluster", "Delivery_location_latitude", "Delivery_location_longitude")


SCORE_FEATURES = ("Distance_km", "Time_taken_min", "Wait_Time_Minutes", "Delivery_person_Ratings")


def profit_score(facts: DataFrame, factors: Sequence[str] = PROFIT_FACTORS) -> DataFrame:
    """Min-max scaled features -> Profit_Score = mean of (1-km), (1-time),
    (1-wait), rating. Rows with any NULL among the used columns are dropped.
    A constant feature scales to 0. The min/max are one-row scalar subqueries."""
    fs = present(facts, factors)
    keep = ["Order_ID", *SCORE_FEATURES, *fs, "Profit"]
    base = facts.select(*keep).dropna(subset=[*SCORE_FEATURES, *fs, "Profit"])
    bounds = base.agg(
        *[F.min(c).alias(f"_mn_{c}") for c in SCORE_FEATURES],
        *[F.max(c).alias(f"_mx_{c}") for c in SCORE_FEATURES],
    )
    # one aggregate row: a proven size bound for the broadcast
    base = base.crossJoin(F.broadcast(bounds))
    scaled = {}
    for c in SCORE_FEATURES:
        mn, mx = F.col(f"_mn_{c}"), F.col(f"_mx_{c}")
        scaled[c] = F.when(mx - mn == 0, F.lit(0.0)).otherwise((F.col(c) - mn) / (mx - mn))
    d, t, w, r = (scaled[c] for c in SCORE_FEATURES)
    score = ((F.lit(1.0) - d) + (F.lit(1.0) - t) + (F.lit(1.0) - w) + r) / 4.0
    return base.select(
        "Order_ID", *fs, "Profit",
        *[scaled[c].alias(f"{c}_scaled") for c in SCORE_FEATURES],
        score.alias("Profit_Score"),
    )


def top_scenarios(
    facts: DataFrame, factors: Sequence[str] = PROFIT_FACTORS, min_rows: int = MIN_GROUP_ROWS, top: int = 10
) -> DataFrame:
    """Best factor combinations by mean Profit_Score among groups with at
    least ``min_rows`` rows; top ``top`` (a top-k report)."""
    fs = [c for c in present(facts, factors) if c not in ("Restaurant_Cluster", "Delivery_Cluster")]
    scored = profit_score(facts, factors)
    g = scored.groupBy(*fs).agg(
        F.avg("Profit_Score").alias("score_mean"),
        F.stddev_samp("Profit_Score").alias("score_std"),
        F.count("Profit_Score").alias("score_count"),
        F.avg("Profit").alias("profit_mean"),
        F.stddev_samp("Profit").alias("profit_std"),
    ).where(F.col("score_count") >= min_rows)
    return g.orderBy(F.desc("score_mean"), *fs).limit(top)
