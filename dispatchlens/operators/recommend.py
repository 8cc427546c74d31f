"""Rule-based recommendation tables (Z1-Z6) and chart feeds.

Each recommendation is a row (category, ordinal, text) computed from the
analysis tables with DataFrame operations; every table feeding a line is a
small aggregate, and lists are built from at most three ranked rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlens.params import SEGMENT_FACTORS


def _rows(category: str, *parts: DataFrame) -> DataFrame:
    """Union text rows (each with a sort key) and number them 1..n (bounded:
    a handful of rows)."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.orderBy("_key")
    return u.select(F.lit(category).alias("category"), F.row_number().over(w).alias("ordinal"), "text")


def _top3(df: DataFrame, order: list, col: str) -> DataFrame:
    """Distributed top-3 (each task keeps 3 rows), then ranks on those 3 rows."""
    top = df.orderBy(*order).limit(3)
    return top.select(col, F.row_number().over(Window.orderBy(*order)).alias("_rk"))


def _joined(col: str) -> Column:
    """', '-joined values of a ranked (_rk) column, in rank order."""
    items = F.array_sort(F.collect_list(F.struct(F.col("_rk"), F.col(col).cast("string").alias("v"))))
    return F.array_join(F.transform(items, lambda x: x["v"]), ", ")


def _price(c) -> Column:
    return F.col(c).cast("double").cast("string")


def pricing_recommendations(facts: DataFrame, with_model: bool = False) -> DataFrame:
    """Optimal uniform fee; first three segments (by value) with a positive
    optimal price per factor; a line on the price model if there is one."""
    from dispatchlens.operators.pricing import optimal_uniform_price, segment_optimal_prices

    spark = facts.sparkSession
    uni = optimal_uniform_price(facts).select(
        F.lit(0).alias("_key"),
        F.concat(F.lit("Uniform fee with the highest expected profit: "), _price("Base_Price")).alias("text"),
    )
    order = F.create_map(*[x for i, f in enumerate(SEGMENT_FACTORS) for x in (F.lit(f), F.lit(i + 1))])
    seg = segment_optimal_prices(facts).where(F.col("optimal_price") > 0)
    seg = seg.withColumn("_rk", F.row_number().over(Window.partitionBy("factor").orderBy("value"))).where(F.col("_rk") <= 3)
    lines = seg.groupBy("factor").agg(
        F.array_sort(F.collect_list(F.struct("_rk", F.concat(F.col("value"), F.lit(": "), _price("optimal_price")).alias("s")))).alias("_l")
    )
    seg_txt = lines.select(
        F.element_at(order, F.col("factor")).alias("_key"),
        F.concat(F.lit("Best fees by "), F.col("factor"), F.lit(": "),
                 F.array_join(F.transform("_l", lambda x: x["s"]), ", ")).alias("text"),
    )
    model = spark.range(1).select(
        F.lit(100).alias("_key"), F.lit("Quote fees from the fitted price model").alias("text")
    )
    return _rows("pricing", uni, seg_txt, *[model] * with_model)


def operations_recommendations(facts: DataFrame) -> DataFrame:
    """Three restaurants with the longest pickup delays, the mean wait, the
    factor whose values have the largest mean time spread."""
    from dispatchlens.operators.efficiency import bottleneck_kpis, efficiency_by_factor, restaurant_delays

    top = _top3(restaurant_delays(facts), [F.desc("delay_mean"), F.col("Restaurant_ID")], "Restaurant_ID")
    rest = top.agg(_joined("Restaurant_ID").alias("ids"), F.count(F.lit(1)).alias("n")).where(
        F.col("n") > 0
    ).select(F.lit(1).alias("_key"), F.concat(F.lit("Kitchens with the longest pickup delays: "), F.col("ids")).alias("text"))
    wait = bottleneck_kpis(facts).select(
        F.lit(2).alias("_key"),
        F.concat(F.lit("Mean wait before pickup in minutes: "), F.format_string("%.1f", F.col("avg_wait_time"))).alias("text"),
    )
    order = F.create_map(*[x for i, f in enumerate(SEGMENT_FACTORS) for x in (F.lit(f), F.lit(i))])
    var = efficiency_by_factor(facts).groupBy("factor").agg(F.avg("time_std").alias("_s"))
    var = var.where(F.col("_s").isNotNull()).agg(
        F.max_by("factor", F.struct(F.col("_s"), -F.element_at(order, F.col("factor")))).alias("f")
    ).where(F.col("f").isNotNull())
    var = var.select(F.lit(3).alias("_key"), F.concat(F.lit("Delivery times vary most by "), F.col("f")).alias("text"))
    return _rows("operations", rest, wait, var)


def driver_recommendations(facts: DataFrame) -> DataFrame:
    """Z3: busiest day (sum over shifts; first in week order on ties) and its
    busiest shift; the two standing lines on couriers."""
    from dispatchlens.operators.drivers import shift_allocation

    sa = shift_allocation(facts)
    day = sa.groupBy("DayOfWeek", "day").agg(F.sum("drivers_needed").alias("_t"))
    best_day = day.agg(F.min_by("DayOfWeek", F.struct(-F.col("_t"), F.col("DayOfWeek"))).alias("DayOfWeek"))
    shift = sa.join(best_day, "DayOfWeek").agg(
        F.first("day").alias("day"),
        F.min_by("shift", F.struct(-F.col("drivers_needed"), F.col("shift_index"))).alias("shift"),
    )
    peak = shift.select(F.lit(1).alias("_key"), F.concat(F.lit("Couriers are needed most on "), F.col("day"), F.lit(" in the shift "), F.col("shift")).alias("text"))
    fixed = facts.sparkSession.createDataFrame(
        [(2, "Teach new couriers what the leading ones do"), (3, "Tie courier bonuses to measured efficiency")], "_key int, text string"
    )
    return _rows("driver_management", peak, fixed)


def customer_recommendations(names: DataFrame) -> DataFrame:
    """Loyalty line for clusters named High Value, win-back line for Low
    Frequency clusters (from :func:`customers.name_segments`)."""
    def line(key, pattern, prefix):
        sel = names.where(F.col("name").contains(pattern)).agg(
            F.array_join(F.array_sort(F.collect_list(F.col("Cluster").cast("string"))), ", ").alias("ids"),
            F.count(F.lit(1)).alias("n"),
        ).where(F.col("n") > 0)
        return sel.select(F.lit(key).alias("_key"), F.concat(F.lit(prefix), F.col("ids"), F.lit(")")).alias("text"))

    return _rows(
        "customer_strategies",
        line(1, "High Value", "Reward the groups that bring most profit (clusters "),
        line(2, "Low Frequency", "Invite back the groups that order rarely (clusters "),
    )


def route_recommendations(
    facts: DataFrame, clustered: DataFrame | None = None, pickup: DataFrame | None = None, dropoff: DataFrame | None = None
) -> DataFrame:
    """Top three route types by profit per minute; hot-spot lines when
    pickup / drop-off hot spots exist. Pass the clustered facts and hot spots
    where they have been computed already."""
    from dispatchlens.operators.geo import dropoff_hotspots, pickup_hotspots, with_location_clusters
    from dispatchlens.operators.routes import efficient_routes

    c = clustered if clustered is not None else with_location_clusters(facts, reassign=False)
    top = _top3(efficient_routes(c), [F.desc("profit_per_min"), F.col("Route_Type")], "Route_Type")
    routes = top.agg(_joined("Route_Type").alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    routes = routes.select(F.lit(1).alias("_key"), F.concat(F.lit("Routes with the most profit per minute: "), F.col("r")).alias("text"))
    p = (pickup_hotspots(facts) if pickup is None else pickup).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0).select(
        F.lit(2).alias("_key"), F.lit("Consider shared kitchens at the pickup hot spots").alias("text"))
    d = (dropoff_hotspots(facts) if dropoff is None else dropoff).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0).select(
        F.lit(3).alias("_key"), F.lit("Let couriers wait near the drop-off hot spots").alias("text"))
    return _rows("route_optimization", routes, p, d)


def recommendations(
    facts: DataFrame, names: DataFrame | None = None, clustered: DataFrame | None = None,
    pickup: DataFrame | None = None, dropoff: DataFrame | None = None, with_model: bool = False,
) -> DataFrame:
    """All recommendation lines as (category, ordinal, text)."""
    parts = [pricing_recommendations(facts, with_model), operations_recommendations(facts), driver_recommendations(facts)]
    if names is not None:
        parts.append(customer_recommendations(names))
    parts.append(route_recommendations(facts, clustered, pickup, dropoff))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def safe_group_agg(df: DataFrame, key: str, aggs: dict[str, str]) -> tuple[DataFrame | None, DataFrame]:
    """The aggregates of ``aggs`` (column: ``mean``, ``sum``, ``min``, ``max`` or ``count``) that ``df`` can give by
    ``key`` (null keys left out), and a table ``(column, problem)`` of those it can't. Without the key or any
    usable column there is no result."""
    kinds, numeric = dict(df.dtypes), ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    problems, exprs = [], []
    for column, name in aggs.items():
        if column not in kinds:
            problems.append((column, "absent from the input"))
        elif name in ("mean", "sum") and not kinds[column].startswith(numeric):
            problems.append((column, f"{name} needs numbers, the column holds {kinds[column]}"))
        else:
            exprs.append({"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[name](column).alias(column))
    if key not in kinds:
        problems, exprs = [(key, "absent, nothing to group by"), *problems], []
    left_out = df.sparkSession.createDataFrame(problems, "column string, problem string")
    return (df.dropna(subset=[key]).groupBy(key).agg(*exprs) if exprs else None), left_out
