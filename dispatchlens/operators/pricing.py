"""Pricing (X1-X11).

Price-grid search (X1/X3) in one pass: every order is bucketed to the smallest
grid price that is strictly above its cost (it is profitable from that price
on), counted per bucket with partial aggregation (at most 32 buckets per
segment), and turned into "profitable share at price p" by a cumulative sum
over the 31 grid prices. Mean profit at p is p - mean(cost). This replaces the
reference's 31 (x segments) full scans.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlens.functions.shapes import factor_long, present
from dispatchlens.params import (
    APP_SURGE, HOLIDAY_SURGE, HOUR_SURGE, MIN_SEGMENT_ROWS, PEAK_HOUR_SURGE, PRICE_GRID, SEGMENT_FACTORS,
    TRAFFIC_SURGE, VIABLE_PROFITABLE_PCT, WEATHER_SURGE, WEEKEND_SURGE,
)

GRID_COLS = ["Base_Price", "Average_Profit", "Profit_Margin_Pct", "Profitable_Deliveries_Pct"]


def price_bucket(cost: Column, grid: tuple[int, int, int] = PRICE_GRID) -> Column:
    """Smallest grid price strictly greater than ``cost`` (exact: the float
    estimate is corrected by direct comparison with the neighbouring prices)."""
    lo, _, step = grid
    k0 = F.floor((cost - lo) / step) + 1
    k = (
        F.when(F.lit(lo) + F.lit(step) * k0 <= cost, k0 + 1)
        .when(F.lit(lo) + F.lit(step) * (k0 - 1) > cost, k0 - 1)
        .otherwise(k0)
    )
    return (F.lit(lo) + F.lit(step) * F.greatest(k, F.lit(0))).cast("long")


def _grid(spark, grid=PRICE_GRID) -> DataFrame:
    lo, hi, step = grid
    return spark.range(lo, hi + 1, step).select(F.col("id").alias("Base_Price"))


def _grid_table(hist: DataFrame, seg: DataFrame, keys: Sequence[str], grid) -> DataFrame:
    """hist: keys + bucket price + count; seg: keys + n + mean cost."""
    spark = hist.sparkSession
    cells = seg.crossJoin(F.broadcast(_grid(spark, grid)))  # segments x 31, the result's own size
    j = cells.join(hist, [*keys, "Base_Price"], "left")
    w = Window.partitionBy(*keys).orderBy("Base_Price").rowsBetween(Window.unboundedPreceding, 0)
    prof = F.sum(F.coalesce(F.col("_c"), F.lit(0))).over(w)
    price = F.col("Base_Price").cast("double")
    avg_profit = price - F.col("_mean_cost")
    return j.select(
        *keys,
        F.col("Base_Price"),
        avg_profit.alias("Average_Profit"),
        (avg_profit / price * 100.0).alias("Profit_Margin_Pct"),
        (prof / F.col("_n") * 100.0).alias("Profitable_Deliveries_Pct"),
        F.col("_n"),
    )


def price_grid(facts: DataFrame, grid: tuple[int, int, int] = PRICE_GRID) -> DataFrame:
    """Mean profit, margin % and % profitable orders at each grid price."""
    f = facts.where(F.col("Total_Cost").isNotNull())
    hist = f.groupBy(price_bucket(F.col("Total_Cost"), grid).alias("Base_Price")).agg(F.count(F.lit(1)).alias("_c"))
    seg = f.agg(F.count(F.lit(1)).alias("_n"), F.avg("Total_Cost").alias("_mean_cost"))
    return _grid_table(hist, seg, [], grid).select(*GRID_COLS).orderBy("Base_Price")


def _pick_optimal(grid_df: DataFrame, keys: Sequence[str], viable_pct: float) -> DataFrame:
    viable = (F.col("Profitable_Deliveries_Pct") >= viable_pct).cast("int")
    w = Window.partitionBy(*keys).orderBy(viable.desc(), F.desc("Average_Profit"), "Base_Price")
    return grid_df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == 1).drop("_rk")


def optimal_uniform_price(facts: DataFrame, viable_pct: float = VIABLE_PROFITABLE_PCT) -> DataFrame:
    """Best mean profit among prices that make >= 90 % of orders
    profitable; the best overall if no price does."""
    g = price_grid(facts).withColumn("_one", F.lit(1))
    return _pick_optimal(g, ["_one"], viable_pct).select(*GRID_COLS)


def segment_price_grid(
    facts: DataFrame,
    factors: Sequence[str] = SEGMENT_FACTORS,
    min_rows: int = MIN_SEGMENT_ROWS,
    grid: tuple[int, int, int] = PRICE_GRID,
) -> DataFrame:
    """X1 for every value of each factor that has at least ``min_rows``
    orders; one scan for all factors."""
    long = factor_long(facts.where(F.col("Total_Cost").isNotNull()), present(facts, factors), ["Total_Cost"])
    keys = ["factor", "value"]
    hist = long.groupBy(*keys, price_bucket(F.col("Total_Cost"), grid).alias("Base_Price")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    seg = (
        long.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.avg("Total_Cost").alias("_mean_cost"))
        .where(F.col("_n") >= min_rows)
    )
    return _grid_table(hist, seg, keys, grid).select(*keys, *GRID_COLS, F.col("_n").alias("sample_size")).orderBy(
        *keys, "Base_Price"
    )


def segment_optimal_prices(
    facts: DataFrame,
    factors: Sequence[str] = SEGMENT_FACTORS,
    min_rows: int = MIN_SEGMENT_ROWS,
    viable_pct: float = VIABLE_PROFITABLE_PCT,
) -> DataFrame:
    """X2 per segment, with the segment's sample size."""
    g = segment_price_grid(facts, factors, min_rows)
    return (
        _pick_optimal(g, ["factor", "value"], viable_pct)
        .select(
            "factor", "value", F.col("Base_Price").alias("optimal_price"),
            F.col("Average_Profit").alias("average_profit"), F.col("Profit_Margin_Pct").alias("profit_margin"),
            F.col("Profitable_Deliveries_Pct").alias("profitable_pct"), "sample_size",
        )
        .orderBy("factor", "value")
    )


#: The multiplier of each level of each factor, in the order in which they are multiplied; other levels count 1.
SURGE_FACTORS: dict[str, dict] = {
    "IsPeakHour": {1: PEAK_HOUR_SURGE},
    "IsWeekend": {1: WEEKEND_SURGE},
    "IsHoliday": {1: HOLIDAY_SURGE},
    "Road_traffic_density": TRAFFIC_SURGE,
    "Weatherconditions": WEATHER_SURGE,
    "Order_Hour": HOUR_SURGE,
}


def dynamic_multiplier(facts: DataFrame) -> Column:
    """Product of the multipliers of a row's levels, over the factors that the table has."""

    def of_level(factor: str) -> Column:
        levels = F.create_map(*[F.lit(x) for level, multiplier in SURGE_FACTORS[factor].items() for x in (level, float(multiplier))])
        return F.coalesce(F.try_element_at(levels, F.col(factor)), F.lit(1.0))

    return reduce(lambda product, factor: product * of_level(factor), [f for f in SURGE_FACTORS if f in facts.columns], F.lit(1.0))


def with_dynamic_price(facts: DataFrame, base_fee: float = 100.0) -> DataFrame:
    """X6 + X7: Dynamic_Multiplier, Dynamic_Price = fee x multiplier,
    Dynamic_Profit = price - total cost."""
    df = facts.withColumn("Dynamic_Multiplier", dynamic_multiplier(facts))
    df = df.withColumn("Dynamic_Price", F.lit(float(base_fee)) * F.col("Dynamic_Multiplier"))
    return df.withColumn("Dynamic_Profit", F.col("Dynamic_Price") - F.col("Total_Cost"))


def dynamic_prices(facts: DataFrame, base_fee: float = 100.0) -> DataFrame:
    """X6/X7 per order."""
    return with_dynamic_price(facts, base_fee).select(
        "Order_ID", "Dynamic_Multiplier", "Dynamic_Price", "Dynamic_Profit"
    )


def pricing_strategy_compare(facts: DataFrame, base_fee: float = 100.0) -> DataFrame:
    """Static vs dynamic pricing, one row each."""
    d = with_dynamic_price(facts, base_fee)
    a = d.agg(
        F.sum("Profit").alias("s_total"), F.avg("Profit").alias("s_avg"),
        (F.avg((F.col("Profit") > 0).cast("int")) * 100.0).alias("s_pct"),
        F.sum("Dynamic_Profit").alias("d_total"), F.avg("Dynamic_Profit").alias("d_avg"),
        (F.avg((F.col("Dynamic_Profit") > 0).cast("int")) * 100.0).alias("d_pct"),
    )
    inc = F.col("d_total") - F.col("s_total")
    return a.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("static").alias("strategy"), F.col("s_total").alias("total_profit"),
                    F.col("s_avg").alias("avg_profit_per_order"), F.col("s_pct").alias("profitable_orders_pct"),
                    F.lit(None).cast("double").alias("profit_increase"),
                    F.lit(None).cast("double").alias("profit_increase_pct"),
                ),
                F.struct(
                    F.lit("dynamic").alias("strategy"), F.col("d_total").alias("total_profit"),
                    F.col("d_avg").alias("avg_profit_per_order"), F.col("d_pct").alias("profitable_orders_pct"),
                    inc.alias("profit_increase"),
                    (F.try_divide(inc, F.abs(F.col("s_total"))) * 100.0).alias("profit_increase_pct"),
                ),
            )
        )
    )


def equal_width_bins(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """X9 helper: counts in ``bins`` equal-width, right-closed bins over
    [min, max], the first bin extended by 0.1 % of the range; empty bins are
    kept. Edges are computed exactly as ``i * step + min`` (numpy linspace)."""
    spark = df.sparkSession
    v = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    b = v.agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    mn, mx = F.col("_mn"), F.col("_mx")
    same = mn == mx
    lo = F.when(same, mn - F.abs(mn) * 0.001).otherwise(mn)
    hi = F.when(same, mx + F.abs(mx) * 0.001).otherwise(mx)
    step = (hi - lo) / float(bins)
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, hi).otherwise(i * step + lo))
    first = F.when(same, lo).otherwise(lo - (hi - lo) * 0.001)
    edges = F.transform(edges, lambda e, i: F.when(i == 0, first).otherwise(e))
    bnd = b.select(edges.alias("_edges"))
    inner = F.slice(F.col("_edges"), 2, bins - 1)  # the bins-1 inner edges
    idx = F.size(F.filter(inner, lambda e: e < F.col(value))) + 1
    counts = v.crossJoin(F.broadcast(bnd)).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("orders"))
    spine = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(bnd))
    return (
        spine.join(counts, "bin", "left")
        .select(
            "bin",
            F.element_at("_edges", F.col("bin")).alias("lower"),
            F.element_at("_edges", F.col("bin") + 1).alias("upper"),
            F.coalesce(F.col("orders"), F.lit(0)).cast("long").alias("orders"),
        )
        .orderBy("bin")
    )


def price_elasticity_bins(facts: DataFrame, bins: int = 10, base_fee: float = 100.0) -> DataFrame:
    """Order volume per dynamic-price range."""
    return equal_width_bins(with_dynamic_price(facts, base_fee), "Dynamic_Price", bins)


def multiplier_stats(facts: DataFrame) -> DataFrame:
    """describe() of the dynamic multiplier."""
    from dispatchlens.operators.profitability import overall_metrics

    return overall_metrics(with_dynamic_price(facts), ["Dynamic_Multiplier"])


def surge_table(spark, variant: str = "analysis") -> DataFrame:
    """X11: the surge factors as a (factor, level, multiplier) table (a fixed
    constant, for display and for joins)."""
    table = {("Hour" if f == "Order_Hour" else f): levels for f, levels in SURGE_FACTORS.items()} if variant == "analysis" else APP_SURGE
    rows = [(factor, str(level), float(multiplier)) for factor, levels in table.items() for level, multiplier in levels.items()]
    return spark.createDataFrame(rows, "factor string, level string, multiplier double")
