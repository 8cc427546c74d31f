"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the star-schema tables under ``sf_dir`` in full, builds the
fact table (materialized once per session, see ``plans.materialize``) and runs
one operator; doubles are rounded to 6 decimals for the
cross-engine comparison (``present``), nothing else is changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlens.functions.shapes import round_doubles
from dispatchlens.plans.materialize import fact_table, memo, raw_deliveries
from dispatchlens.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def on_facts(name: str, op: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(op(fact_table(spark, sf_dir)))

    run.__name__ = name
    _REGISTRY[name] = run


def on_session(name: str, op: Callable[[SparkSession, str], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(op(spark, sf_dir))

    run.__name__ = name
    _REGISTRY[name] = run


def registry() -> dict[str, Query]:
    if not _REGISTRY:
        _build()
    return dict(_REGISTRY)


def _build() -> None:
    from dispatchlens.operators import profitability as R

    on_facts("overall_metrics", R.overall_metrics)
    on_facts("profitable_pct", R.profitable_pct)
    on_facts("profit_by_factor", R.profit_by_factor)
    on_facts("profit_by_hour", R.profit_by_hour)
    on_facts("profit_by_day", R.profit_by_day)
    on_facts("profit_score", R.profit_score)
    on_facts("top_scenarios", R.top_scenarios)

    from dispatchlens.operators import drivers as V
    from dispatchlens.operators import efficiency as E
    from dispatchlens.operators import routes as T

    for name in (
        "delivery_kpis", "on_time_rate", "efficiency_by_factor", "bottleneck_kpis", "restaurant_efficiency_rank",
        "delay_by_hour", "restaurant_delays", "avg_time_by_factor_union", "executive_kpis",
    ):
        on_facts(name, getattr(E, name))
    for name in (
        "hourly_demand_matrix", "drivers_needed", "driver_metrics", "high_rated_drivers", "shift_allocation",
        "driver_leaderboard",
    ):
        on_facts(name, getattr(V, name))
    on_facts("city_vehicle_efficiency", T.city_vehicle_efficiency)

    from dispatchlens.operators import pricing as X

    for name in (
        "price_grid", "optimal_uniform_price", "segment_price_grid", "segment_optimal_prices", "dynamic_prices",
        "pricing_strategy_compare", "price_elasticity_bins", "multiplier_stats",
    ):
        on_facts(name, getattr(X, name))

    from dispatchlens.operators import demand as D
    from dispatchlens.operators import holidays as H

    on_facts("daily_orders", D.daily_orders)
    on_facts("holdout_split", lambda f: D.holdout_split(D.daily_orders(f)))
    on_facts("holdout_split_fraction", lambda f: D.holdout_split(D.daily_orders(f, fill_missing=False), mode="fraction"))
    on_facts("moving_average_forecast_fraction", lambda f: D.moving_average_forecast(f, mode="fraction"))
    for name in (
        "moving_average_forecast", "ma_forecast_accuracy", "ma_forecast_insights", "history_and_forecast",
        "hourly_orders", "hourly_features", "weekday_pattern", "hourly_pattern", "autoregressive_forecast",
    ):
        on_facts(name, getattr(D, name))
    on_facts("arima_forecast", D.arima_forecast)
    on_facts("city_arima_forecast", lambda f: D.arima_forecast(f, series=["City"]))
    on_facts("city_hourly_features", lambda f: D.hourly_features(f, time_aligned=True, series=["City"]))
    on_facts("holiday_calendar_profit", lambda f: H.profit_by_holiday(f, H.busiest_days(f)))
    on_facts("city_autoregressive_forecast", lambda f: D.autoregressive_forecast(f, series=["City"]))

    from dispatchlens.operators import geo as G

    for name in (
        "restaurant_sites", "restaurant_sites_distinct", "delivery_sites", "pickup_hotspots", "dropoff_hotspots",
        "hotspot_center",
    ):
        on_facts(name, getattr(G, name))

    # Location clusters without the K-means noise reassignment have an exact SQL
    # twin; run_all uses the full C1-C4 chain.
    def clustered(f):
        return memo(f.sparkSession, ("clustered", id(f)), lambda: G.with_location_clusters(f, reassign=False))

    on_facts("profit_by_factor_clustered", lambda f: R.profit_by_factor(clustered(f)))
    on_facts("profit_score_clustered", lambda f: R.profit_score(clustered(f)))
    # two orders: combinations of eight factors rarely repeat at small scales
    on_facts("top_scenarios_clustered", lambda f: R.top_scenarios(clustered(f), min_rows=2))
    on_facts("restaurant_cluster_profit", lambda f: R.restaurant_cluster_profit(clustered(f)))
    on_facts("delivery_cluster_profit", lambda f: R.delivery_cluster_profit(clustered(f)))
    on_facts("efficient_clusters", lambda f: T.efficient_clusters(clustered(f)))
    on_facts("efficient_routes", lambda f: T.efficient_routes(clustered(f)))
    on_facts("route_types_reassigned", lambda f: T.efficient_routes(G.with_location_clusters(f, reassign=True)))

    # distinct sites and a tighter setting leave noise in these tables, which C2 then clusters
    def reassigned(f):
        return memo(f.sparkSession, ("reassigned", id(f)), lambda: G.with_location_clusters(f, 0.01, 10, weighted=False))

    on_facts("restaurant_sites_reassigned", lambda f: G.reassign_noise(G.restaurant_sites_distinct(f), G.RESTAURANT_COORDS))
    on_facts("restaurant_cluster_profit_reassigned", lambda f: R.restaurant_cluster_profit(reassigned(f)))
    on_facts("delivery_cluster_profit_reassigned", lambda f: R.delivery_cluster_profit(reassigned(f)))
    on_facts("efficient_clusters_reassigned", lambda f: T.efficient_clusters(reassigned(f)))
    on_facts("efficient_routes_reassigned", lambda f: T.efficient_routes(reassigned(f)))

    from dispatchlens.operators import customers as U
    from dispatchlens.operators import linear as L
    from dispatchlens.operators import models as M
    from dispatchlens.operators import recommend as Z

    on_facts("customer_profile", U.customer_profile)
    on_facts("customer_rfm", U.customer_rfm)
    on_facts("customer_segments", U.customer_segments)

    def elbow(f):
        return memo(f.sparkSession, ("elbow", id(f)), lambda: U.kmeans_elbow(U.customer_rfm(f)))

    def clusters(f):
        return memo(f.sparkSession, ("customer_clusters", id(f)), lambda: U.customer_clusters(U.customer_rfm(f), elbow=elbow(f)))

    on_facts("kmeans_elbow", lambda f: elbow(f)[0])
    on_facts("customer_cluster_summary", lambda f: U.cluster_summary(clusters(f)[0]))
    on_facts("customer_cluster_names", lambda f: U.name_segments(*clusters(f)))

    # the same steps over labels and predictions that any engine can repeat
    def fixed_labels(f):
        return U.customer_rfm(f).withColumn("Cluster", (F.col("order_count") % 4).cast("int"))

    on_facts("fixed_cluster_names", lambda f: U.name_segments(fixed_labels(f), 4))
    on_facts("fixed_customer_recommendations", lambda f: Z.customer_recommendations(U.name_segments(fixed_labels(f), 4)))
    on_facts("split_counts", M.split_counts)
    on_facts("fixed_prediction_metrics", lambda f: M.regression_metrics(f.withColumn("prediction", 15.0 + 2.0 * F.col("Distance_km")), "Time_taken_min"))

    def time_models(f):
        return memo(f.sparkSession, ("time_models", id(f)), lambda: M.delivery_time_models(f))

    on_facts("delivery_time_models", lambda f: time_models(f)[0])
    on_facts("delivery_time_importance", lambda f: time_models(f)[1])

    def linear(f):
        return memo(f.sparkSession, ("linear_models", id(f)), lambda: L.linear_delivery_time(f))

    on_facts("linear_coefficients", lambda f: linear(f)[0])
    on_facts("linear_metrics", lambda f: linear(f)[1])

    def price_model(f):
        return memo(f.sparkSession, ("price_model", id(f)), lambda: M.dynamic_price_model(f))

    on_facts("dynamic_price_model", lambda f: price_model(f)[0])
    on_facts("dynamic_price_importance", lambda f: price_model(f)[1])

    def hourly_model(f):
        return memo(f.sparkSession, ("hourly_model", id(f)), lambda: M.hourly_demand_model(f))

    on_facts("hourly_demand_model", lambda f: hourly_model(f)[0])
    on_facts("hourly_demand_importance", lambda f: hourly_model(f)[1])

    on_facts("pricing_recommendations", Z.pricing_recommendations)
    on_facts("operations_recommendations", Z.operations_recommendations)
    on_facts("driver_recommendations", Z.driver_recommendations)
    on_facts("customer_recommendations", lambda f: Z.customer_recommendations(U.name_segments(*clusters(f))))
    on_facts("route_recommendations", lambda f: Z.route_recommendations(f, clustered(f)))
    on_facts("recommendations", lambda f: Z.recommendations(f, U.name_segments(*clusters(f))))

    from dispatchlens.functions.columns import parse_order_date
    from dispatchlens.plans import store as S

    def by_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The facts from a store that got the days after each month's 20th, and rows without a date, as a late batch."""
        def build() -> str:
            path = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
            raw = raw_deliveries(spark, sf_dir)
            early = F.coalesce(F.dayofmonth(parse_order_date(F.col("Order_Date"))) <= 20, F.lit(False))
            S.append(raw.where(early), path, "early")
            S.append(raw.where(~early), path, "late")
            return path

        return S.stored_facts(spark, memo(spark, ("store", sf_dir), build))

    on_session("monthly_report_by_batches", lambda spark, sf_dir: S.monthly_report(by_batches(spark, sf_dir)))

    from dispatchlens.sources.files import preview

    on_facts("preview", lambda f: preview(f, 5))
