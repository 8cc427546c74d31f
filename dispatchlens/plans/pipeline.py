"""Run the whole catalogue.

An analysis is a function from the shared inputs (the fact table, written once; location clusters; customer
clusters; hot spots) to its results. ``run_all`` returns every result as a DataFrame keyed ``<analysis>_<result>``,
``save_all`` writes them (S5), and ``run_and_save`` runs analyses as concurrent jobs that fail apart and reports on each.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from dispatchlens.operators import customers as U
from dispatchlens.operators import demand as D
from dispatchlens.operators import drivers as V
from dispatchlens.operators import efficiency as E
from dispatchlens.operators import geo as G
from dispatchlens.operators import models as M
from dispatchlens.operators import pricing as X
from dispatchlens.operators import profitability as R
from dispatchlens.operators import recommend as Z
from dispatchlens.operators import routes as T
from dispatchlens.params import FactParams
from dispatchlens.plans.facts import facts as build_facts
from dispatchlens.session import written

Results = dict[str, DataFrame]


class Inputs:
    """What several analyses share, built when first asked for, once, by whichever thread comes first."""

    def __init__(self, spark: SparkSession, raw: DataFrame, p: FactParams = FactParams(), with_models: bool = True):
        self.spark, self.raw, self.p, self.with_models = spark, raw, p, with_models
        self._lock, self._locks, self._made = threading.Lock(), {}, {}

    def get(self, name: str):
        with self._lock:
            own = self._locks.setdefault(name, threading.RLock())
        with own:
            if name not in self._made:
                self._made[name] = getattr(self, f"_{name}")()
            return self._made[name]

    def _facts(self) -> DataFrame:
        return written(build_facts(self.raw, self.p), "facts", by=("Year", "Month"))

    def _segments(self) -> DataFrame:
        return U.customer_segments(self.get("facts"))

    def _enriched(self) -> DataFrame:
        return U.with_customer_segments(written(G.with_location_clusters(self.get("facts")), "enriched"), self.get("segments"))

    def _elbow(self) -> tuple:
        return U.kmeans_elbow(written(U.customer_rfm(self.get("facts")), "rfm"))

    def _labeled(self) -> tuple:
        rfm = U.customer_rfm(self.get("facts"))
        return U.customer_clusters(rfm, elbow=self.get("elbow"))

    def _names(self) -> DataFrame:
        return U.name_segments(*self.get("labeled"))

    def _pickup(self) -> DataFrame:
        return written(G.pickup_hotspots(self.get("facts")), "pickup")

    def _dropoff(self) -> DataFrame:
        return written(G.dropoff_hotspots(self.get("facts")), "dropoff")


def _profitability(i: Inputs) -> Results:
    f, enriched = i.get("facts"), i.get("enriched")
    return {
        "overall_metrics": R.overall_metrics(f),
        "profit_percentage": R.profitable_pct(f),
        "profit_by_factor": R.profit_by_factor(enriched),
        "profit_by_hour": R.profit_by_hour(f),
        "profit_by_day": R.profit_by_day(f),
        "profit_score": R.profit_score(enriched),
        "top_scenarios": R.top_scenarios(enriched),
        "restaurant_cluster_profit": R.restaurant_cluster_profit(enriched),
        "delivery_cluster_profit": R.delivery_cluster_profit(enriched),
    }


def _pricing(i: Inputs) -> Results:
    f = i.get("facts")
    out = {
        "price_analysis": X.price_grid(f),
        "uniform_optimal_price": X.optimal_uniform_price(f),
        "segment_price_grid": X.segment_price_grid(f),
        "segment_based_pricing": X.segment_optimal_prices(f),
    }
    if i.with_models:
        out["dynamic_model"], out["dynamic_feature_importance"] = M.dynamic_price_model(f)
    return out


def _dynamic_pricing(i: Inputs) -> Results:
    f = i.get("facts")
    return {
        "prices": X.dynamic_prices(f),
        "pricing_strategies": X.pricing_strategy_compare(f),
        "price_elasticity": X.price_elasticity_bins(f),
        "price_multipliers": X.multiplier_stats(f),
    }


def _demand_forecast(i: Inputs) -> Results:
    f = i.get("facts")
    forecast = D.moving_average_forecast(f)
    out = {
        "daily_orders": D.daily_orders(f),
        "moving_average": forecast,
        "accuracy": D.forecast_accuracy(forecast),
        "insights": D.forecast_insights(forecast, D.forecast_accuracy(forecast)),
        "autoregressive": D.autoregressive_forecast(f),
        "arima": D.arima_forecast(f),
        "hourly_features": D.hourly_features(f),
        "weekday_pattern": D.weekday_pattern(f),
        "hourly_pattern": D.hourly_pattern(f),
    }
    if i.with_models:
        out["hourly_model"], out["hourly_importance"] = M.hourly_demand_model(f)
    return out


def _route_optimization(i: Inputs) -> Results:
    f, enriched, pickup, dropoff = map(i.get, ("facts", "enriched", "pickup", "dropoff"))
    return {
        "efficient_clusters": T.efficient_clusters(enriched),
        "efficient_routes": T.efficient_routes(enriched),
        "pickup_hotspots": pickup,
        "dropoff_hotspots": dropoff,
        "hotspot_center": G.hotspot_center(f, pickup, dropoff),
        "city_vehicle": T.city_vehicle_efficiency(f),
    }


def _driver_allocation(i: Inputs) -> Results:
    f = i.get("facts")
    return {
        "hourly_demand": V.hourly_demand_matrix(f),
        "drivers_needed": V.drivers_needed(f),
        "shift_allocation": V.shift_allocation(f),
        "efficient_drivers": V.driver_metrics(f),
        "high_rated_drivers": V.high_rated_drivers(f),
    }


def _customer_segmentation(i: Inputs) -> Results:
    labeled, _ = i.get("labeled")
    return {
        "customer_data": labeled,
        "cluster_analysis": U.cluster_summary(labeled),
        "cluster_names": i.get("names"),
        "wcss": i.get("elbow")[0],
        "profiles": i.get("segments"),
    }


def _efficiency(i: Inputs) -> Results:
    f = i.get("facts")
    return {
        "kpis": E.delivery_kpis(f).crossJoin(E.on_time_rate(f)),
        "by_factor": E.efficiency_by_factor(f),
        "avg_time_by_factor": E.avg_time_by_factor_union(f),
        "executive_kpis": E.executive_kpis(f),
        "bottlenecks": E.bottleneck_kpis(f),
        "restaurant_efficiency": E.restaurant_efficiency_rank(f),
        "time_delays_by_hour": E.delay_by_hour(f),
        "restaurant_delays": E.restaurant_delays(f),
    }


def _time_prediction(i: Inputs) -> Results:
    if not i.with_models:
        return {}
    results, importance = M.delivery_time_models(i.get("facts"))
    return {"model_results": results, "feature_importance": importance}


def _recommendations(i: Inputs) -> Results:
    return {"": Z.recommendations(i.get("facts"), i.get("names"), i.get("enriched"), i.get("pickup"), i.get("dropoff"), i.with_models)}


#: Each analysis: its name and what builds its results, which are saved as ``<analysis>_<result>``.
ANALYSES: dict[str, Callable[[Inputs], Results]] = {
    "facts": lambda i: {"": i.get("facts")},
    "profitability": _profitability,
    "pricing": _pricing,
    "dynamic_pricing": _dynamic_pricing,
    "demand_forecast": _demand_forecast,
    "route_optimization": _route_optimization,
    "driver_allocation": _driver_allocation,
    "customer_segmentation": _customer_segmentation,
    "efficiency": _efficiency,
    "time_prediction": _time_prediction,
    "recommendations": _recommendations,
}
STATUS = "analysis string, ok boolean, results int, seconds double, message string"


def _named(analysis: str, results: Results) -> Results:
    return {f"{analysis}_{k}".rstrip("_"): v for k, v in results.items()}


def run_all(spark: SparkSession, raw: DataFrame, p: FactParams = FactParams(), with_models: bool = True) -> Results:
    """Every result of every analysis; the first failure is raised (:func:`run_and_save` keeps analyses apart)."""
    inputs = Inputs(spark, raw, p, with_models)
    return {k: v for name, build in ANALYSES.items() for k, v in _named(name, build(inputs)).items()}


def run_and_save(
    spark: SparkSession, raw: DataFrame, out_dir: str, p: FactParams = FactParams(), only: Sequence[str] | None = None,
    with_models: bool = True, fmt: str = "parquet", at_once: int = 4,
) -> DataFrame:
    """Build and save the analyses (all, or those named in ``only``), ``at_once`` of them as concurrent jobs.

    An analysis that fails, building or writing, ends alone: what it saved before stays, the others go on. Shared inputs
    are built once; each analysis runs in a scheduler pool of its own name, which a fair scheduler serves in turn. Returns
    ``(analysis, ok, results, seconds, message)``, a row for each analysis in the order of :data:`ANALYSES`.
    """
    from dispatchlens.sources.files import write_results

    if unknown := set(only or ()) - set(ANALYSES):
        raise ValueError(f"no such analyses: {sorted(unknown)}")
    inputs = Inputs(spark, raw, p, with_models)

    def run(name: str) -> tuple:
        began, saved = time.monotonic(), 0
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            for key, frame in _named(name, ANALYSES[name](inputs)).items():
                write_results({key: frame}, out_dir, fmt)
                saved += 1
            ok, message = True, ""
        except Exception as e:  # noqa: BLE001  the status tells it
            ok, message = False, f"{type(e).__name__}: {e}"[:500]
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        return name, ok, saved, round(time.monotonic() - began, 3), message

    with ThreadPoolExecutor(at_once) as threads:
        # each has its own copy of this thread's local properties
        waiting = [threads.submit(inheritable_thread_target(spark)(partial(run, name))) for name in ANALYSES if only is None or name in only]
        rows = [w.result() for w in waiting]
    return spark.createDataFrame(rows, STATUS)


def save_all(results: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> list[str]:
    """S5 over ``run_all``'s results (the fact table included)."""
    from dispatchlens.sources.files import write_results

    return write_results(results, out_dir, fmt)


def save_with_status(results: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> DataFrame:
    """``save_all`` one result at a time: ``(analysis, ok, message)``; a failing analysis doesn't stop the others."""
    rows = []
    for name, frame in results.items():
        try:
            save_all({name: frame}, out_dir, fmt)
            rows.append((name, True, ""))
        except Exception as e:  # noqa: BLE001  the report is the point
            rows.append((name, False, f"{type(e).__name__}: {e}"[:500]))
    return next(iter(results.values())).sparkSession.createDataFrame(rows, "analysis string, ok boolean, message string")
