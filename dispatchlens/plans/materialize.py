"""Materialized inputs shared by all operators of a session.

The fact table is written once as Parquet, partitioned by order month, into the
folder that the caller names or else the shared checkpoint folder, and read by
every operator. This

* cuts lineage: operators plan against a Parquet scan of the columns they use,
  with filters (months as partition filters) pushed into it, not against the
  star join and ~50 parsed columns;
* survives executor loss: the files live in the shared folder;
* computes the data-dependent columns (global mean wait, per-driver and
  per-restaurant means) once.

A table is kept under its input's path and parameters; call :func:`forget` after
the files at that path have changed. Each table or model is built under a lock of its own.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from dispatchlens.params import FactParams
from dispatchlens.plans.facts import facts
from dispatchlens.session import compilable, written
from dispatchlens.sources.star import deliveries_from_star

_LOCK = threading.Lock()
_BUILDING: dict[tuple, threading.RLock] = {}
_CACHE: dict[tuple, DataFrame] = {}


def _key(spark: SparkSession, *parts) -> tuple:
    return (spark.sparkContext.applicationId, *parts)


def _once(k: tuple, build):
    with _LOCK:
        lock = _BUILDING.setdefault(k, threading.RLock())
    with lock:
        if k not in _CACHE:
            _CACHE[k] = build()
        return _CACHE[k]


def raw_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 output over the whole input."""
    return _once(_key(spark, "raw", sf_dir), lambda: deliveries_from_star(spark, sf_dir))


def fact_table(spark: SparkSession, sf_dir: str, p: FactParams = FactParams(), path: str | None = None) -> DataFrame:
    """Fact table over the whole input, written once per session (to ``path``, if given)."""

    def build() -> DataFrame:
        rows = facts(raw_deliveries(spark, sf_dir), p, by_month=True)
        with compilable(spark):
            return written(rows, "facts", path, by=("Year", "Month"), dealt=True)

    return _once(_key(spark, "facts", sf_dir, p, path), build)


def forget(spark: SparkSession) -> None:
    """Drop this session's materialized tables from the registry."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        for k in [k for k in _CACHE if k[0] == app]:
            del _CACHE[k]


def memo(spark: SparkSession, key: tuple, build):
    """Per-session memo for results that are expensive to recompute (fitted
    models and their small metric tables), keyed like the tables above."""
    return _once(_key(spark, "memo", *key), build)
