"""A fact store that grows by batches: late days are added without parsing or rewriting the rows before them.

``path/rows/batch=<name>/Year=/Month=`` holds a batch's parsed rows (P1-P12) and
``path/sums/batch=<name>`` its sums and counts behind the three columns that depend on all
rows: the mean wait that fills missing ones (P13) and the means by driver and by restaurant
(P16, P17). Sums add up over batches, so :func:`stored_facts` gets the same means, and with them the
same facts, as a build from all raw rows at once, while :func:`append` costs what its own batch costs.

A batch's rows are written before its sums, each by one job that replaces the batch's own folder. A
batch without sums isn't read yet, so an append that broke off is repeated under the same name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchlens.params import FactParams
from dispatchlens.plans.facts import ESSENTIAL_COLUMNS, near, parse_rows, with_costs, with_rates
from dispatchlens.session import written

SUMS = "kind string, key string, total double, known long, missing long"
_MONTH = ("Year", "Month")


def _save(df: DataFrame, folder: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(folder)


def batch_sums(parsed: DataFrame) -> DataFrame:
    """``kind, key, total, known, missing`` of waits (one row), speeds by driver and waits by restaurant; null keys have none."""
    speed = F.try_divide(F.col("Distance_km"), F.col("Time_taken_min"))
    part = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
    wait = F.col("Wait_Time_Minutes")
    parts = F.array(
        part("wait", F.lit("all"), wait),
        part("driver", F.col("Delivery_person_ID"), speed),
        part("restaurant", F.col("Restaurant_ID"), wait),
    )
    each = parsed.select(F.inline(parts)).where(F.col("key").isNotNull())
    return each.groupBy("kind", "key").agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"),
        F.count("value").alias("known"),
        (F.count(F.lit(1)) - F.count("value")).alias("missing"),
    )


def append(raw: DataFrame, path: str, batch: str, p: FactParams = FactParams()) -> None:
    """Add the raw rows as ``batch`` (letters, digits, ``_.-``); a batch of that name is replaced, others aren't touched.

    An order that two batches hold counts twice, as in a build from both. Files follow from the
    batch's size by month. All batches of a store need the same parameters."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    rows = f"{path}/rows/batch={batch}"
    parsed = parse_rows(raw, p)
    # what an earlier try left is unreadable until the new sums are there
    _save(raw.sparkSession.createDataFrame([], SUMS), f"{path}/sums/batch={batch}")
    _save(parsed.hint("rebalance", *_MONTH), rows, *_MONTH)
    stored = raw.sparkSession.read.schema(parsed.schema).parquet(rows)
    _save(batch_sums(stored), f"{path}/sums/batch={batch}")


def _sums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SUMS}, batch string").parquet(f"{path}/sums")


def _added(spark: SparkSession, path: str) -> DataFrame:
    return _sums(spark, path).groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("total", "known", "missing")])


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """The parsed rows of all whole batches, with ``batch``; filters on Year and Month choose folders."""
    batches = [r.batch for r in _sums(spark, path).select("batch").distinct().collect()]  # a name for each append
    parsed = parse_rows(spark.createDataFrame([], "Order_ID string"))
    schema = T.StructType([*parsed.schema.fields, T.StructField("batch", T.StringType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows").where(F.col("batch").isin(batches))
    return rows.select(*parsed.columns, "batch")


def stored_means(spark: SparkSession, path: str, p: FactParams = FactParams()) -> tuple[float | None, DataFrame, DataFrame]:
    """The mean wait, and the means by driver and by restaurant, of all whole batches."""
    added = written(_added(spark, path), "sums")
    waits = added.where("kind = 'wait'").select(F.try_divide("total", "known")).first()
    mean_wait = waits[0] if waits else None
    drivers = added.where("kind = 'driver'").select(F.col("key").alias("Delivery_person_ID"), F.try_divide("total", "known").alias("_driver_speed"))
    # a missing wait counts as the mean of all
    filled = F.col("total") + F.col("missing") * F.lit(mean_wait).cast("double")
    prep = F.try_divide(filled, F.col("known") + F.col("missing")) * F.lit(p.prep_share_of_wait)
    return mean_wait, drivers, added.where("kind = 'restaurant'").select(F.col("key").alias("Restaurant_ID"), prep.alias("_rest_prep"))


def stored_facts(spark: SparkSession, path: str, p: FactParams = FactParams(), essential: tuple[str, ...] = ESSENTIAL_COLUMNS) -> DataFrame:
    """The fact table (P1-P21) over all whole batches; equal to ``facts`` of all their raw rows but for the last digits of means."""
    mean_wait, drivers, restaurants = stored_means(spark, path, p)
    rows = with_rates(stored_rows(spark, path).drop("batch"), F.lit(mean_wait).cast("double"), p)
    return with_costs(rows.join(near(drivers), "Delivery_person_ID", "left").join(near(restaurants), "Restaurant_ID", "left"), p, essential)


def compacted(spark: SparkSession, path: str, new_path: str) -> None:
    """A copy of the store at ``new_path`` with all batches in one, so that a month that many appends reached is few files again."""
    rows = stored_rows(spark, path).drop("batch")
    _save(rows.hint("rebalance", *_MONTH), f"{new_path}/rows/batch=all", *_MONTH)
    _save(_added(spark, path), f"{new_path}/sums/batch=all")


def monthly_report(facts: DataFrame) -> DataFrame:
    """Orders, profit and the columns that depend on all rows, by month."""
    means = [F.avg(c).alias(n) for c, n in (("Profit", "profit_mean"), ("Wait_Time_Minutes", "wait_mean"), ("Delivery_Person_Efficiency", "driver_efficiency_mean"), ("Restaurant_Efficiency", "restaurant_efficiency_mean"))]
    return facts.groupBy("Year", "Month").agg(F.count(F.lit(1)).alias("orders"), *means)
