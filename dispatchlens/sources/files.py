"""File sources and sinks: S1, S2, S4-S7."""

from __future__ import annotations

import importlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchlens.session import written
from dispatchlens.sources.schema import CSV_TIME_TAKEN, RAW_COLUMNS, RAW_SCHEMA


REJECTED = "_rejected"


def _read_csv(spark: SparkSession, path: str, whole_lines: bool) -> DataFrame:
    """The file's columns by their header names, and in ``REJECTED`` each line that doesn't fit them (with ``whole_lines``: judged by all columns, whichever are asked for)."""
    kinds = {f.name: f.dataType for f in RAW_SCHEMA.fields} | {CSV_TIME_TAKEN: RAW_SCHEMA["Time_taken_min"].dataType}
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header] + [T.StructField(REJECTED, T.StringType())])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", REJECTED).option("columnPruning", not whole_lines).csv(path)


def read_deliveries_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row, explicit schema (no inference pass).

    Columns are found by their names in the header, in any order; both spellings of the time column are accepted,
    columns that RAW_SCHEMA doesn't have are left out, and so are absent ones. Dirty numerics
    stay strings until the fact build; a line that doesn't fit gives what could be read of it (see
    :func:`read_deliveries_with_rejects`).
    """
    return from_dataframe(_read_csv(spark, path, False))


def read_deliveries_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The lines that fit the header and its types, and a table ``(file, line)`` of the others.

    The lines are parsed once and written as Parquet, which both tables read."""
    df = written(_read_csv(spark, path, True).withColumn("file", F.col("_metadata.file_path")), "csv")
    lines = df.where(F.col(REJECTED).isNotNull())
    return from_dataframe(df.where(F.col(REJECTED).isNull())), lines.select("file", F.col(REJECTED).alias("line"))


def from_dataframe(df: DataFrame) -> DataFrame:
    """Accept an existing DataFrame, renaming the CSV spelling of the time column."""
    if CSV_TIME_TAKEN in df.columns:
        df = df.withColumnRenamed(CSV_TIME_TAKEN, "Time_taken_min")
    return df.select(*[F.col(c) for c in RAW_COLUMNS if c in df.columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    """Save a table (parquet by default, CSV with header otherwise).

    With partition columns ``by`` the rows are first rebalanced on them, so that a partition is few files of
    about the advisory size however many tasks wrote before (and a skewed one is split), and overwriting
    replaces the partitions that ``df`` has rows for and leaves the others.
    """
    out = df.hint("rebalance", *by) if by else df
    writer = out.write.mode(mode).partitionBy(*by).option("partitionOverwriteMode", "dynamic" if by else "static")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_results(results: Mapping[str, DataFrame], out_dir: str, fmt: str = "parquet") -> list[str]:
    """One directory per result, named ``<analysis>_<key>``. Every result is a
    flat DataFrame, so nothing is silently skipped."""
    paths = []
    for name, df in results.items():
        paths.append(f"{out_dir.rstrip('/')}/{name}")
        write_table(df, paths[-1], fmt)
    return paths


def save_model(model, path: str) -> None:
    """Persist a fitted Spark ML model or pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a model saved with :func:`save_model`; its class is read from its metadata."""
    spark = SparkSession.getActiveSession()
    kind = json.loads(spark.read.text(f"{path}/metadata").first()[0])["class"]
    module, _, name = kind.rpartition(".")
    python = module.replace("org.apache.spark", "pyspark")  # org.apache.spark.ml.regression.X: pyspark.ml.regression.X
    return getattr(importlib.import_module(python), name).load(path)


def preview(df: DataFrame, n: int = 5, order_by: str | list[str] = "Order_ID") -> DataFrame:
    """First ``n`` rows in a stable order (top-k, not a full sort)."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(n)
