"""Reshaping helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The subset of ``cols`` that exists in ``df`` (the reference skips absent
    columns instead of failing)."""
    return [c for c in cols if c in df.columns]


def factor_long(df: DataFrame, factors: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Unpivot ``factors`` into (factor, value) rows carrying ``measures``.

    One scan feeds every factor's group-by (a grouping-sets plan): the expand
    happens before the partial aggregation, so the shuffle carries one partial
    buffer per (factor, value) and task, not the expanded rows. NULL factor
    values are dropped, as pandas' group-by does.
    """
    pairs = F.array(
        *[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("value")) for f in factors]
    )
    return (
        df.select(F.inline(pairs), *measures)
        .where(F.col("value").isNotNull())
    )


def epoch_seconds(c: str, dtype: T.DataType) -> F.Column:
    """Seconds since 1970-01-01 of a DATE or TIMESTAMP_NTZ column, computed from
    calendar fields so the session time zone does not matter."""
    col = F.col(c)
    days = F.datediff(col.cast("date"), F.lit("1970-01-01").cast("date")).cast("double") * 86400.0
    if isinstance(dtype, T.DateType):
        return days
    return days + F.hour(col) * 3600.0 + F.minute(col) * 60.0 + F.second(col)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (presentation for cross-engine comparison)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
