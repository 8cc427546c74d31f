"""What the two vector searches share: valid rows, distinct vectors, blocks, and answers for every query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct candidate and query vectors of one task's block.
CANDIDATES, QUERIES = 4096, 512


def usable(rows: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``id`` and ``v`` (array of double) of the rows whose id and vector are whole: no null, no non-finite component."""
    v = F.col(embedding).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"), whole.alias("whole"))
    return own.filter(F.col("id").isNotNull() & F.col("whole") & (F.size("v") > 0)).select("id", "v")


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row for each distinct ``v``: its ``k + 1`` smallest ids, and (``rep``, ``h``) that name it.

    Equal vectors have equal scores, ties go to smaller ids and a query leaves out only its own
    row, so more ids of one vector than that can never be in an answer. The limit by rank
    is taken before the shuffle too, so a vector that a third of all rows hold isn't one large group.
    """
    first = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumns({"rep": F.col("ids")[0], "h": F.xxhash64("v")})


def block_of(n: Column | int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n) if isinstance(n, int) else n).cast("int")


def block(n: Column | int, *also: str) -> Column:
    return block_of(n, "rep", "h", *also)


def matrix(column: pd.Series, dims: int, kind=np.float64) -> np.ndarray:
    """The vectors as rows, shorter ones filled with zeros."""
    out = np.zeros((len(column), dims), kind)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def answers(found: DataFrame, queries: DataFrame, k: int, score_type: str) -> DataFrame:
    """The ``k`` best for each query id. ``found``: for query vectors (``rep``, ``h``) candidates' ``ids`` and ``score``;
    ``queries``: ``query_id`` with its vector's (``rep``, ``h``)."""
    each = found.select("rep", "h", "score", F.explode("ids").alias("vec_id"))
    best = each.withColumn("rn", F.row_number().over(Window.partitionBy("rep", "h").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rn") <= k + 1).drop("rn")
    own = queries.join(best, ["rep", "h"]).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast(score_type).alias("score"))


def query_vectors(rows: DataFrame, vectors: DataFrame, every: int) -> DataFrame:
    """``query_id`` of each row whose id is divisible by ``every``, with its vector's (``rep``, ``h``)."""
    return rows.filter(F.col("id") % every == 0).distinct().join(vectors.select("v", "rep", "h"), "v").select(F.col("id").alias("query_id"), "rep", "h")
