"""Linear and ridge regression in closed form (M4, M5), without an iterative solver.

Products of numeric inputs and the label are summed by combination of categories in one partial
aggregation (54 sums for eight numeric inputs, whatever the number of categories). A combination's sums hold all that the
normal equations need of its rows: a category's slot is 1 there, so it shares the sums of the
intercept. Pairs of slots are then summed over the combinations, and only that matrix
reaches the driver (``MOST_SLOTS`` at most), where it is solved once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlens.operators.models import TIME_FEATURES, hash_split, regression_metrics, time_features

#: Slots (intercept, numeric inputs, category values) of a model at most: the matrix on the driver has their square.
MOST_SLOTS = 2000
#: A slot with less than this share of its square left is explained by the slots before it and gets coefficient 0.
TINY = 1e-9
MODELS = {"Linear Regression": 0.0, "Ridge Regression": 1.0}  # name: penalty
INTERCEPT = "1"


def complete_rows(facts: DataFrame, label: str = "Time_taken_min") -> tuple[DataFrame, list[str], list[str]]:
    """Rows with all numeric inputs and the label, and the names of the numeric and categorical inputs that have values."""
    known = facts.agg(*[F.count(c).alias(c) for c in TIME_FEATURES if c in facts.columns]).first().asDict()
    nums, cats = time_features(facts, [c for c in TIME_FEATURES if known.get(c)])
    rows = facts.select("Order_ID", *[F.col(c).cast("double").alias(c) for c in [*nums, label]], *[F.col(c).cast("string").alias(c) for c in cats])
    return rows.dropna(subset=[*nums, label]), nums, cats


def scales(rows: DataFrame, nums: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample standard deviation of each numeric input."""
    s = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(nums)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(nums)]).first()
    return {c: (s[f"m{i}"] or 0.0, s[f"s{i}"] or 0.0) for i, c in enumerate(nums)}


def standard(c: str, scale: tuple[float, float]) -> Column:
    mean, std = scale
    return (F.col(c) - mean) / std if std else F.lit(0.0)


def slot_of(c: str) -> Column:
    """The slot of a row's value of a category; none for a missing value."""
    return F.concat(F.lit(f"{c}="), F.col(c))


def slot_sums(rows: DataFrame, nums: Sequence[str], cats: Sequence[str], label: str, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """``(s, t, value)``: the sum of products of each two slots that occur together; the label is slot ``y``."""
    own = {INTERCEPT: F.lit(1.0), **{c: standard(c, scale[c]) for c in nums}, "y": F.col(label)}
    names = list(own)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    z = rows.select(*cats, *[v.alias(f"_{i}") for i, v in enumerate(own.values())])
    combos = z.groupBy(*cats).agg(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"_{i}_{j}") for i, j in pairs])
    # a slot and the number of the value that it has within a combination: a category's is the intercept's
    slot = lambda name, i: F.struct(name.alias("s"), F.lit(i).alias("i"))
    slots = [slot(F.lit(n), i) for i, n in enumerate(names)] + [slot(slot_of(c), 0) for c in cats]
    products = F.array(*[F.array(*[F.col(f"_{min(i, j)}_{max(i, j)}") for j in range(len(names))]) for i in range(len(names))])
    held = combos.select(products.alias("p"), F.filter(F.array(*slots), lambda x: x["s"].isNotNull()).alias("slots"))
    each = held.select("p", "slots", F.inline("slots").alias("s", "i")).select("p", "s", "i", F.inline("slots").alias("t", "j"))
    return each.groupBy("s", "t").agg(F.sum(F.col("p")[F.col("i")][F.col("j")]).alias("value"))


def solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Coefficients by Gauss-Jordan elimination in the given order; a slot that those before it explain gets 0."""
    m, size = np.column_stack([matrix, right]), matrix.diagonal().copy()
    for k in range(len(matrix)):
        row = m[k] / m[k, k] if m[k, k] > TINY * size[k] else np.zeros_like(m[k])
        m -= np.outer(m[:, k], row)
        m[k] = row
    return m[:, -1]


def linear_coefficients(train: DataFrame, nums: Sequence[str], cats: Sequence[str], label: str, scale: dict[str, tuple[float, float]]) -> dict[str, dict[str, float]]:
    """Each model's coefficients by slot: intercept, standardised numeric inputs, then category values in the order of their names.

    The intercept is not penalised. Without rows all coefficients are empty."""
    sums = slot_sums(train, nums, cats, label, scale)
    squares = sums.where("s = t").count()
    if squares > MOST_SLOTS + 1:
        raise ValueError(f"{squares - 1} slots, at most {MOST_SLOTS} can be solved on the driver")
    value = {(r["s"], r["t"]): r["value"] for r in sums.collect()}
    fixed = [INTERCEPT, *nums]
    levels = {s for s, _ in value} - {*fixed, "y"}
    order = [s for s in fixed if (s, s) in value] + sorted(levels, key=lambda s: ([*cats].index(s.split("=")[0]), s))
    matrix = np.array([[value.get((s, t), 0.0) for t in order] for s in order]).reshape(len(order), len(order))
    right = np.array([value.get((s, "y"), 0.0) for s in order])
    penalised = np.diag([float(s != INTERCEPT) for s in order]) if order else matrix
    return {name: dict(zip(order, solve(matrix + penalty * penalised, right).tolist())) for name, penalty in MODELS.items()}


def predicted(rows: DataFrame, own: dict[str, float], nums: Sequence[str], cats: Sequence[str], scale: dict[str, tuple[float, float]]) -> Column:
    """A model's prediction; categories that it hasn't seen add nothing."""
    out = F.lit(own.get(INTERCEPT, 0.0))
    for c in nums:
        out += standard(c, scale[c]) * own.get(c, 0.0)
    for c in cats:
        table = [F.lit(x) for s, v in own.items() if s.startswith(f"{c}=") for x in (s, v)]
        if table:
            out += F.coalesce(F.try_element_at(F.create_map(*table), slot_of(c)), F.lit(0.0))
    return out


def linear_delivery_time(facts: DataFrame, label: str = "Time_taken_min") -> tuple[DataFrame, DataFrame]:
    """M4, M5 on the 80/20 hash split: ``(model, slot, coefficient)`` and each model's metrics on the test rows.

    Rows without a numeric input or label take no part; a missing category has no slot. Numeric inputs
    are standardised by the training rows. Slots that those before explain (the last value of a category, a
    constant input) have coefficient 0 in the unpenalised model."""
    rows, nums, cats = complete_rows(facts, label)
    train, test = hash_split(rows)
    scale = scales(train, nums)
    fitted = linear_coefficients(train, nums, cats, label, scale)
    spark = facts.sparkSession
    table = spark.createDataFrame([(m, s, c) for m, own in fitted.items() for s, c in own.items()], "model string, slot string, coefficient double")
    both = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), predicted(test, own, nums, cats, scale).alias("prediction")) for m, own in fitted.items()]))
    scored = test.select(F.col(label), both)
    metrics = [regression_metrics(scored.where(F.col("model") == m), label).select(F.lit(m).alias("model"), "*") for m in fitted]
    return table, metrics[0].unionByName(metrics[1])
