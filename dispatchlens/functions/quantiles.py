"""Exact grouped quantiles (linear interpolation, as pandas/DuckDB
``quantile_cont``) without shuffling the rows or gathering a group into one task.

1. One scan: per (group, measure) count, min, max and a mergeable sketch
   (``percentile_approx``), whose values a little below and above each
   probability bracket the target ranks ``floor(p*(n-1))`` and ``ceil(p*(n-1))``.
2. Only while a bracket may hold more than ``rank_rows`` rows (groups of several
   million rows): histogram it into ``buckets`` equal-width buckets (partial
   aggregation, output = targets x buckets) and keep the bucket with the rank.
3. One scan: rows below a target's bracket are counted as one, equal values
   within it each; the counts are ranked in a window, which is bounded.

The sketch only proposes: counts decide, and a rank that they don't find within its
bracket starts again from its group's whole range. So the usual cost is two scans, and
the result is exact at every size. Rows meet the targets by a broadcast of the
targets, after their number has been checked (``BROADCAST_TARGETS``); with more
groups than that by a join. Building the result runs the scans, so it is not
lazy; the driver sees a few numbers per scan, never data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlens.session import written

RANK_ROWS = 50_000
BUCKETS = 4096
#: Accuracy of the sketch: ranks are off by at most a share of 1 / ACCURACY. Smaller groups are bracketed by their range.
ACCURACY = 1000
#: Distance of a bracket's ends from its probability, in units of 1 / ACCURACY: once for the sketch's error, twice for the rounding of ranks.
MARGIN = 3
#: Targets (group, measure, rank) that are broadcast at most.
BROADCAST_TARGETS = 200_000


def _on(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column | None:
    conds = [left[c].eqNullSafe(right[c]) for c in cols]
    return reduce(lambda a, b: a & b, conds) if conds else None


def _join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``cols``, keeping one copy of the key columns."""
    if not cols:
        return left.crossJoin(right) if how == "inner" else left.join(right, how=how)
    r = right.select(*[F.col(c).alias(f"__r_{c}") for c in cols], *[c for c in right.columns if c not in cols])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[f"__r_{c}"]) for c in cols])
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{c}" for c in cols])


def _long(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(keys..., _m, _v) with NULL/NaN values removed (pandas skips NaN)."""
    if len(measures) == 1:
        m = measures[0]
        out = df.select(*keys, F.lit(m).alias("_m"), F.col(m).cast("double").alias("_v"))
    else:
        pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in measures])
        out = df.select(*keys, F.inline(pairs).alias("_m", "_v"))
    return out.where(F.col("_v").isNotNull() & ~F.isnan("_v"))


def _at_or_below(long: DataFrame, state: DataFrame, gk: Sequence[str], n_targets: int) -> DataFrame:
    """Each row with the targets of its group and measure that are not below it."""
    near = F.broadcast(state) if n_targets <= BROADCAST_TARGETS else state
    return _join(long, near, gk).where(F.col("_v") <= F.col("_b"))


def _at_rank(counts: DataFrame, gk: Sequence[str], order: str) -> DataFrame:
    """Of each target's counts ``_c`` in the order of a column, the one that holds its rank."""
    w = Window.partitionBy(*gk, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_cum", F.sum("_c").over(w))
    return counts.where((F.col("_cum") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_cum")))


def _whole_range(state: DataFrame) -> DataFrame:
    return state.withColumns({"_a": F.col("_min"), "_b": F.col("_max"), "_cnt": F.col("_n")})


def _narrowed(long: DataFrame, state: DataFrame, gk: list[str], rank_rows: int, buckets: int) -> DataFrame:
    """The targets with brackets that hold at most ``rank_rows`` rows, or one value."""
    wide = (F.col("_cnt") > rank_rows) & (F.col("_a") < F.col("_b"))
    while n_wide := state.where(wide).count():
        open_ = state.where(wide)
        bucket = F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * buckets)
        bucket = F.when(F.col("_v") < F.col("_a"), -1).otherwise(F.least(F.lit(buckets - 1), bucket)).cast("int")
        h = _at_or_below(long, open_, gk, n_wide).groupBy(*gk, "_r", bucket.alias("_k")).agg(
            F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        hit = _at_rank(h, gk, "_k").where(F.col("_k") >= 0).select(*gk, "_r", "_lo", "_hi", "_c")
        got = F.col("_c").isNotNull()
        new = _join(_whole_range(open_), hit, gk + ["_r"], "left").withColumns(
            {t: F.when(got, F.col(c)).otherwise(F.col(t)) for t, c in (("_a", "_lo"), ("_b", "_hi"), ("_cnt", "_c"))}
        )
        state = written(state.where(~wide).unionByName(new.select(*state.columns)), "ranks")
    return state


def _picked(long: DataFrame, state: DataFrame, gk: list[str], n_targets: int) -> DataFrame:
    """The value at each target's rank, where its bracket holds it."""
    value = F.when(F.col("_v") >= F.col("_a"), F.col("_v"))  # null, which comes first: all rows below the bracket
    counts = _at_or_below(long, state, gk, n_targets).groupBy(*gk, "_r", value.alias("_val")).agg(F.count(F.lit(1)).alias("_c"))
    return _at_rank(counts, gk, "_val").where(F.col("_val").isNotNull()).select(*gk, "_r", "_val")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    probs: Sequence[float] = (0.5,),
    names: Sequence[str] | None = None,
    *,
    rank_rows: int = RANK_ROWS,
    buckets: int = BUCKETS,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group: ``keys`` + a column ``<measure>_<name>`` for each
    measure and probability (``names`` default to ``p50`` style labels).
    Groups whose measure has no non-NULL value get no value (NULL after the
    caller's left join)."""
    keys, measures = list(keys), list(measures)
    names = list(names) if names is not None else [f"p{int(round(p * 100))}" for p in probs]
    long = _long(df, keys, measures)
    gk = keys + ["_m"]
    ends = [min(1.0, max(0.0, p + side * MARGIN / accuracy)) for p in probs for side in (-1, 1)]
    stats = long.groupBy(*gk).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", ends, accuracy).alias("_ends")
    )
    stats = written(stats, "stats")
    pos = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    each = [
        F.struct(
            F.lit(i).alias("_pi"),
            F.floor(x).alias("_rlo"),
            F.ceil(x).alias("_rhi"),
            (x - F.floor(x)).alias("_frac"),
            F.col("_ends")[2 * i].alias("_a"),
            F.col("_ends")[2 * i + 1].alias("_b"),
        )
        for i, x in enumerate(pos)
    ]
    targets = stats.select(*gk, "_n", "_min", "_max", F.inline(F.array(*each)))
    few = F.col("_n") <= accuracy
    share = F.ceil(F.col("_n") * (2 * (MARGIN + 1) / accuracy))
    ranks = (
        targets.select(*gk, "_n", "_min", "_max", "_a", "_b", F.explode(F.array_distinct(F.array("_rlo", "_rhi"))).alias("_r"))
        .groupBy(*gk, "_r", "_n", "_min", "_max")
        .agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
        .withColumns({
            "_a": F.when(few, F.col("_min")).otherwise(F.col("_a")),
            "_b": F.when(few, F.col("_max")).otherwise(F.col("_b")),
            "_cnt": F.when(few, F.col("_n")).otherwise(F.least(F.col("_n"), share)),
        })
    )
    state = written(ranks, "ranks")
    vals = None
    while True:
        state = _narrowed(long, state, gk, rank_rows, buckets)
        asked = state.count()
        picked = written(_picked(long, state, gk, asked), "values")
        vals = picked if vals is None else vals.unionByName(picked)
        if picked.count() == asked:
            break
        state = written(_whole_range(_join(state, picked.drop("_val"), gk + ["_r"], "left_anti")), "ranks")
    lo = vals.select(*gk, F.col("_r").alias("_rlo"), F.col("_val").alias("_vlo"))
    hi = vals.select(*gk, F.col("_r").alias("_rhi"), F.col("_val").alias("_vhi"))
    q = _join(_join(targets, lo, gk + ["_rlo"]), hi, gk + ["_rhi"]).select(
        *gk, "_pi", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("_q")
    )
    outs = [
        F.max(F.when((F.col("_m") == m) & (F.col("_pi") == i), F.col("_q"))).alias(f"{m}_{n}")
        for m in measures
        for i, n in enumerate(names)
    ]
    return q.groupBy(*keys).agg(*outs)


def with_quantiles(
    agg: DataFrame,
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    probs: Sequence[float] = (0.5,),
    names: Sequence[str] | None = None,
    **kw,
) -> DataFrame:
    """Left-join exact quantiles of ``df`` onto the per-group table ``agg``."""
    q = exact_quantiles(df, keys, measures, probs, names, **kw)
    return _join(agg, q, list(keys), "left")


def median_of(df: DataFrame, keys: Sequence[str], measure: str, alias: str, **kw) -> DataFrame:
    q = exact_quantiles(df, keys, [measure], (0.5,), ["med"], **kw)
    return q.withColumnRenamed(f"{measure}_med", alias)
