"""Weighted K-means as DataFrame steps that any engine can repeat.

The start is taken from the data: the point nearest to the weighted mean, then always the point
farthest from the centres so far. Each Lloyd round is one partial aggregation of the points (weights and
weighted sums by nearest centre, added up by NumPy within a batch and by Spark across them); all numbers of clusters share a round's scan. Squared distances are
compared at nine decimals, ties go to the first centre or the smallest coordinates, and a
centre without points stays where it is, so results don't depend on the order of rows.
Only centres reach the driver (at most ``k`` points a clustering).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 20
DECIMALS = 9
#: Columns whose squared differences are added up as plain expressions, at most.
PLAIN_COLUMNS = 16
Centre = tuple[float, ...]


def _weight(weight: Column | None) -> Column:
    return F.lit(1.0) if weight is None else weight


def _distances(cols: Sequence[str], centres: Sequence[Centre]) -> Column:
    """An array of a row's squared distances (what ``squares`` of :func:`_by_batch` gives for a batch): plain sums, or folds over arrays where those are too much code."""
    if len(cols) <= PLAIN_COLUMNS:
        square = lambda c: reduce(lambda s, d: s + d, [(F.col(a) - F.lit(b)) * (F.col(a) - F.lit(b)) for a, b in zip(cols, c)], F.lit(0.0))
        return F.array(*[F.round(square(c), DECIMALS) for c in centres])
    x, own = F.array(*cols), F.array(*[F.array(*map(F.lit, c)) for c in centres])
    square = lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    return F.transform(own, lambda c: F.round(square(c), DECIMALS))


def _by_batch(points: DataFrame, cols: Sequence[str], weight: Column, schema: str, work: Callable) -> DataFrame:
    """The rows that ``work(x, w, squares)`` gives for each batch: ``x`` the columns as arrays, ``w`` the weights,
    ``squares(centres)`` an array (points, centres) of rounded squared distances. Passed by value, so workers don't need this package."""
    scale = 10.0**DECIMALS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            *x, w = (c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in batch.columns)

            def squares(centres, x=x):
                sums = np.zeros((len(x[0]), len(centres)))
                for column, own in zip(x, np.asarray(centres, np.float64).T):
                    difference = column[:, None] - own
                    sums += difference * difference
                return np.floor(sums * scale + 0.5) / scale

            columns = work(x, w, squares)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = [c.split()[0] for c in schema.split(",")]
    named = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    return points.select(*named, weight.cast("double").alias("w")).mapInArrow(run, schema)


def _farthest(points: DataFrame, cols: Sequence[str], centres: Sequence[Centre], nearest_wins: bool = False) -> tuple[float, Centre]:
    """The least distance and the coordinates of the point farthest from ``centres`` (``nearest_wins``: nearest); ties to the smallest coordinates."""
    sign, names = (-1.0 if nearest_wins else 1.0), [f"p{i}" for i in range(len(cols))]

    def work(x, w, squares):
        d = sign * squares(centres).min(axis=1)
        most = np.flatnonzero(d == d.max())
        best = min(zip(*(c[most].tolist() for c in x)))
        return [[float(d.max())], *[[v] for v in best]]

    found = _by_batch(points, cols, F.lit(1.0), ", ".join(["d double", *(f"{n} double" for n in names)]), work)
    row = found.agg(F.max(F.struct("d", *[(-F.col(n)).alias(n) for n in names])).alias("p")).first()["p"]
    return row["d"], tuple(-row[n] for n in names)


def nearest(cols: Sequence[str], centres: Sequence[Centre]) -> Column:
    """The number (from 0) of the centre nearest to a row."""
    distances = _distances(cols, centres)
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def farthest_first(points: DataFrame, cols: Sequence[str], k: int, weight: Column | None = None) -> list[Centre]:
    """Up to ``k`` different points: that nearest to the weighted mean, then each time the farthest from those taken; none without points."""
    cols, weight = list(cols), _weight(weight)
    mean = points.agg(*[(F.sum(weight * F.col(c)) / F.sum(weight)).alias(c) for c in cols]).first()
    if mean[0] is None:
        return []
    out = [_farthest(points, cols, [tuple(mean)], nearest_wins=True)[1]]
    while len(out) < k:
        distance, point = _farthest(points, cols, out)
        if not distance:
            break
        out.append(point)
    return out


def fit(points: DataFrame, cols: Sequence[str], starts: dict[int, list[Centre]], weight: Column | None = None, rounds: int = ROUNDS) -> dict[int, list[Centre]]:
    """The centres after ``rounds`` Lloyd rounds (fewer if nothing moves any more) for each number of clusters in ``starts``."""
    cols, centres, weight = list(cols), dict(starts), _weight(weight)
    moving = {k for k, own in centres.items() if own}
    for _ in range(rounds):
        if not moving:
            break
        own, n = {k: centres[k] for k in sorted(moving)}, len(cols)

        def work(x, w, squares, own=own):
            rows = []
            for k, some in own.items():
                at = squares(some).argmin(axis=1)  # the first of equals
                sums = [np.bincount(at, w * c, len(some)) for c in (1.0, *x)]
                rows += [(k, c, *(s[c] for s in sums)) for c in np.unique(at).tolist()]
            return [list(map(kind, c)) for kind, c in zip([int, int] + [float] * (n + 1), zip(*rows))]

        schema = ", ".join(["_k long", "_c long", "_w double", *(f"s{i} double" for i in range(n))])
        sums = _by_batch(points, cols, weight, schema, work).groupBy("_k", "_c").agg(*[F.sum(c).alias(c) for c in ["_w", *(f"s{i}" for i in range(n))]])
        moved = {k: list(centres[k]) for k in moving}
        for r in sums.collect():  # a row for each centre
            if r["_w"]:
                moved[r["_k"]][r["_c"]] = tuple(r[f"s{i}"] / r["_w"] for i in range(n))
        moving = {k for k in moving if moved[k] != centres[k]}
        centres |= moved
    return centres


def within(points: DataFrame, cols: Sequence[str], centres: dict[int, list[Centre]], weight: Column | None = None) -> dict[int, float]:
    """The weighted sum of squared distances to the nearest centre, for each number of clusters."""
    if not centres:
        return {}

    def work(x, w, squares):
        return [[k for k in centres], [float((w * squares(own).min(axis=1)).sum()) for own in centres.values()]]

    sums = _by_batch(points, list(cols), _weight(weight), "k long, s double", work)
    return {r["k"]: r["s"] for r in sums.groupBy("k").agg(F.sum("s").alias("s")).collect()} or dict.fromkeys(centres)
