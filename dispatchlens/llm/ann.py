"""Approximate nearest neighbours by inner product with an adaptive dimension scan.

The index has inverted lists over randomly rotated vectors, kept in blocks of columns. Within
each probed list a query adds up squared distances block by block; after every block a
hypothesis test on the partial distance abandons the candidates that are, at the chosen
significance, farther than the k-th nearest so far. The nearest list is searched first, and
its k-th distance is the limit for the others, which return only what is nearer. Inner product becomes distance by one more
component that gives all candidates the same length (zero for queries). Queries are scaled to that
length too: it doesn't change the order of their inner products, and lists are then told apart by direction for
short queries as for long ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispatchlens.llm import common, vectors
from dispatchlens.llm.pivots import lifted

#: Rows that the index is fitted on, at most about: centroids and the number of probes.
FIT_ROWS = 20_000
FIT_QUERIES = 500
#: Vectors a list aims at, and the most lists.
LIST_ROWS, MOST_LISTS = 512, 4096
#: Mean recall on the fitting rows that decides how many lists are probed, and that of the worst twentieth of queries.
TARGET_RECALL, TARGET_TAIL = 0.95, 0.75
#: Columns of a block, and the significance of the test (larger: fewer candidates lost).
COLUMNS, SIGNIFICANCE = 16, 2.1
#: Share of pairs left below which they are looked at one by one, and queries looked at together.
SPARSE, TOGETHER = 0.2, 64
ROUNDS, SEED = 12, 20
#: Distances to centres held at once.
PAIRS = 1 << 22
LISTS = "list int, chunks int, query_blocks int"


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def fit_centroids(points: np.ndarray, n: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = points[rng.choice(len(points), n, replace=False)]
    for _ in range(ROUNDS):
        near = nearest(points, centres, 1)[:, 0]
        size = np.bincount(near, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each point, nearest first; points are taken together only as far as memory is bounded."""
    out, size = np.empty((len(points), min(n, len(centres))), np.int64), (centres**2).sum(1)
    step = max(1, PAIRS // len(centres))
    for i in range(0, len(points), step):
        far = size - 2 * points[i : i + step] @ centres.T
        out[i : i + step] = far.argmin(1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]
    return out


def scaled(x: np.ndarray, longest2: float) -> np.ndarray:
    """Queries at the length of the lifted candidates, with a zero as the component more."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    x *= np.sqrt(longest2 / np.maximum((x**2).sum(1, keepdims=True), np.finfo(float).tiny))
    return np.column_stack([x, np.zeros(len(x))])


def fit_probes(points: np.ndarray, queries: np.ndarray, centres: np.ndarray, k: int) -> int:
    """The fewest probes with which the fitting queries find ``TARGET_RECALL`` of their ``k`` nearest fitting rows,
    and 19 of 20 queries at least ``TARGET_TAIL`` of their own."""
    own = nearest(points, centres, 1)[:, 0]
    order = nearest(queries, centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(order), 0), axis=1)
    true = nearest(queries, points, k + 1)[:, 1:]
    needed = np.sort(np.take_along_axis(place, own[true], axis=1), axis=1)
    if not needed.size:
        return 1
    within = lambda x, share: int(np.sort(x)[max(0, int(np.ceil(share * len(x))) - 1)])
    tail = needed[:, max(0, int(np.ceil(TARGET_TAIL * needed.shape[1])) - 1)]
    return max(within(needed.ravel(), TARGET_RECALL), within(tail, 0.95)) + 1


def scan(queries: np.ndarray, blocks: list[np.ndarray], k: int, limits: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places of each query's up to ``k`` nearest in a list that are within its squared ``limit``.

    ``blocks`` hold the list's vectors by columns. While most pairs are alive a block is added to all of them as a
    matrix product, later only to the pairs that are left. With ``exact`` only pairs already beyond the limit go.
    """
    n, dims = blocks[0].shape[1], sum(len(b) for b in blocks)
    parts = np.split(queries, np.cumsum([len(b) for b in blocks])[:-1], axis=1)
    partial, seen = np.zeros((len(queries), n)), 0
    pairs = None
    for i, (part, block) in enumerate(zip(parts, blocks)):
        if pairs is None:
            partial += (part**2).sum(1)[:, None] + (block**2).sum(0) - 2 * part @ block
        else:
            partial = partial + np.square(block[:, pairs[1]] - part[pairs[0]].T).sum(0)
        seen += len(part)
        if i == 0 and n > k and np.isinf(limits).any():  # the whole distances of those that look nearest give a first limit
            likely = np.argpartition(partial, k - 1, axis=1)[:, :k]
            whole = sum(np.square(b[:, likely] - p.T[:, :, None]).sum(0) for p, b in zip(parts, blocks))
            limits = np.minimum(limits, whole.max(1) * (1 + 1e-9))
        if seen < dims:
            bound = limits * (1 + 1e-6) + 1e-9 if exact else limits * (1 + SIGNIFICANCE / np.sqrt(seen)) ** 2 * (seen / dims)
            if pairs is None:
                alive = partial <= bound[:, None]
                if alive.mean() < SPARSE:
                    pairs = np.nonzero(alive)
                    partial = partial[pairs]
                else:
                    partial[~alive] = np.inf
            else:
                stay = partial <= bound[pairs[0]]
                pairs, partial = (pairs[0][stay], pairs[1][stay]), partial[stay]
    if pairs is None:
        pairs = np.nonzero(np.isfinite(partial))
        partial = partial[pairs]
    near = partial <= limits[pairs[0]] * (1 + 1e-9) + 1e-12
    query, place, partial = pairs[0][near], pairs[1][near], partial[near]
    order = np.lexsort((partial, query))
    query, place = query[order], place[order]
    first = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[first], place[first]


def nearest_neighbours(rows: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """About the ``k`` rows of largest inner product for each row of ``rows(vec_id, embedding)`` whose vec_id is divisible by ``every``.

    Returns ``query_id, rank, vec_id, score``, nearest first, ties to the smaller vec_id; the score is
    the inner product of the original vectors in double precision. All rows but the query's own
    are indexed and are candidates; a query gets fewer than ``k`` only if there are fewer. Where the probed lists give
    fewer, it searches as many more lists, in order of distance, as hold ``k``, without the test.

    Null ids and vectors that are null, empty, zero or hold null or non-finite components take
    no part; vectors of different lengths are compared as if filled with zeros; rows that repeat id and
    vector count once; other columns are not read; an empty table gives no rows.

    Centroids and the number of probes are fitted on at most about ``FIT_ROWS`` rows, and the number of
    lists grows with the rows up to ``MOST_LISTS``. Equal vectors are one entry. A full list is split
    into chunks and its queries into blocks, so a task holds a bounded number of both however
    many rows a list has.
    """
    own = vectors.usable(rows).filter(F.exists("v", lambda x: x != 0))
    own = common.written(own, "vectors")
    data = common.written(vectors.distinct_vectors(own, k), "distinct")
    queries = common.written(vectors.query_vectors(own, data, every), "queries")
    facts = data.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest2")).first()
    n, dims, longest2 = facts["n"], facts["dims"] or 1, facts["longest2"] or 1.0
    turn = rotation(dims + 1)
    sample = vectors.matrix(data.filter(common.hash_fraction("h", "rep") < FIT_ROWS / max(n, 1)).orderBy("h").select("v").toPandas()["v"], dims)
    points = lifted(sample, longest2) @ turn
    if not len(points):
        points = np.zeros((1, dims + 1))
    centres = fit_centroids(points, min(len(points), MOST_LISTS, -(-n // LIST_ROWS) or 1))
    as_query = lambda x: scaled(x, longest2) @ turn
    probes = fit_probes(points, as_query(sample[:FIT_QUERIES]), centres, k)

    def place(as_points, n_lists: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                y = as_points(vectors.matrix(frame["v"], dims))
                yield frame.assign(list=list(nearest(y, centres, n_lists).astype(np.int32)), y=list(y))

        return run

    kind = lambda d: ", ".join(f"{c} {t}" for c, t in d.dtypes) + ", list array<int>, y array<double>"
    index = common.written(data.mapInPandas(place(lambda x: lifted(x, longest2) @ turn, 1), kind(data)).withColumn("list", F.col("list")[0]), "index")
    asked = data.join(queries.select("rep", "h").distinct(), ["rep", "h"]).drop("ids")
    probed = asked.mapInPandas(place(as_query, probes), kind(asked)).select("rep", "h", "v", "y", F.posexplode("list").alias("turn", "list"))
    probed = common.written(probed, "probes")

    def search(candidates: pd.DataFrame, questions: pd.DataFrame, exact: bool) -> pd.DataFrame:
        out = []
        if len(candidates) and len(questions):
            y = np.stack(candidates["y"]).T
            blocks = [np.ascontiguousarray(y[i : i + COLUMNS]) for i in range(0, len(y), COLUMNS)]
            x, v, q = vectors.matrix(candidates["v"], dims), vectors.matrix(questions["v"], dims), np.stack(questions["y"])
            ids, names = candidates["ids"].tolist(), list(zip(questions["rep"], questions["h"]))
            limits = questions["limit"].fillna(np.inf).to_numpy(float)
            for a in range(0, len(q), TOGETHER):
                own, places = scan(q[a : a + TOGETHER], blocks, k + 1, limits[a : a + TOGETHER], exact)
                # products are added in the order of the components, so equal vectors have equal scores in every block
                scores = np.cumsum(x[places] * v[a + own], axis=1)[:, -1]
                out += [(*names[a + i], ids[j], s) for i, j, s in zip(own.tolist(), places.tolist(), scores.tolist())]
        return pd.DataFrame(out, columns=["rep", "h", "ids", "score"])

    def searched(asking: DataFrame, exact: bool = False) -> DataFrame:
        shape = index.groupBy("list").agg(F.count("*").alias("n")).join(asking.groupBy("list").agg(F.count("*").alias("q")), "list")
        # at most MOST_LISTS rows
        shape = shape.select("list", F.ceil(F.col("n") / vectors.CANDIDATES).cast("int").alias("chunks"), F.ceil(F.col("q") / vectors.QUERIES).cast("int").alias("query_blocks")).collect()
        lists = F.broadcast(index.sparkSession.createDataFrame(shape, LISTS))
        every_block = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = index.join(lists, "list").withColumn("cb", vectors.block(F.col("chunks"))).withColumn("qb", every_block("query_blocks"))
        right = asking.join(lists, "list").withColumn("qb", vectors.block(F.col("query_blocks"))).withColumn("cb", every_block("chunks"))
        keys = ["list", "cb", "qb"]
        found = left.select(*keys, "v", "ids", "y").groupBy(*keys).cogroup(right.select(*(F.col(c).alias(c) for c in [*keys, "rep", "h", "v", "y", "limit"])).groupBy(*keys))
        return common.written(found.applyInPandas(lambda c, q: search(c, q, exact), "rep long, h long, ids array<long>, score double"), "found")

    first = searched(probed.filter("turn = 0").withColumn("limit", F.lit(None).cast("double")))
    rank = F.row_number().over(Window.partitionBy("rep", "h").orderBy(F.desc("score")))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    length = largest * F.sqrt(F.aggregate(F.transform("v", lambda x: x / largest), F.lit(0.0), lambda s, x: s + x * x))
    kth = first.withColumn("rn", rank).filter(F.col("rn") == k + 1).select("rep", "h", F.col("score").alias("kth"))
    rest = probed.filter("turn > 0").join(kth, ["rep", "h"], "left").withColumn("limit", 2 * F.lit(longest2) - 2 * F.col("kth") * (float(np.sqrt(longest2)) / length))
    found = first.unionByName(searched(rest.drop("kth")))
    got = found.groupBy("rep", "h").agg(F.sum(F.size("ids")).alias("got"))
    short = common.written(asked.join(got, ["rep", "h"], "left").filter(F.coalesce("got", F.lit(0)) <= k).select("rep", "h", "v"), "short")
    if not short.isEmpty():
        held = np.zeros(len(centres), np.int64)
        for r in index.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():  # at most MOST_LISTS rows
            held[r["list"]] = r["n"]

        def enough(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                y = as_query(vectors.matrix(frame["v"], dims))
                order = nearest(y, centres, len(centres)).astype(np.int32)
                most = np.maximum((np.cumsum(held[order], axis=1) <= k).sum(1) + 1, probes)
                yield frame.assign(list=[o[:m] for o, m in zip(order, most)], y=list(y))

        more = short.mapInPandas(enough, kind(short)).select("rep", "h", "v", "y", F.explode("list").alias("list"), F.lit(None).cast("double").alias("limit"))
        found = found.join(short.select("rep", "h"), ["rep", "h"], "left_anti").unionByName(searched(common.written(more, "more"), exact=True))
    return vectors.answers(found, queries, k, "double")
