"""Exact top-k search by inner product with pivot-table elimination.

Largest inner product becomes nearest neighbour: candidates get one more component that
brings all to the same length M, queries get a zero there; then |q - x|^2 = |q|^2 + M^2 - 2 q.x.
Distances of every vector to many pivots are computed once and kept as columns. By the
triangle inequality the largest difference over the pivots is a lower bound of the
distance between query and candidate. Candidates are evaluated in the order of their bounds
until the next bound shows that no other can reach the answer.

Candidates lie in blocks by their nearest pivots. A block's smallest and largest distances to each pivot
bound all of it, so a query is first compared with its most promising block, and then sent only to
blocks whose bound reaches the scores found there. Where vectors are spread evenly few blocks
fall away; then the exchange is bounded by the candidates times the blocks of ``ASKED`` queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlens.llm import common, vectors

#: Rows among which pivots are chosen, at most about.
PIVOT_SAMPLE = 2000
#: Candidates evaluated between two looks at the bound.
STEP = 256
#: Query vectors that one task holds (compared ``vectors.QUERIES`` at a time), and blocks whose intervals it holds.
ASKED, INTERVALS = 16384, 4096


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal: each pivot is the sampled point farthest from those before."""
    if not len(sample):
        return sample
    at = [int(np.argmax((sample**2).sum(1)))]
    near = ((sample - sample[at[0]]) ** 2).sum(1)
    while len(at) < min(n, len(sample)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[at[-1]]) ** 2).sum(1))
    return sample[at]


def lifted(x: np.ndarray, longest2: float) -> np.ndarray:
    """Candidates with the component that gives all the squared length ``longest2``."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, longest2 - (x**2).sum(1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T))


def reachable(query_length2: np.ndarray, longest2: float, bound: np.ndarray) -> np.ndarray:
    """The largest inner products that lower bounds of the distances allow; a little slack covers what rounding took from them."""
    length2 = query_length2[:, None] + longest2
    return (length2 - np.square(np.maximum(0.0, bound - 1e-6 * np.sqrt(length2)))) / 2 + 1e-6 * length2


def outside(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row of distances ``own`` to the pivots and each interval of distances the largest gap over the pivots; a point is an interval of one value."""
    bound = np.zeros((len(own), len(low)))
    for p in range(own.shape[1]):
        np.maximum(bound, np.maximum(low[None, :, p] - own[:, p, None], own[:, p, None] - high[None, :, p]), out=bound)
    return bound


def best(query: np.ndarray, reach: np.ndarray, candidates: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of a block's ``k`` candidates with the largest inner products (all that tie with the last), of those from ``floor`` on.

    ``reach``: for each candidate the largest inner product that its bound allows.
    """
    order = np.argsort(-reach, kind="stable")
    places, scores = np.zeros(0, np.int64), np.zeros(0, candidates.dtype)
    for first in range(0, len(order), STEP):
        if reach[order[first]] < floor:
            break
        now = order[first : first + STEP]
        places, scores = np.concatenate([places, now]), np.concatenate([scores, candidates[now] @ query])
        if len(scores) >= k:
            last = np.partition(scores, -k)[-k]
            stay = scores >= last
            places, scores, floor = places[stay], scores[stay], max(floor, last)
    return places[scores >= floor], scores[scores >= floor]


def numbered_blocks(known: DataFrame) -> DataFrame:
    """``known`` with ``cb``: one block for each nearest pivot, or, where that has more than a block's rows, for
    each nearest pair of pivots, dealt by hash into as many blocks as their rows fill."""
    sizes = known.groupBy("cell", "second").count().collect()  # at most a row for each pair of pivots
    whole = {}
    for r in sizes:
        whole[r["cell"]] = whole.get(r["cell"], 0) + r["count"]
    numbers, first, together = [], 0, {}
    for r in sizes:
        cell, size = r["cell"], r["count"]
        if whole[cell] <= vectors.CANDIDATES and cell in together:
            numbers.append((cell, r["second"], together[cell], 1))
            continue
        parts = 1 if whole[cell] <= vectors.CANDIDATES else -(-size // vectors.CANDIDATES)
        numbers.append((cell, r["second"], first, parts))
        together[cell] = first
        first += parts
    table = known.sparkSession.createDataFrame(numbers, "cell int, second int, start long, parts int")
    return known.join(F.broadcast(table), ["cell", "second"]).withColumn("cb", F.col("start") + vectors.block(F.col("parts"))).drop("cell", "second", "start", "parts")


def pivot_search(rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int = 32) -> DataFrame:
    """The ``k`` rows of largest inner product for each row of ``rows(vec_id, embedding)`` whose vec_id is divisible by ``every``.

    Components are first turned into ``floor(scale * x)``; scores are exact integers (below
    2**63). All rows but the query's own are candidates (fewer than ``k``: all); ties go to the smaller
    vec_id. Returns ``query_id, rank, vec_id, score``.

    Null ids and vectors that are null, empty or hold null or non-finite components take
    no part; vectors of different lengths are compared as if filled with zeros; rows that repeat id and
    vector count once; other columns are not read; an empty table gives no rows.

    Equal vectors are one candidate and one query (:func:`vectors.distinct_vectors`). Candidates and queries
    meet in blocks of bounded size, one task each; only the pivots, two maxima and the sizes of the pivots'
    cells reach the driver. The result doesn't depend on the pivots.
    """
    own = vectors.usable(rows)
    own = common.written(own.withColumn("v", F.transform("v", lambda x: F.floor(x * float(scale)))), "vectors")
    data = common.written(vectors.distinct_vectors(own, k), "distinct")
    queries = common.written(vectors.query_vectors(own, data, every), "queries")
    facts = data.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("longest2")).first()
    n, dims, longest2 = facts["n"], facts["dims"] or 1, facts["longest2"] or 0.0
    sample = data.filter(common.hash_fraction("h", "rep") < PIVOT_SAMPLE / max(n, 1)).select("v").toPandas()
    points = choose_pivots(lifted(vectors.matrix(sample["v"], dims), longest2), pivots)
    points = points if len(points) else np.zeros((1, dims + 1))

    def with_table(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = vectors.matrix(frame["v"], dims)
            table = distances(lifted(x, longest2), points)
            near = np.argsort(table, axis=1, kind="stable")[:, [0, min(1, len(points) - 1)]]
            yield frame.assign(as_candidate=list(table), as_query=list(distances(np.column_stack([x, np.zeros(len(x))]), points)), cell=near[:, 0], second=near[:, 1])

    kind = ", ".join(f"{c} {t}" for c, t in data.dtypes)
    known = common.written(data.mapInPandas(with_table, f"{kind}, as_candidate array<double>, as_query array<double>, cell int, second int"), "pivots")
    asked = queries.select("rep", "h").distinct()
    questions = common.written(known.join(asked, ["rep", "h"]).select("rep", "h", "v", "as_query"), "questions")
    candidates = common.written(numbered_blocks(known).select("cb", "v", "ids", "as_candidate"), "blocks")
    ends = lambda f: F.array(*[f(F.col("as_candidate")[i]) for i in range(len(points))])
    intervals = common.written(candidates.groupBy("cb").agg(ends(F.min).alias("low"), ends(F.max).alias("high")), "intervals")
    kb, qb = -(-intervals.count() // INTERVALS) or 1, -(-questions.count() // ASKED) or 1
    at_once = vectors.QUERIES
    every_block = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def pairs(questions: DataFrame, first: bool) -> DataFrame:
        """``rep, h, cb, reach`` of the most promising block (of some) for each query, or of all others that reach ``least``."""

        def bounded(blocks: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            out = []
            low, high, cb = (np.stack(blocks[c]) if len(blocks) else np.zeros((0, len(points))) for c in ("low", "high", "cb"))
            for i in range(0, len(asking) if len(blocks) else 0, at_once):
                some = asking.iloc[i : i + at_once]
                length2 = (vectors.matrix(some["v"], dims) ** 2).sum(1)
                reach = reachable(length2, longest2, outside(np.stack(some["as_query"]), low, high))
                if first:
                    at, to = np.arange(len(some)), reach.argmax(1)
                else:
                    at, to = np.nonzero((reach >= some["least"].fillna(-np.inf).to_numpy()[:, None]) & (cb[None, :] != some["home"].to_numpy()[:, None]))
                out.append(pd.DataFrame({"rep": some["rep"].to_numpy()[at], "h": some["h"].to_numpy()[at], "cb": cb[to], "reach": reach[at, to]}))
            return pd.concat(out) if out else pd.DataFrame({"rep": [], "h": [], "cb": [], "reach": []})

        left = intervals.withColumns({"kb": vectors.block_of(kb, "cb"), "qb": every_block(qb)})
        right = questions.withColumns({"qb": vectors.block(qb), "kb": every_block(kb)})
        return left.groupBy("kb", "qb").cogroup(right.toDF(*right.columns).groupBy("kb", "qb")).applyInPandas(bounded, "rep long, h long, cb long, reach double")

    def search(x_rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        x = vectors.matrix(x_rows["v"], dims, np.int64)
        table = np.stack(x_rows["as_candidate"]) if len(x) else None
        firsts = np.array([ids[0] for ids in x_rows["ids"]], np.int64)
        for i in range(0, len(asking) if len(x) else 0, at_once):
            some = asking.iloc[i : i + at_once]
            q = vectors.matrix(some["v"], dims, np.int64)
            reach = reachable((q.astype(np.float64) ** 2).sum(1), longest2, outside(np.stack(some["as_query"]), table, table))
            for j, (rep, h, least) in enumerate(zip(some["rep"], some["h"], some["least"].fillna(-np.inf))):
                places, scores = best(q[j], reach[j], x, k + 1, least)
                nearest = np.lexsort((firsts[places], -scores))[: k + 1]  # of equal scores those with the smallest ids
                out += [(rep, h, x_rows["ids"].iloc[c], s) for c, s in zip(places[nearest].tolist(), scores[nearest].tolist())]
        return pd.DataFrame(out, columns=["rep", "h", "ids", "score"])

    def searched(asking: DataFrame) -> DataFrame:
        """Compare queries with the blocks ``cb`` they ask for; a block goes to as many tasks as its queries need, and to none without one."""
        tasks = asking.groupBy("cb").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("tasks"))
        left = candidates.join(tasks, "cb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
        right = asking.join(tasks, "cb").withColumn("qb", vectors.block(F.col("tasks"), "cb")).drop("tasks")
        return left.groupBy("cb", "qb").cogroup(right.toDF(*right.columns).groupBy("cb", "qb")).applyInPandas(search, "rep long, h long, ids array<long>, score long")

    none = F.lit(None).cast("double").alias("least")
    home = common.written(pairs(questions, True).groupBy("rep", "h").agg(F.max_by("cb", "reach").alias("home")), "home")
    at_home = common.written(searched(questions.join(home, ["rep", "h"]).select("*", F.col("home").alias("cb"), none)), "at-home")
    enough = F.when(F.count(F.lit(1)) > k, F.min("score") - F.abs(F.min("score")) * 1e-12).alias("least")  # of k + 1, as one row may be the query's own; what doubles lose is let through
    started = common.written(questions.join(home, ["rep", "h"]).join(at_home.groupBy("rep", "h").agg(enough), ["rep", "h"], "left"), "started")
    further = common.written(pairs(started, False).select("rep", "h", "cb"), "further")
    found = at_home.unionByName(searched(further.join(started, ["rep", "h"])))
    return vectors.answers(found, queries, k, "long")
