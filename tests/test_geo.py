import random

import pandas as pd
from pyspark.sql import functions as F

from dispatchlens.functions.graph import components
from dispatchlens.operators import geo
from dispatchlens.operators.geo import dbscan


def _shapes():
    pts = []
    pts += [(0.0 + 0.001 * i, 0.0) for i in range(6)]          # blob A (chain)
    pts += [(1.0, 1.0 + 0.001 * i) for i in range(6)]          # blob B
    pts += [(0.0065, 0.0)]                                     # near a border point only: noise
    pts += [(5.0, 5.0)]                                        # noise
    return pd.DataFrame(pts, columns=["x", "y"])


def test_dbscan_shapes(spark):
    df = spark.createDataFrame(_shapes())
    lab = {(r.x, r.y): r for r in dbscan(df, ["x", "y"], 0.0012, 3, weighted=False).collect()}
    a = {lab[(0.001 * i, 0.0)].cluster for i in range(6)}
    b = {lab[(1.0, 1.0 + 0.001 * i)].cluster for i in range(6)}
    assert a == {0} and b == {1}
    # chain ends have 2 neighbours (< 3): border points of A; inner points are core
    assert lab[(0.0, 0.0)].is_core is False and lab[(0.0, 0.0)].cluster == 0
    assert lab[(0.001 * 5, 0.0)].is_core is False and lab[(0.001 * 5, 0.0)].cluster == 0
    assert lab[(0.001 * 2, 0.0)].is_core is True
    assert lab[(0.0065, 0.0)].cluster == -1
    assert lab[(5.0, 5.0)].cluster == -1


def test_dbscan_invariant_to_order_and_partitions(spark):
    pdf = _shapes()
    a = dbscan(spark.createDataFrame(pdf), ["x", "y"], 0.0012, 3, weighted=False)
    b = dbscan(spark.createDataFrame(pdf.iloc[::-1]).repartition(7), ["x", "y"], 0.0012, 3, weighted=False)
    key = lambda d: sorted(tuple(r) for r in d.select("x", "y", "cluster", "is_core").collect())
    assert key(a) == key(b)


def test_weighted_counts_rows(spark):
    pdf = pd.DataFrame([(0.0, 0.0)] * 5 + [(3.0, 3.0)], columns=["x", "y"])
    lab = {(r.x, r.y): r.cluster for r in dbscan(spark.createDataFrame(pdf), ["x", "y"], 0.01, 5).collect()}
    assert lab[(0.0, 0.0)] == 0 and lab[(3.0, 3.0)] == -1


def _brute(points, eps, min_samples):
    """Labels by the definition: core flags, and clusters as sets of core points."""
    near = {i: [j for j, q in enumerate(points) if (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) <= eps * eps] for i, p in enumerate(points)}
    core = {i for i in near if len(near[i]) >= min_samples}
    label, groups = {}, []
    for i in sorted(core, key=points.__getitem__):
        if i not in label:
            todo, label[i] = [i], len(groups)
            groups.append(i)
            while todo:
                for j in near[todo.pop()]:
                    if j in core and j not in label:
                        label[j] = label[i]
                        todo.append(j)
    return {points[i]: (i in core, label[i] if i in core else min((label[j] for j in near[i] if j in core), default=-1)) for i in near}


def test_dbscan_against_the_definition(spark):
    rnd = random.Random(11)
    for spread, n in ((1.0, 250), (0.3, 300), (3.0, 200)):
        points = list({(round(rnd.gauss(0, spread), 2), round(rnd.gauss(0, spread), 2)) for _ in range(n)})
        got = dbscan(spark.createDataFrame(points, "x double, y double"), ["x", "y"], 0.1, 4, weighted=False)
        assert {(r.x, r.y): (r.is_core, r.cluster) for r in got.collect()} == _brute(points, 0.1, 4)


def test_crowded_parts_are_halved_until_few_points_meet(spark, monkeypatch):
    monkeypatch.setattr(geo, "POINT_PAIRS", 4)
    rnd = random.Random(7)
    # two crowds about eps apart, whose boxes can't tell; in the second case only one point reaches over
    for shift, bridge in ((0.1, []), (0.1151, []), (0.1151, [(0.0155, 0.0)])):
        left = {(round(rnd.uniform(0, 0.015), 4), round(rnd.uniform(0, 0.05), 4)) for _ in range(150)}
        right = {(round(x + shift, 4), y) for x, y in left}
        points = sorted(left | right | set(bridge) | {(3.0, 3.0)})
        got = dbscan(spark.createDataFrame(points, "x double, y double"), ["x", "y"], 0.1, 4, weighted=False)
        assert {(r.x, r.y): (r.is_core, r.cluster) for r in got.collect()} == _brute(points, 0.1, 4)


def test_long_chain_is_one_cluster(spark):
    order = list(range(2000))
    random.Random(5).shuffle(order)
    chain = [(float(i), float(order[i] % 2) * 0.1) for i in range(2000)]
    got = dbscan(spark.createDataFrame(chain, "x double, y double"), ["x", "y"], 1.1, 2, weighted=False)
    assert [(r.cluster, r["count"]) for r in got.groupBy("cluster").count().collect()] == [(0, 2000)]


def test_many_points_in_one_cell(spark):
    rows = spark.range(50_000).select((F.col("id") / 50_000.0 * 0.5).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 2000.0).alias("y"))
    got = dbscan(rows, ["x", "y"], 1.0, 10, weighted=False)
    assert [(r.cluster, r.is_core, r["count"]) for r in got.groupBy("cluster", "is_core").count().collect()] == [(0, True, 50_000)]


def test_components_of_shuffled_chain(spark):
    nodes = list(range(500))
    random.Random(3).shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes[:300], nodes[1:300])) + list(zip(nodes[300:], nodes[301:])), "a long, b long")
    got = {r.x: r.root for r in components(edges, "a", "b").collect()}
    assert got == {n: min(part) for part in (nodes[:300], nodes[300:]) for n in part}
