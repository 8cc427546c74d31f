"""Density clustering of locations (C1-C4) and hot zones.

DBSCAN as Spark jobs
--------------------
1. Points are the distinct coordinates with a weight = number of order rows
   at that location (``weighted=True``: every order counts, as when clustering
   the order rows themselves) or 1 (``weighted=False``: distinct sites). They
   are written once.
2. Space is cut into cells of side ``eps / sqrt(d)``, so all points of a cell are
   neighbours (sum of squared differences <= eps^2, inclusive). A cell whose
   weight reaches ``min_samples`` is dense: all its points are core, without a
   comparison. Other cells hold fewer than ``min_samples`` points; only those are
   compared with the points of the cells around, which is linear in the points.
3. The core points of a cell belong together, so clusters are connected components of
   cells. Two cells are linked if a core point of one is a neighbour of one
   of the other: decided from the bounding boxes of 4^d parts of each cell where
   the boxes' largest or smallest distance tells. Parts in between are halved and judged
   again until two of them hold few points, which are then compared.
4. A non-core point takes the smallest label among adjacent core points
   (border), else -1 (noise). Cluster numbers 0..k-1 follow the order of each
   cluster's smallest core coordinates, so results do not depend on input order
   or partitioning.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlens.functions import lloyd
from dispatchlens.functions.graph import components
from dispatchlens.session import written

RESTAURANT_COORDS = ("Restaurant_latitude", "Restaurant_longitude")
#: Pairs of points that two undecided parts may have to be compared point by point, and halvings of a part at most
#: (the grid's numbers stay far from the limits of a long; what is then left lies within 1e-9 of a cell).
POINT_PAIRS, HALVINGS = 1024, 30

DELIVERY_COORDS = ("Delivery_location_latitude", "Delivery_location_longitude")


def _sites(df: DataFrame, cols: Sequence[str], weighted: bool) -> DataFrame:
    base = df.select(*cols).where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in cols]))
    pts = base.groupBy(*cols).agg(F.count(F.lit(1)).alias("weight"))
    if not weighted:
        pts = pts.withColumn("weight", F.lit(1).cast("long"))
    return pts.withColumn("_pid", F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)]))


def _around(d: int, half: bool = False) -> Column:
    """Offsets to the cells that can hold neighbours (``half``: one of each two opposite ones, without the cell itself)."""
    reach = math.ceil(math.sqrt(d))
    every = itertools.product(range(-reach, reach + 1), repeat=d)
    return F.array(*[F.array(*[F.lit(o).cast("long") for o in off]) for off in every if not half or off > (0,) * d])


def _moved(cell: str, offset: Column) -> Column:
    return F.transform(offset, lambda o: F.zip_with(F.col(cell), o, lambda x, y: x + y))


def _within(a: str, b: str, d: int, eps: float) -> Column:
    diff = [F.col(f"{a}{i}") - F.col(f"{b}{i}") for i in range(d)]
    return reduce(lambda x, y: x + y, [x * x for x in diff]) <= eps * eps


def _named(points: DataFrame, cols: Sequence[str], name: str, *keys: str) -> DataFrame:
    return points.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], *[F.col(c).alias(f"{name}{i}") for i, c in enumerate(cols)])


def _boxes(core: DataFrame, cols: Sequence[str], name: str, *more: str) -> DataFrame:
    """Bounding box and number of points of each part of a cell, with columns named after the side of a pair."""
    ends = [f(c).alias(f"{name}_{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]
    keys = ["cell", "part", *more]
    return core.groupBy(*[F.col(c).alias(f"{name}_{c}") for c in keys]).agg(*ends, F.count(F.lit(1)).alias(f"{name}_n"))


def _judged(pairs: DataFrame, d: int, eps: float) -> DataFrame:
    """Pairs of boxes without those too far apart; ``sure``: all their points are neighbours."""
    over = [F.col(f"a_hi{i}") - F.col(f"b_lo{i}") for i in range(d)]
    under = [F.col(f"b_hi{i}") - F.col(f"a_lo{i}") for i in range(d)]
    squares = lambda xs: reduce(lambda x, y: x + y, [x * x for x in xs])
    far = squares([F.greatest(x, y) for x, y in zip(over, under)])
    gap = squares([F.greatest(F.lit(0.0), -x, -y) for x, y in zip(over, under)])
    keep = [f"{n}_{c}" for c in ("cell", "part", "n") for n in "ab"]
    return pairs.where(gap <= eps * eps).select(*keep, (far <= eps * eps).alias("sure"))


def _linked_cells(core: DataFrame, cols: Sequence[str], eps: float, part_side: float) -> DataFrame:
    """Pairs of cells (ca, cb) with neighbouring core points; ``core`` has cell and part.

    Pairs of parts that their boxes don't decide are compared by points where those are few, and else their parts
    are halved along each axis and judged again, so that no two crowded parts meet with all their points."""
    d, links = len(cols), []
    boxes = written(_boxes(core, cols, "b"), "boxes")
    a = boxes.select(*[F.col(c).alias("a" + c[1:]) for c in boxes.columns], F.explode(_moved("b_cell", _around(d, half=True))).alias("b_cell"))
    pairs, points = written(_judged(a.join(boxes, "b_cell"), d, eps), "box-pairs"), core
    for level in itertools.count(1):
        found = pairs.where("sure").select("a_cell", "b_cell").distinct()
        open_ = pairs.where(~F.col("sure")).join(found, ["a_cell", "b_cell"], "left_anti")
        crowded = (F.col("a_n") * F.col("b_n") > POINT_PAIRS) & F.lit(level < HALVINGS)
        sides = [_named(points, cols, n, "cell", "part") for n in "ab"]
        tested = open_.where(~crowded).join(sides[0], ["a_cell", "a_part"]).join(sides[1], ["b_cell", "b_part"])
        links.append(written(found.unionByName(tested.where(_within("a", "b", d, eps)).select("a_cell", "b_cell")).distinct(), "links"))
        many = written(open_.where(crowded).join(links[-1], ["a_cell", "b_cell"], "left_anti").select("a_cell", "b_cell", "a_part", "b_part"), "crowded")
        if many.isEmpty():
            return reduce(DataFrame.unionByName, links).distinct()
        parts = many.select(F.col("a_cell").alias("cell"), F.col("a_part").alias("part")).union(many.select("b_cell", "b_part")).distinct()
        half = part_side / 2**level
        finer = points.join(parts, ["cell", "part"], "left_semi").withColumn("finer", F.array(*[F.floor(F.col(c) / half) for c in cols]))
        points = written(finer, "finer")
        children = [written(_boxes(points, cols, n, "finer"), "boxes") for n in "ab"]
        halves = many.join(children[0], ["a_cell", "a_part"]).join(children[1], ["b_cell", "b_part"])
        pairs = written(_judged(halves.withColumns({f"{n}_part": F.col(f"{n}_finer") for n in "ab"}), d, eps), "box-pairs")
        points = points.withColumn("part", F.col("finer")).drop("finer")


def _numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``name``: the place of each row in the order of the distinct values ``by``, from 0, without one task that sees all rows."""
    dealt = written(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "dealt")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return dealt.withColumn("_own", own).join(base, "_part").withColumn(name, F.col("_own") + F.col("_base")).drop("_part", "_own", "_base")


def dbscan(df: DataFrame, cols: Sequence[str], eps: float, min_samples: int, weighted: bool = True) -> DataFrame:
    """One row per distinct location: coordinates, weight, is_core, cluster
    (-1 = noise)."""
    cols, d = list(cols), len(cols)
    side = eps / math.sqrt(d) * (1 - 1e-9)  # rounding can't bring a cell's points out of reach
    grid = lambda s: F.array(*[F.floor(F.col(c) / s) for c in cols])
    pts = written(_sites(df, cols, weighted).withColumns({"cell": grid(side), "part": grid(side / 4)}), "sites")
    cells = written(pts.groupBy("cell").agg((F.sum("weight") >= min_samples).alias("dense")), "cells")
    placed = pts.join(cells, "cell")
    sparse = placed.where(~F.col("dense"))
    left = sparse.select(F.col("_pid").alias("a_pid"), *[F.col(c).alias(f"a{i}") for i, c in enumerate(cols)], F.explode(_moved("cell", _around(d))).alias("cell"))
    right = pts.select(F.col("_pid").alias("b_pid"), "weight", "cell", *[F.col(c).alias(f"b{i}") for i, c in enumerate(cols)])
    near = written(left.join(right, "cell").where(_within("a", "b", d, eps)).select("a_pid", "b_pid", "weight"), "near")
    reached = near.groupBy(F.col("a_pid").alias("_pid")).agg(F.sum("weight").alias("_w")).where(F.col("_w") >= min_samples).select("_pid")
    keep = ["_pid", *cols, "cell", "part"]
    core = written(placed.where("dense").select(*keep).unionByName(sparse.join(reached, "_pid", "left_semi").select(*keep)), "core")
    roots = components(_linked_cells(core, cols, eps, side / 4), "a_cell", "b_cell").withColumnRenamed("x", "cell")
    firsts = core.groupBy("cell").agg(F.min("_pid").alias("first")).join(roots, "cell", "left").withColumn("root", F.coalesce("root", "cell"))
    clusters = _numbered(firsts.groupBy("root").agg(F.min("first").alias("first")), "first", "cluster")
    numbers = written(firsts.select("cell", "root").join(clusters.select("root", F.col("cluster").cast("int").alias("cluster")), "root").select("cell", "cluster"), "numbers")
    labelled = core.join(numbers, "cell").select("_pid", "cluster")
    border = near.join(labelled.withColumnRenamed("_pid", "b_pid"), "b_pid").groupBy(F.col("a_pid").alias("_pid")).agg(F.min("cluster").alias("_edge"))
    out = pts.join(labelled.withColumn("is_core", F.lit(True)), "_pid", "left").join(border, "_pid", "left")
    # written once, so that every consumer reads it
    return written(out.select(
        *cols, "weight",
        F.coalesce("is_core", F.lit(False)).alias("is_core"),
        F.coalesce("cluster", "_edge", F.lit(-1)).cast("int").alias("cluster"),
    ), "clusters")


def reassign_noise(labels: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """K-means (k=5, see :mod:`functions.lloyd`) over the noise locations (weighted by rows); their
    labels continue after the largest cluster id (from 0 without clusters).
    Fewer than k noise rows: noise stays -1."""
    noise = labels.where(F.col("cluster") == -1)
    stats = labels.agg(
        F.sum(F.when(F.col("cluster") == -1, F.col("weight"))).alias("n_noise"),
        F.max(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("max_label"),
    ).first()
    if not stats["n_noise"] or stats["n_noise"] < k:
        return labels
    offset = 0 if stats["max_label"] is None else stats["max_label"] + 1
    weight = F.col("weight").cast("double")
    centres = lloyd.fit(noise, cols, {k: lloyd.farthest_first(noise, cols, k, weight)}, weight)[k]
    return labels.withColumn("cluster", F.when(F.col("cluster") == -1, lloyd.nearest(cols, centres) + offset).otherwise(F.col("cluster")))


def cluster_labels_join(facts: DataFrame, labels: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Attach each row's location cluster; rows without one get -1."""
    lab = labels.select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(cols)], F.col("cluster").alias(name))
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_l{i}") for i, c in enumerate(cols)])
    out = facts.join(lab, cond, "left").drop(*[f"_l{i}" for i in range(len(cols))])
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(-1)))


def with_location_clusters(
    facts: DataFrame,
    eps: float = 0.02,
    min_samples: int = 5,
    restaurant_cols: Sequence[str] = RESTAURANT_COORDS,
    delivery_cols: Sequence[str] = DELIVERY_COORDS,
    weighted: bool = True,
    reassign: bool = True,
) -> DataFrame:
    """Restaurant_Cluster, Delivery_Cluster and Route_Type columns.
    Pass the four coordinates as both column lists to reproduce clustering on
    all four at once."""
    out = facts
    for cols, name in ((restaurant_cols, "Restaurant_Cluster"), (delivery_cols, "Delivery_Cluster")):
        lab = dbscan(facts, cols, eps, min_samples, weighted)
        if reassign:
            lab = reassign_noise(lab, cols)
        out = cluster_labels_join(out, lab, cols, name)
    return out.withColumn(
        "Route_Type", F.concat_ws("_", F.col("Restaurant_Cluster").cast("string"), F.col("Delivery_Cluster").cast("string"))
    )


def hotspots(facts: DataFrame, cols: Sequence[str], eps: float = 0.01, min_samples: int = 10) -> DataFrame:
    """Order-weighted DBSCAN on 2-D coordinates; centroid and order count
    of every non-noise cluster."""
    lab = dbscan(facts, cols, eps, min_samples, weighted=True).where(F.col("cluster") >= 0)
    lat, lon = cols
    return lab.groupBy("cluster").agg(
        (F.sum(F.col(lat) * F.col("weight")) / F.sum("weight")).alias("latitude"),
        (F.sum(F.col(lon) * F.col("weight")) / F.sum("weight")).alias("longitude"),
        F.sum("weight").alias("count"),
    ).orderBy("cluster")


def pickup_hotspots(facts: DataFrame) -> DataFrame:
    return hotspots(facts, RESTAURANT_COORDS)


def dropoff_hotspots(facts: DataFrame) -> DataFrame:
    return hotspots(facts, DELIVERY_COORDS)


def hotspot_center(facts: DataFrame, pickup: DataFrame | None = None, dropoff: DataFrame | None = None) -> DataFrame:
    """T4: map centre = mean of the pickup and drop-off centroid means (of the
    hot spots given, or computed from the facts)."""
    p = (pickup_hotspots(facts) if pickup is None else pickup).agg(F.avg("latitude").alias("plat"), F.avg("longitude").alias("plon"))
    d = (dropoff_hotspots(facts) if dropoff is None else dropoff).agg(F.avg("latitude").alias("dlat"), F.avg("longitude").alias("dlon"))
    return p.crossJoin(d).select(
        ((F.col("plat") + F.col("dlat")) / 2.0).alias("center_latitude"),
        ((F.col("plon") + F.col("dlon")) / 2.0).alias("center_longitude"),
    )


def restaurant_sites(facts: DataFrame) -> DataFrame:
    """C1 on restaurant locations, every order a point (eps 0.02, min 5)."""
    return dbscan(facts, RESTAURANT_COORDS, 0.02, 5, weighted=True)


def restaurant_sites_distinct(facts: DataFrame) -> DataFrame:
    """C1 on distinct restaurant sites (eps 0.01, min 10): exercises border and noise."""
    return dbscan(facts, RESTAURANT_COORDS, 0.01, 10, weighted=False)


def delivery_sites(facts: DataFrame) -> DataFrame:
    """C1 on delivery locations, every order a point (eps 0.02, min 5)."""
    return dbscan(facts, DELIVERY_COORDS, 0.02, 5, weighted=True)
