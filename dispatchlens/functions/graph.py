"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlens.session import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(x, root)`` for every end of an edge ``(a, b)``; the root is the component's smallest node.

    Each round hooks a node and its present root onto the smallest root in its neighbourhood and then
    follows the root's own root, so trees at least halve in depth while they merge; rounds grow with
    the logarithm of a component's size. Every round is written to the shared folder, and it ends
    when no root changes. Hooks onto a busy root are aggregated before the shuffle.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y")))
    both = written(both.filter("x <> y").distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("root")), "roots")
    while True:
        near = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("root").alias("near"))
        seen = written(labels.join(near, "x"), "roots")
        hooks = seen.select("x", "near").unionByName(seen.select(F.col("root").alias("x"), "near")).groupBy("x").agg(F.min("near").alias("near"))
        step = written(labels.join(hooks, "x").select("x", F.col("root").alias("was"), F.least("root", "near").alias("mid")), "roots")
        above = step.select(F.col("x").alias("mid"), F.col("mid").alias("top"))
        new = written(step.join(above, "mid").select("x", "was", F.least("mid", "top").alias("root")), "roots")
        labels = new.select("x", "root")
        if not new.filter("was <> root").limit(1).count():
            return labels
