import random

import numpy as np
import pytest
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from dispatchlens.functions import boosting
from dispatchlens.session import written


def inputs(spark, n, parts):
    rnd = random.Random(n)
    rows = [(rnd.gauss(0, 1), float(rnd.randint(0, 40)), rnd.choice([0.0, 1.0]), rnd.randint(0, 4), 1.0) for _ in range(n)]
    table = spark.createDataFrame([(*r, 3 * r[0] * r[2] + r[1] % 7 + (r[3] == 2) + rnd.gauss(0, 1)) for r in rows], "a double, b double, c double, kind int, same double, y double").repartition(parts)
    table = OneHotEncoder(inputCols=["kind"], outputCols=["v"], dropLast=False).fit(table).transform(table)
    table = VectorAssembler(inputCols=["a", "b", "c", "same", "v"], outputCol="features").transform(table)
    return written(table.select("features", "y"), "boosting-test")


@pytest.mark.parametrize(("n", "parts", "depth"), [(3000, 3, 4), (40, 2, 5), (12_000, 1, 3)])
def test_trees_equal_the_estimators(spark, n, parts, depth):
    rows = inputs(spark, n, parts)
    estimator = GBTRegressor(labelCol="y", maxIter=6, stepSize=0.3, maxDepth=depth, seed=5)
    want, got = estimator.fit(rows), boosting.fit(estimator, rows)
    assert [t.numNodes for t in want.trees] == [1 + 2 * len(t.gain) for t in got.trees]
    assert np.allclose(want.featureImportances.toArray(), got.featureImportances.toArray(), atol=1e-9)
    scored = zip(want.transform(rows).select("y", "prediction").collect(), got.transform(rows).collect())
    assert max(abs(a.prediction - b.prediction) + abs(a.y - b.y) for a, b in scored) < 1e-9


def test_equal_labels_and_equal_inputs_give_single_leaves(spark):
    for label, value, mean in ((F.lit(2.5), F.col("id"), 2.5), (F.col("id") % 2, F.lit(1), 0.5)):
        table = spark.range(20).select(value.cast("double").alias("a"), label.cast("double").alias("y"))
        rows = written(VectorAssembler(inputCols=["a"], outputCol="features").transform(table).select("features", "y"), "boosting-test")
        got = boosting.fit(GBTRegressor(labelCol="y", maxIter=3, maxDepth=3), rows)
        assert all(not t.gain for t in got.trees) and got.featureImportances.toArray().tolist() == [0.0]
        assert {round(r.prediction, 9) for r in got.transform(rows).collect()} == {mean}


def test_a_round_reads_its_rows_in_a_task_a_core(spark):
    """A fit's jobs have as many tasks as there are cores, not as many as the table has files."""
    cores, tracker = spark.sparkContext.defaultParallelism, spark.sparkContext.statusTracker()
    rows = inputs(spark, 2000, 5 * cores)
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a file a partition
    spark.sparkContext.setJobGroup("boosting-fit", "")
    try:
        boosting.fit(GBTRegressor(labelCol="y", maxIter=4, maxDepth=5), rows)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.sparkContext._jsc.clearJobGroup()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("boosting-fit") for s in tracker.getJobInfo(j).stageIds]
    tasks = [s.numTasks for s in stages if s]
    assert max(tasks) == 5 * cores and len(tasks) > 15 and sorted(tasks)[len(tasks) // 2] <= cores
