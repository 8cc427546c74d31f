"""Steps whose cost a row or whose parallelism once grew badly with the tables."""

import random
from collections import Counter

from pyspark.sql import functions as F

from dispatchlens.functions import lloyd
from dispatchlens.operators import customers as U


def test_nearest_centres_are_plain_sums(spark):
    """No lambda is evaluated value by value, neither for the labels nor in the rounds; labels are those of exact distances."""
    rnd = random.Random(5)
    rows = [tuple(rnd.uniform(-3, 3) for _ in range(7)) for _ in range(200)]
    cols = [f"x{i}" for i in range(7)]
    points, centres = spark.createDataFrame(rows, cols), rows[:10]
    labelled = points.withColumn("c", lloyd.nearest(cols, centres))
    assert "lambda" not in labelled._jdf.queryExecution().analyzed().toString()
    exact = [min(range(10), key=lambda k: sum((a - b) ** 2 for a, b in zip(r, centres[k]))) for r in rows]
    assert [r.c for r in labelled.collect()] == exact
    folded, lloyd.PLAIN_COLUMNS = lloyd.PLAIN_COLUMNS, 3
    try:
        assert [r.c for r in points.withColumn("c", lloyd.nearest(cols, centres)).collect()] == exact
    finally:
        lloyd.PLAIN_COLUMNS = folded


def test_modes_are_counted_in_fixed_width(spark):
    rnd = random.Random(6)
    pick = lambda n: rnd.choice([None, *(f"v{i:02d}" for i in range(n))])
    rows = [(rnd.choice(["a", "b", "c", None]), pick(3), pick(2), pick(40), 1.0, 2.0, 3.0, f"o{i}") for i in range(300)] + [("d", None, None, None, 1.0, 2.0, 3.0, "o")]
    facts = spark.createDataFrame(rows, "Customer_ID string, Type_of_order string, Type_of_vehicle string, City string, Distance_km double, Time_taken_min double, Profit double, Order_ID string")
    few = U.customer_profile(facts.withColumn("City", F.col("Type_of_order")))
    assert "ObjectHashAggregate" not in few._jdf.queryExecution().executedPlan().toString()

    def mode(customer, i):
        n = Counter(r[i] for r in rows if r[0] == customer and r[i] is not None)
        return min(n, key=lambda v: (-n[v], v)) if n else None

    got = {r.Customer_ID: (r.Type_of_order, r.Type_of_vehicle, r.City) for r in U.customer_profile(facts).collect()}
    assert got == {c: tuple(mode(c, i) for i in (1, 2, 3)) for c in "abcd"}
