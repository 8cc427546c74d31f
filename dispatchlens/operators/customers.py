"""Customer profiles, RFM and segmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlens.functions import lloyd
from dispatchlens.functions.shapes import epoch_seconds
from dispatchlens.params import MIN_GROUP_ROWS  # noqa: F401  (shared gate)
from dispatchlens.session import written

#: Values of a category that become columns, at most.
MAX_LEVELS = 200
#: Values of a category that are counted in columns of their own, at most.
MODE_LEVELS = 16


def _cust(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("Customer_ID").isNotNull())


def _modes(facts: DataFrame, cats: Sequence[str]) -> dict[str, Column]:
    """The most frequent value of each column (smallest on ties; null without one) as an aggregate.

    Strings with few values have a plain counter for each, so that the partial sums are rows of fixed width; ``mode``, whose
    state is a table for each group that is sorted and spilled as soon as many groups meet in a task, counts the others."""
    strings = {c for c, kind in facts.dtypes if kind == "string"}
    out = {}
    for c in cats:
        # a scan of one column; at most MODE_LEVELS + 1 values reach the driver
        found = facts.select(c).where(F.col(c).isNotNull()).distinct().limit(MODE_LEVELS + 1).collect() if c in strings else []
        levels = sorted(r[0] for r in found)
        if c not in strings or len(levels) > MODE_LEVELS:
            out[c] = F.mode(c, True)
            continue
        counts = [F.count_if(F.col(c) == v) for v in levels]
        most = F.greatest(F.lit(1), F.lit(1), *counts)
        out[c] = F.coalesce(F.lit(None).cast("string"), *[F.when(n == most, F.lit(v)) for n, v in zip(counts, levels)])
    return out


def customer_profile(facts: DataFrame) -> DataFrame:
    """Per customer: most frequent order type, vehicle and city (smallest
    value on ties), mean distance/time/profit and order count. One counter per
    distinct category value, so the state is bounded by the
    category cardinality, not by the customer's order count."""
    f = _cust(facts)
    return f.groupBy("Customer_ID").agg(
        *[mode.alias(c) for c, mode in _modes(f, ["Type_of_order", "Type_of_vehicle", "City"]).items()],
        F.avg("Distance_km").alias("Distance_km"),
        F.avg("Time_taken_min").alias("Time_taken_min"),
        F.avg("Profit").alias("Profit"),
        F.count("Order_ID").alias("Order_Count"),
    )


def customer_rfm(facts: DataFrame) -> DataFrame:
    """U1 + U2: per customer order count, profit sum/mean, distance mean/max,
    time mean/sum, mean rating, distinct restaurants, modal order type, whole
    days since the last order (against the latest order overall), lifetime
    days and orders per month = n / (lifetime / 30 + 0.01)."""
    f = _cust(facts)
    ts = epoch_seconds("Order_Datetime", f.schema["Order_Datetime"].dataType)
    f = f.withColumn("_ts", ts)
    latest = f.select(F.max("_ts")).scalar()
    g = f.groupBy("Customer_ID").agg(
        F.count("Order_ID").alias("order_count"),
        F.sum("Profit").alias("total_profit"),
        F.avg("Profit").alias("avg_profit_per_order"),
        F.avg("Distance_km").alias("avg_distance"),
        F.max("Distance_km").alias("max_distance"),
        F.avg("Time_taken_min").alias("avg_delivery_time"),
        F.sum("Time_taken_min").alias("total_delivery_time"),
        F.avg("Delivery_person_Ratings").alias("avg_rating"),
        F.countDistinct("Restaurant_ID").alias("unique_restaurants"),
        _modes(f, ["Type_of_order"])["Type_of_order"].alias("most_common_order_type"),
        F.max("_ts").alias("_last"),
        F.min("_ts").alias("_first"),
    )
    life = F.floor((F.col("_last") - F.col("_first")) / 86400.0)
    return g.select(
        "Customer_ID", "order_count", "total_profit", "avg_profit_per_order", "avg_distance", "max_distance",
        "avg_delivery_time", "total_delivery_time", "avg_rating", "unique_restaurants", "most_common_order_type",
        F.floor((latest - F.col("_last")) / 86400.0).cast("long").alias("days_since_last_order"),
        life.cast("long").alias("customer_lifetime_days"),
        (F.col("order_count") / (life / 30.0 + 0.01)).alias("orders_per_month"),
    )


# The features that customers are clustered by.
CLUSTER_FEATURES = (
    "order_count", "avg_profit_per_order", "avg_distance", "avg_delivery_time", "unique_restaurants",
    "days_since_last_order", "orders_per_month",
)


def standardized(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` without rows that lack a feature, and ``_z_<feature>`` columns standardised by the
    population deviation (zeros for a constant). The statistics are one aggregate row, broadcast."""
    d = df.dropna(subset=list(features))
    st = d.agg(*[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_pop(c).alias(f"_s_{c}") for c in features])
    cols = [
        F.when(F.col(f"_s_{c}") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(f"_z_{c}")
        for c in features
    ]
    return d.crossJoin(F.broadcast(st)).select(*df.columns, *cols)


def kmeans_elbow(rfm: DataFrame, features: Sequence[str] = CLUSTER_FEATURES, max_k: int = 10, rounds: int = lloyd.ROUNDS):
    """Within-cluster sum of squares for k = 1..min(10, n-1) and the elbow
    k* = argmin |second difference| + 2 (3 with fewer than 3 points). Returns
    (DataFrame(k, wcss, is_optimal), k*, (standardised points, centres by k)).

    All k share the farthest-first start and every round's scan of the points."""
    points, cols = written(standardized(rfm, features), "vectors"), [f"_z_{c}" for c in features]
    kmax = min(max_k, points.count() - 1)
    start = lloyd.farthest_first(points, cols, kmax)
    centres = lloyd.fit(points, cols, {k: start[:k] for k in range(1, kmax + 1)}, rounds=rounds)
    sums = lloyd.within(points, cols, centres)
    wcss = [sums[k] for k in sorted(sums)]
    if len(wcss) >= 3:
        d1 = [b - a for a, b in zip(wcss, wcss[1:])]
        d2 = [round(abs(b - a), 9) for a, b in zip(d1, d1[1:])]
        k_star = int(min(range(len(d2)), key=lambda i: d2[i])) + 2
    else:
        k_star = 3
    spark = rfm.sparkSession
    table = spark.createDataFrame([(k + 1, w, k + 1 == k_star) for k, w in enumerate(wcss)], "k int, wcss double, is_optimal boolean")
    return table, k_star, (points, centres)


def customer_clusters(rfm: DataFrame, k: int | None = None, features: Sequence[str] = CLUSTER_FEATURES, elbow=None):
    """U4: K-means at k (the elbow's k* when None); returns per-customer labels. ``elbow``: what
    :func:`kmeans_elbow` returned, where it has been computed already."""
    if k is None or elbow is not None:
        _, best, (points, centres) = elbow or kmeans_elbow(rfm, features)
        k = k or best
    else:
        points, centres = written(standardized(rfm, features), "vectors"), {}
    cols = [f"_z_{c}" for c in features]
    if k not in centres:
        centres = lloyd.fit(points, cols, {k: lloyd.farthest_first(points, cols, k)})
    cluster = lloyd.nearest(cols, centres[k]) if centres[k] else F.lit(0)
    return points.withColumn("Cluster", cluster).drop(*cols), k


def cluster_summary(labeled: DataFrame, features: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    """U4: per-cluster feature means and sizes."""
    return labeled.groupBy("Cluster").agg(*[F.avg(c).alias(c) for c in features], F.count(F.lit(1)).alias("size")).orderBy("Cluster")


def name_segments(labeled: DataFrame, k: int) -> DataFrame:
    """Rank clusters by mean total profit and mean order count (descending,
    average rank on ties); rank <= k/2 is "High", else "Low"."""
    g = labeled.groupBy("Cluster").agg(
        F.avg("total_profit").alias("_v"), F.avg("order_count").alias("_f"), F.count(F.lit(1)).alias("size")
    )

    def avg_rank(c: str):  # one row per cluster: bounded window
        w = Window.orderBy(F.desc(c))
        ties = Window.partitionBy(c)
        return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0

    r = g.select("Cluster", "size", avg_rank("_v").alias("value_rank"), avg_rank("_f").alias("frequency_rank"))
    half = k / 2.0
    hv, hf = F.col("value_rank") <= half, F.col("frequency_rank") <= half
    name = (
        F.when(hv & hf, "High Value, High Frequency")
        .when(hv, "High Value, Low Frequency")
        .when(hf, "Low Value, High Frequency")
        .otherwise("Low Value, Low Frequency")
    )
    return r.select(
        "Cluster", "value_rank", "frequency_rank", "size",
        F.concat(F.lit("Cluster "), F.col("Cluster").cast("string"), F.lit(" - "), name).alias("name"),
    ).orderBy("Cluster")


def customer_segments(facts: DataFrame, k: int = 4) -> DataFrame:
    """One-hot modal order type/vehicle/city + standardised mean distance,
    time, profit and order count -> K-means(4) segment per customer; customers that lack one of them have no segment."""
    # The columns that the segments are built from.
    cats = ["Type_of_order", "Type_of_vehicle", "City"]
    nums = ["Distance_km", "Time_taken_min", "Profit", "Order_Count"]
    points = written(standardized(customer_profile(facts).dropna(subset=cats), nums), "profiles")
    cols = [f"_z_{c}" for c in nums]
    for c in cats:
        levels = sorted(r[0] for r in points.select(c).distinct().limit(MAX_LEVELS + 1).collect())
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} values")
        for i, level in enumerate(levels):
            points = points.withColumn(f"_{c}_{i}", (F.col(c) == level).cast("double"))
            cols.append(f"_{c}_{i}")
    centres = lloyd.fit(points, cols, {k: lloyd.farthest_first(points, cols, k)})[k]
    segment = lloyd.nearest(cols, centres) if centres else F.lit(0)
    return points.select("Customer_ID", *cats, *nums, segment.alias("Customer_Segment"))


def with_customer_segments(facts: DataFrame, segments: DataFrame) -> DataFrame:
    """Attach Customer_Segment to every order (left join on the customer)."""
    return facts.join(segments.select("Customer_ID", "Customer_Segment"), "Customer_ID", "left")
