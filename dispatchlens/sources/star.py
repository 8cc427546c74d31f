"""S3: derive the raw delivery table from the star schema (orders, customer,
nation, lineitem).

Every column is an integer-only function of the order, customer and supplier
keys, so the table is deterministic and can be recomputed in SQL. Products of
keys are reduced modulo the prime first, ``((k % p) * a) % p``, which equals
``(k * a) % p`` for non-negative keys but cannot overflow a 64-bit integer.

Plan shape: lineitem is pre-aggregated per order (partial aggregation, then a
shuffle on the order key); orders join it on the same key, so that join reuses
the aggregate's hash partitioning. Customer joins on its key (sort-merge, or a
broadcast that AQE picks at run time after measuring it). Nation has 25 rows
by definition of the schema and is broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlens.sources.schema import RAW_COLUMNS

# --- fixed values: category domains of the adapter, in code order ----------
WEATHER_VALUES = ("Sunny", "Cloudy", "Fog", "Windy", "Stormy", "Sandstorms")
TRAFFIC_VALUES = ("Low", "Medium", "High", "Jam")
VEHICLE_VALUES = ("motorcycle", "scooter", "bicycle")
ORDER_TYPE_VALUES = ("Snack", "Meal", "Drinks", "Buffet")


def _hash_mod(key: Column, mult: int, prime: int) -> Column:
    return ((key % prime) * mult) % prime


def _pick(idx: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _hhmm(minute_of_day: Column) -> Column:
    hh = F.lpad(F.floor(minute_of_day / 60).cast("string"), 2, "0")
    mm = F.lpad((minute_of_day % 60).cast("string"), 2, "0")
    return F.concat(hh, F.lit(":"), mm)


def deliveries_from_tables(
    orders: DataFrame, customer: DataFrame, nation: DataFrame, lineitem: DataFrame
) -> DataFrame:
    """Raw delivery rows (string-typed dirty columns, as a CSV would give)."""
    first_supplier = lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    base = (
        orders.select("o_orderkey", "o_custkey", "o_orderdate")
        .join(customer.select(F.col("c_custkey"), F.col("c_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
        # 25 rows by schema definition: a fixed, proven size bound.
        .join(F.broadcast(nation.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(first_supplier, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    k, c, s, rg = F.col("o_orderkey"), F.col("o_custkey"), F.col("s"), F.col("n_regionkey")
    m = F.floor((((k % 10007) * 104729) % 10007 % 1440) / 15) * 15
    pm = (m + 5 * (_hash_mod(k, 7919, 10007) % 31)) % 1440
    seconds_suffix = F.when(k % 2 == 1, F.lit(":00")).otherwise(F.lit(""))
    rest_lat = (
        F.lit(28.42)
        + F.lit(0.05) * (s % 3)
        + ((s * 7919) % 401) / F.lit(2e4)
        + F.when(s % 17 == 0, F.lit(0.3) + s / F.lit(1e3)).otherwise(F.lit(0.0))
    )
    rest_lon = F.lit(77.02) + F.lit(0.05) * (s % 2) + ((s * 104729) % 401) / F.lit(2e4)
    cust_lat = (
        F.lit(28.42)
        + F.lit(0.05) * (c % 6)
        + ((c * 7919) % 401) / F.lit(2e4)
        + F.when(c % 97 == 0, F.lit(0.3) + (c % 1000) / F.lit(1e3)).otherwise(F.lit(0.0))
    )
    cust_lon = F.lit(77.02) + F.lit(0.05) * (c % 5) + ((c * 104729) % 401) / F.lit(2e4)
    rating = F.lit(3.0) + (_hash_mod(k, 59, 10067) % 21) / F.lit(10.0)
    return base.select(
        F.concat(F.lit("ORD-"), F.lpad(k.cast("string"), 7, "0")).alias("Order_ID"),
        F.concat(F.lit("CUST-"), c.cast("string")).alias("Customer_ID"),
        F.when(s.isNotNull(), F.concat(F.lit("REST-"), s.cast("string"))).alias("Restaurant_ID"),
        F.concat(F.lit("DP-"), (_hash_mod(k, 15485863, 10007) % 200).cast("string")).alias("Delivery_person_ID"),
        F.when(k % 997 == 0, F.lit("bad-date"))
        .otherwise(F.date_format(F.col("o_orderdate"), "dd-MM-yyyy"))
        .alias("Order_Date"),
        F.when(k % 101 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(_hhmm(m), seconds_suffix))
        .alias("Time_Orderd"),
        F.when(k % 103 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(_hhmm(pm), seconds_suffix))
        .alias("Time_Order_picked"),
        _pick(_hash_mod(k, 31, 10007) % 6, WEATHER_VALUES).alias("Weatherconditions"),
        _pick(_hash_mod(k, 37, 10009) % 4, TRAFFIC_VALUES).alias("Road_traffic_density"),
        _pick(_hash_mod(k, 41, 10037) % 3, VEHICLE_VALUES).alias("Type_of_vehicle"),
        _pick(_hash_mod(k, 43, 10039) % 4, ORDER_TYPE_VALUES).alias("Type_of_order"),
        F.when(rg < 2, F.lit("Urban")).when(rg < 4, F.lit("Metropolitian")).otherwise(F.lit("Semi-Urban")).alias("City"),
        rest_lat.alias("Restaurant_latitude"),
        rest_lon.alias("Restaurant_longitude"),
        cust_lat.alias("Delivery_location_latitude"),
        cust_lon.alias("Delivery_location_longitude"),
        F.when(k % 211 == 0, F.lit("NaN "))
        .otherwise((18 + _hash_mod(k, 53, 10061) % 27).cast("string"))
        .alias("Delivery_person_Age"),
        F.when(k % 223 == 0, F.lit(None).cast("string")).otherwise(rating.cast("string")).alias("Delivery_person_Ratings"),
        F.when(k % 307 == 0, F.lit("n/a"))
        .otherwise(F.concat((15 + _hash_mod(k, 61, 10069) % 30).cast("string"), F.lit(" min")))
        .alias("Time_taken_min"),
    ).select(*RAW_COLUMNS)


def read_star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deliveries_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the raw delivery table derived from ``sf_dir``'s parquet tables."""
    t = lambda n: read_star_table(spark, sf_dir, n)
    return deliveries_from_tables(t("orders"), t("customer"), t("nation"), t("lineitem"))
