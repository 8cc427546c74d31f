import glob
import os

from pyspark.sql import functions as F

from dispatchlens.plans.facts import facts
from dispatchlens.plans.materialize import raw_deliveries
from dispatchlens.sources.files import read_deliveries_csv, read_deliveries_with_rejects, write_table

SF = "/root/testdata/sf0.001"


def test_csv_round_trip_gives_same_facts(spark, tmp_path):
    raw = raw_deliveries(spark, SF)
    out = str(tmp_path / "raw")
    write_table(raw.withColumnRenamed("Time_taken_min", "Time_taken(min)"), out, "csv")
    back = read_deliveries_csv(spark, out)
    assert back.columns == raw.columns
    a = {r.Order_ID: round(r.Profit, 9) for r in facts(back).select("Order_ID", "Profit").collect()}
    b = {r.Order_ID: round(r.Profit, 9) for r in facts(raw).select("Order_ID", "Profit").collect()}
    assert a == b and len(a) > 0


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(
        "City,extra,Order_ID,Restaurant_latitude,Time_taken(min)\n"
        "Urban,x,ORD-1,28.5,24 min\n"
        ",y,ORD-2,,30\n"
        "Urban,z,ORD-3,north,31\n"  # no number
        "Urban,z,ORD-4,28.5,31,more\n"  # a column too many
        "Urban\n"
    )
    every = read_deliveries_csv(spark, str(path))
    assert every.columns == ["Order_ID", "City", "Restaurant_latitude", "Time_taken_min"]
    rows = {r.Order_ID: r for r in every.collect()}
    assert len(rows) == 5 and rows["ORD-1"].Restaurant_latitude == 28.5 and rows["ORD-2"].City is None and rows["ORD-3"].Restaurant_latitude is None
    good, rejects = read_deliveries_with_rejects(spark, str(path))
    assert sorted(r.Order_ID for r in good.collect()) == ["ORD-1", "ORD-2"] and good.columns == every.columns
    assert sorted(r.line for r in rejects.collect()) == ["Urban", "Urban,z,ORD-3,north,31", "Urban,z,ORD-4,28.5,31,more"]
    assert all(r.file.endswith("orders.csv") for r in rejects.collect())
    assert rejects.count() == 3


def test_partitions_are_few_files_and_overwritten_apart(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(6000).select("id", (F.col("id") % 3).alias("month")).repartition(40)
    write_table(rows, path, by=["month"])
    files = {m: glob.glob(f"{path}/month={m}/*.parquet") for m in range(3)}
    assert all(1 <= len(f) <= 4 for f in files.values())
    write_table(rows.where("month = 1 and id < 100"), path, by=["month"])
    assert glob.glob(f"{path}/month=0/*.parquet") == files[0] and not any(map(os.path.exists, files[1]))
    assert sorted(map(tuple, spark.read.parquet(path).groupBy("month").count().collect())) == [(0, 2000), (1, 33), (2, 2000)]
