import math

from pyspark.sql import functions as F

from dispatchlens.functions import columns as C


def test_dirty_scalars(spark):
    df = spark.createDataFrame([("24 min", "NaN ", "4.3"), ("min", "31", None), (None, "", "x"), ("(min) 7", " 40 ", "5")],
                               "t string, age string, rating string")
    out = df.select(C.parse_minutes(F.col("t")).alias("t"), C.coerce_numeric(F.col("age")).alias("a"),
                    C.coerce_numeric(F.col("rating")).alias("r")).collect()
    assert [r.t for r in out] == [24.0, None, None, 7.0]
    assert [r.a for r in out] == [None, 31.0, None, 40.0]
    assert [r.r for r in out] == [4.3, None, None, 5.0]


def test_haversine(spark):
    df = spark.createDataFrame([(28.5, 77.1, 28.5, 77.1), (0.0, 0.0, 0.0, 180.0), (28.5, None, 28.6, 77.2)],
                               "a double, b double, c double, d double")
    out = [r[0] for r in df.select(C.haversine_km(*[F.col(x) for x in "abcd"])).collect()]
    assert out[0] == 0.0
    assert math.isclose(out[1], math.pi * 6371.0, rel_tol=1e-12)
    assert out[2] is None


def test_clock_parts(spark):
    df = spark.createDataFrame([("18:45",), ("18:45:30",), ("9:05",), ("25:00",), ("ab",), ("00:00",)], "c string")
    h, m, s = C.clock_parts(F.col("c"))
    rows = df.select(h.alias("h"), m.alias("m"), s.alias("s"), C.valid_clock(h, m, s).alias("ok")).collect()
    assert [(r.h, r.m, r.s) for r in rows[:3]] == [(18, 45, 0), (18, 45, 30), (9, 5, 0)]
    assert rows[3].ok is False
    assert rows[4].h is None and rows[4].ok is None
    assert (rows[5].h, rows[5].ok) == (0, True)


def test_calendar_flags(spark):
    df = spark.createDataFrame([("2023-01-01", 11), ("2023-12-25", 21), ("2023-03-04", 15), (None, None)], "d string, h int")
    d = F.to_date("d")
    rows = df.select(C.weekday_monday0(d).alias("w"), C.is_weekend(C.weekday_monday0(d)).alias("we"),
                     C.is_holiday(d).alias("hol"), C.is_peak_hour(F.col("h")).alias("pk")).collect()
    assert [r.w for r in rows] == [6, 0, 5, None]
    assert [r.we for r in rows] == [1, 0, 1, 0]
    assert [r.hol for r in rows] == [1, 1, 0, 0]
    assert [r.pk for r in rows] == [1, 1, 0, 0]
