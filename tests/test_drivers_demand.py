import datetime as dt

from dispatchlens.operators import demand as D
from dispatchlens.operators import drivers as V


def test_shift_allocation_minimum_one(spark):
    rows = [(0, 7)] * 40 + [(0, 23)] * 3 + [(2, 15)] * 16
    f = spark.createDataFrame(rows, "DayOfWeek int, Order_Hour int")
    out = {(r.DayOfWeek, r.shift_index): r.drivers_needed for r in V.shift_allocation(f).collect()}
    assert len(out) == 21
    assert out[(0, 0)] == 2 and out[(0, 2)] == 1 and out[(2, 1)] == 1 and out[(6, 1)] == 1


def test_drivers_needed_half_even(spark):
    rows = [(0, 10)] * 1 + [(0, 11)] * 5 + [(1, 10)] * 3
    f = spark.createDataFrame(rows, "DayOfWeek int, Order_Hour int")
    out = {(r.DayOfWeek, r.Order_Hour): r.drivers_needed for r in V.drivers_needed(f).collect()}
    assert out == {(0, 10): 0, (0, 11): 2, (1, 10): 2, (1, 11): 0}


def test_daily_spine_and_moving_average(spark):
    start = dt.date(2023, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(30) if i not in (3, 4, 20)]
    f = spark.createDataFrame([(d,) for d in days for _ in range(2)], "Order_Date date")
    d = D.daily_orders(f).collect()
    assert len(d) == 30 and sum(r.orders for r in d) == 2 * 27
    fc = D.moving_average_forecast(f).collect()
    test = [r for r in fc if r.split == "test"]
    fut = [r for r in fc if r.split == "future"]
    assert len(test) == 14 and len(fut) == 30
    # last 7 training days are days 9..15 (all present): mean 2
    assert all(abs(r.forecast - 2.0) < 1e-12 for r in fc)


def test_fraction_split_and_its_forecast(spark):
    start = dt.date(2023, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(21) if i != 3]
    f = spark.createDataFrame([(d,) for i, d in enumerate(days) for _ in range(i + 1)], "Order_Date date")
    split = D.holdout_split(D.daily_orders(f, fill_missing=False), mode="fraction").collect()
    assert [r.split for r in sorted(split)] == ["train"] * 16 + ["test"] * 4
    fc = D.moving_average_forecast(f, mode="fraction").collect()
    assert [r.split for r in fc] == ["test"] * 4 + ["future"] * 30
    assert {r.forecast for r in fc} == {13.0} and [r.actual for r in fc][:4] == [17.0, 18.0, 19.0, 20.0]
    few = f.where(f.Order_Date < days[13])
    assert D.holdout_split(D.daily_orders(few, fill_missing=False), mode="fraction").collect() == []
    assert D.moving_average_forecast(few, mode="fraction").collect() == []


def test_fraction_forms_match_their_sql(spark):
    import __spark_entry__ as E
    from oracle_harness import compare, duck

    sf = "/root/testdata/sf0.001"
    for name in ("holdout_split_fraction", "moving_average_forecast_fraction"):
        assert compare(E.queries()[name](spark, sf), duck(sf), E.oracle_sql()[name]) == []


def test_driver_recommendations_keep_the_standing_lines(spark):
    from dispatchlens.operators.recommend import driver_recommendations

    f = spark.createDataFrame([(0, 7)] * 40 + [(2, 15)] * 16, "DayOfWeek int, Order_Hour int")
    rows = driver_recommendations(f).orderBy("ordinal").collect()
    assert [(r.category, r.ordinal) for r in rows] == [("driver_management", i) for i in (1, 2, 3)]
    assert rows[0].text == "Couriers are needed most on Monday in the shift Morning (6 AM - 2 PM)"
    assert [r.text for r in rows[1:]] == ["Teach new couriers what the leading ones do", "Tie courier bonuses to measured efficiency"]
