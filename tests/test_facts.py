from pyspark.sql import functions as F

from dispatchlens.plans.facts import facts
from dispatchlens.sources.schema import RAW_SCHEMA


def _raw(spark, rows):
    full = []
    for r in rows:
        base = dict.fromkeys(RAW_SCHEMA.fieldNames())
        base.update(r)
        full.append(tuple(base[c] for c in RAW_SCHEMA.fieldNames()))
    return spark.createDataFrame(full, RAW_SCHEMA)


def _row(oid, **kw):
    r = dict(Order_ID=oid, Customer_ID="C1", Restaurant_ID="R1", Delivery_person_ID="D1", Order_Date="01-01-2023",
             Time_Orderd="10:00", Time_Order_picked="10:30", Weatherconditions="Fog", Road_traffic_density="Low",
             Type_of_vehicle="scooter", Type_of_order="Meal", City="Urban", Restaurant_latitude=28.5,
             Restaurant_longitude=77.1, Delivery_location_latitude=28.6, Delivery_location_longitude=77.2,
             Delivery_person_Age="30", Delivery_person_Ratings="4.5", Time_taken_min="20 min")
    r.update(kw)
    return r


def test_clock_edges_and_imputation(spark):
    raw = _raw(spark, [
        _row("o1"),                                         # wait 30
        _row("o2", Time_Order_picked="12:00"),             # wait 120 (kept)
        _row("o3", Time_Order_picked="12:05"),             # 125 -> imputed
        _row("o4", Time_Order_picked="09:00"),             # negative -> imputed
        _row("o5", Time_Orderd=None, Time_Order_picked="00:10:00"),  # 00:00 -> 10 min
        _row("o6", Order_Date="bad"),                      # dropped (no hour)
        _row("o7", Delivery_person_Age="NaN "),            # dropped
    ])
    f = {r.Order_ID: r for r in facts(raw).collect()}
    assert set(f) == {"o1", "o2", "o3", "o4", "o5"}
    mean = (30 + 120 + 10 + 30) / 4  # over all parsed rows (o7 too: it is dropped later)
    assert f["o1"].Wait_Time_Minutes == 30.0 and f["o2"].Wait_Time_Minutes == 120.0
    assert abs(f["o3"].Wait_Time_Minutes - mean) < 1e-12 and abs(f["o4"].Wait_Time_Minutes - mean) < 1e-12
    assert f["o4"].Order_To_Pickup_Minutes == -60.0
    assert f["o5"].Order_Hour == 0 and f["o5"].Wait_Time_Minutes == 10.0
    assert abs(f["o1"].Restaurant_Prep_Time - 21.0) < 1e-12
    # profit identity
    r = f["o1"]
    assert abs(r.Total_Cost - (r.Time_taken_min * 2 + r.Distance_km * 5 + 50)) < 1e-9
    assert abs(r.Profit - (100 - r.Total_Cost)) < 1e-9


def test_zero_division_gives_null(spark):
    raw = _raw(spark, [_row("o1", Time_Order_picked="10:00"), _row("o2", Time_Order_picked="10:20")])
    f = {r.Order_ID: r for r in facts(raw).collect()}
    assert f["o1"].Restaurant_Prep_Time == 0.0
    assert f["o1"].Restaurant_Efficiency is None
    assert f["o2"].Restaurant_Efficiency is not None


def test_months_are_dealt_before_derived_columns(spark, tmp_path):
    """What crosses the shuffle by month is the parsed columns and two means; the rows are those of a plain build."""
    from dispatchlens.plans import facts as P
    from dispatchlens.session import written

    raw = _raw(spark, [_row(f"o{i}", Order_Date=f"{i % 28 + 1:02d}-{i % 5 + 1:02d}-2023", Time_Order_picked=None if i % 7 == 0 else "10:20:30") for i in range(60)])
    out = P.facts(raw, by_month=True)
    plan = out._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "RebalancePartitions":
        plan = plan.children().head()
    assert plan.output().size() < 30 < len(P.FACT_COLUMNS)
    kept = written(out, path=str(tmp_path / "facts"), by=("Year", "Month"), dealt=True)
    assert sorted(kept.collect(), key=lambda r: r.Order_ID) == sorted(P.facts(raw).collect(), key=lambda r: r.Order_ID)
    assert sorted(f.name for f in (tmp_path / "facts" / "Year=2023").iterdir()) == [f"Month={m}" for m in range(1, 6)]
    hours = {r.Order_ID: (r.Order_Hour, r.Order_Minute, r.Pickup_Hour, r.Pickup_Minute, r.DayOfWeek, r.IsPeakHour) for r in kept.collect()}
    assert hours["o1"] == (10, 0, 10, 20, 3, 0) and hours["o7"][2:4] == (0, 0)
