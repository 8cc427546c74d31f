import datetime
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from dispatchlens.functions import lloyd
from dispatchlens.operators import customers as U
from dispatchlens.operators import demand as D
from dispatchlens.operators import geo as G
from dispatchlens.operators import holidays as H
from dispatchlens.operators import linear as L
from dispatchlens.operators import models as M
from dispatchlens.operators.recommend import safe_group_agg
from dispatchlens.plans.materialize import fact_table, raw_deliveries
from dispatchlens.plans import pipeline
from dispatchlens.plans.pipeline import run_all, run_and_save, save_all, save_with_status
from dispatchlens.session import ensure_checkpoint_dir, written
from dispatchlens.sources.files import from_dataframe, load_model, save_model

SF = "/root/testdata/sf0.001"


def test_noise_is_reassigned(spark):
    rnd = random.Random(2)
    blobs = [(round(x + rnd.uniform(0, 0.01), 5), round(rnd.uniform(0, 0.01), 5)) for x in (0.0, 1.0) for _ in range(30)]
    noise = [(10.0 + 3 * i, 20.0) for i in range(12)]
    labels = G.dbscan(spark.createDataFrame(blobs + noise, "x double, y double"), ["x", "y"], 0.02, 5)
    assert labels.where("cluster = -1").count() == 12
    out = G.reassign_noise(labels, ["x", "y"])
    assert out.count() == labels.count() and out.where("cluster = -1").count() == 0
    new = {r.cluster for r in out.where("x >= 10").collect()}
    assert new <= set(range(2, 7)) and len(new) > 1
    assert out.where("x < 10").exceptAll(labels.where("x < 10")).count() == 0


def test_importances_name_their_inputs(spark):
    facts = fact_table(spark, SF)
    metrics, importances = M.delivery_time_models(facts, models=["Linear Regression", "Random Forest"])
    rows = importances.collect()
    nums, cats = M.time_features(facts)
    values = {c: {r[0] for r in facts.select(c).distinct().collect()} for c in cats}
    assert abs(sum(r.importance for r in rows) - 1) < 1e-9
    for r in rows:
        c = next((c for c in cats if r.feature.startswith(f"{c}_")), None)
        assert r.feature in nums or r.feature.removeprefix(f"{c}_") in values[c]
    assert len({r.feature for r in rows}) == len(rows) == len(nums) + sum(len(v - {None}) for v in values.values())
    assert metrics.where("is_best").count() == 1


def test_linear_and_ridge_have_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.1 * rng.standard_normal(200)
    frame = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    frame = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame)
    regs = M._regressors("y", 200, float(y.std()))
    centred, target = x - x.mean(0), y - y.mean()
    for name, alpha in (("Linear Regression", 0.0), ("Ridge Regression", 1.0)):
        want = np.linalg.solve(centred.T @ centred + alpha * np.eye(3), centred.T @ target)
        assert np.allclose(regs[name].fit(frame).coefficients.toArray(), want, atol=1e-4)


def test_closed_form_equals_the_fitted_models(spark):
    from pyspark.ml import Pipeline
    from pyspark.sql import functions as F

    facts = fact_table(spark, SF)
    some = F.when(F.col("Order_Hour") != 3, F.col("City"))  # a category with missing values
    facts = facts.withColumn("City", some).withColumn("Constant", F.lit(1))
    rows, nums, cats = L.complete_rows(facts)
    train, test = M.hash_split(rows)
    scale = L.scales(train, nums)
    fitted = L.linear_coefficients(train, nums, cats, "Time_taken_min", scale)
    stages = Pipeline(stages=M.feature_pipeline(nums, cats)).fit(train)
    shaped = stages.transform(train)
    st = train.agg(F.count("*").alias("n"), F.stddev_pop("Time_taken_min").alias("s")).first()
    regs = M._regressors("Time_taken_min", st["n"], st["s"])
    for name, own in fitted.items():
        want = regs[name].setTol(1e-12).fit(shaped).transform(stages.transform(test)).select("Order_ID", "prediction")
        got = test.select("Order_ID", L.predicted(test, own, nums, cats, scale).alias("got"))
        worst = want.join(got, "Order_ID").agg(F.max(F.abs(F.col("got") - F.col("prediction"))), F.count("*")).first()
        assert worst[1] > 100 and worst[0] < 1e-6, (name, worst)


def test_solve_leaves_out_explained_slots():
    x = np.random.default_rng(2).normal(size=(50, 3))
    x = np.column_stack([np.ones(50), x, x[:, 0] - 2 * x[:, 1], np.zeros(50)])
    y = x[:, :4] @ [1.0, 2.0, -3.0, 0.5]
    assert np.allclose(L.solve(x.T @ x, x.T @ y), [1, 2, -3, 0.5, 0, 0], atol=1e-9)


def test_linear_models_without_rows(spark):
    facts = fact_table(spark, SF)
    rows, nums, cats = L.complete_rows(facts)
    none = rows.where("Distance_km < 0")
    scale = L.scales(none, nums)
    assert L.linear_coefficients(none, nums, cats, "Time_taken_min", scale) == {m: {} for m in L.MODELS}


def series(spark, counts):
    day = datetime.date(2024, 1, 1)
    rows = [(str(i), day + datetime.timedelta(days=d)) for d, n in enumerate(counts) for i in range(n)]
    return spark.createDataFrame(rows, "Order_ID string, Order_Date date")


def test_autoregression_against_least_squares(spark):
    rnd = random.Random(4)
    counts = [rnd.randint(5, 30) for _ in range(60)]
    out = D.autoregressive_forecast(series(spark, counts), order=3, future_days=5).collect()
    train = np.array(counts[:-14], float)
    d = np.diff(train)
    rows = np.column_stack([d[3 - i - 1 : len(d) - i - 1] for i in range(3)])
    coef = np.linalg.lstsq(rows, d[3:], rcond=None)[0]
    hist, level, want = list(d[-3:][::-1]), train[-1], []
    for _ in range(19):
        hist = [float(np.dot(coef, hist)), *hist[:2]]
        level += hist[0]
        want.append(level)
    assert np.allclose([r.forecast for r in out], want)
    assert [r.split for r in out] == ["test"] * 14 + ["future"] * 5
    assert [r.actual for r in out][:14] == [float(c) for c in counts[-14:]]


@pytest.mark.parametrize(("counts", "level"), [([7] * 40, 7.0), ([4] * 17, 4.0), ([3] * 5, None)])
def test_constant_and_short_series(spark, counts, level):
    out = D.autoregressive_forecast(series(spark, counts), future_days=3).collect()
    assert {r.forecast for r in out} == {level} and len(out) == min(14, len(counts)) + 3


def test_hourly_series_of_few_orders(spark):
    few = fact_table(spark, SF).limit(10)
    assert D.hourly_orders(few).count() > 0 and D.hourly_pattern(few).count() > 0


def plain_lloyd(x, w, k, rounds):
    """The same clustering over plain arrays."""
    square = lambda c: np.round(((x[:, None, :] - np.array(c)[None]) ** 2).sum(2), 9)
    smallest = lambda score: min(range(len(x)), key=lambda i: (-score[i], tuple(x[i])))
    mean = (x * w[:, None]).sum(0) / w.sum()
    centres = [x[smallest(-square([mean])[:, 0])]]
    while len(centres) < k and (far := square(centres).min(1)).max() > 0:
        centres.append(x[smallest(far)])
    for _ in range(rounds):
        own = square(centres).argmin(1)
        centres = [(x[own == c] * w[own == c, None]).sum(0) / w[own == c].sum() if (own == c).any() else centres[c] for c in range(len(centres))]
    return np.array(centres), square(centres).argmin(1), float((w * square(centres).min(1)).sum())


def test_lloyd_equals_plain_arrays(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (3, 3), (0, 4))] + [np.repeat([[9.0, 9.0]], 5, axis=0)])
    w = rng.integers(1, 4, len(x)).astype(float)
    points = spark.createDataFrame([(i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(x, w))], "id int, a double, b double, w double").repartition(3)
    weight = F.col("w")
    start = lloyd.farthest_first(points, ["a", "b"], 6, weight)
    fits = lloyd.fit(points, ["a", "b"], {k: start[:k] for k in (1, 3, 6)}, weight, rounds=4)
    costs = lloyd.within(points, ["a", "b"], fits, weight)
    for k, centres in fits.items():
        want, own, cost = plain_lloyd(x, w, k, 4)
        assert np.allclose(centres, want, atol=1e-9) and abs(costs[k] - cost) < 1e-6
        got = points.select("id", lloyd.nearest(["a", "b"], centres).alias("c")).collect()
        assert [r.c for r in sorted(got)] == own.tolist()
    same = spark.createDataFrame([(1.0, 2.0)] * 4, "a double, b double")
    assert lloyd.farthest_first(same, ["a", "b"], 3) == [(1.0, 2.0)] and lloyd.farthest_first(same.limit(0), ["a", "b"], 3) == []
    assert lloyd.fit(same, ["a", "b"], {1: [(1.0, 2.0)]}) == {1: [(1.0, 2.0)]}


def test_customer_clusters_and_segments(spark):
    rfm = written(U.customer_rfm(fact_table(spark, SF)), "rfm-test")
    table, k, found = U.kmeans_elbow(rfm, rounds=3)
    rows = table.orderBy("k").collect()
    assert [r.k for r in rows] == list(range(1, 11)) and [r.k for r in rows if r.is_optimal] == [k]
    assert all(a.wcss > b.wcss for a, b in zip(rows, rows[1:]))
    labelled, three = U.customer_clusters(rfm, 3)
    assert three == 3 and {r.Cluster for r in labelled.collect()} == {0, 1, 2} and set(labelled.columns) == {*rfm.columns, "Cluster"}
    assert labelled.count() == U.customer_clusters(rfm, elbow=(table, k, found))[0].count() == found[0].count()
    segments = U.customer_segments(fact_table(spark, SF))
    assert U.with_customer_segments(fact_table(spark, SF), segments).count() == fact_table(spark, SF).count()
    assert U.customer_segments(fact_table(spark, SF).limit(0)).collect() == []


def test_model_and_frame_round_trips(spark):
    frame = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "x double, y double")
    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(frame)
    model = M._regressors("y", 20, 1.0)["Linear Regression"].fit(vectors)
    path = f"{ensure_checkpoint_dir(spark)}/model-test"
    save_model(model, path)
    assert np.allclose(load_model(path).coefficients.toArray(), model.coefficients.toArray())
    raw = raw_deliveries(spark, SF)
    assert from_dataframe(raw).count() == raw.count()


def test_safe_group_agg(spark):
    frame = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), (None, 5, "z")], "k string, v int, s string")
    out, left_out = safe_group_agg(frame, "k", {"v": "mean", "gone": "sum", "s": "mean"})
    assert [(r.k, r.v) for r in out.collect()] == [("a", 2.0)]
    assert [r.column for r in left_out.collect()] == ["gone", "s"] and "string" in left_out.collect()[1].problem
    assert safe_group_agg(frame, "k", {"s": "max"})[0].collect()[0].s == "y"
    out, left_out = safe_group_agg(frame, "nothing", {"v": "mean"})
    assert out is None and [r.column for r in left_out.collect()] == ["nothing"]
    assert safe_group_agg(frame, "k", {"gone": "sum"})[0] is None


def test_run_all(spark):
    results = run_all(spark, raw_deliveries(spark, SF), with_models=False)
    cheap = [k for k in results if not k.startswith(("efficiency_", "pricing_", "dynamic_", "driver_"))]
    empty = {k for k in cheap if results[k].isEmpty()}
    # at this scale no fact has seven days of hourly history, and few groups reach their sizes
    assert empty <= {"demand_forecast_hourly_features", "profitability_top_scenarios", "pricing_segment_price_grid", "pricing_segment_based_pricing", "driver_allocation_high_rated_drivers", "efficiency_restaurant_delays"}
    routes = [r.Route_Type for r in results["route_optimization_efficient_routes"].orderBy(F.desc("profit_per_min"), "Route_Type").limit(3).collect()]
    lines = {(r.category, r.ordinal): r.text for r in results["recommendations"].collect()}
    assert lines["route_optimization", 1].endswith(": " + ", ".join(routes))
    assert not any("price model" in t for t in lines.values())
    some = {k: results[k] for k in ("efficiency_kpis", "recommendations")}
    assert len(save_all(some, f"{ensure_checkpoint_dir(spark)}/run-all-test")) == 2
    broken = spark.range(3).select(F.assert_true(F.col("id") < 0).alias("x"))
    status = save_with_status({"kpis": results["efficiency_kpis"], "broken": broken}, f"{ensure_checkpoint_dir(spark)}/status-test")
    assert [(r.analysis, r.ok) for r in status.collect()] == [("kpis", True), ("broken", False)]


def test_a_failing_analysis_ends_alone(spark, tmp_path, monkeypatch):
    """One analysis fails while it is built, one while it is written, and a shared input fails for those that need it."""
    broken = spark.range(3).select(F.assert_true(F.col("id") < 0).alias("x"))
    monkeypatch.setitem(pipeline.ANALYSES, "efficiency", lambda i: 1 / 0)
    monkeypatch.setitem(pipeline.ANALYSES, "pricing", lambda i: {"first": spark.range(2).toDF("n"), "second": broken})
    monkeypatch.setattr(pipeline.Inputs, "_enriched", lambda i: i.no_such_input)
    names = ["facts", "pricing", "dynamic_pricing", "route_optimization", "driver_allocation", "efficiency"]
    out = str(tmp_path / "results")
    rows = {r.analysis: r for r in run_and_save(spark, raw_deliveries(spark, SF), out, only=names, with_models=False, at_once=3).collect()}
    assert list(rows) == names
    assert {n: r.ok for n, r in rows.items()} == {n: n in ("facts", "dynamic_pricing", "driver_allocation") for n in names}
    assert "ZeroDivisionError" in rows["efficiency"].message and "AttributeError" in rows["route_optimization"].message
    assert rows["pricing"].results == 1 and rows["driver_allocation"].results == 5
    assert spark.read.parquet(f"{out}/pricing_first").count() == 2 and spark.read.parquet(f"{out}/driver_allocation_shift_allocation").count() == 21
    assert spark.read.parquet(f"{out}/facts").count() == fact_table(spark, SF).count()
    with pytest.raises(ValueError, match="nothing"):
        run_and_save(spark, raw_deliveries(spark, SF), out, only=["nothing"])


def test_arima_against_two_stage_least_squares(spark):
    rnd = random.Random(9)
    counts = [rnd.randint(5, 30) for _ in range(80)]
    out = D.arima_forecast(series(spark, counts), order=2, moving=2, long_order=4, future_days=3).collect()
    d = np.diff(np.array(counts[:-14], float))
    lagged = lambda x, n: np.column_stack([np.concatenate([np.full(i, np.nan), x[:-i]]) for i in range(1, n + 1)])

    def least_squares(left, right):
        whole = ~np.isnan(left).any(1) & ~np.isnan(right)
        return np.linalg.lstsq(left[whole], right[whole], rcond=None)[0]

    far = lagged(d, 4)
    e = d - far @ least_squares(far, d)
    coef = least_squares(np.hstack([lagged(d, 2), lagged(e, 2)]), d)
    moves, errors, level, want = [d[-1], d[-2]], [e[-1], e[-2]], counts[-15], []
    for _ in range(17):
        move = float(np.dot(coef, moves + errors))
        moves, errors, level = [move, moves[0]], [0.0, errors[0]], level + move
        want.append(level)
    assert np.allclose([r.forecast for r in out], want) and [r.split for r in out] == ["test"] * 14 + ["future"] * 3
    assert [r.actual for r in out][:14] == [float(c) for c in counts[-14:]]
    short = D.arima_forecast(series(spark, [3, 4] * 8), future_days=1).collect()  # two training days: no equations
    assert {r.forecast for r in short} == {4.0}
    assert D.arima_forecast(series(spark, [3] * 5), future_days=1).where("forecast is not null").count() == 0


def test_hourly_features_by_series_and_time(spark):
    hour = datetime.datetime(2024, 1, 1)
    rnd = random.Random(5)
    cities = {"a": [rnd.randint(0, 2) for _ in range(24 * 9)], "b": [1] * 100 + [0] * 50 + [1] * 60}
    rows = [(c, (t := hour + datetime.timedelta(hours=i)).date(), t.hour) for c, own in cities.items() for i, n in enumerate(own) for _ in range(n)]
    facts = spark.createDataFrame([*rows, (None, hour.date(), 3), ("a", None, 4), ("b", hour.date(), None)], "City string, Order_Date date, Order_Hour int")
    got = {(r.City, r.ts): r for r in D.hourly_features(facts, time_aligned=True, series=["City"]).collect()}
    want = {}
    for c, own in cities.items():
        seen = [i for i, n in enumerate(own) if n]
        for i in range(seen[0] + 168, seen[-1] + 1):
            want[c, hour + datetime.timedelta(hours=i)] = (own[i], own[i - 24], own[i - 168], sum(own[i - 168 : i]) / 168)
    assert {k: (r.orders, r.lag_1d, r.lag_7d, r.ma_7d) for k, r in got.items()} == want and len({c for c, _ in want}) == 2


def test_calendar_holidays(spark):
    day = datetime.date
    calendar = spark.createDataFrame([(day(2024, 1, 1), day(2024, 1, 3)), (day(2024, 1, 3), None), (None, day(2024, 1, 9)), (day(2024, 2, 2), day(2024, 2, 1))], "first date, last date")
    facts = spark.createDataFrame([(1, day(2024, 1, 1), 0, 5.0), (2, day(2024, 1, 3), 0, 7.0), (3, day(2024, 1, 9), 1, 1.0), (4, None, 1, 2.0), (5, day(2024, 2, 1), None, 3.0)], "id int, Order_Date date, IsHoliday int, Profit double")
    for days in (H.BROADCAST_DAYS, 0):
        H.BROADCAST_DAYS, kept = days, H.BROADCAST_DAYS
        out = H.with_calendar_holidays(facts, calendar)
        assert out.columns == facts.columns and {r.id: r.IsHoliday for r in out.collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
        H.BROADCAST_DAYS = kept
    assert [tuple(r) for r in H.profit_by_holiday(facts, calendar).collect()] == [(0, 3, 2.0), (1, 2, 6.0)]
