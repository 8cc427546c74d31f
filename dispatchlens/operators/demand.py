"""Demand series and forecasts.

Series operators run on already-aggregated data (one row per day or per
(day, hour)); their size is bounded by the calendar span, not by the number of
orders. Orders are reduced to these series with partial aggregation first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlens.params import DAY_NAMES

TEST_DAYS = 14
FUTURE_DAYS = 30
MA_WINDOW = 7
FRACTION_MIN_DAYS = 14


def daily_orders(facts: DataFrame, fill_missing: bool = True) -> DataFrame:
    """Orders per calendar day; with ``fill_missing`` every day between the
    first and last order day is present (0 orders on empty days)."""
    cnt = facts.where(F.col("Order_Date").isNotNull()).groupBy(F.col("Order_Date").alias("day")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    if not fill_missing:
        return cnt.orderBy("day")
    span = cnt.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    spine = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return spine.join(cnt, "day", "left").select("day", F.coalesce("orders", F.lit(0)).alias("orders")).orderBy("day")


def holdout_split(daily: DataFrame, test_days: int = TEST_DAYS, mode: str = "last_days") -> DataFrame:
    """Mark each day 'train' or 'test'. ``last_days``: the last
    ``test_days`` days are test. ``fraction``: the first 80 % of days (integer
    part) are train; fewer than 14 days give no rows."""
    if mode == "last_days":
        last = daily.select(F.max("day")).scalar()
        split = F.when(F.col("day") > F.date_sub(last, test_days), "test").otherwise("train")
        return daily.withColumn("split", split)
    n = daily.select(F.count(F.lit(1))).scalar()
    rn = F.row_number().over(Window.orderBy("day"))  # one row per day: bounded
    out = daily.withColumn("_rn", rn)
    out = out.withColumn("split", F.when(F.col("_rn") <= F.floor(n * 0.8), "train").otherwise("test")).drop("_rn")
    return out.where(n >= FRACTION_MIN_DAYS)


def moving_average_forecast(
    facts: DataFrame, window: int = MA_WINDOW, test_days: int = TEST_DAYS, future_days: int = FUTURE_DAYS, mode: str = "last_days"
) -> DataFrame:
    """D3: forecast = mean of the last ``window`` training days (the training
    mean when training is shorter), repeated over the test days and the
    ``future_days`` after the last day. Columns: day, split, actual, forecast.
    ``mode="fraction"`` (app form): only days with orders, split by
    ``holdout_split``'s ``fraction``; the trailing means are filled backwards,
    so the last one stands unless training is shorter than the window (NULL)."""
    d = holdout_split(daily_orders(facts, fill_missing=mode == "last_days"), test_days, mode)
    train = d.where(F.col("split") == "train")
    rn = F.row_number().over(Window.orderBy(F.desc("day")))  # one row per day: bounded
    tail = train.withColumn("_rn", rn)
    level = tail.agg(
        F.avg(F.when(F.col("_rn") <= window, F.col("orders"))).alias("_tail"),
        F.count(F.when(F.col("_rn") <= window, F.lit(1))).alias("_k"),
        F.avg("orders").alias("_all"),
    ).select(F.when(F.col("_k") == window, F.col("_tail")).otherwise(F.col("_all") if mode == "last_days" else F.lit(None)).alias("_f"))
    last = d.agg(F.max("day").alias("_last"))
    test = d.where(F.col("split") == "test").select("day", "split", F.col("orders").cast("double").alias("actual"))
    future = last.select(
        F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", future_days), F.expr("INTERVAL 1 DAY"))).alias("day"),
        F.lit("future").alias("split"),
        F.lit(None).cast("double").alias("actual"),
    )
    # one-row level: a fixed size bound for the broadcast
    return test.unionByName(future).crossJoin(F.broadcast(level)).select(
        "day", "split", "actual", F.col("_f").alias("forecast")
    ).orderBy("day")


def forecast_accuracy(forecast: DataFrame) -> DataFrame:
    """MAE and RMSE of a forecast over its test days."""
    t = forecast.where((F.col("split") == "test") & F.col("actual").isNotNull())
    err = F.col("actual") - F.col("forecast")
    return t.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))


def ma_forecast_accuracy(facts: DataFrame) -> DataFrame:
    """D5 on the moving-average forecast."""
    return forecast_accuracy(moving_average_forecast(facts))


def _solve(matrix: Column, order: int) -> Column:
    """Solution of the normal equations ``matrix`` (rows with the right side last) by Gauss-Jordan steps; an
    unknown whose pivot vanishes against the first diagonal's sum is zero."""
    at = lambda m, i, j: F.element_at(F.element_at(m, i), j)
    size = F.aggregate(F.sequence(F.lit(1), F.lit(order)), F.lit(0.0), lambda s, i: s + at(matrix, i, i))

    def step(m: Column, k: Column) -> Column:
        pivot = at(m, k, k)
        gone = pivot <= size * 1e-12
        row_k = F.transform(F.element_at(m, k), lambda x: F.when(gone, 0.0).otherwise(x / pivot))
        return F.transform(m, lambda row, i: F.when(i + 1 == k, row_k).otherwise(F.zip_with(row, row_k, lambda x, y: x - F.element_at(row, k) * y)))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(order)), matrix, step)
    return F.transform(done, lambda row: F.element_at(row, order + 1))


def _daily_by_series(facts: DataFrame, series: Sequence[str]) -> tuple[list[str], DataFrame, DataFrame]:
    """Key columns, each series' first and last day (``lo, hi``) and its zero-filled daily orders."""
    keys = [*series, "_all"]
    cnt = facts.where(F.col("Order_Date").isNotNull()).withColumn("_all", F.lit(0)).groupBy(
        *[F.col(k).cast("string").alias(k) for k in keys], F.col("Order_Date").alias("day")
    ).agg(F.count(F.lit(1)).alias("orders"))
    cnt = cnt.dropna(subset=keys)
    span = cnt.groupBy(*keys).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    spine = span.select(*keys, "hi", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    daily = spine.join(cnt, [*keys, "day"], "left").withColumn("orders", F.coalesce("orders", F.lit(0)).cast("double"))
    return keys, span, daily


def _normal_equations(left: list[str], right: str, whole: Column) -> Column:
    """The rows of the normal equations of ``right`` by ``left``, the right side last, as an aggregate of the rows that are ``whole``."""
    cells = [[F.coalesce(F.sum(F.when(whole, F.col(x) * F.col(y))), F.lit(0.0)) for y in [*left, right]] for x in left]
    return F.array(*[F.array(*row) for row in cells])


def _dot(coefficients: Column | str, values: Column) -> Column:
    return F.aggregate(F.zip_with(coefficients, values, lambda c, x: c * x), F.lit(0.0), lambda s, x: s + x)


def arima_forecast(
    facts: DataFrame,
    order: int = 2,
    moving: int = 2,
    long_order: int = 5,
    series: Sequence[str] = (),
    test_days: int = TEST_DAYS,
    future_days: int = FUTURE_DAYS,
) -> DataFrame:
    """D4 with moving-average terms: ARIMA(``order``, 1, ``moving``) without intercept, fitted in two stages of least
    squares on the training days, forecast over the test days and the ``future_days`` after the
    last day; one series for each value of the ``series`` columns.

    A long autoregression of ``long_order`` lags of the first differences gives residuals; the differences are then
    regressed on ``order`` own lags and ``moving`` lags of those residuals. The forecast folds over
    the days with both histories, and residuals of days to come are zero. Days without a whole set of lags
    take no part in a fit; a series with too few days has zero coefficients, so its forecast
    stays at the last training value (null without training days).
    """
    keys, span, daily = _daily_by_series(facts, series)
    w = Window.partitionBy(*keys).orderBy("day")
    d = [f"_d{i}" for i in range(max(long_order, order) + 1)]  # _d0 is the day's own difference
    e = [f"_e{i}" for i in range(moving + 1)]
    train = daily.where(F.col("day") <= F.date_sub("hi", test_days)).withColumn("_d0", F.col("orders") - F.lag("orders").over(w))
    train = train.withColumns({c: F.lag("_d0", i).over(w) for i, c in enumerate(d) if i})
    own = d[1 : long_order + 1]
    long_fit = train.groupBy(*keys).agg(_normal_equations(own, "_d0", F.col(own[-1]).isNotNull()).alias("_m")).select(*keys, _solve(F.col("_m"), long_order).alias("_long"))
    train = train.join(long_fit, keys).withColumn("_e0", F.when(F.col(own[-1]).isNotNull(), F.col("_d0") - _dot("_long", F.array(*own))))
    train = train.withColumns({c: F.lag("_e0", i).over(w) for i, c in enumerate(e) if i})
    inputs = [*d[1 : order + 1], *e[1:]]
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    ends = [*d[:order], *e[:moving]]
    fitted = train.groupBy(*keys).agg(
        _normal_equations(inputs, "_d0", F.col(d[order]).isNotNull() & F.col(e[-1]).isNotNull()).alias("_m"),
        F.max("day").alias("_last"),
        F.max_by(F.struct("orders", *map(zero, ends)), "day").alias("_end"),
    )
    none = F.array().cast("array<double>")
    history = lambda names: F.array(*[F.col(f"_end.{c}") for c in names]) if names else none
    fitted = fitted.select(*keys, "_last", F.col("_end.orders").alias("_level"), history(d[:order]).alias("_moves"), history(e[:moving]).alias("_errors"), _solve(F.col("_m"), order + moving).alias("_coef"))
    ahead = span.join(fitted, keys, "left").withColumn("_from", F.coalesce(F.date_add("_last", 1), "lo"))
    steps = F.datediff("hi", "_from") + 1 + future_days
    begin = F.struct(F.col("_moves").alias("moves"), F.col("_errors").alias("errors"), F.col("_level").alias("level"), none.alias("out"))

    def one_day(state: Column, _: Column) -> Column:
        move = _dot("_coef", F.concat(state["moves"], state["errors"]))
        level = state["level"] + move
        pushed = lambda new, old, n: F.slice(F.concat(F.array(new), old), 1, n)
        return F.struct(pushed(move, state["moves"], order).alias("moves"), pushed(F.lit(0.0), state["errors"], moving).alias("errors"), level.alias("level"), F.concat(state["out"], F.array(level)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), steps), begin, one_day)["out"]
    return _forecast_days(ahead, path, steps, daily, keys, series)


def _forecast_days(ahead: DataFrame, path: Column, steps: Column, daily: DataFrame, keys: list[str], series: Sequence[str]) -> DataFrame:
    """The days from ``_from`` on with the forecasts of ``path``, whether they are test or future days, and what was ordered."""
    path = F.coalesce(path, F.array_repeat(F.lit(None).cast("double"), steps))
    days = ahead.select(*keys, "hi", "_from", F.posexplode(path).alias("_i", "forecast"))
    days = days.withColumn("day", F.date_add("_from", F.col("_i")))
    split = F.when(F.col("day") <= F.col("hi"), "test").otherwise("future")
    out = days.withColumn("split", split).join(daily.select(*keys, "day", F.col("orders").alias("actual")), [*keys, "day"], "left")
    return out.select(*series, "day", "split", "actual", "forecast").orderBy(*series, "day")


def autoregressive_forecast(
    facts: DataFrame,
    order: int = 5,
    series: Sequence[str] = (),
    test_days: int = TEST_DAYS,
    future_days: int = FUTURE_DAYS,
) -> DataFrame:
    """AR(``order``) without intercept on the first differences of the
    zero-filled daily series, fitted by least squares on the training days,
    forecast over the test days and the ``future_days`` after the last day; one
    series for each value of the ``series`` columns.

    Lags are windows within a series (one row a day), the normal equations sums
    over its days, the recursion a fold over the forecast days. A series with
    fewer differences than lags has no equations: its coefficients are zero and the
    forecast stays at the last training value (null without training days).
    """
    keys, span, daily = _daily_by_series(facts, series)
    train = daily.where(F.col("day") <= F.date_sub("hi", test_days))
    w = Window.partitionBy(*keys).orderBy("day")
    lags = [f"_d{i}" for i in range(order + 1)]  # _d0 is the day's own difference
    train = train.withColumn("_d0", F.col("orders") - F.lag("orders").over(w))
    train = train.withColumns({c: F.lag("_d0", i).over(w) for i, c in enumerate(lags) if i})
    whole = F.col(lags[-1]).isNotNull()
    # the rows of the normal equations, the right side (products with the day's own difference) last
    cells = [[F.coalesce(F.sum(F.when(whole, F.col(x) * F.col(y))), F.lit(0.0)) for y in [*lags[1:], lags[0]]] for x in lags[1:]]
    fitted = train.groupBy(*keys).agg(
        F.array(*[F.array(*row) for row in cells]).alias("_m"),
        F.max("day").alias("_last"),
        F.max_by(F.struct("orders", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in lags[:-1]]), "day").alias("_end"),
    )
    fitted = fitted.select(*keys, "_last", F.col("_end.orders").alias("_level"), F.array(*[F.col(f"_end.{c}") for c in lags[:-1]]).alias("_hist"), _solve(F.col("_m"), order).alias("_coef"))
    ahead = span.join(fitted, keys, "left").withColumn("_from", F.coalesce(F.date_add("_last", 1), "lo"))
    steps = F.datediff("hi", "_from") + 1 + future_days
    begin = F.struct(F.col("_hist").alias("hist"), F.col("_level").alias("level"), F.array().cast("array<double>").alias("out"))

    def one_day(state: Column, _: Column) -> Column:
        move = F.aggregate(F.zip_with("_coef", state["hist"], lambda c, d: c * d), F.lit(0.0), lambda s, x: s + x)
        level = state["level"] + move
        return F.struct(F.slice(F.concat(F.array(move), state["hist"]), 1, order).alias("hist"), level.alias("level"), F.concat(state["out"], F.array(level)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), steps), begin, one_day)["out"]
    return _forecast_days(ahead, path, steps, daily, keys, series)


def hourly_orders(facts: DataFrame) -> DataFrame:
    """Orders per observed (day, hour), with a timestamp key."""
    g = (
        facts.where(F.col("Order_Date").isNotNull() & F.col("Order_Hour").isNotNull())
        .groupBy(F.col("Order_Date").alias("day"), F.col("Order_Hour").alias("hour"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    ts = F.make_timestamp_ntz(F.year("day"), F.month("day"), F.dayofmonth("day"), F.col("hour"), F.lit(0), F.lit(0))
    return g.select(ts.alias("ts"), "day", "hour", "orders").orderBy("ts")


def hourly_features(facts: DataFrame, time_aligned: bool = False, series: Sequence[str] = ()) -> DataFrame:
    """Hour, weekday, day of month, month; lag_1d / lag_7d and the 7-day
    moving average, for each value of the ``series`` columns (null values left out).

    Default = reference semantics: lags are 24 / 168 *rows*
    back over observed hours and the 168-row mean includes the current row.
    ``time_aligned`` instead looks back by time: every hour between a series' first and last is there (0 for empty
    ones), lags are the orders of 24 / 168 hours before, and the mean is over the 168 hours before the current one.
    Rows without a full history are dropped. Windows hold one series' hours."""
    by = list(series)
    h = (
        facts.where(F.col("Order_Date").isNotNull() & F.col("Order_Hour").isNotNull())
        .dropna(subset=by)
        .groupBy(*by, F.make_timestamp_ntz(F.year("Order_Date"), F.month("Order_Date"), F.dayofmonth("Order_Date"), F.col("Order_Hour"), F.lit(0), F.lit(0)).alias("ts"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    if time_aligned:
        span = h.groupBy(*by).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).where(F.col("lo").isNotNull())
        spine = span.select(*by, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("ts"))
        h = spine.join(h, [*by, "ts"], "left").withColumn("orders", F.coalesce("orders", F.lit(0)))
    w = Window.partitionBy(*by).orderBy("ts")
    if time_aligned:
        # hours since a fixed one, so that frames are intervals of time
        h = h.withColumn("_hour", F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))
        timed = Window.partitionBy(*by).orderBy("_hour")
        lag = lambda n: F.sum("orders").over(timed.rangeBetween(-n, -n))
        frame = timed.rangeBetween(-168, -1)
    else:
        lag = lambda n: F.lag("orders", n).over(w)
        frame = w.rowsBetween(-167, 0)
    out = h.select(
        *by,
        "ts",
        F.hour("ts").alias("hour"),
        F.weekday("ts").alias("dayofweek"),
        F.dayofmonth("ts").alias("dayofmonth"),
        F.month("ts").alias("month"),
        F.col("orders").cast("double").alias("orders"),
        lag(24).cast("double").alias("lag_1d"),
        lag(168).cast("double").alias("lag_7d"),
        F.when(F.count("orders").over(frame) == 168, F.avg("orders").over(frame)).alias("ma_7d"),
    )
    return out.dropna().orderBy(*by, "ts")


def weekday_pattern(facts: DataFrame) -> DataFrame:
    """Mean orders per observed day, by weekday (dashboard view)."""
    d = daily_orders(facts, fill_missing=False)
    names = F.array(*[F.lit(x) for x in DAY_NAMES])
    return (
        d.groupBy(F.weekday("day").alias("dayofweek"))
        .agg(F.avg("orders").alias("avg_orders"))
        .select("dayofweek", F.element_at(names, F.col("dayofweek") + 1).alias("day_name"), "avg_orders")
        .orderBy("dayofweek")
    )


def hourly_pattern(facts: DataFrame) -> DataFrame:
    """Mean orders per observed (day, hour) cell, by hour of day."""
    return hourly_orders(facts).groupBy("hour").agg(F.avg("orders").alias("avg_orders")).orderBy("hour")


def forecast_insights(forecast: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Trend of the future forecast (last vs first), its peak day (first
    day of the maximum) and accuracy = 100 - 5 x MAE."""
    fut = forecast.where(F.col("split") == "future")
    s = fut.agg(
        F.min_by("forecast", "day").alias("_first"),
        F.max_by("forecast", "day").alias("_last"),
        F.max("forecast").alias("_peak"),
    )
    peak_day = fut.crossJoin(F.broadcast(s)).where(F.col("forecast") == F.col("_peak")).agg(F.min("day").alias("peak_day"))
    return s.crossJoin(peak_day).crossJoin(accuracy).select(
        F.when(F.col("_last") > F.col("_first"), "upward").otherwise("downward").alias("trend"),
        "peak_day",
        (F.lit(100.0) - F.col("mae") * 5.0).alias("accuracy_pct"),
    )


def ma_forecast_insights(facts: DataFrame) -> DataFrame:
    """D11 on the moving-average forecast."""
    fc = moving_average_forecast(facts)
    return forecast_insights(fc, forecast_accuracy(fc))


def history_and_forecast(facts: DataFrame) -> DataFrame:
    """Z9 chart feed: the daily history followed by the forecast."""
    hist = daily_orders(facts).select("day", F.lit("history").alias("split"), F.col("orders").cast("double").alias("actual"),
                                      F.lit(None).cast("double").alias("forecast"))
    return hist.unionByName(moving_average_forecast(facts)).orderBy("day", "split")
