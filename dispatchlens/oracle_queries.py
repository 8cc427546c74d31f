"""Oracle SQL (DuckDB) for every registered deterministic query."""

from __future__ import annotations

from dispatchlens.oracle import with_facts

# Factors present in the base fact table (Route_Type appears only after the
# clustering enrichment).
PROFIT_FACTORS_BASE = ("City", "Type_of_vehicle", "Weatherconditions", "Road_traffic_density", "IsWeekend", "IsPeakHour", "IsHoliday")
SEGMENT_FACTORS = ("City", "Type_of_vehicle", "Weatherconditions", "Road_traffic_density", "IsWeekend", "IsPeakHour")
DESCRIBE_COLUMNS = (
    "Order_Date", "Restaurant_latitude", "Restaurant_longitude", "Delivery_location_latitude",
    "Delivery_location_longitude", "Delivery_person_Age", "Delivery_person_Ratings", "Time_taken_min",
    "Distance_km", "Route_Efficiency", "Actual_Distance_km", "Order_Datetime", "Pickup_Datetime",
    "Order_Hour", "Pickup_Hour", "Order_Minute", "Pickup_Minute", "DayOfWeek", "Month", "Year", "Day",
    "IsWeekend", "IsHoliday", "IsPeakHour", "Order_To_Pickup_Minutes", "Wait_Time_Minutes",
    "Delivery_Speed", "Restaurant_Prep_Time", "Delivery_Person_Efficiency", "Restaurant_Efficiency",
    "Time_Cost", "Distance_Cost", "Fuel_Cost", "Maintenance_Cost", "Total_Variable_Cost", "Total_Cost",
    "Revenue", "Profit", "CO2_Emissions", "Fuel_Consumption",
)
_TEMPORAL = {"Order_Date", "Order_Datetime", "Pickup_Datetime"}


def r(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


def factor_long(factors, measures, src="facts") -> str:
    parts = [
        f"SELECT '{f}' AS factor, CAST({f} AS VARCHAR) AS value, {', '.join(measures)} FROM {src}"
        for f in factors
    ]
    return "\nUNION ALL ".join(parts)


def _describe() -> str:
    def v(c):
        if c in _TEMPORAL:
            return f"CAST(date_diff('second', TIMESTAMP '1970-01-01', CAST({c} AS TIMESTAMP)) AS DOUBLE)"
        return f"CAST({c} AS DOUBLE)"

    items = ", ".join(f"struct_pack(col := '{c}', v := {v(c)})" for c in DESCRIBE_COLUMNS)
    long_cte = f"lng AS (SELECT UNNEST([{items}], recursive := true) FROM facts)"
    body = f"""SELECT col AS "column", count(v) AS "count", {r('avg(v)', 'mean')}, {r('min(v)', '"min"')},
  {r('quantile_cont(v, 0.25)', 'p25')}, {r('quantile_cont(v, 0.5)', 'p50')}, {r('quantile_cont(v, 0.75)', 'p75')},
  {r('max(v)', '"max"')}, {r('stddev_samp(v)', 'std')}
FROM lng WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY col"""
    return with_facts(body, long_cte)


def _profit_stats(src: str, keys: str) -> str:
    return f"""SELECT {keys}, {r('avg(Profit)', 'profit_mean')}, {r('median(Profit)', 'profit_median')},
  {r('stddev_samp(Profit)', 'profit_std')}, count(Profit) AS profit_count,
  {r('avg(Total_Cost)', 'total_cost_mean')}, {r('avg(Revenue)', 'revenue_mean')}"""


ORACLE: dict[str, str] = {}

ORACLE["overall_metrics"] = _describe()
ORACLE["profitable_pct"] = with_facts(
    f"SELECT {r('avg(CASE WHEN Profit > 0 THEN 1 ELSE 0 END) * 100e0', 'profitable_pct')} FROM facts"
)
ORACLE["profit_by_factor"] = with_facts(
    _profit_stats("lng", "factor, value")
    + f", {r('avg(Profit) / NULLIF(avg(Revenue), 0) * 100e0', 'profit_margin_pct')}"
    + " FROM lng WHERE value IS NOT NULL GROUP BY factor, value",
    f"lng AS ({factor_long(PROFIT_FACTORS_BASE, ['Profit', 'Total_Cost', 'Revenue'])})",
)
ORACLE["profit_by_hour"] = with_facts(
    _profit_stats("facts", "Order_Hour") + " FROM facts WHERE Order_Hour IS NOT NULL GROUP BY Order_Hour"
)
ORACLE["profit_by_day"] = with_facts(
    _profit_stats("facts", "DayOfWeek")
    + ", (['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'])[DayOfWeek + 1] AS day_name"
    + " FROM facts WHERE DayOfWeek IS NOT NULL GROUP BY DayOfWeek"
)

_SCORE = ("Distance_km", "Time_taken_min", "Wait_Time_Minutes", "Delivery_person_Ratings")


def _score_ctes(factors=PROFIT_FACTORS_BASE, src: str = "facts") -> list[str]:
    fs = ", ".join(factors)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in (*_SCORE, *factors, "Profit"))
    bounds = ", ".join([f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _SCORE])
    scaled = ", ".join(
        f"CASE WHEN mx_{c} - mn_{c} = 0 THEN 0e0 ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) END AS {c}_scaled" for c in _SCORE
    )
    return [
        f"sb AS (SELECT Order_ID, {', '.join(_SCORE)}, {fs}, Profit FROM {src} WHERE {notnull})",
        f"bnd AS (SELECT {bounds} FROM sb)",
        f"sc AS (SELECT sb.*, {scaled} FROM sb, bnd)",
        "scored AS (SELECT *, ((1e0 - Distance_km_scaled) + (1e0 - Time_taken_min_scaled) + (1e0 - Wait_Time_Minutes_scaled)"
        " + Delivery_person_Ratings_scaled) / 4e0 AS Profit_Score FROM sc)",
    ]


ORACLE["profit_score"] = with_facts(
    f"SELECT Order_ID, {', '.join(PROFIT_FACTORS_BASE)}, {r('Profit', 'Profit')}, "
    + ", ".join(r(f"{c}_scaled", f"{c}_scaled") for c in _SCORE)
    + f", {r('Profit_Score', 'Profit_Score')} FROM scored",
    *_score_ctes(),
)
ORACLE["top_scenarios"] = with_facts(
    f"""SELECT {', '.join(PROFIT_FACTORS_BASE)}, {r('avg(Profit_Score)', 'score_mean')}, {r('stddev_samp(Profit_Score)', 'score_std')},
  count(Profit_Score) AS score_count, {r('avg(Profit)', 'profit_mean')}, {r('stddev_samp(Profit)', 'profit_std')}
FROM scored GROUP BY {', '.join(PROFIT_FACTORS_BASE)} HAVING count(Profit_Score) >= 10
ORDER BY avg(Profit_Score) DESC, {', '.join(PROFIT_FACTORS_BASE)} LIMIT 10""",
    *_score_ctes(),
)

# --- efficiency (E1-E9) -----------------------------------------------------
ORACLE["delivery_kpis"] = with_facts(
    f"""SELECT {r('avg(Time_taken_min)', 'avg_delivery_time')}, {r('median(Time_taken_min)', 'median_delivery_time')},
  {r('avg(Distance_km)', 'avg_distance')}, {r('avg(Distance_km / NULLIF(Time_taken_min / 60e0, 0))', 'avg_speed_kmph')} FROM facts"""
)
ORACLE["on_time_rate"] = with_facts(
    f"SELECT {r('avg(CASE WHEN Time_taken_min <= 30 THEN 1 ELSE 0 END) * 100e0', 'on_time_rate')} FROM facts"
)
ORACLE["efficiency_by_factor"] = with_facts(
    f"""SELECT factor, value, {r('avg(Time_taken_min)', 'time_mean')}, {r('median(Time_taken_min)', 'time_median')},
  {r('stddev_samp(Time_taken_min)', 'time_std')}, {r('avg(Distance_km)', 'distance_mean')},
  {r('avg(Delivery_Speed)', 'speed_mean')}, {r('stddev_samp(Delivery_Speed)', 'speed_std')},
  {r('avg(Distance_km) / NULLIF(avg(Time_taken_min) / 60e0, 0)', 'avg_speed_kmph')}
FROM lng WHERE value IS NOT NULL GROUP BY factor, value""",
    f"lng AS ({factor_long(SEGMENT_FACTORS, ['Time_taken_min', 'Distance_km', 'Delivery_Speed'])})",
)
ORACLE["bottleneck_kpis"] = with_facts(
    f"SELECT {r('avg(Wait_Time_Minutes)', 'avg_wait_time')}, {r('avg(Restaurant_Prep_Time)', 'restaurant_prep_time')} FROM facts"
)
ORACLE["restaurant_efficiency_rank"] = with_facts(
    f"SELECT Restaurant_ID, {r('avg(Restaurant_Efficiency)', 'restaurant_efficiency')} FROM facts "
    "WHERE Restaurant_ID IS NOT NULL GROUP BY Restaurant_ID"
)
ORACLE["delay_by_hour"] = with_facts(
    f"""SELECT Order_Hour, {r('avg(Order_To_Pickup_Minutes)', 'delay_mean')}, {r('median(Order_To_Pickup_Minutes)', 'delay_median')},
  {r('stddev_samp(Order_To_Pickup_Minutes)', 'delay_std')} FROM facts WHERE Order_Hour IS NOT NULL GROUP BY Order_Hour"""
)
ORACLE["restaurant_delays"] = with_facts(
    f"""SELECT Restaurant_ID, {r('avg(Order_To_Pickup_Minutes)', 'delay_mean')}, {r('median(Order_To_Pickup_Minutes)', 'delay_median')},
  count(Order_To_Pickup_Minutes) AS delay_count FROM facts WHERE Restaurant_ID IS NOT NULL GROUP BY Restaurant_ID
HAVING count(Order_To_Pickup_Minutes) >= 10"""
)
ORACLE["avg_time_by_factor_union"] = with_facts(
    f"SELECT factor AS dimension, value AS Factor, {r('avg(Time_taken_min)', 'Avg_Time')} FROM lng "
    "WHERE value IS NOT NULL GROUP BY factor, value",
    f"lng AS ({factor_long(('Road_traffic_density', 'Weatherconditions', 'Type_of_vehicle'), ['Time_taken_min'])})",
)
ORACLE["executive_kpis"] = with_facts(
    f"""SELECT {r('avg(Profit)', 'avg_profit')}, {r('avg(CASE WHEN Profit > 0 THEN 1 ELSE 0 END) * 100e0', 'profitable_pct')},
  count(DISTINCT Order_ID) AS total_orders, {r('avg(Time_taken_min)', 'avg_time')}, {r('avg(Distance_km)', 'avg_distance')},
  {r('avg(Distance_km) / NULLIF(avg(Time_taken_min) / 60e0, 0)', 'avg_speed_kmph')} FROM facts"""
)

# --- drivers and shifts (V1-V6) ---------------------------------------------
_HD = "hd AS (SELECT DayOfWeek, Order_Hour, count(*) AS orders FROM facts WHERE DayOfWeek IS NOT NULL AND Order_Hour IS NOT NULL GROUP BY DayOfWeek, Order_Hour)"
ORACLE["hourly_demand_matrix"] = with_facts(
    "SELECT DayOfWeek, "
    + ", ".join(f"CAST(COALESCE(sum(orders) FILTER (WHERE Order_Hour = {h}), 0) AS BIGINT) AS hour_{h}" for h in range(24))
    + " FROM hd GROUP BY DayOfWeek",
    _HD,
)
ORACLE["drivers_needed"] = with_facts(
    """SELECT d.DayOfWeek, h.Order_Hour, COALESCE(hd.orders, 0) AS orders,
  CAST(round_even(COALESCE(hd.orders, 0) / 2e0, 0) AS INTEGER) AS drivers_needed
FROM (SELECT DISTINCT DayOfWeek FROM hd) d CROSS JOIN (SELECT DISTINCT Order_Hour FROM hd) h
LEFT JOIN hd ON hd.DayOfWeek = d.DayOfWeek AND hd.Order_Hour = h.Order_Hour""",
    _HD,
)
ORACLE["driver_metrics"] = with_facts(
    f"""SELECT Delivery_person_ID, count(Order_ID) AS order_count, {r('sum(Time_taken_min)', 'time_sum')},
  {r('avg(Time_taken_min)', 'time_mean')}, {r('sum(Distance_km)', 'distance_sum')}, {r('avg(Distance_km)', 'distance_mean')},
  {r('sum(Profit)', 'profit_sum')}, {r('avg(Profit)', 'profit_mean')},
  {r('count(Order_ID) / (SELECT CAST(count(DISTINCT Order_Date) AS DOUBLE) FROM facts)', 'deliveries_per_day')},
  {r('sum(Profit) / NULLIF(sum(Time_taken_min), 0)', 'profit_per_minute')},
  {r('sum(Profit) / NULLIF(sum(Distance_km), 0)', 'profit_per_km')}
FROM facts WHERE Delivery_person_ID IS NOT NULL GROUP BY Delivery_person_ID"""
)
ORACLE["high_rated_drivers"] = with_facts(
    f"""SELECT Delivery_person_ID, {r('avg(Delivery_person_Ratings)', 'rating_mean')}, count(Delivery_person_Ratings) AS rating_count
FROM facts WHERE Delivery_person_ID IS NOT NULL GROUP BY Delivery_person_ID HAVING count(Delivery_person_Ratings) >= 10"""
)
_SHIFT = "CASE WHEN Order_Hour >= 6 AND Order_Hour < 14 THEN 0 WHEN Order_Hour >= 14 AND Order_Hour < 22 THEN 1 ELSE 2 END"
ORACLE["shift_allocation"] = with_facts(
    """SELECT sp.DayOfWeek,
  (['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'])[sp.DayOfWeek + 1] AS day,
  sp.shift_index, (['Morning (6 AM - 2 PM)','Afternoon (2 PM - 10 PM)','Night (10 PM - 6 AM)'])[sp.shift_index + 1] AS shift,
  CAST(COALESCE(ps.orders, 0) AS BIGINT) AS orders,
  CAST(greatest(1, floor(COALESCE(ps.orders, 0) / 16e0)) AS INTEGER) AS drivers_needed
FROM (SELECT CAST(i // 3 AS INTEGER) AS DayOfWeek, CAST(i % 3 AS INTEGER) AS shift_index FROM range(21) t(i)) sp
LEFT JOIN ps ON ps.DayOfWeek = sp.DayOfWeek AND ps.shift_index = sp.shift_index""",
    f"ps AS (SELECT DayOfWeek, {_SHIFT} AS shift_index, count(*) AS orders FROM facts "
    "WHERE DayOfWeek IS NOT NULL AND Order_Hour IS NOT NULL GROUP BY 1, 2)",
)
ORACLE["driver_leaderboard"] = with_facts(
    f"""SELECT Delivery_person_ID, count(Order_ID) AS orders, {r('avg(Time_taken_min)', 'avg_time')},
  {r('avg(Profit)', 'avg_profit')}, {r('avg(Delivery_person_Ratings)', 'rating')}
FROM facts WHERE Delivery_person_ID IS NOT NULL GROUP BY Delivery_person_ID ORDER BY avg(Profit) DESC, Delivery_person_ID LIMIT 10"""
)
ORACLE["city_vehicle_efficiency"] = with_facts(
    f"""SELECT City, Type_of_vehicle, {r('avg(Time_taken_min)', 'time_mean')}, {r('avg(Distance_km)', 'distance_mean')},
  {r('avg(Profit)', 'profit_mean')}, {r('avg(Distance_km) / NULLIF(avg(Time_taken_min) / 60e0, 0)', 'speed_kmph')},
  {r('avg(Profit) / NULLIF(avg(Time_taken_min) / 60e0, 0)', 'profit_per_hour')}
FROM facts WHERE City IS NOT NULL AND Type_of_vehicle IS NOT NULL GROUP BY City, Type_of_vehicle"""
)

# --- pricing (X1-X10) -------------------------------------------------------
# The surge factors, written out here too so that a wrong constant in the library shows.
TRAFFIC_SURGE = {"Jam": 1.4, "High": 1.3, "Medium": 1.15, "Low": 1.0}
WEATHER_SURGE = {"Fog": 1.3, "Stormy": 1.4, "Sandstorms": 1.35, "Windy": 1.2, "Cloudy": 1.1, "Sunny": 1.0}
HOUR_SURGE = dict(enumerate([
    1.2, 1.3, 1.4, 1.5, 1.4, 1.3, 1.1, 1.2, 1.3, 1.1, 1.0, 1.1,
    1.2, 1.1, 1.0, 1.0, 1.1, 1.2, 1.3, 1.4, 1.3, 1.2, 1.1, 1.2,
]))

_PRICES = "prices AS (SELECT CAST(range AS BIGINT) AS Base_Price FROM range(50, 201, 5))"


def _grid_select(keys: str, src: str, where: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}Base_Price, {r('avg(Base_Price - Total_Cost)', 'Average_Profit')},
  {r('avg(Base_Price - Total_Cost) / Base_Price * 100e0', 'Profit_Margin_Pct')},
  {r('avg(CASE WHEN Base_Price - Total_Cost > 0 THEN 1 ELSE 0 END) * 100e0', 'Profitable_Deliveries_Pct')}
FROM prices CROSS JOIN {src} WHERE Total_Cost IS NOT NULL {where} GROUP BY {k}Base_Price"""


ORACLE["price_grid"] = with_facts(_grid_select("", "facts"), _PRICES)
ORACLE["optimal_uniform_price"] = with_facts(
    "SELECT * FROM g ORDER BY (Profitable_Deliveries_Pct >= 90) DESC, Average_Profit DESC, Base_Price LIMIT 1",
    _PRICES,
    f"g AS ({_grid_select('', 'facts')})",
)
_SEG_CTES = [
    _PRICES,
    f"lng AS ({factor_long(SEGMENT_FACTORS, ['Total_Cost'])})",
    "seg AS (SELECT factor, value, count(*) AS sample_size FROM lng WHERE value IS NOT NULL AND Total_Cost IS NOT NULL "
    "GROUP BY factor, value HAVING count(*) >= 100)",
    "lng2 AS (SELECT lng.*, seg.sample_size FROM lng JOIN seg USING (factor, value))",
]
ORACLE["segment_price_grid"] = with_facts(
    _grid_select("factor, value", "lng2").replace("SELECT factor, value,", "SELECT factor, value, any_value(sample_size) AS sample_size,", 1),
    *_SEG_CTES,
)
ORACLE["segment_optimal_prices"] = with_facts(
    """SELECT factor, value, Base_Price AS optimal_price, Average_Profit AS average_profit, Profit_Margin_Pct AS profit_margin,
  Profitable_Deliveries_Pct AS profitable_pct, sample_size
FROM (SELECT *, row_number() OVER (PARTITION BY factor, value ORDER BY (Profitable_Deliveries_Pct >= 90) DESC,
  Average_Profit DESC, Base_Price) AS rk FROM g) WHERE rk = 1""",
    *_SEG_CTES,
    "g AS (" + _grid_select("factor, value", "lng2").replace("SELECT factor, value,", "SELECT factor, value, any_value(sample_size) AS sample_size,", 1) + ")",
)


def _case(col: str, mapping: dict, quote: bool) -> str:
    whens = " ".join(f"WHEN {col} = {repr(k) if quote else k} THEN {float(v)!r}e0".replace("e0e0", "e0") for k, v in mapping.items())
    return f"COALESCE(CASE {whens} END, 1e0)"


DYN_MULT = (
    "((((((1e0 * CASE WHEN IsPeakHour = 1 THEN 1.5e0 ELSE 1e0 END)"
    " * CASE WHEN IsWeekend = 1 THEN 1.2e0 ELSE 1e0 END)"
    " * CASE WHEN IsHoliday = 1 THEN 1.3e0 ELSE 1e0 END)"
    f" * {_case('Road_traffic_density', TRAFFIC_SURGE, True)})"
    f" * {_case('Weatherconditions', WEATHER_SURGE, True)})"
    f" * {_case('Order_Hour', HOUR_SURGE, False)})"
)
_DYN = f"dyn AS (SELECT *, {DYN_MULT} AS Dynamic_Multiplier, 100e0 * {DYN_MULT} AS Dynamic_Price, 100e0 * {DYN_MULT} - Total_Cost AS Dynamic_Profit FROM facts)"
ORACLE["dynamic_prices"] = with_facts(
    f"SELECT Order_ID, {r('Dynamic_Multiplier', 'Dynamic_Multiplier')}, {r('Dynamic_Price', 'Dynamic_Price')}, "
    f"{r('Dynamic_Profit', 'Dynamic_Profit')} FROM dyn",
    _DYN,
)
ORACLE["pricing_strategy_compare"] = with_facts(
    f"""SELECT 'static' AS strategy, {r('sum(Profit)', 'total_profit')}, {r('avg(Profit)', 'avg_profit_per_order')},
  {r('avg(CASE WHEN Profit > 0 THEN 1 ELSE 0 END) * 100e0', 'profitable_orders_pct')},
  CAST(NULL AS DOUBLE) AS profit_increase, CAST(NULL AS DOUBLE) AS profit_increase_pct FROM dyn
UNION ALL
SELECT 'dynamic', {r('sum(Dynamic_Profit)', 'total_profit')}, {r('avg(Dynamic_Profit)', 'avg_profit_per_order')},
  {r('avg(CASE WHEN Dynamic_Profit > 0 THEN 1 ELSE 0 END) * 100e0', 'profitable_orders_pct')},
  {r('sum(Dynamic_Profit) - sum(Profit)', 'profit_increase')},
  {r('(sum(Dynamic_Profit) - sum(Profit)) / NULLIF(abs(sum(Profit)), 0) * 100e0', 'profit_increase_pct')} FROM dyn""",
    _DYN,
)
_EDGES = (
    "bnd AS (SELECT min(Dynamic_Price) AS mn, max(Dynamic_Price) AS mx FROM dyn WHERE Dynamic_Price IS NOT NULL),"
    "\nedges AS (SELECT list_transform(range(0, 11), lambda i: CASE WHEN i = 0 THEN mn - (mx - mn) * 0.001e0 "
    "WHEN i = 10 THEN mx ELSE i * ((mx - mn) / 10e0) + mn END) AS e FROM bnd)"
)
ORACLE["price_elasticity_bins"] = with_facts(
    f"""SELECT CAST(b AS INTEGER) AS bin, {r('e[b]', 'lower')}, {r('e[b + 1]', 'upper')}, CAST(COALESCE(c.orders, 0) AS BIGINT) AS orders
FROM edges CROSS JOIN range(1, 11) t(b) LEFT JOIN (
  SELECT 1 + len(list_filter(e[2:10], lambda x: x < Dynamic_Price)) AS bn, count(*) AS orders
  FROM dyn CROSS JOIN edges WHERE Dynamic_Price IS NOT NULL GROUP BY 1) c ON c.bn = t.b""",
    _DYN,
    _EDGES,
)
ORACLE["multiplier_stats"] = with_facts(
    f"""SELECT 'Dynamic_Multiplier' AS "column", count(Dynamic_Multiplier) AS "count", {r('avg(Dynamic_Multiplier)', 'mean')},
  {r('min(Dynamic_Multiplier)', '"min"')}, {r('quantile_cont(Dynamic_Multiplier, 0.25)', 'p25')},
  {r('quantile_cont(Dynamic_Multiplier, 0.5)', 'p50')}, {r('quantile_cont(Dynamic_Multiplier, 0.75)', 'p75')},
  {r('max(Dynamic_Multiplier)', '"max"')}, {r('stddev_samp(Dynamic_Multiplier)', 'std')} FROM dyn""",
    _DYN,
)

# --- demand (D1-D11) --------------------------------------------------------
_CNT = "cnt AS (SELECT Order_Date AS day, count(*) AS orders FROM facts WHERE Order_Date IS NOT NULL GROUP BY 1)"
_DAILY = (
    "daily AS (SELECT CAST(s.d AS DATE) AS day, COALESCE(c.orders, 0) AS orders FROM "
    "(SELECT unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM cnt) s "
    "LEFT JOIN cnt c ON c.day = CAST(s.d AS DATE))"
)
_HS = "hs AS (SELECT *, CASE WHEN day > (SELECT max(day) FROM daily) - 14 THEN 'test' ELSE 'train' END AS split FROM daily)"
_MA = [
    _CNT, _DAILY, _HS,
    "tr AS (SELECT day, orders, row_number() OVER (ORDER BY day DESC) AS rn FROM hs WHERE split = 'train')",
    "lvl AS (SELECT CASE WHEN count(*) FILTER (WHERE rn <= 7) = 7 THEN avg(orders) FILTER (WHERE rn <= 7) ELSE avg(orders) END AS f FROM tr)",
    "fc0 AS (SELECT day, split, CAST(orders AS DOUBLE) AS actual FROM hs WHERE split = 'test' UNION ALL "
    "SELECT CAST(d AS DATE), 'future', CAST(NULL AS DOUBLE) FROM (SELECT unnest(generate_series("
    "CAST((SELECT max(day) FROM daily) + 1 AS TIMESTAMP), CAST((SELECT max(day) FROM daily) + 30 AS TIMESTAMP), INTERVAL 1 DAY)) AS d))",
    "fc AS (SELECT day, split, actual, f AS forecast FROM fc0, lvl)",
    "acc AS (SELECT avg(abs(actual - forecast)) AS mae, sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse "
    "FROM fc WHERE split = 'test' AND actual IS NOT NULL)",
]
ORACLE["daily_orders"] = with_facts("SELECT day, orders FROM daily", _CNT, _DAILY)
ORACLE["holdout_split"] = with_facts("SELECT day, orders, split FROM hs", _CNT, _DAILY, _HS)
_HSF = (
    "hsf AS (SELECT day, orders, CASE WHEN row_number() OVER (ORDER BY day) <= floor((SELECT count(*) FROM cnt) * 0.8e0) "
    "THEN 'train' ELSE 'test' END AS split FROM cnt WHERE (SELECT count(*) FROM cnt) >= 14)"
)
ORACLE["holdout_split_fraction"] = with_facts("SELECT day, orders, split FROM hsf", _CNT, _HSF)
ORACLE["moving_average_forecast_fraction"] = with_facts(
    f"SELECT day, split, {r('actual', 'actual')}, {r('forecast', 'forecast')} FROM fc",
    _CNT, _HSF,
    "roll AS (SELECT day, CASE WHEN count(*) OVER w = 7 THEN avg(orders) OVER w END AS ma FROM hsf WHERE split = 'train' "
    "WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))",
    "fill AS (SELECT day, first_value(ma IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ma FROM roll)",
    "fc AS (SELECT day, split, CAST(orders AS DOUBLE) AS actual, (SELECT max_by(ma, day) FROM fill) AS forecast FROM hsf WHERE split = 'test' UNION ALL "
    "SELECT CAST(d AS DATE), 'future', CAST(NULL AS DOUBLE), (SELECT max_by(ma, day) FROM fill) FROM (SELECT unnest(generate_series("
    "CAST((SELECT max(day) FROM hsf) + 1 AS TIMESTAMP), CAST((SELECT max(day) FROM hsf) + 30 AS TIMESTAMP), INTERVAL 1 DAY)) AS d))",
)
ORACLE["moving_average_forecast"] = with_facts(
    f"SELECT day, split, {r('actual', 'actual')}, {r('forecast', 'forecast')} FROM fc", *_MA
)
ORACLE["ma_forecast_accuracy"] = with_facts(f"SELECT {r('mae', 'mae')}, {r('rmse', 'rmse')} FROM acc", *_MA)
ORACLE["ma_forecast_insights"] = with_facts(
    f"""SELECT CASE WHEN max_by(forecast, day) > min_by(forecast, day) THEN 'upward' ELSE 'downward' END AS trend,
  (SELECT min(day) FROM fc WHERE split = 'future' AND forecast = (SELECT max(forecast) FROM fc WHERE split = 'future')) AS peak_day,
  {r('100e0 - (SELECT mae FROM acc) * 5e0', 'accuracy_pct')} FROM fc WHERE split = 'future'""",
    *_MA,
)
ORACLE["history_and_forecast"] = with_facts(
    f"""SELECT day, 'history' AS split, {r('CAST(orders AS DOUBLE)', 'actual')}, CAST(NULL AS DOUBLE) AS forecast FROM daily
UNION ALL SELECT day, split, {r('actual', 'actual')}, {r('forecast', 'forecast')} FROM fc""",
    *_MA,
)
_HO = (
    "ho AS (SELECT CAST(Order_Date AS TIMESTAMP) + to_hours(Order_Hour) AS ts, Order_Date AS day, Order_Hour AS hour, "
    "count(*) AS orders FROM facts WHERE Order_Date IS NOT NULL AND Order_Hour IS NOT NULL "
    "GROUP BY Order_Date, Order_Hour)"
)
ORACLE["hourly_orders"] = with_facts("SELECT ts, day, hour, orders FROM ho", _HO)
ORACLE["hourly_features"] = with_facts(
    f"""SELECT * FROM (
  SELECT ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek,
    CAST(day(ts) AS INTEGER) AS dayofmonth, CAST(month(ts) AS INTEGER) AS month, CAST(orders AS DOUBLE) AS orders,
    CAST(lag(orders, 24) OVER w AS DOUBLE) AS lag_1d, CAST(lag(orders, 168) OVER w AS DOUBLE) AS lag_7d,
    {r('CASE WHEN count(orders) OVER m = 168 THEN avg(orders) OVER m END', 'ma_7d')}
  FROM ho WINDOW w AS (ORDER BY ts), m AS (ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW))
WHERE lag_1d IS NOT NULL AND lag_7d IS NOT NULL AND ma_7d IS NOT NULL""",
    _HO,
)
ORACLE["weekday_pattern"] = with_facts(
    f"""SELECT CAST(isodow(day) - 1 AS INTEGER) AS dayofweek,
  (['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'])[isodow(day)] AS day_name,
  {r('avg(orders)', 'avg_orders')} FROM cnt GROUP BY 1, 2""",
    _CNT,
)
ORACLE["hourly_pattern"] = with_facts(f"SELECT hour, {r('avg(orders)', 'avg_orders')} FROM ho GROUP BY hour", _HO)

# --- density clustering (C1, T3, T4) ------------------------------------------


def dbscan_ctes(x: str, y: str, eps: float, min_samples: int, weighted: bool, p: str = "") -> list[str]:
    """CTEs {p}lab(x, y, weight, is_core, cluster) for DBSCAN on (x, y)."""
    w = "count(*)" if weighted else "1"
    e2 = f"{eps!r}e0 * {eps!r}e0".replace("e0e0", "e0")
    return [
        f"{p}pts AS (SELECT {x} AS x, {y} AS y, CAST({w} AS BIGINT) AS weight FROM facts WHERE {x} IS NOT NULL AND {y} IS NOT NULL "
        f"AND NOT isnan({x}) AND NOT isnan({y}) GROUP BY {x}, {y})",
        f"{p}pairs AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, b.weight AS bw FROM {p}pts a JOIN {p}pts b "
        f"ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {e2})",
        f"{p}core AS (SELECT ax AS x, ay AS y FROM {p}pairs GROUP BY ax, ay HAVING sum(bw) >= {min_samples})",
        f"{p}edges AS (SELECT p.ax, p.ay, p.bx, p.by FROM {p}pairs p JOIN {p}core c1 ON c1.x = p.ax AND c1.y = p.ay "
        f"JOIN {p}core c2 ON c2.x = p.bx AND c2.y = p.by)",
        f"{p}reach AS (SELECT * FROM (WITH RECURSIVE rr(x, y, rx, ry) AS (SELECT x, y, x, y FROM {p}core UNION "
        f"SELECT e.bx, e.by, rr.rx, rr.ry FROM rr JOIN {p}edges e ON e.ax = rr.x AND e.ay = rr.y) SELECT * FROM rr))",
        f"{p}roots AS (SELECT x, y, min([rx, ry]) AS root FROM {p}reach GROUP BY x, y)",
        f"{p}ids AS (SELECT root, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT root FROM {p}roots))",
        f"{p}corelab AS (SELECT r.x, r.y, i.cluster FROM {p}roots r JOIN {p}ids i ON i.root = r.root)",
        f"{p}border AS (SELECT p.ax AS x, p.ay AS y, min(c.cluster) AS bc FROM {p}pairs p JOIN {p}corelab c ON c.x = p.bx AND c.y = p.by GROUP BY 1, 2)",
        f"{p}lab AS (SELECT t.x, t.y, t.weight, c.cluster IS NOT NULL AS is_core, "
        f"CAST(COALESCE(c.cluster, b.bc, -1) AS INTEGER) AS cluster FROM {p}pts t "
        f"LEFT JOIN {p}corelab c ON c.x = t.x AND c.y = t.y LEFT JOIN {p}border b ON b.x = t.x AND b.y = t.y)",
    ]


def _sites_sql(x: str, y: str, eps: float, ms: int, weighted: bool) -> str:
    return with_facts(
        f"SELECT x AS {x}, y AS {y}, weight, is_core, cluster FROM lab", *dbscan_ctes(x, y, eps, ms, weighted)
    )


ORACLE["restaurant_sites"] = _sites_sql("Restaurant_latitude", "Restaurant_longitude", 0.02, 5, True)
ORACLE["restaurant_sites_distinct"] = _sites_sql("Restaurant_latitude", "Restaurant_longitude", 0.01, 10, False)
ORACLE["delivery_sites"] = _sites_sql("Delivery_location_latitude", "Delivery_location_longitude", 0.02, 5, True)


def _hot_sql(x: str, y: str, p: str = "") -> tuple[str, list[str]]:
    body = (
        f"SELECT cluster, sum(x * weight) / sum(weight) AS latitude, sum(y * weight) / sum(weight) AS longitude, "
        f"CAST(sum(weight) AS BIGINT) AS count FROM {p}lab WHERE cluster >= 0 GROUP BY cluster"
    )
    return body, dbscan_ctes(x, y, 0.01, 10, True, p)


for _name, (_x, _y) in {
    "pickup_hotspots": ("Restaurant_latitude", "Restaurant_longitude"),
    "dropoff_hotspots": ("Delivery_location_latitude", "Delivery_location_longitude"),
}.items():
    _b, _c = _hot_sql(_x, _y)
    ORACLE[_name] = with_facts(
        f"SELECT cluster, {r('latitude', 'latitude')}, {r('longitude', 'longitude')}, count FROM ({_b})", *_c
    )
_pb, _pc = _hot_sql("Restaurant_latitude", "Restaurant_longitude", "pk_")
_db, _dc = _hot_sql("Delivery_location_latitude", "Delivery_location_longitude", "dr_")
ORACLE["hotspot_center"] = with_facts(
    f"""SELECT {r('(p.plat + d.dlat) / 2e0', 'center_latitude')}, {r('(p.plon + d.dlon) / 2e0', 'center_longitude')}
FROM (SELECT avg(latitude) AS plat, avg(longitude) AS plon FROM ({_pb})) p,
     (SELECT avg(latitude) AS dlat, avg(longitude) AS dlon FROM ({_db})) d""",
    *_pc, *_dc,
)

# --- cluster-enriched facts (R6, R7, T1, T2) ------------------------------------
_ENR = [
    *dbscan_ctes("Restaurant_latitude", "Restaurant_longitude", 0.02, 5, True, "rc_"),
    *dbscan_ctes("Delivery_location_latitude", "Delivery_location_longitude", 0.02, 5, True, "dc_"),
    "enr0 AS (SELECT f.*, CAST(COALESCE(r.cluster, -1) AS INTEGER) AS Restaurant_Cluster, "
    "CAST(COALESCE(d.cluster, -1) AS INTEGER) AS Delivery_Cluster FROM facts f "
    "LEFT JOIN rc_lab r ON r.x = f.Restaurant_latitude AND r.y = f.Restaurant_longitude "
    "LEFT JOIN dc_lab d ON d.x = f.Delivery_location_latitude AND d.y = f.Delivery_location_longitude)",
    "enr AS (SELECT *, CAST(Restaurant_Cluster AS VARCHAR) || '_' || CAST(Delivery_Cluster AS VARCHAR) AS Route_Type FROM enr0)",
]
ORACLE["restaurant_cluster_profit"] = with_facts(
    f"""SELECT Restaurant_Cluster, {r('avg(Profit)', 'profit_mean')}, count(Profit) AS profit_count,
  {r('avg(Restaurant_latitude)', 'latitude_mean')}, {r('avg(Restaurant_longitude)', 'longitude_mean')}
FROM enr GROUP BY Restaurant_Cluster""",
    *_ENR,
)
ORACLE["delivery_cluster_profit"] = with_facts(
    f"""SELECT Delivery_Cluster, {r('avg(Profit)', 'profit_mean')}, count(Profit) AS profit_count,
  {r('avg(Delivery_location_latitude)', 'latitude_mean')}, {r('avg(Delivery_location_longitude)', 'longitude_mean')}
FROM enr GROUP BY Delivery_Cluster""",
    *_ENR,
)
ORACLE["efficient_clusters"] = with_facts(
    f"""SELECT Restaurant_Cluster, {r('avg(Time_taken_min)', 'time_mean')}, {r('median(Time_taken_min)', 'time_median')},
  {r('stddev_samp(Time_taken_min)', 'time_std')}, {r('avg(Distance_km)', 'distance_mean')}, {r('median(Distance_km)', 'distance_median')},
  {r('stddev_samp(Distance_km)', 'distance_std')}, {r('avg(Profit)', 'profit_mean')}, {r('sum(Profit)', 'profit_sum')},
  {r('avg(Restaurant_latitude)', 'latitude_mean')}, {r('avg(Restaurant_longitude)', 'longitude_mean')},
  {r('avg(Profit) / NULLIF(avg(Time_taken_min), 0)', 'profit_per_minute')}
FROM enr GROUP BY Restaurant_Cluster""",
    *_ENR,
)
ORACLE["efficient_routes"] = with_facts(
    f"""SELECT Route_Type, {r('avg(Time_taken_min)', 'time_mean')}, {r('median(Time_taken_min)', 'time_median')},
  count(Time_taken_min) AS time_count, {r('avg(Distance_km)', 'distance_mean')}, {r('avg(Profit)', 'profit_mean')},
  {r('avg(Distance_km) / NULLIF(avg(Time_taken_min), 0)', 'speed_km_per_min')},
  {r('avg(Profit) / NULLIF(avg(Time_taken_min), 0)', 'profit_per_min')},
  {r('avg(Profit) / NULLIF(avg(Distance_km), 0)', 'profit_per_km')}
FROM enr GROUP BY Route_Type""",
    *_ENR,
)

# --- customers (C5, U1, U2) ---------------------------------------------------


def _mode_cte(col: str, name: str) -> str:
    return (
        f"{name} AS (SELECT Customer_ID, v AS {col} FROM (SELECT Customer_ID, {col} AS v, row_number() OVER "
        f"(PARTITION BY Customer_ID ORDER BY count(*) DESC, {col}) AS rk FROM facts WHERE Customer_ID IS NOT NULL "
        f"AND {col} IS NOT NULL GROUP BY Customer_ID, {col}) WHERE rk = 1)"
    )


ORACLE["customer_profile"] = with_facts(
    f"""SELECT g.Customer_ID, m1.Type_of_order, m2.Type_of_vehicle, m3.City, {r('g.d', 'Distance_km')},
  {r('g.t', 'Time_taken_min')}, {r('g.p', 'Profit')}, g.n AS Order_Count
FROM (SELECT Customer_ID, avg(Distance_km) AS d, avg(Time_taken_min) AS t, avg(Profit) AS p, count(Order_ID) AS n
      FROM facts WHERE Customer_ID IS NOT NULL GROUP BY Customer_ID) g
LEFT JOIN m1 USING (Customer_ID) LEFT JOIN m2 USING (Customer_ID) LEFT JOIN m3 USING (Customer_ID)""",
    _mode_cte("Type_of_order", "m1"), _mode_cte("Type_of_vehicle", "m2"), _mode_cte("City", "m3"),
)
_EPOCH = "date_diff('second', TIMESTAMP '1970-01-01', CAST(Order_Datetime AS TIMESTAMP))"
ORACLE["customer_rfm"] = with_facts(
    f"""SELECT g.Customer_ID, order_count, {r('total_profit', 'total_profit')}, {r('avg_profit_per_order', 'avg_profit_per_order')},
  {r('avg_distance', 'avg_distance')}, {r('max_distance', 'max_distance')}, {r('avg_delivery_time', 'avg_delivery_time')},
  {r('total_delivery_time', 'total_delivery_time')}, {r('avg_rating', 'avg_rating')}, unique_restaurants,
  m1.Type_of_order AS most_common_order_type,
  CAST(floor(((SELECT max({_EPOCH}) FROM facts) - lst) / 86400e0) AS BIGINT) AS days_since_last_order,
  CAST(floor((lst - fst) / 86400e0) AS BIGINT) AS customer_lifetime_days,
  {r('order_count / (floor((lst - fst) / 86400e0) / 30e0 + 0.01e0)', 'orders_per_month')}
FROM (SELECT Customer_ID, count(Order_ID) AS order_count, sum(Profit) AS total_profit, avg(Profit) AS avg_profit_per_order,
        avg(Distance_km) AS avg_distance, max(Distance_km) AS max_distance, avg(Time_taken_min) AS avg_delivery_time,
        sum(Time_taken_min) AS total_delivery_time, avg(Delivery_person_Ratings) AS avg_rating,
        count(DISTINCT Restaurant_ID) AS unique_restaurants, max({_EPOCH}) AS lst, min({_EPOCH}) AS fst
      FROM facts WHERE Customer_ID IS NOT NULL GROUP BY Customer_ID) g
LEFT JOIN m1 USING (Customer_ID)""",
    _mode_cte("Type_of_order", "m1"),
)

# --- recommendations (Z1-Z3) ----------------------------------------------------
_SEGF_ORDER = "CASE factor " + " ".join(f"WHEN '{f}' THEN {i + 1}" for i, f in enumerate(SEGMENT_FACTORS)) + " END"
ORACLE["pricing_recommendations"] = with_facts(
    f"""SELECT 'pricing' AS category, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS ordinal, text FROM (
  SELECT 0 AS k, 'Uniform fee with the highest expected profit: ' || CAST(CAST(Base_Price AS DOUBLE) AS VARCHAR) AS text
  FROM (SELECT * FROM g ORDER BY (Profitable_Deliveries_Pct >= 90) DESC, Average_Profit DESC, Base_Price LIMIT 1)
  UNION ALL
  SELECT {_SEGF_ORDER}, 'Best fees by ' || factor || ': ' || string_agg(value || ': ' || CAST(CAST(optimal_price AS DOUBLE) AS VARCHAR), ', ' ORDER BY value)
  FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY value) AS rk FROM so WHERE optimal_price > 0) WHERE rk <= 3 GROUP BY factor)""",
    _PRICES,
    f"g AS ({_grid_select('', 'facts')})",
    *_SEG_CTES[1:],
    "sg AS (" + _grid_select("factor, value", "lng2") + ")",
    "so AS (SELECT factor, value, Base_Price AS optimal_price FROM (SELECT *, row_number() OVER (PARTITION BY factor, value "
    "ORDER BY (Profitable_Deliveries_Pct >= 90) DESC, Average_Profit DESC, Base_Price) AS rk FROM sg) WHERE rk = 1)",
)
ORACLE["operations_recommendations"] = with_facts(
    f"""SELECT 'operations' AS category, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS ordinal, text FROM (
  SELECT 1 AS k, 'Kitchens with the longest pickup delays: ' || string_agg(Restaurant_ID, ', ' ORDER BY rk) AS text
  FROM (SELECT Restaurant_ID, row_number() OVER (ORDER BY m DESC, Restaurant_ID) AS rk FROM rd) WHERE rk <= 3 HAVING count(*) > 0
  UNION ALL SELECT 2, 'Mean wait before pickup in minutes: ' || printf('%.1f', avg(Wait_Time_Minutes)) FROM facts
  UNION ALL SELECT 3, 'Delivery times vary most by ' || arg_max(factor, s)
  FROM (SELECT factor, avg(sd) AS s FROM (SELECT factor, value, stddev_samp(Time_taken_min) AS sd FROM lng WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY factor) WHERE s IS NOT NULL)""",
    "rd AS (SELECT Restaurant_ID, avg(Order_To_Pickup_Minutes) AS m FROM facts WHERE Restaurant_ID IS NOT NULL "
    "GROUP BY Restaurant_ID HAVING count(Order_To_Pickup_Minutes) >= 10)",
    f"lng AS ({factor_long(SEGMENT_FACTORS, ['Time_taken_min'])})",
)
ORACLE["driver_recommendations"] = with_facts(
    """SELECT 'driver_management' AS category, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS ordinal, text FROM (
  SELECT 1 AS k, 'Couriers are needed most on ' || day || ' in the shift ' || shift AS text FROM (
    SELECT sa.day, sa.shift, row_number() OVER (ORDER BY sa.drivers_needed DESC, sa.shift_index) AS rk
    FROM sa JOIN (SELECT DayOfWeek FROM sa GROUP BY DayOfWeek ORDER BY sum(drivers_needed) DESC, DayOfWeek LIMIT 1) b USING (DayOfWeek))
  WHERE rk = 1
  UNION ALL SELECT 2, 'Teach new couriers what the leading ones do'
  UNION ALL SELECT 3, 'Tie courier bonuses to measured efficiency')""",
    f"ps AS (SELECT DayOfWeek, {_SHIFT} AS shift_index, count(*) AS orders FROM facts "
    "WHERE DayOfWeek IS NOT NULL AND Order_Hour IS NOT NULL GROUP BY 1, 2)",
    """sa AS (SELECT sp.DayOfWeek, (['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'])[sp.DayOfWeek + 1] AS day,
  sp.shift_index, (['Morning (6 AM - 2 PM)','Afternoon (2 PM - 10 PM)','Night (10 PM - 6 AM)'])[sp.shift_index + 1] AS shift,
  CAST(greatest(1, floor(COALESCE(ps.orders, 0) / 16e0)) AS INTEGER) AS drivers_needed
FROM (SELECT CAST(i // 3 AS INTEGER) AS DayOfWeek, CAST(i % 3 AS INTEGER) AS shift_index FROM range(21) t(i)) sp
LEFT JOIN ps ON ps.DayOfWeek = sp.DayOfWeek AND ps.shift_index = sp.shift_index)""",
)

# --- preview (S7) and route recommendations (Z5) --------------------------------
_FACT_DOUBLES = {
    "Restaurant_latitude", "Restaurant_longitude", "Delivery_location_latitude", "Delivery_location_longitude",
    "Delivery_person_Age", "Delivery_person_Ratings", "Time_taken_min", "Distance_km", "Route_Efficiency",
    "Actual_Distance_km", "Order_To_Pickup_Minutes", "Wait_Time_Minutes", "Delivery_Speed", "Restaurant_Prep_Time",
    "Delivery_Person_Efficiency", "Restaurant_Efficiency", "Time_Cost", "Distance_Cost", "Fuel_Cost",
    "Maintenance_Cost", "Total_Variable_Cost", "Total_Cost", "Revenue", "Profit", "CO2_Emissions", "Fuel_Consumption",
}


def _preview_sql() -> str:
    from dispatchlens.plans.facts import FACT_COLUMNS

    cols = ", ".join(r(c, c) if c in _FACT_DOUBLES else c for c in FACT_COLUMNS)
    return with_facts(f"SELECT {cols} FROM facts ORDER BY Order_ID LIMIT 5")


ORACLE["preview"] = _preview_sql()
_RB, _RC = _hot_sql("Restaurant_latitude", "Restaurant_longitude", "pk_")
_DB, _DC = _hot_sql("Delivery_location_latitude", "Delivery_location_longitude", "dr_")
ORACLE["route_recommendations"] = with_facts(
    f"""SELECT 'route_optimization' AS category, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS ordinal, text FROM (
  SELECT 1 AS k, 'Routes with the most profit per minute: ' || string_agg(Route_Type, ', ' ORDER BY rk) AS text
  FROM (SELECT Route_Type, row_number() OVER (ORDER BY ppm DESC, Route_Type) AS rk
        FROM (SELECT Route_Type, avg(Profit) / NULLIF(avg(Time_taken_min), 0) AS ppm FROM enr GROUP BY Route_Type))
  WHERE rk <= 3 HAVING count(*) > 0
  UNION ALL SELECT 2, 'Consider shared kitchens at the pickup hot spots'
  FROM ({_RB}) HAVING count(*) > 0
  UNION ALL SELECT 3, 'Let couriers wait near the drop-off hot spots'
  FROM ({_DB}) HAVING count(*) > 0)""",
    *_ENR, *_RC, *_DC,
)

# --- scenarios on clustered facts (R3, R8, R9 with the eighth factor) ---------------
_EIGHT = (*PROFIT_FACTORS_BASE[:4], "Route_Type", *PROFIT_FACTORS_BASE[4:])
ORACLE["profit_by_factor_clustered"] = with_facts(
    _profit_stats("lng", "factor, value")
    + f", {r('avg(Profit) / NULLIF(avg(Revenue), 0) * 100e0', 'profit_margin_pct')}"
    + " FROM lng WHERE value IS NOT NULL GROUP BY factor, value",
    *_ENR, f"lng AS ({factor_long(_EIGHT, ['Profit', 'Total_Cost', 'Revenue'], 'enr')})",
)
ORACLE["profit_score_clustered"] = with_facts(
    f"SELECT Order_ID, {', '.join(_EIGHT)}, {r('Profit', 'Profit')}, "
    + ", ".join(r(f"{c}_scaled", f"{c}_scaled") for c in _SCORE)
    + f", {r('Profit_Score', 'Profit_Score')} FROM scored",
    *_ENR, *_score_ctes(_EIGHT, "enr"),
)
ORACLE["top_scenarios_clustered"] = with_facts(
    f"""SELECT {', '.join(_EIGHT)}, {r('avg(Profit_Score)', 'score_mean')}, {r('stddev_samp(Profit_Score)', 'score_std')},
  count(Profit_Score) AS score_count, {r('avg(Profit)', 'profit_mean')}, {r('stddev_samp(Profit)', 'profit_std')}
FROM scored GROUP BY {', '.join(_EIGHT)} HAVING count(Profit_Score) >= 2
ORDER BY avg(Profit_Score) DESC, {', '.join(_EIGHT)} LIMIT 10""",
    *_ENR, *_score_ctes(_EIGHT, "enr"),
)

# --- autoregressive forecasts (D4) ----------------------------------------------


def _ar_ctes(key: str, order: int = 5) -> list[str]:
    lags = [f"d{i}" for i in range(order + 1)]
    cells = ", ".join("[" + ", ".join(f"COALESCE(sum({x} * {y}) FILTER (WHERE d{order} IS NOT NULL), 0e0)" for y in [*lags[1:], "d0"]) + "]" for x in lags[1:])
    trace = " + ".join(f"m[{i}][{i}]" for i in range(1, order + 1))
    pivot_row = "list_transform(m[i], lambda x: CASE WHEN m[i][i] <= size * 1e-12 THEN 0e0 ELSE x / m[i][i] END)"
    other = f"list_transform(range(1, {order + 2}), lambda t: row[t] - row[i] * p[t])"
    move = " + ".join(["0e0", *(f"c[{i}] * h[{i}]" for i in range(1, order + 1))])
    return [
        f"cs AS (SELECT {key} AS k, Order_Date AS day, count(*) AS orders FROM facts WHERE Order_Date IS NOT NULL AND {key} IS NOT NULL GROUP BY ALL)",
        "sp AS (SELECT k, min(day) AS lo, max(day) AS hi FROM cs GROUP BY k)",
        "dd AS (SELECT s.k, s.hi, s.day, CAST(COALESCE(cs.orders, 0) AS DOUBLE) AS orders FROM (SELECT k, hi, CAST(unnest(generate_series("
        "CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM sp) s LEFT JOIN cs ON cs.k = s.k AND cs.day = s.day)",
        "t0 AS (SELECT *, orders - lag(orders) OVER (PARTITION BY k ORDER BY day) AS d0 FROM dd WHERE day <= hi - 14)",
        "t1 AS (SELECT *, " + ", ".join(f"lag(d0, {i}) OVER (PARTITION BY k ORDER BY day) AS d{i}" for i in range(1, order + 1)) + " FROM t0)",
        f"nm AS (SELECT k, [{cells}] AS m, max(day) AS last, arg_max(orders, day) AS level, "
        f"[{', '.join(f'COALESCE(arg_max_null({x}, day), 0e0)' for x in lags[:-1])}] AS h FROM t1 GROUP BY k)",
        f"gj AS (SELECT * FROM (WITH RECURSIVE gr AS (SELECT k, 1 AS i, m, {trace} AS size FROM nm UNION ALL SELECT k, i + 1, "
        f"list_transform(m, lambda row, j: CASE WHEN j = i THEN p ELSE {other} END), size FROM (SELECT *, {pivot_row} AS p FROM gr WHERE i <= {order})) SELECT * FROM gr))",
        f"co AS (SELECT k, list_transform(m, lambda row: row[{order + 1}]) AS c FROM gj WHERE i = {order + 1})",
        "fr AS (SELECT * FROM (WITH RECURSIVE ff AS (SELECT nm.k, nm.last AS day, level, h, c, hi FROM nm JOIN co USING (k) JOIN sp USING (k) UNION ALL "
        f"SELECT k, day + 1, level + ({move}), list_concat([{move}], h[1:{order - 1}]), c, hi FROM ff WHERE day < hi + 30) SELECT * FROM ff))",
    ]


def _ar_sql(key: str, column: str) -> str:
    return with_facts(
        f"""SELECT {column} fr.day, CASE WHEN fr.day <= fr.hi THEN 'test' ELSE 'future' END AS split, {r('dd.orders', 'actual')}, {r('fr.level', 'forecast')}
FROM fr LEFT JOIN dd ON dd.k = fr.k AND dd.day = fr.day JOIN nm ON nm.k = fr.k WHERE fr.day > nm.last""",
        *_ar_ctes(key),
    )


ORACLE["autoregressive_forecast"] = _ar_sql("'all'", "")
ORACLE["city_autoregressive_forecast"] = _ar_sql("City", "fr.k AS City,")

# --- models and segments over fixed inputs (M3, M8, U5, Z4) ----------------------
_SPLIT = "CASE WHEN CAST('0x' || substr(md5(CAST(Order_ID AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END"
ORACLE["split_counts"] = with_facts(
    f"SELECT {_SPLIT} AS split, count(*) AS orders, {r('avg(Time_taken_min)', 'time_mean')} FROM facts GROUP BY 1"
)
ORACLE["fixed_prediction_metrics"] = with_facts(
    f"""SELECT {r('avg(abs(e))', 'mae')}, {r('avg(e * e)', 'mse')}, {r('sqrt(avg(e * e))', 'rmse')},
  {r('1e0 - sum(e * e) / (var_pop(Time_taken_min) * count(*))', 'r2')}
FROM (SELECT Time_taken_min, Time_taken_min - (15e0 + 2e0 * Distance_km) AS e FROM facts)"""
)
_FIXED = [
    _mode_cte("Type_of_order", "m1"),
    "lb AS (SELECT Customer_ID, count(Order_ID) AS order_count, sum(Profit) AS total_profit, count(Order_ID) % 4 AS Cluster "
    "FROM facts WHERE Customer_ID IS NOT NULL GROUP BY Customer_ID)",
    "cg AS (SELECT Cluster, avg(total_profit) AS v, avg(order_count) AS f, count(*) AS size FROM lb GROUP BY Cluster)",
    "cr AS (SELECT Cluster, size, rank() OVER (ORDER BY v DESC) + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS vr, "
    "rank() OVER (ORDER BY f DESC) + (count(*) OVER (PARTITION BY f) - 1) / 2e0 AS fr FROM cg)",
    "nm AS (SELECT CAST(Cluster AS INTEGER) AS Cluster, vr AS value_rank, fr AS frequency_rank, size, 'Cluster ' || CAST(Cluster AS VARCHAR) || ' - ' || "
    "CASE WHEN vr <= 2 THEN 'High' ELSE 'Low' END || ' Value, ' || CASE WHEN fr <= 2 THEN 'High' ELSE 'Low' END || ' Frequency' AS name FROM cr)",
]
ORACLE["fixed_cluster_names"] = with_facts(f"SELECT Cluster, {r('value_rank', 'value_rank')}, {r('frequency_rank', 'frequency_rank')}, size, name FROM nm", *_FIXED)
ORACLE["fixed_customer_recommendations"] = with_facts(
    """SELECT 'customer_strategies' AS category, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS ordinal, text FROM (
  SELECT 1 AS k, 'Reward the groups that bring most profit (clusters ' || string_agg(CAST(Cluster AS VARCHAR), ', ' ORDER BY CAST(Cluster AS VARCHAR)) || ')' AS text
  FROM nm WHERE contains(name, 'High Value') HAVING count(*) > 0
  UNION ALL SELECT 2, 'Invite back the groups that order rarely (clusters ' || string_agg(CAST(Cluster AS VARCHAR), ', ' ORDER BY CAST(Cluster AS VARCHAR)) || ')'
  FROM nm WHERE contains(name, 'Low Frequency') HAVING count(*) > 0)""",
    *_FIXED,
)
