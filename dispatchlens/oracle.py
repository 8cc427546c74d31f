"""DuckDB twins of the deterministic operators (the correctness oracle).

``FACTS_CTE`` rebuilds the raw delivery table from the star schema and the
fact table from it in plain SQL; every oracle query is ``WITH <FACTS_CTE>
[, more CTEs] SELECT ...``. Floating-point outputs are rounded to 6 decimals in
both engines by the query registry (see ``__spark_entry__``).
"""

from __future__ import annotations

_CLOCK = "'^([0-9]{1,2}):([0-9]{2})(:([0-9]{2}))?$'"


def _hhmm(m: str) -> str:
    return f"lpad(CAST({m} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} % 60 AS VARCHAR), 2, '0')"


def _secs(t: str) -> str:
    # seconds of day of a validated clock string, NULL when invalid
    h = f"TRY_CAST(regexp_extract({t}, {_CLOCK}, 1) AS INTEGER)"
    m = f"TRY_CAST(regexp_extract({t}, {_CLOCK}, 2) AS INTEGER)"
    s = f"COALESCE(TRY_CAST(NULLIF(regexp_extract({t}, {_CLOCK}, 4), '') AS INTEGER), 0)"
    return (
        f"CASE WHEN regexp_matches({t}, {_CLOCK}) AND {h} < 24 AND {m} < 60 AND {s} < 60 "
        f"THEN {h} * 3600 + {m} * 60 + {s} END"
    )


RAW_CTE = f"""
li AS (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, li.s AS s, n.n_regionkey AS rg, o.o_orderdate AS od,
         ((((o.o_orderkey % 10007) * 104729) % 10007 % 1440) // 15) * 15 AS m
  FROM orders o
  JOIN customer cu ON o.o_custkey = cu.c_custkey
  JOIN nation n ON cu.c_nationkey = n.n_nationkey
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey),
base2 AS (SELECT *, (m + 5 * ((((k % 10007) * 7919) % 10007) % 31)) % 1440 AS pm FROM base),
raw AS (
  SELECT
    'ORD-' || lpad(CAST(k AS VARCHAR), 7, '0') AS Order_ID,
    'CUST-' || CAST(c AS VARCHAR) AS Customer_ID,
    CASE WHEN s IS NULL THEN NULL ELSE 'REST-' || CAST(s AS VARCHAR) END AS Restaurant_ID,
    'DP-' || CAST((((k % 10007) * 15485863) % 10007) % 200 AS VARCHAR) AS Delivery_person_ID,
    CASE WHEN k % 997 = 0 THEN 'bad-date' ELSE strftime(od, '%d-%m-%Y') END AS Order_Date,
    CASE WHEN k % 101 = 0 THEN NULL ELSE {_hhmm('m')} || CASE WHEN k % 2 = 1 THEN ':00' ELSE '' END END AS Time_Orderd,
    CASE WHEN k % 103 = 0 THEN NULL ELSE {_hhmm('pm')} || CASE WHEN k % 2 = 1 THEN ':00' ELSE '' END END AS Time_Order_picked,
    (['Sunny', 'Cloudy', 'Fog', 'Windy', 'Stormy', 'Sandstorms'])[((((k % 10007) * 31) % 10007) % 6) + 1] AS Weatherconditions,
    (['Low', 'Medium', 'High', 'Jam'])[((((k % 10009) * 37) % 10009) % 4) + 1] AS Road_traffic_density,
    (['motorcycle', 'scooter', 'bicycle'])[((((k % 10037) * 41) % 10037) % 3) + 1] AS Type_of_vehicle,
    (['Snack', 'Meal', 'Drinks', 'Buffet'])[((((k % 10039) * 43) % 10039) % 4) + 1] AS Type_of_order,
    CASE WHEN rg < 2 THEN 'Urban' WHEN rg < 4 THEN 'Metropolitian' ELSE 'Semi-Urban' END AS City,
    28.42e0 + 0.05e0 * (s % 3) + ((s * 7919) % 401) / 2e4
      + CASE WHEN s % 17 = 0 THEN 0.3e0 + s / 1e3 ELSE 0e0 END AS Restaurant_latitude,
    77.02e0 + 0.05e0 * (s % 2) + ((s * 104729) % 401) / 2e4 AS Restaurant_longitude,
    28.42e0 + 0.05e0 * (c % 6) + ((c * 7919) % 401) / 2e4
      + CASE WHEN c % 97 = 0 THEN 0.3e0 + (c % 1000) / 1e3 ELSE 0e0 END AS Delivery_location_latitude,
    77.02e0 + 0.05e0 * (c % 5) + ((c * 104729) % 401) / 2e4 AS Delivery_location_longitude,
    CASE WHEN k % 211 = 0 THEN 'NaN ' ELSE CAST(18 + ((((k % 10061) * 53) % 10061) % 27) AS VARCHAR) END AS Delivery_person_Age,
    CASE WHEN k % 223 = 0 THEN NULL ELSE CAST(3e0 + ((((k % 10067) * 59) % 10067) % 21) / 1e1 AS VARCHAR) END AS Delivery_person_Ratings,
    CASE WHEN k % 307 = 0 THEN 'n/a' ELSE CAST(15 + ((((k % 10069) * 61) % 10069) % 30) AS VARCHAR) || ' min' END AS Time_taken_min
  FROM base2)"""

FACTS_CTE = RAW_CTE + f""",
p1 AS (
  SELECT Order_ID, Customer_ID, Restaurant_ID, Delivery_person_ID,
    CAST(try_strptime(Order_Date, '%d-%m-%Y') AS DATE) AS Order_Date,
    COALESCE(Time_Orderd, '00:00') AS Time_Orderd,
    COALESCE(Time_Order_picked, '00:00') AS Time_Order_picked,
    Weatherconditions, Road_traffic_density, Type_of_vehicle, Type_of_order, City,
    Restaurant_latitude, Restaurant_longitude, Delivery_location_latitude, Delivery_location_longitude,
    CASE WHEN isnan(TRY_CAST(trim(Delivery_person_Age) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(Delivery_person_Age) AS DOUBLE) END AS Delivery_person_Age,
    CASE WHEN isnan(TRY_CAST(trim(Delivery_person_Ratings) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(Delivery_person_Ratings) AS DOUBLE) END AS Delivery_person_Ratings,
    TRY_CAST(NULLIF(regexp_extract(Time_taken_min, '[0-9]+'), '') AS DOUBLE) AS Time_taken_min,
    pow(sin((radians(Delivery_location_latitude) - radians(Restaurant_latitude)) / 2), 2)
      + cos(radians(Restaurant_latitude)) * cos(radians(Delivery_location_latitude))
      * pow(sin((radians(Delivery_location_longitude) - radians(Restaurant_longitude)) / 2), 2) AS hav_a
  FROM raw),
p2 AS (
  SELECT * EXCLUDE (hav_a),
    2e0 * asin(sqrt(CASE WHEN hav_a > 1 THEN 1e0 ELSE hav_a END)) * 6371e0 AS Distance_km,
    {_secs('Time_Orderd')} AS o_sec,
    {_secs('Time_Order_picked')} AS p_sec
  FROM p1),
p3 AS (
  SELECT *,
    CASE WHEN Order_Date IS NOT NULL THEN (p_sec - o_sec) / 60e0 END AS Order_To_Pickup_Minutes,
    CAST(CASE WHEN Order_Date IS NOT NULL THEN o_sec // 3600 END AS INTEGER) AS Order_Hour,
    CAST(CASE WHEN Order_Date IS NOT NULL THEN p_sec // 3600 END AS INTEGER) AS Pickup_Hour,
    CAST(CASE WHEN Order_Date IS NOT NULL THEN (o_sec % 3600) // 60 END AS INTEGER) AS Order_Minute,
    CAST(CASE WHEN Order_Date IS NOT NULL THEN (p_sec % 3600) // 60 END AS INTEGER) AS Pickup_Minute,
    CAST(isodow(Order_Date) - 1 AS INTEGER) AS DayOfWeek,
    CAST(month(Order_Date) AS INTEGER) AS Month,
    CAST(year(Order_Date) AS INTEGER) AS Year,
    CAST(day(Order_Date) AS INTEGER) AS Day,
    CAST(Order_Date AS TIMESTAMP) + to_seconds(o_sec) AS Order_Datetime,
    CAST(Order_Date AS TIMESTAMP) + to_seconds(p_sec) AS Pickup_Datetime
  FROM p2),
p4 AS (
  SELECT *,
    CASE WHEN DayOfWeek >= 5 THEN 1 ELSE 0 END AS IsWeekend,
    CASE WHEN (Month = 1 AND Day = 1) OR (Month = 12 AND Day = 25) THEN 1 ELSE 0 END AS IsHoliday,
    CASE WHEN Order_Hour BETWEEN 11 AND 14 OR Order_Hour BETWEEN 18 AND 21 THEN 1 ELSE 0 END AS IsPeakHour,
    CASE WHEN Order_To_Pickup_Minutes >= 0 AND Order_To_Pickup_Minutes <= 120 THEN Order_To_Pickup_Minutes END AS wait_raw
  FROM p3),
p5 AS (
  SELECT *,
    COALESCE(wait_raw, (SELECT avg(wait_raw) FROM p4)) AS Wait_Time_Minutes,
    Distance_km / NULLIF(Time_taken_min, 0) AS Delivery_Speed
  FROM p4),
p6 AS (SELECT *, Wait_Time_Minutes * 0.7e0 AS Restaurant_Prep_Time FROM p5),
drv AS (SELECT Delivery_person_ID, avg(Delivery_Speed) AS drv_speed FROM p6 GROUP BY Delivery_person_ID),
rst AS (SELECT Restaurant_ID, avg(Restaurant_Prep_Time) AS rst_prep FROM p6 WHERE Restaurant_ID IS NOT NULL GROUP BY Restaurant_ID),
p7 AS (
  SELECT p6.*,
    p6.Delivery_Speed / NULLIF(drv.drv_speed, 0) AS Delivery_Person_Efficiency,
    rst.rst_prep / NULLIF(p6.Restaurant_Prep_Time, 0) AS Restaurant_Efficiency,
    Time_taken_min * 2e0 AS Time_Cost,
    Distance_km * 3e0 AS Distance_Cost,
    Distance_km * 1.5e0 AS Fuel_Cost,
    Distance_km * 0.5e0 AS Maintenance_Cost
  FROM p6 LEFT JOIN drv ON p6.Delivery_person_ID = drv.Delivery_person_ID
          LEFT JOIN rst ON p6.Restaurant_ID = rst.Restaurant_ID),
p8 AS (SELECT *, Time_Cost + Distance_Cost + Fuel_Cost + Maintenance_Cost AS Total_Variable_Cost FROM p7),
p9 AS (SELECT *, Total_Variable_Cost + 20e0 + 30e0 AS Total_Cost FROM p8),
facts AS (
  SELECT * EXCLUDE (o_sec, p_sec, wait_raw),
    1.25e0 AS Route_Efficiency,
    Distance_km * 1.25e0 AS Actual_Distance_km,
    100e0 AS Revenue,
    100e0 - Total_Cost AS Profit,
    Distance_km * 0.12e0 AS CO2_Emissions,
    Distance_km / 15e0 AS Fuel_Consumption
  FROM p9
  WHERE Time_taken_min IS NOT NULL AND Distance_km IS NOT NULL AND Delivery_person_Age IS NOT NULL
    AND Delivery_person_Ratings IS NOT NULL AND Order_Hour IS NOT NULL AND Pickup_Hour IS NOT NULL)"""


def with_facts(body: str, *ctes: str) -> str:
    """``WITH <facts> [, ctes] <body>``."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {FACTS_CTE}{extra}\n{body}"
