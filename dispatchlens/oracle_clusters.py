"""DuckDB twins of the K-means operators (C2, C6, U3, U4 and what builds on them): the same start and rounds in recursive SQL."""

from __future__ import annotations

from dispatchlens.oracle import with_facts
from dispatchlens.oracle_queries import _EPOCH, ORACLE, _mode_cte, dbscan_ctes, r

ROUNDS = 20


def _squared(a: str, b: str) -> str:
    return f"round(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9)"


def _distances(centres: str) -> str:
    return f"list_transform({centres}, lambda centre: {_squared('x', 'centre')})"


def lloyd_ctes(points: str, k: int, p: str) -> list[str]:
    """{p}fit(k, centres): the centres of 1..k clusters of ``points(x, w)`` after all rounds."""
    dims = "unnest(range(1, len(x) + 1)) AS i"
    return [
        f"{p}mean AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, sum(w * x[i]) / sum(w) AS m FROM (SELECT x, w, {dims} FROM {points}) GROUP BY i))",
        f"{p}first AS (SELECT first(x ORDER BY {_squared('x', 'm')}, x) AS x FROM {points}, {p}mean HAVING count(*) > 0)",
        f"""{p}start AS (SELECT * FROM (WITH RECURSIVE ff(n, centres) AS (
  SELECT 1, [x] FROM {p}first
  UNION ALL SELECT n + 1, list_append(any_value(centres), first(x ORDER BY far DESC, x))
  FROM (SELECT n, centres, x, list_min({_distances('centres')}) AS far FROM ff, {points} WHERE n < {k}) GROUP BY n HAVING max(far) > 0) SELECT * FROM ff))""",
        f"""{p}fit AS (SELECT * FROM (WITH RECURSIVE it(k, n, centres) AS (
  SELECT n, 0, centres FROM {p}start
  UNION ALL SELECT k, n + 1, list(centre ORDER BY c) FROM (
    SELECT k, n, c, list(m ORDER BY i) AS centre FROM (
      SELECT k, n, c, i, CASE WHEN sum(w) > 0 THEN sum(w * x[i]) / sum(w) ELSE max(x[i]) END AS m FROM (
        SELECT k, n, c, x, w, {dims} FROM (
          SELECT k, n, x, w, list_position(ds, list_min(ds)) AS c FROM (SELECT k, n, x, w, {_distances('centres')} AS ds FROM it, {points} WHERE n < {ROUNDS})
          UNION ALL SELECT k, n, centres[c], 0e0, c FROM it, range(1, {k + 1}) t(c) WHERE c <= len(centres) AND n < {ROUNDS}))
      GROUP BY k, n, c, i) GROUP BY k, n, c) GROUP BY k, n) SELECT k, centres FROM it WHERE n = {ROUNDS}))""",
    ]


def _nearest(centres: str) -> str:
    return f"CAST(list_position({_distances(centres)}, list_min({_distances(centres)})) - 1 AS INTEGER)"


def _standard(src: str, columns: tuple[str, ...], p: str) -> tuple[str, str]:
    """A CTE of means and deviations, and the list of a row's standardised columns."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in columns)
    own = ", ".join(f"CASE WHEN s_{c} = 0 THEN 0e0 ELSE ({c} - m_{c}) / s_{c} END" for c in columns)
    return f"{p}st AS (SELECT {stats} FROM {src})", f"[{own}]"


# --- customer clusters (U3, U4, and U5, Z4, Z6 over them) --------------------------
_FEATURES = ("order_count", "avg_profit_per_order", "avg_distance", "avg_delivery_time", "unique_restaurants", "days_since_last_order", "orders_per_month")
_LIFE = "floor((max(ep) - min(ep)) / 86400e0)"
_ST, _X = _standard("rf", _FEATURES, "u")
_CUSTOMERS = [
    f"rf0 AS (SELECT *, {_EPOCH} AS ep FROM facts)",
    f"""rf AS (SELECT Customer_ID, count(Order_ID) AS order_count, sum(Profit) AS total_profit, avg(Profit) AS avg_profit_per_order, avg(Distance_km) AS avg_distance,
  avg(Time_taken_min) AS avg_delivery_time, count(DISTINCT Restaurant_ID) AS unique_restaurants,
  floor(((SELECT max(ep) FROM rf0) - max(ep)) / 86400e0) AS days_since_last_order, count(Order_ID) / ({_LIFE} / 30e0 + 0.01e0) AS orders_per_month
FROM rf0 WHERE Customer_ID IS NOT NULL GROUP BY Customer_ID HAVING {" AND ".join(f"{c} IS NOT NULL" for c in _FEATURES)})""",
    _ST,
    f"cp AS MATERIALIZED (SELECT rf.*, {_X} AS x, 1e0 AS w FROM rf, ust)",
    *lloyd_ctes("cp", 10, "u"),
    f"wc AS (SELECT k, sum(list_min({_distances('centres')})) AS wcss FROM ufit, cp WHERE k <= least(10, (SELECT count(*) FROM cp) - 1) GROUP BY k)",
    "bend AS (SELECT k, round(abs((lead(wcss) OVER (ORDER BY k) - wcss) - (wcss - lag(wcss) OVER (ORDER BY k))), 9) AS b FROM wc)",
    "best AS (SELECT coalesce((SELECT first(k ORDER BY b, k) FROM bend WHERE b IS NOT NULL), 3) AS k)",
    f"lb AS (SELECT cp.*, {_nearest('centres')} AS Cluster, k FROM cp, ufit JOIN best USING (k))",
    "cg AS (SELECT Cluster, any_value(k) AS k, avg(total_profit) AS v, avg(order_count) AS f, count(*) AS size FROM lb GROUP BY Cluster)",
    "cr AS (SELECT Cluster, size, k, rank() OVER (ORDER BY v DESC) + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS vr, "
    "rank() OVER (ORDER BY f DESC) + (count(*) OVER (PARTITION BY f) - 1) / 2e0 AS fr FROM cg)",
    "nm AS (SELECT Cluster, vr AS value_rank, fr AS frequency_rank, size, 'Cluster ' || CAST(Cluster AS VARCHAR) || ' - ' || "
    "CASE WHEN vr <= k / 2e0 THEN 'High' ELSE 'Low' END || ' Value, ' || CASE WHEN fr <= k / 2e0 THEN 'High' ELSE 'Low' END || ' Frequency' AS name FROM cr)",
]
ORACLE["kmeans_elbow"] = with_facts(f"SELECT CAST(wc.k AS INTEGER) AS k, {r('wcss', 'wcss')}, wc.k = best.k AS is_optimal FROM wc, best", *_CUSTOMERS)
ORACLE["customer_cluster_summary"] = with_facts(f"SELECT Cluster, {', '.join(r(f'avg({c})', c) for c in _FEATURES)}, count(*) AS size FROM lb GROUP BY Cluster", *_CUSTOMERS)
ORACLE["customer_cluster_names"] = with_facts(f"SELECT Cluster, {r('value_rank', 'value_rank')}, {r('frequency_rank', 'frequency_rank')}, size, name FROM nm", *_CUSTOMERS)
ORACLE["customer_recommendations"] = with_facts(
    """SELECT 'customer_strategies' AS category, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS ordinal, text FROM (
  SELECT 1 AS k, 'Reward the groups that bring most profit (clusters ' || string_agg(CAST(Cluster AS VARCHAR), ', ' ORDER BY CAST(Cluster AS VARCHAR)) || ')' AS text
  FROM nm WHERE contains(name, 'High Value') HAVING count(*) > 0
  UNION ALL SELECT 2, 'Invite back the groups that order rarely (clusters ' || string_agg(CAST(Cluster AS VARCHAR), ', ' ORDER BY CAST(Cluster AS VARCHAR)) || ')'
  FROM nm WHERE contains(name, 'Low Frequency') HAVING count(*) > 0)""",
    *_CUSTOMERS,
)
ORACLE["recommendations"] = "\nUNION ALL ".join(
    f"SELECT category, ordinal, text FROM ({ORACLE[k]})"
    for k in ("pricing_recommendations", "operations_recommendations", "driver_recommendations", "customer_recommendations", "route_recommendations")
)

# --- customer segments (C6) ---------------------------------------------------------
_NUMS, _CATS = ("Distance_km", "Time_taken_min", "Profit", "Order_Count"), ("Type_of_order", "Type_of_vehicle", "City")
_SST, _SX = _standard("pf", _NUMS, "s")
_HOT = ", ".join(f"list_transform((SELECT list(DISTINCT {c} ORDER BY {c}) FROM pf), lambda v: CASE WHEN v = {c} THEN 1e0 ELSE 0e0 END)" for c in _CATS)
ORACLE["customer_segments"] = with_facts(
    f"SELECT Customer_ID, {', '.join(_CATS)}, {', '.join(r(c, c) if c != 'Order_Count' else c for c in _NUMS)}, {_nearest('centres')} AS Customer_Segment FROM sp, sfit WHERE k = 4",
    *[_mode_cte(c, f"m{i}") for i, c in enumerate(_CATS)],
    f"""pf AS (SELECT * FROM (SELECT Customer_ID, avg(Distance_km) AS Distance_km, avg(Time_taken_min) AS Time_taken_min, avg(Profit) AS Profit, count(Order_ID) AS Order_Count
  FROM facts WHERE Customer_ID IS NOT NULL GROUP BY Customer_ID) JOIN m0 USING (Customer_ID) JOIN m1 USING (Customer_ID) JOIN m2 USING (Customer_ID)
WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _NUMS)})""",
    _SST,
    f"sp AS MATERIALIZED (SELECT pf.*, list_concat({_SX}, {_HOT}) AS x, 1e0 AS w FROM pf, sst)",
    *lloyd_ctes("sp", 4, "s"),
)


# --- reassigned noise (C2, and R6, R7, T1, T2 over it) ----------------------------
def reassigned_ctes(x: str, y: str, eps: float, least: int, weighted: bool, p: str) -> list[str]:
    """{p}new(x, y, weight, is_core, cluster): density clusters whose noise has been clustered by K-means."""
    return [
        *dbscan_ctes(x, y, eps, least, weighted, p),
        f"{p}noise AS MATERIALIZED (SELECT [x, y] AS x, CAST(weight AS DOUBLE) AS w FROM {p}lab WHERE cluster = -1)",
        *lloyd_ctes(f"{p}noise", 5, p),
        f"{p}most AS (SELECT centres, (SELECT coalesce(max(cluster) FILTER (WHERE cluster >= 0) + 1, 0) FROM {p}lab) AS begin FROM {p}fit "
        f"WHERE (SELECT sum(w) FROM {p}noise) >= 5 ORDER BY k DESC LIMIT 1)",
        f"{p}told AS (SELECT n.x AS x, {_nearest('centres')} + begin AS cluster FROM {p}noise n, {p}most)",
        f"{p}new AS (SELECT l.x, l.y, weight, is_core, CAST(CASE WHEN l.cluster = -1 THEN coalesce(t.cluster, -1) ELSE l.cluster END AS INTEGER) AS cluster "
        f"FROM {p}lab l LEFT JOIN {p}told t ON t.x = [l.x, l.y])",
    ]


_R, _D = ("Restaurant_latitude", "Restaurant_longitude"), ("Delivery_location_latitude", "Delivery_location_longitude")
ORACLE["restaurant_sites_reassigned"] = with_facts(f"SELECT x AS {_R[0]}, y AS {_R[1]}, weight, is_core, cluster FROM new", *reassigned_ctes(*_R, 0.01, 10, False, ""))


def _routes(eps: float, least: int, weighted: bool) -> list[str]:
    return [
        *reassigned_ctes(*_R, eps, least, weighted, "rc_"),
        *reassigned_ctes(*_D, eps, least, weighted, "dc_"),
        "enr0 AS (SELECT f.*, CAST(COALESCE(a.cluster, -1) AS INTEGER) AS Restaurant_Cluster, CAST(COALESCE(b.cluster, -1) AS INTEGER) AS Delivery_Cluster FROM facts f "
        f"LEFT JOIN rc_new a ON a.x = f.{_R[0]} AND a.y = f.{_R[1]} LEFT JOIN dc_new b ON b.x = f.{_D[0]} AND b.y = f.{_D[1]})",
        "enr AS (SELECT *, CAST(Restaurant_Cluster AS VARCHAR) || '_' || CAST(Delivery_Cluster AS VARCHAR) AS Route_Type FROM enr0)",
    ]


def _body(name: str) -> str:
    """The last SELECT of a query over ``enr``."""
    sql = ORACLE[name]
    return sql[sql.rindex("\nSELECT ") + 1 :]


for _name in ("restaurant_cluster_profit", "delivery_cluster_profit", "efficient_clusters", "efficient_routes"):
    ORACLE[f"{_name}_reassigned"] = with_facts(_body(_name), *_routes(0.01, 10, False))
ORACLE["route_types_reassigned"] = with_facts(_body("efficient_routes"), *_routes(0.02, 5, True))
