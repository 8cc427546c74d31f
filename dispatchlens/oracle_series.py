"""DuckDB twins of the series operators with moving-average terms, by series and with calendars."""

from __future__ import annotations

from dispatchlens.oracle import with_facts
from dispatchlens.oracle_clusters import ORACLE
from dispatchlens.oracle_queries import r


def _least_squares(src: str, left: list[str], whole: str, p: str, more: str = "") -> list[str]:
    """{p}co(k, c): coefficients of d0 by ``left`` over the rows of ``src`` that are ``whole``, for each k."""
    n = len(left)
    cells = ", ".join("[" + ", ".join(f"COALESCE(sum({x} * {y}) FILTER (WHERE {whole}), 0e0)" for y in [*left, "d0"]) + "]" for x in left)
    pivot = "list_transform(m[i], lambda x: CASE WHEN m[i][i] <= size * 1e-12 THEN 0e0 ELSE x / m[i][i] END)"
    return [
        f"{p}nm AS (SELECT k, [{cells}] AS m{more} FROM {src} GROUP BY k)",
        f"{p}gj AS (SELECT * FROM (WITH RECURSIVE gr AS (SELECT k, 1 AS i, m, {' + '.join(f'm[{i}][{i}]' for i in range(1, n + 1))} AS size FROM {p}nm UNION ALL "
        f"SELECT k, i + 1, list_transform(m, lambda row, j: CASE WHEN j = i THEN p ELSE list_transform(range(1, {n + 2}), lambda t: row[t] - row[i] * p[t]) END), size "
        f"FROM (SELECT *, {pivot} AS p FROM gr WHERE i <= {n})) SELECT * FROM gr))",
        f"{p}co AS (SELECT k, list_transform(m, lambda row: row[{n + 1}]) AS c FROM {p}gj WHERE i = {n + 1})",
    ]


def _arima(key: str, column: str, order: int = 2, moving: int = 2, long: int = 5) -> str:
    d, e = [f"d{i}" for i in range(max(order, long) + 1)], [f"e{i}" for i in range(moving + 1)]
    own = d[1 : long + 1]
    at_end = lambda names: "[" + ", ".join(f"COALESCE(arg_max_null({x}, day), 0e0)" for x in names) + "]"
    lags = lambda names: ", ".join(f"lag({names[0]}, {i}) OVER (PARTITION BY k ORDER BY day) AS {x}" for i, x in enumerate(names) if i)
    move = " + ".join(["0e0", *(f"c[{i + 1}] * h[{i + 1}]" for i in range(order)), *(f"c[{order + i + 1}] * g[{i + 1}]" for i in range(moving))])
    return with_facts(
        f"""SELECT {column} fr.day, CASE WHEN fr.day <= fr.hi THEN 'test' ELSE 'future' END AS split, {r('dd.orders', 'actual')}, {r('fr.level', 'forecast')}
FROM fr LEFT JOIN dd ON dd.k = fr.k AND dd.day = fr.day JOIN nm ON nm.k = fr.k WHERE fr.day > nm.last""",
        f"cs AS (SELECT {key} AS k, Order_Date AS day, count(*) AS orders FROM facts WHERE Order_Date IS NOT NULL AND {key} IS NOT NULL GROUP BY ALL)",
        "sp AS (SELECT k, min(day) AS lo, max(day) AS hi FROM cs GROUP BY k)",
        "dd AS (SELECT s.k, s.hi, s.day, CAST(COALESCE(cs.orders, 0) AS DOUBLE) AS orders FROM (SELECT k, hi, CAST(unnest(generate_series("
        "CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM sp) s LEFT JOIN cs ON cs.k = s.k AND cs.day = s.day)",
        "t0 AS (SELECT *, orders - lag(orders) OVER (PARTITION BY k ORDER BY day) AS d0 FROM dd WHERE day <= hi - 14)",
        f"t1 AS (SELECT *, {lags(d)} FROM t0)",
        *_least_squares("t1", own, f"{own[-1]} IS NOT NULL", "l"),
        f"t2 AS (SELECT t1.*, CASE WHEN {own[-1]} IS NOT NULL THEN d0 - ({' + '.join(f'c[{i + 1}] * {x}' for i, x in enumerate(own))}) END AS e0 FROM t1 JOIN lco USING (k))",
        f"t3 AS (SELECT *, {lags(e)} FROM t2)",
        *_least_squares("t3", [*d[1 : order + 1], *e[1:]], f"{d[order]} IS NOT NULL AND {e[-1]} IS NOT NULL", "", f", max(day) AS last, arg_max(orders, day) AS level, {at_end(d[:order])} AS h, {at_end(e[:moving])} AS g"),
        "fr AS (SELECT * FROM (WITH RECURSIVE ff AS (SELECT nm.k, nm.last AS day, level, h, g, c, hi FROM nm JOIN co USING (k) JOIN sp USING (k) UNION ALL "
        f"SELECT k, day + 1, level + ({move}), list_concat([{move}], h[1:{order - 1}]), list_concat([0e0], g[1:{moving - 1}]), c, hi FROM ff WHERE day < hi + 30) SELECT * FROM ff))",
    )


ORACLE["arima_forecast"] = _arima("'all'", "")
ORACLE["city_arima_forecast"] = _arima("City", "fr.k AS City,")
ORACLE["city_hourly_features"] = with_facts(
    f"""SELECT City, ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(day(ts) AS INTEGER) AS dayofmonth, CAST(month(ts) AS INTEGER) AS month,
  {r('orders', 'orders')}, {r('lag_1d', 'lag_1d')}, {r('lag_7d', 'lag_7d')}, {r('ma_7d', 'ma_7d')} FROM w WHERE lag_7d IS NOT NULL AND n = 168""",
    "ho AS (SELECT City, CAST(Order_Date AS TIMESTAMP) + to_hours(Order_Hour) AS ts, count(*) AS orders FROM facts WHERE Order_Date IS NOT NULL AND Order_Hour IS NOT NULL AND City IS NOT NULL GROUP BY ALL)",
    "sp AS (SELECT City, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM ho GROUP BY City)",
    "hs AS (SELECT City, ts, CAST(COALESCE(orders, 0) AS DOUBLE) AS orders FROM sp LEFT JOIN ho USING (City, ts))",
    "w AS (SELECT *, lag(orders, 24) OVER o AS lag_1d, lag(orders, 168) OVER o AS lag_7d, count(*) OVER b AS n, avg(orders) OVER b AS ma_7d FROM hs "
    "WINDOW o AS (PARTITION BY City ORDER BY ts), b AS (PARTITION BY City ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING))",
)
ORACLE["holiday_calendar_profit"] = with_facts(
    f"SELECT CAST(h.day IS NOT NULL AS INTEGER) AS IsHoliday, count(*) AS orders, {r('avg(Profit)', 'profit_mean')} FROM facts LEFT JOIN h ON h.day = facts.Order_Date GROUP BY 1",
    "busy AS (SELECT Order_Date AS day, row_number() OVER (PARTITION BY Year ORDER BY count(*) DESC, Order_Date) AS rn FROM facts WHERE Order_Date IS NOT NULL GROUP BY Year, Order_Date)",
    "h AS (SELECT day FROM busy WHERE rn <= 3 UNION SELECT day + 1 FROM busy WHERE rn <= 3)",
)
