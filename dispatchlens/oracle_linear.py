"""DuckDB twins of the closed-form regressions (M4, M5)."""

from __future__ import annotations

from dispatchlens.operators.linear import MODELS, TINY
from dispatchlens.operators.models import TIME_CATEGORICAL, TIME_FEATURES
from dispatchlens.oracle import with_facts
from dispatchlens.oracle_queries import _SPLIT, r
from dispatchlens.oracle_series import ORACLE

_NUMS = [c for c in TIME_FEATURES if c not in TIME_CATEGORICAL]
_CATS = [c for c in TIME_FEATURES if c in TIME_CATEGORICAL]


def _fits() -> list[str]:
    """co(model, slots, c): each model's slots and coefficients; lo: the rows' slots in long form."""
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [*_NUMS, "Time_taken_min"])
    scale = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m{i}, stddev_samp(CAST({c} AS DOUBLE)) AS s{i}" for i, c in enumerate(_NUMS))
    slots = ["{o: 0, s: '1', v: 1e0}"]
    slots += [f"{{o: {i + 1}, s: '{c}', v: CASE WHEN s{i} > 0 THEN ({c} - m{i}) / s{i} ELSE 0e0 END}}" for i, c in enumerate(_NUMS)]
    slots += [f"{{o: {len(_NUMS) + 1 + i}, s: '{c}=' || {c}, v: 1e0}}" for i, c in enumerate(_CATS)]
    models = ", ".join(f"('{m}', {p!r}::DOUBLE)" for m, p in MODELS.items())
    pivot = f"list_transform(m[i], lambda x: CASE WHEN m[i][i] > {TINY} * size[i] THEN x / m[i][i] ELSE 0e0 END)"
    return [
        f"rw AS (SELECT *, {_SPLIT} AS split, CAST(Time_taken_min AS DOUBLE) AS y, row_number() OVER () AS id FROM facts WHERE {whole})",
        f"sc AS (SELECT {scale} FROM rw WHERE split = 'train')",
        f"l0 AS (SELECT id, split, y, unnest([{', '.join(slots)}]) AS e FROM rw, sc)",
        "lo AS (SELECT id, split, y, e.o AS o, e.s AS s, e.v AS v FROM l0 WHERE e.s IS NOT NULL)",
        "tr AS (SELECT * FROM lo WHERE split = 'train')",
        "so AS (SELECT o, s, row_number() OVER (ORDER BY o, s) AS k FROM tr GROUP BY o, s)",
        "pr AS (SELECT a.s AS s, b.s AS t, sum(a.v * b.v) AS value FROM tr a JOIN tr b USING (id) GROUP BY ALL)",
        "ry AS (SELECT s, sum(v * y) AS value FROM tr GROUP BY s)",
        f"mo AS (SELECT * FROM (VALUES {models}) AS x(model, penalty))",
        "ce AS (SELECT model, a.k AS i, b.k AS j, COALESCE(value, 0e0) + CASE WHEN a.k = b.k AND a.k > 1 THEN penalty ELSE 0e0 END AS x FROM mo, so a CROSS JOIN so b LEFT JOIN pr ON pr.s = a.s AND pr.t = b.s "
        "UNION ALL SELECT model, k, (SELECT count(*) + 1 FROM so), value FROM mo, so JOIN ry USING (s))",
        "ro AS (SELECT model, i, list(x ORDER BY j) AS row FROM ce GROUP BY model, i)",
        "nm AS (SELECT model, list(row ORDER BY i) AS m, list(row[i] ORDER BY i) AS size FROM ro GROUP BY model)",
        "gj AS (SELECT * FROM (WITH RECURSIVE gr AS (SELECT model, 1 AS i, m, size FROM nm UNION ALL SELECT model, i + 1, list_transform(m, lambda row, j: CASE WHEN j = i THEN p ELSE "
        f"list_transform(range(1, len(p) + 1), lambda t: row[t] - row[i] * p[t]) END), size FROM (SELECT *, {pivot} AS p FROM gr WHERE i <= len(size))) SELECT * FROM gr))",
        "co AS (SELECT model, s, list_transform(m, lambda row: row[len(row)])[k] AS c FROM gj, so WHERE i = len(size) + 1)",
    ]


ORACLE["linear_coefficients"] = with_facts(f"SELECT model, s AS slot, {r('c', 'coefficient')} FROM co", *_fits())
ORACLE["linear_metrics"] = with_facts(
    f"""SELECT model, {r('avg(abs(e))', 'mae')}, {r('avg(e * e)', 'mse')}, {r('sqrt(avg(e * e))', 'rmse')}, {r('1e0 - sum(e * e) / (var_pop(y) * count(*))', 'r2')} FROM pe GROUP BY model""",
    *_fits(),
    "pe AS (SELECT model, id, y, y - sum(v * COALESCE(c, 0e0)) AS e FROM (SELECT lo.*, mo.model FROM lo, mo WHERE split = 'test') x LEFT JOIN co USING (model, s) GROUP BY model, id, y)",
)

# The fact store's report is that of facts built at once.
ORACLE["monthly_report_by_batches"] = with_facts(
    f"""SELECT Year, Month, count(*) AS orders, {r('avg(Profit)', 'profit_mean')}, {r('avg(Wait_Time_Minutes)', 'wait_mean')},
  {r('avg(Delivery_Person_Efficiency)', 'driver_efficiency_mean')}, {r('avg(Restaurant_Efficiency)', 'restaurant_efficiency_mean')} FROM facts GROUP BY Year, Month"""
)
