"""Column expressions of the fact build (P1-P20). All are Spark built-ins, so
they stay inside whole-stage codegen; none of them needs a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchlens.params import HOLIDAYS, PEAK_HOURS

_CLOCK = r"^([0-9]{1,2}):([0-9]{2})(:([0-9]{2}))?$"


def parse_minutes(c: Column) -> Column:
    """First run of digits as a double ('24 min' -> 24.0); no digits -> NULL."""
    return F.regexp_substr(c, F.lit("[0-9]+")).try_cast("double")


def coerce_numeric(c: Column) -> Column:
    """String -> double; unparsable or NaN -> NULL."""
    x = F.trim(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_km: float = 6371.0) -> Column:
    """Great-circle distance in km; any NULL input gives NULL."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlat = p2 - p1
    dlon = F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    # clamp rounding overshoot at antipodes; least() would turn NULL into 1
    a = F.when(a > 1.0, F.lit(1.0)).otherwise(a)
    return F.lit(2.0) * F.asin(F.sqrt(a)) * F.lit(radius_km)


def parse_order_date(c: Column) -> Column:
    """P5: 'dd-MM-yyyy' -> DATE; malformed -> NULL."""
    return F.try_to_date(c, "dd-MM-yyyy")


def fill_missing_time(c: Column) -> Column:
    """Missing clock time -> '00:00'."""
    return F.coalesce(c, F.lit("00:00"))


def clock_parts(c: Column) -> tuple[Column, Column, Column]:
    """Hour, minute, second of an 'H:mm', 'HH:mm' or 'HH:mm:ss' string; all
    NULL when the string is not a valid clock time. Evaluate once per string
    (select the three parts into columns) and combine them afterwards."""
    parts = F.when(c.rlike(_CLOCK), F.split(c, ":"))
    h = F.try_element_at(parts, F.lit(1)).cast("int")
    m = F.try_element_at(parts, F.lit(2)).cast("int")
    s = F.coalesce(F.try_element_at(parts, F.lit(3)).cast("int"), F.when(parts.isNotNull(), F.lit(0)))
    return h, m, s


def valid_clock(h: Column, m: Column, s: Column) -> Column:
    return (h < 24) & (m < 60) & (s < 60)


def timestamp_ntz(d: Column, h: Column, m: Column, s: Column) -> Column:
    """DATE + clock parts -> TIMESTAMP_NTZ (wall-clock time without a zone,
    so nothing depends on the session time zone)."""
    return F.try_make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), h, m, s.cast("decimal(8,6)"))


def weekday_monday0(d: Column) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(d)


def is_weekend(weekday: Column) -> Column:
    """1 for Saturday/Sunday, 0 otherwise (also for NULL)."""
    return F.coalesce(weekday >= 5, F.lit(False)).cast("int")


def is_holiday(d: Column) -> Column:
    """P10: fixed-date holidays (Jan 1, Dec 25); NULL date -> 0."""
    cond = None
    for mon, day in HOLIDAYS:
        term = (F.month(d) == mon) & (F.dayofmonth(d) == day)
        cond = term if cond is None else (cond | term)
    return F.coalesce(cond, F.lit(False)).cast("int")


def is_peak_hour(hour: Column) -> Column:
    """Hour in 11-14 or 18-21 (inclusive); NULL -> 0."""
    cond = None
    for lo, hi in PEAK_HOURS:
        term = hour.between(lo, hi)
        cond = term if cond is None else (cond | term)
    return F.coalesce(cond, F.lit(False)).cast("int")


def clipped(x: Column, lo: float, hi: float) -> Column:
    """P12 helper: keep values inside [lo, hi], NULL otherwise."""
    return F.when((x >= lo) & (x <= hi), x)
