"""The cleaned, enriched delivery fact table.

Order of operations follows the reference's working preprocessing: row-level
parsing and features first; then the three data-dependent columns (global
mean wait for imputation, per-driver mean speed, per-restaurant mean prep time)
over *all* parsed rows; then costs; the null-drop last.

Scale notes
-----------
* The global mean is a scalar subquery: one partial aggregate per task and a
  single value inlined into the projection; no unpartitioned window.
* Per-driver and per-restaurant means are aggregates joined back on their key,
  not windows: the aggregate is partial (map-side), so a hot driver or
  restaurant never lands in one task. The means are written and counted, and
  broadcast up to ``BROADCAST_GROUPS`` rows, so facts aren't shuffled; beyond
  that AQE splits skewed partitions of the sort-merge join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlens.functions import columns as C
from dispatchlens.params import FactParams
from dispatchlens.session import compilable, written
from dispatchlens.sources.schema import RAW_SCHEMA

#: Partitions that rows are dealt to by month before they are split or joined by size: few enough for a shuffle that writes each
#: partition's file directly, without holding and spilling rows.
MONTH_PARTITIONS = 128
#: Drivers or restaurants whose means are broadcast at most (a key and a number each).
BROADCAST_GROUPS = 500_000

FACT_COLUMNS = [
    "Order_ID", "Customer_ID", "Restaurant_ID", "Delivery_person_ID", "Order_Date",
    "Time_Orderd", "Time_Order_picked", "Weatherconditions", "Road_traffic_density",
    "Type_of_vehicle", "Type_of_order", "City", "Restaurant_latitude", "Restaurant_longitude",
    "Delivery_location_latitude", "Delivery_location_longitude", "Delivery_person_Age",
    "Delivery_person_Ratings", "Time_taken_min", "Distance_km", "Route_Efficiency",
    "Actual_Distance_km", "Order_Datetime", "Pickup_Datetime", "Order_Hour", "Pickup_Hour",
    "Order_Minute", "Pickup_Minute", "DayOfWeek", "Month", "Year", "Day", "IsWeekend",
    "IsHoliday", "IsPeakHour", "Order_To_Pickup_Minutes", "Wait_Time_Minutes", "Delivery_Speed",
    "Restaurant_Prep_Time", "Delivery_Person_Efficiency", "Restaurant_Efficiency", "Time_Cost",
    "Distance_Cost", "Fuel_Cost", "Maintenance_Cost", "Total_Variable_Cost", "Total_Cost",
    "Revenue", "Profit", "CO2_Emissions", "Fuel_Consumption",
]

# Columns that must be present for a row to enter the fact table.
ESSENTIAL_COLUMNS = (
    "Time_taken_min", "Distance_km", "Delivery_person_Age",
    "Delivery_person_Ratings", "Order_Hour", "Pickup_Hour",
)


# The raw columns that each essential column comes from.
ESSENTIAL_INPUTS = {
    "Distance_km": ("Restaurant_latitude", "Restaurant_longitude", "Delivery_location_latitude", "Delivery_location_longitude"),
    "Order_Hour": ("Order_Date", "Time_Orderd"),
    "Pickup_Hour": ("Order_Date", "Time_Order_picked"),
}


def with_absent_columns(raw: DataFrame) -> DataFrame:
    """``raw`` with the columns of the raw schema that it lacks, as nulls: what depends on them is null, and
    null factors and groups are left out of every analysis."""
    return raw.withColumns({f.name: F.lit(None).cast(f.dataType) for f in RAW_SCHEMA.fields if f.name not in raw.columns})


def essential_columns(raw: DataFrame) -> list[str]:
    """P21's columns, without those that ``raw`` has no inputs for."""
    return [c for c in ESSENTIAL_COLUMNS if all(x in raw.columns for x in ESSENTIAL_INPUTS.get(c, (c,)))]


def parse_rows(raw: DataFrame, p: FactParams = FactParams()) -> DataFrame:
    """Per-row parsing and features (no cross-row state)."""
    return with_calendar(parse_base(raw, p), p)


def parse_base(raw: DataFrame, p: FactParams = FactParams()) -> DataFrame:
    """The parsed columns that :func:`with_calendar` derives the others from, year and month."""
    col = F.col
    raw = with_absent_columns(raw)
    d = C.parse_order_date(col("Order_Date"))
    t_order = C.fill_missing_time(col("Time_Orderd"))
    t_pick = C.fill_missing_time(col("Time_Order_picked"))
    dist = C.haversine_km(
        col("Restaurant_latitude"), col("Restaurant_longitude"),
        col("Delivery_location_latitude"), col("Delivery_location_longitude"),
        p.earth_radius_km,
    )
    df = raw.select(
        "Order_ID", "Customer_ID", "Restaurant_ID", "Delivery_person_ID",
        d.alias("Order_Date"),
        t_order.alias("Time_Orderd"),
        t_pick.alias("Time_Order_picked"),
        "Weatherconditions", "Road_traffic_density", "Type_of_vehicle", "Type_of_order", "City",
        "Restaurant_latitude", "Restaurant_longitude",
        "Delivery_location_latitude", "Delivery_location_longitude",
        C.coerce_numeric(col("Delivery_person_Age")).alias("Delivery_person_Age"),
        C.coerce_numeric(col("Delivery_person_Ratings")).alias("Delivery_person_Ratings"),
        C.parse_minutes(col("Time_taken_min")).alias("Time_taken_min"),
        dist.alias("Distance_km"),
    )
    # clock parts once per string, in their own projection
    o_h, o_m, o_s = C.clock_parts(col("Time_Orderd"))
    p_h, p_m, p_s = C.clock_parts(col("Time_Order_picked"))
    df = df.select("*", o_h.alias("_oh"), o_m.alias("_om"), o_s.alias("_os"),
                   p_h.alias("_ph"), p_m.alias("_pm"), p_s.alias("_ps"))
    od = col("Order_Date")
    has_date = od.isNotNull()
    o_ok = has_date & C.valid_clock(col("_oh"), col("_om"), col("_os"))
    p_ok = has_date & C.valid_clock(col("_ph"), col("_pm"), col("_ps"))
    df = df.select(
        "*",
        F.when(o_ok, col("_oh") * 3600 + col("_om") * 60 + col("_os")).alias("_osec"),
        F.when(p_ok, col("_ph") * 3600 + col("_pm") * 60 + col("_ps")).alias("_psec"),
        F.when(o_ok, C.timestamp_ntz(od, col("_oh"), col("_om"), col("_os"))).alias("Order_Datetime"),
        F.when(p_ok, C.timestamp_ntz(od, col("_ph"), col("_pm"), col("_ps"))).alias("Pickup_Datetime"),
    ).drop("_oh", "_om", "_os", "_ph", "_pm", "_ps")
    df = df.select("*", ((col("_psec") - col("_osec")) / F.lit(60.0)).alias("Order_To_Pickup_Minutes")).drop(
        "_osec", "_psec"
    )
    return df.select(
        "*",
        F.month(od).alias("Month"),
        F.year(od).alias("Year"),
        C.clipped(col("Order_To_Pickup_Minutes"), p.min_wait_minutes, p.max_wait_minutes).alias("Wait_Time_Minutes"),
    )


def with_calendar(base: DataFrame, p: FactParams = FactParams()) -> DataFrame:
    """The columns that follow from a row's dates, times and distance alone (a time is null unless date and clock are valid)."""
    od, ordered, picked = F.col("Order_Date"), F.col("Order_Datetime"), F.col("Pickup_Datetime")
    df = base.withColumns(
        {
            "Order_Hour": F.hour(ordered), "Pickup_Hour": F.hour(picked), "Order_Minute": F.minute(ordered), "Pickup_Minute": F.minute(picked),
            "DayOfWeek": C.weekday_monday0(od), "Day": F.dayofmonth(od), "IsHoliday": C.is_holiday(od),
            "Route_Efficiency": F.lit(p.detour_factor), "Actual_Distance_km": F.col("Distance_km") * F.lit(p.detour_factor),
        }
    )
    return df.withColumns({"IsWeekend": C.is_weekend(F.col("DayOfWeek")), "IsPeakHour": C.is_peak_hour(F.col("Order_Hour"))})


def facts(
    raw: DataFrame, p: FactParams = FactParams(), drop_incomplete: bool = True, materialize_parsed: bool = True, by_month: bool = False
) -> DataFrame:
    """Raw delivery rows -> cleaned fact table.

    With ``materialize_parsed`` the parsed rows are written once (as Parquet
    in the shared checkpoint folder) and read by the three aggregates
    and the final projection, instead of being re-parsed by each of them.
    ``by_month``: rows dealt to and ordered by their months, for a partitioned write. That happens before the
    columns that follow from others are added, so half of a fact's columns are neither shuffled nor sorted."""
    base = parse_base(raw, p)
    if materialize_parsed:
        with compilable(raw.sparkSession):
            base = written(base, "parsed")
    # Impute missing waits with the mean over all parsed rows.
    mean_wait = base.select(F.avg("Wait_Time_Minutes")).scalar()
    by_driver, by_restaurant = (near(written(means, "means")) for means in group_means(with_rates(base, mean_wait, p)))
    rows = base.join(by_driver, "Delivery_person_ID", "left").join(by_restaurant, "Restaurant_ID", "left")
    if by_month:
        rows = rows.hint("rebalance", MONTH_PARTITIONS, "Year", "Month").sortWithinPartitions("Year", "Month")
    return with_costs(with_rates(with_calendar(rows, p), mean_wait, p), p, essential_columns(raw) if drop_incomplete else [])


def near(groups: DataFrame) -> DataFrame:
    """A table of group means to be broadcast, if it has been counted to be small; the rows then aren't shuffled by a skewed key."""
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def with_rates(parsed: DataFrame, mean_wait: Column, p: FactParams) -> DataFrame:
    """Waits with missing ones imputed, speed and preparation time."""
    wait = F.coalesce(F.col("Wait_Time_Minutes"), mean_wait)
    return parsed.withColumns(
        {
            "Wait_Time_Minutes": wait,
            "Delivery_Speed": F.try_divide(F.col("Distance_km"), F.col("Time_taken_min")),
            "Restaurant_Prep_Time": wait * F.lit(p.prep_share_of_wait),
        }
    )


def group_means(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Means over all parsed rows by driver and by restaurant, without null keys."""
    by = lambda key, value, name: enriched.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(name))
    return by("Delivery_person_ID", "Delivery_Speed", "_driver_speed"), by("Restaurant_ID", "Restaurant_Prep_Time", "_rest_prep")


def with_costs(joined: DataFrame, p: FactParams, essential: Sequence[str] = ESSENTIAL_COLUMNS) -> DataFrame:
    """P16-P21 from rows that carry their group means."""
    col, c = F.col, p.cost
    time_cost = col("Time_taken_min") * F.lit(c.cost_per_min)
    dist_cost = col("Distance_km") * F.lit(c.cost_per_km)
    fuel_cost = col("Distance_km") * F.lit(c.fuel_cost_per_km)
    maint_cost = col("Distance_km") * F.lit(c.vehicle_maintenance)
    variable = time_cost + dist_cost + fuel_cost + maint_cost
    total = variable + F.lit(c.fixed_costs) + F.lit(c.driver_base_pay)
    out = joined.select(
        *[col(x) for x in FACT_COLUMNS[: FACT_COLUMNS.index("Restaurant_Prep_Time") + 1]],
        F.try_divide(col("Delivery_Speed"), col("_driver_speed")).alias("Delivery_Person_Efficiency"),
        F.try_divide(col("_rest_prep"), col("Restaurant_Prep_Time")).alias("Restaurant_Efficiency"),
        time_cost.alias("Time_Cost"),
        dist_cost.alias("Distance_Cost"),
        fuel_cost.alias("Fuel_Cost"),
        maint_cost.alias("Maintenance_Cost"),
        variable.alias("Total_Variable_Cost"),
        total.alias("Total_Cost"),
        F.lit(float(c.base_delivery_fee)).alias("Revenue"),
        (F.lit(float(c.base_delivery_fee)) - total).alias("Profit"),
        (col("Distance_km") * F.lit(p.env.co2_kg_per_km)).alias("CO2_Emissions"),
        (col("Distance_km") / F.lit(p.env.fuel_km_per_litre)).alias("Fuel_Consumption"),
    )
    return out.dropna(subset=list(essential)) if essential else out


def facts_from_star(spark, sf_dir: str, p: FactParams = FactParams()) -> DataFrame:
    from dispatchlens.sources.star import deliveries_from_star

    return facts(deliveries_from_star(spark, sf_dir), p)
