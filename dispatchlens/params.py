"""Business parameters with the reference's defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CostParams:
    """Per-order revenue and cost model (currency units)."""

    base_delivery_fee: float = 100.0
    cost_per_min: float = 2.0
    cost_per_km: float = 3.0
    fixed_costs: float = 20.0
    driver_base_pay: float = 30.0
    fuel_cost_per_km: float = 1.5
    vehicle_maintenance: float = 0.5

    @classmethod
    def app(cls) -> "CostParams":
        """Dashboard cost model: 20 + 3 per km + 2 per minute."""
        return cls(driver_base_pay=0.0, fuel_cost_per_km=0.0, vehicle_maintenance=0.0)


@dataclass(frozen=True)
class EnvParams:
    co2_kg_per_km: float = 0.12
    fuel_km_per_litre: float = 15.0


@dataclass(frozen=True)
class FactParams:
    """Everything the fact-table build needs besides the input rows."""

    cost: CostParams = field(default_factory=CostParams)
    env: EnvParams = field(default_factory=EnvParams)
    # The reference draws a random route factor in [1.0, 1.5]; we use a fixed
    # detour factor (the midpoint) so results are reproducible.
    detour_factor: float = 1.25
    earth_radius_km: float = 6371.0
    min_wait_minutes: float = 0.0
    max_wait_minutes: float = 120.0
    prep_share_of_wait: float = 0.7


# --- fixed values (must equal the reference for equal results) -------------
# Dynamic-pricing surge factors of the batch analysis.
PEAK_HOUR_SURGE = 1.5
WEEKEND_SURGE = 1.2
HOLIDAY_SURGE = 1.3
TRAFFIC_SURGE = {"Jam": 1.4, "High": 1.3, "Medium": 1.15, "Low": 1.0}
WEATHER_SURGE = {
    "Fog": 1.3,
    "Stormy": 1.4,
    "Sandstorms": 1.35,
    "Windy": 1.2,
    "Cloudy": 1.1,
    "Sunny": 1.0,
}
HOUR_SURGE = {
    0: 1.2, 1: 1.3, 2: 1.4, 3: 1.5, 4: 1.4, 5: 1.3,
    6: 1.1, 7: 1.2, 8: 1.3, 9: 1.1, 10: 1.0, 11: 1.1,
    12: 1.2, 13: 1.1, 14: 1.0, 15: 1.0, 16: 1.1, 17: 1.2,
    18: 1.3, 19: 1.4, 20: 1.3, 21: 1.2, 22: 1.1, 23: 1.2,
}
# Dashboard variant of the surge factors (display table).
APP_SURGE = {
    "Weather": {"Sunny": 1.0, "Cloudy": 1.1, "Rainy": 1.3, "Foggy": 1.3, "Stormy": 1.4},
    "Traffic": {"Low": 1.0, "Medium": 1.15, "High": 1.3, "Jam": 1.4},
    "Time of Day": {
        "Morning (6-10)": 1.1,
        "Midday (10-14)": 1.0,
        "Afternoon (14-18)": 1.1,
        "Evening (18-22)": 1.3,
        "Night (22-6)": 1.2,
    },
    "Day Type": {"Weekday": 1.0, "Weekend": 1.2, "Holiday": 1.3},
}
# Holidays as (month, day).
HOLIDAYS = ((1, 1), (12, 25))
# Peak hours, inclusive ranges.
PEAK_HOURS = ((11, 14), (18, 21))
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
SHIFT_NAMES = ("Morning (6 AM - 2 PM)", "Afternoon (2 PM - 10 PM)", "Night (10 PM - 6 AM)")
# Price grid of the uniform and segment price search.
PRICE_GRID = (50, 200, 5)
VIABLE_PROFITABLE_PCT = 90.0
MIN_SEGMENT_ROWS = 100
MIN_GROUP_ROWS = 10
DELIVERIES_PER_DRIVER_HOUR = 2
SHIFT_HOURS = 8

# Factor lists of the analyses.
PROFIT_FACTORS = (
    "City",
    "Type_of_vehicle",
    "Weatherconditions",
    "Road_traffic_density",
    "Route_Type",
    "IsWeekend",
    "IsPeakHour",
    "IsHoliday",
)
SEGMENT_FACTORS = (
    "City",
    "Type_of_vehicle",
    "Weatherconditions",
    "Road_traffic_density",
    "IsWeekend",
    "IsPeakHour",
)
EFFICIENCY_FACTORS = SEGMENT_FACTORS
