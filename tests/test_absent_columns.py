import pytest

from dispatchlens.operators import customers as U
from dispatchlens.operators import drivers as V
from dispatchlens.operators import efficiency as E
from dispatchlens.operators import profitability as R
from dispatchlens.plans.facts import FACT_COLUMNS, facts
from dispatchlens.plans.materialize import fact_table, raw_deliveries
from dispatchlens.session import written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "absent", ["Weatherconditions", "Restaurant_latitude", "Time_Order_picked", "Delivery_person_Ratings", "Restaurant_ID", "Customer_ID", "City", "Order_Date"]
)
def test_facts_and_operators_without_a_column(spark, absent):
    raw = raw_deliveries(spark, SF)
    f = written(facts(raw.drop(absent)), "facts-test")
    assert f.columns == FACT_COLUMNS
    assert f.count() >= fact_table(spark, SF).count() > 0
    factors = {r.factor for r in R.profit_by_factor(f).collect()}
    assert absent not in factors and "Type_of_vehicle" in factors
    for op in (R.overall_metrics, R.profit_by_hour, E.efficiency_by_factor, E.restaurant_delays, V.driver_metrics, U.customer_profile, U.customer_rfm):
        op(f).collect()


def test_scans_are_pruned_and_filters_pushed(spark):
    f = fact_table(spark, SF)
    plan = R.profitable_pct(f)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Profit:double>" in plan
    plan = f.where("Month = 1 and Profit > 0").select("Profit")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Month" in plan and "GreaterThan(Profit,0.0)" in plan
