"""Raw delivery schema (what a CSV export of the orders holds)."""

from pyspark.sql import types as T

RAW_SCHEMA = T.StructType(
    [
        T.StructField("Order_ID", T.StringType()),
        T.StructField("Customer_ID", T.StringType()),
        T.StructField("Restaurant_ID", T.StringType()),
        T.StructField("Delivery_person_ID", T.StringType()),
        T.StructField("Order_Date", T.StringType()),
        T.StructField("Time_Orderd", T.StringType()),
        T.StructField("Time_Order_picked", T.StringType()),
        T.StructField("Weatherconditions", T.StringType()),
        T.StructField("Road_traffic_density", T.StringType()),
        T.StructField("Type_of_vehicle", T.StringType()),
        T.StructField("Type_of_order", T.StringType()),
        T.StructField("City", T.StringType()),
        T.StructField("Restaurant_latitude", T.DoubleType()),
        T.StructField("Restaurant_longitude", T.DoubleType()),
        T.StructField("Delivery_location_latitude", T.DoubleType()),
        T.StructField("Delivery_location_longitude", T.DoubleType()),
        T.StructField("Delivery_person_Age", T.StringType()),
        T.StructField("Delivery_person_Ratings", T.StringType()),
        T.StructField("Time_taken_min", T.StringType()),
    ]
)
RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]
# The CSV header spells the delivery-time column with parentheses.
CSV_TIME_TAKEN = "Time_taken(min)"
