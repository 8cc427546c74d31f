import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from dispatchlens.operators import pricing as X


def test_price_bucket_is_strict(spark):
    df = spark.createDataFrame([(100.0,), (99.99,), (100.01,), (10.0,), (250.0,), (50.0,)], "c double")
    out = [r[0] for r in df.select(X.price_bucket(F.col("c"))).collect()]
    assert out == [105, 100, 105, 50, 255, 55]


def test_price_grid_matches_direct_count(spark):
    rng = np.random.default_rng(3)
    costs = np.concatenate([rng.uniform(40, 230, 500), np.arange(50, 201, 5, dtype=float)])
    f = spark.createDataFrame(pd.DataFrame({"Total_Cost": costs}))
    g = X.price_grid(f).toPandas()
    for _, r in g.iterrows():
        p = r.Base_Price
        assert abs(r.Profitable_Deliveries_Pct - (p - costs > 0).mean() * 100) < 1e-9
        assert abs(r.Average_Profit - (p - costs).mean()) < 1e-9


def test_equal_width_bins_match_pandas_cut(spark):
    vals = np.array([100.0, 120.0, 150.0, 150.0, 180.0, 688.8, 300.0, 100.0])
    b = X.equal_width_bins(spark.createDataFrame(pd.DataFrame({"v": vals})), "v", 10).toPandas()
    exp = pd.cut(pd.Series(vals), bins=10).value_counts(sort=False).to_numpy()
    assert b.orders.tolist() == exp.tolist()
    assert len(b) == 10
