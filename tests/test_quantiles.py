import numpy as np
import pandas as pd
import pytest

from dispatchlens.functions import quantiles
from dispatchlens.functions.quantiles import exact_quantiles


@pytest.mark.parametrize("limit,buckets,accuracy", [(10**9, 4096, 1000), (50, 8, 1000), (3, 4, 100), (10**9, 4096, 100), (20, 8, 40)])
def test_exact_quantiles_match_pandas(spark, limit, buckets, accuracy):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"g": rng.integers(0, 4, n), "x": rng.normal(size=n), "y": rng.integers(0, 5, n).astype(float)})
    pdf.loc[::11, "x"] = np.nan
    pdf.loc[pdf.g == 3, "y"] = 2.5  # constant group
    q = exact_quantiles(spark.createDataFrame(pdf), ["g"], ["x", "y"], (0.25, 0.5, 0.75),
                        rank_rows=limit, buckets=buckets, accuracy=accuracy).toPandas().set_index("g").sort_index()
    exp = pdf.groupby("g")[["x", "y"]].quantile([0.25, 0.5, 0.75]).unstack()
    for m in ("x", "y"):
        for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
            assert np.allclose(q[f"{m}_{name}"].to_numpy(), exp[(m, p)].to_numpy(), rtol=0, atol=1e-12)


def test_global_quantile(spark):
    pdf = pd.DataFrame({"x": [5.0, 1.0, 3.0, 2.0]})
    q = exact_quantiles(spark.createDataFrame(pdf), [], ["x"], (0.5,), ["med"], rank_rows=2, buckets=2).first()
    assert q.x_med == 2.5


def test_ranks_outside_their_brackets_are_found_again(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MARGIN", 0)  # brackets of one value of the sketch, mostly beside the rank
    pdf = pd.DataFrame({"g": np.arange(4000) % 2, "x": np.random.default_rng(3).normal(size=4000)})
    for limit in (10**9, 50):
        q = exact_quantiles(spark.createDataFrame(pdf), ["g"], ["x"], (0.1, 0.5), rank_rows=limit, buckets=16, accuracy=20).toPandas().set_index("g")
        assert np.allclose(q.sort_index().to_numpy(), pdf.groupby("g").x.quantile([0.1, 0.5]).unstack().to_numpy(), rtol=0, atol=1e-12)


def test_skewed_values_take_two_scans(spark, monkeypatch):
    scans = []
    at_or_below = quantiles._at_or_below
    monkeypatch.setattr(quantiles, "_at_or_below", lambda *a: scans.append(a) or at_or_below(*a))
    x = np.concatenate([np.zeros(5000), np.exp(np.random.default_rng(4).normal(0, 4, 15000))])
    q = exact_quantiles(spark.createDataFrame(pd.DataFrame({"x": x})), [], ["x"], (0.25, 0.5, 0.99), rank_rows=1000).first()
    assert len(scans) == 1  # the sketch's scan, and this one
    assert np.allclose(list(q), np.quantile(x, [0.25, 0.5, 0.99]), rtol=0, atol=1e-9)


def test_empty_input_and_groups_without_values(spark):
    rows = spark.createDataFrame([("a", None), ("b", 2.0), ("b", 4.0), (None, 7.0)], "g string, x double")
    assert {r["g"]: r["x_p50"] for r in exact_quantiles(rows, ["g"], ["x"]).collect()} == {"b": 3.0, None: 7.0}
    assert exact_quantiles(rows.where("x > 9"), ["g"], ["x"]).count() == 0
