"""Spark ML models.

Splits are deterministic hashes of the order id, not ``randomSplit`` (whose
rows depend on partitioning), so the same rows are held out on every run and
the split can be reproduced in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispatchlens.functions import boosting
from dispatchlens.session import written

SEED = 42
# The inputs of the two models, which must match
TIME_FEATURES = (
    "Distance_km", "Order_Hour", "Pickup_Hour", "DayOfWeek", "IsWeekend", "IsPeakHour", "IsHoliday",
    "Weatherconditions", "Road_traffic_density", "Wait_Time_Minutes", "City", "Type_of_vehicle",
)
TIME_CATEGORICAL = ("Weatherconditions", "Road_traffic_density", "City", "Type_of_vehicle")
PRICE_FEATURES = (
    "Distance_km", "Time_taken_min", "Wait_Time_Minutes", "Order_Hour", "IsWeekend", "IsPeakHour", "IsHoliday",
    "Delivery_Speed", "Restaurant_Prep_Time",
)


def hash_split(df: DataFrame, key: str = "Order_ID", train_pct: int = 80) -> tuple[DataFrame, DataFrame]:
    """M3: deterministic train/test split on a hash of ``key``."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100
    d = df.withColumn("_bucket", bucket)
    return d.where(F.col("_bucket") < train_pct).drop("_bucket"), d.where(F.col("_bucket") >= train_pct).drop("_bucket")


def split_counts(facts: DataFrame) -> DataFrame:
    """M3 in numbers: orders and mean delivery time of each side of the split."""
    sides = [d.select(F.lit(name).alias("split"), "Time_taken_min") for name, d in zip(("train", "test"), hash_split(facts))]
    return sides[0].unionByName(sides[1]).groupBy("split").agg(F.count(F.lit(1)).alias("orders"), F.avg("Time_taken_min").alias("time_mean"))


def time_features(facts: DataFrame, candidates: Sequence[str] = TIME_FEATURES, min_features: int = 5):
    """M1: the candidate features present in ``facts`` (needs >= 5), split
    into numeric and categorical."""
    avail = [c for c in candidates if c in facts.columns]
    if len(avail) < min_features:
        raise ValueError(f"need at least {min_features} features, found {avail}")
    cats = [c for c in TIME_CATEGORICAL if c in avail]
    nums = [c for c in avail if c not in cats]
    return nums, cats


def feature_pipeline(nums: Sequence[str], cats: Sequence[str]):
    """M2: standardise numerics, one-hot categoricals (unseen values -> all
    zeros: the 'keep' index is the dropped last slot)."""
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    stages = [StringIndexer(inputCol=c, outputCol=f"_{c}_i", handleInvalid="keep") for c in cats]
    if cats:
        stages.append(OneHotEncoder(inputCols=[f"_{c}_i" for c in cats], outputCols=[f"_{c}_v" for c in cats], dropLast=True))
    stages.append(VectorAssembler(inputCols=list(nums), outputCol="_nums", handleInvalid="skip"))
    stages.append(StandardScaler(inputCol="_nums", outputCol="_nums_z", withMean=True, withStd=True))
    stages.append(VectorAssembler(inputCols=["_nums_z", *[f"_{c}_v" for c in cats]], outputCol="features"))
    return stages


def _regressors(label: str, n_train: int, y_std_pop: float):
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    return {
        "Linear Regression": LinearRegression(labelCol=label, regParam=0.0),
        # Ridge alpha = 1 in the closed form (X'X + aI)^-1 X'y equals Spark's
        # objective with regParam = a * std_pop(y) / n (no standardisation).
        "Ridge Regression": LinearRegression(
            labelCol=label, elasticNetParam=0.0, solver="normal", standardization=False,
            regParam=1.0 * y_std_pop / max(n_train, 1),
        ),
        "Random Forest": RandomForestRegressor(labelCol=label, numTrees=100, maxDepth=10, seed=SEED),
        "Boosted Trees": GBTRegressor(labelCol=label, maxIter=100, stepSize=0.1, maxDepth=5, seed=SEED),
    }


def regression_metrics(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """M8: MAE, MSE, RMSE and R^2 in one aggregate."""
    err = F.col(label) - F.col(prediction)
    a = pred.agg(
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
        F.sum(err * err).alias("_sse"), F.var_pop(label).alias("_var"), F.count(F.lit(1)).alias("_n"),
    )
    return a.select("mae", "mse", F.sqrt("mse").alias("rmse"),
                    (F.lit(1.0) - F.col("_sse") / (F.col("_var") * F.col("_n"))).alias("r2"))


def feature_names(vectors: DataFrame, column: str = "features") -> list[str]:
    """Names of a vector column's slots, from the attributes that the feature stages leave with it."""
    attrs = vectors.schema[column].metadata["ml_attr"]["attrs"]
    return [x["name"] for x in sorted((x for kind in attrs.values() for x in kind), key=lambda x: x["idx"])]


def _importances(model, names: Sequence[str], nums: Sequence[str], cats: Sequence[str]) -> list[tuple[str, float]]:
    """Importance of each input: numeric columns by name, categories as ``column_value``."""
    plain = []
    for n in names:
        if n.startswith("_nums_z_"):
            plain.append(nums[int(n.rsplit("_", 1)[1])])
        else:
            c = next(c for c in cats if n.startswith(f"_{c}_v_"))
            plain.append(f"{c}_{n.removeprefix(f'_{c}_v_')}")
    return sorted(zip(plain, map(float, model.featureImportances.toArray())), key=lambda t: (-t[1], t[0]))


def delivery_time_models(facts: DataFrame, label: str = "Time_taken_min", models: Sequence[str] | None = None):
    """M1-M9: fit linear, ridge, random forest and boosted trees on an 80/20
    hash split; return (metrics DataFrame, importances DataFrame of the best
    tree model by MAE; ``is_best`` marks the best of all models). The linear models are
    solved in closed form (``operators.linear``). The feature stages of the others are
    fitted once, train and test vectors are written once, and all are fitted at the same time."""
    from pyspark.ml import Pipeline

    from dispatchlens.operators.linear import MODELS, linear_delivery_time

    known = facts.agg(*[F.count(c).alias(c) for c in TIME_FEATURES if c in facts.columns]).first().asDict()
    nums, cats = time_features(facts, [c for c in TIME_FEATURES if known.get(c)])
    data = facts.select("Order_ID", *nums, *cats, F.col(label).cast("double").alias(label)).dropna(subset=[label])
    train, test = hash_split(data)
    stages = Pipeline(stages=feature_pipeline(nums, cats)).fit(train)
    shaped = stages.transform(train)
    names = feature_names(shaped)
    vectors = [written(d.select("features", label), "vectors") for d in (shaped, stages.transform(test))]
    wanted = [m for m in _regressors(label, 1, 0.0) if not models or m in models]

    def fit(name: str):
        own = _regressors(label, 1, 0.0)[name]
        model = boosting.fit(own, vectors[0]) if name == "Boosted Trees" else own.fit(vectors[0])
        return model, regression_metrics(model.transform(vectors[1]), label).first()

    def closed():
        return {r["model"]: r for r in linear_delivery_time(facts, label)[1].collect()}

    trees = [m for m in wanted if m not in MODELS]
    apart = inheritable_thread_target(facts.sparkSession)
    with ThreadPoolExecutor(len(trees) + 1) as pool:  # a job alone leaves most of the cluster idle between its rounds
        linear = pool.submit(apart(closed)) if len(trees) < len(wanted) else None
        fits = {m: pool.submit(apart(fit), m) for m in trees}
        fitted = {m: f.result()[0] for m, f in fits.items()}
        found = (linear.result() if linear else {}) | {m: f.result()[1] for m, f in fits.items()}
    rows = [(m, *(found[m][c] for c in ("mae", "mse", "rmse", "r2"))) for m in wanted]
    best = min(rows, key=lambda r: r[1])[0]
    spark = facts.sparkSession
    metrics = spark.createDataFrame(
        [(*r, r[0] == best) for r in rows], "model string, mae double, mse double, rmse double, r2 double, is_best boolean"
    )
    trees = [r for r in rows if r[0] in fitted]
    imps = _importances(fitted[min(trees, key=lambda r: r[1])[0]], names, nums, cats) if trees else []
    return metrics, spark.createDataFrame(imps, "feature string, importance double")


def dynamic_price_model(facts: DataFrame, features: Sequence[str] = PRICE_FEATURES, markup: float = 1.25):
    """Boosted trees learning ``markup x Total_Cost`` from up to nine
    order features (NULLs as 0); (metrics, importances)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    feats = [c for c in features if c in facts.columns]
    if len(feats) < 5:
        raise ValueError("need at least 5 features")
    data = facts.select("Order_ID", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats],
                        (F.col("Total_Cost") * markup).alias("label")).dropna(subset=["label"])
    data = written(data, "prices")
    train, test = hash_split(data)
    va = VectorAssembler(inputCols=feats, outputCol="features")
    model = boosting.fit(GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=5, seed=SEED), va.transform(train))
    m = regression_metrics(model.transform(va.transform(test)), "label")
    spark = facts.sparkSession
    imp = sorted(zip(feats, map(float, model.featureImportances.toArray())), key=lambda t: -t[1])
    return m.select("mae", "mse", "r2"), spark.createDataFrame(imp, "feature string, importance double")


HOURLY_FEATURES = ("hour", "dayofweek", "dayofmonth", "month", "lag_1d", "lag_7d", "ma_7d")


def hourly_demand_model(facts: DataFrame, test_hours: int = 168):
    """Boosted trees (depth 3) on the hourly features; the last 168 hours
    are the test set; (metrics(mae, rmse), importances)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from dispatchlens.operators.demand import hourly_features

    h = hourly_features(facts)
    pos = F.row_number().over(Window.orderBy(F.desc("ts")))  # one row per hour: bounded
    # written by the window's one task: each round of the fit then reads one small file instead of building the features again
    h = written(h.withColumn("_pos", pos), "hourly")
    va = VectorAssembler(inputCols=list(HOURLY_FEATURES), outputCol="features")
    train = va.transform(h.where(F.col("_pos") > test_hours))
    test = va.transform(h.where(F.col("_pos") <= test_hours))
    model = GBTRegressor(labelCol="orders", maxIter=100, stepSize=0.1, maxDepth=3, seed=SEED).fit(train)
    m = regression_metrics(model.transform(test), "orders").select("mae", "rmse")
    imp = sorted(zip(HOURLY_FEATURES, map(float, model.featureImportances.toArray())), key=lambda t: -t[1])
    return m, facts.sparkSession.createDataFrame(imp, "feature string, importance double")
