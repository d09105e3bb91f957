import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, T0
from tidemark.operators.errors import DataContractError
from tidemark.operators.splits import split_by_index
from tidemark.plans import models as m
from tidemark.plans import registry as reg
from tidemark.schemas import KEY, TIME
from tidemark.session import scratch_path


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        a, b = rng.gauss(50, 10), rng.gauss(-3, 0.5)
        c = 2 * a + rng.gauss(0, 1)
        rows.append(("s", T0 + dt.timedelta(hours=i), a, b, c, 9.0, 3 * a - 20 * b + rng.gauss(0, 2), a + b))
    df = spark.createDataFrame(
        rows, f"{KEY} string, {TIME} timestamp_ntz, a double, b double, c double, k double, "
        "aqi_target_1h double, aqi_target_2h double")
    return split_by_index(df).persist()


FEATURES = ["a", "b", "c", "k"]


def closed_form(rows, alpha):
    x = np.array([[r[c] for c in FEATURES] for r in rows])
    y = np.array([r["aqi_target_1h"] for r in rows])
    sd = x.std(0)
    sd[sd == 0] = 1.0
    z = (x - x.mean(0)) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(len(FEATURES)), z.T @ (y - y.mean()))
    return lambda r: float(((np.array([r[c] for c in FEATURES]) - x.mean(0)) / sd) @ w + y.mean())


@pytest.mark.parametrize("alpha", [0.01, 1.0, 1000.0])
def test_ridge_equals_closed_form(data, alpha):
    train = data.where("part = 'train'")
    want = closed_form(train.collect(), alpha)
    one_pass = m.ridge_by_horizon(data, FEATURES, [1], alpha)[1]
    ml = m.ridge(train, FEATURES, "aqi_target_1h", alpha).transform(m.assemble(data, FEATURES))
    for r in data.withColumn("p", one_pass.prediction()).collect():
        assert r["p"] == pytest.approx(want(r), rel=1e-8)
    for r in ml.collect():
        assert r["prediction"] == pytest.approx(want(r), rel=1e-6)


def test_contributions_add_up(data):
    model = m.ridge_by_horizon(data, FEATURES, [1])[1]
    total = sum((F.col(c) for c in FEATURES[1:]), F.col(FEATURES[0]))
    parts = m.linear_contributions(data, model).select(KEY, TIME, total.alias("total"))
    base = model.intercept + sum(w * mu for w, mu in zip(model.coefficients, model.means))
    for r in data.withColumn("p", model.prediction()).join(parts, [KEY, TIME]).collect():
        assert r["total"] + base == pytest.approx(r["p"], abs=1e-6)
    top = m.contribution_ranking(data, model, 2).collect()
    assert len(top) == 2 and top[0]["mean_abs_contribution"] >= top[1]["mean_abs_contribution"]


def test_grid_ranks_and_tests_once(data):
    df = data.select(KEY, TIME, "a", "b", "c", F.lit(90.0).alias("wind_direction_10m"), F.lit(1).alias("hour"),
                     F.lit(2).alias("day_of_week"), F.lit(3).alias("month"), "aqi_target_1h")
    grid, best = m.ridge_grid(df, "aqi_target_1h", [0.1, 1000.0], {"small": ["a"], "full": ["a", "b", "c"]})
    rows = grid.orderBy("validation_rmse").collect()
    assert len(rows) == 4
    winner = best.first()
    assert (winner["feature_set"], winner["alpha"]) == (rows[0]["feature_set"], rows[0]["alpha"]) == ("full", 0.1)


def test_boosting_beats_the_mean(data):
    train = data.where("part = 'train'")
    model = m.boosted(train, FEATURES, "aqi_target_1h", maxIter=20, stepSize=0.3)
    row = m.regression_metrics(model.transform(m.assemble(train, FEATURES)), "aqi_target_1h", "prediction").first()
    assert row["r2"] > 0.5
    gain = {r["feature"]: r["rmse_increase"] for r in
            m.permutation_importance(train, model, FEATURES, "aqi_target_1h").collect()}
    assert set(gain) == set(FEATURES) and gain["k"] == 0.0 and max(gain.values()) > 1.0


def test_null_input_is_an_error(data):
    with pytest.raises(Exception):
        m.assemble(data.withColumn("a", F.lit(None).cast("double")), FEATURES).collect()
    with pytest.raises(DataContractError):
        m.assemble(data, FEATURES, saved_order=FEATURES[::-1])


def test_registry_versions(spark, data):
    root = scratch_path(spark, "models")
    metrics = lambda models: m.linear_metrics(data, models, "Ridge").withColumnRenamed(
        "horizon", "forecast_horizon_hours")
    first = m.ridge_by_horizon(data, FEATURES, [1, 2], 1.0)
    assert reg.register_models(spark, root, first, FEATURES, metrics(first), {"model_type": "ridge"}, 2) == 1
    with pytest.raises(DataContractError, match="no model for horizons"):
        reg.register_models(spark, root, {1: first[1]}, FEATURES, metrics(first), {}, 2)
    tree = m.boosted(data.where("part = 'train'"), FEATURES, "aqi_target_2h", maxIter=2)
    second = {1: first[1], 2: tree}
    assert reg.register_models(spark, root, second, FEATURES, metrics(first), {"model_type": "mixed"}, 2) == 2
    version, loaded, saved = reg.load_latest_models(spark, root, FEATURES)
    assert version == 2 and saved == FEATURES and loaded[1] == first[1]
    a = loaded[2].transform(m.assemble(data, FEATURES)).agg(F.sum("prediction")).first()[0]
    b = tree.transform(m.assemble(data, FEATURES)).agg(F.sum("prediction")).first()[0]
    assert a == pytest.approx(b)
    with pytest.raises(DataContractError):
        reg.load_latest_models(spark, root, FEATURES[::-1])
    from tidemark.sources.tables import _fs_delete
    assert reg.horizon_metrics(spark, root, 2, 1).count() == 1
    _fs_delete(spark, f"{root}/version=2/h=01")
    with pytest.raises(DataContractError, match="no model for horizons"):
        reg.load_latest_models(spark, root, FEATURES)
    assert reg.promote(reg.metadata_table(spark, root), "rmse_1h").first()["promote"] is True


def test_forecast_has_72_consecutive_hours(spark):
    from tidemark.catalog.frames import forecast
    from tidemark.functions.scoring import category
    df = forecast(spark, SF.replace("0.001", "0.01"))
    rows = df.orderBy("horizon_hours").collect()
    assert [r["horizon_hours"] for r in rows] == list(range(1, 73))
    assert all(r["forecast_time"] == r["forecast_generated_at"] + dt.timedelta(hours=r["horizon_hours"]) for r in rows)
    assert df.where(category("predicted_aqi") != F.col("aqi_category")).isEmpty()


def test_entry_runs(spark):
    import __spark_entry__ as e
    row = e.entry(spark).first()
    assert row["row_count"] > 0 and row["r2"] is not None
    assert set(e.oracle_sql()) <= set(e.queries())
