import datetime as dt

import pytest

from tidemark.functions import calendar as cal
from tidemark.functions import scoring as sc
from tidemark.operators import aggregates as agg
from tidemark.operators import joins, project
from tidemark.operators.errors import DataContractError
from tidemark.operators.guards import non_empty, same_order, validate_batch
from tidemark.operators.quantiles import exact_quantiles
from tidemark import schemas as sch


def one(spark, value, kind="double"):
    return spark.createDataFrame([(value,)], f"x {kind}")


@pytest.mark.parametrize("value,text", [
    (0.0, "Good"), (50.0, "Good"), (50.01, "Moderate"), (100.0, "Moderate"),
    (150.0, "Unhealthy for Sensitive Groups"), (200.0, "Unhealthy"), (300.0, "Very Unhealthy"),
    (300.01, "Hazardous"), (None, None), (float("nan"), None)])
def test_category(spark, value, text):
    sc.register_sql_functions(spark)
    df = one(spark, value)
    assert df.select(sc.category("x")).first()[0] == text
    assert df.selectExpr("aqi_category(x)").first()[0] == text


@pytest.mark.parametrize("value,low", [(-3.0, 0.0), (0.0, 0.0), (2.5, 2.5), (float("nan"), 0.0), (None, None)])
def test_clamp(spark, value, low):
    assert one(spark, value).select(sc.clamp_min("x")).first()[0] == low


@pytest.mark.parametrize("value,digits", [(0.25, 1), (0.35, 1), (46.25, 1), (2.675, 2), (-0.25, 1), (-1.05, 1), (1234.5, 0), (0.05, 1)])
def test_format_like_python(spark, value, digits):
    assert one(spark, value).select(sc.format_number("x", digits)).first()[0] == f"{value:.{digits}f}"


def test_round_display_half_even(spark):
    assert one(spark, 0.25).select(sc.round_display("x", 1)).first()[0] == 0.2


@pytest.mark.parametrize("day,dow,weekend", [(6, 5, 1), (7, 6, 1), (8, 0, 0)])
def test_weekday(spark, day, dow, weekend):
    df = one(spark, dt.datetime(2024, 1, day), "timestamp_ntz")
    assert tuple(df.select(cal.day_of_week("x"), cal.is_weekend("x")).first()) == (dow, weekend)


def test_latest_completed_and_epoch(spark):
    df = one(spark, dt.datetime(2024, 5, 3, 20, 34, 10), "timestamp_ntz")
    row = df.select(cal.latest_completed("x"), cal.from_epoch_seconds(cal.epoch_seconds("x")),
                    cal.convert_tz("x", "UTC", "Asia/Tashkent")).first()
    assert row[0] == dt.datetime(2024, 5, 3, 19)
    assert row[1] == dt.datetime(2024, 5, 3, 20, 34, 10)
    assert row[2] == dt.datetime(2024, 5, 4, 1, 34, 10)


def test_epoch_ignores_the_session_zone(spark):
    df = one(spark, dt.datetime(2024, 3, 10, 2, 30), "timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # a local hour that is skipped
        row = df.select(cal.floor_hour("x"), cal.from_epoch_seconds(cal.epoch_seconds("x"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(row) == (dt.datetime(2024, 3, 10, 2), dt.datetime(2024, 3, 10, 2, 30))


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (4.0,)], "x double")
    got = {r["bin"]: r["count"] for r in agg.histogram(df, "x", 5).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1}


def test_constant_truth_has_no_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "y double, p double")
    row = agg.regression_metrics(df, "y", "p").first()
    assert (row["mae"], row["rmse"], row["r2"]) == (1.0, 1.0, None)


@pytest.mark.parametrize("small,accuracy", [(500_000, 2000), (20, 50), (3, 4)])
def test_exact_quantiles_by_narrowing(spark, small, accuracy):
    import numpy as np
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(0, 4, 400), np.full(250, 7.0), [-1e12, 1e12]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    ps = [0.0, 0.25, 0.5, 0.8, 0.99, 1.0]
    got = exact_quantiles(df, "x", ps, small, accuracy)
    assert got == pytest.approx(list(np.quantile(values, ps)), rel=1e-12)


def test_contracts(spark, hourly):
    df = hourly([("a", 0, 1), ("a", 1, 2)])
    cols = ["series_id", "time", "us_aqi"]
    assert validate_batch(df, cols, ["series_id", "time"]) == 2
    with pytest.raises(DataContractError, match="missing columns: nope"):
        project.select_contract(df, ["nope"])
    with pytest.raises(DataContractError, match="columns differ"):
        validate_batch(df, cols[::-1], ["time"])
    with pytest.raises(DataContractError, match="empty"):
        validate_batch(df.where("false"), cols, ["time"])
    with pytest.raises(DataContractError, match="missing values"):
        validate_batch(hourly([("a", 0, None)]), cols, ["time"])
    with pytest.raises(DataContractError, match="repeated keys"):
        validate_batch(df, cols, ["series_id"])
    with pytest.raises(DataContractError, match="expected 72 rows"):
        validate_batch(df, cols, ["time"], (("series_id",), 72))
    with pytest.raises(DataContractError):
        non_empty(df.where("false"), "nothing there")
    with pytest.raises(DataContractError):
        same_order(["a", "b"], ["b", "a"])


def test_future_weather_must_match_once(spark, hourly):
    latest = hourly([("a", 0, 1)])
    rows = joins.expand_horizons(latest, 3)
    assert joins.attach_future_weather(rows, hourly([("a", h, h) for h in (1, 2, 3)], "t")).count() == 3
    with pytest.raises(DataContractError, match="0 rows"):
        joins.attach_future_weather(rows, hourly([("a", h, h) for h in (1, 3)], "t"))
    with pytest.raises(DataContractError, match="2 rows"):
        joins.attach_future_weather(rows, hourly([("a", h, h) for h in (1, 2, 2, 3)], "t"))
    with pytest.raises(DataContractError, match="missing"):
        joins.require_keys(rows.selectExpr("forecast_time AS time"), hourly([("a", 1, 1)]), ["time"])


def test_contract_sizes():
    assert len(sch.FEATURE_COLUMNS) == 72 and len(sch.MODEL_COLUMNS) == 85
    assert len(sch.SHORT_FEATURES) == 39 and len(sch.LONG_FEATURES) == 32
    assert len(sch.ALL_FEATURES_72H) == 88 and len(sch.REDUCED_FEATURES_72H) == 57
    assert sch.FEATURE_COLUMNS[0] == "time" and sch.FEATURE_COLUMNS[-1] == "aqi_std_72h"
    from tidemark.plans.features import FEATURE_SETS
    assert {k: len(v) for k, v in FEATURE_SETS.items()} == {
        "original_features": 39, "cyclical_replacement": 43, "original_plus_cyclical": 47}


def test_plan_chunks(spark):
    from tidemark.sources.files import plan_chunks
    df = spark.sql("SELECT DATE'2024-01-01' AS start_date, DATE'2024-03-10' AS end_date")
    got = [tuple(str(v) for v in r) for r in plan_chunks(df).select("chunk_start", "chunk_end").collect()]
    assert got == [("2024-01-01", "2024-01-30"), ("2024-01-31", "2024-02-29"), ("2024-03-01", "2024-03-10")]


def test_observation_counts_without_a_pass(spark, hourly):
    df, watch = agg.observe_rows(hourly([("a", 0, 1), ("a", 1, 2)]), "loaded")
    df.write.format("noop").mode("overwrite").save()
    assert watch.get == {"rows": 2, "columns": 3}


def test_shuffle_is_repeatable(hourly):
    df = hourly([("a", h, h) for h in range(50)])
    a = [r["us_aqi"] for r in project.shuffle_rows(df, ["series_id", "time"]).collect()]
    b = [r["us_aqi"] for r in project.shuffle_rows(df.repartition(3), ["series_id", "time"]).collect()]
    assert a == b and sorted(a) == [float(h) for h in range(50)] and a != sorted(a)

