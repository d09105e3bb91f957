import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.conftest import T0
from tidemark.operators import keyed
from tidemark.operators.errors import DataContractError
from tidemark.operators.guards import assert_regular
from tidemark.operators.joins import lookup_at_offset
from tidemark.operators.rolling import changes, lags, leads, rolling_mean, rolling_std, window_recipe
from tidemark.operators.series import HOURLY, Series, row_index
from tidemark.plans.features import wide_targets


def by_key(df, column):
    return {(r["series_id"], r["time"]): r[column] for r in df.collect()}


def at(h):
    return T0 + dt.timedelta(hours=h)


def test_full_window_only(hourly):
    df = hourly([("a", i, i + 1) for i in range(30)])
    got = by_key(rolling_mean(df, ["us_aqi"], [24], HOURLY), "aqi_mean_24h")
    assert [got["a", at(i)] for i in range(23)] == [None] * 23
    assert got["a", at(23)] == 12.5


def test_null_inside_window_gives_null(hourly):
    df = hourly([("a", i, None if i == 10 else i) for i in range(30)])
    got = by_key(rolling_mean(df, ["us_aqi"], [3], HOURLY), "aqi_mean_3h")
    assert got["a", at(9)] == 8.0
    assert [got["a", at(i)] for i in (10, 11, 12)] == [None] * 3
    assert got["a", at(13)] == 12.0


@pytest.mark.parametrize("mode", ["dense", "rows", "time"])
@pytest.mark.parametrize("chunk", [50, 8192])
def test_every_mode_equals_brute_force(hourly, mode, chunk):
    rng = random.Random(7)
    hours = [h for h in range(400) if mode == "dense" or rng.random() > 0.02]
    values = {h: rng.uniform(0, 300) for h in hours}
    df = hourly([("a", h, values[h]) for h in hours])
    series = Series(mode=mode, chunk_steps=chunk)
    got_mean = by_key(rolling_mean(df, ["us_aqi"], [7, 24], series), "aqi_mean_24h")
    got_std = by_key(rolling_std(df, "us_aqi", [24], series), "aqi_std_24h")
    got_lag = by_key(lags(df, "us_aqi", [48], series), "aqi_lag_48h")
    got_change = by_key(changes(df, "us_aqi", [3], series), "aqi_change_3h")
    got_lead = by_key(leads(df, {"later": "us_aqi"}, 30, series), "later")

    def back(i, k):
        if mode == "time":
            return values.get(hours[i] - k)
        return values[hours[i - k]] if 0 <= i - k < len(hours) else None

    for i, h in enumerate(hours):
        key = ("a", at(h))
        window = [back(i, k) for k in range(24)]
        if None in window:
            assert got_mean[key] is None and got_std[key] is None
        else:
            assert got_mean[key] == pytest.approx(statistics.fmean(window), abs=1e-9)
            assert got_std[key] == pytest.approx(statistics.stdev(window), abs=1e-9)
        assert got_lag[key] == back(i, 48)
        prev = back(i, 3)
        assert got_change[key] == (None if prev is None else values[h] - prev)
        assert got_lead[key] == back(i, -30)


def test_spread_is_stable_far_from_zero(hourly):
    df = hourly([("a", i, 1e9 + i % 5) for i in range(100)])
    got = by_key(rolling_std(df, "us_aqi", [72], HOURLY), "aqi_std_72h")
    window = [1e9 + i % 5 for i in range(28, 100)]
    assert got["a", at(99)] == pytest.approx(statistics.stdev(window), rel=1e-9)


@pytest.mark.parametrize("windows", [[3, 6, 12, 24, 48, 72], [7, 30], [1, 2, 5], [365], [11, 13, 168]])
def test_recipe_parts_tile_the_window(windows):
    recipe = window_recipe(windows)
    for n, (level, parts) in recipe.items():
        covered = sorted(x for d, k in parts for x in range(k, k + d))
        assert covered == list(range(n))
        assert all(recipe[d][0] < level for d, _ in parts if n > 1)


def test_row_index_and_total(hourly):
    df = hourly([("a", h, h) for h in (0, 1, 5, 900, 901)] + [("b", 3, 0)])
    rows = row_index(df, Series(chunk_steps=10), "i", "n").collect()
    assert sorted((r["series_id"], r["us_aqi"], r["i"], r["n"]) for r in rows) == [
        ("a", 0.0, 0, 5), ("a", 1.0, 1, 5), ("a", 5.0, 2, 5), ("a", 900.0, 3, 5), ("a", 901.0, 4, 5), ("b", 0.0, 0, 1)]


def test_gap_rows_and_lookup(hourly):
    df = hourly([("a", h, h) for h in (0, 1, 3)])
    gaps = keyed.time_gaps(df).collect()
    assert [(g["previous_time"], g["time"], g["gap_steps"]) for g in gaps] == [(at(1), at(3), 2.0)]
    with pytest.raises(DataContractError, match="steps are missing"):
        assert_regular(df)
    with pytest.warns(UserWarning):
        assert assert_regular(df, policy="warn") is False
    assert by_key(lags(df, "us_aqi", [1], HOURLY.using("rows")), "aqi_lag_1h")["a", at(3)] == 1.0
    assert by_key(lags(df, "us_aqi", [1], HOURLY.using("time")), "aqi_lag_1h")["a", at(3)] is None
    assert by_key(lookup_at_offset(df, "us_aqi", [2]), "value_at_2h") == {
        ("a", at(0)): None, ("a", at(1)): 3.0, ("a", at(3)): None}


def test_gap_longer_than_a_chunk(hourly):
    df = hourly([("a", 0, 1), ("a", 50_000, 2)])
    (gap,) = keyed.time_gaps(df).collect()
    assert gap["gap_steps"] == 50_000.0


def test_label_equals_later_value(hourly):
    df = hourly([("a", i, i) for i in range(100)])
    got = {r["time"]: r for r in wide_targets(df, 72).collect()}
    assert len(got) == 28
    for t, row in got.items():
        h = (t - T0).total_seconds() / 3600
        assert [row[f"aqi_target_{k}h"] for k in range(1, 73)] == [h + k for k in range(1, 73)]


def test_grid_and_missing(hourly):
    df = hourly([("a", h, h) for h in (0, 1, 4)] + [("b", 2, 2)])
    small = Series(chunk_steps=2)
    grid = keyed.own_grid(df, small).collect()
    assert sorted((r["series_id"], r["time"]) for r in grid) == [("a", at(h)) for h in range(5)] + [("b", at(2))]
    assert sorted(r["time"] for r in keyed.missing_steps(df, small).collect()) == [at(2), at(3)]


def test_dedup_last_and_extremes(spark, hourly):
    rows = [("a", at(0), 1.0, 1), ("a", at(0), 2.0, 2), ("a", at(1), 2.0, 1)]
    df = spark.createDataFrame(rows, "series_id string, time timestamp_ntz, us_aqi double, ingest_seq long")
    kept = keyed.dedup_last(df, ["series_id", "time"], ["ingest_seq"])
    assert sorted((r["time"], r["us_aqi"]) for r in kept.collect()) == [(at(0), 2.0), (at(1), 2.0)]
    assert keyed.extreme_row(kept, "us_aqi", True).first()["time"] == at(0)  # earliest on ties
    assert keyed.latest_row(kept).first()["time"] == at(1)


def test_hot_keys_are_reduced_before_the_shuffle(hourly):
    df = hourly([("a", 0, 1)])
    plan = keyed.dedup_last(df, ["series_id", "time"], ["us_aqi"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_all_history_on_one_shuffle(hourly):
    from tidemark.operators.rolling import history_levels
    from tidemark.operators.series import over_series
    df = hourly([("a", i, i) for i in range(10)]).selectExpr("*", "us_aqi AS pm2_5", "us_aqi AS pm10")
    levels, back = history_levels()
    plan = over_series(df, HOURLY, back, 0, levels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


@pytest.mark.parametrize("chunk", [10, 100, 8192])
def test_default_labels_with_a_hole_are_exact_hours(hourly, chunk):
    hours = [h for h in range(300) if h != 120]
    df = hourly([("a", h, h) for h in hours])
    got = {r["time"]: [r[f"aqi_target_{k}h"] for k in (1, 2, 3)]
           for r in wide_targets(df, 3, Series(chunk_steps=chunk)).collect()}
    want = {at(h): [h + 1, h + 2, h + 3] for h in hours if all(h + k in hours for k in (1, 2, 3))}
    assert got == want and wide_targets(df, 3).count() == len(want)


def test_null_keys_are_a_series_and_null_times_raise(hourly):
    df = hourly([(s, h, h) for s in ("a", None) for h in range(5)])
    got = sorted((str(r["series_id"]), r["time"], r["_pos"]) for r in row_index(df, Series(chunk_steps=2)).collect())
    assert got == sorted((s, at(h), h) for s in ("a", "None") for h in range(5))
    broken = df.withColumn("time", F.when(F.col("us_aqi") != 3, F.col("time")))
    for act in (lambda: row_index(broken).collect(), lambda: lags(broken, "us_aqi", [1], HOURLY).collect()):
        with pytest.raises(Exception, match="must not be NULL"):
            act()
