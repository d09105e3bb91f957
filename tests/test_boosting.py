import datetime as dt
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import T0
from tidemark.operators.errors import DataContractError
from tidemark.plans import boosting as b
from tidemark.plans import horizons as hz
from tidemark.plans import models as m
from tidemark.plans import registry as reg
from tidemark.plans import retraining as rt
from tidemark.schemas import KEY, TIME, WEATHER, target_name
from tidemark.session import scratch_path

PLAIN = b.Boosting(rounds=3, rate=0.5, depth=2, least_rows=5, rows=1.0, columns=1.0, l1=1.0, l2=2.0)
INPUTS = ["us_aqi", "pm10", "future_temperature", "target_hour"]


@pytest.fixture(scope="module")
def rows(spark):
    r, out = random.Random(7), []
    for h in range(260):
        if h % 37 == 5:
            continue  # a missing hour
        pm10 = float(r.randrange(12))
        value = 50.0 + 20 * (pm10 > 5) + 15 * (h % 24 > 12) + 30 * (pm10 > 9 and h % 24 > 18) + r.gauss(0, 3)
        out.append(("s", T0 + dt.timedelta(hours=h), round(value, 1), pm10, *[float(r.randrange(10)) for _ in WEATHER]))
    return spark.createDataFrame(out, f"{KEY} string, {TIME} timestamp_ntz, us_aqi double, pm10 double, " + ", ".join(f"{w} double" for w in WEATHER)).cache()


@pytest.fixture(scope="module")
def store(spark, rows):
    path = scratch_path(spark, "store")
    hz.horizon_store(rows, 3, keep=["us_aqi", "pm10"]).write.parquet(path)
    return spark.read.parquet(path)


def pairs(rows, h):
    """(inputs, target) of one horizon, straight from the rows."""
    by = {r[TIME]: r for r in rows.collect()}
    x, y = [], []
    for t, r in sorted(by.items()):
        later = by.get(t + dt.timedelta(hours=h))
        if later:
            x.append([r["us_aqi"], r["pm10"], later["temperature_2m"], float((t + dt.timedelta(hours=h)).hour)])
            y.append(later["us_aqi"])
    return np.array(x), np.array(y)


def gain_of(g, spec):
    return max(abs(g.sum()) - spec.l1, 0) ** 2 / (len(g) + spec.l2)


def split_of(x, g, edges, spec):
    best = None
    for f in range(x.shape[1]):
        for cut in edges[f][:]:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < spec.least_rows:
                continue
            gain = gain_of(g[left], spec) + gain_of(g[~left], spec) - gain_of(g, spec)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, cut)
    return best


def brute(x, y, edges, spec):
    """Plain boosting, a tree at a time, best leaf first."""
    made = np.full(len(y), y.mean())
    for _ in range(spec.rounds):
        g, leaves = made - y, [(np.arange(len(y)), 0)]
        while not spec.leaves or len(leaves) < spec.leaves:
            found = [(split_of(x[i], g[i], edges, spec), k) for k, (i, d) in enumerate(leaves) if d < spec.depth and len(i) >= 2 * spec.least_rows]
            found = [(s, k) for s, k in found if s]
            if not found:
                break
            (_, f, cut), k = max(found, key=lambda v: v[0][0])
            i, d = leaves.pop(k)
            below = x[i, f] <= cut
            leaves += [(i[below], d + 1), (i[~below], d + 1)]
        for i, _ in leaves:
            s = g[i].sum()
            made[i] -= spec.rate * np.sign(s) * max(abs(s) - spec.l1, 0) / (len(i) + spec.l2)
    return made


@pytest.mark.parametrize("spec", [PLAIN, replace(PLAIN, depth=9, leaves=4), replace(PLAIN, rounds=1, depth=9, leaves=6, l1=0.0)])
def test_trees_equal_plain_boosting(rows, store, spec):
    models = b.fit_boosted(store, [1, 3], spec, INPUTS, blocks=2)
    base, every = b._base_of(store, INPUTS)
    edges = b._edges(store, base, spec.bins)
    edges = [edges[k] for k in b._places(base, INPUTS)]
    got = {(r[TIME], r.horizon): r for r in b.score_store(store, models).collect()}
    for h in (1, 3):
        x, y = pairs(rows, h)
        want = brute(x, y, edges, spec)
        mine = [got[t] for t in sorted(k for k in got if k[1] == h)]
        assert [r.target for r in mine] == pytest.approx(y.tolist())
        assert [r.prediction for r in mine] == pytest.approx(want.tolist(), abs=1e-9)


def test_best_first_and_level_by_level_differ(rows, store):
    level = b.fit_boosted(store, [1], replace(PLAIN, rounds=1), INPUTS)[1]
    best = b.fit_boosted(store, [1], replace(PLAIN, rounds=1, depth=9, leaves=4), INPUTS)[1]
    count = lambda t: sum(f < 0 for f in t.feature)
    assert count(level.trees[0]) == count(best.trees[0]) == 4 and level.trees != best.trees


def test_stops_early_and_draws_alike(store):
    spec = replace(b.HISTOGRAM, rounds=60, rate=0.3, least_rows=5, held_out=0.3, patience=4, columns=0.5, rows=0.8)
    one, two = (b.fit_boosted(store, [2], spec, INPUTS, blocks=k)[2] for k in (1, 3))
    assert 0 < len(one.trees) < 50 and len(one.losses) < 60
    assert len(one.trees) == len(two.trees) and one.losses == pytest.approx(two.losses)  # whatever the partitions
    assert one.losses[len(one.trees)] == min(one.losses)


def test_checkpoints_and_shuffled_sums_change_nothing(store, monkeypatch):
    want = b.fit_boosted(store, [1, 2], replace(PLAIN, rounds=5, rows=0.7, columns=0.6), INPUTS, blocks=2)
    monkeypatch.setattr(b, "EPOCH", 2)
    monkeypatch.setattr(b, "DRIVER_BYTES", 0)
    got = b.fit_boosted(store, [1, 2], replace(PLAIN, rounds=5, rows=0.7, columns=0.6), INPUTS, blocks=2)
    for h in want:
        assert [t.feature for t in got[h].trees] == [t.feature for t in want[h].trees]
        assert [v for t in got[h].trees for v in t.value] == pytest.approx([v for t in want[h].trees for v in t.value])


def test_a_fit_reads_the_store_without_an_exchange(store):
    plan = b._scan(store, ["us_aqi", "pm10"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert "Exchange" not in hz.long_of(store, ["us_aqi"])._jdf.queryExecution().executedPlan().toString()


def test_no_rows_for_a_horizon(store):
    with pytest.raises(DataContractError, match=r"\[9\]"):
        b.fit_boosted(store, [1, 9], replace(PLAIN, rounds=1), INPUTS)


def test_store_holds_exact_hours_and_labels(spark, rows):
    long_ = {(r[TIME], r.horizon): r for r in hz.horizon_long(rows, [1, 3], keep=["pm10"]).collect()}
    by = {r[TIME]: r for r in rows.collect()}
    want = {(t, h) for t in by for h in (1, 3) if t + dt.timedelta(hours=h) in by}
    assert set(long_) == want
    assert all(r.target == by[t + dt.timedelta(hours=h)]["us_aqi"] and r.future_cloud_cover == by[t + dt.timedelta(hours=h)]["cloud_cover"]
               for (t, h), r in long_.items())
    labelled = rows.withColumns({target_name(h): F.lit(float(h)) for h in (1, 2, 3)})
    ahead = hz.horizon_store(labelled, 3, keep=["pm10"]).select(F.explode("ahead").alias("x")).select("x.*")
    assert ahead.where("target <> horizon").isEmpty() and ahead.count() > 600


# -- the retraining job ------------------------------------------------------------------------
@pytest.fixture(scope="module")
def joined(spark):
    r = random.Random(1)
    rows = [("s", T0 + dt.timedelta(hours=h), r.gauss(50, 9), r.gauss(5, 2)) for h in range(90)]
    features = spark.createDataFrame(rows, f"{KEY} string, {TIME} timestamp_ntz, us_aqi double, pm10 double").withColumns(
        {w: F.lit(1.0) for w in WEATHER})
    labels = features.select(KEY, TIME, *[(F.col("us_aqi") * h + F.col("pm10")).alias(target_name(h)) for h in range(1, 73)])
    return features.cache(), labels.cache()


def test_a_stopped_retraining_goes_on(spark, joined):
    job, root, fitted = scratch_path(spark, "job"), scratch_path(spark, "models"), []
    whole = rt.ridge_learner(["us_aqi", "pm10"])

    def fit(training, horizons):
        if len(fitted) == 40:
            raise KeyboardInterrupt
        fitted.extend(horizons)
        return whole.fit(training, horizons)
    stopping = replace(whole, fit=fit)
    with pytest.raises(KeyboardInterrupt):
        rt.retrain(job, *joined, stopping, root)
    assert rt.committed(spark, job, 72) == list(range(1, 41))
    again = []
    going = replace(whole, fit=lambda t, hs: again.extend(hs) or whole.fit(t, hs))
    version, promotion = rt.retrain(job, *joined, going, root)
    assert version == 1 and again == list(range(41, 73)) and promotion.first()["promote"] is True
    assert rt.retrain(job, *joined, going, root)[0] == 1 and len(again) == 32  # a finished job fits nothing
    _, models, _ = reg.load_latest_models(spark, root, ["us_aqi", "pm10"])
    straight = m.ridge_by_horizon(rt.training_data(job, *joined).rows, ["us_aqi", "pm10"], [1, 72])
    assert models[1].coefficients == pytest.approx(straight[1].coefficients) and models[72].intercept == pytest.approx(straight[72].intercept)
    assert reg.horizon_metrics(spark, root, 1, 72).first()["training_rows"] == 72  # 80 % of 90


def test_boosted_models_are_registered_and_score_in_one_pass(spark, store):
    spec = replace(PLAIN, rounds=2)
    models = b.fit_boosted(store, [1, 2], spec, INPUTS)
    inputs = store.limit(5).select("us_aqi", "pm10", F.lit(4.0).alias("future_temperature"), F.lit(7).alias("target_hour"),
                                   F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("horizon_hours"))
    root = scratch_path(spark, "models")
    metrics = spark.createDataFrame([(h, 1.0, 1.0, 0.5) for h in (1, 2)], "forecast_horizon_hours int, mae double, rmse double, r2 double")
    reg.register_models(spark, root, models, INPUTS, metrics, {}, 2)
    _, loaded, _ = reg.load_latest_models(spark, root, INPUTS)
    assert loaded == models
    got = b.score_rows(inputs, loaded).collect()
    assert len(got) == 10
    for r in got:
        x = np.array([[r["us_aqi"], r["pm10"], 4.0, 7.0]])
        assert r["prediction"] == pytest.approx(models[r["horizon_hours"]].predict(x)[0])
