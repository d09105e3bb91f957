import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import T0
from tidemark.operators import aggregates as agg
from tidemark.operators import keyed
from tidemark.plans import incremental as inc
from tidemark.plans import models as m
from tidemark.plans.reports import drift_report
from tidemark.schemas import KEY, MODEL_BASE_COLUMNS, MODEL_COLUMNS, TIME, WEATHER, target_name
from tidemark.session import scratch_path
from tidemark.sources.tables import create_table
from tidemark.streaming import jobs


def at(h):
    return T0 + dt.timedelta(hours=h)


def test_labels_follow_late_and_corrected_values(spark, hourly):
    """Values land in three batches, an early hole is filled late, and one hour is corrected."""
    root, path, checkpoint = scratch_path(spark, "t"), scratch_path(spark, "landed"), scratch_path(spark, "c")
    values, wide = [create_table(spark, root, n, 1, (KEY, TIME), TIME) for n in ("values", "wide")]
    long_ = create_table(spark, root, "long", 1, (KEY, TIME, "horizon"), TIME)
    want = {h: float(h) for h in range(90)}
    batches = [[h for h in range(60) if h != 7], list(range(60, 90)), [7], [40]]
    for k, hours in enumerate(batches):
        part = hourly([("a", h, 1000 + h if k == 3 else h) for h in hours]).withColumn("seq", F.lit(k))
        part.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(part.schema).parquet(path)
        jobs.label_tables(stream, long_, wide, values, checkpoint, "seq").awaitTermination()
        if k == 1:
            assert {r[TIME] for r in wide.read().collect()} == {at(h) for h in range(7, 18) if h != 7}
    want[40] = 1040.0
    got = {(r[TIME], r["horizon"]): r["target"] for r in long_.read().collect()}
    assert got == {(at(h), j): want[h + j] for h in range(90) for j in range(1, 73) if h + j < 90}
    rows = {r[TIME]: r for r in wide.read().collect()}
    assert set(rows) == {at(h) for h in range(18)}
    assert all(r[target_name(j)] == want[int((t - T0).total_seconds() // 3600) + j] for t, r in rows.items() for j in (1, 22, 33, 72))


def test_a_forecast_batch_counts_once_and_late_rows_bring_nothing_back(spark):
    def rows(hours):
        return spark.createDataFrame([("a", at(h), *[float(h)] * len(MODEL_BASE_COLUMNS)) for h in hours],
                                     f"{KEY} string, {TIME} timestamp_ntz, " + ", ".join(f"{c} double" for c in MODEL_BASE_COLUMNS))
    weather = spark.createDataFrame([("a", at(h), *[1.0] * len(WEATHER)) for h in range(200)],
                                    f"{KEY} string, {TIME} timestamp_ntz, " + ", ".join(f"{c} double" for c in WEATHER))
    models = {h: m.LinearModel(("us_aqi",), (1.0,), float(h), (0.0,)) for h in range(1, 73)}
    path, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "c")
    table = create_table(spark, scratch_path(spark, "t"), "forecast", 1, (KEY, "forecast_time"), "forecast_time")
    for hours in ([0, 1], [5], [3]):
        rows(hours).coalesce(1).write.mode("append").parquet(path)
        jobs.forecast_stream(spark.readStream.schema(rows([0]).schema).parquet(path), weather, models, MODEL_COLUMNS, table, checkpoint,
                             name="f").awaitTermination()
    got = {r["forecast_time"]: (r["forecast_generated_at"], r["predicted_aqi"]) for r in table.read().collect()}
    assert got == {at(h): (at(1), 1.0 + h - 1) for h in range(2, 6)} | {at(5 + h): (at(5), 5.0 + h) for h in range(1, 73)}
    before = table.snapshot().number
    jobs.forecast_stream(spark.readStream.schema(rows([0]).schema).parquet(path), weather, models, MODEL_COLUMNS, table,
                         scratch_path(spark, "again"), name="f").awaitTermination()  # the same batches under the same name
    assert table.snapshot().number == before


def test_drift_against_direct_sums(spark):
    r = np.random.default_rng(1)
    first, second = r.normal(0, 1, 400), r.normal(0.7, 2, 300)
    data = [("old", float(v)) for v in first] + [("new", float(v)) for v in second] + [("new", None), ("new", math.nan)]
    got = {x.period: x for x in drift_report(spark.createDataFrame(data, "p string, v double"), ["v"], F.col("p"), F.col("p") == "old").collect()}
    edges = np.quantile(first, np.arange(1, 10) / 10)
    p, q = (np.bincount(np.searchsorted(edges, v), minlength=10) / len(v) for v in (second, first))
    assert got["new"]["rows"] == 300 and got["old"]["psi"] == pytest.approx(0.0) and got["old"]["ks"] == pytest.approx(0.0)
    assert got["new"]["psi"] == pytest.approx(((np.maximum(p, 1e-4) - np.maximum(q, 1e-4)) * np.log(np.maximum(p, 1e-4) / np.maximum(q, 1e-4))).sum())
    assert got["new"]["ks"] == pytest.approx(np.abs(np.cumsum(p) - np.cumsum(q)).max())


def test_correlations_with_and_without_gaps(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 2))
    rows = [(float(a), float(b + a), 3.0, None if k % 7 == 0 else float(b)) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, k double, g double")
    whole = {(t.left, t.right): t.correlation for t in agg.correlations(df, [("a", "b"), ("a", "k")]).collect()}
    assert whole["a", "b"] == pytest.approx(np.corrcoef(x[:, 0], x.sum(1))[0, 1]) and whole["a", "k"] is None
    known = [v for v in rows if v[3] is not None]
    gaps = agg.correlations(df, [("a", "g")]).first().correlation
    assert gaps == pytest.approx(np.corrcoef([v[0] for v in known], [v[3] for v in known])[0, 1])
    assert agg.correlations(df.where("false"), [("a", "b")]).count() == 1


def test_extremes_of_ties_nulls_and_null_keys(spark):
    rows = [("x", 1, 5.0), ("x", 2, 5.0), ("x", 3, None), ("x", 4, math.nan), (None, 1, 2.0), (None, 9, 1.0), ("z", 1, None)]
    df = spark.createDataFrame([(k, at(t), v) for k, t, v in rows], f"{KEY} string, {TIME} timestamp_ntz, v double")
    high = {r[KEY]: r[TIME] for r in keyed.extreme_row(df, "v", True, (KEY,)).collect()}
    assert high == {"x": at(1), None: at(1)} and keyed.extreme_row(df, "v", False).first()[TIME] == at(9)
    assert {r[KEY]: r[TIME] for r in keyed.latest_row(df).collect()} == {"x": at(4), None: at(9), "z": at(1)}
    assert "SortAggregate" not in keyed.latest_row(df)._jdf.queryExecution().optimizedPlan().toString()


def test_refreshed_targets_read_no_history_for_their_marks(spark, hourly):
    feats, labels = [create_table(spark, scratch_path(spark, "t"), n, 1, (KEY, TIME), TIME) for n in ("f", "l")]
    feats.upsert(hourly([("a", h, h) for h in range(200)]))
    assert inc.refresh_targets(labels, feats) == 128
    feats.upsert(hourly([("a", h, h) for h in range(200, 210)]))
    assert inc.refresh_targets(labels, feats) == 10 and inc.refresh_targets(labels, feats) == 0
    assert labels.read().count() == 138
