import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, T0
from tidemark.catalog import QUERIES
from tidemark.operators import dense, keyed, rolling
from tidemark.operators.series import Series, over_series
from tidemark.schemas import KEY, TIME

SCHEMA = "series_id string, time timestamp_ntz, us_aqi double, pm2_5 double, pm10 double"


def as_windows(df, series, fill):
    levels, back = rolling.history_levels()
    return over_series(keyed.densify(df, series).na.fill(fill, ["us_aqi", "pm2_5", "pm10"]), series.using("dense"), back, 0, levels)


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


@pytest.mark.parametrize("chunk,block", [(200, 64), (500, 1 << 15), (8192, 1 << 15)])
def test_known_rows_give_the_block_of_the_spine(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(dense, "BLOCK_STEPS", block)
    r = random.Random(chunk)

    def row(key, hours, minute=0, value=None):
        at = T0 + dt.timedelta(hours=hours, minutes=minute)
        return (key, at, *(value or (r.uniform(-9, 9) * 10 ** r.randint(0, 9), r.choice([None, float("nan"), 2.5]), float(r.randint(0, 9)))))

    data = [row(f"s{s}", h) for s in range(6) for h in sorted(r.sample(range(r.choice([30, 900])), 25))]
    data += [row("far", 0), row("far", 3000), row("one", 5), row("half", 1, 30), row("half", 400, 30), row("half", 7),
             row("frac", 0), ("frac", T0 + dt.timedelta(hours=2, microseconds=5), 1.0, 1.0, 1.0), row("frac", 3),
             row(None, 0), row(None, 4), ("none", None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    series = Series(chunk_steps=chunk)
    got = dense.dense_history(df, series, 0.5)
    want = as_windows(df, series, 0.5).select(got.columns)
    assert want.dtypes == got.dtypes and len(got.columns) == 54
    assert rows(got, got.columns) == rows(want, got.columns)


def test_input_batches_cut_chunks_anywhere(spark):
    df = spark.range(900).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias(KEY), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, int(id * 2))").alias(TIME),
        F.col("id").cast("double").alias("us_aqi"), F.lit(1.0).alias("pm2_5"), F.lit(2.0).alias("pm10"))
    want = rows(as_windows(df, Series(chunk_steps=300), 0.0), [KEY, TIME, "us_aqi", "aqi_lag_168h", "aqi_std_72h"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows(dense.dense_history(df, Series(chunk_steps=300)), [KEY, TIME, "us_aqi", "aqi_lag_168h", "aqi_std_72h"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_user_history_shuffles_known_rows_only(spark):
    plan = QUERIES["d_user_history"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("REPARTITION_BY_NUM") == 1
