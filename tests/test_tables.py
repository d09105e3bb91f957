import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import T0
from tidemark.operators.errors import ConcurrentWriteError, DataContractError
from tidemark.operators.project import cast_schema
from tidemark.plans import features as f
from tidemark.plans import incremental as inc
from tidemark.schemas import KEY, POLLUTANTS, TIME, WEATHER, feature_types
from tidemark.session import scratch_path
from tidemark.sources.files import (
    read_csv, read_hourly_json, write_csv, write_forecast, write_hourly_json,
)
from tidemark.sources import tables
from tidemark.sources.tables import _fs_list, create_table, table_meta
from tidemark.streaming import jobs

KEYS = (KEY, TIME)


def at(h):
    return T0 + dt.timedelta(hours=h)


def sources(spark, hours, series=("a", "b"), bump=None):
    """Two sources with pseudo-random values; ``bump`` changes one hour of every series."""
    def frame(names, salt):
        rows = []
        for s in series:
            for h in range(hours):
                rng = random.Random(f"{s}{h}{salt}{h if h == bump else ''}{'x' if h == bump else ''}")
                rows.append((s, at(h), *[float(rng.randrange(1000)) for _ in names]))
        return spark.createDataFrame(rows, f"{KEY} string, {TIME} timestamp_ntz, " + ", ".join(f"{n} double" for n in names))
    return frame(POLLUTANTS, "p"), frame(WEATHER, "w")


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def rebuilt(air, weather):
    return cast_schema(f.engineer_features(air, weather), feature_types())


def new_table(spark, name="t", keys=KEYS):
    return create_table(spark, scratch_path(spark, "tables"), name, 1, keys, TIME)


def test_upsert_inserts_replaces_and_is_idempotent(spark, hourly):
    t = new_table(spark)
    t.upsert(hourly([("a", h, h) for h in range(100)]))
    second = hourly([("a", h, -h) for h in range(80, 120)])
    assert t.upsert(second) == 2  # hours 80-119 touch two days
    once = rows_of(t.read())
    assert len(once) == 120 and sum(1 for r in once if r[2] < 0) == 40
    t.upsert(second)
    assert rows_of(t.read()) == once
    assert rows_of(t.read(["us_aqi"], since=str(at(110)))) == [(-float(h),) for h in range(119, 109, -1)]


def test_order_column_keeps_the_newest(spark, hourly):
    t = new_table(spark)
    row = lambda seq, v: hourly([("a", 0, v)]).withColumn("seq", F.lit(seq))
    t.upsert(row(2, 20), "seq")
    t.upsert(row(1, 10), "seq")
    assert t.read().first()["us_aqi"] == 20.0
    t.upsert(row(3, 30).unionByName(row(4, 40)), "seq")
    assert t.read().first()["us_aqi"] == 40.0


def test_a_stopped_upsert_changes_nothing(spark, hourly, monkeypatch):
    t = new_table(spark)
    t.upsert(hourly([("a", h, h) for h in range(48)]))
    before, files = rows_of(t.read()), set(_fs_list(spark, t.data))

    def stop(*args):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(type(t), "_publish", stop)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(hourly([("a", h, 7) for h in range(24)]))
    assert rows_of(t.read()) == before and set(_fs_list(spark, t.data)) == files
    t.upsert(hourly([("a", 0, 9)]))
    assert len(rows_of(t.read())) == 48 and t.read().where("us_aqi = 9").count() == 2


def test_a_reader_keeps_its_snapshot(spark, hourly):
    t = new_table(spark)
    t.upsert(hourly([("a", h, h) for h in range(48)]))
    opened = t.read()
    t.upsert(hourly([("a", h, -1) for h in range(72)]))
    assert opened.count() == 48 and opened.where("us_aqi = -1").count() == 0
    assert t.read().where("us_aqi = -1").count() == 72 and t.read(as_of=1).count() == 48
    assert t.expire(keep=1) == 0  # young files stay
    assert t.expire(keep=1, hours=-1) == 1  # the first commit; the marks of both still add up
    assert t.read().count() == 72
    with pytest.raises(DataContractError):
        t.read(as_of=1)


def test_of_two_writers_one_fails(spark, hourly, monkeypatch):
    t = new_table(spark)
    t.upsert(hourly([("a", 1, 1)]))
    real = type(t)._publish

    def late(self, *args):
        monkeypatch.setattr(type(t), "_publish", real)
        t.upsert(hourly([("a", 2, 2)]))  # another writer is faster
        return real(self, *args)
    monkeypatch.setattr(type(t), "_publish", late)
    with pytest.raises(ConcurrentWriteError):
        t.upsert(hourly([("a", 3, 3)]))
    assert {r[TIME] for r in t.read().collect()} == {at(1), at(2)}
    t.upsert(hourly([("a", 3, 3)]))
    assert t.read().count() == 3


def test_a_dead_writers_file_is_passed_over(spark, hourly, monkeypatch):
    monkeypatch.setattr(tables, "GRACE_SECONDS", 0)
    t = new_table(spark)
    t.upsert(hourly([("a", 1, 1)]))
    tables._fs_write(spark, f"{t.path}/_snapshots/{2:012d}.json", '{"number": 2, "ba')
    assert t.snapshot().number == 1
    t.upsert(hourly([("a", 2, 2)]))
    assert t.snapshot().number == 3 and t.read().count() == 2


def test_marks_follow_every_upsert(spark, hourly):
    t = new_table(spark)
    r, seen = random.Random(3), {}
    for k in range(12):  # past the point where marks are written as one
        hours = [(r.choice("abc"), r.randint(0, 300)) for _ in range(3)]
        t.upsert(hourly([(s, h, k) for s, h in sorted(set(hours))]))
        for s, h in hours:
            seen.setdefault(s, set()).add(h)
        if k in (0, 8, 11):
            got = {x[KEY]: (x["stored_min"], x["stored_max"]) for x in t.marks().collect()}
            assert got == {s: (at(min(hs)), at(max(hs))) for s, hs in seen.items()}
    assert len(t.snapshot().marks) < 9
    assert "data/commit" not in t.marks()._jdf.queryExecution().executedPlan().toString()


def test_a_batch_of_a_stream_counts_once(spark, hourly):
    t = new_table(spark)
    assert t.upsert(hourly([("a", 1, 1)]), stream=("s", 4)) == 1
    assert t.upsert(hourly([("a", 1, 2)]), stream=("s", 4)) == 0 and t.read().first()["us_aqi"] == 1.0
    assert t.upsert(hourly([("a", 1, 3)]), stream=("s", 5)) == 1 and t.upsert(hourly([("a", 1, 4)]), stream=("other", 0)) == 1
    with pytest.raises(DataContractError, match="columns differ"):
        t.upsert(hourly([("a", 1, 1)], "other"))


def test_scan_prunes_days_and_columns(spark, hourly):
    t = new_table(spark)
    t.upsert(hourly([("a", h, h) for h in range(240)]))
    plan = t.read(["us_aqi"], since=str(at(200)))._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters"):]
    assert "dt" in scan.split("PushedFilters")[0] and "series_id" not in scan.split("ReadSchema")[1]


def test_table_identity(spark):
    t = new_table(spark)
    assert create_table(spark, t.root, "t", 1, KEYS, TIME) == t
    assert table_meta(t).first()["event_time"] == TIME
    with pytest.raises(DataContractError):
        create_table(spark, t.root, "t", 1, (KEY,), TIME)


def test_payload_round_trip_and_errors(spark, hourly):
    path = scratch_path(spark, "json")
    df = hourly([("a", h, None if h == 3 else h) for h in range(1000)])
    write_hourly_json(df, path, ["us_aqi"])
    got = read_hourly_json(spark, path, ["us_aqi"])
    assert got.exceptAll(df).isEmpty() and df.exceptAll(got).isEmpty()
    bad = scratch_path(spark, "json")
    spark.createDataFrame([('{"series_id": "a", "error": true}',)], "value string").write.text(bad)
    with pytest.raises(DataContractError, match="no hourly part"):
        read_hourly_json(spark, bad, ["us_aqi"])


def test_csv_round_trip_and_single_forecast_file(spark, hourly, tmp_path):
    df = hourly([("a", h, None if h == 3 else h) for h in range(50)])
    path = scratch_path(spark, "csv")
    write_csv(df, path)
    got = read_csv(spark, path, df.schema)
    assert got.exceptAll(df).isEmpty() and got.count() == 50
    out = str(tmp_path / "forecast")
    write_forecast(df.withColumnRenamed(TIME, "forecast_time"), out)
    assert len(list((tmp_path / "forecast").glob("*.csv"))) == 1


def test_refresh_plan_edges(spark):
    marks = spark.createDataFrame([("a", dt.datetime(2024, 1, 10, 10))], f"{KEY} string, stored_max timestamp_ntz")
    p = inc.refresh_plan(marks, "2024-01-10 20:34:00").first()
    assert p["latest"] == dt.datetime(2024, 1, 10, 19)
    assert p["next_missing"] == dt.datetime(2024, 1, 10, 11)
    assert p["refresh_start"] == dt.datetime(2024, 1, 8, 20) == p["recompute_from"]
    assert p["fetch_from"] == dt.datetime(2023, 12, 31, 20)
    with pytest.raises(DataContractError):
        inc.require_marks(marks.where("false"))


def test_refresh_equals_rebuild_and_revises_recent_hours(spark):
    air, weather = sources(spark, 330)
    t = new_table(spark, "features")
    t.upsert(rebuilt(air, weather).where(F.col(TIME) <= F.lit(str(at(300))).cast("timestamp_ntz")))
    # an hour inside the last 48 is corrected before the next run
    air2, weather2 = sources(spark, 330, bump=290)
    now = str(at(329) + dt.timedelta(minutes=94))
    report = inc.refresh_features(t, air2, weather2, now).collect()
    assert {(r[KEY], r["new_rows"], r["refreshed_rows"], r["new_max"]) for r in report} == {
        ("a", 29, 19, at(329)), ("b", 29, 19, at(329))}
    fresh = rebuilt(air2, weather2)
    low = F.lit(str(at(282))).cast("timestamp_ntz")
    tail = t.read().where(F.col(TIME) >= low)
    assert tail.exceptAll(fresh.select(*tail.columns)).isEmpty()
    assert tail.count() == 2 * 48 and t.read().count() == fresh.count()
    before = rows_of(t.read([KEY, TIME, "us_aqi", "aqi_mean_72h"]))
    inc.refresh_features(t, air2, weather2, now)
    assert rows_of(t.read([KEY, TIME, "us_aqi", "aqi_mean_72h"])) == before


def test_gaps_stop_the_live_run(spark):
    air, weather = sources(spark, 300, ("a",))
    holed = air.where(F.col(TIME) != F.lit(str(at(280))).cast("timestamp_ntz"))
    t = new_table(spark, "features")
    t.upsert(rebuilt(air, weather).where(F.col(TIME) <= F.lit(str(at(270))).cast("timestamp_ntz")))
    with pytest.raises(DataContractError, match="steps are missing"):
        inc.refresh_features(t, holed, weather, str(at(300)))


def test_mature_labels_arrive_once(spark, hourly):
    t = new_table(spark, "labels")
    feats = hourly([("a", h, h) for h in range(100)])
    assert inc.refresh_targets(t, feats) == 28
    assert inc.refresh_targets(t, feats) == 0
    more = hourly([("a", h, h) for h in range(110)])
    assert inc.refresh_targets(t, more) == 10
    got = t.read().collect()
    assert len(got) == 38
    assert all(r["aqi_target_72h"] == (r[TIME] - T0).total_seconds() / 3600 + 72 for r in got)


def test_ingest_stream_in_several_batches_equals_rebuild(spark):
    """Four landings, the last of which corrects an old hour."""
    air, weather = sources(spark, 260, ("a",))
    corrected, _ = sources(spark, 260, ("a",), bump=100)
    root = scratch_path(spark, "tables")
    stored = [create_table(spark, root, n, 1, KEYS, TIME) for n in ("weather", "air", "features")]
    stored[0].upsert(weather)
    landing = scratch_path(spark, "landing")
    hour = (F.unix_timestamp(F.col(TIME).cast("timestamp")) - F.lit(int((T0 - dt.datetime(1970, 1, 1)).total_seconds()))) / 3600
    checkpoint = scratch_path(spark, "checkpoint")
    for part in (air.where(hour < 200), air.where((hour >= 200) & (hour < 230)), air.where(hour >= 230),
                 corrected.where(hour == 100)):
        part.coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(air.schema).parquet(landing)
        jobs.ingest_features(stream, *stored, checkpoint).awaitTermination()
    want = cast_schema(f.feature_table(f.clean_sources(corrected, weather)), feature_types())
    got = stored[2].read()
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() == 260 - 168


def test_streams_need_utc(spark, hourly):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tashkent")
        with pytest.raises(ValueError):
            jobs.dedup_stream(hourly([("a", 0, 1)]), [KEY, TIME])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_repeated_keys_are_refused_without_an_order(spark, hourly):
    t = new_table(spark, "twice")
    twice = hourly([("a", 1, 1), ("a", 1, 2), ("a", 2, 3)])
    with pytest.raises(DataContractError, match="repeats keys"):
        t.upsert(twice)
    t.upsert(hourly([("a", 1, 1)]))
    with pytest.raises(DataContractError, match="repeats keys"):
        t.upsert(twice)
    assert t.read().count() == 1


def test_arrays_of_unequal_length_are_refused(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"series_id": "a", "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "x": [1, 2, 3]}}')
    with pytest.raises(DataContractError, match="unequal"):
        read_hourly_json(spark, str(tmp_path), ["x"])


def test_late_weather_yields_its_rows_and_leaves_nothing_behind(spark):
    import os

    air, weather = sources(spark, 260)
    root = scratch_path(spark, "late")
    a, w, feats = [create_table(spark, root, n, 1, KEYS, TIME) for n in ("air", "weather", "features")]
    early = F.col(TIME) < F.lit(str(at(200))).cast("timestamp_ntz")

    def land(df, name):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)
    shared = os.path.dirname(root)
    before = set(os.listdir(shared))
    w.upsert(weather.where(early))
    jobs.ingest_features(land(air, "l1"), w, a, feats, scratch_path(spark, "c1")).awaitTermination()
    jobs.ingest_weather(land(weather.where(~early), "l2"), w, a, feats, scratch_path(spark, "c2")).awaitTermination()
    assert rows_of(feats.read()) == rows_of(cast_schema(rebuilt(air, weather), feature_types()))
    assert not [n for n in set(os.listdir(shared)) - before if n.startswith("batch-")]


def test_a_forecast_of_other_than_72_rows_is_not_written(spark):
    rows = [("a", at(0), at(h), h, 50.0 + h, 1.0, 2.0, 3.0, 4.0, "Good") for h in range(1, 73)]
    names = f"{KEY} string, forecast_generated_at timestamp_ntz, forecast_time timestamp_ntz, horizon_hours int, predicted_aqi double, " \
            "forecast_temperature double, forecast_humidity double, forecast_precipitation double, forecast_wind_speed double, aqi_category string"
    t = create_table(spark, scratch_path(spark, "tables"), "forecast", 1, (KEY, "forecast_time"), "forecast_time")
    with pytest.raises(DataContractError, match="expected 72 rows"):
        inc.publish_forecast(t, spark.createDataFrame(rows[:-1], names))
    with pytest.raises(DataContractError, match="missing values"):
        inc.publish_forecast(t, spark.createDataFrame([*rows[:-1], (*rows[-1][:4], None, *rows[-1][5:])], names))
    assert not t.exists()
    inc.publish_forecast(t, spark.createDataFrame(rows, names))
    assert t.read().count() == 72


def test_islands_of_touched_hours(spark, hourly):
    rows = hourly([("a", 0, 1), ("a", 5, 1), ("a", 300, 1), ("a", 2000, 1), ("b", 10, 1), ("c", 7000, 1), ("d", 50, 1)])
    newest = spark.createDataFrame([("a", at(2050)), ("b", at(9000)), ("c", at(100)), ("x", at(5))], f"{KEY} string, stored_max timestamp_ntz")
    got = {tuple(r) for r in inc.touched_intervals(rows, newest).collect()}
    assert got == {("a", at(-192), at(0), at(468)), ("a", at(1808), at(2000), at(2050)), ("b", at(-182), at(10), at(178))}


def test_corrections_far_apart_read_only_their_days(spark, monkeypatch):
    """Two hours 80 days apart: the days between them are neither read nor written."""
    air, weather = sources(spark, 2000, ("a",))
    root = scratch_path(spark, "far")
    a, w, feats = [create_table(spark, root, n, 1, KEYS, TIME) for n in ("air", "weather", "features")]
    a.upsert(air)
    w.upsert(weather)
    feats.upsert(rebuilt(air, weather))
    days = []
    monkeypatch.setattr(jobs, "plan_days", lambda plan, table: days.append(inc.plan_days(plan, table)) or days[-1])
    path = scratch_path(spark, "landed")
    fixed = F.when(F.col(TIME).isin(at(100), at(1990)), F.col("us_aqi") + 5).otherwise(F.col("us_aqi"))
    corrected = air.withColumn("us_aqi", fixed)
    corrected.where(F.col(TIME).isin(at(100), at(1990))).write.parquet(path)
    jobs.ingest_features(spark.readStream.schema(air.schema).parquet(path), w, a, feats, scratch_path(spark, "c")).awaitTermination()
    assert all(len(x) < 30 for x in days) and len(days) == 2  # of 84 days
    want = cast_schema(f.feature_table(f.clean_sources(corrected, weather)), feature_types())
    assert feats.read().exceptAll(want).isEmpty() and feats.read().count() == want.count()
