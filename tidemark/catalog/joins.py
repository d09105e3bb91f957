"""Queries for joins (C) and set operations (G)."""

from pyspark.sql import functions as F

from tidemark.catalog.frames import (
    air, hourly_all, hourly_by_type, redelivered, weather, with_frames,
)
from tidemark.catalog.registry import query
from tidemark.catalog.sqltext import lead_sql
from tidemark.catalog.windows import ROWS
from tidemark.functions.calendar import add_hours
from tidemark.operators import joins, keyed, sets
from tidemark.operators.series import HOURLY
from tidemark.plans.features import wide_targets
from tidemark.schemas import KEY, TIME, WEATHER

_LABELS = "SELECT series_id, time, " + ", ".join(
    f"{lead_sql('us_aqi', h)} AS aqi_target_{h}h" for h in range(1, 73)) + " FROM f2"


@query("c1_join_sources", with_frames("pair_err", "SELECT * FROM pair_err"))
def _(spark, d):
    return joins.join_sources(air(spark, d), weather(spark, d, only_errors=True))


@query("c1_join_redelivered", with_frames(
    "f5 f2", "SELECT a.series_id, a.time, a.us_aqi, a.pm2_5, a.pm10, b.pm10 AS other FROM (SELECT * FROM f5 QUALIFY "
    "row_number() OVER (PARTITION BY series_id, time ORDER BY ingest_seq DESC) = 1) a "
    "JOIN (SELECT * FROM f2 WHERE series_id = 'error') b ON a.time = b.time"))
def _(spark, d):
    errors = hourly_by_type(spark, d).where(F.col(KEY) == "error").select(
        F.lit("all").alias(KEY), TIME, F.col("pm10").alias("other"), F.lit(1).alias("ingest_seq"))
    return joins.join_sources(redelivered(spark, d), errors, order="ingest_seq")


@query("c2_join_targets", with_frames(
    "f2", "SELECT * FROM f2 JOIN t USING (series_id, time) WHERE aqi_target_72h IS NOT NULL", t=_LABELS))
def _(spark, d):
    f2 = hourly_by_type(spark, d)
    return joins.join_targets(f2, wide_targets(f2, 72, ROWS))


@query("c3_training_view", with_frames(
    "f2", "SELECT f2.*, " + ", ".join(f"aqi_target_{h}h" for h in range(1, 73))
    + " FROM f2 LEFT JOIN (SELECT * FROM t WHERE aqi_target_72h IS NOT NULL) t USING (series_id, time)", t=_LABELS))
def _(spark, d):
    f2 = hourly_by_type(spark, d)
    joins.training_view(f2, wide_targets(f2, 72, ROWS), "training_view", how="left")
    return spark.table("training_view")


@query("c5_expand_horizons", with_frames(
    "f2", "SELECT series_id, time, CAST(h AS INTEGER) AS horizon_hours, time + to_hours(h) AS forecast_time FROM "
    "(SELECT series_id, max(time) AS time FROM f2 GROUP BY series_id), (SELECT unnest(range(1, 73)) AS h)"))
def _(spark, d):
    return joins.expand_horizons(keyed.latest_row(hourly_by_type(spark, d)).select(KEY, TIME))


@query("c6_attach_future_weather", with_frames(
    "weather", "SELECT l.series_id, l.time, CAST(h AS INTEGER) AS horizon_hours, l.time + to_hours(h) AS forecast_time, "
    + ", ".join(f"w.{c}" for c in WEATHER) + " FROM (SELECT series_id, max(time) AS time FROM weather GROUP BY 1) l, "
    "(SELECT unnest(range(1, 73)) AS h), weather w WHERE w.time + INTERVAL 72 HOUR = l.time + to_hours(h)"))
def _(spark, d):
    w = weather(spark, d)
    rows = joins.expand_horizons(keyed.latest_row(w.select(KEY, TIME)))
    # sf0.001 misses hours, so the exactly-one check is left to the unit tests
    return joins.attach_future_weather(rows, w.withColumn(TIME, add_hours(TIME, 72)), check=False)


@query("c7_missing_keys", with_frames(
    "f1 weather_err", "SELECT series_id, time FROM f1 WHERE time NOT IN (SELECT time FROM weather_err)"))
def _(spark, d):
    return joins.missing_keys(hourly_all(spark, d), weather(spark, d, only_errors=True), [KEY, TIME])


@query("c8_rejoin_features_labels", with_frames(
    "f2", "SELECT f2.series_id, f2.time, us_aqi, pm10, " + ", ".join(f"aqi_target_{h}h" for h in range(1, 73))
    + " FROM f2 JOIN t USING (series_id, time) WHERE aqi_target_72h IS NOT NULL", t=_LABELS))
def _(spark, d):
    f2 = hourly_by_type(spark, d)
    y = wide_targets(f2, 72, ROWS)
    return joins.rejoin_features_labels(f2.select(KEY, TIME, "us_aqi", "pm10"), y)


# -- set operations ----------------------------------------------------------------------
_MISSING = ("SELECT g.series_id, g.time FROM (SELECT series_id, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) "
            "AS time FROM f2 GROUP BY series_id) g ANTI JOIN f2 ON f2.series_id = g.series_id AND f2.time = g.time")


@query("g2_hour_difference", with_frames("f2", _MISSING))
def _(spark, d):
    return keyed.missing_steps(hourly_by_type(spark, d))


@query("f6_first_missing", with_frames("f2", f"SELECT * FROM ({_MISSING}) ORDER BY series_id, time LIMIT 10"))
def _(spark, d):
    return keyed.missing_steps(hourly_by_type(spark, d)).orderBy(KEY, TIME).limit(10)


@query("g3_distinct_keys", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return sets.distinct_keys(spark.read.parquet(f"{d}/events.parquet"), ["user_id", "event_type"])


@query("i7_hour_grid", with_frames(
    "f2", "SELECT series_id, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM f2 GROUP BY series_id"))
def _(spark, d):
    return keyed.own_grid(hourly_by_type(spark, d))


@query("i7_densify", with_frames(
    "f2", "SELECT g.series_id, g.time, us_aqi, pm2_5, pm10 FROM (SELECT series_id, unnest(generate_series(min(time), "
    "max(time), INTERVAL 1 HOUR)) AS time FROM f2 GROUP BY series_id) g LEFT JOIN f2 USING (series_id, time)"))
def _(spark, d):
    return keyed.densify(hourly_by_type(spark, d), HOURLY)
