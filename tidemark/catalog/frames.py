"""Hourly frames derived from the given tables, in Spark and in SQL.

All measures are integer-valued doubles (cents, counts, ids), so that sums and means come out
the same whatever the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import floor_hour
from tidemark.functions.calendar import add_hours
from tidemark.operators.joins import expand_horizons
from tidemark.operators.keyed import latest_row
from tidemark.functions.scoring import category
from tidemark.schemas import KEY, POLLUTANTS, TIME, WEATHER


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.round(F.col("value") * 100).alias("cents"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        floor_hour("ts").alias(TIME))


def _measures():
    return [F.sum("cents").alias("us_aqi"), F.max("cents").alias("pm2_5"),
            F.count(F.lit(1)).cast("double").alias("pm10")]


def hourly_all(spark, d) -> DataFrame:
    return events(spark, d).groupBy(F.lit("all").alias(KEY), TIME).agg(*_measures())


def hourly_by_type(spark, d) -> DataFrame:
    return events(spark, d).groupBy(F.col("event_type").alias(KEY), TIME).agg(*_measures())


def air(spark, d, key=None) -> DataFrame:
    key = F.lit("all") if key is None else F.col(key)
    out = events(spark, d).groupBy(key.alias(KEY), TIME).agg(
        *_measures(),
        F.min("cents").alias("carbon_monoxide"),
        F.sum("user_id").cast("double").alias("nitrogen_dioxide"),
        F.max("user_id").cast("double").alias("sulphur_dioxide"),
        F.min("user_id").cast("double").alias("ozone"),
        F.count_if(F.col("event_type") == "click").cast("double").alias("dust"),
        F.sum("k").cast("double").alias("aerosol_optical_depth"))
    return out.select(KEY, TIME, *POLLUTANTS)


def weather(spark, d, only_errors: bool = False, key=None) -> DataFrame:
    """``only_errors`` keeps the hours with an event of one type, so that some are missing."""
    key = F.lit("all") if key is None else F.col(key)
    k = F.col("k")
    out = events(spark, d).groupBy(key.alias(KEY), TIME).agg(
        F.min(k).cast("double").alias("temperature_2m"),
        F.max(k).cast("double").alias("relative_humidity_2m"),
        (F.max(k) - F.min(k)).cast("double").alias("dew_point_2m"),
        F.sum(k).cast("double").alias("surface_pressure"),
        F.count_if(k < 10).cast("double").alias("precipitation"),
        (F.sum(k) % 101).cast("double").alias("cloud_cover"),
        F.count_if(k >= 50).cast("double").alias("wind_speed_10m"),
        (F.sum(k) % 360).cast("double").alias("wind_direction_10m"),
        F.count(k).cast("double").alias("wind_gusts_10m"),
        F.count_if(F.col("event_type") == "error").alias("_errors"))
    return (out.where("_errors > 0") if only_errors else out).select(KEY, TIME, *WEATHER)


def daily_orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias(KEY), F.col("o_orderdate").alias(TIME),
    ).agg(F.sum(F.round(F.col("o_totalprice") * 100)).alias("y"))


def redelivered(spark, d) -> DataFrame:
    f1 = hourly_all(spark, d)
    again = f1.where(F.hour(TIME) % 6 == 0).withColumn("us_aqi", F.col("us_aqi") + 1)
    return f1.withColumn("ingest_seq", F.lit(1).cast("long")).unionByName(
        again.withColumn("ingest_seq", F.lit(2).cast("long")))


def with_nulls(spark, d) -> DataFrame:
    h = F.hour(TIME)
    return hourly_all(spark, d).withColumns({
        "pm10": F.when(~h.isin(3, 4), F.col("pm10")),
        "us_aqi": F.when(h != 5, F.col("us_aqi"))})


def forecast(spark, d) -> DataFrame:
    """72 rows after the newest hour: the values of 72 hours before, scaled into 0-350."""
    base = air(spark, d).join(weather(spark, d), [KEY, TIME])
    rows = expand_horizons(latest_row(base.select(KEY, TIME)), 72)
    seen = base.select(
        KEY, add_hours(TIME, 72).alias("forecast_time"),
        (F.col("us_aqi") % 350).alias("predicted_aqi"),
        F.col("temperature_2m").alias("forecast_temperature"),
        F.col("relative_humidity_2m").alias("forecast_humidity"),
        F.col("precipitation").alias("forecast_precipitation"),
        F.col("wind_speed_10m").alias("forecast_wind_speed"))
    return rows.join(seen, [KEY, "forecast_time"]).select(
        F.col(TIME).alias("forecast_generated_at"), "forecast_time",
        F.col("horizon_hours").cast("long").alias("horizon_hours"), "predicted_aqi",
        "forecast_temperature", "forecast_humidity", "forecast_precipitation",
        "forecast_wind_speed", category("predicted_aqi").alias("aqi_category"))


# -- the same frames in SQL --------------------------------------------------------------
_M = "sum(cents) AS us_aqi, max(cents) AS pm2_5, CAST(count(*) AS DOUBLE) AS pm10"
_AIR = (
    "CAST(count(*) AS DOUBLE) AS pm10, max(cents) AS pm2_5, min(cents) AS carbon_monoxide, "
    "CAST(sum(user_id) AS DOUBLE) AS nitrogen_dioxide, CAST(max(user_id) AS DOUBLE) AS sulphur_dioxide, "
    "CAST(min(user_id) AS DOUBLE) AS ozone, "
    "CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS dust, "
    "CAST(sum(k) AS DOUBLE) AS aerosol_optical_depth, sum(cents) AS us_aqi"
)
_WEATHER = (
    "CAST(min(k) AS DOUBLE) AS temperature_2m, CAST(max(k) AS DOUBLE) AS relative_humidity_2m, "
    "CAST(max(k) - min(k) AS DOUBLE) AS dew_point_2m, CAST(sum(k) AS DOUBLE) AS surface_pressure, "
    "CAST(count(*) FILTER (WHERE k < 10) AS DOUBLE) AS precipitation, "
    "CAST(sum(k) % 101 AS DOUBLE) AS cloud_cover, "
    "CAST(count(*) FILTER (WHERE k >= 50) AS DOUBLE) AS wind_speed_10m, "
    "CAST(sum(k) % 360 AS DOUBLE) AS wind_direction_10m, CAST(count(k) AS DOUBLE) AS wind_gusts_10m"
)
CATEGORY_SQL = (
    "CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 50 THEN 'Good' WHEN {x} <= 100 THEN 'Moderate' "
    "WHEN {x} <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN {x} <= 200 THEN 'Unhealthy' "
    "WHEN {x} <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END"
)
FRAMES_SQL = {
    "ev": "SELECT event_id, ts, user_id, event_type, value, round(value * 100) AS cents, "
          "CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, date_trunc('hour', ts) AS time FROM events",
    "f1": f"SELECT 'all' AS series_id, time, {_M} FROM ev GROUP BY time",
    "f2": f"SELECT event_type AS series_id, time, {_M} FROM ev GROUP BY event_type, time",
    "air": f"SELECT 'all' AS series_id, time, {_AIR} FROM ev GROUP BY time",
    "weather": f"SELECT 'all' AS series_id, time, {_WEATHER} FROM ev GROUP BY time",
    "weather_err": f"SELECT 'all' AS series_id, time, {_WEATHER} FROM ev GROUP BY time HAVING count(*) FILTER (WHERE event_type = 'error') > 0",
    "air_type": f"SELECT event_type AS series_id, time, {_AIR} FROM ev GROUP BY event_type, time",
    "weather_type": f"SELECT event_type AS series_id, time, {_WEATHER} FROM ev GROUP BY event_type, time",
    "pair": "SELECT * FROM air JOIN weather USING (series_id, time)",
    "pair_err": "SELECT * FROM air JOIN weather_err USING (series_id, time)",
    "pair_type": "SELECT * FROM air_type JOIN weather_type USING (series_id, time)",
    "f4": "SELECT o_orderpriority AS series_id, o_orderdate AS time, sum(round(o_totalprice * 100)) AS y "
          "FROM orders GROUP BY o_orderpriority, o_orderdate",
    "f5": "SELECT *, CAST(1 AS BIGINT) AS ingest_seq FROM f1 UNION ALL "
          "SELECT series_id, time, us_aqi + 1, pm2_5, pm10, CAST(2 AS BIGINT) FROM f1 WHERE hour(time) % 6 = 0",
    "f6": "SELECT series_id, time, CASE WHEN hour(time) <> 5 THEN us_aqi END AS us_aqi, pm2_5, "
          "CASE WHEN hour(time) NOT IN (3, 4) THEN pm10 END AS pm10 FROM f1",
    "f9": "SELECT l.t AS forecast_generated_at, b.time + INTERVAL 72 HOUR AS forecast_time, "
          "CAST(h.h AS BIGINT) AS horizon_hours, b.us_aqi % 350 AS predicted_aqi, "
          "b.temperature_2m AS forecast_temperature, b.relative_humidity_2m AS forecast_humidity, "
          "b.precipitation AS forecast_precipitation, b.wind_speed_10m AS forecast_wind_speed, "
          + CATEGORY_SQL.format(x="(b.us_aqi % 350)") + " AS aqi_category "
          "FROM (SELECT max(time) AS t FROM pair) l JOIN range(1, 73) h(h) ON TRUE "
          "JOIN pair b ON b.time + INTERVAL 72 HOUR = l.t + to_hours(h.h)",
}
_NEEDS = {
    "f1": ["ev"], "f2": ["ev"], "air": ["ev"], "weather": ["ev"], "weather_err": ["ev"],
    "air_type": ["ev"], "weather_type": ["ev"], "pair": ["air", "weather"],
    "pair_err": ["air", "weather_err"], "pair_type": ["air_type", "weather_type"],
    "f5": ["f1"], "f6": ["f1"], "f9": ["pair"],
}


def with_frames(names: str, body: str, **extra: str) -> str:
    """``WITH`` the named frames and what they need, then extra ones, then the body."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({FRAMES_SQL[n].replace(chr(10), ' ')})" for n in order]
    parts += [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
