"""Queries for projections, filters, casts (B) and scalar functions (H, N)."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.catalog.frames import (
    CATEGORY_SQL, events, forecast, hourly_all, table, weather, with_frames, with_nulls,
)
from tidemark.catalog.registry import query
from tidemark.functions import calendar as cal
from tidemark.functions import scoring as sc
from tidemark.operators import project as p
from tidemark.plans.models import VECTOR, assemble
from tidemark.schemas import KEY, TIME

AT = "2024-01-15 12:00:00"


def at(text=AT):
    return F.lit(text).cast("timestamp_ntz")


@query("b1_select_contract", with_frames("f1", "SELECT time, pm10, us_aqi FROM f1"))
def _(spark, d):
    return p.select_contract(hourly_all(spark, d), [TIME, "pm10", "us_aqi"])


@query("b2_feature_vector", with_frames(
    "f1", "SELECT series_id, time, 3 AS inputs, us_aqi AS first_input, pm10 AS last_input FROM f1"))
def _(spark, d):
    order = ["us_aqi", "pm2_5", "pm10"]
    v = vector_to_array(VECTOR)
    return assemble(hourly_all(spark, d), order, saved_order=order).select(
        KEY, TIME, F.size(v).alias("inputs"), F.element_at(v, 1).alias("first_input"),
        F.element_at(v, -1).alias("last_input"))


@query("b3_drop_null_essential", with_frames("f6", "SELECT * FROM f6 WHERE us_aqi IS NOT NULL AND pm2_5 IS NOT NULL"))
def _(spark, d):
    return p.drop_null_essential(with_nulls(spark, d), ["us_aqi", "pm2_5"])


@query("b4_drop_null_any", with_frames("f6", "SELECT * FROM f6 WHERE us_aqi IS NOT NULL AND pm2_5 IS NOT NULL AND pm10 IS NOT NULL"))
def _(spark, d):
    return p.drop_null_any(with_nulls(spark, d))


@query("b5_drop_null_model", with_frames("f6", "SELECT * FROM f6 WHERE us_aqi IS NOT NULL AND pm10 IS NOT NULL"))
def _(spark, d):
    return p.drop_null_model(with_nulls(spark, d), ["pm10"], "us_aqi")


@query("b6_between_time",
       f"SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '{AT}'")
def _(spark, d):
    return p.between_time(table(spark, d, "events"), at("2024-01-10 00:00:00"), at(), "ts").select("event_id", "ts")


@query("b7_boundary",
       f"SELECT event_id, CASE WHEN ts < TIMESTAMP '{AT}' THEN 'train' ELSE 'test' END AS part FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    before, after = p.before_boundary(e, at(), "ts"), p.after_boundary(e, at(), "ts")
    return p.literal_column(before.select("event_id"), "part", "train").unionByName(
        p.literal_column(after.select("event_id"), "part", "test"))


@query("b8_horizon_in", with_frames("f9", "SELECT * FROM f9 WHERE horizon_hours IN (1, 6, 12, 24, 48, 72)"))
def _(spark, d):
    return p.horizon_in(forecast(spark, d))


@query("b9_horizon_le", with_frames("f9", "SELECT * FROM f9 WHERE horizon_hours <= 24"))
def _(spark, d):
    return p.horizon_le(forecast(spark, d), 24)


@query("b10_equals_filter", with_frames("f9", "SELECT * FROM f9 WHERE horizon_hours = 48"))
def _(spark, d):
    return p.equals_filter(forecast(spark, d), "horizon_hours", 48)


@query("b11_cast_schema", "SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, CAST(floor(value) AS BIGINT) AS value FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    return p.cast_schema(e, {"user_id": "double", "value": "bigint"})


@query("b12_rename", with_frames("f1", 'SELECT time AS "Time", us_aqi AS "Measured AQI" FROM f1'))
def _(spark, d):
    return p.rename(hourly_all(spark, d).select(TIME, "us_aqi"), {TIME: "Time", "us_aqi": "Measured AQI"})


@query("b13_drop_columns", with_frames("f1", "SELECT series_id, time, pm2_5, pm10 FROM f1"))
def _(spark, d):
    return p.drop_columns(hourly_all(spark, d), "us_aqi")


@query("b14_clamp_min", "SELECT event_id, CASE WHEN user_id = 7 THEN 0.0 ELSE greatest(0.0, round(value * 100) - 2000) END AS clamped FROM events")
def _(spark, d):
    x = F.when(F.col("user_id") == 7, F.lit(float("nan"))).otherwise(F.col("cents") - 2000)
    return events(spark, d).select("event_id", sc.clamp_min(x).alias("clamped"))


@query("b15_round_display", "SELECT event_id, round_even(value * 10, 0) / 10 AS shown FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", sc.round_display("value", 1).alias("shown"))


@query("b16_literal_column", "SELECT event_id, 'events' AS source FROM events")
def _(spark, d):
    return p.literal_column(table(spark, d, "events").select("event_id"), "source", "events")


# -- scalar functions ------------------------------------------------------------------
_CAL = ("CAST(hour({t}) AS INTEGER) AS {p}hour, CAST(isodow({t}) - 1 AS INTEGER) AS {p}day_of_week, "
        "CAST(month({t}) AS INTEGER) AS {p}month, CASE WHEN isodow({t}) >= 6 THEN 1 ELSE 0 END AS {p}is_weekend")


@query("h1_hour_of", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", cal.hour_of("ts").alias("hour"))


@query("h2_day_of_week", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", cal.day_of_week("o_orderdate").alias("day_of_week"))


@query("h3_month_of", "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", cal.month_of("o_orderdate").alias("month"))


@query("h4_is_weekend", "SELECT o_orderkey, CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", cal.is_weekend("o_orderdate").alias("is_weekend"))


@query("h5_add_hours", "SELECT event_id, ts + INTERVAL 31 HOUR AS later FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", cal.add_hours("ts", 31).alias("later"))


@query("h6_target_calendar", "SELECT event_id, " + _CAL.format(t="(ts + INTERVAL 72 HOUR)", p="target_") + " FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", *[
        c.alias(n) for n, c in cal.target_calendar("ts", 72).items()])


@query("h7_wind_sin_cos", with_frames(
    "weather", "SELECT time, round(sin(radians(wind_direction_10m)), 9) + 0.0 AS wind_direction_sin, "
    "round(cos(radians(wind_direction_10m)), 9) + 0.0 AS wind_direction_cos FROM weather"))
def _(spark, d):
    return weather(spark, d).select(TIME, *[
        F.round(c, 9).alias(n) for n, c in cal.wind_sin_cos("wind_direction_10m").items()])


@query("h8_cyclical", "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 9) + 0.0 AS hour_sin, "
       "round(cos(2 * pi() * hour(ts) / 24), 9) + 0.0 AS hour_cos, "
       "round(sin(2 * pi() * (month(ts) - 1) / 12), 9) + 0.0 AS month_sin, "
       "round(cos(2 * pi() * (month(ts) - 1) / 12), 9) + 0.0 AS month_cos FROM events")
def _(spark, d):
    cols = {**cal.cyclical(F.hour("ts"), 24, "hour"), **cal.cyclical(F.month("ts"), 12, "month", origin=1)}
    return table(spark, d, "events").select("event_id", *[F.round(c, 9).alias(n) for n, c in cols.items()])


@query("h9_floor_hour", "SELECT event_id, date_trunc('hour', ts) AS hour_start FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", cal.floor_hour("ts").alias("hour_start"))


@query("h10_strip_tz", "SELECT event_id, ts AS clock FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", cal.strip_tz(F.col("ts").cast("timestamp")).alias("clock"))


@query("h11_convert_tz", "SELECT event_id, ts + INTERVAL 5 HOUR AS local_time FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", cal.convert_tz("ts", "UTC", "Asia/Tashkent").alias("local_time"))


@query("h12_earlier", f"SELECT event_id, least(ts, TIMESTAMP '{AT}') AS first_time FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", cal.earlier("ts", at()).alias("first_time"))


@query("h13_date_of", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", cal.date_of("ts").cast("string").alias("day"))


@query("h14_iso_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", cal.iso_date("o_orderdate").alias("day"))


_V = "(value * 4)"


@query("h15_category", "SELECT event_id, " + CATEGORY_SQL.format(x=_V) + " AS aqi_category FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", sc.category(F.col("value") * 4).alias("aqi_category"))


@query("h16_health_message", f"SELECT event_id, CASE WHEN {_V} <= 50 THEN 'Air quality is satisfactory.' "
       f"WHEN {_V} <= 100 THEN 'Air quality is acceptable for most people.' "
       f"WHEN {_V} <= 150 THEN 'Sensitive groups may experience health effects.' "
       f"WHEN {_V} <= 200 THEN 'Everyone may begin to experience health effects.' "
       f"WHEN {_V} <= 300 THEN 'Health alert: increased risk of health effects.' "
       "ELSE 'Health warning: emergency conditions possible.' END AS message FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", sc.health_message(F.col("value") * 4).alias("message"))


@query("h17_alert_level", f"SELECT event_id, CASE WHEN {_V} > 300 THEN 'hazardous' WHEN {_V} > 200 THEN 'very_unhealthy' "
       f"WHEN {_V} > 150 THEN 'unhealthy' WHEN {_V} > 100 THEN 'sensitive_groups' ELSE 'none' END AS alert FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", sc.alert_level(F.col("value") * 4).alias("alert"))


@query("h18_label_of", "SELECT o_orderkey, dayname(o_orderdate) AS weekday, strftime(o_orderdate, '%b') AS month FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", sc.label_of(cal.day_of_week("o_orderdate"), sc.WEEKDAYS).alias("weekday"),
        sc.label_of(cal.month_of("o_orderdate"), sc.MONTHS, first=1).alias("month"))


@query("h20_format_number", "SELECT event_id, printf('%.1f', round(value * 100) / 64) AS shown FROM events")
def _(spark, d):
    return events(spark, d).select("event_id", sc.format_number(F.col("cents") / 64, 1).alias("shown"))


@query("h21_errors", "SELECT event_id, abs(round(value * 100) - user_id) AS abs_error, "
       "(round(value * 100) - user_id) * (round(value * 100) - user_id) AS sq_error FROM events")
def _(spark, d):
    return events(spark, d).select("event_id", sc.abs_error("cents", "user_id").alias("abs_error"),
                                   sc.sq_error("cents", "user_id").alias("sq_error"))


@query("n1_sql_function", "SELECT event_id, " + CATEGORY_SQL.format(x="value") + " AS aqi_category FROM events")
def _(spark, d):
    sc.register_sql_functions(spark)
    return table(spark, d, "events").selectExpr("event_id", "aqi_category(value) AS aqi_category")


