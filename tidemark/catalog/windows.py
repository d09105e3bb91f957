"""Queries for ordered operators (D), splits (J) and row picks."""

from pyspark.sql import functions as F

from tidemark.catalog.frames import (
    daily_orders, events, forecast, hourly_all, hourly_by_type, redelivered, table, weather, with_frames,
)
from tidemark.catalog.registry import query
from tidemark.catalog.sqltext import (
    change_columns, history_columns, lag_columns, lead_sql, mean_columns, std_columns,
)
from tidemark.operators import keyed, rolling, splits
from tidemark.operators.dense import dense_history
from tidemark.operators.joins import lookup_at_offset
from tidemark.operators.series import HOURLY, Series, over_series
from tidemark.plans.features import wide_targets
from tidemark.schemas import (
    CHANGE_COLUMNS, FUTURE_WEATHER, KEY, LAG_COLUMNS, LAG_STEPS, LAGS, MEAN_COLUMNS, MEAN_WINDOWS, PREFIX, STD_COLUMNS,
    STD_WINDOWS, TIME,
)

ROWS = HOURLY.using("rows")
BY_TIME = HOURLY.using("time")
DAILY = Series(step_seconds=86400, mode="rows", chunk_steps=1024)


def rounded(df, columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _sel(cols, frame="f1", base="series_id, time, us_aqi, pm2_5, pm10"):
    return with_frames(frame, f"SELECT {base}, {', '.join(cols)} FROM {frame}")


@query("d1_lags_aqi", _sel(lag_columns(["us_aqi"]), "f2"))
def _(spark, d):
    return rolling.lags(hourly_by_type(spark, d), "us_aqi", LAGS["us_aqi"], ROWS)


@query("d2_lags_pm2_5", _sel(lag_columns(["pm2_5"])))
def _(spark, d):
    return rolling.lags(hourly_all(spark, d), "pm2_5", LAGS["pm2_5"], HOURLY.using("rows"))


@query("d3_lags_pm10", _sel(lag_columns(["pm10"], by_time=True), "f2"))
def _(spark, d):
    return rolling.lags(hourly_by_type(spark, d), "pm10", LAGS["pm10"], BY_TIME)


@query("d4_rolling_mean", _sel(mean_columns(), "f2"))
def _(spark, d):
    return rolling.rolling_mean(hourly_by_type(spark, d), list(PREFIX), MEAN_WINDOWS, ROWS)


@query("d5_rolling_std", _sel(std_columns(), "f2"))
def _(spark, d):
    return rounded(rolling.rolling_std(hourly_by_type(spark, d), "us_aqi", STD_WINDOWS, ROWS), STD_COLUMNS)


@query("d6_changes", _sel(change_columns(), "f2"))
def _(spark, d):
    return rolling.changes(hourly_by_type(spark, d), "us_aqi", LAG_STEPS, ROWS)


@query("d7_leads", with_frames("weather", "SELECT series_id, time, " + ", ".join(
    f"{lead_sql(s, 24)} AS {n}" for n, s in FUTURE_WEATHER.items()) + " FROM weather"))
def _(spark, d):
    return rolling.leads(weather(spark, d), FUTURE_WEATHER, 24, ROWS).select(KEY, TIME, *FUTURE_WEATHER)


_TARGETS = "SELECT series_id, time, " + ", ".join(
    f"{lead_sql('us_aqi', h)} AS aqi_target_{h}h" for h in range(1, 73)) + " FROM {frame}"


@query("d8_targets", with_frames(
    "f2", "SELECT * FROM t WHERE aqi_target_72h IS NOT NULL", t=_TARGETS.format(frame="f2")))
def _(spark, d):
    return wide_targets(hourly_by_type(spark, d), 72, ROWS)


_GAPS = ("SELECT series_id, prev AS previous_time, time, epoch(time - prev) / {s} AS gap_steps FROM ("
         "SELECT series_id, time, lag(time) OVER (PARTITION BY series_id ORDER BY time) AS prev FROM {f}) "
         "WHERE epoch(time - prev) > {s}")


@query("d9_time_gaps", with_frames("f2", _GAPS.format(s=3600, f="f2")))
def _(spark, d):
    return keyed.time_gaps(hourly_by_type(spark, d), HOURLY)


@query("d9_time_gaps_daily", with_frames("f4", _GAPS.format(s=86400, f="f4")))
def _(spark, d):
    return keyed.time_gaps(daily_orders(spark, d), DAILY)


@query("d10_dedup_last", with_frames("f5", "SELECT * FROM f5 QUALIFY row_number() OVER "
       "(PARTITION BY series_id, time ORDER BY ingest_seq DESC) = 1"))
def _(spark, d):
    return keyed.dedup_last(redelivered(spark, d), [KEY, TIME], ["ingest_seq"])


@query("d11_row_split_index", with_frames(
    "f4", "SELECT series_id, time, y, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 "
    "< floor(count(*) OVER (PARTITION BY series_id) * 0.8) THEN 'train' ELSE 'test' END AS part FROM f4"))
def _(spark, d):
    return splits.split_by_index(daily_orders(spark, d), 0.8, DAILY)


@query("d12_nth_row", with_frames(
    "f4", "SELECT series_id, time, y FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time) AS rn, "
    "count(*) OVER (PARTITION BY series_id) AS n FROM f4) WHERE rn = floor(n / 2) + 1"))
def _(spark, d):
    return keyed.middle_row(daily_orders(spark, d), DAILY)


@query("d13_first_row", with_frames("f9", "SELECT * FROM f9 WHERE horizon_hours = 1"))
def _(spark, d):
    return keyed.first_row(forecast(spark, d), time="forecast_time")


@query("d14_latest_row", with_frames(
    "f2", "SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY time DESC) = 1"))
def _(spark, d):
    return keyed.latest_row(hourly_by_type(spark, d))


@query("d_history_by_time", _sel(history_columns(by_time=True), "f2"))
def _(spark, d):
    levels, back = rolling.history_levels()
    return rounded(over_series(hourly_by_type(spark, d), BY_TIME, back, 0, levels), STD_COLUMNS).select(
        *_history_output())


@query("d_history_small_chunks", _sel(history_columns(), "f2"))
def _(spark, d):
    """The same block with very short chunks, so that every frame crosses a chunk border."""
    levels, back = rolling.history_levels()
    series = Series(mode="rows", chunk_steps=100)
    return rounded(over_series(hourly_by_type(spark, d), series, back, 0, levels), STD_COLUMNS).select(
        *_history_output())


def _history_output():
    from tidemark.schemas import CHANGE_COLUMNS, LAG_COLUMNS, MEAN_COLUMNS
    return [KEY, TIME, "us_aqi", "pm2_5", "pm10", *LAG_COLUMNS, *MEAN_COLUMNS, *CHANGE_COLUMNS, *STD_COLUMNS]


@query("c4_lookup_at_offset", with_frames(
    "f2", "SELECT a.series_id, a.time, a.us_aqi, a.pm2_5, a.pm10, "
    + ", ".join(f"b{k}.us_aqi AS value_at_{k}h" for k in (1, 6, 24, 72)) + " FROM f2 a "
    + " ".join(f"LEFT JOIN f2 b{k} ON b{k}.series_id = a.series_id AND b{k}.time = a.time + INTERVAL {k} HOUR"
               for k in (1, 6, 24, 72))))
def _(spark, d):
    return lookup_at_offset(hourly_by_type(spark, d), "us_aqi", [1, 6, 24, 72])


# -- splits ------------------------------------------------------------------------------
@query("j1_split_by_index", with_frames(
    "f2", "SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 "
    "< floor(count(*) OVER (PARTITION BY series_id) * 0.8) THEN 'train' ELSE 'test' END AS part FROM f2"))
def _(spark, d):
    return splits.split_by_index(hourly_by_type(spark, d))


@query("j1_split_null_keys", with_frames(
    "f2", "SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 "
    "< floor(count(*) OVER (PARTITION BY series_id) * 0.8) THEN 'train' ELSE 'test' END AS part FROM "
    "(SELECT CASE WHEN series_id <> 'error' THEN series_id END AS series_id, time, us_aqi, pm2_5, pm10 FROM f2)"))
def _(spark, d):
    """A series without a key is a series like any other."""
    return splits.split_by_index(hourly_by_type(spark, d).withColumn(KEY, F.when(F.col(KEY) != "error", F.col(KEY))))


@query("j2_split_by_time", "SELECT event_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-20 20:00:00' "
       "THEN 'train' ELSE 'test' END AS part FROM events")
def _(spark, d):
    return splits.split_by_time(table(spark, d, "events").select("event_id", "ts"), "2024-01-20 20:00:00", "ts")


@query("j2_split_by_time_purged", "SELECT event_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-20 20:00:00' "
       "THEN 'train' ELSE 'test' END AS part FROM events WHERE ts >= TIMESTAMP '2024-01-20 20:00:00' "
       "OR date_trunc('second', ts) < TIMESTAMP '2024-01-17 20:00:00'")
def _(spark, d):
    return splits.split_by_time(table(spark, d, "events").select("event_id", "ts"), "2024-01-20 20:00:00", "ts", 72)


@query("j3_split_by_quantile", with_frames(
    "f2", "SELECT *, CASE WHEN epoch(time) < (SELECT quantile_cont(epoch(time), 0.8) FROM f2) "
    "THEN 'train' ELSE 'test' END AS part FROM f2"))
def _(spark, d):
    return splits.split_by_quantile(hourly_by_type(spark, d))


@query("j4_split_nested", with_frames(
    "f4", "SELECT series_id, time, y, CASE WHEN rn < floor(floor(n * 0.8) * 0.8) THEN 'train' "
    "WHEN rn < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS part FROM (SELECT *, "
    "row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM f4)"))
def _(spark, d):
    return splits.split_nested(daily_orders(spark, d), series=DAILY)


@query("d_user_history", with_frames(
    "ev", "SELECT series_id, time, us_aqi, pm2_5, pm10, " + ", ".join(history_columns()) + " FROM dense",
    u="SELECT CAST(user_id AS VARCHAR) AS series_id, time, sum(cents) AS us_aqi, max(cents) AS pm2_5, CAST(count(*) AS DOUBLE) AS pm10 FROM ev GROUP BY 1, 2",
    spine="SELECT series_id, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM u GROUP BY series_id",
    dense="SELECT s.series_id, s.time, coalesce(us_aqi, 0) AS us_aqi, coalesce(pm2_5, 0) AS pm2_5, coalesce(pm10, 0) AS pm10 FROM spine s "
          "LEFT JOIN u ON u.series_id = s.series_id AND u.time = s.time"))
def _(spark, d):
    """The whole history block, 49 columns, on one dense hourly series per user: the widest window job."""
    hourly = events(spark, d).groupBy(F.col("user_id").cast("string").alias(KEY), TIME).agg(
        F.sum("cents").alias("us_aqi"), F.max("cents").alias("pm2_5"), F.count("*").cast("double").alias("pm10"))
    return rounded(dense_history(hourly), STD_COLUMNS).select(
        KEY, TIME, *PREFIX, *LAG_COLUMNS, *MEAN_COLUMNS, *CHANGE_COLUMNS, *STD_COLUMNS)
