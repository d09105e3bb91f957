"""Queries for composite feature operators (K, H19) and the incremental operators (I)."""

from pyspark.sql import functions as F

from tidemark.catalog.frames import (
    air, events, forecast, hourly_all, hourly_by_type, table, weather, with_frames,
)
from tidemark.catalog.registry import query
from tidemark.catalog.sqltext import (
    calendar_sql, complete, feature_sql, future_weather_sql, lead_sql,
)
from tidemark.catalog.windows import BY_TIME, ROWS, rounded
from tidemark.functions.calendar import latest_completed
from tidemark.operators.guards import irregular_series, non_empty
from tidemark.operators.keyed import densify
from tidemark.operators.errors import DataContractError
from tidemark.operators.project import cast_schema, unpivot_targets
from tidemark.plans import features as f
from tidemark.plans import horizons as hz
from tidemark.plans import incremental as inc
from tidemark.schemas import (
    ALL_FEATURES_72H, CYCLE_COLUMNS, FEATURE_COLUMNS, FUTURE_WEATHER, KEY,
    REDUCED_FEATURES_72H, STD_COLUMNS, TARGET_CALENDAR, TIME, feature_types,
    target_name,
)
from tidemark.session import scratch_path
from tidemark.sources.tables import create_table

_COLS = ", ".join([KEY, *FEATURE_COLUMNS])
_K1 = "SELECT {cols} FROM ({src}) WHERE {done}"


def k1_sql(frame, by_time=False):
    return _K1.format(cols=_COLS, src=feature_sql(frame, by_time), done=complete(FEATURE_COLUMNS))


def shaped(df):
    return rounded(cast_schema(df, feature_types()), STD_COLUMNS)


@query("k1_engineer_features", with_frames("pair", k1_sql("pair")))
def _(spark, d):
    """Batch form: missing steps are reported and rows are counted."""
    return shaped(f.engineer_features(air(spark, d), weather(spark, d), "warn"))


@query("k1_engineer_features_gaps", with_frames("pair_err", k1_sql("pair_err")))
def _(spark, d):
    """One source misses hours; k steps back are k rows back."""
    merged = f.clean_sources(air(spark, d), weather(spark, d, only_errors=True))
    return shaped(f.feature_table(merged, ROWS))


@query("k1_engineer_features_by_time", with_frames("pair_type", k1_sql("pair_type", True)))
def _(spark, d):
    """Several series with gaps; k steps back are exactly k hours back."""
    both = [fn(spark, d, key="event_type") for fn in (air, weather)]
    return shaped(f.engineer_features(*both, gap_policy="by_time"))


_H_EXTRA = [*future_weather_sql(24), f"{lead_sql('wind_direction_10m', 24)} AS dir", f"{lead_sql('us_aqi', 24)} AS aqi_target_24h",
            *calendar_sql("(time + INTERVAL 24 HOUR)", TARGET_CALENDAR, "INTEGER")]
_WIND = ("round(sin(radians(dir)), 9) + 0.0 AS future_wind_direction_sin, round(cos(radians(dir)), 9) + 0.0 AS future_wind_direction_cos")


@query("k2_horizon_dataset", with_frames(
    "pair", f"SELECT {_COLS}, {', '.join([*FUTURE_WEATHER, *TARGET_CALENDAR])}, {_WIND}, aqi_target_24h FROM "
    f"(SELECT *, {', '.join(_H_EXTRA)} FROM k1) WHERE aqi_target_24h IS NOT NULL AND dir IS NOT NULL", k1=k1_sql("pair")))
def _(spark, d):
    k1 = shaped(f.feature_table(f.clean_sources(air(spark, d), weather(spark, d)), ROWS))
    out = k1.transform(hz.horizon_dataset, 24, ROWS)
    return rounded(out, ["future_wind_direction_sin", "future_wind_direction_cos"], 9)


_LONG_H = list(range(1, 73))


@query("k2_horizon_long", with_frames("pair_type", " UNION ALL ".join(
    f"SELECT series_id, time, {h} AS horizon, us_aqi, pm2_5, {', '.join([*FUTURE_WEATHER, *TARGET_CALENDAR])}, {_WIND}, target FROM "
    f"(SELECT *, {', '.join(future_weather_sql(h, True))}, {lead_sql('wind_direction_10m', h, True)} AS dir, {lead_sql('us_aqi', h, True)} AS target, "
    f"{', '.join(calendar_sql(f'(time + INTERVAL {h} HOUR)', TARGET_CALENDAR, 'INTEGER'))} FROM pair_type) WHERE target IS NOT NULL AND dir IS NOT NULL"
    for h in _LONG_H)))
def _(spark, d):
    both = [fn(spark, d, key="event_type") for fn in (air, weather)]
    out = hz.horizon_long(f.clean_sources(*both), _LONG_H, BY_TIME, keep=["us_aqi", "pm2_5"])
    return rounded(out, ["future_wind_direction_sin", "future_wind_direction_cos"], 9)


_ALL72 = "SELECT * FROM (SELECT series_id, time, " + ", ".join(
    f"{lead_sql('us_aqi', h)} AS {target_name(h)}" for h in range(1, 73)) + " FROM f1) WHERE aqi_target_72h IS NOT NULL"


@query("k3_wide_targets", with_frames("f1", _ALL72))
def _(spark, d):
    return f.wide_targets(hourly_all(spark, d), 72, ROWS)


@query("k3_wide_targets_holes", with_frames("f2", "SELECT * FROM (SELECT series_id, time, " + ", ".join(
    f"{lead_sql('us_aqi', h, True)} AS {target_name(h)}" for h in range(1, 73)) + " FROM f2) WHERE " + " AND ".join(
    f"{target_name(h)} IS NOT NULL" for h in range(1, 73))))
def _(spark, d):
    """The default call on series with holes: labels are those of the exact hours."""
    return f.wide_targets(hourly_by_type(spark, d))


@query("k3_label_check", with_frames(
    "f2", "SELECT t.series_id, t.time FROM (SELECT series_id, time, lead(us_aqi, 24) OVER (PARTITION BY series_id ORDER BY time) AS y, "
    "lead(us_aqi, 72) OVER (PARTITION BY series_id ORDER BY time) AS last FROM f2) t JOIN f2 ON f2.series_id = t.series_id "
    "AND f2.time = t.time + INTERVAL 24 HOUR WHERE t.last IS NOT NULL AND t.y <> f2.us_aqi"))
def _(spark, d):
    """Row-counted labels against exact hours: on a series with gaps some differ."""
    f2 = hourly_by_type(spark, d)
    return f.label_check(f.wide_targets(f2, 72, ROWS), f2, 24).select(KEY, TIME)


@query("h19_melt_targets", with_frames("f1", " UNION ALL ".join(
    f"SELECT series_id, time, {h} AS horizon, {target_name(h)} AS target FROM t" for h in range(1, 73)), t=_ALL72))
def _(spark, d):
    return unpivot_targets(f.wide_targets(hourly_all(spark, d), 72, ROWS), [target_name(h) for h in range(1, 73)])


@query("k4_live_inputs", with_frames(
    "pair", "SELECT l.series_id, l.time, l.time + to_hours(h) AS forecast_time, CAST(h AS INTEGER) AS horizon_hours, l.us_aqi, l.aqi_lag_168h, l.pm10_mean_72h, "
    + ", ".join(f"w.{s} AS {n}" for n, s in FUTURE_WEATHER.items())
    + ", round(sin(radians(w.wind_direction_10m)), 9) + 0.0 AS future_wind_direction_sin, "
    + ", ".join(calendar_sql("(l.time + to_hours(h))", TARGET_CALENDAR, "INTEGER"))
    + " FROM (SELECT * FROM k1 ORDER BY time DESC LIMIT 1) l, (SELECT unnest(range(1, 73)) AS h), weather w "
    "WHERE w.time + INTERVAL 96 HOUR = l.time + to_hours(h)", k1=k1_sql("pair")))
def _(spark, d):
    from tidemark.functions.calendar import add_hours
    w = weather(spark, d)
    k1 = f.feature_table(f.clean_sources(air(spark, d), w), ROWS)
    out = hz.live_inputs(k1, w.withColumn(TIME, add_hours(TIME, 96)), check=False)
    return rounded(out, ["future_wind_direction_sin"], 9).select(
        KEY, TIME, "forecast_time", "horizon_hours", "us_aqi", "aqi_lag_168h", "pm10_mean_72h",
        *FUTURE_WEATHER, "future_wind_direction_sin", *TARGET_CALENDAR)


@query("k4_live_inputs_full", with_frames(
    "pair", f"SELECT l.{_COLS.replace(', ', ', l.')}, l.time + to_hours(h) AS forecast_time, CAST(h AS INTEGER) AS horizon_hours, "
    + ", ".join(f"coalesce(w.{s}, 0) AS {n}" for n, s in FUTURE_WEATHER.items())
    + ", round(sin(radians(coalesce(w.wind_direction_10m, 0))), 9) + 0.0 AS future_wind_direction_sin"
    ", round(cos(radians(coalesce(w.wind_direction_10m, 0))), 9) + 0.0 AS future_wind_direction_cos, "
    + ", ".join(calendar_sql("(l.time + to_hours(h))", TARGET_CALENDAR, "INTEGER"))
    + " FROM (SELECT * FROM k1 ORDER BY time DESC LIMIT 1) l CROSS JOIN (SELECT unnest(range(1, 73)) AS h) LEFT JOIN weather w "
    "ON w.time + INTERVAL 96 HOUR = l.time + to_hours(h)", k1=k1_sql("pair", True)))
def _(spark, d):
    """All 89 columns of the 72 live input rows, with the checks of weather, nulls and order on."""
    from tidemark.functions.calendar import add_hours
    w = weather(spark, d)
    k1 = shaped(f.feature_table(f.clean_sources(air(spark, d), w)))
    future = densify(w).na.fill(0.0).withColumn(TIME, add_hours(TIME, 96))
    return rounded(hz.live_inputs(k1, future), ["future_wind_direction_sin", "future_wind_direction_cos"], 9)


def _cyc(x, p, name):
    return [f"round(sin(2 * pi() * ({x}) / {p}), 9) + 0.0 AS {name}_sin_72h", f"round(cos(2 * pi() * ({x}) / {p}), 9) + 0.0 AS {name}_cos_72h"]


_T72 = "(time + INTERVAL 72 HOUR)"
_K5 = [f"{c} AS {n}_72h" for n, c in zip(FUTURE_WEATHER, [e.rsplit(" AS ", 1)[0] for e in future_weather_sql(72)])] + [
    f"round(sin(radians({lead_sql('wind_direction_10m', 72)})), 9) + 0.0 AS future_wind_direction_sin_72h",
    f"round(cos(radians({lead_sql('wind_direction_10m', 72)})), 9) + 0.0 AS future_wind_direction_cos_72h",
    *_cyc(f"hour({_T72})", 24, "target_hour"), *_cyc(f"isodow({_T72}) - 1", 7, "target_day"),
    *_cyc(f"month({_T72}) - 1", 12, "target_month"),
    f"CASE WHEN isodow({_T72}) >= 6 THEN 1 ELSE 0 END AS target_is_weekend_72h",
] + [f"{lead_sql('us_aqi', h)} AS {target_name(h)}" for h in (1, 6, 24, 48, 72)]
_K5_FLOATS = [c for c in ALL_FEATURES_72H if c.endswith(("_sin_72h", "_cos_72h"))]
_K5_OUT = [KEY, TIME, *ALL_FEATURES_72H, *[target_name(h) for h in (1, 6, 24, 48, 72)]]
_K5_SQL = f"SELECT *, {', '.join(_K5)} FROM ({feature_sql('pair')})"
_K5_SOURCE = with_frames("pair", "SELECT {cols} FROM k5 WHERE " + complete(_K5_OUT), k5=_K5_SQL)


def _k5(spark, d):
    # row-counted, so that data with gaps match the SQL as well
    out = f.experimental_features_72h(air(spark, d), weather(spark, d), series=ROWS)
    return rounded(shaped(out), _K5_FLOATS, 9)


@query("k5_experimental_features_72h", _K5_SOURCE.format(cols=", ".join(_K5_OUT)))
def _(spark, d):
    return _k5(spark, d).select(*_K5_OUT)


@query("k6_cyclical_features", with_frames(
    "pair", "SELECT series_id, time, us_aqi, "
    + ", ".join(f"round({fn}(2 * pi() * {x} / {p}), 9) + 0.0 AS {n}_{fn}" for n, x, p in
                (("hour", "hour(time)", 24), ("day_of_week", "(isodow(time) - 1)", 7), ("month", "(month(time) - 1)", 12)) for fn in ("sin", "cos"))
    + ", round(sin(radians(wind_direction_10m)), 9) + 0.0 AS wind_direction_sin, round(cos(radians(wind_direction_10m)), 9) + 0.0 AS wind_direction_cos FROM pair"))
def _(spark, d):
    from tidemark.functions.calendar import calendar_columns
    df = f.clean_sources(air(spark, d), weather(spark, d)).withColumns(calendar_columns(TIME))
    return rounded(f.with_cycles(df).select(KEY, TIME, "us_aqi", *CYCLE_COLUMNS), CYCLE_COLUMNS, 9)


def _cycle_sql():
    parts = (("hour", "hour", 24), ("day_of_week", "day_of_week", 7), ("month", "(month - 1)", 12))
    return [f"round({fn}(2 * pi() * {x} / {p}), 9) + 0.0 AS {n}_{fn}" for n, x, p in parts for fn in ("sin", "cos")] + [
        f"round({fn}(radians(wind_direction_10m)), 9) + 0.0 AS wind_direction_{fn}" for fn in ("sin", "cos")]


def _set_query(name):
    columns = [c for c in f.FEATURE_SETS[name] if c not in CYCLE_COLUMNS]

    @query(f"k6_{name}", with_frames("pair", f"SELECT series_id, time, {', '.join(columns + _cycle_sql())} FROM k1", k1=k1_sql("pair")))
    def _(spark, d):
        k1 = shaped(f.feature_table(f.clean_sources(air(spark, d), weather(spark, d)), ROWS))
        return rounded(f.feature_set(k1, name), CYCLE_COLUMNS, 9)


for _name in ("cyclical_replacement", "original_plus_cyclical"):
    _set_query(_name)


@query("k7_reduced_features", _K5_SOURCE.format(cols=", ".join([KEY, TIME, *REDUCED_FEATURES_72H])))
def _(spark, d):
    return _k5(spark, d).select(KEY, TIME, *REDUCED_FEATURES_72H)


@query("p_planned_extras", with_frames(
    "pair", "SELECT series_id, time, pm2_5 - lag(pm2_5, 1) OVER w AS pm2_5_change_1h, pm2_5 - lag(pm2_5, 24) OVER w AS pm2_5_change_24h, "
    "pm10 - lag(pm10, 1) OVER w AS pm10_change_1h, pm10 - lag(pm10, 24) OVER w AS pm10_change_24h, "
    "CASE WHEN precipitation > 0 THEN 1 ELSE 0 END AS is_raining, round(wind_speed_10m * cos(radians(wind_direction_10m)), 9) + 0.0 AS wind_x, "
    "round(wind_speed_10m * sin(radians(wind_direction_10m)), 9) + 0.0 AS wind_y, CAST(floor((month(time) % 12) / 3) AS INTEGER) AS season, "
    "relative_humidity_2m * pm2_5 AS humidity_pm2_5 FROM pair WINDOW w AS (PARTITION BY series_id ORDER BY time)"))
def _(spark, d):
    out = f.planned_extras(f.clean_sources(air(spark, d), weather(spark, d)), ROWS)
    return rounded(out, ["wind_x", "wind_y"], 9).select(
        KEY, TIME, *[f"{m}_change_{k}h" for m in ("pm2_5", "pm10") for k in (1, 24)],
        "is_raining", "wind_x", "wind_y", "season", "humidity_pm2_5")


# -- incremental ---------------------------------------------------------------------------
NOW = "2024-01-31 20:34:00"


@query("i1_high_water_mark", with_frames("f2", "SELECT series_id, max(time) AS stored_max FROM f2 GROUP BY series_id"))
def _(spark, d):
    return inc.high_water_mark(hourly_by_type(spark, d))


@query("i2_latest_completed", "SELECT event_id, date_trunc('hour', ts) - INTERVAL 1 HOUR AS latest FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", latest_completed("ts").alias("latest"))


@query("i3_refresh_plan", with_frames(
    "f2", "SELECT series_id, m AS stored_max, TIMESTAMP '2024-01-31 19:00:00' AS latest, m + INTERVAL 1 HOUR AS next_missing, "
    "TIMESTAMP '2024-01-29 20:00:00' AS refresh_start, least(m + INTERVAL 1 HOUR, TIMESTAMP '2024-01-29 20:00:00') AS recompute_from, "
    "least(m + INTERVAL 1 HOUR, TIMESTAMP '2024-01-29 20:00:00') - INTERVAL 192 HOUR AS fetch_from FROM "
    "(SELECT series_id, max(time) AS m FROM f2 GROUP BY series_id)"))
def _(spark, d):
    return inc.refresh_plan(inc.high_water_mark(hourly_by_type(spark, d)), NOW)


_HOLES = ("SELECT g.series_id, min(g.time) AS first_hole FROM (SELECT series_id, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time "
          "FROM f2 GROUP BY series_id) g ANTI JOIN f2 ON f2.series_id = g.series_id AND f2.time = g.time GROUP BY g.series_id")


@query("i3_refresh_plan_holes", with_frames(
    "f2", "SELECT m.series_id, least(m.m + INTERVAL 1 HOUR, TIMESTAMP '2024-01-29 20:00:00', coalesce(h.first_hole, TIMESTAMP '2024-01-29 20:00:00')) "
    "AS recompute_from FROM (SELECT series_id, max(time) AS m FROM f2 GROUP BY series_id) m LEFT JOIN holes h USING (series_id)", holes=_HOLES))
def _(spark, d):
    f2 = hourly_by_type(spark, d)
    return inc.refresh_plan(inc.high_water_mark(f2), NOW, holes=inc.first_holes(f2)).select(KEY, "recompute_from")


_TAIL_FROM, _TAIL_TO = "2024-01-26 06:00:00", "2024-01-29 19:00:00"


def _plan(spark, d, stored="2024-01-26 05:00:00", now="2024-01-29 20:34:00"):
    marks = events(spark, d).groupBy(F.lit("all").alias(KEY)).agg(
        F.least(F.max(TIME), F.lit(stored).cast("timestamp_ntz")).alias("stored_max"))
    return inc.refresh_plan(marks, now)


@query("i4_recompute_tail", with_frames(
    "pair", f"SELECT * FROM ({k1_sql('pair', True)}) WHERE time BETWEEN TIMESTAMP '{_TAIL_FROM}' AND TIMESTAMP '{_TAIL_TO}'"))
def _(spark, d):
    """Only the fetched span is engineered; the rows equal those of a full rebuild."""
    out = inc.recompute_tail(air(spark, d), weather(spark, d), _plan(spark, d), "by_time",
                             fetch_from="2024-01-18 06:00:00", latest=_TAIL_TO)
    return shaped(out)


def _stored_features(spark, d, until):
    rows = f.feature_table(f.clean_sources(air(spark, d), weather(spark, d)), BY_TIME)
    t = create_table(spark, scratch_path(spark, "tables"), "features", 2, (KEY, TIME), TIME)
    t.upsert(cast_schema(rows, feature_types()).where(F.col(TIME) <= F.lit(until).cast("timestamp_ntz")))
    return t


@query("i5_refresh_features", with_frames(
    "pair", f"SELECT * FROM ({k1_sql('pair', True)}) WHERE time <= TIMESTAMP '{_TAIL_TO}'"))
def _(spark, d):
    """A table filled up to a date, then one refresh run: the same as a rebuild."""
    t = _stored_features(spark, d, "2024-01-26 05:00:00")
    inc.refresh_features(t, air(spark, d), weather(spark, d), "2024-01-29 20:34:00", "by_time")
    return shaped(t.read())


@query("i12_run_report", with_frames(
    "pair", "SELECT series_id, max(time) FILTER (WHERE time <= TIMESTAMP '2024-01-26 05:00:00') AS old_max, "
    "count(*) FILTER (WHERE time > TIMESTAMP '2024-01-26 05:00:00') AS new_rows, "
    "count(*) FILTER (WHERE time > TIMESTAMP '2024-01-24 05:00:00' AND time <= TIMESTAMP '2024-01-26 05:00:00') AS refreshed_rows, "
    "max(time) AS new_max FROM k1 GROUP BY series_id", k1=k1_sql("pair", True)))
def _(spark, d):
    rows = f.feature_table(f.clean_sources(air(spark, d), weather(spark, d)), BY_TIME)
    cut = F.lit("2024-01-26 05:00:00").cast("timestamp_ntz")
    marks = inc.high_water_mark(rows.where(F.col(TIME) <= cut))
    return inc.run_report(marks, rows.where(F.col(TIME) > F.lit("2024-01-24 05:00:00").cast("timestamp_ntz")))


@query("i6_irregular_series", with_frames(
    "f2", "SELECT series_id, count(*) AS rows, epoch(max(time) - min(time)) / 3600 + 1 AS expected FROM f2 GROUP BY series_id "
    "HAVING count(*) <> epoch(max(time) - min(time)) / 3600 + 1"))
def _(spark, d):
    return irregular_series(hourly_by_type(spark, d))


@query("i10_non_empty", with_frames("f2", "SELECT * FROM f2"))
def _(spark, d):
    """The guard passes a table that has rows on unchanged, and refuses one that has none."""
    rows = hourly_by_type(spark, d)
    try:
        non_empty(rows.where("time < TIMESTAMP_NTZ '1900-01-01'"), "no rows")
    except DataContractError:
        return non_empty(rows, "no rows")
    raise AssertionError("an empty table passed")


_BY_TIME72 = "SELECT * FROM (SELECT series_id, time, " + ", ".join(
    f"{lead_sql('us_aqi', h, True)} AS {target_name(h)}" for h in range(1, 73)) + " FROM {fr}) WHERE " + complete(
    [target_name(h) for h in range(1, 73)])


@query("i8_mature_targets", with_frames("f2", _BY_TIME72.format(fr="f2")))
def _(spark, d):
    return inc.mature_targets(hourly_by_type(spark, d))


@query("i8_mature_targets_again", with_frames(
    "f1", f"SELECT * FROM ({_BY_TIME72.format(fr='f1')}) WHERE time > TIMESTAMP '2024-01-20 00:00:00'"))
def _(spark, d):
    """Labels are stored up to a date; only later rows are added."""
    f1 = hourly_all(spark, d)
    stored = f1.where(F.col(TIME) <= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select(KEY, TIME)
    return inc.mature_targets(f1, stored)


@query("i11_upsert_forecast", with_frames(
    "f9", "SELECT forecast_generated_at + to_hours(CAST(CASE WHEN horizon_hours > 12 THEN 12 ELSE 0 END AS BIGINT)) AS forecast_generated_at, forecast_time, "
    "CASE WHEN horizon_hours > 12 THEN horizon_hours - 12 ELSE horizon_hours END AS horizon_hours, "
    "CASE WHEN horizon_hours > 12 THEN predicted_aqi + 1 ELSE predicted_aqi END AS predicted_aqi FROM f9"))
def _(spark, d):
    """Two runs 12 hours apart: hours both of them cover show the newer one."""
    from tidemark.functions.calendar import add_hours
    first = forecast(spark, d).select("forecast_generated_at", "forecast_time", "horizon_hours", "predicted_aqi")
    second = first.where("horizon_hours > 12").withColumns({
        "forecast_generated_at": add_hours("forecast_generated_at", 12),
        "horizon_hours": F.col("horizon_hours") - 12, "predicted_aqi": F.col("predicted_aqi") + 1})
    t = create_table(spark, scratch_path(spark, "tables"), "forecast", 1, ("forecast_time",), "forecast_time")
    inc.upsert_forecast(t, second)
    inc.upsert_forecast(t, first)
    return t.read()


