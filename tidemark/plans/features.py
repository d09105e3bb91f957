"""The feature table and the derived feature sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import add_hours, calendar_columns, cyclical, wind_sin_cos
from tidemark.operators.guards import assert_regular
from tidemark.operators.joins import join_sources
from tidemark.operators.project import drop_null_essential, known_rows, select_contract
from tidemark.operators.rolling import history_levels
from tidemark.operators.series import HOURLY, Series, over_series
from tidemark.schemas import (
    BASELINE_HORIZONS, CALENDAR, CYCLE_COLUMNS, CYCLE_SOURCES, ESSENTIAL, FEATURE_COLUMNS,
    FUTURE_WEATHER, KEY, LONG_LAG, MAX_HORIZON, POLLUTANTS, PREFIX, SHORT_FEATURES,
    TARGET_COLUMNS, TIME, WEATHER, WIND_DIRECTION, lag_name, mean_name, target_name,
)

# A feature row has no NULL exactly when these columns have none: a known 72-step mean means that
# every value of its window is known, and with it all shorter means, lags, changes and spreads.
COMPLETE_WHEN = (
    [c for c in POLLUTANTS + WEATHER if c not in PREFIX]
    + [mean_name(m, 72) for m in PREFIX] + [lag_name(m, 72) for m in PREFIX]
    + [lag_name("us_aqi", LONG_LAG)]
)

# gap policy -> what "k steps back" means
POLICY_MODE = {"error": "dense", "warn": "rows", "by_time": "time"}


def clean_sources(air: DataFrame, weather: DataFrame, order: str | None = None) -> DataFrame:
    return drop_null_essential(join_sources(air, weather, order=order), ESSENTIAL)


def history_features(df: DataFrame, series: Series = HOURLY, extra_levels=(), ahead: int = 0) -> DataFrame:
    """Calendar, lag, rolling, change and spread columns on one shuffle."""
    levels, back = history_levels()
    # calendar columns first: they are only projections and ride along
    dated = df.withColumns(calendar_columns(TIME))
    return over_series(dated, series, back, ahead, [*levels, *extra_levels])


def engineer_features(air: DataFrame, weather: DataFrame, gap_policy: str = "error",
                      order: str | None = None, series: Series = HOURLY) -> DataFrame:
    """Both sources to the 72-column contract (plus the series key).

    ``error`` and ``warn`` look for missing steps first; ``error`` stops there, ``warn`` goes on
    counting rows, ``by_time`` reads exact hours and needs no check.
    """
    merged = clean_sources(air, weather, order)
    mode = POLICY_MODE[gap_policy]
    if assert_regular(merged, series, gap_policy):
        mode = "dense"
    return feature_table(merged, series.using(mode))


def feature_table(merged: DataFrame, series: Series = HOURLY) -> DataFrame:
    out = known_rows(history_features(merged, series), COMPLETE_WHEN)
    return select_contract(out, [KEY, *FEATURE_COLUMNS])


def wide_targets(df: DataFrame, horizons: int = MAX_HORIZON, series: Series = HOURLY,
                 measure: str = "us_aqi") -> DataFrame:
    """One label column per horizon; only rows for which all of them exist."""
    hs = range(1, horizons + 1)
    narrow = df.select(*series.keys, series.time, measure)
    out = over_series(narrow, series, 0, horizons, [
        lambda at: {target_name(h): at(measure, -h) for h in hs}
    ])
    return known_rows(out.drop(measure), [target_name(h) for h in hs])


def label_check(labels: DataFrame, values: DataFrame, horizon: int, series: Series = HOURLY,
                measure: str = "us_aqi") -> DataFrame:
    """Label rows that differ from the value ``horizon`` hours later; empty when aligned."""
    later = values.select(*series.keys, (add_hours(series.time, -horizon)).alias(series.time),
                          F.col(measure).alias("_value"))
    return labels.join(later, [*series.keys, series.time], "inner").where(
        ~F.col(target_name(horizon)).eqNullSafe(F.col("_value")))


def _future_level(horizon: int, suffix: str = "", measure: str | None = None):
    def level(at) -> dict[str, str]:
        out = {f"{new}{suffix}": at(src, -horizon) for new, src in FUTURE_WEATHER.items()}
        out["_future_direction"] = at(WIND_DIRECTION, -horizon)
        if measure:
            out["_label"] = at(measure, -horizon)
        return out
    return level


def experimental_features_72h(air: DataFrame, weather: DataFrame, order: str | None = None,
                              series: Series = HOURLY, horizon: int = 72) -> DataFrame:
    """The feature table plus weather and cyclical time at +72 h and five labels.

    Everything ordered shares the one shuffle of the history features.
    """
    merged = clean_sources(air, weather, order)
    extra = [
        _future_level(horizon, f"_{horizon}h"),
        lambda at: {target_name(h): at("us_aqi", -h) for h in BASELINE_HORIZONS},
    ]
    out = history_features(merged, series, extra, ahead=horizon)
    later = add_hours(TIME, horizon)
    suffix = f"_{horizon}h"
    cal = calendar_columns(later, ("_h", "_d", "_m", "_w"))
    out = out.withColumns({
        **{f"{k}_{horizon}h": v for k, v in
           wind_sin_cos("_future_direction", "future_wind_direction").items()},
        **cyclical(cal["_h"], 24, "target_hour", suffix=suffix),
        **cyclical(cal["_d"], 7, "target_day", suffix=suffix),
        **cyclical(cal["_m"], 12, "target_month", origin=1, suffix=suffix),
        f"target_is_weekend{suffix}": cal["_w"],
    }).drop("_future_direction")
    needed = [*COMPLETE_WHEN, f"future_wind_direction_sin{suffix}",
              *[f"{c}{suffix}" for c in FUTURE_WEATHER], *[target_name(h) for h in BASELINE_HORIZONS]]
    return known_rows(out, needed)


def cycle_columns() -> dict[str, Column]:
    return {
        **cyclical("hour", 24, "hour"), **cyclical("day_of_week", 7, "day_of_week"),
        **cyclical("month", 12, "month", origin=1), **wind_sin_cos(WIND_DIRECTION),
    }


def with_cycles(df: DataFrame) -> DataFrame:
    return df.withColumns(cycle_columns())


# feature set name -> model input columns (39, 43 and 47 of them)
FEATURE_SETS = {
    "original_features": SHORT_FEATURES,
    "cyclical_replacement": [c for c in SHORT_FEATURES if c not in CYCLE_SOURCES] + CYCLE_COLUMNS,
    "original_plus_cyclical": SHORT_FEATURES + CYCLE_COLUMNS,
}


def feature_set(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    return with_cycles(df).select(*(keep or [KEY, TIME]), *FEATURE_SETS[name])


# Ideas the plans of the project name next: rates, rain, wind parts, season, interaction.
def planned_extras(df: DataFrame, series: Series = HOURLY) -> DataFrame:
    r = F.radians(WIND_DIRECTION)
    season = F.floor((F.month(TIME) % 12) / 3).cast("int")
    return over_series(df, series, 24, 0, [
        lambda at: {f"{m}_change_{k}h": f"`{m}` - {at(m, k)}" for m in ("pm2_5", "pm10") for k in (1, 24)}
    ]).withColumns({
        "is_raining": (F.col("precipitation") > 0).cast("int"),
        "wind_x": F.col("wind_speed_10m") * F.cos(r),
        "wind_y": F.col("wind_speed_10m") * F.sin(r),
        "season": season,
        "humidity_pm2_5": F.col("relative_humidity_2m") * F.col("pm2_5"),
    })


ALL_FEATURE_COLUMNS = [KEY, *FEATURE_COLUMNS]
ALL_TARGET_COLUMNS = [KEY, TIME, *TARGET_COLUMNS]
CALENDAR_COLUMNS = CALENDAR
