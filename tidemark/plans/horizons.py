"""Per-horizon datasets for training, and the live model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import calendar_columns, target_calendar, wind_sin_cos
from tidemark.operators.errors import DataContractError
from tidemark.operators.joins import attach_future_weather, expand_horizons
from tidemark.operators.keyed import latest_row
from tidemark.operators.project import drop_null_model, known_rows, select_contract
from tidemark.operators.series import CHUNK, HOME, HOURLY, POS, Series, over_series, spread
from tidemark.plans.features import _future_level
from tidemark.schemas import (
    FEATURE_COLUMNS, FUTURE_WEATHER, FUTURE_WIND, HORIZON_EXTRAS, KEY, MODEL_BASE_COLUMNS, MODEL_COLUMNS,
    TARGET_CALENDAR, TIME, WEATHER, WIND_DIRECTION, target_name,
)


def horizon_dataset(df: DataFrame, horizon: int, series: Series = HOURLY,
                    measure: str = "us_aqi", base: list[str] | None = None) -> DataFrame:
    """Inputs known at ``time`` plus weather and calendar at the target hour, and the label.

    The label is read from ``aqi_target_{h}h`` when the table has it (labels joined before),
    otherwise from the measure itself. Weather is read from the rows of ``df``: counted in rows
    (``rows``/``dense``, as a shift on the joined table does) or at the exact hour (``time``).
    """
    base = base if base is not None else MODEL_BASE_COLUMNS
    label = target_name(horizon)
    stored = label in df.columns
    level = _future_level(horizon, measure=None if stored else measure)
    out = over_series(df, series, 0, horizon, [level])
    if not stored:
        out = out.withColumnRenamed("_label", label)
    out = out.withColumns({
        **wind_sin_cos("_future_direction", "future_wind_direction"),
        **target_calendar(series.time, horizon),
    })
    out = out.select(*series.keys, series.time, *base, *HORIZON_EXTRAS, label)
    needed = [c for c in HORIZON_EXTRAS if c not in (FUTURE_WIND[1], *TARGET_CALENDAR)]
    return drop_null_model(out, [*base, *needed], label)


AHEAD = "ahead"


def horizon_store(df: DataFrame, horizons: int = 72, series: Series = HOURLY, measure: str = "us_aqi",
                  keep: list[str] | None = None) -> DataFrame:
    """The rows with an array ``ahead`` of (horizon, target, weather, direction) of the next ``horizons`` steps.

    One shuffle and one window make what every horizon needs; stored, it serves all fits and the long
    form without another exchange. Steps that have no row are left out of the array. Labels stored beside
    the features (``aqi_target_{h}h``) take the measure's place as target, as in ``horizon_dataset``.
    """
    labels = {h: target_name(h) for h in range(1, horizons + 1) if target_name(h) in df.columns}
    base = keep if keep is not None else [c for c in df.columns if c not in (*series.keys, series.time, *labels.values())]
    fields = {"target": measure, **FUTURE_WEATHER, "direction": WIND_DIRECTION}
    out = with_later(df, horizons, series, fields)
    if labels:
        stored = F.array(*[F.col(labels[h]).cast("double") if h in labels else F.lit(None).cast("double")
                           for h in range(1, horizons + 1)])
        out = out.withColumn("_labels", stored).withColumn(AHEAD, F.transform(
            AHEAD, lambda x: x.withField("target", F.get(F.col("_labels"), x["horizon"] - 1))))
    return out.select(*series.keys, series.time, *base, AHEAD)


def with_later(df: DataFrame, horizons: int, series: Series, fields: dict[str, str]) -> DataFrame:
    """The rows with an array ``ahead`` of (horizon, fields) of the next steps that have a row; one exchange."""
    placed = spread(df, series, 0, horizons)
    unit = 1 if series.mode == "rows" else series.step_seconds
    frame = Window.partitionBy(*series.keys, CHUNK).orderBy(POS).rangeBetween(unit, horizons * unit)
    entry = F.struct(F.col(POS).alias("at"), *[F.col(s).cast("double").alias(n) for n, s in fields.items()])
    out = placed.withColumn("_later", F.collect_list(entry).over(frame)).where(HOME)
    return out.withColumn(AHEAD, F.transform("_later", lambda x: F.struct(
        ((x["at"] - F.col(POS)) / unit).cast("int").alias("horizon"), *[x[n].alias(n) for n in fields]))).select(*df.columns, AHEAD)


def long_of(store: DataFrame, keep: list[str], series: Series = HOURLY, horizons: list[int] | None = None) -> DataFrame:
    """A stored ``horizon_store`` as rows (keys, time, horizon, kept columns, extras, target), in place."""
    ahead = F.col(AHEAD) if horizons is None else F.filter(AHEAD, lambda x: x["horizon"].isin(horizons))
    out = store.select(*series.keys, series.time, *keep, F.inline(ahead)).withColumns({
        **wind_sin_cos("direction", "future_wind_direction"),
        **target_calendar(series.time, F.col("horizon")),
    })
    out = out.select(*series.keys, series.time, "horizon", *keep, *HORIZON_EXTRAS, "target")
    return known_rows(out, [*keep, *FUTURE_WEATHER, FUTURE_WIND[0], "target"])


def horizon_long(df: DataFrame, horizons: list[int], series: Series = HOURLY,
                 measure: str = "us_aqi", keep: list[str] | None = None) -> DataFrame:
    """All horizons at once: (keys, time, kept columns, horizon, target, weather at +h, ...).

    One shuffle reads every offset; the rows are unfolded after it, in place. Keep few base
    columns: every one of them is repeated for each horizon.
    """
    keep = keep if keep is not None else [measure]
    needed = list(dict.fromkeys([*series.keys, series.time, *keep, measure, *WEATHER]))
    store = horizon_store(df.select(*needed), max(horizons), series, measure, keep)
    whole = sorted(horizons) == list(range(1, max(horizons) + 1))
    return long_of(store, keep, series, None if whole else horizons)


def live_inputs(features: DataFrame, weather: DataFrame, horizons: int = 72,
                saved_order: list[str] | None = None, check: bool = True) -> DataFrame:
    """Model input rows for every horizon after the newest feature row of each series."""
    newest = latest_row(features.select(KEY, *FEATURE_COLUMNS))
    expanded = expand_horizons(newest, horizons)
    future = weather.select(
        KEY, TIME, *[F.col(s).alias(n) for n, s in FUTURE_WEATHER.items()],
        F.col(WIND_DIRECTION).alias("_future_direction"))
    rows = attach_future_weather(expanded, future, check=check).withColumns({
        **wind_sin_cos("_future_direction", "future_wind_direction"),
        **calendar_columns("forecast_time", TARGET_CALENDAR),
    })
    order = saved_order or MODEL_COLUMNS
    out = select_contract(rows, [KEY, TIME, "forecast_time", "horizon_hours", *order])
    if check:
        gone = [F.count_if(F.col(c).isNull()).alias(c) for c in order]
        nulls = {c: n for c, n in out.agg(*gone).first().asDict().items() if n}
        if nulls:
            raise DataContractError(f"model inputs are missing: {nulls}")
    return out
