"""Column contracts of the tables the library keeps.

Lists that must match the data providers are stated plainly; every derived
column name is generated from its rule (measure, kind, offset).
"""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "series_id"
TIME = "time"
HOUR_SECONDS = 3600
MAX_HORIZON = 72

# Variable names as the data providers deliver them.
POLLUTANTS = [
    "pm10", "pm2_5", "carbon_monoxide", "nitrogen_dioxide", "sulphur_dioxide",
    "ozone", "dust", "aerosol_optical_depth", "us_aqi",
]
WEATHER = [
    "temperature_2m", "relative_humidity_2m", "dew_point_2m", "surface_pressure",
    "precipitation", "cloud_cover", "wind_speed_10m", "wind_direction_10m",
    "wind_gusts_10m",
]
# The measures a row must have to be kept at all.
ESSENTIAL = [
    "pm10", "pm2_5", "carbon_monoxide", "nitrogen_dioxide", "sulphur_dioxide",
    "ozone", "us_aqi",
]
CALENDAR = ["hour", "day_of_week", "month", "is_weekend"]

# Offsets and windows of the feature contract, in steps.
LAG_STEPS = [1, 3, 6, 12, 24, 48, 72]
LONG_LAG = 168
MEAN_WINDOWS = [3, 6, 12, 24, 48, 72]
STD_WINDOWS = [24, 72]
REPORT_HORIZONS = [1, 6, 12, 24, 48, 72]
BASELINE_HORIZONS = [1, 6, 24, 48, 72]

# measure column -> prefix of the columns derived from it
PREFIX = {"us_aqi": "aqi", "pm2_5": "pm2_5", "pm10": "pm10"}
LAGS = {
    "us_aqi": LAG_STEPS + [LONG_LAG],
    "pm2_5": LAG_STEPS,
    "pm10": LAG_STEPS,
}


def lag_name(measure: str, steps: int) -> str:
    return f"{PREFIX.get(measure, measure)}_lag_{steps}h"


def mean_name(measure: str, window: int) -> str:
    return f"{PREFIX.get(measure, measure)}_mean_{window}h"


def std_name(measure: str, window: int) -> str:
    return f"{PREFIX.get(measure, measure)}_std_{window}h"


def change_name(measure: str, steps: int) -> str:
    return f"{PREFIX.get(measure, measure)}_change_{steps}h"


def target_name(horizon: int) -> str:
    return f"aqi_target_{horizon}h"


LAG_COLUMNS = [lag_name(m, k) for m in PREFIX for k in LAGS[m]]
MEAN_COLUMNS = [mean_name(m, n) for m in PREFIX for n in MEAN_WINDOWS]
CHANGE_COLUMNS = [change_name("us_aqi", k) for k in LAG_STEPS]
STD_COLUMNS = [std_name("us_aqi", n) for n in STD_WINDOWS]

MODEL_BASE_COLUMNS = (
    POLLUTANTS + WEATHER + CALENDAR + LAG_COLUMNS + MEAN_COLUMNS + CHANGE_COLUMNS + STD_COLUMNS
)
FEATURE_COLUMNS = [TIME] + MODEL_BASE_COLUMNS  # 72 columns
TARGET_COLUMNS = [target_name(h) for h in range(1, MAX_HORIZON + 1)]

# Weather at the target hour, output name -> source name.
FUTURE_WEATHER = {
    "future_temperature": "temperature_2m",
    "future_humidity": "relative_humidity_2m",
    "future_dew_point": "dew_point_2m",
    "future_pressure": "surface_pressure",
    "future_precipitation": "precipitation",
    "future_cloud_cover": "cloud_cover",
    "future_wind_speed": "wind_speed_10m",
    "future_wind_gusts": "wind_gusts_10m",
}
WIND_DIRECTION = "wind_direction_10m"
FUTURE_WIND = ["future_wind_direction_sin", "future_wind_direction_cos"]
TARGET_CALENDAR = ["target_hour", "target_day_of_week", "target_month", "target_is_weekend"]
HORIZON_EXTRAS = list(FUTURE_WEATHER) + FUTURE_WIND + TARGET_CALENDAR  # 14 columns
MODEL_COLUMNS = MODEL_BASE_COLUMNS + HORIZON_EXTRAS  # 85 columns

# Short-history model inputs (39): what the per-horizon linear and forest models use.
SHORT_FEATURES = (
    POLLUTANTS + WEATHER + CALENDAR
    + [lag_name("us_aqi", k) for k in (1, 3, 6, 12, 24)]
    + [lag_name(m, k) for m in ("pm2_5", "pm10") for k in (1, 24)]
    + [mean_name("us_aqi", n) for n in (3, 6, 12, 24)]
    + [mean_name(m, 24) for m in ("pm2_5", "pm10")]
    + [change_name("us_aqi", k) for k in (1, 3)]
)
LONG_FEATURES = [c for c in MODEL_BASE_COLUMNS if c not in SHORT_FEATURES]  # 32 columns

FIXED_HORIZON_CYCLES = [
    f"target_{unit}_{fn}_72h" for unit in ("hour", "day", "month") for fn in ("sin", "cos")
]
FIXED_HORIZON_EXTRAS = (
    [f"{c}_72h" for c in list(FUTURE_WEATHER) + FUTURE_WIND]
    + FIXED_HORIZON_CYCLES
    + ["target_is_weekend_72h"]
)  # 17 columns
ALL_FEATURES_72H = SHORT_FEATURES + LONG_FEATURES + FIXED_HORIZON_EXTRAS  # 88 columns
REDUCED_FEATURES_72H = (
    POLLUTANTS + WEATHER + CALENDAR
    + [lag_name("us_aqi", k) for k in (6, 24, 72, 168)]
    + [mean_name("us_aqi", n) for n in (24, 72)]
    + STD_COLUMNS
    + [change_name("us_aqi", k) for k in (24, 72)]
    + [c for m in ("pm2_5", "pm10")
       for c in [lag_name(m, 24), lag_name(m, 72), mean_name(m, 24), mean_name(m, 72)]]
    + FIXED_HORIZON_EXTRAS
)  # 57 columns

CYCLE_COLUMNS = [
    f"{base}_{fn}" for base in ("hour", "day_of_week", "month", "wind_direction")
    for fn in ("sin", "cos")
]
CYCLE_SOURCES = ["hour", "day_of_week", "month", WIND_DIRECTION]

PREDICTION_TYPES = {
    "forecast_generated_at": T.TimestampNTZType(),
    "forecast_time": T.TimestampNTZType(),
    "horizon_hours": T.LongType(),
    "predicted_aqi": T.DoubleType(),
    "forecast_temperature": T.DoubleType(),
    "forecast_humidity": T.DoubleType(),
    "forecast_precipitation": T.DoubleType(),
    "forecast_wind_speed": T.DoubleType(),
    "aqi_category": T.StringType(),
}


def hourly_schema(variables: list[str], with_key: bool = True) -> T.StructType:
    fields = [T.StructField(KEY, T.StringType())] if with_key else []
    fields.append(T.StructField(TIME, T.TimestampNTZType()))
    return T.StructType(fields + [T.StructField(v, T.DoubleType()) for v in variables])


AIR_SCHEMA = hourly_schema(POLLUTANTS)
WEATHER_SCHEMA = hourly_schema(WEATHER)


def feature_types() -> dict[str, T.DataType]:
    types: dict[str, T.DataType] = {c: T.DoubleType() for c in MODEL_BASE_COLUMNS}
    types.update({c: T.LongType() for c in CALENDAR})
    return {TIME: T.TimestampNTZType(), **{c: types[c] for c in MODEL_BASE_COLUMNS}}


def target_types() -> dict[str, T.DataType]:
    return {TIME: T.TimestampNTZType(), **{c: T.DoubleType() for c in TARGET_COLUMNS}}
