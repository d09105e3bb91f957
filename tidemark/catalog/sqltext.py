"""SQL text for feature columns, generated from the same fixed offsets."""

from tidemark.schemas import (
    FUTURE_WEATHER, LAG_STEPS, LAGS, MEAN_WINDOWS, PREFIX, STD_WINDOWS, change_name, lag_name,
    mean_name, std_name,
)

_W = "OVER (PARTITION BY series_id ORDER BY time"


def lag_sql(m, k, by_time=False):
    if by_time:
        return f"max({m}) {_W} RANGE BETWEEN INTERVAL {k} HOURS PRECEDING AND INTERVAL {k} HOURS PRECEDING)"
    return f"lag({m}, {k}) {_W})"


def lead_sql(m, k, by_time=False):
    if by_time:
        return f"max({m}) {_W} RANGE BETWEEN INTERVAL {k} HOURS FOLLOWING AND INTERVAL {k} HOURS FOLLOWING)"
    return f"lead({m}, {k}) {_W})"


def roll_sql(fn, m, n, by_time=False):
    frame = (f"{_W} RANGE BETWEEN INTERVAL {n - 1} HOURS PRECEDING AND CURRENT ROW)" if by_time
             else f"{_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
    return f"CASE WHEN count({m}) {frame} = {n} THEN {fn}({m}) {frame} END"


def lag_columns(measures=PREFIX, by_time=False):
    return [f"{lag_sql(m, k, by_time)} AS {lag_name(m, k)}" for m in measures for k in LAGS[m]]


def mean_columns(by_time=False):
    return [f"{roll_sql('avg', m, n, by_time)} AS {mean_name(m, n)}" for m in PREFIX for n in MEAN_WINDOWS]


def change_columns(by_time=False):
    return [f"us_aqi - {lag_sql('us_aqi', k, by_time)} AS {change_name('us_aqi', k)}" for k in LAG_STEPS]


def std_columns(by_time=False, digits=4):
    return [f"round({roll_sql('stddev_samp', 'us_aqi', n, by_time)}, {digits}) AS {std_name('us_aqi', n)}"
            for n in STD_WINDOWS]


def history_columns(by_time=False):
    return [*lag_columns(by_time=by_time), *mean_columns(by_time), *change_columns(by_time), *std_columns(by_time)]


def calendar_sql(t="time", names=("hour", "day_of_week", "month", "is_weekend"), kind="BIGINT"):
    parts = (f"hour({t})", f"isodow({t}) - 1", f"month({t})", f"CASE WHEN isodow({t}) >= 6 THEN 1 ELSE 0 END")
    return [f"CAST({p} AS {kind}) AS {n}" for p, n in zip(parts, names)]


def feature_sql(frame, by_time=False):
    """The feature contract over a merged frame, before rows with NULLs are dropped."""
    cols = ["*", *calendar_sql(), *history_columns(by_time)]
    return f"SELECT {', '.join(cols)} FROM {frame}"


def complete(columns):
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def future_weather_sql(h, by_time=False):
    return [f"{lead_sql(s, h, by_time)} AS {n}" for n, s in FUTURE_WEATHER.items()]
