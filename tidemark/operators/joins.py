"""Equi joins of sources, labels, horizons and future weather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import add_hours
from tidemark.operators.errors import DataContractError
from tidemark.operators.keyed import dedup_last
from tidemark.operators.series import HOURLY, Series, over_series
from tidemark.schemas import KEY, MAX_HORIZON, TIME


def join_sources(air: DataFrame, weather: DataFrame, keys: tuple[str, ...] = (KEY, TIME),
                 order: str | None = None) -> DataFrame:
    """Rows both sources have; with ``order`` each side keeps its last delivery per key.

    Deduplication and join use the same key, so each side is shuffled once for both.
    """
    if order:
        air = dedup_last(air, list(keys), [order]).drop(order)
        weather = dedup_last(weather, list(keys), [order]).drop(order)
    return air.join(weather, list(keys), "inner")


def join_targets(features: DataFrame, targets: DataFrame, keys: tuple[str, ...] = (KEY, TIME),
                 order: str | None = None, must_match: bool = False) -> DataFrame:
    out = join_sources(features, targets, keys, order)
    if must_match and out.isEmpty():
        raise DataContractError("no feature row has a label row")
    return out


def training_view(features: DataFrame, targets: DataFrame, name: str, how: str = "inner",
                  keys: tuple[str, ...] = (KEY, TIME)) -> DataFrame:
    out = features.join(targets, list(keys), how)
    out.createOrReplaceTempView(name)
    return out


def lookup_at_offset(df: DataFrame, column: str, offsets: list[int], series: Series = HOURLY,
                     name=lambda k: f"value_at_{k}h") -> DataFrame:
    """Value of ``column`` exactly k steps later; NULL where there is no such row.

    All offsets are read on one shuffle with single-row range frames, instead of one self join
    for each of them.
    """
    by_time = series.using("time")
    return over_series(df, by_time, 0, max(offsets), [
        lambda at: {name(k): at(column, -k) for k in offsets}
    ])


def expand_horizons(latest: DataFrame, horizons: int | list[int] = MAX_HORIZON,
                    time: str = TIME) -> DataFrame:
    """One row per horizon with its target hour; a literal list, so no join is needed."""
    hs = list(range(1, horizons + 1)) if isinstance(horizons, int) else horizons
    out = latest.withColumn("horizon_hours", F.explode(F.array(*[F.lit(h) for h in hs])))
    return out.withColumn("forecast_time", add_hours(time, F.col("horizon_hours")))


def attach_future_weather(rows: DataFrame, weather: DataFrame,
                          keys: tuple[str, ...] = (KEY,), check: bool = True) -> DataFrame:
    """Weather of the target hour; every row must find exactly one match when checked."""
    future = weather.withColumnRenamed(TIME, "forecast_time")
    on = [*keys, "forecast_time"]
    if check:
        wanted = rows.select(*on).distinct()
        own = future.select(*on).join(wanted, on, "left_semi")  # the hours asked for, not all weather there is
        counted = wanted.join(own.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), on, "left")
        bad = counted.where(F.coalesce("_n", F.lit(0)) != 1).orderBy(*on).limit(10).collect()
        if bad:
            hours = ", ".join(f"{r['forecast_time']} ({r['_n'] or 0} rows)" for r in bad)
            raise DataContractError(f"future weather must have one row per hour: {hours}")
    return rows.join(future, on, "inner")


def missing_keys(required: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    return required.select(*keys).distinct().join(available.select(*keys), keys, "left_anti")


def require_keys(required: DataFrame, available: DataFrame, keys: list[str]) -> None:
    gone = missing_keys(required, available, keys).orderBy(*keys).limit(10).collect()
    if gone:
        raise DataContractError("missing: " + ", ".join(str(tuple(r)) for r in gone))


def rejoin_features_labels(features: DataFrame, labels: DataFrame,
                           keys: tuple[str, ...] = (KEY, TIME)) -> DataFrame:
    return features.join(labels, list(keys), "inner")
