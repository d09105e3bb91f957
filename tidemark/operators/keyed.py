"""One row out of many: last per key, newest, extreme, n-th; gaps and missing steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import add_seconds, epoch_seconds, from_epoch_seconds
from tidemark.operators.series import HOURLY, POS, Series, over_series, row_index
from tidemark.schemas import KEY, TIME


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest ``order`` per key.

    A ``row_number() = 1`` filter lets Spark drop losers before the shuffle as well, so a key
    with very many copies reaches its task as one row per input task.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def extreme_row(df: DataFrame, value: str, largest: bool, by: tuple[str, ...] = (),
                tie: str = TIME) -> DataFrame:
    """The whole row holding the largest or smallest value; the earliest one on ties."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    near = _with_extreme(known, by, value, largest)
    return _one_by(_with_extreme(near, by, tie, False), by, F.min_by, tie)


def _with_extreme(df: DataFrame, by: tuple[str, ...], column: str, largest: bool) -> DataFrame:
    """The rows that hold the extreme of a column: a hash aggregate over keys and that column, then an equi join,
    so the whole rows are neither sorted nor shuffled where the extremes are few enough to broadcast."""
    best = df.groupBy(*[F.col(k).alias(f"_by_{k}") for k in by]).agg((F.max if largest else F.min)(column).alias("_best"))
    on = F.col(column) == F.col("_best")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    return df.join(best, on).select(*df.columns)


def _one_by(df: DataFrame, by: tuple[str, ...], pick, order: str) -> DataFrame:
    """One row a group, out of the few that are left."""
    rest = F.struct(*[c for c in df.columns if c not in by])
    return (df.groupBy(*by).agg(pick(rest, order).alias("_row")).where("_row IS NOT NULL")
            .select(*by, "_row.*").select(*df.columns))


def latest_row(df: DataFrame, by: tuple[str, ...] = (KEY,), time: str = TIME) -> DataFrame:
    return _one_by(_with_extreme(df, by, time, True), by, F.max_by, time)


def first_row(df: DataFrame, by: tuple[str, ...] = (), time: str = TIME) -> DataFrame:
    rest = F.struct(*[c for c in df.columns if c not in by])
    return (df.groupBy(*by).agg(F.min_by(rest, time).alias("_row")).where("_row IS NOT NULL")
            .select(*by, "_row.*").select(*df.columns))


def nth_row(df: DataFrame, position: Column, series: Series = HOURLY) -> DataFrame:
    """Row at a zero-based position in its series; ``position`` may use ``_total``."""
    placed = row_index(df, series, total="_total")
    return placed.where(F.col(POS) == position).select(*df.columns)


def middle_row(df: DataFrame, series: Series = HOURLY) -> DataFrame:
    return nth_row(df, F.floor(F.col("_total") / 2), series)


def time_gaps(df: DataFrame, series: Series = HOURLY) -> DataFrame:
    """Rows that come more than one step after the row before them."""
    by_row = series.using("rows")
    seconds = F.col("_seconds")
    out = over_series(df.select(*series.keys, series.time), by_row, 1, 0, [
        lambda at: {"_previous": at(series.time, 1)},
    ]).withColumn("_seconds", epoch_seconds(series.time) - epoch_seconds("_previous"))
    return out.where(seconds > series.step_seconds).select(
        *series.keys, F.col("_previous").alias("previous_time"), series.time,
        (seconds / series.step_seconds).alias("gap_steps"),
    )


def step_grid(bounds: DataFrame, low: str, high: str, series: Series = HOURLY) -> DataFrame:
    """Every step from ``low`` to ``high`` for each row of ``bounds``.

    The range is cut into chunks that are spread over tasks before they are filled in.
    """
    step, size = series.step_seconds, series.chunk_seconds
    start, end = epoch_seconds(low), epoch_seconds(high)
    chunks = (
        bounds.where(start <= end)
        .select(*series.keys, end.alias("_end"), F.explode(F.sequence(start, end, F.lit(size))).alias("_from"))
        .repartition(*series.keys, "_from")
    )
    return chunks.select(
        *series.keys,
        F.explode(F.sequence("_from", F.least(F.col("_from") + (size - step), F.col("_end")),
                             F.lit(step))).alias("_at"),
    ).select(*series.keys, from_epoch_seconds("_at").alias(series.time))


def own_grid(df: DataFrame, series: Series = HOURLY) -> DataFrame:
    """The complete spine between the first and last row of each series."""
    bounds = df.groupBy(*series.keys).agg(
        F.min(series.time).alias("_low"), F.max(series.time).alias("_high"))
    return step_grid(bounds, "_low", "_high", series)


def missing_steps(df: DataFrame, series: Series = HOURLY) -> DataFrame:
    """Steps of the spine that have no row."""
    on = [*series.keys, series.time]
    return own_grid(df, series).join(df.select(*on), on, "left_anti")


def densify(df: DataFrame, series: Series = HOURLY) -> DataFrame:
    """The spine with the known rows on it and NULL measures elsewhere."""
    return own_grid(df, series).join(df, [*series.keys, series.time], "left").select(*df.columns)


def next_step(time: Column | str, series: Series = HOURLY) -> Column:
    return add_seconds(time, series.step_seconds)
