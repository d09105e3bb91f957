"""Ordered work on keyed series: positions, chunks with halos, offset lookups.

A window over ``PARTITION BY series_id`` puts one whole series in one task, so a single hot
series would set the run time. Every ordered operator here instead cuts each series into
chunks of bounded length, gives each chunk a copy of the few neighbouring rows its frames
reach (the halo), runs the window per (series, chunk), and drops the copies. The result is
the same as the plain window, because no frame reaches beyond its halo.

Three meanings of "k steps back" are supported:

* ``time``   the row exactly k steps earlier, else NULL; chunks are cut by time. The default:
             a missing step never moves a value to another hour.
* ``dense``  k rows back; the caller vouches (see ``guards.assert_regular``) that no step is
             missing, so rows and steps are the same and chunks are cut by time.
* ``rows``   k rows back, gaps allowed; chunks are cut by exact row position.

All three need (keys, time) to be unique: run ``dedup_last`` first. A NULL time raises; NULL
keys are a series of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import epoch_seconds
from tidemark.schemas import HOUR_SECONDS, KEY, TIME

POS = "_pos"
CHUNK = "_chunk"
HOME = "_home"
MODES = ("dense", "rows", "time")

# Wide feature blocks hold hundreds of expressions. They are written as SQL text, because each
# Column object costs several calls into the JVM and building the plan would outlast the query.
At = Callable[[str, int], str]
Level = Callable[[At], dict[str, str]]


def quoted(name: str) -> str:
    return f"`{name}`"


@dataclass(frozen=True)
class Series:
    """How a table is keyed, ordered and spaced."""

    keys: tuple[str, ...] = (KEY,)
    time: str = TIME
    step_seconds: int = HOUR_SECONDS
    mode: str = "time"
    chunk_steps: int = 8192

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")

    def using(self, mode: str) -> "Series":
        return replace(self, mode=mode)

    @property
    def chunk_seconds(self) -> int:
        return self.chunk_steps * self.step_seconds


HOURLY = Series()


def known_seconds(series: "Series"):
    """Seconds of the time column; a row without a time has no place in its series and raises."""
    return F.when(F.col(series.time).isNull(), F.raise_error(F.lit(f"{series.time} must not be NULL"))).otherwise(
        epoch_seconds(series.time))


def row_index(df: DataFrame, series: Series = HOURLY, name: str = POS,
              total: str | None = None) -> DataFrame:
    """Zero-based position of each row in its series, and optionally the series length.

    Two levels: rows are numbered inside time buckets of bounded length, and the running sum
    of the (small) bucket counts gives each bucket its start. No task sees a whole series.
    """
    keys = list(series.keys)
    bucket = F.floor(known_seconds(series) / series.chunk_seconds)
    rows = df.withColumn("_bucket", bucket)
    order = Window.partitionBy(*keys).orderBy("_bucket")
    starts = (
        rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys, "_bucket",
            F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0)).alias("_start"),
            F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(series.time)
    numbered = rows.withColumn("_rn", F.row_number().over(inside) - 1).alias("r")
    on = [F.col(f"r.{quoted(k)}").eqNullSafe(F.col(f"s.{quoted(k)}")) for k in [*keys, "_bucket"]]
    placed = numbered.join(starts.alias("s"), on, "inner")
    extra = [F.col("_total").alias(total)] if total else []
    own = [F.col(f"r.{quoted(c)}") for c in df.columns]
    return placed.select(*own, (F.col("_start") + F.col("_rn")).alias(name), *extra)


def spread(df: DataFrame, series: Series, back: int, ahead: int) -> DataFrame:
    """Add position and chunk, copying each row into every chunk whose frames reach it."""
    if series.mode == "rows":
        placed, unit, size = row_index(df, series), 1, series.chunk_steps
    else:
        placed = df.withColumn(POS, known_seconds(series))
        unit, size = series.step_seconds, series.chunk_seconds
    first = F.floor((F.col(POS) - ahead * unit) / size)
    last = F.floor((F.col(POS) + back * unit) / size)
    return (
        placed.withColumn(CHUNK, F.explode(F.sequence(first, last)))
        .withColumn(HOME, F.col(CHUNK) == F.floor(F.col(POS) / size))
    )


def offset_lookup(series: Series) -> At:
    """``at(column, k)``: SQL for the column's value k steps earlier (later for negative k)."""
    over = f"PARTITION BY {', '.join(map(quoted, [*series.keys, CHUNK]))} ORDER BY {POS}"

    def at(column: str, k: int) -> str:
        c = quoted(column)
        if k == 0:
            return c
        if series.mode == "time":
            side = "PRECEDING" if k > 0 else "FOLLOWING"
            d = f"{abs(k) * series.step_seconds} {side}"
            return f"first({c}) OVER ({over} RANGE BETWEEN {d} AND {d})"
        return f"{'lag' if k > 0 else 'lead'}({c}, {abs(k)}) OVER ({over})"

    return at


def over_series(df: DataFrame, series: Series, back: int, ahead: int,
                levels: list[Level], keep: list[str] | None = None) -> DataFrame:
    """Add columns level by level on one shuffle; a level may use columns of earlier levels."""
    at = offset_lookup(series)
    out = spread(df, series, back, ahead)
    added: list[str] = []
    for level in levels:
        columns = level(at)
        added += [c for c in columns if c not in added]
        out = out.selectExpr("*", *[f"{text} AS {quoted(c)}" for c, text in columns.items()])
    final = keep if keep is not None else df.columns + [c for c in added if c not in df.columns]
    return out.where(HOME).select(*final)
