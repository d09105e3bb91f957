"""Chronological train / validation / test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import epoch_seconds
from tidemark.operators.quantiles import time_quantile
from tidemark.operators.series import HOURLY, POS, Series, row_index
from tidemark.schemas import TIME

PART = "part"


def split_by_index(df: DataFrame, fraction: float = 0.8, series: Series = HOURLY) -> DataFrame:
    """First ``int(n * fraction)`` rows of each series by time are ``train``."""
    placed = row_index(df, series, total="_total")
    return placed.withColumn(
        PART, F.when(F.col(POS) < F.floor(F.col("_total") * fraction), "train").otherwise("test")
    ).select(*df.columns, PART)


def split_nested(df: DataFrame, outer: float = 0.8, inner: float = 0.8,
                 series: Series = HOURLY) -> DataFrame:
    """Train and validation inside the first ``outer`` share, test after it."""
    placed = row_index(df, series, total="_total")
    cut = F.floor(F.col("_total") * outer)
    return placed.withColumn(
        PART,
        F.when(F.col(POS) < F.floor(cut * inner), "train")
        .when(F.col(POS) < cut, "validation").otherwise("test"),
    ).select(*df.columns, PART)


def split_by_time(df: DataFrame, boundary, time: str = TIME, purge_hours: int = 0) -> DataFrame:
    """``train`` before the boundary, ``test`` from it on.

    ``purge_hours`` drops the training rows whose label would lie inside the test period.
    """
    b = F.lit(boundary).cast("timestamp_ntz")
    out = df.withColumn(PART, F.when(F.col(time) < b, "train").otherwise("test"))
    if purge_hours:
        late = epoch_seconds(time) + purge_hours * 3600 >= epoch_seconds(b)
        out = out.where((F.col(PART) == "test") | ~late)
    return out


def quantile_boundary(df: DataFrame, probability: float = 0.8, time: str = TIME) -> float | None:
    return time_quantile(df, time, probability)


def split_by_quantile(df: DataFrame, probability: float = 0.8, time: str = TIME) -> DataFrame:
    """Boundary at an interpolated quantile of the times of the whole table."""
    boundary = quantile_boundary(df, probability, time)
    return df.withColumn(
        PART, F.when(epoch_seconds(time) < F.lit(boundary), "train").otherwise("test"))
