"""Checks that run before anything is written; each is one aggregate over the data."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import epoch_seconds
from tidemark.operators.errors import DataContractError
from tidemark.operators.keyed import time_gaps
from tidemark.operators.series import HOURLY, Series

GAP_POLICIES = ("error", "warn", "by_time")


def non_empty(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise DataContractError(message)
    return df


def irregular_series(df: DataFrame, series: Series = HOURLY) -> DataFrame:
    """Series whose row count does not fill their time span.

    With unique times this is the same as having a gap, and costs one partial aggregate.
    """
    low, high = epoch_seconds(F.min(series.time)), epoch_seconds(F.max(series.time))
    return (
        df.groupBy(*series.keys)
        .agg(F.count(series.time).alias("rows"),
             ((high - low) / series.step_seconds + 1).alias("expected"))
        .where("rows <> expected")
    )


def assert_regular(df: DataFrame, series: Series = HOURLY, policy: str = "error",
                   show: int = 10) -> bool:
    """True when no step is missing. ``error`` raises, ``warn`` reports, ``by_time`` skips."""
    if policy not in GAP_POLICIES:
        raise ValueError(f"policy must be one of {GAP_POLICIES}")
    if policy == "by_time":
        return False
    if irregular_series(df, series).isEmpty():
        return True
    found = time_gaps(df, series).orderBy(*series.keys, series.time).limit(show).collect()
    text = "; ".join(f"{[r[k] for k in series.keys]} {r['previous_time']} -> {r[series.time]}"
                     for r in found)
    if policy == "error":
        raise DataContractError(f"steps are missing: {text}")
    warnings.warn(f"steps are missing: {text}", stacklevel=2)
    return False


def validate_batch(df: DataFrame, columns: list[str], keys: list[str],
                   exact_rows_per: tuple[tuple[str, ...], int] | None = None) -> int:
    """Exact columns, at least one row, no NULL or NaN, unique keys. Returns the row count."""
    if df.columns != columns:
        raise DataContractError(f"columns differ: {df.columns} instead of {columns}")
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    bad = [
        F.count_if(F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()).alias(c)
        for c in columns
    ]
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *bad).first()
    if counts["_rows"] == 0:
        raise DataContractError("the batch is empty")
    nulls = {c: counts[c] for c in columns if counts[c]}
    if nulls:
        raise DataContractError(f"missing values: {nulls}")
    twice = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if twice:
        raise DataContractError(f"repeated keys: {[tuple(r)[:-1] for r in twice]}")
    if exact_rows_per:
        group, n = exact_rows_per
        off = df.groupBy(*group).count().where(F.col("count") != n).limit(5).collect()
        if off:
            raise DataContractError(f"expected {n} rows per {group}: {[tuple(r) for r in off]}")
    return counts["_rows"]


def same_order(saved: list[str], current: list[str]) -> None:
    if list(saved) != list(current):
        raise DataContractError("model input columns differ from the saved order")
