"""Projections, filters, casts and contracts on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.errors import DataContractError
from tidemark.schemas import KEY, REPORT_HORIZONS, TIME


def nan_to_null(df: DataFrame) -> DataFrame:
    """Readers call this once, so that missing means NULL everywhere else."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def select_contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; extra ones go, missing ones are an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataContractError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def known_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NULL in the columns (readers have turned NaN into NULL).

    One predicate per column instead of ``dropna``: its single all-column predicate makes the
    optimizer's constraint set double with every derived column it mentions.
    """
    return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)) if columns else df


def drop_null_essential(df: DataFrame, columns: list[str]) -> DataFrame:
    return known_rows(df, columns)


def drop_null_any(df: DataFrame) -> DataFrame:
    return known_rows(df, df.columns)


def drop_null_model(df: DataFrame, features: list[str], target: str) -> DataFrame:
    return known_rows(df, [*features, target])


def between_time(df: DataFrame, low, high, time: str = TIME) -> DataFrame:
    return df.where(F.col(time).between(low, high))


def before_boundary(df: DataFrame, boundary, time: str = TIME) -> DataFrame:
    return df.where(F.col(time) < boundary)


def after_boundary(df: DataFrame, boundary, time: str = TIME) -> DataFrame:
    return df.where(F.col(time) >= boundary)


def limit_source(df: DataFrame, newest, time: str = TIME) -> DataFrame:
    """Nothing after the newest completed step; a plain filter, so it reaches the scan."""
    return df.where(F.col(time) <= newest)


def horizon_in(df: DataFrame, horizons: list[int] = REPORT_HORIZONS,
               column: str = "horizon_hours") -> DataFrame:
    return df.where(F.col(column).isin(horizons))


def horizon_le(df: DataFrame, last: int, column: str = "horizon_hours") -> DataFrame:
    return df.where(F.col(column) <= last)


def equals_filter(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value)


def cast_schema(df: DataFrame, types: dict) -> DataFrame:
    names = {c: t if isinstance(t, str) else t.simpleString() for c, t in types.items()}
    return df.selectExpr(*[
        f"CAST(`{c}` AS {names[c]}) AS `{c}`" if c in names else f"`{c}`" for c in df.columns])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def literal_column(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def unpivot_targets(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Wide labels to (keys, horizon, target); the horizon is read from the column name."""
    keys = keys or [KEY, TIME]
    long = df.unpivot(keys, columns, "_name", "target")
    horizon = F.regexp_extract("_name", r"_(\d+)h$", 1).cast("int")
    return long.select(*keys, horizon.alias("horizon"), "target")


def preview(df: DataFrame, n: int = 5, order: list[Column | str] | None = None) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def top_k(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 42, n: int | None = None) -> DataFrame:
    """All rows (or the first ``n``) in a pseudo-random order.

    The order comes from a hash of the key and the seed, so a task that is run again on
    another executor gives the same rows.
    """
    out = df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)
    return out if n is None else out.limit(n)
