"""Reports as aggregates. Grouped forms take ``by``; all of them combine partial results."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles
from tidemark.schemas import TIME


def profile_range(df: DataFrame, time: str = TIME, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(time).alias("min_time"), F.max(time).alias("max_time"))


def null_counts(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """(column_name, null_count) for every column, from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column_name", "null_count")
    return long.where("null_count > 0") if only_missing else long


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key; NULL is a key value like any other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of one measure."""
    q = exact_quantiles(df, column, [0.25, 0.5, 0.75])
    c = F.col(column)
    return df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        *[F.lit(v).cast("double").alias(n) for n, v in zip(("p25", "p50", "p75"), q)],
        F.max(c).alias("max"))


def mean_and_median(df: DataFrame, column: str) -> DataFrame:
    (median,) = exact_quantiles(df, column, [0.5])
    return df.agg(F.avg(column).alias("mean"), F.lit(median).cast("double").alias("median"))


def mean_by(df: DataFrame, group: Column, name: str, measure: str,
            label: Column | None = None) -> DataFrame:
    out = df.groupBy(group.alias(name)).agg(F.avg(measure).alias(f"mean_{measure}"))
    return out if label is None else out.withColumn(f"{name}_name", label)


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(left, right, correlation), each over the rows where both are known; NULL for a constant measure.

    Rows without a gap go through Spark's own correlation of vectors: one buffer for all pairs instead
    of one each. A first pass tells; with gaps, each pair has rows of its own and its own buffer.
    """
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    gap = F.lit(False)
    for c in columns:
        gap = gap | F.col(c).isNull() | F.isnan(c)
    seen = values.agg(F.count(F.lit(1)).alias("n"), F.count_if(gap).alias("gaps")).first()
    if seen["n"] and not seen["gaps"]:
        vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(values).select("_v")
        matrix = Correlation.corr(vectors, "_v").first()[0].toArray()  # as many numbers as pairs of columns
        at = {c: i for i, c in enumerate(columns)}
        rows = [(x, y, float(matrix[at[x], at[y]])) for x, y in pairs]
        found = df.sparkSession.createDataFrame(rows, "left string, right string, correlation double")
        return found.withColumn("correlation", F.when(~F.isnan("correlation"), F.col("correlation")))
    stats = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ])
    return stats.select(F.inline(rows))


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """All unordered pairs; mirror them for the square form."""
    return correlations(df, [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]])


def corr_with(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    return (correlations(df, [(target, c) for c in columns])
            .select(F.col("right").alias("variable"), "correlation")
            .orderBy(F.desc("correlation"), "variable"))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins from min to max, the last one closed; empty bins are kept.

    The bounds are a scalar subquery and the counts a partial aggregate of ``bins`` groups.
    """
    bounds = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    c = F.col(column)
    width = (high - low) / bins
    slot = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((c - low) / width), F.lit(bins - 1)))
    counted = df.where(c.isNotNull()).groupBy(slot.cast("int").alias("_slot")).agg(
        F.count(F.lit(1)).alias("_n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("_slot"))
    return spine.join(counted, "_slot", "left").select(
        (F.col("_slot") + 1).alias("bin"),
        (low + width * F.col("_slot")).alias("bin_low"),
        (low + width * (F.col("_slot") + 1)).alias("bin_high"),
        F.coalesce("_n", F.lit(0)).alias("count"))


def regression_metrics(df: DataFrame, y: str, yhat: str, by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE and R2 per group in one pass.

    The total sum of squares is ``n * var_pop(y)``, which Spark computes by merging centred
    moments, so it is as stable as a second pass. A constant ``y`` gives a NULL R2.
    """
    e = F.col(y) - F.col(yhat)
    known = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"))


def mean_metrics(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"), F.avg("r2").alias("mean_r2"))


def training_mean(df: DataFrame, target: str, is_train: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.when(is_train, F.col(target))).alias("training_mean"))


def split_counts(df: DataFrame, is_train: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(is_train).alias("training_rows"), F.count_if(~is_train).alias("test_rows"))


def forecast_summary(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Next value, window means and extreme hours of a forecast, in one aggregate."""
    p, h, t = F.col("predicted_aqi"), F.col("horizon_hours"), F.col("forecast_time")
    order = h.cast("long")
    return df.groupBy(*by).agg(
        F.min_by(p, h).alias("next_hour_aqi"),
        F.avg(p).alias("mean_all"),
        F.avg(F.when(h <= 24, p)).alias("mean_24h"),
        F.avg(F.when(h <= 48, p)).alias("mean_48h"),
        F.avg(F.when(h <= 72, p)).alias("mean_72h"),
        F.max(p).alias("max_aqi"),
        F.max_by(t, F.struct(p, -order)).alias("max_time"),
        F.min(p).alias("min_aqi"),
        F.min_by(t, F.struct(p, order)).alias("min_time"))


def prediction_extent(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("forecast_time").alias("min_forecast_time"),
        F.max("forecast_time").alias("max_forecast_time"),
        F.min("predicted_aqi").alias("min_predicted"), F.max("predicted_aqi").alias("max_predicted"))


def series_by_model(metrics: DataFrame, models: list[str], value: str = "mae") -> DataFrame:
    """One row per horizon, one column per model. The model list is given, so no extra job."""
    return metrics.groupBy("horizon").pivot("model", models).agg(F.first(value))


def new_vs_refreshed(df: DataFrame, stored_max, time: str = TIME, by: tuple[str, ...] = ()) -> DataFrame:
    t = F.col(time)
    return df.groupBy(*by).agg(
        F.count_if(t > stored_max).alias("new_rows"),
        F.count_if(t <= stored_max).alias("refreshed_rows"))


def observe_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Row count taken while another action runs, without a pass of its own."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")), watch


def row_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(step, rows, columns) on both sides of a step."""
    def counted(df: DataFrame, step: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(step).alias("step"), "rows", F.lit(len(df.columns)).alias("columns"))
    return counted(before, "before").unionByName(counted(after, "after"))
