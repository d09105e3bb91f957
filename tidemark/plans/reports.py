"""Quality, exploration, forecast and model reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import day_of_week, hour_of, month_of
from tidemark.functions.scoring import (
    MONTHS, WEEKDAYS, alert_level, category, health_message, label_of, round_display,
)
from tidemark.operators.aggregates import (
    corr_matrix, corr_with, describe, duplicate_count, forecast_summary, histogram, mean_by,
    mean_metrics, null_counts, profile_range, series_by_model,
)
from tidemark.operators.keyed import extreme_row, time_gaps
from tidemark.operators.project import horizon_in
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.series import HOURLY, Series
from tidemark.operators.sets import union_all
from tidemark.schemas import KEY, POLLUTANTS, TIME, WEATHER, WIND_DIRECTION

CORRELATED = ["us_aqi"] + [c for c in POLLUTANTS if c != "us_aqi"] + [
    c for c in WEATHER if c != WIND_DIRECTION
]  # 17 measures

# Display names of the hourly forecast table.
DISPLAY_NAMES = {
    "forecast_time": "Time",
    "horizon_hours": "Horizon (h)",
    "predicted_aqi": "Predicted AQI",
    "aqi_category": "AQI Category",
    "forecast_temperature": "Temperature °C",
    "forecast_humidity": "Humidity %",
    "forecast_precipitation": "Precipitation mm",
    "forecast_wind_speed": "Wind Speed",
}
# Decimals shown per column.
DISPLAY_DIGITS = {
    "predicted_aqi": 1, "forecast_temperature": 1, "forecast_humidity": 1,
    "forecast_precipitation": 2, "forecast_wind_speed": 1,
}


def quality_report(df: DataFrame, series: Series = HOURLY) -> DataFrame:
    """Per series: rows, span, rows with any NULL, repeated keys, gaps."""
    keys = list(series.keys)
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(c).isNull()
    per_key = df.groupBy(*keys, series.time).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(any_null).alias("_nulls"))
    base = per_key.groupBy(*keys).agg(
        F.sum("_n").alias("row_count"), F.min(series.time).alias("min_time"),
        F.max(series.time).alias("max_time"), F.sum("_nulls").alias("rows_with_nulls"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"))
    gaps = time_gaps(df.select(*keys, series.time).distinct(), series).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("gaps"), F.max("gap_steps").alias("longest_gap_steps"))
    return base.join(gaps, keys, "left").na.fill(0, ["gaps"]).na.fill(0.0, ["longest_gap_steps"])


def distribution_report(df: DataFrame, measure: str, bins: int = 40) -> dict[str, DataFrame]:
    shown = [c for c in (TIME, measure) if c in df.columns]
    return {
        "summary": describe(df, measure),
        "histogram": histogram(df, measure, bins),
        "highest": extreme_row(df.select(*shown), measure, True),
        "lowest": extreme_row(df.select(*shown), measure, False),
    }


def cycle_report(df: DataFrame, measure: str) -> DataFrame:
    """(cycle, code, label, mean) for hour of day, weekday and month, from one scan.

    The data are first averaged down to (hour, weekday, month) cells as sums and counts, at most
    2,016 rows, and the three cycles are taken from those.
    """
    cells = df.groupBy(
        hour_of(TIME).alias("hour"), day_of_week(TIME).alias("day_of_week"), month_of(TIME).alias("month"),
    ).agg(F.sum(measure).alias("_s"), F.count(measure).alias("_n"))
    labels = {
        "hour": F.col("code").cast("string"),
        "day_of_week": label_of("code", WEEKDAYS),
        "month": label_of("code", MONTHS, first=1),
    }
    unfolded = cells.select("_s", "_n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("cycle"), F.col(c).alias("code")) for c in labels])))
    out = unfolded.groupBy("cycle", "code").agg((F.sum("_s") / F.sum("_n")).alias(f"mean_{measure}"))
    name = F.lit(None).cast("string")
    for cycle, text in labels.items():
        name = F.when(F.col("cycle") == cycle, text).otherwise(name)
    return out.withColumn("label", name)


def association_report(df: DataFrame, target: str, columns: list[str]) -> dict[str, DataFrame]:
    return {"matrix": corr_matrix(df, columns), "with_target": corr_with(df, target, columns)}


def forecast_headline(forecast: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    s = forecast_summary(forecast, by)
    return s.withColumns({
        "next_category": category("next_hour_aqi"),
        "max_category": category("max_aqi"),
        "message": health_message("max_aqi"),
        "alert": alert_level("max_aqi"),
    })


def forecast_table(forecast: DataFrame) -> DataFrame:
    """The hourly table as shown: rounded half-even, with display names."""
    rounded = forecast.withColumns({c: round_display(c, d) for c, d in DISPLAY_DIGITS.items()})
    return rounded.select(*[F.col(c).alias(n) for c, n in DISPLAY_NAMES.items()])


def key_horizons(forecast: DataFrame) -> DataFrame:
    return horizon_in(forecast).select(
        "horizon_hours", "forecast_time", round_display("predicted_aqi", 1).alias("predicted_aqi"),
        "aqi_category")


def model_comparison(*metrics: DataFrame, models: list[str]) -> dict[str, DataFrame]:
    rows = union_all(*metrics)
    return {
        "rows": rows,
        "by_model": series_by_model(rows, models),
        "means": mean_metrics(rows, ("model",)),
    }


def year_month_means(df: DataFrame, measure: str) -> DataFrame:
    """One row per year, one column per month."""
    codes = list(range(1, 13))
    pivoted = df.groupBy(F.year(TIME).alias("year"), F.month(TIME).alias("_month")).agg(
        F.avg(measure).alias("_mean")).groupBy("year").pivot("_month", codes).agg(F.first("_mean"))
    return pivoted.withColumnsRenamed({str(c): m.lower() for c, m in zip(codes, MONTHS)})


def source_checks(df: DataFrame) -> dict[str, DataFrame]:
    """The separate tables printed after loading a source."""
    return {"range": profile_range(df), "nulls": null_counts(df),
            "duplicates": duplicate_count(df, [KEY, TIME]), "gaps": time_gaps(df)}


def hour_means(df: DataFrame, measure: str) -> DataFrame:
    return mean_by(df, hour_of(TIME), "hour", measure)


def drift_report(df: DataFrame, columns: list[str], period: Column, reference: Column, bins: int = 10,
                 floor: float = 1e-4) -> DataFrame:
    """How far each period's distribution of each column lies from the reference rows' one.

    (period, feature, rows, psi, ks): bins have the reference's exact quantiles as edges, so each holds an equal
    share of it; psi is the population stability index with shares of at least ``floor``, ks the greatest
    distance of the cumulative shares at the edges. Errors of a forecast are a column like any other. NULL
    and NaN are left out; without reference rows ks is NULL and psi compares with ``floor``. One scan counts all columns, periods and bins; what follows has a row a bin.
    """
    shares = [k / bins for k in range(1, bins)]
    edges = {c: sorted({e for e in exact_quantiles(df.where(reference), c, shares) if e is not None}) for c in columns}

    def bin_of(c: str) -> Column:
        above = [F.when(F.col(c).cast("double") > F.lit(e), 1).otherwise(0) for e in edges[c]]
        return sum(above, F.lit(0))

    known = [F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")),
                    F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin"))) for c in columns]
    cells = df.select(period.alias("period"), reference.alias("_reference"), F.explode(F.array_compact(F.array(*known))).alias("_x"))
    counted = cells.groupBy("period", "_x.feature", "_x.bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_reference").alias("r"))
    grid = counted.select("period", "feature").distinct().select(
        "period", "feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    basis = counted.groupBy("feature", "bin").agg(F.sum("r").alias("r"))
    full = grid.join(counted.drop("r"), ["period", "feature", "bin"], "left").join(basis, ["feature", "bin"], "left").na.fill(0, ["n", "r"])
    group = Window.partitionBy("period", "feature")
    upto = group.orderBy("bin")
    share = lambda c, over: F.try_divide(F.sum(c).over(over), F.sum(c).over(group))
    own = lambda c: F.try_divide(F.col(c), F.sum(c).over(group))
    shares_ = full.withColumns({"p": own("n"), "q": own("r"), "cp": share("n", upto), "cq": share("r", upto)})
    p, q = F.greatest("p", F.lit(floor)), F.greatest("q", F.lit(floor))  # greatest leaves NULL out
    return shares_.groupBy("period", "feature").agg(
        F.sum("n").alias("rows"), F.sum(F.when((F.col("n") > 0) | (F.col("r") > 0), (p - q) * F.log(p / q)).otherwise(0.0)).alias("psi"),
        F.max(F.abs(F.col("cp") - F.col("cq"))).alias("ks"))
