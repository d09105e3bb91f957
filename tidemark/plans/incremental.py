"""Keeping feature, label and forecast tables current."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import add_seconds, epoch_seconds, from_epoch_seconds, latest_completed
from tidemark.operators.errors import DataContractError
from tidemark.operators.guards import assert_regular, validate_batch
from tidemark.operators.keyed import missing_steps
from tidemark.operators.series import HOURLY, Series
from tidemark.plans.features import (
    ALL_FEATURE_COLUMNS, ALL_TARGET_COLUMNS, POLICY_MODE, clean_sources, feature_table,
    wide_targets,
)
from tidemark.operators.project import cast_schema
from tidemark.plans.horizons import live_inputs
from tidemark.plans.models import check_horizons, score_horizons
from tidemark.schemas import KEY, MAX_HORIZON, PREDICTION_TYPES, TIME, feature_types, target_types
from tidemark.sources.tables import DAY_COLUMN, FORMATS, NEWEST, OLDEST, KeyedTable, _fs_delete

# fixed values: hours that a run refreshes, and hours it reads before them
REFRESH_HOURS = 48
LOOKBACK_HOURS = 192
REACH_HOURS = 168  # the longest look back of any feature: so far ahead a changed hour is felt


def high_water_mark(df: DataFrame, series: Series = HOURLY) -> DataFrame:
    """Newest stored time per series."""
    return df.groupBy(*series.keys).agg(F.max(series.time).alias("stored_max"))


def require_marks(marks: DataFrame) -> DataFrame:
    if marks.isEmpty():
        raise DataContractError("the stored table is empty; run a backfill first")
    return marks


def first_holes(stored: DataFrame, series: Series = HOURLY) -> DataFrame:
    """Earliest missing step inside each series, for plans that also repair old holes."""
    return missing_steps(stored, series).groupBy(*series.keys).agg(F.min(series.time).alias("first_hole"))


def refresh_plan(marks: DataFrame, now, refresh: int = REFRESH_HOURS,
                 lookback: int = LOOKBACK_HOURS, holes: DataFrame | None = None,
                 series: Series = HOURLY) -> DataFrame:
    """What to recompute and how far back to read, one row per series; refresh and lookback count steps."""
    at = F.lit(now).cast("timestamp_ntz") if not hasattr(now, "cast") else now
    step = series.step_seconds
    newest = latest_completed(at) if series == HOURLY else from_epoch_seconds(
        F.floor(epoch_seconds(at) / step) * step - step)
    plan = marks if holes is None else marks.join(holes, list(series.keys), "left")
    candidates = ["next_missing", "refresh_start"] + (["first_hole"] if holes is not None else [])
    return (
        plan.withColumn("latest", newest)
        .withColumn("next_missing", add_seconds("stored_max", step))
        .withColumn("refresh_start", add_seconds("latest", -(refresh - 1) * step))
        .withColumn("recompute_from", F.least(*candidates))
        .withColumn("fetch_from", add_seconds("recompute_from", -lookback * step))
    )


def touched_intervals(touched: DataFrame, newest: DataFrame, reach: int = REACH_HOURS,
                      lookback: int = LOOKBACK_HOURS, series: Series = HOURLY) -> DataFrame:
    """Plan rows (keys, fetch_from, recompute_from, latest) for changed steps: one for each island of them.

    A changed step is felt ``reach`` steps ahead and needs ``lookback`` steps before it. Steps whose fetched spans
    meet make one island, so spans of one series never overlap, and two corrections a year apart cost
    two short spans instead of a year. ``newest`` (keys, stored_max) ends the last span. Steps are first
    reduced to their extremes by blocks of ``reach``, so a series costs a row a block, not a row a step.
    """
    keys, step = list(series.keys), series.step_seconds
    at = epoch_seconds(series.time)
    blocks = touched.groupBy(*keys, F.floor(at / (reach * step)).alias("_block")).agg(
        F.min(at).alias("_from"), (F.max(at) + reach * step).alias("_to"))
    order = Window.partitionBy(*keys).orderBy("_block")
    starts = (F.col("_from") - lookback * step > F.lag("_to").over(order)) | F.lag("_to").over(order).isNull()
    islands = blocks.withColumn("_starts", starts.cast("int")).withColumn("_island", F.sum("_starts").over(order))
    spans = islands.groupBy(*keys, "_island").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    last = newest.select(*keys, epoch_seconds("stored_max").alias("_last"))
    ends = spans.join(last, keys).withColumn("_to", F.least("_to", "_last")).where("_from <= _to")
    return ends.select(*keys, from_epoch_seconds(F.col("_from") - lookback * step).alias("fetch_from"),
                       from_epoch_seconds("_from").alias("recompute_from"), from_epoch_seconds("_to").alias("latest"))


def plan_days(plan: DataFrame, table: KeyedTable, low: str = "fetch_from", high: str = "latest") -> list[str]:
    """Days (or months) of a table that a plan's spans lie in: what a scan has to list, a few hundred a year."""
    first, last = F.to_date(low), F.to_date(high)
    days = plan.select(F.explode(F.sequence(first, last)).alias("d")).select(
        F.date_format("d", FORMATS[table.period]).alias(DAY_COLUMN)).distinct()
    return sorted(r[0] for r in days.collect())


def within_spans(df: DataFrame, plan: DataFrame, low: str, high: str, series: Series = HOURLY) -> DataFrame:
    """Rows inside one of their series' spans; the spans of a series must not overlap.

    An equi join on (series, day) with the days the spans cover, so no row meets all spans of its series.
    """
    days = plan.select(*series.keys, F.col(low).alias("_low"), F.col(high).alias("_high"),
                       F.explode(F.sequence(F.to_date(low), F.to_date(high))).alias("_day"))
    return df.withColumn("_day", F.to_date(series.time)).join(days, [*series.keys, "_day"], "inner").where(
        F.col(series.time).between(F.col("_low"), F.col("_high"))).select(*df.columns)


def recompute_tail(air: DataFrame, weather: DataFrame, plan: DataFrame, gap_policy: str = "by_time",
                   order: str | None = None, series: Series = HOURLY,
                   fetch_from=None, latest=None) -> DataFrame:
    """Feature rows in [recompute_from, latest], engineered over the fetched span only. A series may have
    several plan rows as long as their spans don't overlap (see touched_intervals).

    ``fetch_from`` and ``latest`` are the overall bounds as literals: they reach the scans,
    while the plan narrows each series further.
    """
    span = plan.select(*series.keys, "fetch_from", "recompute_from", "latest")

    def fetched(df: DataFrame) -> DataFrame:
        if fetch_from is not None:
            df = df.where(F.col(TIME) >= F.lit(fetch_from).cast("timestamp_ntz"))
        if latest is not None:
            df = df.where(F.col(TIME) <= F.lit(latest).cast("timestamp_ntz"))
        return within_spans(df, span, "fetch_from", "latest", series)

    merged = clean_sources(fetched(air), fetched(weather), order)
    if gap_policy == "error":
        assert_regular(merged, series, "error")
    rows = feature_table(merged, series.using(POLICY_MODE[gap_policy]))
    return within_spans(rows, span, "recompute_from", "latest", series)


def bounds_of(plan: DataFrame):
    """Overall scan bounds of a plan: one aggregate row for the driver."""
    row = plan.agg(F.min("fetch_from").alias("f"), F.max("latest").alias("l"),
                   F.min("recompute_from").alias("r")).first()
    return row["f"], row["l"], row["r"]


def stored_marks(table: KeyedTable) -> DataFrame:
    """Newest stored time of each series out of the table's own marks: no scan of its rows."""
    if not table.exists():
        raise DataContractError("the stored table is empty; run a backfill first")
    return table.marks().withColumnRenamed(NEWEST, "stored_max").drop(OLDEST)


def refresh_features(table: KeyedTable, air: DataFrame, weather: DataFrame, now,
                     gap_policy: str = "error", order: str | None = None,
                     repair_holes: bool = False) -> DataFrame:
    """One hourly run: plan, fetch, engineer, validate, upsert. Returns the run report, which is also kept
    in the table's run log. Only ``repair_holes`` reads the stored times; marks come from the table."""
    spark = table.spark
    holes = first_holes(table.read([KEY, TIME])) if repair_holes else None
    plan = refresh_plan(stored_marks(table), now, holes=holes)
    paths = [_staged(spark, plan)]
    try:
        plan = spark.read.schema(plan.schema).parquet(paths[0])
        low, high, _ = bounds_of(plan)
        rows = recompute_tail(air, weather, plan, gap_policy, order, fetch_from=low, latest=high)
        rows = cast_schema(rows, feature_types())
        paths.append(_staged(spark, rows))
        staged = spark.read.schema(rows.schema).parquet(paths[1])
        validate_batch(staged, ALL_FEATURE_COLUMNS, [KEY, TIME])
        run = append_run_log(run_report(plan.select(KEY, "stored_max"), staged), f"{table.path}/_runs", uuid.uuid4().hex)
        table.upsert(staged, stored=True, unique=True)
    finally:
        for path in paths:
            _fs_delete(spark, path)
    return run


def _staged(spark: SparkSession, rows: DataFrame) -> str:
    """Write a batch to the shared folder once, so that checks and upsert read the same rows."""
    from tidemark.session import scratch_path

    path = scratch_path(spark, "batch")
    rows.write.parquet(path)
    return path


def run_report(marks: DataFrame, batch: DataFrame, series: Series = HOURLY) -> DataFrame:
    """Per series: old newest time, new rows, refreshed rows, new newest time."""
    joined = batch.select(*series.keys, series.time).join(marks, list(series.keys), "inner")
    return joined.groupBy(*series.keys).agg(
        F.first("stored_max").alias("old_max"),
        F.count_if(F.col(series.time) > F.col("stored_max")).alias("new_rows"),
        F.count_if(F.col(series.time) <= F.col("stored_max")).alias("refreshed_rows"),
        F.greatest(F.max(series.time), F.first("stored_max")).alias("new_max"))


def append_run_log(report: DataFrame, path: str, run_id: str) -> DataFrame:
    """Keep a run's report under its id; returns it as stored."""
    own = f"{path}/run_id={run_id}"
    report.write.parquet(own)
    return report.sparkSession.read.schema(report.schema).parquet(own)


def mature_targets(features: DataFrame, existing: DataFrame | None = None,
                   horizons: int = MAX_HORIZON, series: Series = HOURLY,
                   measure: str = "us_aqi") -> DataFrame:
    """Label rows that have become complete since the newest stored one, by exact time."""
    marks = features.groupBy(*series.keys).agg(
        F.max(series.time).alias(NEWEST), F.min(series.time).alias(OLDEST))
    stored = None if existing is None else high_water_mark(existing.select(*series.keys, series.time), series)
    return mature_rows(features, mature_plan(marks, stored, horizons, series), horizons, series, measure)


def mature_plan(marks: DataFrame, stored: DataFrame | None, horizons: int = MAX_HORIZON,
                series: Series = HOURLY) -> DataFrame:
    """(keys, since, until): the hours whose labels are complete and not stored yet, for the series that have any.

    ``marks`` holds the features' oldest and newest time, ``stored`` the labels' newest one."""
    plan = marks.withColumn("until", add_seconds(NEWEST, -horizons * series.step_seconds))
    if stored is None:
        plan = plan.withColumn("since", F.col(OLDEST))
    else:
        known = stored.select(*series.keys, F.col("stored_max").alias("_labelled"))
        plan = plan.join(known, list(series.keys), "left").withColumn(
            "since", F.coalesce(add_seconds("_labelled", series.step_seconds), F.col(OLDEST)))
    return plan.select(*series.keys, "since", "until").where("since <= until")


def mature_rows(features: DataFrame, plan: DataFrame, horizons: int = MAX_HORIZON, series: Series = HOURLY,
                measure: str = "us_aqi") -> DataFrame:
    # values up to until + horizons are needed, and nothing before since
    needed = features.select(*series.keys, series.time, measure).join(
        plan, list(series.keys), "inner").where(F.col(series.time) >= F.col("since"))
    labels = wide_targets(needed.drop("since", "until"), horizons, series.using("time"), measure)
    return labels.join(plan, list(series.keys), "inner").where(
        F.col(series.time).between(F.col("since"), F.col("until"))).select(*labels.columns)


def refresh_targets(table: KeyedTable, features: DataFrame | KeyedTable, gap_policy: str = "error") -> int:
    """One daily run: check, label, validate, upsert. Returns new rows (0 is a clean stop).

    With a stored feature table the plan comes from both tables' marks, and only the days from the oldest
    unlabelled hour on are read; the gap check then covers those days."""
    spark = table.spark
    labelled = stored_marks(table) if table.exists() else None
    if isinstance(features, KeyedTable):
        marks = features.marks()
    else:
        features = features.select(KEY, TIME, "us_aqi")
        marks = features.groupBy(KEY).agg(F.max(TIME).alias(NEWEST), F.min(TIME).alias(OLDEST))
    plan = mature_plan(marks, labelled)
    paths = [_staged(spark, plan)]
    try:
        plan = spark.read.schema(plan.schema).parquet(paths[0])
        since = plan.agg(F.min("since")).first()[0]
        if isinstance(features, KeyedTable):
            if since is None:
                return 0
            narrow = features.read([KEY, TIME, "us_aqi"], since=since)
        else:
            narrow = features
        assert_regular(narrow, HOURLY, gap_policy)
        if since is None:
            return 0
        labels = cast_schema(mature_rows(narrow.where(F.col(TIME) >= F.lit(since).cast("timestamp_ntz")), plan), target_types())
        paths.append(_staged(spark, labels))
        staged = spark.read.schema(labels.schema).parquet(paths[1])
        if staged.isEmpty():
            return 0
        count = validate_batch(staged, ALL_TARGET_COLUMNS, [KEY, TIME])
        table.upsert(staged, stored=True, unique=True)
    finally:
        for path in paths:
            _fs_delete(spark, path)
    return count


def upsert_forecast(table: KeyedTable, forecast: DataFrame, history: KeyedTable | None = None,
                    stream: tuple[str, int] | None = None) -> int:
    """The newest forecast of an hour replaces older ones; history keeps every run."""
    days = table.upsert(forecast, order="forecast_generated_at", stream=stream)
    if history is not None:
        history.upsert(forecast, stream=stream)
    return days


def publish_forecast(table: KeyedTable, forecast: DataFrame, horizons: int = MAX_HORIZON,
                     history: KeyedTable | None = None, stream: tuple[str, int] | None = None) -> DataFrame:
    """Check a run's rows (columns, nulls, keys, exactly one row a horizon) before any write.

    Returns the table's rows of the run's hours, from the run's oldest feature time on."""
    rows = cast_schema(forecast, PREDICTION_TYPES).select(KEY, *PREDICTION_TYPES)
    path = _staged(table.spark, rows)
    try:
        staged = table.spark.read.schema(rows.schema).parquet(path)
        validate_batch(staged, [KEY, *PREDICTION_TYPES], [KEY, "forecast_time"], exact_rows_per=((KEY,), horizons))
        low, high, made = staged.agg(F.min("forecast_time"), F.max("forecast_time"), F.min("forecast_generated_at")).first()
        upsert_forecast(table, staged, history, stream)
    finally:
        _fs_delete(table.spark, path)
    return table.read(since=low).where((F.col("forecast_time") <= F.lit(high)) & (F.col("forecast_generated_at") >= F.lit(made)))


def run_forecast(features: KeyedTable, weather: DataFrame, models: dict[int, object], inputs: list[str],
                 forecasts: KeyedTable, horizons: int = MAX_HORIZON, history: KeyedTable | None = None) -> DataFrame:
    """The live forecast: newest feature row of each series, weather of the target hours, one model a
    horizon, clamped values, checks, upsert. Returns the published rows.

    The newest times come from the table's marks; only the days from the oldest of them on are read."""
    check_horizons(models, horizons)
    since = require_marks(stored_marks(features)).agg(F.min("stored_max")).first()[0]
    return forecast_rows(features.read(since=since), weather, models, inputs, forecasts, horizons, history)


def forecast_rows(rows: DataFrame, weather: DataFrame, models: dict[int, object], inputs: list[str], forecasts: KeyedTable,
                  horizons: int = MAX_HORIZON, history: KeyedTable | None = None,
                  stream: tuple[str, int] | None = None) -> DataFrame:
    """Score the newest of the given feature rows of each series and publish the checked forecast."""
    spark = forecasts.spark
    ready = live_inputs(rows, weather, horizons, inputs)
    path = _staged(spark, ready)
    try:
        stored = spark.read.schema(ready.schema).parquet(path)
        return publish_forecast(forecasts, score_horizons(models, stored, inputs), horizons, history, stream)
    finally:
        _fs_delete(spark, path)
