"""Structured Streaming forms of the incremental operators.

Watermarks need TIMESTAMP, while the tables keep TIMESTAMP_NTZ; columns are cast on the way in
and out under a UTC session, where both show the same clock. Window functions do not exist on
streams, so features are computed inside ``foreachBatch`` over the stored tail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.calendar import epoch_seconds
from tidemark.plans.incremental import (
    _staged, bounds_of, forecast_rows, plan_days, recompute_tail, stored_marks, touched_intervals, within_spans,
)
from tidemark.plans.horizons import AHEAD, with_later
from tidemark.plans.models import check_horizons
from tidemark.operators.guards import validate_batch
from tidemark.operators.series import HOURLY
from tidemark.operators.project import cast_schema
from tidemark.plans.features import ALL_FEATURE_COLUMNS
from tidemark.schemas import KEY, MAX_HORIZON, TIME, feature_types, target_name
from tidemark.sources.tables import KeyedTable, _fs_delete

LATE = "48 hours"
EVENT = "_event"


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone.upper() not in ("UTC", "ETC/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"streaming jobs need a UTC session, not {zone}")


def watermarked(df: DataFrame, name: str = EVENT, delay: str = LATE) -> DataFrame:
    return df.withColumn(name, F.col(TIME).cast("timestamp")).withWatermark(name, delay)


def dedup_stream(df: DataFrame, keys: list[str], delay: str = LATE) -> DataFrame:
    """One delivery per (series, hour): the first to arrive. State is ``delay`` of keys."""
    require_utc(df.sparkSession)
    kept = watermarked(df, EVENT, delay).dropDuplicatesWithinWatermark([*[k for k in keys if k != TIME], EVENT])
    return kept.drop(EVENT)


def join_sources_stream(air: DataFrame, weather: DataFrame, delay: str = LATE) -> DataFrame:
    """Rows of the same hour from both sources, either one late by up to ``delay``.

    The equality on the event time lets Spark drop state once the watermark has passed it.
    """
    require_utc(air.sparkSession)
    left = watermarked(air, "_air_event", delay)
    right = watermarked(weather, "_weather_event", delay).withColumnRenamed(KEY, "_key").drop(TIME)
    on = (F.col(KEY) == F.col("_key")) & (F.col("_air_event") == F.col("_weather_event"))
    return left.join(right, on, "inner").drop("_key", "_air_event", "_weather_event")


def label_stream(features: DataFrame, horizons: int = 72, delay: str = LATE,
                 measure: str = "us_aqi") -> DataFrame:
    """Long label rows (series, time, horizon, target) as later hours arrive.

    A row at ``t`` needs the values in (t, t + H]. Both sides carry the number of an H-hour
    block, the later side under its own block and the one before, so the join is an equality on
    (series, block) and a hot series is spread over its blocks.
    """
    require_utc(features.sparkSession)
    seconds = horizons * 3600
    base = features.select(
        KEY, TIME, F.col(TIME).cast("timestamp").alias("_t1"),
        F.floor(epoch_seconds(TIME) / seconds).alias("_block"),
    ).withWatermark("_t1", delay)
    own = F.floor(epoch_seconds(TIME) / seconds)
    later = features.select(
        F.col(KEY).alias("_key"), F.col(measure).alias("target"),
        F.col(TIME).cast("timestamp").alias("_t2"),
        F.explode(F.array(own, own - 1)).alias("_later_block"),
    ).withWatermark("_t2", delay)
    on = (
        (F.col(KEY) == F.col("_key")) & (F.col("_block") == F.col("_later_block"))
        & (F.col("_t2") > F.col("_t1"))
        & (F.col("_t2") <= F.col("_t1") + F.expr(f"interval {horizons} hours"))
    )
    hours = ((F.unix_timestamp("_t2") - F.unix_timestamp("_t1")) / 3600).cast("int")
    return base.join(later, on, "inner").select(KEY, TIME, hours.alias("horizon"), "target")


def label_tables(values: DataFrame, labels: KeyedTable, wide: KeyedTable, stored: KeyedTable, checkpoint: str,
                 order: str | None = None, horizons: int = MAX_HORIZON, measure: str = "us_aqi") -> StreamingQuery:
    """Landed values -> long labels (series, time, horizon, target) and the wide row once all horizons are there.

    A value that lands or is corrected changes the labels of the ``horizons`` hours before it and completes its
    own. Each batch is stored (last delivery wins), the spans it touches are read back, and every label in
    them is made again: a corrected hour revises its 72 labels and the wide rows of those hours that are complete.
    Repeating a batch changes nothing, and values may come in any order and at any age.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        paths = [_staged(spark, batch)]
        try:
            landed = spark.read.schema(batch.schema).parquet(paths[0])
            if landed.isEmpty():
                return
            stored.upsert(landed, order, stored=True)
            plan = touched_intervals(landed.select(KEY, TIME), stored_marks(stored), horizons, horizons)
            paths.append(_staged(spark, plan))
            plan = spark.read.schema(plan.schema).parquet(paths[-1])
            rows = within_spans(stored.read([KEY, TIME, measure], days=plan_days(plan, stored)), plan, "fetch_from", "latest")
            known = rows.where(F.col(measure).isNotNull())
            ahead = with_later(known, horizons, HOURLY, {"target": measure}).select(KEY, TIME, AHEAD).where(F.size(AHEAD) > 0)
            paths.append(_staged(spark, ahead))
            ahead = spark.read.schema(ahead.schema).parquet(paths[-1])
            if ahead.isEmpty():
                return
            labels.upsert(ahead.select(KEY, TIME, F.inline(AHEAD)), unique=True)
            whole = ahead.where(F.size(AHEAD) == horizons).select(KEY, TIME, *[
                F.get(AHEAD, F.lit(h - 1))["target"].alias(target_name(h)) for h in range(1, horizons + 1)])
            wide.upsert(whole, unique=True)
        finally:
            for path in paths:
                _fs_delete(spark, path)

    return (values.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingest_features(air_raw: DataFrame, weather: KeyedTable, air: KeyedTable, features: KeyedTable,
                    checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Landed air rows -> air table -> feature rows, one micro-batch at a time."""
    return _ingest(air_raw, air, weather, air, features, checkpoint, order)


def ingest_weather(weather_raw: DataFrame, weather: KeyedTable, air: KeyedTable, features: KeyedTable,
                   checkpoint: str, order: str | None = None) -> StreamingQuery:
    """The same for landed weather: hours that come after their air, or are corrected.

    Not to run at the same time as the air side: a table has one writer.
    """
    return _ingest(weather_raw, weather, weather, air, features, checkpoint, order)


def _ingest(raw: DataFrame, own: KeyedTable, weather: KeyedTable, air: KeyedTable, features: KeyedTable,
            checkpoint: str, order: str | None) -> StreamingQuery:
    """Each batch is stored, then what it touches in every series is engineered again from the stored
    rows: a changed hour reaches REACH_HOURS ahead and no further, and hours far apart are islands of
    their own (see touched_intervals). Only the days of those spans are read, and the newest hours come
    from the air table's marks. Storing and upserting are idempotent, so a batch that is repeated after a
    failure changes nothing. There is no watermark here: gaps of any age are filled.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        paths = [_staged(spark, batch)]
        try:
            landed = spark.read.schema(batch.schema).parquet(paths[0])
            if landed.isEmpty():
                return
            own.upsert(landed, order, stored=True)
            if not (air.exists() and weather.exists()):
                return
            plan = touched_intervals(landed.select(KEY, TIME), stored_marks(air))
            paths.append(_staged(spark, plan))
            plan = spark.read.schema(plan.schema).parquet(paths[-1])
            low, high, _ = bounds_of(plan)
            if low is None:  # no air from there on yet
                return
            rows = cast_schema(recompute_tail(air.read(days=plan_days(plan, air)), weather.read(days=plan_days(plan, weather)),
                                              plan, "by_time", fetch_from=low, latest=high), feature_types())
            paths.append(_staged(spark, rows))
            rows = spark.read.schema(rows.schema).parquet(paths[-1])
            if not rows.isEmpty():
                validate_batch(rows, ALL_FEATURE_COLUMNS, [KEY, TIME])
                features.upsert(rows, stored=True, unique=True)
        finally:
            for path in paths:
                _fs_delete(spark, path)

    return (raw.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def forecast_stream(features: DataFrame, weather: DataFrame | KeyedTable, models: dict[int, object], inputs: list[str],
                    forecasts: KeyedTable, checkpoint: str, horizons: int = 72, history: KeyedTable | None = None,
                    name: str | None = None) -> StreamingQuery:
    """New feature rows -> the weather of their next hours -> one model a horizon -> the forecast table.

    Each micro-batch forecasts from the newest row it brings for a series, unless that series already has a
    forecast from a newer row: a late row must not bring an old forecast back. The static weather side is read
    anew for each batch, narrowed to the target hours. A batch is published under its number in the same
    step that makes its rows visible, so one that is repeated after a failure publishes once. Numbers belong to
    a checkpoint: ``name`` (by default the checkpoint's path) has to change with it.
    """
    check_horizons(models, horizons)
    name = name or f"forecast {checkpoint}"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if forecasts.exists() and forecasts.snapshot().batches.get(name, -1) >= batch_id:
            return
        path = _staged(spark, batch)
        try:
            rows = spark.read.schema(batch.schema).parquet(path)
            if forecasts.exists():
                made = F.max(F.col("forecast_generated_at")).alias("_made")
                # a series' newest run covers its newest forecast hour: the rows from the oldest of these on tell
                since = forecasts.marks().agg(F.min("stored_max")).first()[0]
                rows = rows.join(forecasts.read([KEY, "forecast_generated_at"], since=since).groupBy(KEY).agg(made), [KEY], "left")
                rows = rows.where(F.col("_made").isNull() | (F.col(TIME) >= F.col("_made"))).drop("_made")
            low, high = rows.agg(F.min(TIME), F.max(TIME)).first()
            if low is None:
                return
            future = weather.read(since=low) if isinstance(weather, KeyedTable) else weather
            hours = F.col(TIME).between(F.lit(low), F.lit(high) + F.expr(f"INTERVAL {horizons} HOURS"))
            forecast_rows(rows, future.where(hours), models, inputs, forecasts, horizons, history, (name, batch_id))
        finally:
            _fs_delete(spark, path)

    return (features.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def upsert_stream(df: DataFrame, table: KeyedTable, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Keep-last form of deduplication: each batch is upserted."""
    def step(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, order)

    return (df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_to_parquet(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over everything available and append it to a Parquet folder."""
    query = (df.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
