"""Queries for the streaming forms: each stream is run to the end over a whole table."""


from pyspark.sql import functions as F

from tidemark.catalog.frames import air, hourly_by_type, redelivered, weather, with_frames
from tidemark.catalog.features import k1_sql, shaped
from tidemark.catalog.registry import query
from tidemark.catalog.sqltext import complete, lead_sql
from tidemark.plans import incremental as inc
from tidemark.schemas import KEY, POLLUTANTS, TIME, WEATHER, target_name
from tidemark.session import scratch_path
from tidemark.sources.tables import create_table
from tidemark.streaming import jobs


def landed(spark, df, label, files_a_batch=None):
    """Landed files as a stream source, by time; all in one micro-batch, or a few at a time."""
    path = scratch_path(spark, label)
    df.repartitionByRange(6, TIME).write.parquet(path)
    reader = spark.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)


def finished(spark, stream):
    path, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    jobs.run_to_parquet(stream, path, checkpoint)
    return spark.read.schema(stream.schema).parquet(path)


@query("i13_dedup_stream", with_frames("f5", "SELECT DISTINCT series_id, time, pm2_5, pm10 FROM f5"))
def _(spark, d):
    rows = redelivered(spark, d)
    out = finished(spark, jobs.dedup_stream(landed(spark, rows, "landed"), [KEY, TIME]))
    return out.select(KEY, TIME, "pm2_5", "pm10")


@query("i13_dedup_stream_first", with_frames("f1", "SELECT series_id, time, us_aqi, pm2_5, pm10 FROM f1"))
def _(spark, d):
    """Second deliveries with other values land after the first: within the 48 hours kept they are repeats, before that too late."""
    rows, path = redelivered(spark, d), scratch_path(spark, "landed")
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    for seq in (1, 2):
        rows.where(F.col("ingest_seq") == seq).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        jobs.run_to_parquet(jobs.dedup_stream(stream, [KEY, TIME]), out, checkpoint)
    return spark.read.schema(rows.schema).parquet(out).select(KEY, TIME, "us_aqi", "pm2_5", "pm10")


@query("i13_keep_last_stream", with_frames("f5", "SELECT series_id, time, us_aqi, pm2_5, pm10, ingest_seq FROM f5 QUALIFY row_number() OVER "
       "(PARTITION BY series_id, time ORDER BY ingest_seq DESC) = 1"))
def _(spark, d):
    rows = redelivered(spark, d)
    t = create_table(spark, scratch_path(spark, "tables"), "hourly", 1, (KEY, TIME), TIME)
    jobs.upsert_stream(landed(spark, rows, "landed", 2), t, scratch_path(spark, "checkpoint"), "ingest_seq").awaitTermination()
    return t.read()


@query("i14_join_sources_stream", with_frames("pair_err", "SELECT * FROM pair_err"))
def _(spark, d):
    left, right = landed(spark, air(spark, d), "air"), landed(spark, weather(spark, d, only_errors=True), "weather")
    return finished(spark, jobs.join_sources_stream(left, right)).select(KEY, TIME, *POLLUTANTS, *WEATHER)


@query("i8_label_stream", with_frames(
    "f2", "SELECT a.series_id, a.time, CAST(epoch(b.time - a.time) / 3600 AS INTEGER) AS horizon, b.us_aqi AS target FROM f2 a JOIN f2 b "
    "ON a.series_id = b.series_id AND b.time > a.time AND b.time <= a.time + INTERVAL 72 HOUR"))
def _(spark, d):
    rows = hourly_by_type(spark, d).select(KEY, TIME, "us_aqi")
    return finished(spark, jobs.label_stream(landed(spark, rows, "landed")))


@query("i8_label_tables", with_frames("f2", "SELECT * FROM (SELECT series_id, time, " + ", ".join(
    f"{lead_sql('us_aqi', h, True)} AS {target_name(h)}" for h in range(1, 73)) + " FROM fixed) WHERE " + complete([target_name(h) for h in range(1, 73)]),
    fixed="SELECT series_id, time, CASE WHEN hour(time) % 6 = 0 THEN us_aqi + 1 ELSE us_aqi END AS us_aqi FROM f2"))
def _(spark, d):
    """Values land in several batches out of order, a sixth of them is corrected afterwards: the wide rows are those of the batch form."""
    rows = hourly_by_type(spark, d).select(KEY, TIME, "us_aqi")
    again = rows.where(F.hour(TIME) % 6 == 0).withColumn("us_aqi", F.col("us_aqi") + 1)
    root, keys, path, checkpoint = scratch_path(spark, "tables"), (KEY, TIME), scratch_path(spark, "landed"), scratch_path(spark, "checkpoint")
    values, wide = [create_table(spark, root, n, 1, keys, TIME) for n in ("values", "wide")]
    long_ = create_table(spark, root, "labels", 1, (KEY, TIME, "horizon"), TIME)
    early = F.dayofmonth(TIME) < 20
    schema = rows.withColumn("ingest_seq", F.lit(1)).schema
    for k, part in enumerate((rows.where(~early), rows.where(early), again)):
        part.withColumn("ingest_seq", F.lit(k)).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        jobs.label_tables(stream, long_, wide, values, checkpoint, "ingest_seq").awaitTermination()
    return wide.read()


@query("i4_ingest_stream", with_frames("pair", k1_sql("pair", True)))
def _(spark, d):
    """Landed rows -> air table -> feature table, inside foreachBatch."""
    root = scratch_path(spark, "tables")
    keys = (KEY, TIME)
    a = create_table(spark, root, "air", 1, keys, TIME)
    w = create_table(spark, root, "weather", 1, keys, TIME)
    feats = create_table(spark, root, "features", 2, keys, TIME)
    w.upsert(weather(spark, d))
    stream = landed(spark, air(spark, d), "landed", 2)
    jobs.ingest_features(stream, w, a, feats, scratch_path(spark, "checkpoint")).awaitTermination()
    return shaped(feats.read())


@query("i4_ingest_late_weather", with_frames("pair", k1_sql("pair", True)))
def _(spark, d):
    """Weather that lands after its air hours still yields their feature rows."""
    root = scratch_path(spark, "tables")
    a, w, feats = [create_table(spark, root, n, v, (KEY, TIME), TIME) for n, v in (("air", 1), ("weather", 1), ("features", 2))]
    early = F.col(TIME) < F.lit("2024-01-10").cast("timestamp_ntz")
    both = weather(spark, d)
    w.upsert(both.where(early))
    jobs.ingest_features(landed(spark, air(spark, d), "landed", 3), w, a, feats, scratch_path(spark, "checkpoint")).awaitTermination()
    late = landed(spark, both.where(~early), "late", 3)
    jobs.ingest_weather(late, w, a, feats, scratch_path(spark, "checkpoint")).awaitTermination()
    return shaped(feats.read())


_CORRECTED = ("CASE WHEN time IN (TIMESTAMP '2024-01-03 05:00:00', TIMESTAMP '2024-01-29 07:00:00') THEN us_aqi + 7 ELSE us_aqi END AS us_aqi")


@query("i4_distant_corrections", with_frames("pair", k1_sql("fixed", True), fixed=f"SELECT * REPLACE ({_CORRECTED}) FROM pair"))
def _(spark, d):
    """Two hours far apart are corrected after the table was filled: two islands are engineered again."""
    root = scratch_path(spark, "tables")
    a, w, feats = [create_table(spark, root, n, v, (KEY, TIME), TIME) for n, v in (("air", 1), ("weather", 1), ("features", 2))]
    rows = air(spark, d)
    w.upsert(weather(spark, d))
    checkpoint = scratch_path(spark, "checkpoint")
    jobs.ingest_features(landed(spark, rows, "landed"), w, a, feats, checkpoint).awaitTermination()
    late = rows.where(F.col(TIME).cast("string").isin("2024-01-03 05:00:00", "2024-01-29 07:00:00"))
    late = landed(spark, late.withColumn("us_aqi", F.col("us_aqi") + 7), "late")
    jobs.ingest_features(late, w, a, feats, scratch_path(spark, "checkpoint")).awaitTermination()
    return shaped(feats.read())


@query("i4_touched_intervals", with_frames(
    "f2", "SELECT series_id, min(time) - INTERVAL 192 HOUR AS fetch_from, min(time) AS recompute_from, least(max(time) + INTERVAL 168 HOUR, any_value(last)) "
    "AS latest FROM (SELECT *, sum(first) OVER (PARTITION BY series_id ORDER BY time) AS island FROM (SELECT f2.series_id, f2.time, last, CASE WHEN "
    "f2.time - INTERVAL 360 HOUR <= lag(f2.time) OVER (PARTITION BY f2.series_id ORDER BY f2.time) THEN 0 ELSE 1 END AS first "
    "FROM f2 JOIN (SELECT series_id, max(time) AS last FROM f2 GROUP BY series_id) m ON m.series_id = f2.series_id WHERE day(f2.time) IN (2, 28))) GROUP BY series_id, island"))
def _(spark, d):
    """The spans that an arbitrary set of changed hours makes necessary, several a series."""
    rows = hourly_by_type(spark, d)
    return inc.touched_intervals(rows.where(F.dayofmonth(TIME).isin(2, 28)).select(KEY, TIME), inc.high_water_mark(rows))
