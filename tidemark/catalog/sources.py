"""Queries for scans, sources and sinks (inventory A)."""

from pyspark.sql import functions as F

from tidemark.catalog.frames import (
    air, daily_orders, forecast, hourly_all, hourly_by_type, redelivered, table, with_frames,
)
from tidemark.catalog.registry import query
from tidemark.operators.project import limit_source
from tidemark.operators.sets import union_all
from tidemark.operators.errors import DataContractError
from tidemark.plans.features import wide_targets
from tidemark.schemas import KEY, POLLUTANTS, TIME, hourly_schema
from tidemark.session import scratch_path
from tidemark.sources.files import (
    plan_chunks, read_csv, read_hourly_json, write_csv, write_forecast, write_hourly_json,
)
from tidemark.sources.tables import create_table, read_training_set, table_meta, write_training_set

NTZ = "timestamp_ntz"


@query("a1_read_hourly_json", with_frames("air", "SELECT * FROM air"))
def _(spark, d):
    path = scratch_path(spark, "payload")
    write_hourly_json(air(spark, d), path, POLLUTANTS)
    return read_hourly_json(spark, path, POLLUTANTS)


@query("a2_read_csv", with_frames("f1", "SELECT series_id, time, us_aqi, pm2_5, pm10 FROM f1"))
def _(spark, d):
    path = scratch_path(spark, "csv")
    write_csv(hourly_all(spark, d), path)
    return read_csv(spark, path, hourly_schema(["us_aqi", "pm2_5", "pm10"]))


@query("a3_write_csv", with_frames("f2", "SELECT series_id, time, us_aqi FROM f2"))
def _(spark, d):
    path = scratch_path(spark, "csv")
    write_csv(hourly_by_type(spark, d).select(KEY, TIME, "us_aqi"), path)
    return read_csv(spark, path, hourly_schema(["us_aqi"]))


def _orders_table(spark, d):
    t = create_table(spark, scratch_path(spark, "tables"), "orders", 1, ("o_orderkey",), "o_orderdate", "month")
    t.upsert(table(spark, d, "orders"))
    return t


@query("a6_create_table", "SELECT 'orders' AS name, CAST(1 AS BIGINT) AS version, 'o_orderkey' AS key, 'o_orderdate' AS event_time, count(*) AS rows, "
       "CAST(2 AS BIGINT) AS snapshots, (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') AS rows_of_first FROM orders")
def _(spark, d):
    """Created once and got again; its record, its rows now, and its rows as of the first of two snapshots."""
    rows, root = table(spark, d, "orders"), scratch_path(spark, "tables")
    early = F.col("o_orderdate") < F.lit("1998-01-01 00:00:00").cast(NTZ)
    t = create_table(spark, root, "orders", 1, ("o_orderkey",), "o_orderdate", "month")
    t.upsert(rows.where(early))
    t = create_table(spark, root, "orders", 1, ("o_orderkey",), "o_orderdate", "month")
    t.upsert(rows.where(~early))
    return table_meta(t).select(
        "name", "version", F.col("keys")[0].alias("key"), "event_time", F.lit(t.read().count()).cast("long").alias("rows"),
        F.lit(t.snapshot().number).cast("long").alias("snapshots"), F.lit(t.read(as_of=1).count()).cast("long").alias("rows_of_first"))


@query("a4_read_table", "SELECT * FROM orders")
def _(spark, d):
    return _orders_table(spark, d).read()


@query("a5_read_table_columns",
       "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def _(spark, d):
    return _orders_table(spark, d).read(["o_orderkey", "o_totalprice"], since="1998-01-01 00:00:00")


@query("a7_upsert", with_frames(
    "f1", "SELECT series_id, time, CASE WHEN hour(time) % 6 = 0 THEN us_aqi + 1 ELSE us_aqi END AS us_aqi, "
    "pm2_5, pm10 FROM f1"))
def _(spark, d):
    rows = redelivered(spark, d)
    t = create_table(spark, scratch_path(spark, "tables"), "hourly", 1, (KEY, TIME), TIME)
    t.upsert(rows.where("ingest_seq = 1").drop("ingest_seq"))
    t.upsert(rows.where("ingest_seq = 2").drop("ingest_seq"))
    return t.read()


_TRAIN_BODY = (
    "SELECT * FROM (SELECT series_id, time, us_aqi, pm2_5, pm10, "
    + ", ".join(f"lead(us_aqi, {h}) OVER (ORDER BY time) AS aqi_target_{h}h" for h in range(1, 73))
    + " FROM f1) WHERE aqi_target_72h IS NOT NULL")
_TRAIN = with_frames("f1", _TRAIN_BODY)


def _training(spark, d):
    f1 = hourly_all(spark, d)
    root = scratch_path(spark, "training")
    labels = [f"aqi_target_{h}h" for h in range(1, 73)]
    from tidemark.catalog.windows import ROWS
    version = write_training_set(f1.join(wide_targets(f1, 72, ROWS), [KEY, TIME]), root)
    return read_training_set(spark, root, version, [KEY, TIME], labels)


@query("a7_upsert_order", with_frames("f5", "SELECT series_id, time, us_aqi, pm2_5, pm10, ingest_seq FROM f5 QUALIFY "
       "row_number() OVER (PARTITION BY series_id, time ORDER BY ingest_seq DESC) = 1"))
def _(spark, d):
    """One batch that repeats keys: refused without an order, the last delivery wins with one."""
    rows = redelivered(spark, d)
    t = create_table(spark, scratch_path(spark, "tables"), "hourly", 1, (KEY, TIME), TIME)
    try:
        t.upsert(rows)
    except DataContractError:
        t.upsert(rows, "ingest_seq")
    return t.read()


@query("a8_write_training_set", _TRAIN)
def _(spark, d):
    x, y = _training(spark, d)
    return x.join(y, [KEY, TIME])


@query("a9_read_training_set", with_frames(
    "f1", "SELECT series_id, time, " + ", ".join(f"aqi_target_{h}h" for h in range(1, 73)) + " FROM t",
    t=_TRAIN_BODY))
def _(spark, d):
    return _training(spark, d)[1]


@query("a9_read_training_features", with_frames("f1", "SELECT series_id, time, us_aqi, pm2_5, pm10 FROM t", t=_TRAIN_BODY))
def _(spark, d):
    return _training(spark, d)[0]


@query("a10_plan_chunks",
       "SELECT o_orderpriority, CAST(strftime(s, '%Y-%m-%d') AS VARCHAR) AS chunk_start, "
       "CAST(strftime(least(s + INTERVAL 29 DAY, hi), '%Y-%m-%d') AS VARCHAR) AS chunk_end FROM ("
       "SELECT o_orderpriority, unnest(generate_series(lo, hi, INTERVAL 30 DAY)) AS s, hi FROM ("
       "SELECT o_orderpriority, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1))")
def _(spark, d):
    bounds = table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.to_date(F.min("o_orderdate")).alias("start_date"), F.to_date(F.max("o_orderdate")).alias("end_date"))
    return plan_chunks(bounds).select(
        "o_orderpriority", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("chunk_start", "chunk_end")])


@query("a11_union_chunks", with_frames("f2", "SELECT * FROM f2"))
def _(spark, d):
    f2 = hourly_by_type(spark, d)
    types = ["click", "error", "purchase", "signup", "view"]
    parts = [f2.where(F.col(KEY) == t) for t in types]
    return union_all(*parts, f2.where(~F.col(KEY).isin(types)))


@query("a12_limit_source",
       "SELECT event_id, ts, value FROM events WHERE ts <= TIMESTAMP '2024-01-20 19:00:00'")
def _(spark, d):
    newest = F.lit("2024-01-20 19:00:00").cast(NTZ)
    return limit_source(table(spark, d, "events"), newest, "ts").select("event_id", "ts", "value")


@query("a13_write_forecast", with_frames(
    "f9", "SELECT forecast_time, horizon_hours, predicted_aqi, aqi_category FROM f9"))
def _(spark, d):
    path = scratch_path(spark, "forecast")
    cols = ["forecast_time", "horizon_hours", "predicted_aqi", "aqi_category"]
    rows = forecast(spark, d).select(*cols)
    write_forecast(rows, path)
    return read_csv(spark, path, rows.schema)


@query("a7_upsert_daily", with_frames("f4", "SELECT series_id, time, y FROM f4"))
def _(spark, d):
    rows = daily_orders(spark, d)
    t = create_table(spark, scratch_path(spark, "tables"), "daily", 1, (KEY, TIME), TIME, "month")
    t.upsert(rows.where(F.year(TIME) < 1999))
    t.upsert(rows.where(F.year(TIME) >= 1998))
    return t.read()
