"""File sources and sinks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.errors import DataContractError
from tidemark.operators.project import nan_to_null
from tidemark.schemas import KEY, TIME


def payload_schema(variables: list[str]) -> T.StructType:
    inner = [T.StructField(TIME, T.ArrayType(T.StringType()))]
    inner += [T.StructField(v, T.ArrayType(T.DoubleType())) for v in variables]
    return T.StructType([T.StructField(KEY, T.StringType()), T.StructField("hourly", T.StructType(inner))])


def _unequal(variables: list[str]):
    """A variable that is there, but not once for each time."""
    hours = F.size("hourly.time")
    off = [F.col(f"hourly.{v}").isNotNull() & (F.size(F.col(f"hourly.{v}")) != hours) for v in variables]
    return reduce(or_, off, F.lit(False))


def flatten_payload(raw: DataFrame, variables: list[str]) -> DataFrame:
    """One row per hour out of a struct of equal-length arrays."""
    zipped = F.arrays_zip(*[F.col(f"hourly.{c}").alias(c) for c in [TIME, *variables]])
    names = [TIME, *variables]
    flat = raw.select(KEY, F.explode(zipped).alias("_row"))
    # the zipped struct keeps its field order, whatever the fields are called
    return nan_to_null(flat.select(
        KEY,
        F.to_timestamp_ntz(F.col(f"_row.`{names[0]}`"), F.lit("yyyy-MM-dd'T'HH:mm")).alias(TIME),
        *[F.col(f"_row.`{v}`").alias(v) for v in variables]))


def read_hourly_json(spark: SparkSession, path: str, variables: list[str],
                     series_id: str | None = None, multiline: bool = False) -> DataFrame:
    """Landed payload files as hourly rows; ``series_id`` fills in a missing key."""
    raw = spark.read.schema(payload_schema(variables)).option("multiLine", multiline).json(path)
    if series_id is not None:
        raw = raw.withColumn(KEY, F.coalesce(KEY, F.lit(series_id)))
    problems = raw.agg(
        F.count_if(F.col("hourly").isNull()).alias("without"),
        F.count_if(F.coalesce(F.size("hourly.time"), F.lit(-1)) <= 0).alias("empty"),
        F.count_if(_unequal(variables)).alias("unequal"),
        F.count(F.lit(1)).alias("files")).first()
    if problems["unequal"]:
        raise DataContractError(f"{problems['unequal']} payloads have arrays of unequal length")
    if problems["files"] == 0 or problems["without"] or problems["empty"]:
        raise DataContractError(
            f"{problems['without']} payloads have no hourly part, {problems['empty']} are empty, "
            f"of {problems['files']}")
    return flatten_payload(raw, variables)


def write_hourly_json(df: DataFrame, path: str, variables: list[str], chunk: str = TIME) -> None:
    """The inverse of ``read_hourly_json``: one payload per series and 30-day chunk."""
    from tidemark.functions.calendar import epoch_seconds

    block = F.floor(epoch_seconds(TIME) / (30 * 86400))
    rows = F.sort_array(F.collect_list(F.struct(
        F.date_format(TIME, "yyyy-MM-dd'T'HH:mm").alias(TIME), *variables)))
    packed = df.groupBy(KEY, block.alias("_block")).agg(rows.alias("_rows"))
    hourly = F.struct(*[F.col(f"_rows.{c}").alias(c) for c in [TIME, *variables]])
    packed.select(KEY, hourly.alias("hourly")).write.mode("overwrite").option(
        "ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return nan_to_null(spark.read.schema(schema).option("nanValue", "NaN").csv(
        path, header=True, enforceSchema=False))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_forecast(df: DataFrame, path: str, per_series: bool = False) -> None:
    """Publish the latest forecast: one file of horizon rows.

    A forecast of many series would not fit one task, so ``per_series`` writes one folder
    per series instead.
    """
    if per_series:
        df.repartition(KEY).sortWithinPartitions(KEY, "horizon_hours").write.mode(
            "overwrite").option("header", True).partitionBy(KEY).csv(path)
        return
    # the shuffle keeps the work before it parallel; only the horizon rows meet in one task
    df.repartition(1).sortWithinPartitions("forecast_time").write.mode("overwrite").option(
        "header", True).csv(path)


def plan_chunks(bounds: DataFrame, start: str = "start_date", end: str = "end_date",
                days: int = 30) -> DataFrame:
    """Cut each inclusive date range into chunks of at most ``days`` days."""
    first = F.explode(F.expr(f"sequence({start}, {end}, interval {days} days)"))
    chunked = bounds.where(F.col(start) <= F.col(end)).withColumn("chunk_start", first)
    return chunked.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col(end)))
