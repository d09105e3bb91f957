"""Retraining as one call: boundary, a model a horizon, metrics, a registered version, promotion; resumable.

Everything a run has finished lies under its job folder, so a run that stopped goes on where it was: the
joined table and its horizon store are written once, and every horizon's model and scores are committed
by a mark that is written last. Calling again with the same folder fits only the horizons without a mark.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import from_epoch_seconds
from tidemark.operators.errors import DataContractError
from tidemark.operators.joins import join_targets
from tidemark.operators.series import HOURLY, Series
from tidemark.operators.splits import PART, quantile_boundary
from tidemark.plans import registry
from tidemark.plans.boosting import DIRECT, Boosting, boosted_metrics, fit_boosted
from tidemark.plans.horizons import horizon_store
from tidemark.plans.models import linear_metrics, ridge_by_horizon
from tidemark.schemas import MODEL_COLUMNS
from tidemark.sources.tables import _fs_exists, _fs_read, _fs_write

METRICS = "model string, forecast_horizon_hours int, training_rows bigint, test_rows bigint, mae double, rmse double, r2 double"


@dataclass(frozen=True)
class Training:
    """What a learner works on: the stored joined rows with their part, the stored horizon arrays, the boundary."""

    rows: DataFrame
    store: DataFrame
    boundary: str
    series: Series


@dataclass(frozen=True)
class Learner:
    """How to fit a few horizons at once, and how to score them: a frame with the columns of METRICS."""

    features: list[str]
    fit: Callable[[Training, list[int]], dict[int, object]]
    score: Callable[[Training, dict[int, object]], DataFrame]


def ridge_learner(features: list[str], alpha: float = 1.0) -> Learner:
    """Ridge on inputs known at the time itself; a chunk of horizons costs one set of moments."""
    def score(t: Training, models: dict) -> DataFrame:
        train = t.rows.where(F.col(PART) == "train").count()
        return linear_metrics(t.rows, models, "Ridge Regression").select(
            "model", F.col("horizon").cast("int").alias("forecast_horizon_hours"), F.lit(train).alias("training_rows"),
            F.col("test_rows").cast("long").alias("test_rows"), "mae", "rmse", "r2")

    return Learner(features, lambda t, hs: ridge_by_horizon(t.rows, features, hs, alpha), score)


def boosted_learner(spec: Boosting = DIRECT, features: list[str] | None = None, blocks: int | None = None) -> Learner:
    """Boosted trees on the horizon store: all horizons of a chunk in one pass a level."""
    def fit(t: Training, horizons: list[int]) -> dict:
        before = F.col(t.series.time) < F.lit(t.boundary).cast("timestamp_ntz")
        return fit_boosted(t.store.where(before), horizons, spec, features, blocks)

    def score(t: Training, models: dict) -> DataFrame:
        return boosted_metrics(t.store, models, t.boundary, series=t.series).select(
            "model", "forecast_horizon_hours", "training_rows", "test_rows", "mae", "rmse", "r2")

    return Learner(features or MODEL_COLUMNS, fit, score)


def _stored(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A step's table: written unless a complete one is there, then read."""
    if not _fs_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return spark.read.parquet(path)


def training_data(job: str, features: DataFrame, targets: DataFrame, probability: float = 0.8, horizons: int = 72,
                  series: Series = HOURLY) -> Training:
    """The joined rows split at an interpolated quantile of their times, and their horizon store, both kept."""
    spark = features.sparkSession
    joined = _stored(spark, f"{job}/joined", lambda: join_targets(features, targets, (*series.keys, series.time)))
    mark = f"{job}/boundary.json"
    if not _fs_exists(spark, mark):
        seconds = quantile_boundary(joined, probability, series.time)
        if seconds is None:
            raise DataContractError("no feature row has a label row")
        # rows lie on whole seconds: the first one not before the quantile decides as the quantile does
        whole = -int(-seconds // 1)
        at = spark.range(1).select(from_epoch_seconds(F.lit(whole)).cast("string").alias("t")).first().t
        _fs_write(spark, mark, json.dumps(at))
    boundary = json.loads(_fs_read(spark, mark))
    part = F.when(F.col(series.time) < F.lit(boundary).cast("timestamp_ntz"), "train").otherwise("test")
    store = _stored(spark, f"{job}/store", lambda: horizon_store(joined, horizons, series))
    return Training(joined.withColumn(PART, part), store, boundary, series)


def committed(spark: SparkSession, job: str, horizons: int) -> list[int]:
    """Horizons whose model and scores an earlier call finished."""
    return [h for h in range(1, horizons + 1) if _fs_exists(spark, f"{job}/h={h:02d}/metrics.json")]


def retrain(job: str, features: DataFrame, targets: DataFrame, learner: Learner, registry_root: str, metadata: dict | None = None,
            horizons: int = 72, chunk: int = 8, probability: float = 0.8, promote_by: str = "rmse_24h",
            series: Series = HOURLY) -> tuple[int, DataFrame]:
    """Fit what is missing, register all as a new version, compare it with the versions before.

    Returns (version, promotion row). ``chunk`` horizons are fitted together and then committed one by one. A
    finished job keeps its version: calling again only compares.
    """
    spark = features.sparkSession
    done_mark = f"{job}/version.json"
    if not _fs_exists(spark, done_mark):
        data = training_data(job, features, targets, probability, horizons, series)
        left = sorted(set(range(1, horizons + 1)) - set(committed(spark, job, horizons)))
        for at in range(0, len(left), chunk):
            models = learner.fit(data, left[at:at + chunk])
            scores = {r["forecast_horizon_hours"]: r.asDict() for r in learner.score(data, models).collect()}  # a row a horizon
            for h, model in sorted(models.items()):
                registry.save_model(spark, model, f"{job}/h={h:02d}")
                _fs_write(spark, f"{job}/h={h:02d}/metrics.json", json.dumps(scores[h]))  # last: this commits the horizon
        models = {h: registry.load_model(spark, f"{job}/h={h:02d}") for h in range(1, horizons + 1)}
        names = [f.split()[0] for f in METRICS.split(", ")]
        rows = [json.loads(_fs_read(spark, f"{job}/h={h:02d}/metrics.json")) for h in range(1, horizons + 1)]
        metrics = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], METRICS)
        version = registry.register_models(spark, registry_root, models, learner.features, metrics,
                                           {"boundary": data.boundary, **(metadata or {})}, horizons)
        _fs_write(spark, done_mark, json.dumps(version))
    version = json.loads(_fs_read(spark, done_mark))
    return version, registry.promote(registry.metadata_table(spark, registry_root), promote_by)

