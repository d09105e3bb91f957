"""Versioned model bundles: one folder per horizon plus metadata and metrics."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml.regression import (
    GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.errors import DataContractError
from tidemark.operators.guards import same_order
from tidemark.operators.project import equals_filter
from tidemark.plans.boosting import BoostedTrees
from tidemark.plans.models import LinearModel, check_horizons
from tidemark.sources.tables import _fs_claim, _fs_exists, _fs_list, _fs_read, _fs_write, next_version, versions

KINDS = {c.__name__: c for c in (GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel)}
# Horizons whose scores are kept in the metadata.
SCORED_HORIZONS = [1, 24, 72]


def register_models(spark: SparkSession, root: str, models: dict[int, object], features: list[str],
                    metrics: DataFrame, metadata: dict, horizons: int = 72) -> int:
    """Write a new version; it must hold a model and a metric row for every horizon."""
    wanted = list(range(1, horizons + 1))
    gone = [h for h in wanted if h not in models]
    if gone:
        raise DataContractError(f"no model for horizons {gone}")
    rows = {r["forecast_horizon_hours"]: r for r in metrics.collect()}  # one row per horizon
    if sorted(rows) != wanted:
        raise DataContractError("metrics must hold one row per horizon")
    version = next_version(spark, root)
    while not _fs_claim(spark, f"{root}/version={version}/_claim"):  # another registration took it
        version += 1
    path = f"{root}/version={version}"
    for h in wanted:
        save_model(spark, models[h], f"{path}/h={h:02d}")
    metrics.repartition(1).write.parquet(f"{path}/metrics")
    scores = {f"{m}_{h}h": rows[h][m] for h in SCORED_HORIZONS if h in rows for m in ("mae", "rmse", "r2")}
    record = {**metadata, **scores, "number_of_models": len(wanted), "version": version}
    _fs_write(spark, f"{path}/features.json", json.dumps(list(features)))
    # written last: a version without it is incomplete and is not offered for loading
    _fs_write(spark, f"{path}/metadata.json", json.dumps(record))
    return version


def save_model(spark, model, path: str) -> None:
    if isinstance(model, LinearModel):
        _fs_write(spark, f"{path}/linear.json", json.dumps(asdict(model)))
    elif isinstance(model, BoostedTrees):
        _fs_write(spark, f"{path}/boosted.json", json.dumps(model.as_dict()))
    else:
        _fs_write(spark, f"{path}/kind.json", json.dumps(type(model).__name__))
        model.write().save(f"{path}/model")


def load_model(spark, path: str):
    if _fs_exists(spark, f"{path}/boosted.json"):
        return BoostedTrees.from_dict(json.loads(_fs_read(spark, f"{path}/boosted.json")))
    if _fs_exists(spark, f"{path}/linear.json"):
        d = json.loads(_fs_read(spark, f"{path}/linear.json"))
        return LinearModel(tuple(d["features"]), tuple(d["coefficients"]), d["intercept"], tuple(d["means"]))
    kind = KINDS[json.loads(_fs_read(spark, f"{path}/kind.json"))]
    return kind.load(f"{path}/model")


def metadata_table(spark: SparkSession, root: str) -> DataFrame:
    complete = [f"{root}/version={v}/metadata.json" for v in versions(spark, root)
                if _fs_exists(spark, f"{root}/version={v}/metadata.json")]
    if not complete:
        raise DataContractError("no complete model version")
    return spark.read.json(complete)


def latest_version(metadata: DataFrame) -> DataFrame:
    """The whole metadata row with the highest version."""
    return metadata.agg(F.max_by(F.struct(*metadata.columns), "version").alias("_row")).select("_row.*")


def horizon_metrics(spark: SparkSession, root: str, version: int, horizon: int) -> DataFrame:
    metrics = spark.read.parquet(f"{root}/version={version}/metrics")
    return equals_filter(metrics, "forecast_horizon_hours", horizon)


def load_latest_models(spark: SparkSession, root: str,
                       features: list[str] | None = None) -> tuple[int, dict[int, object], list[str]]:
    """(version, models by horizon, input order); another input order than saved, or a bundle that
    has lost models, is an error."""
    version = latest_version(metadata_table(spark, root)).first()["version"]
    path = f"{root}/version={version}"
    saved = json.loads(_fs_read(spark, f"{path}/features.json"))
    if features is not None:
        same_order(saved, features)
    names = [n for n in _fs_list(spark, path) if n.startswith("h=")]
    record = json.loads(_fs_read(spark, f"{path}/metadata.json"))
    check_horizons({int(n[2:]): n for n in names}, record["number_of_models"])
    return version, {int(n[2:]): load_model(spark, f"{path}/{n}") for n in sorted(names)}, saved


def promote(metadata: DataFrame, metric: str = "rmse_24h") -> DataFrame:
    """Newest version against the best earlier one: promote when it is not worse."""
    newest = latest_version(metadata).select("version", metric)
    v = newest.select("version").scalar()
    best = metadata.where(F.col("version") < v).agg(F.min(metric).alias("b")).select("b").scalar()
    return newest.select("version", metric, best.alias("best_before"),
                         F.coalesce(F.col(metric) <= best, F.lit(True)).alias("promote"))
