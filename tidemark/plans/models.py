"""Baselines, linear and tree models per horizon, scoring, explanation."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scoring import category, clamp_min
from tidemark.operators.aggregates import regression_metrics, split_counts
from tidemark.operators.errors import DataContractError
from tidemark.operators.guards import same_order
from tidemark.operators.keyed import middle_row
from tidemark.operators.project import known_rows, top_k, unpivot_targets
from tidemark.operators.series import HOURLY, Series
from tidemark.operators.splits import PART, split_nested
from tidemark.operators.sets import union_all
from tidemark.plans.boosting import BoostedTrees, score_rows
from tidemark.plans.features import FEATURE_SETS, with_cycles
from tidemark.plans.horizons import horizon_dataset
from tidemark.schemas import BASELINE_HORIZONS, KEY, MODEL_COLUMNS, TIME, target_name
from tidemark.session import scratch_path

VECTOR = "_features"

# The boosted trees' settings, as far as Spark ML has them.
BOOSTED = dict(maxIter=800, stepSize=0.02, maxDepth=2, minInstancesPerNode=20, subsamplingRate=0.8,
               featureSubsetStrategy="0.7", seed=42)
# The histogram-boosting experiment (depth stands in for its leaf budget).
HISTOGRAM_BOOSTED = dict(maxIter=300, stepSize=0.05, maxDepth=5, minInstancesPerNode=20, seed=42)
# The forest of the model comparison.
FOREST = dict(numTrees=200, maxDepth=20, minInstancesPerNode=2, featureSubsetStrategy="all", seed=42)
# The ridge grid.
ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]


# -- baselines ------------------------------------------------------------------------
def _long_test(df: DataFrame, horizons: list[int], keep: list[str]) -> DataFrame:
    return unpivot_targets(df.select(KEY, TIME, *keep, *[target_name(h) for h in horizons]),
                           [target_name(h) for h in horizons], [KEY, TIME, *keep])


def persistence_baseline(df: DataFrame, horizons: list[int] = BASELINE_HORIZONS) -> DataFrame:
    """Forecast = current value, measured on the rows marked ``test``."""
    long = _long_test(df.where(F.col(PART) == "test"), horizons, ["us_aqi"])
    return _named(regression_metrics(long, "target", "us_aqi", ("horizon",)), "Persistence baseline")


def mean_baseline(df: DataFrame, horizons: list[int] = BASELINE_HORIZONS) -> DataFrame:
    """Forecast = mean label of the training rows, per horizon.

    The means are one row for each of the given horizons, so broadcasting them is bounded.
    """
    long = _long_test(df, horizons, [PART])
    means = long.groupBy("horizon").agg(
        F.avg(F.when(F.col(PART) == "train", F.col("target"))).alias("_mean"))
    test = long.where(F.col(PART) == "test").join(F.broadcast(means), "horizon")
    return _named(regression_metrics(test, "target", "_mean", ("horizon",)), "Training mean baseline")


def _named(metrics: DataFrame, model: str) -> DataFrame:
    return metrics.select(F.lit(model).alias("model"), "horizon", F.col("row_count").alias("test_rows"),
                          "mae", "rmse", "r2")


# -- vectors --------------------------------------------------------------------------
def assemble(df: DataFrame, columns: list[str], saved_order: list[str] | None = None) -> DataFrame:
    """Model input vector in the saved order; a NULL input is an error, never a dropped row."""
    if saved_order is not None:
        same_order(saved_order, columns)
    return VectorAssembler(inputCols=columns, outputCol=VECTOR, handleInvalid="error").transform(df)


# -- linear models --------------------------------------------------------------------
@dataclass(frozen=True)
class LinearModel:
    """A fitted linear forecast; scoring and explaining it are plain column expressions."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    means: tuple[float, ...]

    def prediction(self) -> Column:
        terms = [f"`{c}` * {float(w)!r}D" for c, w in zip(self.features, self.coefficients) if w]
        return F.expr(" + ".join([f"{float(self.intercept)!r}D", *terms]))

    def contributions(self) -> dict[str, Column]:
        return {c: (F.col(c) - F.lit(float(m))) * F.lit(float(w))
                for c, w, m in zip(self.features, self.coefficients, self.means)}


@dataclass(frozen=True)
class Moments:
    """Count, means, spreads and correlations of a set of columns: all a ridge fit needs."""

    columns: tuple[str, ...]
    count: int
    mean: np.ndarray
    std: np.ndarray  # population
    corr: np.ndarray


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """Two aggregates over the data; the result is one small square matrix.

    The vectors are kept for the second pass, so that what lies before them runs once.
    """
    vectors = assemble(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns).select(VECTOR)
    vectors = vectors.persist()
    try:
        stats = vectors.select(
            Summarizer.metrics("mean", "variance", "count").summary(F.col(VECTOR)).alias("s")).first()["s"]
        corr = Correlation.corr(vectors, VECTOR).first()[0].toArray()
    finally:
        vectors.unpersist()
    n = int(stats["count"])
    variance = np.array(stats["variance"].toArray()) * (n - 1) / n
    corr = np.nan_to_num(corr, nan=0.0)
    np.fill_diagonal(corr, 1.0)
    return Moments(tuple(columns), n, np.array(stats["mean"].toArray()), np.sqrt(variance), corr)


def ridge_from_moments(m: Moments, features: list[str], label: str, alpha: float) -> LinearModel:
    """Ridge on standardized inputs: solves ``(n R + alpha I) w = n r sd(y)``.

    One set of moments serves every label, feature subset and penalty.
    """
    at = {c: i for i, c in enumerate(m.columns)}
    xs, y = [at[c] for c in features], at[label]
    r = m.corr[np.ix_(xs, xs)]
    w = np.linalg.solve(m.count * r + alpha * np.eye(len(xs)), m.count * m.corr[xs, y] * m.std[y])
    sd = m.std[xs]
    beta = np.divide(w, sd, out=np.zeros_like(w), where=sd > 0)
    return LinearModel(tuple(features), tuple(beta), float(m.mean[y] - beta @ m.mean[xs]),
                       tuple(m.mean[xs]))


def ridge(train: DataFrame, features: list[str], label: str, alpha: float = 1.0):
    """The same fit through Spark ML's own solver, for pipelines that need an ML model object.

    Spark scales the penalty by the label's spread and the row count, hence ``regParam``.
    """
    stats = train.agg(F.stddev_pop(label).alias("sd"), F.count(label).alias("n")).first()
    solver = LinearRegression(featuresCol=VECTOR, labelCol=label, elasticNetParam=0.0, solver="normal",
                              standardization=True, regParam=alpha * stats["sd"] / stats["n"])
    return solver.fit(assemble(train, features))


def ridge_by_horizon(df: DataFrame, features: list[str], horizons: list[int],
                     alpha: float = 1.0) -> dict[int, LinearModel]:
    """One ridge model per horizon out of a single set of moments of the training rows."""
    train = df.where(F.col(PART) == "train")
    m = moments(train, [*features, *[target_name(h) for h in horizons]])
    return {h: ridge_from_moments(m, features, target_name(h), alpha) for h in horizons}


def linear_metrics(df: DataFrame, models: dict[int, LinearModel], name: str) -> DataFrame:
    """Test metrics of every horizon from one scan."""
    test = df.where(F.col(PART) == "test")
    long = test.select(F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(target_name(h)).alias("target"),
                 m.prediction().alias("prediction"))
        for h, m in models.items()])))
    return _named(regression_metrics(long, "target", "prediction", ("horizon",)), name)


def ridge_grid(df: DataFrame, label: str, alphas: Iterable[float] = ALPHAS,
               feature_sets: dict[str, list[str]] | None = None,
               series: Series = HOURLY) -> tuple[DataFrame, DataFrame]:
    """Grid over feature sets and penalties on a chronological 64/16/20 split.

    Returns (validation table, test metrics of the winner refit on train and validation). All
    fits come from one set of training moments and all validation scores from one scan. The
    split rows are written once to the shared folder, since every step after it reads them.
    """
    sets = feature_sets or FEATURE_SETS
    columns = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    parts = split_nested(known_rows(with_cycles(df), [*columns, label]).select(KEY, TIME, *columns, label),
                         series=series)
    path = scratch_path(df.sparkSession, "grid")
    parts.write.parquet(path)
    parts = df.sparkSession.read.schema(parts.schema).parquet(path)
    known = moments(parts.where(F.col(PART) == "train"), [*columns, label])
    fits = {(s, a): ridge_from_moments(known, cs, label, a) for s, cs in sets.items() for a in alphas}
    scored = parts.where(F.col(PART) == "validation").select(label, F.inline(F.array(*[
        F.struct(F.lit(s).alias("feature_set"), F.lit(float(a)).alias("alpha"),
                 F.lit(len(sets[s])).alias("feature_count"), m.prediction().alias("prediction"))
        for (s, a), m in fits.items()])))
    table = regression_metrics(scored, label, "prediction", ("feature_set", "alpha", "feature_count"))
    table = table.select("feature_set", "alpha", "feature_count", F.col("mae").alias("validation_mae"),
                         F.col("rmse").alias("validation_rmse"), F.col("r2").alias("validation_r2"))
    # one row per fit: kept, so that ranking and returning it do not score twice
    table = df.sparkSession.createDataFrame(table.collect(), table.schema)
    best = table.orderBy("validation_rmse", "feature_set", "alpha").first()
    refit = moments(parts.where(F.col(PART) != "test"), [*sets[best["feature_set"]], label])
    winner = ridge_from_moments(refit, sets[best["feature_set"]], label, best["alpha"])
    test = parts.where(F.col(PART) == "test").select(label, winner.prediction().alias("prediction"))
    tested = regression_metrics(test, label, "prediction").select(
        F.lit(best["feature_set"]).alias("feature_set"), F.lit(best["alpha"]).alias("alpha"),
        F.lit(best["feature_count"]).alias("feature_count"), F.col("mae").alias("test_mae"),
        F.col("rmse").alias("test_rmse"), F.col("r2").alias("test_r2"))
    return table, tested


# -- tree models ----------------------------------------------------------------------
def random_forest(train: DataFrame, features: list[str], label: str, **settings):
    return RandomForestRegressor(featuresCol=VECTOR, labelCol=label, **{**FOREST, **settings}).fit(
        assemble(train, features))


def boosted(train: DataFrame, features: list[str], label: str, **settings):
    return GBTRegressor(featuresCol=VECTOR, labelCol=label, lossType="squared",
                        **{**BOOSTED, **settings}).fit(assemble(train, features))


def histogram_boosted(train: DataFrame, features: list[str], label: str, validation: Column,
                      **settings):
    """Boosting that stops when the rows marked ``validation`` no longer improve."""
    data = assemble(train, features).withColumn("_validation", validation)
    return GBTRegressor(featuresCol=VECTOR, labelCol=label, lossType="squared",
                        validationIndicatorCol="_validation",
                        **{**HISTOGRAM_BOOSTED, **settings}).fit(data)


@dataclass(frozen=True)
class HorizonFit:
    horizon: int
    model: object
    features: tuple[str, ...]
    metrics: DataFrame


def fit_horizons(table: DataFrame, horizons: list[int], boundary, series: Series = HOURLY,
                 features: list[str] | None = None, fit=boosted, parallel: int = 4,
                 name: str = "Boosted trees", source: str = "feature table", **settings) -> list[HorizonFit]:
    """One direct model per horizon.

    ``table`` should be a stored table: each horizon derives its own dataset from it with one
    shuffle, and keeps it only while its model is fitted. A few fits run side by side; the rows
    stay on the executors.
    """
    columns = features or MODEL_COLUMNS
    split = F.lit(boundary).cast("timestamp_ntz")

    def one(h: int) -> HorizonFit:
        label = target_name(h)
        base = [c for c in columns if c in table.columns]
        data = horizon_dataset(table, h, series, base=base).persist()
        try:
            is_train = F.col(TIME) < split
            model = fit(data.where(is_train), columns, label, **settings)
            scored = model.transform(assemble(data.where(~is_train), columns))
            counts = split_counts(data, is_train).first()
            metrics = regression_metrics(scored, label, "prediction").select(
                F.lit(name).alias("model"), F.lit(source).alias("data_source"),
                F.lit(h).alias("forecast_horizon_hours"),
                F.lit(counts["training_rows"]).cast("long").alias("training_rows"),
                F.lit(counts["test_rows"]).cast("long").alias("test_rows"), "mae", "rmse", "r2")
            metrics = table.sparkSession.createDataFrame(metrics.collect(), metrics.schema)
            return HorizonFit(h, model, tuple(columns), metrics)
        finally:
            data.unpersist()

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(one, horizons))


def all_metrics(fits: list[HorizonFit]) -> DataFrame:
    return union_all(*[f.metrics for f in fits])


def feature_importance(model, features: list[str], spark, k: int = 10) -> DataFrame:
    weights = model.featureImportances.toArray()
    rows = [(c, float(w)) for c, w in zip(features, weights)]
    return top_k(spark.createDataFrame(rows, "feature string, importance double"), "importance", k, "feature")


# -- scoring --------------------------------------------------------------------------
def score_horizons(models: dict[int, object], inputs: DataFrame, features: list[str]) -> DataFrame:
    """Forecast rows for the horizons that have a model, in the prediction table's columns."""
    def predicted(h: int, m) -> DataFrame:
        return m.transform(assemble(inputs.where(F.col("horizon_hours") == h), features)).drop(VECTOR)

    linear = {h: m for h, m in models.items() if isinstance(m, LinearModel)}
    boosted_ = {h: m for h, m in models.items() if isinstance(m, BoostedTrees)}
    parts = [predicted(h, m) for h, m in sorted(models.items()) if h not in linear and h not in boosted_]
    if linear:
        parts.append(_linear_scores(linear, inputs))
    if boosted_:
        parts.append(score_rows(inputs, boosted_))
    scored = union_all(*parts)
    value = clamp_min("prediction")
    return scored.select(
        KEY, F.col(TIME).alias("forecast_generated_at"), "forecast_time",
        F.col("horizon_hours").cast("long").alias("horizon_hours"), value.alias("predicted_aqi"),
        F.col("future_temperature").alias("forecast_temperature"),
        F.col("future_humidity").alias("forecast_humidity"),
        F.col("future_precipitation").alias("forecast_precipitation"),
        F.col("future_wind_speed").alias("forecast_wind_speed"),
        category(value).alias("aqi_category"))


def _linear_scores(models: dict[int, LinearModel], inputs: DataFrame) -> DataFrame:
    """All linear models in one pass: a row's horizon picks its coefficients (one row a model)."""
    names = list(dict.fromkeys(c for m in models.values() for c in m.features))
    rows = [(h, float(m.intercept), [float(dict(zip(m.features, m.coefficients)).get(c, 0.0)) for c in names])
            for h, m in models.items()]
    table = inputs.sparkSession.createDataFrame(rows, "_h int, _intercept double, _weights array<double>")
    joined = inputs.join(F.broadcast(table), F.col("horizon_hours") == F.col("_h"))
    values = F.array(*[F.col(c).cast("double") for c in names])
    products = F.zip_with(values, "_weights", lambda x, w: F.when(w == 0, 0.0).otherwise(x * w))
    return joined.withColumn("prediction", F.aggregate(products, F.col("_intercept"), lambda s, x: s + x)).select(
        *inputs.columns, "prediction")


# -- explanation ----------------------------------------------------------------------
def linear_contributions(df: DataFrame, model: LinearModel) -> DataFrame:
    """Additive contribution of each input to each row's forecast."""
    return df.select(KEY, TIME, *[c.alias(n) for n, c in model.contributions().items()])


def contribution_ranking(df: DataFrame, model: LinearModel, k: int = 20) -> DataFrame:
    sizes = df.agg(*[F.avg(F.abs(c)).alias(n) for n, c in model.contributions().items()])
    long = sizes.unpivot([], list(model.features), "feature", "mean_abs_contribution")
    return top_k(long, "mean_abs_contribution", k, "feature")


def contribution_table(df: DataFrame, models: dict[int, LinearModel]) -> DataFrame:
    """(horizon, feature, mean_abs_contribution) of all models from one scan."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("feature"), c.cast("double").alias("contribution"))
        for h, m in sorted(models.items()) for n, c in m.contributions().items()])))
    return cells.groupBy("horizon", "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))


def local_contributions(df: DataFrame, models: dict[int, LinearModel], series: Series = HOURLY) -> DataFrame:
    """(keys, time, horizon, feature, contribution, prediction) of the middle row of each series."""
    row = middle_row(df, series)
    return row.select(*series.keys, series.time, F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("feature"), c.cast("double").alias("contribution"),
                 m.prediction().alias("prediction"))
        for h, m in sorted(models.items()) for n, c in m.contributions().items()])))


def permutation_importance(df: DataFrame, model, features: list[str], label: str,
                           keys: list[str] | None = None, seed: int = 42,
                           buckets: int = 1024) -> DataFrame:
    """Rise in RMSE when one input is swapped with that of a random other row.

    Every row takes the value of its neighbour in the order (bucket, hash), the last one that of
    the first. Rows are ordered inside hash buckets, whose first rows (one a bucket) close the
    gaps between them: the pairing depends on the keys and ``buckets`` only, not on the number of
    rows. Raise ``buckets`` with very large tables. Every input is scored in the same pass.
    """
    keys = keys or [KEY, TIME]
    mixed = df.select(*keys, label, *features).withColumn("_hash", F.xxhash64(F.lit(seed), *keys)).withColumn(
        "_bucket", F.pmod(F.col("_hash"), F.lit(buckets)))
    w = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    row = F.struct(*features)
    firsts = mixed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("_bucket", row.alias("_first"))
    ring = Window.orderBy("_bucket")
    after = firsts.select("_bucket", F.coalesce(F.lead("_first").over(ring), F.first("_first").over(
        ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_next"))
    placed = mixed.withColumn("_lead", F.lead(row, 1).over(w)).join(F.broadcast(after), "_bucket")
    paired = placed.withColumn("_other", F.coalesce("_lead", "_next")).withColumn(
        "_swap", F.explode(F.array(*[F.lit(i) for i in range(-1, len(features))])))
    swapped = paired.select(label, "_swap", *[
        F.when(F.col("_swap") == i, F.col(f"_other.{c}")).otherwise(F.col(c)).alias(c)
        for i, c in enumerate(features)])
    rmse = regression_metrics(model.transform(assemble(swapped, features)), label, "prediction", ("_swap",))
    base = rmse.where("_swap = -1").select("rmse").scalar()
    name = F.get(F.array(*[F.lit(c) for c in features]), F.col("_swap"))
    return rmse.where("_swap >= 0").select(
        name.alias("feature"), (F.col("rmse") - base).alias("rmse_increase"))


def check_horizons(models: dict[int, object], wanted: int = 72) -> None:
    gone = [h for h in range(1, wanted + 1) if h not in models]
    if gone:
        raise DataContractError(f"no model for horizons {gone}")
