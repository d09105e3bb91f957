"""Queries for baselines, models, scoring and explanation (M)."""

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.catalog.features import k1_sql
from tidemark.catalog.frames import CATEGORY_SQL, air, hourly_by_type, weather, with_frames
from tidemark.catalog.registry import query
from tidemark.catalog.sqltext import lead_sql
from tidemark.catalog.windows import ROWS, rounded
from tidemark.functions.calendar import add_hours
from tidemark.operators import splits
from tidemark.operators.keyed import densify
from tidemark.plans import boosting as boost
from tidemark.plans import features as f
from tidemark.plans import horizons as hz
from tidemark.plans import incremental as inc
from tidemark.plans import models as m
from tidemark.plans import registry as reg
from tidemark.plans import retraining as rt
from tidemark.schemas import (
    BASELINE_HORIZONS, KEY, MODEL_COLUMNS, REPORT_HORIZONS, SHORT_FEATURES, TIME, target_name,
)
from tidemark.session import scratch_path
from tidemark.sources.tables import create_table
from tidemark.streaming import jobs

CUT = "2024-01-20 20:00:00"


def labelled(spark, d):
    """Measures, five labels and the 80/20 mark of each series."""
    f2 = hourly_by_type(spark, d)
    labels = f.wide_targets(f2, 72, ROWS).select(KEY, TIME, *[target_name(h) for h in BASELINE_HORIZONS])
    return splits.split_by_time(f2.join(labels, [KEY, TIME]), CUT)


_L = ("SELECT series_id, time, us_aqi, pm10, " + ", ".join(f"{lead_sql('us_aqi', h)} AS y{h}" for h in BASELINE_HORIZONS) + " FROM f2")
_LONG = " UNION ALL ".join(
    f"SELECT series_id, time, us_aqi, pm10, {h} AS horizon, y{h} AS y, CASE WHEN time < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS part "
    "FROM l WHERE y72 IS NOT NULL" for h in BASELINE_HORIZONS)
_SCORES = ("SELECT '{name}' AS model, horizon, count(*) AS test_rows, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, "
           "round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0), 6) AS r2 FROM ({src}) GROUP BY horizon")


def show(df):
    return df.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4), "r2": F.round("r2", 6)})


@query("m1_persistence_baseline", with_frames("f2", _SCORES.format(
    name="Persistence baseline", src="SELECT horizon, y, us_aqi AS p FROM g WHERE part = 'test'"), l=_L, g=_LONG))
def _(spark, d):
    return show(m.persistence_baseline(labelled(spark, d)))


@query("m2_mean_baseline", with_frames("f2", _SCORES.format(
    name="Training mean baseline", src="SELECT g.horizon, y, p FROM g JOIN (SELECT horizon, avg(y) AS p FROM g WHERE part = 'train' GROUP BY horizon) t "
    "ON t.horizon = g.horizon WHERE part = 'test'"), l=_L, g=_LONG))
def _(spark, d):
    return show(m.mean_baseline(labelled(spark, d)))


# ridge on two standardized inputs has a closed form that SQL can state
_MOM = ("SELECT horizon, count(*) AS n, avg(us_aqi) AS m1, avg(pm10) AS m2, avg(y) AS my, stddev_pop(us_aqi) AS s1, stddev_pop(pm10) AS s2, "
        "stddev_pop(y) AS sy, corr(us_aqi, pm10) AS r12, corr(us_aqi, y) AS r1, corr(pm10, y) AS r2 FROM g WHERE part = 'train' GROUP BY horizon")
def fit_sql(alpha: float = 1) -> str:
    a = f"(n + {alpha})"
    return (f"SELECT *, n * sy * (r1 * {a} - n * r12 * r2) / ({a} * {a} - n * n * r12 * r12) / s1 AS b1, "
            f"n * sy * (r2 * {a} - n * r12 * r1) / ({a} * {a} - n * n * r12 * r12) / s2 AS b2 FROM mom")


_FIT = fit_sql()


@query("m3_ridge", with_frames("f2", _SCORES.format(
    name="Ridge Regression", src="SELECT g.horizon, y, my + b1 * (us_aqi - m1) + b2 * (pm10 - m2) AS p FROM g JOIN fit ON fit.horizon = g.horizon WHERE part = 'test'"),
    l=_L, g=_LONG, mom=_MOM, fit=_FIT))
def _(spark, d):
    """All five horizons from one set of moments and one scoring scan."""
    df = stored(labelled(spark, d))
    models = m.ridge_by_horizon(df, ["us_aqi", "pm10"], BASELINE_HORIZONS, alpha=1.0)
    return show(m.linear_metrics(df, models, "Ridge Regression"))


@query("m3_ridge_ml", with_frames("f2", _SCORES.format(
    name="Ridge Regression", src="SELECT g.horizon, y, my + b1 * (us_aqi - m1) + b2 * (pm10 - m2) AS p FROM g JOIN fit ON fit.horizon = g.horizon "
    "WHERE part = 'test' AND g.horizon = 24"), l=_L, g=_LONG, mom=_MOM, fit=_FIT))
def _(spark, d):
    """The same fit by Spark ML's normal-equation solver."""
    df = stored(labelled(spark, d))
    inputs = ["us_aqi", "pm10"]
    model = m.ridge(df.where("part = 'train'"), inputs, "aqi_target_24h", 1.0)
    scored = model.transform(m.assemble(df.where("part = 'test'"), inputs)).withColumn("horizon", F.lit(24))
    return show(m._named(m.regression_metrics(scored, "aqi_target_24h", "prediction", ("horizon",)), "Ridge Regression"))


_PAIRS = ("SELECT a.time, CAST(epoch(b.time - a.time) / 3600 AS INTEGER) AS horizon, a.us_aqi, a.pm10, b.us_aqi AS y FROM k1 a JOIN k1 b "
          "ON b.time > a.time AND b.time <= a.time + INTERVAL 72 HOUR")
_G72 = "SELECT *, 'train' AS part FROM p QUALIFY count(*) OVER (PARTITION BY time) = 72"


def feature_rows(spark, d):
    """The stored feature table with its labels, as the training jobs read it."""
    k1 = stored(f.feature_table(f.clean_sources(air(spark, d), weather(spark, d)), ROWS))
    return stored(k1.join(f.wide_targets(k1, 72, ROWS), [KEY, TIME]))


def stored(df):
    """Written once to the shared folder and read back, as the jobs do between steps."""
    path = scratch_path(df.sparkSession, "training")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("m3_ridge_by_horizon")
def _(spark, d):
    df = splits.split_by_index(feature_rows(spark, d), 0.8, ROWS)
    models = m.ridge_by_horizon(df, SHORT_FEATURES, BASELINE_HORIZONS)
    return m.linear_metrics(df, models, "Ridge Regression")


_GRID_ALPHAS = [0.01, 1.0, 100.0, 1000.0]
_GRID_SETS = {"one": ["us_aqi"], "two": ["us_aqi", "pm10"]}
_GRID_G = ("SELECT time, us_aqi, pm10, y72 AS y, 72 AS horizon, CASE WHEN rn < floor(floor(n * 0.8) * 0.8) THEN 'train' WHEN rn < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS part "
           f"FROM (SELECT *, row_number() OVER (ORDER BY time) - 1 AS rn, count(*) OVER () AS n FROM (SELECT time, us_aqi, pm10, {lead_sql('us_aqi', 72)} AS y72 FROM k1) WHERE y72 IS NOT NULL)")


def _grid_fits(mom: str) -> str:
    """The fits of all penalties and both sets from one row of moments."""
    one = " UNION ALL ".join(f"SELECT 'one' AS feature_set, {a} AS alpha, 1 AS feature_count, my, m1, m2, n * r1 * sy / (n + {a}) / s1 AS b1, 0.0 AS b2 FROM {mom}" for a in _GRID_ALPHAS)
    two = " UNION ALL ".join(f"SELECT 'two', {a}, 2, my, m1, m2, b1, b2 FROM ({fit_sql(a).replace('FROM mom', f'FROM {mom}')})" for a in _GRID_ALPHAS)
    return f"{one} UNION ALL {two}"


def _grid_scores(part: str, fits: str, name: str) -> str:
    err = "y - my - b1 * (us_aqi - m1) - b2 * (pm10 - m2)"
    return (f"SELECT feature_set, alpha, feature_count, round(avg(abs(e)), 4) AS {name}_mae, round(sqrt(avg(e * e)), 4) AS {name}_rmse, "
            f"round(1 - sum(e * e) / nullif(var_pop(y) * count(*), 0), 6) AS {name}_r2 FROM (SELECT f.*, y, {err} AS e FROM g CROSS JOIN {fits} f WHERE part = '{part}') "
            "GROUP BY feature_set, alpha, feature_count")


_MOM_ALL = _MOM.replace("WHERE part = 'train'", "WHERE part <> 'test'")
_GRID = dict(k1=k1_sql("pair"), g=_GRID_G, mom=_MOM, mom2=_MOM_ALL, fits=_grid_fits("mom"), refits=_grid_fits("mom2"),
             v=_grid_scores("validation", "fits", "validation"))


def _grid(spark, d):
    return m.ridge_grid(feature_rows(spark, d), "aqi_target_72h", _GRID_ALPHAS, _GRID_SETS, ROWS)


def _grid_shown(df, name):
    return df.withColumns({f"{name}_{c}": F.round(f"{name}_{c}", k) for c, k in (("mae", 4), ("rmse", 4), ("r2", 6))})


@query("m4_ridge_grid", with_frames("pair", "SELECT * FROM v", **_GRID))
def _(spark, d):
    """Two feature sets by four penalties from one set of moments; the full grid's sets are ridge_grid's defaults."""
    return _grid_shown(_grid(spark, d)[0], "validation")


@query("m4_ridge_grid_best", with_frames(
    "pair", "SELECT t.* FROM (" + _grid_scores("test", "refits", "test") + ") t JOIN (SELECT feature_set, alpha FROM v ORDER BY validation_rmse, feature_set, alpha LIMIT 1) b "
    "USING (feature_set, alpha)", **_GRID))
def _(spark, d):
    return _grid_shown(_grid(spark, d)[1], "test")


@query("m4_ridge_grid_full")
def _(spark, d):
    """The whole grid: 39, 43 and 47 inputs by six penalties."""
    return m.ridge_grid(feature_rows(spark, d), "aqi_target_72h", series=ROWS)[0]


def _forest(spark, d, h=1):
    df = splits.split_by_time(feature_rows(spark, d), CUT)
    train = df.where("part = 'train'")
    return df, m.random_forest(train, SHORT_FEATURES, target_name(h), numTrees=20)


@query("m5_random_forest")
def _(spark, d):
    df, model = _forest(spark, d)
    scored = model.transform(m.assemble(df.where("part = 'test'"), SHORT_FEATURES))
    return m.regression_metrics(scored, "aqi_target_1h", "prediction")


@query("m8_feature_importance")
def _(spark, d):
    return m.feature_importance(_forest(spark, d)[1], SHORT_FEATURES, spark, 10)


def horizon_rows(spark, d):
    """The stored horizon arrays of the labelled feature rows: what every boosted fit reads."""
    return stored(hz.horizon_store(feature_rows(spark, d), 72, ROWS))


@query("m6_direct_boosted")
def _(spark, d):
    """All 72 horizons side by side, five rounds of the direct settings; m6_boosted_full has all rounds."""
    store = horizon_rows(spark, d)
    train = store.where(F.col(TIME) < F.lit(CUT).cast("timestamp_ntz"))
    models = boost.fit_boosted(train, list(range(1, 73)), replace(boost.DIRECT, rounds=5), blocks=8)
    return boost.boosted_metrics(store, models, CUT, series=ROWS)


@query("m6_boosted_full")
def _(spark, d):
    """The full 800 rounds of one horizon."""
    store = horizon_rows(spark, d)
    train = store.where(F.col(TIME) < F.lit(CUT).cast("timestamp_ntz"))
    models = boost.fit_boosted(train, [24], boost.DIRECT, blocks=1)
    return boost.boosted_metrics(store, models, CUT, series=ROWS)


_SIDES = ("SELECT *, avg(us_aqi_later) OVER (PARTITION BY horizon) AS base FROM (SELECT horizon, pm10 AS x, y AS us_aqi_later FROM p)")
_CUMULATED = ("SELECT horizon, x, base, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY horizon) AS g, sum(n) OVER (PARTITION BY horizon) "
              "AS n FROM (SELECT horizon, x, any_value(base) AS base, sum(base - us_aqi_later) AS g, count(*) AS n FROM sides GROUP BY horizon, x) "
              "WINDOW w AS (PARTITION BY horizon ORDER BY x)")
_T = "(sign({g}) * greatest(abs({g}) - 1, 0))"
_SPLIT = ("SELECT horizon, x AS cut, base, " + _T.format(g="gl") + " / (nl + 20) AS wl, " + _T.format(g="(g - gl)") + " / (n - nl + 20) AS wr, "
          + f"pow({_T.format(g='gl')}, 2) / (nl + 20) + pow({_T.format(g='(g - gl)')}, 2) / (n - nl + 20) - pow({_T.format(g='g')}, 2) / (n + 20) AS gain "
          "FROM cumulated WHERE nl >= 20 AND n - nl >= 20 QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY round(gain, 3) DESC, x) = 1")


@query("m6_one_split", with_frames(
    "pair", "SELECT s.horizon, count(*) AS row_count, round(avg(abs(us_aqi_later - p)), 4) AS mae, round(sqrt(avg((us_aqi_later - p) * (us_aqi_later - p))), 4) AS rmse "
    "FROM (SELECT sides.horizon, us_aqi_later, sides.base - 0.5 * CASE WHEN split.horizon IS NULL THEN 0 WHEN x <= cut THEN wl ELSE wr END AS p FROM sides "
    "LEFT JOIN split ON split.horizon = sides.horizon) s GROUP BY s.horizon",
    k1=k1_sql("pair", True), p=_PAIRS, sides=_SIDES, cumulated=_CUMULATED, split=_SPLIT))
def _(spark, d):
    """One tree of one split for each of 72 horizons: penalties, leaf values and the least rows of a side, in SQL as well."""
    k1 = stored(f.feature_table(f.clean_sources(air(spark, d), weather(spark, d))))
    store = stored(hz.horizon_store(k1))
    spec = replace(boost.DIRECT, rounds=1, rate=0.5, depth=1, rows=1.0, columns=1.0)
    models = boost.fit_boosted(store, list(range(1, 73)), spec, ["pm10"])
    return m.regression_metrics(boost.score_store(store, models), "target", "prediction", ("horizon",)).select(
        "horizon", "row_count", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("m7_hist_boosting")
def _(spark, d):
    """Best-first trees of 20 leaves, up to 300 rounds, stopped where the held-out rows no longer improve."""
    store = horizon_rows(spark, d)
    train = store.where(F.col(TIME) < F.lit(CUT).cast("timestamp_ntz"))
    models = boost.fit_boosted(train, [24], boost.HISTOGRAM, blocks=1)
    return boost.boosted_metrics(store, models, CUT, "Histogram boosting", series=ROWS).withColumn(
        "rounds", F.lit(len(models[24].trees)))


_RETRAIN_L = "SELECT a.time, a.us_aqi, a.pm10, p.horizon, p.y FROM k1 a JOIN p ON p.time = a.time QUALIFY count(*) OVER (PARTITION BY a.time) = 72"
_RETRAIN_G = "SELECT *, CASE WHEN epoch(time) < (SELECT quantile_cont(epoch(time), 0.8) FROM (SELECT DISTINCT time FROM l)) THEN 'train' ELSE 'test' END AS part FROM l"


@query("m11_retrain", with_frames("pair", "SELECT s.*, CAST(2 AS BIGINT) AS version, CAST(2 AS BIGINT) AS promoted_from_version, t.training_rows FROM (" + _SCORES.format(
    name="Ridge Regression", src="SELECT g.horizon, y, my + b1 * (us_aqi - m1) + b2 * (pm10 - m2) AS p FROM g JOIN fit ON fit.horizon = g.horizon WHERE part = 'test'")
    + ") s JOIN (SELECT horizon, count(*) AS training_rows FROM g WHERE part = 'train' GROUP BY horizon) t USING (horizon)",
    k1=k1_sql("pair", True), p=_PAIRS, l=_RETRAIN_L, g=_RETRAIN_G, mom=_MOM, fit=_FIT))
def _(spark, d):
    """A first version with another penalty, then the retraining job: 72 horizons fitted, scored, registered and compared."""
    k1 = stored(f.feature_table(f.clean_sources(air(spark, d), weather(spark, d))))
    targets = stored(f.wide_targets(k1))
    root = scratch_path(spark, "models")
    inputs = ["us_aqi", "pm10"]
    for alpha, label in ((1000.0, "first"), (1.0, "second")):
        version, promotion = rt.retrain(scratch_path(spark, label), k1, targets, rt.ridge_learner(inputs, alpha), root, chunk=36)
    metrics = spark.read.parquet(f"{root}/version={version}/metrics")
    return show(metrics.withColumnRenamed("forecast_horizon_hours", "horizon").withColumn("version", F.lit(version).cast("long")).join(
        promotion.select(F.col("version").alias("promoted_from_version")))).select(
        "model", "horizon", "test_rows", "mae", "rmse", "r2", "version", "promoted_from_version", "training_rows")


_SHIFT = "l.time + to_hours(h) - INTERVAL 96 HOUR"


def forecast_sql(newest: str) -> str:
    """The forecasts of the given newest feature rows, all 72 hours of each, by the closed-form ridge fits."""
    return (
        "SELECT series_id, time AS forecast_generated_at, forecast_time, horizon_hours, round(predicted_aqi, 3) AS predicted_aqi, forecast_temperature, forecast_wind_speed, "
        + CATEGORY_SQL.format(x="predicted_aqi") + " AS aqi_category FROM (SELECT l.series_id, l.time, l.time + to_hours(h) AS forecast_time, h AS horizon_hours, "
        "greatest(0, my + b1 * (l.us_aqi - m1) + b2 * (l.pm10 - m2)) AS predicted_aqi, coalesce(w.temperature_2m, 0) AS forecast_temperature, "
        f"coalesce(w.wind_speed_10m, 0) AS forecast_wind_speed FROM ({newest}) l, "
        f"(SELECT unnest(range(1, 73)) AS h) JOIN fit ON fit.horizon = h LEFT JOIN weather w ON w.time = {_SHIFT})")


_FORECAST_PARTS = dict(k1=k1_sql("pair", True), p=_PAIRS, g=_G72, mom=_MOM, fit=_FIT)
_SHOWN = [KEY, "forecast_generated_at", "forecast_time", "horizon_hours", "predicted_aqi", "forecast_temperature", "forecast_wind_speed", "aqi_category"]


def _forecast_setup(spark, d):
    """Feature rows, one ridge model a horizon, the weather of the hours ahead, an empty forecast table."""
    w = weather(spark, d)
    k1 = stored(f.feature_table(f.clean_sources(air(spark, d), w)))
    train = k1.join(f.wide_targets(k1), [KEY, TIME]).withColumn("part", F.lit("train"))
    models = m.ridge_by_horizon(train, ["us_aqi", "pm10"], list(range(1, 73)))
    future = stored(densify(w).na.fill(0.0).withColumn(TIME, add_hours(TIME, 96)))
    root = scratch_path(spark, "tables")
    return k1, models, future, root, create_table(spark, root, "forecast", 1, (KEY, "forecast_time"), "forecast_time")


def _published(forecasts):
    return forecasts.read().withColumn("predicted_aqi", F.round("predicted_aqi", 3)).select(*_SHOWN)


@query("i9_run_forecast", with_frames("pair", forecast_sql("SELECT * FROM k1 ORDER BY time DESC LIMIT 1"), **_FORECAST_PARTS))
def _(spark, d):
    """Stored features, one ridge model a horizon, weather of the next 72 hours: checked and published."""
    k1, models, future, root, forecasts = _forecast_setup(spark, d)
    table = create_table(spark, root, "features", 1, (KEY, TIME), TIME)
    table.upsert(k1)
    inc.run_forecast(table, future, models, MODEL_COLUMNS, forecasts)
    return _published(forecasts)


@query("m9_score_horizons", with_frames("pair", forecast_sql("SELECT * FROM k1 ORDER BY time DESC LIMIT 1"), **_FORECAST_PARTS))
def _(spark, d):
    """All 72 models score the live inputs in one pass."""
    k1, models, future, _, _ = _forecast_setup(spark, d)
    inputs = hz.live_inputs(k1, future)
    return m.score_horizons(models, inputs, MODEL_COLUMNS).withColumn("predicted_aqi", F.round("predicted_aqi", 3)).select(*_SHOWN)


_CUTS = ("2024-01-25 00:00:00", "2024-01-26 12:00:00", "2024-12-31 00:00:00")


@query("i11_forecast_stream", with_frames(
    "pair", "SELECT * FROM (" + forecast_sql(" UNION ".join(
        f"SELECT * FROM (SELECT * FROM k1 WHERE time < TIMESTAMP '{c}' ORDER BY time DESC LIMIT 1)" for c in _CUTS)) +
    ") QUALIFY row_number() OVER (PARTITION BY series_id, forecast_time ORDER BY forecast_generated_at DESC) = 1", **_FORECAST_PARTS))
def _(spark, d):
    """Feature rows land in three micro-batches, each forecasts 72 hours; late rows land after them and publish nothing."""
    k1, models, future, _, forecasts = _forecast_setup(spark, d)
    path, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "checkpoint")
    edges = [F.lit(c).cast("timestamp_ntz") for c in ("2000-01-01 00:00:00", *_CUTS)]
    late = k1.where(F.col(TIME) < edges[1])
    for rows in (*(k1.where((F.col(TIME) >= a) & (F.col(TIME) < b)) for a, b in zip(edges, edges[1:])), late):
        rows.write.mode("append").parquet(path)
        jobs.forecast_stream(spark.readStream.schema(k1.schema).parquet(path), future, models, MODEL_COLUMNS, forecasts,
                             checkpoint).awaitTermination()
    return _published(forecasts)


_LR = "SELECT series_id, time, us_aqi, pm10, " + ", ".join(f"{lead_sql('us_aqi', h)} AS y{h}" for h in REPORT_HORIZONS) + " FROM f2"
_LONG_R = " UNION ALL ".join(
    f"SELECT series_id, time, us_aqi, pm10, {h} AS horizon, y{h} AS y, CASE WHEN time < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS part "
    "FROM l WHERE y72 IS NOT NULL" for h in REPORT_HORIZONS)
_PARTS = " UNION ALL ".join(
    f"SELECT g.series_id, g.time, g.horizon, part, '{c}' AS feature, b{k} * ({c} - m{k}) AS contribution, my + b1 * (us_aqi - m1) + b2 * (pm10 - m2) AS prediction "
    "FROM g JOIN fit ON fit.horizon = g.horizon" for k, c in ((1, "us_aqi"), (2, "pm10")))


def _explained(spark, d):
    """Rows labelled for the six report horizons, and their ridge models on two inputs."""
    f2 = hourly_by_type(spark, d)
    labels = f.wide_targets(f2, 72, ROWS).select(KEY, TIME, *[target_name(h) for h in REPORT_HORIZONS])
    df = stored(splits.split_by_time(f2.join(labels, [KEY, TIME]), CUT))
    return df, m.ridge_by_horizon(df, ["us_aqi", "pm10"], REPORT_HORIZONS)


@query("m10_contributions", with_frames(
    "f2", "SELECT horizon, feature, round(avg(abs(contribution)), 5) AS mean_abs_contribution FROM parts WHERE part = 'test' GROUP BY horizon, feature",
    l=_LR, g=_LONG_R, mom=_MOM, fit=_FIT, parts=_PARTS))
def _(spark, d):
    """Mean absolute contribution of each input for the six report horizons, one scan."""
    df, models = _explained(spark, d)
    return rounded(m.contribution_table(df.where("part = 'test'"), models), ["mean_abs_contribution"], 5)


@query("m10_local_row", with_frames(
    "f2", "SELECT series_id, time, horizon, feature, round(contribution, 5) + 0.0 AS contribution, round(prediction, 5) AS prediction FROM (SELECT *, "
    "row_number() OVER (PARTITION BY series_id, horizon, feature ORDER BY time) - 1 AS rn, count(*) OVER (PARTITION BY series_id, horizon, feature) AS n "
    "FROM parts WHERE part = 'test') WHERE rn = floor(n / 2)", l=_LR, g=_LONG_R, mom=_MOM, fit=_FIT, parts=_PARTS))
def _(spark, d):
    """The middle test row of each series, explained for the six report horizons."""
    df, models = _explained(spark, d)
    out = m.local_contributions(df.where("part = 'test'"), models)
    return rounded(rounded(out, ["contribution"], 5), ["prediction"], 5)


@query("m10_permutation_importance")
def _(spark, d):
    df, model = _forest(spark, d)
    return m.permutation_importance(df.where("part = 'test'"), model, SHORT_FEATURES, "aqi_target_1h")


_REGISTERED = dict(k1=k1_sql("pair", True), p=_PAIRS, l="SELECT DISTINCT time, us_aqi, pm10 FROM p QUALIFY count(*) OVER (PARTITION BY time) = 72",
                   g=f"SELECT p.*, CASE WHEN time < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS part FROM p WHERE time IN (SELECT time FROM l)", mom=_MOM, fit=_FIT)


@query("m11_m12_registry", with_frames(
    "pair", "SELECT 'all' AS series_id, l.time, " + ", ".join(
        f"round(max(my + b1 * (us_aqi - m1) + b2 * (pm10 - m2)) FILTER (WHERE fit.horizon = {h}), 4) AS forecast_{h}h" for h in REPORT_HORIZONS)
    + ", 2 AS version FROM l CROSS JOIN fit GROUP BY l.time", **_REGISTERED))
def _(spark, d):
    """Two bundles of 72 linear models are registered; the newest one is read back and scores."""
    root, inputs, hs = scratch_path(spark, "models"), ["us_aqi", "pm10"], list(range(1, 73))
    k1 = f.feature_table(f.clean_sources(air(spark, d), weather(spark, d)))
    df = stored(splits.split_by_time(k1.join(f.wide_targets(k1), [KEY, TIME]), CUT))
    for alpha in (100.0, 1.0):
        models = m.ridge_by_horizon(df, inputs, hs, alpha)
        metrics = m.linear_metrics(df, models, "Ridge Regression").withColumnRenamed("horizon", "forecast_horizon_hours")
        reg.register_models(spark, root, models, inputs, metrics, {"model_type": "ridge"})
    version, models, saved = reg.load_latest_models(spark, root, inputs)
    scored = df.select(KEY, TIME, *[F.round(models[h].prediction(), 4).alias(f"forecast_{h}h") for h in REPORT_HORIZONS])
    return scored.withColumn("version", F.lit(version))


@query("f5_latest_version", with_frames("f2", "SELECT 10.0::DOUBLE AS alpha, 2::BIGINT AS version, 1::BIGINT AS number_of_models, mae AS mae_1h, rmse AS rmse_1h, r2 AS r2_1h FROM (" + _SCORES.format(
    name="Ridge Regression", src="SELECT g.horizon, y, my + b1 * (us_aqi - m1) + b2 * (pm10 - m2) AS p FROM g JOIN fit ON fit.horizon = g.horizon WHERE part = 'test' AND g.horizon = 1")
    + ")", l=_L, g=_LONG, mom=_MOM, fit=fit_sql(10)))
def _(spark, d):
    root = scratch_path(spark, "models")
    df = stored(labelled(spark, d))
    for alpha in (1.0, 10.0):
        models = m.ridge_by_horizon(df, ["us_aqi", "pm10"], [1], alpha)
        metrics = m.linear_metrics(df, models, "Ridge Regression").withColumnRenamed("horizon", "forecast_horizon_hours")
        reg.register_models(spark, root, models, ["us_aqi", "pm10"], metrics, {"alpha": alpha}, horizons=1)
    newest = reg.latest_version(reg.metadata_table(spark, root))
    return newest.select("alpha", "version", "number_of_models", F.round("mae_1h", 4).alias("mae_1h"),
                         F.round("rmse_1h", 4).alias("rmse_1h"), F.round("r2_1h", 6).alias("r2_1h"))


@query("f3_top_k_importance")
def _(spark, d):
    return m.feature_importance(_forest(spark, d, 72)[1], SHORT_FEATURES, spark, 10)


@query("f4_top_k_contribution", with_frames(
    "f2", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(abs(b{k} * ({c} - m{k}))), 5) AS mean_abs_contribution FROM g JOIN fit ON fit.horizon = g.horizon "
                             "WHERE g.horizon = 24" for k, c in ((1, "us_aqi"), (2, "pm10"))), l=_L, g=_LONG, mom=_MOM, fit=_FIT))
def _(spark, d):
    df = stored(labelled(spark, d))
    model = m.ridge_by_horizon(df, ["us_aqi", "pm10"], [24])[24]
    return rounded(m.contribution_ranking(df, model, 20), ["mean_abs_contribution"], 5)
