"""Queries for aggregates (E), sorts and limits (F) and reports (L)."""

from pyspark.sql import functions as F

from tidemark.catalog.frames import (
    air, events, forecast, hourly_by_type, redelivered, table, weather, with_frames,
    with_nulls,
)
from tidemark.catalog.registry import query
from tidemark.catalog.windows import ROWS, rounded
from tidemark.functions.calendar import day_of_week, hour_of, month_of
from tidemark.functions.scoring import MONTHS, WEEKDAYS, label_of
from tidemark.operators import aggregates as a
from tidemark.operators import keyed, project
from tidemark.operators.joins import join_sources
from tidemark.operators.quantiles import time_quantile
from tidemark.operators.rolling import lags
from tidemark.operators.sets import union_all
from tidemark.plans import reports
from tidemark.schemas import KEY, TIME

HORIZONS = [1, 6, 24, 48, 72]


def cents(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias(TIME),
        F.round(F.col("l_extendedprice") * 100).alias("price"))


_LI = "(SELECT l_orderkey, l_linenumber, l_shipdate AS time, round(l_extendedprice * 100) AS price FROM lineitem)"


def scored(spark, d):
    """Persistence forecasts at five horizons in long form: y and the value h rows before."""
    f2 = lags(hourly_by_type(spark, d), "us_aqi", HORIZONS, ROWS)
    return f2.select(KEY, TIME, F.col("us_aqi").alias("y"), F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"aqi_lag_{h}h").alias("yhat")) for h in HORIZONS])))


_SCORED = " UNION ALL ".join(
    f"SELECT series_id, time, us_aqi AS y, {h} AS horizon, lag(us_aqi, {h}) OVER (PARTITION BY series_id ORDER BY time) AS yhat FROM f2"
    for h in HORIZONS)
_METRICS = ("SELECT {by}, count(*) AS row_count, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, "
            "1 - sum((y - yhat) * (y - yhat)) / nullif(var_pop(y) * count(*), 0) AS r2 FROM s WHERE yhat IS NOT NULL GROUP BY {by}")
_R6 = "row_count, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 6) AS r2"


def metric_round(df):
    return df.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4), "r2": F.round("r2", 6)})


@query("e1_profile_range", "SELECT count(*) AS row_count, min(l_shipdate) AS min_time, max(l_shipdate) AS max_time FROM lineitem")
def _(spark, d):
    return a.profile_range(table(spark, d, "lineitem"), "l_shipdate")


@query("e2_null_counts", with_frames(
    "f6", "SELECT * FROM (SELECT count(*) - count(us_aqi) AS us_aqi, count(*) - count(pm2_5) AS pm2_5, count(*) - count(pm10) AS pm10, "
    "count(*) - count(series_id) AS series_id, count(*) - count(time) AS time FROM f6) "
    "UNPIVOT (null_count FOR column_name IN (us_aqi, pm2_5, pm10, series_id, time))"))
def _(spark, d):
    return a.null_counts(with_nulls(spark, d))


@query("e3_duplicate_count", with_frames("f5", "SELECT count(*) - count(DISTINCT (series_id, time)) AS duplicate_rows FROM f5"))
def _(spark, d):
    return a.duplicate_count(redelivered(spark, d), [KEY, TIME])


_DESCRIBE = (f"SELECT count(price) AS count, avg(price) AS mean, round(stddev_samp(price), 3) AS std, min(price) AS min, "
       f"quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS p50, quantile_cont(price, 0.75) AS p75, max(price) AS max FROM {_LI}")


@query("e4_describe", _DESCRIBE)
def _(spark, d):
    return rounded(a.describe(cents(spark, d), "price"), ["std"], 3)


@query("e5_mean_median", f"SELECT avg(price) AS mean, median(price) AS median FROM {_LI}")
def _(spark, d):
    return a.mean_and_median(cents(spark, d), "price")


@query("e6_mean_by_hour", with_frames("ev", "SELECT CAST(hour(ts) AS INTEGER) AS hour, avg(cents) AS mean_cents FROM ev GROUP BY 1"))
def _(spark, d):
    return a.mean_by(events(spark, d), hour_of("ts"), "hour", "cents")


@query("e7_mean_by_weekday", f"SELECT CAST(isodow(time) - 1 AS INTEGER) AS day_of_week, avg(price) AS mean_price, dayname(any_value(time)) AS day_of_week_name FROM {_LI} GROUP BY 1")
def _(spark, d):
    return a.mean_by(cents(spark, d), day_of_week(TIME), "day_of_week", "price", label_of("day_of_week", WEEKDAYS))


@query("e8_mean_by_month", f"SELECT CAST(month(time) AS INTEGER) AS month, avg(price) AS mean_price, strftime(any_value(time), '%b') AS month_name FROM {_LI} GROUP BY 1")
def _(spark, d):
    return a.mean_by(cents(spark, d), month_of(TIME), "month", "price", label_of("month", MONTHS, first=1))


_C = reports.CORRELATED


_MATRIX = with_frames("pair", " UNION ALL ".join(
    f"SELECT '{x}' AS \"left\", '{y}' AS \"right\", round(CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END, 6) AS correlation FROM pair"
    for i, x in enumerate(_C) for y in _C[i + 1:]))
_WITH = with_frames("pair", " UNION ALL ".join(
    f"SELECT '{y}' AS variable, round(corr(us_aqi, {y}), 6) AS correlation FROM pair" for y in _C))


@query("e9_corr_matrix", _MATRIX)
def _(spark, d):
    return rounded(a.corr_matrix(join_sources(air(spark, d), weather(spark, d)), _C), ["correlation"], 6)


@query("e10_corr_with", _WITH)
def _(spark, d):
    return rounded(a.corr_with(join_sources(air(spark, d), weather(spark, d)), "us_aqi", _C), ["correlation"], 6)


@query("e11_arg_max_row", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderdate LIMIT 1")
def _(spark, d):
    return keyed.extreme_row(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"),
                             "o_totalprice", True, tie="o_orderdate")


@query("e11_arg_min_row", with_frames(
    "f2", "SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY us_aqi, time) = 1"))
def _(spark, d):
    return keyed.extreme_row(hourly_by_type(spark, d), "us_aqi", False, (KEY,))


_HISTOGRAM = (f"SELECT CAST(b + 1 AS INTEGER) AS bin, mn + (mx - mn) / 40 * b AS bin_low, mn + (mx - mn) / 40 * (b + 1) AS bin_high, "
       f"count(price) AS count FROM (SELECT unnest(range(40)) AS b), (SELECT min(price) AS mn, max(price) AS mx FROM {_LI}) "
       f"LEFT JOIN {_LI} x ON least(floor((x.price - mn) / ((mx - mn) / 40)), 39) = b GROUP BY b, mn, mx")


@query("e12_histogram", _HISTOGRAM)
def _(spark, d):
    return a.histogram(cents(spark, d), "price", 40)


@query("e13_regression_metrics", with_frames("f2", f"SELECT horizon, {_R6} FROM ({_METRICS.format(by='horizon')})", s=_SCORED))
def _(spark, d):
    return metric_round(a.regression_metrics(scored(spark, d), "y", "yhat", ("horizon",)))


@query("e14_mean_metrics", with_frames(
    "f2", "SELECT round(avg(mae), 4) AS mean_mae, round(avg(rmse), 4) AS mean_rmse, round(avg(r2), 6) AS mean_r2 "
    f"FROM ({_METRICS.format(by='horizon')})", s=_SCORED))
def _(spark, d):
    out = a.mean_metrics(a.regression_metrics(scored(spark, d), "y", "yhat", ("horizon",)))
    return rounded(rounded(out, ["mean_mae", "mean_rmse"], 4), ["mean_r2"], 6)


_CUT = "2024-01-20 20:00:00"


def is_train():
    return F.col(TIME) < F.lit(_CUT).cast("timestamp_ntz")


@query("e15_training_mean", with_frames(
    "f2", f"SELECT horizon, avg(CASE WHEN time < TIMESTAMP '{_CUT}' THEN yhat END) AS training_mean FROM s GROUP BY horizon", s=_SCORED))
def _(spark, d):
    return a.training_mean(scored(spark, d), "yhat", is_train(), ("horizon",))


@query("e16_split_counts", with_frames(
    "f2", f"SELECT horizon, count(*) FILTER (WHERE time < TIMESTAMP '{_CUT}') AS training_rows, "
    f"count(*) FILTER (WHERE time >= TIMESTAMP '{_CUT}') AS test_rows FROM s WHERE yhat IS NOT NULL GROUP BY horizon", s=_SCORED))
def _(spark, d):
    return a.split_counts(scored(spark, d).where("yhat IS NOT NULL"), is_train(), ("horizon",))


@query("e17_time_quantile", "SELECT round(quantile_cont(epoch(l_shipdate), 0.8), 3) AS boundary_seconds FROM lineitem")
def _(spark, d):
    li = table(spark, d, "lineitem")
    at = time_quantile(li, "l_shipdate", 0.8)
    return li.agg(F.count(F.lit(1)).alias("n")).select(F.round(F.lit(at), 3).alias("boundary_seconds"))


_SUMMARY = ("SELECT max(predicted_aqi) FILTER (WHERE horizon_hours = 1) AS next_hour_aqi, avg(predicted_aqi) AS mean_all, "
            "avg(predicted_aqi) FILTER (WHERE horizon_hours <= 24) AS mean_24h, "
            "avg(predicted_aqi) FILTER (WHERE horizon_hours <= 48) AS mean_48h, avg(predicted_aqi) AS mean_72h, "
            "max(predicted_aqi) AS max_aqi, (SELECT forecast_time FROM f9 ORDER BY predicted_aqi DESC, horizon_hours LIMIT 1) AS max_time, "
            "min(predicted_aqi) AS min_aqi, (SELECT forecast_time FROM f9 ORDER BY predicted_aqi, horizon_hours LIMIT 1) AS min_time FROM f9")


@query("e18_forecast_summary", with_frames("f9", _SUMMARY))
def _(spark, d):
    return a.forecast_summary(forecast(spark, d))


@query("e19_prediction_extent", with_frames(
    "f9", "SELECT count(*) AS row_count, min(forecast_time) AS min_forecast_time, max(forecast_time) AS max_forecast_time, "
    "min(predicted_aqi) AS min_predicted, max(predicted_aqi) AS max_predicted FROM f9"))
def _(spark, d):
    return a.prediction_extent(forecast(spark, d))


def model_metrics(spark, d):
    """Metrics of the persistence forecast per series, as if each series were a model."""
    return a.regression_metrics(scored(spark, d), "y", "yhat", (KEY, "horizon")).withColumnRenamed(KEY, "model")


_BY_MODEL = _METRICS.format(by="series_id, horizon")
_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("e20_series_by_model", with_frames(
    "f2", "SELECT horizon, " + ", ".join(f"round(max(mae) FILTER (WHERE series_id = '{t}'), 4) AS {t}" for t in _TYPES)
    + f" FROM ({_BY_MODEL}) GROUP BY horizon", s=_SCORED))
def _(spark, d):
    return rounded(a.series_by_model(model_metrics(spark, d), _TYPES), _TYPES)


@query("e21_new_vs_refreshed", with_frames(
    "f2", f"SELECT series_id, count(*) FILTER (WHERE time > TIMESTAMP '{_CUT}') AS new_rows, "
    f"count(*) FILTER (WHERE time <= TIMESTAMP '{_CUT}') AS refreshed_rows FROM f2 GROUP BY series_id"))
def _(spark, d):
    return a.new_vs_refreshed(hourly_by_type(spark, d), F.lit(_CUT).cast("timestamp_ntz"), by=(KEY,))


@query("e22_row_delta", with_frames(
    "f6", "SELECT 'before' AS step, count(*) AS rows, 5 AS columns FROM f6 UNION ALL SELECT 'after', count(*), 5 FROM f6 "
    "WHERE us_aqi IS NOT NULL AND pm10 IS NOT NULL"))
def _(spark, d):
    df = with_nulls(spark, d)
    return a.row_delta(df, project.drop_null_any(df))


# -- sorts and limits ----------------------------------------------------------------------
@query("f1_sort_time", with_frames("f2", "SELECT * FROM f2 ORDER BY time, series_id"))
def _(spark, d):
    return hourly_by_type(spark, d).orderBy(TIME, KEY)


@query("f2_preview", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 5")
def _(spark, d):
    return project.preview(table(spark, d, "events").select("event_id", "ts", "value"), 5, ["ts", "event_id"])


@query("f7_shuffle_rows", "SELECT event_id, user_id, value FROM events")
def _(spark, d):
    return project.shuffle_rows(table(spark, d, "events").select("event_id", "user_id", "value"), ["event_id"])


@query("g1_union_metrics", with_frames(
    "f2", f"SELECT series_id AS model, horizon, {_R6} FROM ({_BY_MODEL}) UNION ALL "
    f"SELECT 'all' AS model, horizon, {_R6} FROM ({_METRICS.format(by='horizon')})", s=_SCORED))
def _(spark, d):
    whole = a.regression_metrics(scored(spark, d), "y", "yhat", ("horizon",)).withColumn("model", F.lit("all"))
    return metric_round(union_all(model_metrics(spark, d), whole))


@query("n3_metric_function", with_frames("f2", f"SELECT series_id AS model, horizon, {_R6} FROM ({_BY_MODEL})", s=_SCORED))
def _(spark, d):
    return metric_round(model_metrics(spark, d))


# -- reports -------------------------------------------------------------------------------
@query("l1_quality_report", with_frames(
    "f2", "SELECT f2.series_id, count(*) AS row_count, min(time) AS min_time, max(time) AS max_time, "
    "CAST(0 AS BIGINT) AS rows_with_nulls, CAST(0 AS BIGINT) AS duplicate_rows, coalesce(any_value(g.gaps), 0) AS gaps, "
    "coalesce(any_value(g.longest), 0.0) AS longest_gap_steps FROM f2 LEFT JOIN (SELECT series_id, count(*) AS gaps, "
    "max(epoch(time - prev) / 3600) AS longest FROM (SELECT series_id, time, lag(time) OVER (PARTITION BY series_id ORDER BY time) "
    "AS prev FROM f2) WHERE epoch(time - prev) > 3600 GROUP BY series_id) g ON g.series_id = f2.series_id GROUP BY f2.series_id"))
def _(spark, d):
    return reports.quality_report(hourly_by_type(spark, d))


_DIRTY = "SELECT series_id, time, us_aqi, pm2_5, pm10 FROM f6 UNION ALL SELECT series_id, time, us_aqi + 1, pm2_5, NULL FROM f6 WHERE hour(time) % 6 = 0"


@query("l1_quality_report_dirty", with_frames(
    "f6", "SELECT dirty.series_id, count(*) AS row_count, min(time) AS min_time, max(time) AS max_time, "
    "count(*) FILTER (WHERE us_aqi IS NULL OR pm2_5 IS NULL OR pm10 IS NULL) AS rows_with_nulls, count(*) - count(DISTINCT time) AS duplicate_rows, "
    "coalesce(any_value(g.gaps), 0) AS gaps, coalesce(any_value(g.longest), 0.0) AS longest_gap_steps FROM dirty LEFT JOIN (SELECT series_id, count(*) AS gaps, "
    "max(epoch(time - prev) / 3600) AS longest FROM (SELECT series_id, time, lag(time) OVER (PARTITION BY series_id ORDER BY time) AS prev FROM "
    "(SELECT DISTINCT series_id, time FROM dirty)) WHERE epoch(time - prev) > 3600 GROUP BY series_id) g ON g.series_id = dirty.series_id GROUP BY dirty.series_id",
    dirty=f"SELECT * FROM ({_DIRTY}) WHERE day(time) <> 7"))
def _(spark, d):
    """Missing values, repeated keys and a missing day."""
    rows = with_nulls(spark, d)
    again = rows.where(F.hour(TIME) % 6 == 0).withColumns({"us_aqi": F.col("us_aqi") + 1, "pm10": F.lit(None).cast("double")})
    return reports.quality_report(rows.unionByName(again).where(F.dayofmonth(TIME) != 7))


@query("l2_distribution_report", f"SELECT 'highest' AS part, time, price FROM (SELECT * FROM {_LI} ORDER BY price DESC, time LIMIT 1) "
       f"UNION ALL SELECT 'lowest', time, price FROM (SELECT * FROM {_LI} ORDER BY price, time LIMIT 1)")
def _(spark, d):
    r = reports.distribution_report(cents(spark, d).select(TIME, "price"), "price")
    return union_all(*[r[p].select(F.lit(p).alias("part"), TIME, "price") for p in ("highest", "lowest")])


@query("l2_summary", _DESCRIBE)
def _(spark, d):
    return rounded(reports.distribution_report(cents(spark, d), "price")["summary"], ["std"], 3)


@query("l2_histogram", _HISTOGRAM)
def _(spark, d):
    return reports.distribution_report(cents(spark, d), "price")["histogram"]


@query("l3_cycle_report", " UNION ALL ".join([
    f"SELECT 'hour' AS cycle, CAST(hour(time) AS INTEGER) AS code, avg(price) AS mean_price, CAST(hour(any_value(time)) AS VARCHAR) AS label FROM {_LI} GROUP BY 2",
    f"SELECT 'day_of_week', CAST(isodow(time) - 1 AS INTEGER) AS code, avg(price), dayname(any_value(time)) FROM {_LI} GROUP BY 2",
    f"SELECT 'month', CAST(month(time) AS INTEGER) AS code, avg(price), strftime(any_value(time), '%b') FROM {_LI} GROUP BY 2"]))
def _(spark, d):
    return reports.cycle_report(cents(spark, d), "price")


@query("l4_association_report", _WITH)
def _(spark, d):
    df = join_sources(air(spark, d), weather(spark, d))
    return rounded(reports.association_report(df, "us_aqi", reports.CORRELATED)["with_target"], ["correlation"], 6)


@query("l4_association_matrix", _MATRIX)
def _(spark, d):
    df = join_sources(air(spark, d), weather(spark, d))
    return rounded(reports.association_report(df, "us_aqi", reports.CORRELATED)["matrix"], ["correlation"], 6)


@query("l5_forecast_headline", with_frames(
    "f9", "SELECT next_hour_aqi, max_aqi, min_aqi, mean_24h, CASE WHEN max_aqi > 300 THEN 'hazardous' WHEN max_aqi > 200 THEN 'very_unhealthy' "
    "WHEN max_aqi > 150 THEN 'unhealthy' WHEN max_aqi > 100 THEN 'sensitive_groups' ELSE 'none' END AS alert FROM sm", sm=_SUMMARY))
def _(spark, d):
    return reports.forecast_headline(forecast(spark, d)).select(
        "next_hour_aqi", "max_aqi", "min_aqi", "mean_24h", "alert")


@query("l5_forecast_table", with_frames(
    "f9", 'SELECT forecast_time AS "Time", horizon_hours AS "Horizon (h)", predicted_aqi AS "Predicted AQI", aqi_category AS "AQI Category", '
    'forecast_temperature AS "Temperature °C", forecast_humidity AS "Humidity %", forecast_precipitation AS "Precipitation mm", '
    'forecast_wind_speed AS "Wind Speed" FROM f9'))
def _(spark, d):
    return reports.forecast_table(forecast(spark, d))


@query("l5_key_horizons", with_frames(
    "f9", "SELECT horizon_hours, forecast_time, predicted_aqi, aqi_category FROM f9 WHERE horizon_hours IN (1, 6, 12, 24, 48, 72)"))
def _(spark, d):
    return reports.key_horizons(forecast(spark, d))


@query("l6_model_comparison", with_frames(
    "f2", "SELECT series_id AS model, round(avg(mae), 4) AS mean_mae, round(avg(rmse), 4) AS mean_rmse, round(avg(r2), 6) AS mean_r2 "
    f"FROM ({_BY_MODEL}) GROUP BY series_id", s=_SCORED))
def _(spark, d):
    out = reports.model_comparison(model_metrics(spark, d), models=_TYPES)["means"]
    return rounded(rounded(out, ["mean_mae", "mean_rmse"], 4), ["mean_r2"], 6)


@query("l6_model_rows", with_frames("f2", f"SELECT series_id AS model, horizon, {_R6} FROM ({_BY_MODEL})", s=_SCORED))
def _(spark, d):
    return metric_round(reports.model_comparison(model_metrics(spark, d), models=_TYPES)["rows"])


@query("l6_by_model", with_frames(
    "f2", "SELECT horizon, " + ", ".join(f"round(max(mae) FILTER (WHERE series_id = '{t}'), 4) AS {t}" for t in _TYPES)
    + f" FROM ({_BY_MODEL}) GROUP BY horizon", s=_SCORED))
def _(spark, d):
    return rounded(reports.model_comparison(model_metrics(spark, d), models=_TYPES)["by_model"], _TYPES)


_DRIFT_COLUMNS = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
_DRIFT_X = " UNION ALL ".join(f"SELECT year(l_shipdate) AS period, '{n}' AS feature, round({c} * 100) AS v FROM lineitem" for n, c in _DRIFT_COLUMNS.items())
_DRIFT_E = ("SELECT feature, list_sort(list_distinct([" + ", ".join(f"quantile_cont(v, {k / 10})" for k in range(1, 10)) + "])) AS e FROM x WHERE period < 1997 GROUP BY feature")
_DRIFT_N = "SELECT period, x.feature, len(list_filter(e, lambda t: t < v)) AS bin, count(*) AS n, count(*) FILTER (WHERE period < 1997) AS r FROM x JOIN e ON e.feature = x.feature GROUP BY 1, 2, 3"
_DRIFT_G = ("SELECT g.period, g.feature, b.bin, coalesce(c.n, 0) AS n, coalesce(q.r, 0) AS r FROM (SELECT DISTINCT period, feature FROM c) g CROSS JOIN (SELECT unnest(range(10)) AS bin) b "
            "LEFT JOIN c ON c.period = g.period AND c.feature = g.feature AND c.bin = b.bin LEFT JOIN (SELECT feature, bin, sum(r) AS r FROM c GROUP BY 1, 2) q ON q.feature = g.feature AND q.bin = b.bin")
_DRIFT_S = ("SELECT *, n / sum(n) OVER w AS p, r / sum(r) OVER w AS q, sum(n) OVER u / sum(n) OVER w AS cp, sum(r) OVER u / sum(r) OVER w AS cq FROM g "
            "WINDOW w AS (PARTITION BY period, feature), u AS (PARTITION BY period, feature ORDER BY bin)")


@query("p_drift", "WITH x AS (" + _DRIFT_X + "), e AS (" + _DRIFT_E + "), c AS (" + _DRIFT_N + "), g AS (" + _DRIFT_G + "), s AS (" + _DRIFT_S + ") "
       "SELECT CAST(period AS INTEGER) AS period, feature, CAST(sum(n) AS BIGINT) AS rows, round(sum(CASE WHEN n > 0 OR r > 0 THEN (greatest(p, 1e-4) - greatest(q, 1e-4)) "
       "* ln(greatest(p, 1e-4) / greatest(q, 1e-4)) ELSE 0 END), 8) + 0.0 AS psi, round(max(abs(cp - cq)), 8) AS ks FROM s GROUP BY period, feature")
def _(spark, d):
    """Three measures of every year against the years before 1997."""
    df = table(spark, d, "lineitem").select("l_shipdate", *[F.round(F.col(c) * 100).alias(n) for n, c in _DRIFT_COLUMNS.items()])
    out = reports.drift_report(df, list(_DRIFT_COLUMNS), F.year("l_shipdate"), F.year("l_shipdate") < 1997)
    return rounded(out, ["psi", "ks"], 8)


@query("p_year_month_means", "SELECT CAST(year(time) AS INTEGER) AS year, " + ", ".join(
    f"avg(price) FILTER (WHERE month(time) = {i + 1}) AS {m.lower()}" for i, m in enumerate(MONTHS)) + f" FROM {_LI} GROUP BY 1")
def _(spark, d):
    return reports.year_month_means(cents(spark, d), "price")


@query("p_severity_metrics", with_frames(
    "f2", "SELECT severity, horizon, " + _R6 + " FROM (" + _METRICS.format(by="severity, horizon") + ")",
    s="SELECT *, CASE WHEN y > 5000 THEN 'severe' ELSE 'usual' END AS severity FROM (" + _SCORED + ")"))
def _(spark, d):
    severity = F.when(F.col("y") > 5000, "severe").otherwise("usual")
    return metric_round(a.regression_metrics(
        scored(spark, d).withColumn("severity", severity), "y", "yhat", ("severity", "horizon")))


