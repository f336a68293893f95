"""Forecast evaluation queries: W5, A25-A29, A33, M8, M16, M17."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.columns import round_half_up
from larder.operators import evaluation as ev
from larder.operators import features as fe
from larder.plans import series
from larder.plans.registry import register
from larder.plans.sqlfrag import rnd
from larder.sources.binding import Marketplace

METRICS = ["mae", "rmse", "mape", "mape_eps", "r2"]
# mape_eps divides by actual + 1e-8, so a zero-demand day contributes ~1e8 x
# error and the metric reaches 1e10: published at 2 decimals (the digits a
# double still holds at that size); the other metrics at 6.
DIGITS = {"mape_eps": 2}


def _r6(df, cols):
    return df.select(*[round_half_up(c, DIGITS.get(c, 6)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def _metrics_sql(group: str) -> str:
    return f"""
SELECT {group}, COUNT(*) AS n,
       {rnd('AVG(ABS(actual - predicted))', 6)} AS mae,
       {rnd('SQRT(AVG((actual - predicted) * (actual - predicted)))', 6)} AS rmse,
       {rnd('AVG(ABS(actual - predicted) / GREATEST(actual, 1.0)) * 100', 6)} AS mape,
       {rnd('AVG(ABS((actual - predicted) / (actual + 1e-8))) * 100', 2)} AS mape_eps,
       {rnd('1 - SUM((actual - predicted) * (actual - predicted)) / (COUNT(*) * VAR_POP(actual))', 6)} AS r2
FROM preds GROUP BY {group}
"""


MA_SQL = series.PREDICTIONS_SQL + f"""
SELECT category, date, actual, {rnd('predicted', 6)} AS predicted FROM preds WHERE model = 'moving_average'
"""


@register("moving_average_forecast", covers=("W5", "W20", "U2"), sql=MA_SQL)
def moving_average_forecast(spark, sf_dir):
    p = series.predictions(Marketplace(spark, sf_dir)).where(F.col("model") == "moving_average")
    return _r6(p.drop("model"), ["predicted"])


METRICS_SQL = series.PREDICTIONS_SQL + _metrics_sql("model")


@register("forecast_model_metrics", covers=("A26", "M16", "F17"), sql=METRICS_SQL)
def forecast_model_metrics(spark, sf_dir):
    m = ev.error_metrics(series.predictions(Marketplace(spark, sf_dir)), group=["model"])
    return _r6(m, METRICS)


CAT_METRICS_SQL = series.PREDICTIONS_SQL + f"""
, m AS ({_metrics_sql('model, category')})
SELECT category,
       MAX(rmse) FILTER (WHERE model = 'last_value') AS last_value,
       MAX(rmse) FILTER (WHERE model = 'moving_average') AS moving_average,
       MAX(rmse) FILTER (WHERE model = 'seasonal_naive') AS seasonal_naive
FROM m GROUP BY category
"""


@register("forecast_rmse_by_category", covers=("A27",), sql=CAT_METRICS_SQL)
def forecast_rmse_by_category(spark, sf_dir):
    m = _r6(ev.error_metrics(series.predictions(Marketplace(spark, sf_dir)), group=["model", "category"]),
            METRICS)
    return ev.pivot_metric(m, "category", "model", "rmse", series.MODELS)


IMPROVE_SQL = series.PREDICTIONS_SQL + f"""
, m AS ({_metrics_sql('model')})
SELECT model, rmse,
       {rnd("(rmse - (SELECT rmse FROM m WHERE model = 'moving_average')) / (SELECT rmse FROM m WHERE model = 'moving_average') * 100", 6)}
           AS rmse_change_pct
FROM m
"""


@register("forecast_improvement", covers=("A28",), sql=IMPROVE_SQL)
def forecast_improvement(spark, sf_dir):
    m = _r6(ev.error_metrics(series.predictions(Marketplace(spark, sf_dir)), group=["model"]), METRICS)
    c = ev.compare_models(m.select("model", "rmse"), "moving_average", "rmse")
    return _r6(c, ["rmse_change_pct"])


BEST_SQL = series.PREDICTIONS_SQL + f"""
, m AS ({_metrics_sql('model, category')})
SELECT category, arg_min(model, (rmse, model)) AS best_model, MIN(rmse) AS best_rmse
FROM m GROUP BY category
"""


@register("forecast_best_model", covers=("A29",), sql=BEST_SQL)
def forecast_best_model(spark, sf_dir):
    m = _r6(ev.error_metrics(series.predictions(Marketplace(spark, sf_dir)), group=["model", "category"]),
            METRICS)
    return ev.best_model(m, "rmse", "model", ["category"])


TOTALS_SQL = series.PREDICTIONS_SQL + f"""
SELECT model, date, SUM(actual) AS actual, {rnd('SUM(predicted)', 6)} AS predicted
FROM preds GROUP BY model, date
"""


@register("forecast_daily_totals", covers=("A25", "A24"), sql=TOTALS_SQL)
def forecast_daily_totals(spark, sf_dir):
    p = series.predictions(Marketplace(spark, sf_dir))
    t = p.groupBy("model", "date").agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"))
    return _r6(t, ["predicted"])


ROLL_UP_SQL = series.PRODUCT_DAY_SQL + f"""
, dates AS (SELECT DISTINCT date FROM pd)
, cut AS (
    SELECT date AS cut_date FROM (
        SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS k FROM dates) t
    WHERE i = CAST(floor(k * 0.8) AS BIGINT))
, pp AS (
    SELECT category, date, quantity_sold AS actual,
           COALESCE(AVG(quantity_sold) OVER (PARTITION BY product_id ORDER BY date
                                             ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0) AS moving_average,
           COALESCE(LAG(quantity_sold, 1) OVER (PARTITION BY product_id ORDER BY date), 0.0) AS last_value,
           COALESCE(LAG(quantity_sold, 7) OVER (PARTITION BY product_id ORDER BY date), 0.0) AS seasonal_naive
    FROM pd)
, u AS (
    SELECT 'moving_average' AS model, category, date, actual, moving_average AS predicted FROM pp
    UNION ALL SELECT 'last_value', category, date, actual, last_value FROM pp
    UNION ALL SELECT 'seasonal_naive', category, date, actual, seasonal_naive FROM pp)
SELECT model, category, date, SUM(actual) AS actual, {rnd('SUM(predicted)', 6)} AS predicted, COUNT(*) AS products
FROM u, cut WHERE date >= cut_date GROUP BY model, category, date
"""


@register("product_forecast_rollup", covers=("M17", "J14"), sql=ROLL_UP_SQL)
def product_forecast_rollup(spark, sf_dir):
    """Product-level baseline predictions of the test dates summed per category
    and date."""
    pd_ = series.product_day(Marketplace(spark, sf_dir))
    p = pd_.select("product_id", "date", F.col("quantity_sold").alias("actual"))
    parts = {"moving_average": ev.moving_average_forecast(p, "product_id", ["date"], "actual", 7),
             "last_value": ev.naive_forecast(p, "product_id", ["date"], "actual", 1),
             "seasonal_naive": ev.naive_forecast(p, "product_id", ["date"], "actual", 7)}
    test = fe.split_by_date_position(pd_.select("date").distinct(), 0.8).where(F.col("split") == "test")
    cut = test.select(F.min("date")).scalar()
    out = None
    for name, part in parts.items():
        part = part.where(F.col("date") >= cut).select(F.lit(name).alias("model"), "product_id", "date", "actual", "predicted")
        out = part if out is None else out.unionByName(part)
    return _r6(ev.roll_up(out, pd_), ["predicted"])


BLEND_SQL = series.PREDICTIONS_SQL + f"""
, pair AS (
    SELECT a.actual, a.predicted AS p1, b.predicted AS p2
    FROM preds a JOIN preds b ON a.category = b.category AND a.date = b.date
    WHERE a.model = 'moving_average' AND b.model = 'seasonal_naive')
SELECT CAST(k AS DOUBLE) / 20.0 AS weight,
       {rnd('SQRT(AVG(POWER(actual - ((CAST(k AS DOUBLE) / 20.0) * p1 + (1 - CAST(k AS DOUBLE) / 20.0) * p2), 2)))', 6)}
           AS rmse
FROM pair, range(0, 21) t(k) GROUP BY k
"""


@register("forecast_blend_weights", covers=("M8",), sql=BLEND_SQL)
def forecast_blend_weights(spark, sf_dir):
    p = series.predictions(Marketplace(spark, sf_dir))
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("predicted")))  # noqa: E731  one row per model and day
    both = p.groupBy("category", "date").agg(F.max("actual").alias("actual"), one("moving_average").alias("p1"),
                                             one("seasonal_naive").alias("p2"))
    return _r6(ev.blend_weights(both, "p1", "p2"), ["rmse"])


HIST_SQL = series.PREDICTIONS_SQL + f"""
, r AS (SELECT actual - predicted AS res FROM preds WHERE model = 'moving_average')
, mm AS (SELECT MIN(res) AS lo, MAX(res) AS hi FROM r)
, b AS (
    SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE LEAST(FLOOR((res - lo) / (hi - lo) * 25.0), 24) END AS INTEGER) AS bin,
           COUNT(*) AS cnt
    FROM r, mm GROUP BY 1)
SELECT s.bin, {rnd('lo + s.bin * ((hi - lo) / 25.0)', 6)} AS bin_start,
       {rnd('lo + (s.bin + 1) * ((hi - lo) / 25.0)', 6)} AS bin_end, COALESCE(b.cnt, 0) AS count
FROM (SELECT CAST(i AS INTEGER) AS bin FROM range(0, 25) t(i)) s CROSS JOIN mm
LEFT JOIN b ON b.bin = s.bin
"""


@register("forecast_residual_histogram", covers=("A33",), sql=HIST_SQL)
def forecast_residual_histogram(spark, sf_dir):
    p = series.predictions(Marketplace(spark, sf_dir)).where(F.col("model") == "moving_average")
    return _r6(ev.residual_histogram(p, 25), ["bin_start", "bin_end"])
