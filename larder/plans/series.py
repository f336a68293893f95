"""Daily demand series shared by the feature and evaluation queries, in
DataFrame form and restated as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import evaluation as ev
from larder.operators import features as fe
from larder.operators.calendar import fill_daily_grid
from larder.plans.sql_binding import with_views
from larder.plans.sqlfrag import rnd
from larder.sources.binding import Marketplace, holiday_of, weather_of

MODELS = ["last_value", "moving_average", "seasonal_naive"]


def with_price_mean(agg_df: DataFrame, micros_sum: str = "_pm", n: str = "orders_count") -> DataFrame:
    """Mean unit price to 6 dp, HALF_UP, in exact integer arithmetic on the
    aggregated micro-unit sum (independent of row order and of an engine's
    decimal casts)."""
    return agg_df.withColumn(
        "price_mean", F.expr(f"CAST((2 * {micros_sum} + {n}) div (2 * {n}) AS DOUBLE) / 1000000.0")
    ).drop(micros_sum)


def product_day(mk: Marketplace) -> DataFrame:
    """A23 per product: (product_id, category, date, quantity_sold,
    orders_count, price_mean)."""
    return with_price_mean(mk.demand.groupBy("product_id", "category", "date").agg(
        F.sum("quantity_sold").alias("quantity_sold"),
        F.count(F.lit(1)).alias("orders_count"),
        F.sum("price_micros").alias("_pm")))


def category_day(mk: Marketplace) -> DataFrame:
    """Category-day demand, mean price and row count."""
    return with_price_mean(mk.demand.groupBy("category", "date").agg(
        F.sum("quantity_sold").alias("demand"),
        F.count(F.lit(1)).alias("orders_count"),
        F.sum("price_micros").alias("_pm")))


def category_grid(mk: Marketplace) -> DataFrame:
    """W16 + W15: full daily grid per category (demand/count 0 on empty
    days), price forward- then backward-filled, weather and holiday of the
    date."""
    g = fill_daily_grid(category_day(mk), ["category"], "date", ["demand", "orders_count"])
    w = fe.series_window("category", "date")
    return g.select("category", "date", "demand", "orders_count",
                    fe.fill_forward_backward("price_mean", w).alias("price_mean"),
                    weather_of(F.col("date")).alias("weather_condition"),
                    holiday_of(F.col("date")).alias("is_holiday"))


def predictions(mk: Marketplace) -> DataFrame:
    """Test-period predictions of three baselines on the category grid:
    (model, category, date, actual, predicted). Test = dates from the
    distinct-date cut at 80 % (W20)."""
    g = category_grid(mk).select("category", "date", F.col("demand").alias("actual"))
    split = fe.split_by_date_position(g.select("date").distinct(), 0.8)
    cut = split.where(F.col("split") == "test").select(F.min("date")).scalar()
    parts = {
        "moving_average": ev.moving_average_forecast(g, "category", ["date"], "actual", 7),
        "last_value": ev.naive_forecast(g, "category", ["date"], "actual", 1),
        "seasonal_naive": ev.naive_forecast(g, "category", ["date"], "actual", 7),
    }
    out = None
    for name in MODELS:
        p = parts[name].where(F.col("date") >= cut).select(
            F.lit(name).alias("model"), "category", "date", "actual", "predicted")
        out = p if out is None else out.unionByName(p)
    return out


# ---- SQL restatement ---------------------------------------------------------

def sql_price_mean(micros: str = "price_micros") -> str:
    return f"CAST((2 * SUM({micros}) + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 1000000.0"


PRODUCT_DAY_SQL = with_views("b_demand") + f"""
, pd AS (
    SELECT product_id, category, date, SUM(quantity_sold) AS quantity_sold,
           COUNT(*) AS orders_count, {sql_price_mean()} AS price_mean
    FROM b_demand GROUP BY product_id, category, date)
"""

CATEGORY_DAY_SQL = f"""
, cd AS (
    SELECT category, date, SUM(quantity_sold) AS demand, COUNT(*) AS orders_count,
           {sql_price_mean()} AS price_mean
    FROM b_demand GROUP BY category, date)
, bounds AS (SELECT category, MIN(date) AS lo, MAX(date) AS hi FROM cd GROUP BY category)
, grid0 AS (
    SELECT b.category, CAST(g.d AS DATE) AS date
    FROM bounds b, LATERAL (SELECT unnest(generate_series(CAST(b.lo AS TIMESTAMP), CAST(b.hi AS TIMESTAMP),
                                                          INTERVAL 1 DAY)) AS d) g)
, grid AS (
    SELECT g.category, g.date, COALESCE(cd.demand, 0.0) AS demand,
           COALESCE(cd.orders_count, 0) AS orders_count,
           COALESCE(cd.price_mean,
                    LAST_VALUE(cd.price_mean IGNORE NULLS) OVER (PARTITION BY g.category ORDER BY g.date
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    FIRST_VALUE(cd.price_mean IGNORE NULLS) OVER (PARTITION BY g.category ORDER BY g.date
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price_mean,
           CASE dayofyear(g.date) % 3 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Rainy' ELSE 'Cloudy' END
               AS weather_condition,
           CAST(dayofyear(g.date) % 10 = 0 AS INTEGER) AS is_holiday
    FROM grid0 g LEFT JOIN cd ON cd.category = g.category AND cd.date = g.date)
"""

GRID_SQL = with_views("b_demand") + CATEGORY_DAY_SQL

PREDICTIONS_SQL = GRID_SQL + """
, dates AS (SELECT DISTINCT date FROM grid)
, cut AS (
    SELECT date AS cut_date FROM (
        SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS k FROM dates) t
    WHERE i = CAST(floor(k * 0.8) AS BIGINT))
, base AS (
    SELECT category, date, demand AS actual,
           COALESCE(AVG(demand) OVER (PARTITION BY category ORDER BY date
                                      ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0) AS p_ma,
           COALESCE(LAG(demand, 1) OVER (PARTITION BY category ORDER BY date), 0.0) AS p_last,
           COALESCE(LAG(demand, 7) OVER (PARTITION BY category ORDER BY date), 0.0) AS p_seas
    FROM grid)
, preds AS (
    SELECT 'moving_average' AS model, category, date, actual, p_ma AS predicted FROM base, cut WHERE date >= cut_date
    UNION ALL
    SELECT 'last_value', category, date, actual, p_last FROM base, cut WHERE date >= cut_date
    UNION ALL
    SELECT 'seasonal_naive', category, date, actual, p_seas FROM base, cut WHERE date >= cut_date)
"""
