"""Time-series feature queries: F11, W1-W4, W6-W23, A23, A24, M19, M20.

Floating-point window statistics are rounded to 6 decimals in the
published output (both here and in the oracle): window sums are evaluated
in different orders by different engines, so raw doubles can differ in the
last bit.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from larder.functions.columns import round_half_up
from larder.operators import features as fe
from larder.operators import models as md
from larder.plans import series
from larder.plans.registry import register
from larder.plans.sql_binding import with_views
from larder.plans.sqlfrag import rnd
from larder.session import checkpoint_dir
from larder.sources.binding import Marketplace, holiday_of, weather_of

R6 = ["rolling_mean_7", "rolling_std_7", "rolling_mean_14", "rolling_std_14", "price_change"]


def _round(df, cols, digits=6):
    return df.select(*[round_half_up(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


PRODUCT_FEATURES_SQL = series.PRODUCT_DAY_SQL + f"""
, f AS (
    SELECT *,
           CAST(month(date) AS INTEGER) AS month, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
           CAST(day(date) AS INTEGER) AS day_of_month, CAST(quarter(date) AS INTEGER) AS quarter,
           CAST(isodow(date) - 1 AS INTEGER) AS day_of_week_num,
           CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
           LAG(quantity_sold, 1) OVER w AS lag_1, LAG(quantity_sold, 7) OVER w AS lag_7,
           LAG(quantity_sold, 14) OVER w AS lag_14,
           CASE WHEN COUNT(quantity_sold) OVER w7 >= 3 THEN AVG(quantity_sold) OVER w7 END AS rolling_mean_7,
           CASE WHEN COUNT(quantity_sold) OVER w7 >= 3 THEN STDDEV_SAMP(quantity_sold) OVER w7 END AS rolling_std_7,
           CASE WHEN COUNT(quantity_sold) OVER w14 >= 7 THEN AVG(quantity_sold) OVER w14 END AS rolling_mean_14,
           CASE WHEN COUNT(quantity_sold) OVER w14 >= 7 THEN STDDEV_SAMP(quantity_sold) OVER w14 END AS rolling_std_14,
           COALESCE(price_mean - LAG(price_mean, 1) OVER w, 0.0) AS price_change
    FROM pd
    WINDOW w AS (PARTITION BY product_id ORDER BY date),
           w7 AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
           w14 AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT product_id, category, date, quantity_sold, orders_count, price_mean, month, week_of_year,
       day_of_month, quarter, day_of_week_num, is_weekend, lag_1, lag_7, lag_14,
       {rnd('rolling_mean_7', 6)} AS rolling_mean_7, {rnd('rolling_std_7', 6)} AS rolling_std_7,
       {rnd('rolling_mean_14', 6)} AS rolling_mean_14, {rnd('rolling_std_14', 6)} AS rolling_std_14,
       {rnd('price_change', 6)} AS price_change
FROM f
WHERE lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND lag_14 IS NOT NULL
  AND rolling_mean_7 IS NOT NULL AND rolling_mean_14 IS NOT NULL AND rolling_std_7 IS NOT NULL
"""


def product_features(mk: Marketplace):
    """Time, lag and rolling features per product-day; rows without
    the required history are dropped (W18; rolling_std_14 not required)."""
    return product_features_of(series.product_day(mk))


def product_features_of(days):
    """The same from the daily series of the products."""
    pd_ = fe.time_features(days)
    w = fe.series_window("product_id", "date")
    out = pd_.select("*", *fe.lag_features("quantity_sold", [1, 7, 14], w),
                     *fe.rolling_features("quantity_sold", [7, 14], w, std="samp"),
                     fe.first_difference("price_mean", w).alias("price_change"))
    return out.na.drop(subset=["lag_1", "lag_7", "lag_14", "rolling_mean_7", "rolling_mean_14",
                               "rolling_std_7"])


@register("product_daily_features", covers=("F11", "W1", "W2", "W13", "W18", "A23"),
          sql=PRODUCT_FEATURES_SQL)
def product_daily_features(spark, sf_dir):
    return _round(product_features(Marketplace(spark, sf_dir)), R6)


STUDY_LAGS, STUDY_WINDOWS = (1, 2, 3, 7, 14, 30), (7, 14, 30)
STUDY_MADE = [f"lag_{k}" for k in STUDY_LAGS] + [f"rolling_{s}_{n}" for s in ("mean", "std") for n in STUDY_WINDOWS]


def study_features(pd_):
    """M18 on product-days: time, lags and rolling features of the study, price
    change, weather and holiday of the day; rows without any of them dropped."""
    w = fe.series_window("product_id", "date")
    out = fe.time_features(pd_).select(
        "product_id", "category", "date", "quantity_sold", "price_mean", "month", "quarter", "day_of_week_num",
        "is_weekend", weather_of(F.col("date")).alias("weather_condition"), holiday_of(F.col("date")).alias("is_holiday"),
        *fe.lag_features("quantity_sold", STUDY_LAGS, w), *fe.rolling_features("quantity_sold", STUDY_WINDOWS, w, std="samp"),
        fe.first_difference("price_mean", w).alias("price_change"))
    return out.na.drop(subset=STUDY_MADE)


def encoded(df, cols):
    """``df`` with ``cols`` replaced by one-hot vectors ``<col>_vec`` (M1): one
    place for each level of the train rows, all zeros for a level they do not
    have; ``<col>_column`` names the place that is set (``col_level``). A sparse
    vector holds any number of levels. The split and the levels come from the
    distinct dates and levels, made once: ``df`` is computed for these and for
    the rows, not for each."""
    checkpoint_dir(df.sparkSession)
    seen = df.select("date", *cols).distinct().checkpoint(eager=True)
    df = fe.split_by_date_position(df, 0.8, dates=seen)
    stages, vecs = md.one_hot_stages(cols)
    m = Pipeline(stages=stages).fit(fe.split_by_date_position(seen, 0.8).where(F.col("split") == "train"))
    out = m.transform(df)
    names = []
    for c, fitted in zip(cols, m.stages[::2], strict=True):
        place = F.col(f"{c}_idx").cast("int")
        names.append(F.when(place < len(fitted.labels), F.concat(F.lit(f"{c}_"), F.col(c))).alias(f"{c}_column"))
    return out.select(*[x for x in df.columns if x not in cols], *vecs, *names)


@register("product_features_encoded", covers=("M20", "M1"))
def product_features_encoded(spark, sf_dir):
    """M20 with the category one-hot."""
    return encoded(product_features(Marketplace(spark, sf_dir)), ["category"])


@register("study_features_encoded", covers=("M18", "M1"))
def study_features_encoded(spark, sf_dir):
    """M18 with category and weather one-hot."""
    return encoded(study_features(series.product_day(Marketplace(spark, sf_dir))), ["category", "weather_condition"])


def _study_sql() -> str:
    lags = ", ".join(f"LAG(quantity_sold, {k}) OVER w AS lag_{k}" for k in STUDY_LAGS)
    rolls = ", ".join(f"CASE WHEN COUNT(quantity_sold) OVER w{n} >= {max(1, n // 2)} THEN {f}(quantity_sold) OVER w{n} END AS rolling_{name}_{n}"
                      for f, name in (("AVG", "mean"), ("STDDEV_SAMP", "std")) for n in STUDY_WINDOWS)
    windows = ", ".join(f"w{n} AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in STUDY_WINDOWS)
    rounded = ", ".join(f"{rnd(c, 6)} AS {c}" if c.startswith("rolling") else c for c in STUDY_MADE)
    return series.PRODUCT_DAY_SQL + f"""
, f AS (
    SELECT product_id, category, date, quantity_sold, price_mean, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
           CAST(isodow(date) - 1 AS INTEGER) AS day_of_week_num, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
           CASE dayofyear(date) % 3 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Rainy' ELSE 'Cloudy' END AS weather_condition,
           CAST(dayofyear(date) % 10 = 0 AS INTEGER) AS is_holiday, {lags}, {rolls},
           COALESCE(price_mean - LAG(price_mean, 1) OVER w, 0.0) AS price_change
    FROM pd WINDOW w AS (PARTITION BY product_id ORDER BY date), {windows})
, g AS (SELECT * FROM f WHERE {" AND ".join(f"{c} IS NOT NULL" for c in STUDY_MADE)})
, dates AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS k FROM (SELECT DISTINCT date FROM g))
, cut AS (SELECT date AS cut_date FROM dates WHERE i = CAST(floor(k * 0.8) AS BIGINT))
, cats AS (SELECT category, ROW_NUMBER() OVER (ORDER BY category) - 1 AS place FROM (SELECT DISTINCT category FROM g, cut WHERE date < cut_date))
, wx AS (SELECT weather_condition, ROW_NUMBER() OVER (ORDER BY weather_condition) - 1 AS place
         FROM (SELECT DISTINCT weather_condition FROM g, cut WHERE date < cut_date))
SELECT product_id, date, quantity_sold, price_mean, month, quarter, day_of_week_num, is_weekend, is_holiday, {rounded}, {rnd("price_change", 6)} AS price_change,
       CASE WHEN date < cut_date THEN 'train' ELSE 'test' END AS split, CAST(cats.place AS INTEGER) AS category_place, CAST(wx.place AS INTEGER) AS weather_place
FROM g CROSS JOIN cut LEFT JOIN cats ON cats.category = g.category LEFT JOIN wx ON wx.weather_condition = g.weather_condition
"""


@register("study_feature_columns", covers=("M18", "M1", "F11", "W1", "W2", "W13", "W18", "W20"), sql=_study_sql())
def study_feature_columns(spark, sf_dir):
    """M18 in plain columns: of each one-hot vector the place that is set (null for a level the train rows lack)."""
    rows = fe.split_by_date_position(study_features(series.product_day(Marketplace(spark, sf_dir))), 0.8)
    stages, _ = md.one_hot_stages(["category", "weather_condition"])
    fitted = Pipeline(stages=stages).fit(rows.where(F.col("split") == "train"))
    out = fitted.transform(rows)
    place = lambda c, n: F.when(F.col(f"{c}_idx") < n, F.col(f"{c}_idx").cast("int"))
    sizes = [len(fitted.stages[i].labels) for i in (0, 2)]
    return _round(out.select("product_id", "date", "quantity_sold", "price_mean", "month", "quarter", "day_of_week_num", "is_weekend", "is_holiday",
                             *STUDY_MADE, "price_change", "split", place("category", sizes[0]).alias("category_place"),
                             place("weather_condition", sizes[1]).alias("weather_place")),
                  [*[c for c in STUDY_MADE if c.startswith("rolling")], "price_change"])


GRID_SQL = series.GRID_SQL + """
SELECT category, date, demand, orders_count, price_mean, weather_condition, is_holiday FROM grid
"""


@register("category_daily_grid", covers=("W16", "W15", "A24", "J9", "F18"), sql=GRID_SQL)
def category_daily_grid(spark, sf_dir):
    return series.category_grid(Marketplace(spark, sf_dir))


H_COLS = ["rolling_mean_7", "rolling_std_7", "rolling_min_7", "rolling_max_7", "price_std_7",
          "rainy_pct_last_7", "sunny_pct_last_7", "cloudy_pct_last_7", "holiday_proximity", "price_change"]

HYBRID_SQL = series.GRID_SQL + f"""
, g AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY date) AS rn,
           CASE WHEN weather_condition = LAG(weather_condition) OVER (PARTITION BY category ORDER BY date)
                THEN 0 ELSE 1 END AS chg
    FROM grid)
, g2 AS (
    SELECT *, SUM(chg) OVER (PARTITION BY category ORDER BY date
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl
    FROM g)
, h AS (
    SELECT category, date, demand, price_mean, weather_condition, is_holiday,
           CASE WHEN rn > 7 THEN AVG(demand) OVER p7 END AS rolling_mean_7,
           CASE WHEN rn > 7 THEN STDDEV_POP(demand) OVER p7 END AS rolling_std_7,
           CASE WHEN rn > 7 THEN MIN(demand) OVER p7 END AS rolling_min_7,
           CASE WHEN rn > 7 THEN MAX(demand) OVER p7 END AS rolling_max_7,
           CASE WHEN rn > 7 THEN STDDEV_POP(price_mean) OVER p7 END AS price_std_7,
           ROW_NUMBER() OVER (PARTITION BY category, isl ORDER BY date) AS weather_streak,
           SUM(CAST(weather_condition = 'Rainy' AS INTEGER)) OVER c7 AS rainy_days_last_7,
           SUM(is_holiday) OVER c7 AS holidays_last_7,
           AVG(CAST(weather_condition = 'Rainy' AS DOUBLE)) OVER c7 AS rainy_pct_last_7,
           AVG(CAST(weather_condition = 'Sunny' AS DOUBLE)) OVER c7 AS sunny_pct_last_7,
           AVG(CAST(weather_condition = 'Cloudy' AS DOUBLE)) OVER c7 AS cloudy_pct_last_7,
           COALESCE(rn - LAST_VALUE(CASE WHEN is_holiday = 1 THEN rn END IGNORE NULLS) OVER upto, 999)
               AS days_since_holiday,
           COALESCE(FIRST_VALUE(CASE WHEN is_holiday = 1 THEN rn END IGNORE NULLS) OVER from_now - rn, 999)
               AS days_until_holiday,
           COALESCE(price_mean - LAG(price_mean) OVER w, 0.0) AS price_change
    FROM g2
    WINDOW w AS (PARTITION BY category ORDER BY date),
           p7 AS (PARTITION BY category ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
           c7 AS (PARTITION BY category ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
           upto AS (PARTITION BY category ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           from_now AS (PARTITION BY category ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT category, date, demand, price_mean, weather_condition, is_holiday,
       {", ".join(rnd(c, 6) + " AS " + c for c in H_COLS[:8])},
       weather_streak, rainy_days_last_7, holidays_last_7, days_since_holiday, days_until_holiday,
       {rnd('GREATEST(COALESCE(CASE WHEN days_since_holiday <= 3 THEN 1 - days_since_holiday / 4.0 END, 0.0), '
            'COALESCE(CASE WHEN days_until_holiday <= 3 THEN 1 - days_until_holiday / 4.0 END, 0.0))', 6)}
           AS holiday_proximity,
       {rnd('price_change', 6)} AS price_change
FROM h
"""


def hybrid_windows(g, windows, lags=()):
    """Window features of the category grid ``g`` for every length in
    ``windows``: full-window demand stats (W3), price std (W6), weather streak
    (W7), rolling counts and shares (W8, W9), holiday distances and proximity
    (W10-W12), price change (W13), and the demand lags (W1). No row is dropped."""
    g = fe.run_length(g, "category", ["date"], "weather_condition", "weather_streak")
    w = fe.series_window("category", "date")
    rn = F.row_number().over(w)
    wc = F.col("weather_condition")
    since, until = fe.event_distance(F.col("is_holiday") == 1, w, rn)
    per_window = []
    for n in windows:
        per_window += [
            *fe.full_window_stats("demand", n, w),
            *fe.full_window_stats("price_mean", n, w, prefix="price", stats=("std",)),
            fe.rolling_count(wc == "Rainy", n, w, f"rainy_days_last_{n}"),
            fe.rolling_count(F.col("is_holiday") == 1, n, w, f"holidays_last_{n}"),
            *[fe.rolling_share(wc == c, n, w, f"{c.lower()}_pct_last_{n}") for c in ("Rainy", "Sunny", "Cloudy")]]
    out = g.select(
        "category", "date", "demand", "price_mean", "weather_condition", "is_holiday",
        *fe.lag_features("demand", lags, w), *per_window, "weather_streak",
        since.alias("days_since_holiday"), until.alias("days_until_holiday"),
        fe.first_difference("price_mean", w).alias("price_change"))
    return out.withColumn("holiday_proximity",
                          fe.proximity(F.col("days_since_holiday"), F.col("days_until_holiday")))


def hybrid_features(mk: Marketplace):
    """The 7-row windows of the category grid, all rows kept (a part of M19;
    ``hybrid_feature_set`` is the whole)."""
    return hybrid_windows(series.category_grid(mk), (7,)).select(
        "category", "date", "demand", "price_mean", "weather_condition", "is_holiday",
        "rolling_mean_7", "rolling_std_7", "rolling_min_7", "rolling_max_7", "price_std_7", "weather_streak",
        "rainy_days_last_7", "holidays_last_7", "rainy_pct_last_7", "sunny_pct_last_7", "cloudy_pct_last_7",
        "days_since_holiday", "days_until_holiday", "price_change", "holiday_proximity")


@register("category_hybrid_features",
          covers=("W3", "W6", "W7", "W8", "W9", "W10", "W11", "W12", "W13"), sql=HYBRID_SQL)
def category_hybrid_features(spark, sf_dir):
    return _round(hybrid_features(Marketplace(spark, sf_dir)), H_COLS)


HYBRID_WINDOWS = (7, 14)
HYBRID_LAGS = (1, 2, 7, 14)
HYBRID_TIME = ["month", "week_of_year", "day_of_month", "quarter", "day_of_week_num", "is_weekend"]
_PER_WINDOW = ("rolling_mean_{0}", "rolling_std_{0}", "rolling_min_{0}", "rolling_max_{0}", "price_std_{0}",
               "rainy_pct_last_{0}", "sunny_pct_last_{0}", "cloudy_pct_last_{0}")
_COUNTS = ("rainy_days_last_{0}", "holidays_last_{0}")
HYBRID_ROUNDED = [c.format(n) for n in HYBRID_WINDOWS for c in _PER_WINDOW] + ["holiday_proximity", "price_change"]
# inputs of the hybrid model: all features but the price itself
HYBRID_NUMS = [*HYBRID_TIME, "is_holiday", *[f"lag_{k}" for k in HYBRID_LAGS], *HYBRID_ROUNDED,
               *[c.format(n) for n in HYBRID_WINDOWS for c in _COUNTS],
               "weather_streak", "days_since_holiday", "days_until_holiday"]


def _hybrid_set_sql():
    def per_window(n):
        full = ", ".join(f"CASE WHEN rn > {n} THEN {f}({c}) OVER p{n} END AS {name}_{n}" for f, c, name in (
            ("AVG", "demand", "rolling_mean"), ("STDDEV_POP", "demand", "rolling_std"), ("MIN", "demand", "rolling_min"),
            ("MAX", "demand", "rolling_max"), ("STDDEV_POP", "price_mean", "price_std")))
        shares = ", ".join(f"AVG(CASE WHEN weather_condition = '{c}' THEN 1.0 ELSE 0.0 END) OVER c{n} AS {c.lower()}_pct_last_{n}"
                           for c in ("Rainy", "Sunny", "Cloudy"))
        return (f"{full}, {shares}, COUNT(*) FILTER (WHERE weather_condition = 'Rainy') OVER c{n} AS rainy_days_last_{n}, "
                f"SUM(is_holiday) OVER c{n} AS holidays_last_{n}")

    frames = ", ".join(f"p{n} AS (PARTITION BY category ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), "
                       f"c{n} AS (PARTITION BY category ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
                       for n in HYBRID_WINDOWS)
    lags = ", ".join(f"LAG(demand, {k}) OVER w AS lag_{k}" for k in HYBRID_LAGS)
    near = " , ".join(f"CASE WHEN days_{d}_holiday <= 3 THEN 1 - days_{d}_holiday / 4.0 ELSE 0.0 END" for d in ("since", "until"))
    return series.GRID_SQL + f"""
, g AS (
    SELECT *, ROW_NUMBER() OVER w AS rn,
           ROW_NUMBER() OVER w - ROW_NUMBER() OVER (PARTITION BY category, weather_condition ORDER BY date) AS isl
    FROM grid WINDOW w AS (PARTITION BY category ORDER BY date))
, h AS (
    SELECT *, {lags}, {", ".join(map(per_window, HYBRID_WINDOWS))},
           ROW_NUMBER() OVER (PARTITION BY category, weather_condition, isl ORDER BY date) AS weather_streak,
           COALESCE(rn - MAX(CASE WHEN is_holiday = 1 THEN rn END) OVER (PARTITION BY category ORDER BY date
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 999) AS days_since_holiday,
           COALESCE(MIN(CASE WHEN is_holiday = 1 THEN rn END) OVER (PARTITION BY category ORDER BY date
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - rn, 999) AS days_until_holiday,
           COALESCE(price_mean - LAG(price_mean) OVER w, 0.0) AS price_change
    FROM g WINDOW w AS (PARTITION BY category ORDER BY date), {frames})
, f AS (SELECT *, GREATEST({near}) AS holiday_proximity FROM h)
SELECT category, date, demand, price_mean, weather_condition,
       CAST(month(date) AS INTEGER) AS month, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
       CAST(day(date) AS INTEGER) AS day_of_month, CAST(quarter(date) AS INTEGER) AS quarter,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week_num, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
       {", ".join(rnd(c, 6) + " AS " + c if c in HYBRID_ROUNDED else c for c in HYBRID_NUMS if c not in HYBRID_TIME)}
FROM f
WHERE rn > {max(HYBRID_LAGS)}
"""


HYBRID_SET_SQL = _hybrid_set_sql()


def hybrid_feature_set(g):
    """M19 whole on the category grid ``g``: time features (F11), lags 1, 2, 7
    and 14 (W1), every window feature over 7 and 14 rows; rows without all lags
    are dropped (W18: the first 14 of a category). The price against the
    category's mean (W14) is per order line, see price_vs_category_mean."""
    out = fe.time_features(hybrid_windows(g, HYBRID_WINDOWS, HYBRID_LAGS))
    out = out.na.drop(subset=[f"lag_{k}" for k in HYBRID_LAGS])
    return out.select("category", "date", "demand", "price_mean", "weather_condition", *HYBRID_NUMS)


@register("category_hybrid_feature_set",
          covers=("M19", "F11", "W1", "W3", "W6", "W7", "W8", "W9", "W10", "W11", "W12", "W13", "W18"),
          sql=HYBRID_SET_SQL)
def category_hybrid_feature_set(spark, sf_dir):
    return _round(hybrid_feature_set(series.category_grid(Marketplace(spark, sf_dir))), HYBRID_ROUNDED)


PRICE_RATIO_SQL = with_views("b_demand") + f"""
SELECT order_id, line_no, product_id, supplier_id, date, category, price,
       {rnd('price / AVG(price) OVER (PARTITION BY date, category) - 1', 6)} AS price_vs_cat_avg
FROM b_demand
"""


@register("price_vs_category_mean", covers=("W14", "J7"), sql=PRICE_RATIO_SQL)
def price_vs_category_mean(spark, sf_dir):
    d = Marketplace(spark, sf_dir).demand
    out = fe.ratio_to_group_mean(d.select("order_id", "line_no", "product_id", "supplier_id", "date", "category", "price"),
                                 "price", ["date", "category"], "price_vs_cat_avg")
    return _round(out, ["price_vs_cat_avg"])


LATEST_SQL = with_views("b_demand") + series.CATEGORY_DAY_SQL[:series.CATEGORY_DAY_SQL.index(", bounds AS")] + """
SELECT category,
       arg_max(demand, date) FILTER (WHERE demand IS NOT NULL) AS demand,
       arg_max(price_mean, date) FILTER (WHERE price_mean IS NOT NULL) AS price_mean
FROM cd GROUP BY category
"""


@register("latest_category_values", covers=("W17",), sql=LATEST_SQL)
def latest_category_values(spark, sf_dir):
    return fe.latest_non_null(series.category_day(Marketplace(spark, sf_dir)), "category", "date",
                              ["demand", "price_mean"])


SPLIT_SQL = series.PRODUCT_DAY_SQL + """
SELECT product_id, date, quantity_sold,
       CASE WHEN ROW_NUMBER() OVER (ORDER BY date, product_id) <= floor(COUNT(*) OVER () * 0.8)
            THEN 'train' ELSE 'test' END AS split
FROM pd
"""


@register("time_split_rows", covers=("W19",), sql=SPLIT_SQL)
def time_split_rows(spark, sf_dir):
    pd_ = series.product_day(Marketplace(spark, sf_dir)).select("product_id", "date", "quantity_sold")
    return fe.split_by_position(pd_, ["product_id"], 0.8)


DATE_SPLIT_SQL = series.GRID_SQL + """
, dates AS (SELECT DISTINCT date FROM grid)
, cut AS (
    SELECT date AS cut_date FROM (
        SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS k FROM dates) t
    WHERE i = CAST(floor(k * 0.8) AS BIGINT))
SELECT category, date, demand, CASE WHEN date < cut_date THEN 'train' ELSE 'test' END AS split
FROM grid, cut
"""


@register("date_split_rows", covers=("W20",), sql=DATE_SPLIT_SQL)
def date_split_rows(spark, sf_dir):
    g = series.category_grid(Marketplace(spark, sf_dir)).select("category", "date", "demand")
    return fe.split_by_date_position(g, 0.8)


FOLDS_SQL = series.PRODUCT_DAY_SQL + """
, pos AS (
    SELECT product_id, date, quantity_sold,
           ROW_NUMBER() OVER (ORDER BY date, product_id) - 1 AS p, COUNT(*) OVER () AS n FROM pd)
, f AS (SELECT *, n // 4 AS size, n - (n // 4) * 3 AS first FROM pos)
SELECT product_id, date, quantity_sold, CAST(fold AS INTEGER) AS fold,
       CASE WHEN p < first + fold * size THEN 'train' ELSE 'test' END AS role
FROM f, range(0, 3) t(fold)
WHERE p < first + fold * size + size
"""


@register("expanding_time_folds", covers=("W21",), sql=FOLDS_SQL)
def expanding_time_folds(spark, sf_dir):
    pd_ = series.product_day(Marketplace(spark, sf_dir)).select("product_id", "date", "quantity_sold")
    return fe.expanding_folds(pd_, ["product_id"], 3).withColumn("fold", F.col("fold").cast("int"))


KEYED_FOLDS_SQL = series.PRODUCT_DAY_SQL + """
SELECT product_id, date, quantity_sold,
       CAST(CAST('0x' || substr(md5(concat_ws('|', product_id, strftime(date, '%Y-%m-%d'), '42')), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM pd
"""


@register("keyed_folds", covers=("W22",), sql=KEYED_FOLDS_SQL)
def keyed_folds(spark, sf_dir):
    pd_ = series.product_day(Marketplace(spark, sf_dir)).select("product_id", "date", "quantity_sold")
    return fe.keyed_folds(pd_, [F.col("product_id").cast("string"), F.date_format("date", "yyyy-MM-dd")], 5, 42)


@register("hash_folds", covers=("W22",))
def hash_folds(spark, sf_dir):
    pd_ = series.product_day(Marketplace(spark, sf_dir)).select("product_id", "date", "quantity_sold")
    return fe.hash_folds(pd_, ["product_id", "date"], 5, 42)


ALIGN_SQL = with_views("b_demand") + series.CATEGORY_DAY_SQL[:series.CATEGORY_DAY_SQL.index(", bounds AS")] + """
SELECT category, CAST(date + to_days(CAST(DATE '2024-12-31' - (SELECT MAX(date) FROM cd) AS INTEGER)) AS DATE) AS date, demand
FROM cd
"""


@register("aligned_category_days", covers=("W23",), sql=ALIGN_SQL)
def aligned_category_days(spark, sf_dir):
    cd = series.category_day(Marketplace(spark, sf_dir)).select("category", "date", "demand")
    return fe.align_dates(cd, "2024-12-31")
