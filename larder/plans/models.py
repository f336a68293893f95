"""Model queries: P12, S10, M1, M3-M6, M10, M11, M12, M14-M16.

Learned models have no SQL oracle (rows-only check); their building blocks
(features, splits, metrics) are oracle-checked in their own queries.
"""

from __future__ import annotations

import math
import random

from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from larder.functions.columns import round_half_up
from larder.operators import arima as ar
from larder.operators import boosting as bo
from larder.operators import evaluation as ev
from larder.operators import features as fe
from larder.operators import models as md
from larder.operators import stacking as st
from larder.plans import series
from larder.plans.features import (
    HYBRID_NUMS, STUDY_MADE, hybrid_feature_set, product_features, product_features_of, study_features,
)
from larder.plans.registry import register
from larder.plans.sql_binding import with_views
from larder.plans.sqlfrag import rnd
from larder.session import checkpoint_dir
from larder.sources.binding import Marketplace

DAY_NAMES = "EEEE"


def raw_requests(mk: Marketplace):
    """Scoring requests as clients send them (mixed case, spaces, holiday
    as text), one per demand row; labels kept for training."""
    d = mk.demand
    ln = F.col("line_no")
    day = F.date_format("date", DAY_NAMES)
    return d.select(
        (F.col("order_id") * 1000 + ln).alias("request_id"), "order_id", "line_no", "product_id", "product_name",
        F.when(F.pmod(ln, F.lit(2)) == 0, F.upper("category")).otherwise(F.concat(F.lit(" "), F.col("category")))
         .alias("category"),
        F.when(F.pmod(ln, F.lit(3)) == 0, F.lower(day)).otherwise(F.upper(day)).alias("day_of_week"),
        F.when(F.pmod(ln, F.lit(4)) == 0, F.lit("true")).otherwise(F.col("is_holiday").cast("string"))
         .alias("is_holiday"),
        F.concat(F.col("weather_condition"), F.lit(" ")).alias("weather_condition"),
        "quantity_sold", "price")


NORMALISE_SQL = with_views("b_demand") + """
, r AS (
    SELECT order_id * 1000 + line_no AS request_id, product_name,
           CASE WHEN line_no % 2 = 0 THEN upper(category) ELSE ' ' || category END AS category,
           CASE WHEN line_no % 3 = 0 THEN lower(strftime(date, '%A')) ELSE upper(strftime(date, '%A')) END
               AS day_of_week,
           CASE WHEN line_no % 4 = 0 THEN 'true' ELSE CAST(is_holiday AS VARCHAR) END AS is_holiday,
           weather_condition || ' ' AS weather_condition
    FROM b_demand)
SELECT request_id, product_name,
       CASE lower(trim(category)) WHEN 'vegetables' THEN 'vegetable' WHEN 'vegetable' THEN 'vegetable'
            WHEN 'fish' THEN 'fish' WHEN 'meat' THEN 'meat' WHEN 'grains' THEN 'grain' WHEN 'grain' THEN 'grain'
            ELSE lower(trim(category)) END AS category,
       upper(substring(trim(day_of_week), 1, 1)) || lower(substring(trim(day_of_week), 2)) AS day_of_week,
       CASE WHEN COALESCE(TRY_CAST(trim(is_holiday) AS INTEGER),
                          CASE lower(trim(is_holiday)) WHEN 'true' THEN 1 WHEN 'false' THEN 0 END) > 0
            THEN 1 ELSE 0 END AS is_holiday,
       lower(trim(weather_condition)) AS weather_condition,
       array_to_string(list_filter([
           CASE WHEN product_name IS NULL OR trim(product_name) = '' THEN 'product_name' END,
           CASE WHEN category IS NULL OR trim(category) = '' THEN 'category' END,
           CASE WHEN day_of_week IS NULL OR trim(day_of_week) = '' THEN 'day_of_week' END,
           CASE WHEN weather_condition IS NULL OR trim(weather_condition) = '' THEN 'weather_condition' END],
           lambda x: x IS NOT NULL), ',') AS missing_fields
FROM r
"""


@register("normalised_requests", covers=("P12", "F1", "F8", "F18"), sql=NORMALISE_SQL)
def normalised_requests(spark, sf_dir):
    return md.normalise_requests(raw_requests(Marketplace(spark, sf_dir)))


CAT_COLS = ["category", "day_of_week", "weather_condition"]


@register("request_model_predictions", covers=("S10", "M1", "M3", "M5", "W22"))
def request_model_predictions(spark, sf_dir):
    """Train one linear pipeline per target (quantity, price) on 80 % of
    the normalised requests (hash folds 1-4) and score the rest."""
    mk = Marketplace(spark, sf_dir)
    raw = raw_requests(mk)
    norm = md.normalise_requests(raw, keep=("quantity_sold", "price", "order_id", "line_no", "product_id"))
    folded = _materialise(fe.hash_folds(norm, ["order_id", "line_no", "product_id"], 5, 42))
    train, test = folded.where(F.col("fold") != 0), folded.where(F.col("fold") == 0)
    models = md.fit_multi_output(train, ["quantity_sold", "price"], CAT_COLS, ["is_holiday"], "linear")
    return md.predict_all(models, test, ["request_id", "quantity_sold", "price"])


def _materialise(df):
    """Training data is read many times (indexers, several fits, folds):
    compute it once into the shared checkpoint folder (also cuts lineage)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _product_split(mk):
    pf = _materialise(fe.split_by_date_position(product_features(mk), 0.8))
    return pf.where(F.col("split") == "train"), pf.where(F.col("split") == "test")


def _boosted(rounds: int, depth: int, rate: float, min_rows: int = 1, **more) -> dict:
    """Parameters of a boosted model; the reference draws 0.8 of the rows and
    of the columns everywhere."""
    return dict(kind="boost", rounds=rounds, depth=depth, rate=rate, min_rows=min_rows, subsample=0.8, columns=0.8, **more)


def _coded(train, *others, cols):
    """The frames with ``<col>_code``: the place of a level among the train
    rows' levels in alphabetical order; unseen and null levels come last."""
    fitted = StringIndexer(inputCols=cols, outputCols=[f"{c}_code" for c in cols], handleInvalid="keep",
                           stringOrderType="alphabetAsc").fit(train)
    return [fitted.transform(df) for df in (train, *others)]


NUMS = ["month", "week_of_year", "day_of_month", "is_weekend", "lag_1", "lag_7", "lag_14",
        "rolling_mean_7", "rolling_mean_14", "rolling_std_7", "price_mean", "price_change"]


CODED = [*NUMS, "category_code"]
DAY_KEYS = ["product_id", "date"]


@register("ml_model_comparison", covers=("M3", "M4", "M10", "M16", "A26"))
def ml_model_comparison(spark, sf_dir, rounds=200, depth=4):
    mk = Marketplace(spark, sf_dir)
    train, test = _coded(*_product_split(mk), cols=["category"])
    linear = md.regression_pipeline(["category"], NUMS, "quantity_sold", "linear").fit(train).transform(test)
    boosted = bo.fit(train, CODED, ["quantity_sold"], [_boosted(rounds, depth, 0.1, target=0)], keys=DAY_KEYS)
    scored = boosted.predict(linear.drop("features", "category_vec"), {"boosted": 0})
    return _metrics_of(scored, "quantity_sold", {"linear": "pred_quantity_sold", "boosted": "boosted"})


def _metrics_of(scored, actual, models):
    """Error metrics of several prediction columns in one aggregate: ``model`` and A26."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("predicted"))
                               for n, c in models.items()]))
    long = scored.select(F.col(actual).cast("double").alias("actual"), each.alias("m")).select("actual", "m.*")
    return ev.error_metrics(long, group=["model"])


@register("gbt_feature_importance", covers=("M15", "L7", "M4"))
def gbt_feature_importance(spark, sf_dir, rounds=500, depth=5):
    """Mean gain per split of each feature, summing to 1."""
    mk = Marketplace(spark, sf_dir)
    train, _ = _coded(*_product_split(mk), cols=["category"])
    model = bo.fit(train, CODED, ["quantity_sold"], [_boosted(rounds, depth, 0.05, 3, target=0)], keys=DAY_KEYS)
    share = bo.Trees.load(model.trees[0]).importance(len(CODED))
    rows = [("category" if n == "category_code" else n, float(v)) for n, v in zip(CODED, share)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _grid_split(mk):
    g = series.category_grid(mk)
    cut = fe.split_by_date_position(g.select("date").distinct(), 0.8) \
            .where(F.col("split") == "test").select(F.min("date")).scalar()
    return g, cut


@register("seasonal_regression_forecast", covers=("M11",))
def seasonal_regression_forecast(spark, sf_dir):
    g, cut = _grid_split(Marketplace(spark, sf_dir))
    return md.seasonal_regression(g.where(F.col("date") < cut), g.where(F.col("date") >= cut),
                                  "category", "demand")


@register("ar_forecast", covers=("M12",))
def ar_forecast(spark, sf_dir):
    g, cut = _grid_split(Marketplace(spark, sf_dir))
    return md.ar2_forecast(g.select("category", "date", "demand"), "category", "demand", cut)


def _arima_sql():
    text = (lambda a, b: f"({a} * {b})", lambda a, b: f"({a} + {b})", lambda a, b: f"({a} - {b})")

    def fit(rows, x, names):
        k = len(x)
        sums = ", ".join([f"SUM({x[i]} * {x[j]}) AS m{i}{j}" for i in range(k) for j in range(i, k)] + [f"SUM({a} * d0) AS v{i}" for i, a in enumerate(x)])
        det, tops = ar.cramer([[f"m{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)], [f"v{i}" for i in range(k)], text)
        found = ", ".join(f"CASE WHEN det <> 0 THEN {t} / det END AS {n}" for t, n in zip(tops, names))
        return f"SELECT category, {found} FROM (SELECT *, {det} AS det FROM (SELECT category, {sums} FROM {rows} GROUP BY category))"

    return "WITH RECURSIVE " + series.GRID_SQL[len("WITH "):] + f"""
, dates AS (SELECT DISTINCT date FROM grid)
, cut AS (SELECT date AS cut_date FROM (SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS k FROM dates)
          WHERE i = CAST(floor(k * 0.8) AS BIGINT))
, t0 AS (SELECT category, date, demand AS y, demand - LAG(demand) OVER (PARTITION BY category ORDER BY date) AS d0 FROM grid)
, t1 AS (SELECT *, LAG(d0) OVER w AS d1, LAG(d0, 2) OVER w AS d2, LAG(d0, 3) OVER w AS d3 FROM t0 WINDOW w AS (PARTITION BY category ORDER BY date))
, tr AS (SELECT t1.* FROM t1, cut WHERE date < cut_date)
, full3 AS (SELECT * FROM tr WHERE d3 IS NOT NULL)
, lng AS ({fit("full3", ["d1", "d2", "d3"], ["p1", "p2", "p3"])})
, res AS (SELECT tr.*, d0 - (0.0 + COALESCE(p1, 0.0) * d1 + COALESCE(p2, 0.0) * d2 + COALESCE(p3, 0.0) * d3) AS e0 FROM tr LEFT JOIN lng USING (category))
, res2 AS (SELECT *, LAG(e0) OVER w AS e1, LAG(e0, 2) OVER w AS e2 FROM res WINDOW w AS (PARTITION BY category ORDER BY date))
, full2 AS (SELECT * FROM res2 WHERE e2 IS NOT NULL)
, sht AS ({fit("full2", ["d1", "d2", "e1", "e2"], ["a1", "a2", "b1", "b2"])})
, st AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY date DESC) AS rn FROM res2) WHERE rn = 1)
, te AS (SELECT t1.category, date, y AS actual, ROW_NUMBER() OVER (PARTITION BY t1.category ORDER BY date) AS i FROM t1, cut WHERE date >= cut_date)
, go AS (SELECT st.category, st.y, d0, d1, e0, e1, a1, a2, b1, b2,
                COALESCE(abs(a2) < 1 AND a2 + a1 < 1 AND a2 - a1 < 1 AND e1 IS NOT NULL, FALSE) AS ok FROM st LEFT JOIN sht USING (category))
, walk(category, i, x1, x2, u1, u2, y) AS (
    SELECT category, CAST(0 AS BIGINT), d0, d1, e0, e1, y FROM go WHERE ok
    UNION ALL
    SELECT w.category, w.i + 1, a1 * x1 + a2 * x2 + b1 * u1 + b2 * u2, x1, CAST(0.0 AS DOUBLE), u1, w.y + (a1 * x1 + a2 * x2 + b1 * u1 + b2 * u2)
    FROM walk w JOIN go USING (category) WHERE w.i < (SELECT MAX(i) FROM te WHERE te.category = w.category))
SELECT te.category, te.date, te.actual, {rnd("COALESCE(walk.y, go.y, 0.0)", 3)} AS predicted
FROM te LEFT JOIN go ON go.category = te.category LEFT JOIN walk ON walk.category = te.category AND walk.i = te.i
"""


@register("arima_forecast", covers=("M12",), sql=_arima_sql())
def arima_forecast(spark, sf_dir):
    """Order (2, 1, 2) on the category grid, rounded to 1e-3."""
    g, cut = _grid_split(Marketplace(spark, sf_dir))
    out = ar.arima_forecast(g.select("category", "date", "demand"), "category", "demand", cut)
    return out.withColumn("predicted", round_half_up("predicted", 3))


RECURSIVE_SQL = "WITH RECURSIVE " + series.PRODUCT_DAY_SQL[len("WITH "):] + f"""
, numbered AS (SELECT product_id, date, quantity_sold, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY date DESC) AS r FROM pd)
, start AS (SELECT product_id, MAX(date) AS last_date, list(quantity_sold ORDER BY date) AS h FROM numbered WHERE r <= 7 GROUP BY product_id)
, walk(product_id, last_date, step, h) AS (
    SELECT product_id, last_date, 0, h FROM start
    UNION ALL
    SELECT product_id, last_date, step + 1, list_append(h, list_avg(h[-7:])) FROM walk WHERE step < 30)
, cats AS (SELECT DISTINCT product_id, category FROM pd)
, days AS (
    SELECT category, CAST(last_date + to_days(step) AS DATE) AS date, step, {rnd("SUM(h[-1])", 4)} AS quantity_sold
    FROM walk JOIN cats USING (product_id) WHERE step > 0 GROUP BY category, last_date + to_days(step), step)
SELECT category, date, CAST(step AS INTEGER) AS step, quantity_sold, CAST(horizon AS INTEGER) AS horizon
FROM days JOIN (VALUES (7), (14), (30)) v(horizon) ON step <= horizon
"""


@register("recursive_forecast", covers=("A24", "J14"), sql=RECURSIVE_SQL)
def recursive_forecast(spark, sf_dir):
    """30 days forward per product (recursive MA(7)), summed by category and
    rounded to 1e-4; horizons 7/14/30 are prefixes of the one 30-day run."""
    mk = Marketplace(spark, sf_dir)
    pd_ = series.product_day(mk)
    fc = md.recursive_ma_forecast(pd_, "product_id", "quantity_sold", 30, 7)
    cats = pd_.select("product_id", "category").distinct()
    by_cat = fc.join(cats, "product_id").groupBy("category", "date", "step").agg(
        round_half_up(F.sum("forecast"), 4).alias("quantity_sold"))
    horizons = F.explode(F.filter(F.array(F.lit(7), F.lit(14), F.lit(30)), lambda h: F.col("step") <= h))
    return by_cat.select("category", "date", "step", "quantity_sold", horizons.alias("horizon"))


def _search(spark, sf_dir, estimator, grid, draws):
    """Cross-validated RMSE of ``draws`` parameter maps of ``grid``."""
    from pyspark.ml import Pipeline
    train, _ = _product_split(Marketplace(spark, sf_dir))
    # encode once; the cross validation refits only the estimator
    feats = md.feature_stages(["category"], NUMS).fit(train)
    train = _materialise(feats.transform(train).select("product_id", "date", "quantity_sold", "features"))
    cvm = md.tune(train, Pipeline(stages=[estimator]), estimator, grid, draws=draws, folds=3, label="quantity_sold")
    rows = [(str({p.name: v for p, v in pm.items()}), float(m)) for pm, m in zip(cvm.getEstimatorParamMaps(),
                                                                               cvm.avgMetrics)]
    return spark.createDataFrame(rows, "params string, cv_rmse double")


_SEARCHED = dict(featuresCol="features", labelCol="quantity_sold", predictionCol="pred_quantity_sold")
LINEAR_GRID = {"regParam": [0.0, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}
# fixed values: the search spaces of the two boosted searches
BOOSTED_GRID = {"rounds": [100, 200, 300, 500], "depth": [3, 4, 6, 8, 10], "rate": [0.01, 0.05, 0.1, 0.2],
                "subsample": [0.6, 0.8, 1.0], "columns": [0.6, 0.8, 1.0], "min_rows": [1, 3, 5],
                "alpha": [0.0, 0.1, 1.0], "lam": [1.0, 2.0, 3.0]}
TIME_GRID = {"rounds": [100, 300, 500], "depth": [3, 5, 7], "rate": [0.01, 0.05, 0.1], "subsample": [0.6, 0.8, 1.0],
             "columns": [0.6, 0.8, 1.0], "alpha": [0.0, 0.1, 1.0], "lam": [1.0, 2.0, 5.0]}


def draw_params(grid, draws, seed=42):
    """``draws`` different maps of the grid (all of a smaller one), seeded."""
    size = math.prod(len(v) for v in grid.values())
    places = sorted(random.Random(seed).sample(range(size), draws)) if draws < size else range(size)
    out = []
    for at in places:
        params = {}
        for name, values in grid.items():
            at, i = divmod(at, len(values))
            params[name] = values[i]
        out.append(params)
    return out


def searched(rows, features, target, params, folds, keys, fold="fold"):
    """M6: every map on every (train, valid) pair of fold lists, all fitted
    together. Returns the fits and, per map, the mean validation RMSE."""
    specs = [{**p, "target": 0, "train": tr, "valid": va, "keep": False} for p in params for tr, va in folds]
    fitted = bo.fit(rows, features, [target], specs, fold=fold, keys=keys)
    rmse = [fitted.valid_rmse(i) for i in range(len(specs))]
    return [sum(rmse[i * len(folds):(i + 1) * len(folds)]) / len(folds) for i in range(len(params))]


def _search_table(spark, params, rmse):
    best = min(range(len(rmse)), key=lambda i: (rmse[i], i))
    names = {"rounds": "int", "depth": "int", "rate": "double", "subsample": "double", "columns": "double",
             "min_rows": "int", "alpha": "double", "lam": "double"}
    rows = [(str(p), float(r), i == best, *[p.get(n) for n in names]) for i, (p, r) in enumerate(zip(params, rmse))]
    return spark.createDataFrame(rows, "params string, cv_rmse double, best boolean, "
                                 + ", ".join(f"{n} {t}" for n, t in names.items())), params[best]


@register("tuned_linear_cv", covers=("W21",))
def tuned_linear_cv(spark, sf_dir, draws=30):
    """Every map of the linear grid (it has fewer than ``draws``)."""
    from pyspark.ml.regression import LinearRegression
    return _search(spark, sf_dir, LinearRegression(**_SEARCHED), LINEAR_GRID, draws)


@register("tuned_boosted_cv", covers=("M6",))
def tuned_boosted_cv(spark, sf_dir, draws=30, grid=None):
    """M6: 30 draws of the reference's boosted search space, 3 folds."""
    train, _ = _coded(*_product_split(Marketplace(spark, sf_dir)), cols=["category"])
    train = fe.hash_folds(train, DAY_KEYS, 3, 42)
    params = draw_params(grid or BOOSTED_GRID, draws)
    folds = [([f for f in range(3) if f != k], [k]) for k in range(3)]
    return _search_table(spark, params, searched(train, CODED, "quantity_sold", params, folds, DAY_KEYS))[0]


STUDY_TIME = ["month", "quarter", "day_of_week_num", "is_weekend", "is_holiday"]
STUDY_NUMS = [*STUDY_TIME, "price_mean", "price_change", *STUDY_MADE]
STUDY_CODED = [*STUDY_NUMS, "category_code", "weather_condition_code"]


def _study_split(mk):
    """The study's features (M18), split by date; ``fold`` numbers the time blocks of the train rows."""
    rows = _materialise(fe.split_by_date_position(study_features(series.product_day(mk)), 0.8))
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    return _coded(fe.time_blocks(train, DAY_KEYS[::-1], 3), test, cols=["category", "weather_condition"])


@register("tuned_boosted_time_cv", covers=("M6", "W21", "M17"))
def tuned_boosted_time_cv(spark, sf_dir, draws=10, grid=None):
    """M6 of the model study: 10 draws on 3 expanding time folds; the best map,
    refitted on all train rows, is tested on product forecasts summed to
    category-days (M17): its errors stand in the row of the best map."""
    train, test = _study_split(Marketplace(spark, sf_dir))
    train = _materialise(train)
    params = draw_params(grid or TIME_GRID, draws)
    folds = [(list(range(k + 1)), [k + 1]) for k in range(3)]
    table, best = _search_table(spark, params, searched(train, STUDY_CODED, "quantity_sold", params, folds, DAY_KEYS))
    model = bo.fit(train, STUDY_CODED, ["quantity_sold"], [{**best, "target": 0}], keys=DAY_KEYS)
    by_day = (model.predict(test, {"predicted": 0}).groupBy("category", "date")
              .agg(F.sum("quantity_sold").alias("actual"), F.sum("predicted").alias("predicted")))
    errors = ev.error_metrics(by_day).select(*[F.col(c).alias(f"test_{c}") for c in ("n", "mae", "rmse", "mape", "r2")])
    return table.join(errors.withColumn("best", F.lit(True)), "best", "left")


STACK_NUMS = [n for n in NUMS if not n.startswith("price")]


def stacked_rows(mk, rounds=200, depth=4, forest_rounds=200, forest_depth=6):
    """M9 on product-days, quantity and price: test rows with all base and
    stacked predictions, and the meta weights."""
    train, test = _coded(*_product_split(mk), cols=["category"])
    train = _materialise(fe.hash_folds(train, DAY_KEYS, 5, 42))
    flags = st.level_flags(train, "category")
    return st.stack(train, test, [*STACK_NUMS, "category_code"], ["quantity_sold", "price_mean"], DAY_KEYS,
                    [*[F.col(c) for c in STACK_NUMS], *flags], boosted=_boosted(rounds, depth, 0.1),
                    forest={**st.FOREST, "rounds": forest_rounds, "depth": forest_depth})


@register("stacked_model_metrics", covers=("M9", "M16", "A26"))
def stacked_model_metrics(spark, sf_dir, rounds=200, depth=4):
    """M9: boosted, forest and linear base models of two targets, out of fold
    over 5 hash folds, ridge meta models of all six; test metrics per target
    of every base model and the stack. Price is no feature."""
    rows, _ = stacked_rows(Marketplace(spark, sf_dir), rounds, depth)
    rows = _materialise(rows)
    out = None
    for target in ("quantity_sold", "price_mean"):
        m = _metrics_of(rows, target, {n: f"{n}_{target}" for n in ("boosted", "forest", "linear", "stack")})
        m = m.withColumn("target", F.lit(target))
        out = m if out is None else out.unionByName(m)
    return out


@register("model_recursive_forecast", covers=("M14", "M17"))
def model_recursive_forecast(spark, sf_dir, rounds=100, depth=3):
    """30 days forward per product by a boosted model fed with its own
    forecasts, summed by category; horizons 7/14/30 are prefixes of one run.
    The parameters are those the reference's search chose."""
    mk = Marketplace(spark, sf_dir)
    days = _materialise(series.product_day(mk))
    rows, model, coded = recursive_model(days, rounds, depth)
    fc = st.model_forecast(coded, "product_id", "quantity_sold", ["price_mean", "category_code"], model, 0, 30)
    cats = days.select("product_id", "category").distinct()
    by_cat = fc.join(cats, "product_id").groupBy("category", "date", "step").agg(F.sum("forecast").alias("quantity_sold"))
    horizons = F.explode(F.filter(F.array(F.lit(7), F.lit(14), F.lit(30)), lambda h: F.col("step") <= h))
    return by_cat.select("category", "date", "step", "quantity_sold", horizons.alias("horizon"))


def recursive_model(days, rounds=100, depth=3):
    """Feature rows, the fitted model and the coded daily series behind the recursive forecast."""
    rows, coded = _coded(product_features_of(days), days, cols=["category"])
    rows = _materialise(rows)
    params = dict(kind="boost", rounds=rounds, depth=depth, rate=0.01, subsample=0.6, alpha=1.0, lam=5.0, target=0)
    return rows, bo.fit(rows, CODED, ["quantity_sold"], [params], keys=DAY_KEYS), coded


SEASONAL_PARTS = ["trend", "weekly", "yearly"]


def hybrid_model_rows(mk: Marketplace):
    """Rows of the hybrid model (the M19 feature set with the seasonal
    forecast and its parts) and the first test date."""
    g, cut = _grid_split(mk)
    seas = md.seasonal_regression(g.where(F.col("date") < cut), g, "category", "demand")
    seas = seas.select(F.col("category").alias("_category"), F.col("date").alias("_date"),
                       F.col("predicted").alias("seasonal"), *SEASONAL_PARTS)
    same = F.col("category").eqNullSafe(F.col("_category")) & (F.col("date") == F.col("_date"))
    return hybrid_feature_set(g).join(seas, same).drop("_category", "_date"), cut


@register("hybrid_forecast_metrics", covers=("M13", "J7", "J8"))
def hybrid_forecast_metrics(spark, sf_dir, rounds=300, depth=5):
    """M13 on the category grid: the seasonal regression (fitted on train
    dates only, unlike the reference which fits on all dates) predicts every
    date; its forecast joins the series on known dates and, with the whole
    M19 feature set, feeds a boosted model. Test metrics for the seasonal model
    alone and the hybrid."""
    mk = Marketplace(spark, sf_dir)
    x, cut = hybrid_model_rows(mk)
    x = _materialise(x)
    train, test = _coded(x.where(F.col("date") < cut), x.where(F.col("date") >= cut), cols=["category", "weather_condition"])
    num = ["seasonal", *SEASONAL_PARTS, *HYBRID_NUMS, "category_code", "weather_condition_code"]
    model = bo.fit(train, num, ["demand"], [_boosted(rounds, depth, 0.05, 3, target=0)], keys=["category", "date"])
    return _metrics_of(model.predict(test, {"hybrid": 0}), "demand", {"seasonal": "seasonal", "hybrid": "hybrid"})


@register("target_specific_predictions", covers=("M7", "M5", "S10"))
def target_specific_predictions(spark, sf_dir, rounds=200, depth=4):
    """M7: a boosted model for quantity and a linear model for price, each
    its own pipeline on the same normalised requests; predictions side by
    side for the held-out fold."""
    mk = Marketplace(spark, sf_dir)
    raw = raw_requests(mk)
    norm = md.normalise_requests(raw, keep=("quantity_sold", "price", "order_id", "line_no", "product_id"))
    folded = _materialise(fe.hash_folds(norm, ["order_id", "line_no", "product_id"], 5, 42))
    train, test = folded.where(F.col("fold") != 0), folded.where(F.col("fold") == 0)
    train, test = _coded(train, test, cols=CAT_COLS)
    # few different requests: each trains as one row of its mean and weight, in ten
    # parts by hash, so that a tree's share of the rows is a share of parts
    features = [*[f"{c}_code" for c in CAT_COLS], "is_holiday"]
    part = F.pmod(F.xxhash64("order_id", "line_no", "product_id"), F.lit(10)).alias("part")
    grouped = train.groupBy(*features, part).agg(F.avg("quantity_sold").alias("quantity_sold"), F.count("*").alias("n"))
    model = bo.fit(grouped, features, ["quantity_sold"], [_boosted(rounds, depth, 0.1, target=0)], weight="n",
                   keys=[*features, "part"])
    price = md.regression_pipeline(CAT_COLS, ["is_holiday"], "price", "linear").fit(train)
    scored = price.transform(test).select("request_id", "quantity_sold", "price", *features, "pred_price")
    return model.predict(scored, {"pred_quantity_sold": 0}).select("request_id", "quantity_sold", "price", "pred_quantity_sold",
                                                                   "pred_price")
