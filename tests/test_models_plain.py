"""Model queries without an SQL form against numpy over the same rows."""

import datetime
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from larder.operators import boosting as bo
from larder.operators import features as fe
from larder.operators import models as md
from larder.plans import models as pm
from larder.plans import scoring as ps
from larder.plans import series
from larder.sources.binding import Marketplace
from tests.conftest import SMALL


def errors(actual, predicted):
    e = actual - predicted
    return {"n": len(e), "mae": np.abs(e).mean(), "rmse": math.sqrt((e ** 2).mean()), "r2": 1 - (e ** 2).sum() / (len(e) * actual.var())}


def same_errors(row, want, tol=1e-6):
    assert row["n"] == want["n"]
    assert all(math.isclose(row[k], want[k], rel_tol=tol, abs_tol=1e-9) for k in ("mae", "rmse", "r2")), (row, want)


def one_hot(train, frame, texts, numbers):
    cols = [np.ones(len(frame)), *[frame[c].to_numpy(float) for c in numbers]]
    for c in texts:
        cols += [(frame[c] == v).to_numpy(float) for v in sorted(train[c].dropna().unique())]
    return np.column_stack(cols)


def test_request_predictions_are_least_squares(spark):
    mk = Marketplace(spark, SMALL)
    rows = md.normalise_requests(pm.raw_requests(mk), keep=("quantity_sold", "price", "order_id", "line_no", "product_id"))
    data = fe.hash_folds(rows, ["order_id", "line_no", "product_id"], 5, 42).toPandas()
    train, test = data[data["fold"] != 0], data[data["fold"] == 0]
    x, z = (one_hot(train, d, pm.CAT_COLS, ["is_holiday"]) for d in (train, test))
    got = pm.request_model_predictions(spark, SMALL).toPandas().set_index("request_id")
    for target in ("quantity_sold", "price"):
        coef = np.linalg.lstsq(x, train[target].to_numpy(float), rcond=None)[0]
        want = pd.Series(z @ coef, index=test["request_id"]).sort_index()
        mine = got[f"pred_{target}"].sort_index()
        assert len(mine) == len(want) and np.allclose(mine.to_numpy(), want.to_numpy(), rtol=1e-4)


def test_model_comparison_against_numpy(spark):
    train, test = pm._coded(*pm._product_split(Marketplace(spark, SMALL)), cols=["category"])
    a, b = train.toPandas(), test.toPandas()
    x, z = (one_hot(a, d, ["category"], pm.NUMS) for d in (a, b))
    y = b["quantity_sold"].to_numpy(float)
    rows = {r.model: r.asDict() for r in pm.ml_model_comparison(spark, SMALL, rounds=20, depth=3).collect()}
    coef = np.linalg.lstsq(x, a["quantity_sold"].to_numpy(float), rcond=None)[0]
    same_errors(rows["linear"], errors(y, z @ coef), 1e-4)
    model = bo.fit(train, pm.CODED, ["quantity_sold"], [pm._boosted(20, 3, 0.1, target=0)], keys=pm.DAY_KEYS)
    bins = np.stack([bo.to_bins(b[c].to_numpy(float), e) for c, e in zip(pm.CODED, model.edges)], 1)
    same_errors(rows["boosted"], errors(y, bo.Trees.load(model.trees[0]).predict(bins)))
    assert rows["boosted"]["rmse"] < errors(y, np.full(len(y), a["quantity_sold"].mean()))["rmse"]


def test_seasonal_forecast_is_least_squares_per_category(spark):
    mk = Marketplace(spark, SMALL)
    grid = series.category_grid(mk).toPandas()
    _, cut = pm._grid_split(mk)
    cut = grid["date"].drop_duplicates().sort_values().iloc[int(grid["date"].nunique() * 0.8)]
    got = pm.seasonal_regression_forecast(spark, SMALL).toPandas()
    for category, own in grid.groupby("category"):
        t = np.array([(d - datetime.date(2000, 1, 1)).days for d in own["date"]], float)
        cols = [np.ones(len(t)), t / 365.25, own["is_holiday"].to_numpy(float)]
        for k in (1, 2, 3):
            for period in (7.0, 365.25):
                cols += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
        x, before = np.column_stack(cols), (own["date"] < cut).to_numpy()
        coef = np.linalg.lstsq(x[before], own["demand"].to_numpy(float)[before], rcond=None)[0]
        mine = got[got["category"] == category].sort_values("date")
        want = (x @ coef)[~before][np.argsort(own["date"].to_numpy()[~before])]
        assert np.allclose(mine["predicted"].to_numpy(), want, rtol=1e-5, atol=1e-6)
        assert np.allclose(mine[["trend", "weekly", "yearly", "holiday"]].sum(axis=1), mine["predicted"])


def test_hybrid_metrics_against_numpy(spark):
    rows = {r.model: r.asDict() for r in pm.hybrid_forecast_metrics(spark, SMALL, rounds=10, depth=3).collect()}
    x, cut = pm.hybrid_model_rows(Marketplace(spark, SMALL))
    test = x.where(F.col("date") >= cut).toPandas()
    same_errors(rows["seasonal"], errors(test["demand"].to_numpy(float), test["seasonal"].to_numpy(float)))
    assert rows["hybrid"]["n"] == rows["seasonal"]["n"] and rows["hybrid"]["rmse"] < rows["seasonal"]["rmse"]


def test_target_specific_predictions_follow_the_weighted_rows(spark):
    """Quantity comes from the booster over weighted distinct requests: on average it fits the train mean."""
    got = pm.target_specific_predictions(spark, SMALL, rounds=50, depth=3).toPandas()
    assert len(got) and got["pred_quantity_sold"].between(got["quantity_sold"].min(), got["quantity_sold"].max()).all()
    assert abs(got["pred_quantity_sold"].mean() - got["quantity_sold"].mean()) < 2
    scores = ps.json_request_scores(spark, SMALL).toPandas()
    assert scores["error"].isna().equals(scores["price"].notna()) and scores["error"].notna().any()


def test_search_scores_are_those_of_single_fits(spark):
    """A map's cross-validated error equals fits of each fold alone."""
    grid = {"rounds": [5], "depth": [2], "rate": [0.3], "subsample": [0.8], "columns": [0.6], "alpha": [0.0, 1.0], "lam": [1.0]}
    rows = pm.tuned_boosted_cv(spark, SMALL, draws=2, grid=grid).collect()
    train, _ = pm._coded(*pm._product_split(Marketplace(spark, SMALL)), cols=["category"])
    train = fe.hash_folds(train, pm.DAY_KEYS, 3, 42)
    for r in rows:
        params = {k: r[k] for k in ("rounds", "depth", "rate", "subsample", "columns", "alpha", "lam")}
        rmse = [bo.fit(train, pm.CODED, ["quantity_sold"], [{**params, "target": 0, "train": [f for f in range(3) if f != k], "valid": [k]}],
                       fold="fold", keys=pm.DAY_KEYS).valid_rmse(0) for k in range(3)]
        assert math.isclose(r["cv_rmse"], sum(rmse) / 3, rel_tol=1e-9)
    assert sum(r["best"] for r in rows) == 1


# 30 days of one product of the daily golden table, and four of its rows
GOLDEN_QUANTITIES = [30, 25, 18, 35, 22, 15, 20, 32, 28, 12, 28, 20, 14, 24, 32, 18, 16, 30, 22, 10, 26, 34, 18, 15, 28, 20, 12, 24, 30, 16]
GOLDEN_ROWS = {   # day of January 2024: lag 1, 7, 14, rolling mean and deviation over 7 and 14
    15: (24.0, 32.0, 30.0, 22.571428571428573, 7.546680127869537, 23.071428571428573, 7.01058853794399),
    16: (32.0, 28.0, 25.0, 22.571428571428573, 7.546680127869537, 23.214285714285715, 7.180942421850636),
    22: (26.0, 32.0, 32.0, 22.0, 7.916228058025279, 22.285714285714285, 7.436175313741823),
    30: (30.0, 18.0, 18.0, 21.0, 6.658328118479393, 21.642857142857142, 7.291798795244535),
}


def test_daily_features_equal_the_golden_rows(spark):
    from larder.plans.features import product_features_of
    rows = [(1, "Fish", datetime.date(2024, 1, 1 + i), float(q), 1, 9.0) for i, q in enumerate(GOLDEN_QUANTITIES)]
    days = spark.createDataFrame(rows, "product_id long, category string, date date, quantity_sold double, orders_count long, price_mean double")
    got = {r.date.day: r for r in product_features_of(days.repartition(3)).collect()}
    assert sorted(got) == list(range(15, 31))
    for day, want in GOLDEN_ROWS.items():
        r = got[day]
        mine = (r.lag_1, r.lag_7, r.lag_14, r.rolling_mean_7, r.rolling_std_7, r.rolling_mean_14, r.rolling_std_14)
        assert np.allclose(mine, want, rtol=1e-12), day
        assert (r.month, r.day_of_month, r.is_weekend) == (1, day, int(r.date.weekday() >= 5))
