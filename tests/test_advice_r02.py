"""Findings of the second review: the whole job of each query."""

import datetime
import inspect

import numpy as np
from pyspark.sql import functions as F

from larder.operators import evaluation as ev
from larder.operators import models as md
from larder.operators import reviews as rv
from larder.plans import features as pf
from larder.plans import models as pm
from larder.plans import registry
from larder.sources.binding import Marketplace
from tests.conftest import SMALL

DAY = datetime.date(2024, 1, 1)


def test_hybrid_feature_set_has_both_windows_and_all_lags(spark):
    rng = np.random.default_rng(3)
    rows = [(k, DAY + datetime.timedelta(days=i), float(rng.integers(0, 50)), float(rng.integers(1, 9)),
             ["Sunny", "Rainy", "Cloudy"][int(rng.integers(3))], int(rng.integers(6) == 0)) for k in ("a", "b") for i in range(40)]
    g = spark.createDataFrame(rows, "category string, date date, demand double, price_mean double, "
                                    "weather_condition string, is_holiday int")
    got = {(r.category, r.date): r for r in pf.hybrid_feature_set(g).collect()}
    assert len(got) == 2 * (40 - 14)
    for k in ("a", "b"):
        s = [r for r in rows if r[0] == k]
        v, price = [r[2] for r in s], [r[3] for r in s]
        for i in range(14, 40):
            r = got[k, s[i][1]]
            assert [r[f"lag_{n}"] for n in (1, 2, 7, 14)] == [v[i - n] for n in (1, 2, 7, 14)]
            for n in (7, 14):
                want = {"rolling_mean": np.mean(v[i - n:i]), "rolling_std": np.std(v[i - n:i]), "rolling_min": min(v[i - n:i]),
                        "rolling_max": max(v[i - n:i]), "price_std": np.std(price[i - n:i]),
                        "holidays_last": sum(x[5] for x in s[i - n + 1:i + 1])}
                here = [x[4] for x in s[i - n + 1:i + 1]]
                want |= {"rainy_days_last": here.count("Rainy")}
                want |= {f"{c.lower()}_pct_last": here.count(c) / n for c in ("Rainy", "Sunny", "Cloudy")}
                assert all(abs(r[f"{c}_{n}"] - x) < 1e-9 for c, x in want.items())


def test_hybrid_model_gets_the_whole_feature_set(spark):
    x, cut = pm.hybrid_model_rows(Marketplace(spark, SMALL))
    assert {"lag_2", "lag_14", "rolling_max_14", "price_std_14", "rainy_pct_last_14", "holidays_last_14", "seasonal",
            "yearly"} <= set(x.columns)
    assert x.where(F.col("lag_14").isNull()).isEmpty() and cut is not None


def test_registered_training_uses_the_references_rounds_and_draws():
    want = {"ml_model_comparison": (200, 4), "target_specific_predictions": (200, 4), "stacked_model_metrics": (200, 4),
            "gbt_feature_importance": (500, 5), "hybrid_forecast_metrics": (300, 5)}
    for name, (rounds, depth) in want.items():
        p = inspect.signature(registry.QUERIES[name]).parameters
        assert (p["rounds"].default, p["depth"].default) == (rounds, depth)
    for name in ("tuned_linear_cv", "tuned_boosted_cv"):
        assert inspect.signature(registry.QUERIES[name]).parameters["draws"].default == 30
    assert {500, 100} <= set(pm.BOOSTED_GRID["rounds"]) and max(pm.BOOSTED_GRID["depth"]) == 10


def test_search_draws_boosted_maps_and_all_linear_ones(spark):
    grid = pm.BOOSTED_GRID | {"rounds": [1, 2], "depth": [2]}
    got = [r.params for r in pm.tuned_boosted_cv(spark, SMALL, draws=2, grid=grid).collect()]
    assert len(set(got)) == 2 and all("rounds" in p and "alpha" in p for p in got)
    assert pm.tuned_linear_cv(spark, SMALL).count() == 6


def _late_grid(spark):
    """Two early series, one without a key, and one that starts after the cut (day 60)."""
    rows = [(k, DAY + datetime.timedelta(days=i), float(i % 7 + 10), 5.0, "Sunny", int(i % 10 == 0))
            for k, first in (("early", 0), (None, 0), ("late", 70)) for i in range(first, 100)]
    return spark.createDataFrame(rows, "category string, date date, demand double, price_mean double, "
                                       "weather_condition string, is_holiday int"), DAY + datetime.timedelta(days=60)


def test_seasonal_regression_keeps_late_and_null_series(spark):
    g, cut = _late_grid(spark)
    out = md.seasonal_regression(g.where(F.col("date") < F.lit(cut)), g.where(F.col("date") >= F.lit(cut)), "category", "demand")
    by = {}
    for r in out.collect():
        by.setdefault(r.category, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"early": 40, None: 40, "late": 30}
    assert all((r.predicted, r.trend, r.holiday, r.lower) == (0.0, 0.0, 0.0, None) for r in by["late"])
    early = {r.date: r.predicted for r in by["early"]}
    assert all(r.predicted is not None and abs(r.predicted - early[r.date]) < 1e-6 for r in by[None])


def test_seasonal_regression_keeps_large_whole_keys_beside_a_null(spark):
    big = 2**53 + 1
    rows = [(k, DAY + datetime.timedelta(days=i), 4.0, 0) for k in (big, None) for i in range(40)]
    g = spark.createDataFrame(rows, "k long, date date, v double, is_holiday int")
    out = md.seasonal_regression(g, g, "k", "v").collect()
    assert len(out) == 80 and {r.k for r in out} == {big, None} and all(abs(r.predicted - 4) < 1e-3 for r in out)


def test_hybrid_model_rows_keep_late_and_null_series(spark, monkeypatch):
    g, cut = _late_grid(spark)
    monkeypatch.setattr(pm, "_grid_split", lambda mk: (g, F.lit(cut)))
    x, _ = pm.hybrid_model_rows(None)
    got = {r.category: (r["count"], r.n) for r in x.groupBy("category").agg(
        F.count("*").alias("count"), F.count("seasonal").alias("n")).collect()}
    assert got == {"early": (86, 86), None: (86, 86), "late": (16, 16)}


def test_product_predictions_roll_up_to_category_days(spark):
    p = spark.createDataFrame([("m", 1, DAY, 5.0, 4.0), ("m", 2, DAY, 7.0, 1.0), ("m", 3, DAY, 1.0, 1.0), ("m", 9, DAY, 2.0, 3.0)],
                              "model string, product_id long, date date, actual double, predicted double")
    cats = spark.createDataFrame([(1, DAY, "a"), (2, DAY, "a"), (2, DAY, "a"), (3, DAY, "b")], "product_id long, date date, category string")
    got = {r.category: (r.actual, r.predicted, r.products) for r in ev.roll_up(p, cats).collect()}
    assert got == {"a": (12.0, 5.0, 2), "b": (1.0, 1.0, 1), None: (2.0, 3.0, 1)}


def test_encoded_columns_of_more_levels_than_any_cap(spark):
    rows = [(f"c{i:05d}" if d < 8 else "new" if i else None, DAY + datetime.timedelta(days=d)) for d in range(10) for i in range(1500)]
    df = spark.createDataFrame(rows, "category string, date date")
    out = pf.encoded(df, ["category"]).groupBy("split", "category_column").agg(F.first("category_vec").alias("v")).collect()
    train = {r.category_column: r.v for r in out if r.split == "train"}
    assert len(train) == 1500 and all(v.size == 1500 and v.values.tolist() == [1.0] for v in train.values())
    assert len({int(v.indices[0]) for v in train.values()}) == 1500 and "category_c00007" in train
    assert [(r.category_column, r.v.numNonzeros()) for r in out if r.split == "test"] == [(None, 0)]


def test_public_reviews_are_featured_first_then_newest(spark):
    rows = [(i, "u", 5, "approved", i % 4 == 0, datetime.datetime(2024, 1, 1 + i % 9), None) for i in range(1, 30)]
    rows += [(90, "u", 5, "pending", True, datetime.datetime(2025, 1, 1), None), (91, "u", 5, "approved", True, datetime.datetime(2025, 1, 1), 3)]
    df = spark.createDataFrame(rows, "review_id long, user_name string, rating int, status string, featured boolean, "
                                     "created_at timestamp, product_id long")
    want = [r[0] for r in sorted(rows[:29], key=lambda r: (r[4], r[5], r[0]), reverse=True)]
    for page in (1, 3):
        got = sorted(rv.public_reviews(df, page, 10).collect(), key=lambda r: r.position)
        assert [r.review_id for r in got] == want[page * 10 - 10:page * 10] and {r.total for r in got} == {29}
