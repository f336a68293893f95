"""ARIMA(2, 1, 2) by two regressions against numpy, null keys, short and constant series."""

import datetime
import math

import numpy as np

from larder.operators import arima, models

DAY = datetime.date(2020, 1, 1)


def plain(y, n_test):
    """The same two regressions with numpy."""
    train = np.asarray(y[:len(y) - n_test], float)
    d = np.diff(train)
    x = np.stack([d[2 - k:len(d) - 1 - k] for k in range(3)], 1)
    phi = np.linalg.solve(x.T @ x, x.T @ d[3:])
    e = d[3:] - x @ phi
    z = np.stack([d[4:-1], d[3:-2], e[1:-1], e[:-2]], 1)
    a1, a2, b1, b2 = np.linalg.solve(z.T @ z, z.T @ d[5:])
    if not (abs(a2) < 1 and a2 + a1 < 1 and a2 - a1 < 1):
        return [train[-1]] * n_test
    x1, x2, u1, u2, level, out = d[-1], d[-2], e[-1], e[-2], train[-1], []
    for _ in range(n_test):
        x1, x2, u1, u2 = a1 * x1 + a2 * x2 + b1 * u1 + b2 * u2, x1, 0.0, u1
        level += x1
        out.append(level)
    return out


def test_forecast_equals_numpy_and_every_series_has_one(spark):
    rng = np.random.default_rng(4)
    noise = rng.normal(size=203)
    moving = np.cumsum(noise[3:] + 0.4 * noise[2:-1] + 0.2 * noise[1:-2] + 5)
    data = {"a": np.round(rng.integers(0, 50, 200) + 20.0), None: np.round(moving, 3), "flat": np.full(200, 7.0), "short": np.arange(162.0)[158:],
            "late": np.array([3.0] * 20)}
    starts = {"short": 158, "late": 180}
    rows = [(k, DAY + datetime.timedelta(days=starts.get(k, 0) + i), float(v)) for k, ys in data.items() for i, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "k string, date date, y double").repartition(5)
    cut = DAY + datetime.timedelta(days=160)
    got = {}
    for r in arima.arima_forecast(df, "k", "y", cut).orderBy("date").collect():
        got.setdefault(r.k, []).append(r.predicted)
    assert len(got) == 5
    for k in ("a", None):
        assert np.allclose(got[k], plain(data[k], 40), rtol=1e-7)
    assert got[None][0] > 100                     # not the forecast of a missing series
    assert got["flat"] == [7.0] * 40 and got["short"] == [159.0] * 2 and got["late"] == [0.0] * 20


def test_ar2_keeps_the_series_without_a_key(spark):
    rows = [(k, DAY + datetime.timedelta(days=i), 100.0 + i % 5) for k in (None, "a") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, date date, y double")
    out = models.ar2_forecast(df, "k", "y", DAY + datetime.timedelta(days=50)).collect()
    assert len(out) == 20 and all(r.predicted > 50 for r in out)


def test_determinants():
    m = [[2.0, 1.0, 0.5, 3.0], [1.0, 3.0, 2.0, 0.1], [0.5, 2.0, 5.0, 1.0], [3.0, 0.1, 1.0, 4.0]]
    det, tops = arima.cramer(m, [1.0, 2.0, 3.0, 4.0])
    assert math.isclose(det, np.linalg.det(m)) and np.allclose(np.array(tops) / det, np.linalg.solve(m, [1, 2, 3, 4]))
