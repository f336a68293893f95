"""ARIMA(2, 1, 2) per series by two regressions (M12), in column expressions only.

Hannan and Rissanen: a long autoregression of the differences gives residuals; the
differences are then regressed on their last two values and the last two residuals. Both
fits come from sums of products per series (map-side, one row per series) and the small
systems are solved by determinants in the projection. The forecast starts from the last
training state and walks the horizon with future residuals of 0; no test value is read.

Defined results: a series whose system is singular, that is too short, or whose
autoregressive part is not stationary is forecast as its last training value (the failure
rule); without training rows it is forecast as 0. A null key is a series like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG = 3                       # lags of the first regression


def determinant(m: list[list], mul, add, sub):
    """Laplace expansion along the first row, for columns and for SQL text."""
    if len(m) == 1:
        return m[0][0]
    total = None
    for j, head in enumerate(m[0]):
        term = mul(head, determinant([r[:j] + r[j + 1:] for r in m[1:]], mul, add, sub))
        total = term if total is None else (sub if j % 2 else add)(total, term)
    return total


COLUMN_OPS = (lambda a, b: a * b, lambda a, b: a + b, lambda a, b: a - b)


def cramer(m: list[list], v: list, ops=COLUMN_OPS):
    """The determinant of ``m`` and the numerators of the solution of ``m x = v``."""
    tops = [determinant([r[:j] + [b] + r[j + 1:] for r, b in zip(m, v, strict=True)], *ops) for j in range(len(m))]
    return determinant(m, *ops), tops


def _fit(rows: DataFrame, key: str, x: list[str], y: str, names: list[str]) -> DataFrame:
    """Per series the coefficients of ``y`` on ``x`` (no constant); null if singular."""
    k = len(x)
    sums = rows.groupBy(key).agg(*[F.sum(F.col(x[i]) * F.col(x[j])).alias(f"_m{i}{j}") for i in range(k) for j in range(i, k)],
                                 *[F.sum(F.col(a) * F.col(y)).alias(f"_v{i}") for i, a in enumerate(x)])
    m = [[F.col(f"_m{min(i, j)}{max(i, j)}") for j in range(k)] for i in range(k)]
    det, tops = cramer(m, [F.col(f"_v{i}") for i in range(k)])
    sums = sums.withColumn("_det", det)
    return sums.select(F.col(key).alias("_key"), *[F.when(F.col("_det") != 0, t / F.col("_det")).alias(n) for t, n in zip(tops, names, strict=True)])


def arima_forecast(series: DataFrame, key: str, target: str, cut_date, order: str = "date") -> DataFrame:
    """``key, date, actual, predicted`` of the rows from ``cut_date`` on; ``series`` is a daily grid."""
    w = Window.partitionBy(key).orderBy(order)
    d = series.select(key, order, F.col(target).cast("double").alias("y"))
    d = d.withColumn("d0", F.col("y") - F.lag("y").over(w))
    d = d.select("*", *[F.lag("d0", k).over(w).alias(f"d{k}") for k in range(1, LONG + 1)])
    train = d.where(F.col(order) < cut_date)
    lags = [f"d{k}" for k in range(1, LONG + 1)]
    phi = [f"p{k}" for k in range(1, LONG + 1)]
    long = _fit(train.where(F.col(lags[-1]).isNotNull()), key, lags, "d0", phi)
    same = F.col(key).eqNullSafe(F.col("_key"))
    fitted: Column = F.lit(0.0)
    for p, x in zip(phi, lags, strict=True):
        fitted = fitted + F.coalesce(F.col(p), F.lit(0.0)) * F.col(x)
    e = train.join(long, same, "left").withColumn("e0", F.col("d0") - fitted).drop("_key", *phi)
    e = e.select("*", F.lag("e0").over(w).alias("e1"), F.lag("e0", 2).over(w).alias("e2"))
    short = _fit(e.where(F.col("e2").isNotNull()), key, ["d1", "d2", "e1", "e2"], "d0", ["a1", "a2", "b1", "b2"])
    last = e.groupBy(key).agg(*[F.max_by(c, order).alias(f"s_{c}") for c in ("y", "d0", "d1", "e0", "e1")])
    ok = (F.abs("a2") < 1) & (F.col("a2") + F.col("a1") < 1) & (F.col("a2") - F.col("a1") < 1)
    ok = F.coalesce(ok & F.col("s_e1").isNotNull(), F.lit(False))
    state = last.join(short, same, "left").select(F.col(key).alias("_key"), "s_y", ok.alias("ok"), "a1", "a2", "b1", "b2", "s_d0", "s_d1", "s_e0", "s_e1")
    test = d.where(F.col(order) >= cut_date).select(key, order, F.col("y").alias("actual"))
    spans = test.groupBy(key).agg(F.count("*").alias("n"))
    first = F.struct(F.col("s_d0").alias("x1"), F.col("s_d1").alias("x2"), F.col("s_e0").alias("u1"), F.col("s_e1").alias("u2"), F.col("s_y").alias("y"),
                     F.array().cast("array<double>").alias("out"))

    def step(a, _):
        move = F.col("a1") * a["x1"] + F.col("a2") * a["x2"] + F.col("b1") * a["u1"] + F.col("b2") * a["u2"]
        return F.struct(move.alias("x1"), a["x1"].alias("x2"), F.lit(0.0).alias("u1"), a["u1"].alias("u2"), (a["y"] + move).alias("y"),
                        F.concat(a["out"], F.array(a["y"] + move)).alias("out"))

    walk = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), first, step, lambda a: a["out"])
    ahead = (spans.join(state, same, "left").select(F.col(key).alias("_key"), F.when(F.col("ok"), walk).alias("walk"), F.coalesce("s_y", F.lit(0.0)).alias("s_y")))
    rows = test.withColumn("_i", F.row_number().over(w)).join(ahead, same, "left")
    return rows.select(key, order, "actual", F.coalesce(F.get("walk", F.col("_i") - 1), F.col("s_y")).alias("predicted"))
