"""Leak-free time-series features as window expressions.

All windows are partitioned by a series key (product or category) and
ordered by date plus a tie-break, so lags are ROW lags within the series.
Features that share one partitioning and ordering are computed in one
``select`` so Spark sorts each partition once. Run category-level windows
on category-day aggregates (few keys, one row per day) rather than on raw
rows: the key count is tiny, so the aggregate keeps each window partition
small.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

_SPREAD = 64  # parts of a date whose rows need no rank
NO_HOLIDAY_YET = 999  # days-since value before the first holiday (fixed value)


def series_window(key: Sequence[str] | str, order: Sequence[str] | str):
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*key).orderBy(*order)


def time_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """month, ISO week, day of month, quarter, weekday (0 = Monday),
    weekend flag."""
    d = F.col(date_col)
    return df.select("*",
                     F.month(d).alias("month"),
                     F.weekofyear(d).alias("week_of_year"),
                     F.dayofmonth(d).alias("day_of_month"),
                     F.quarter(d).alias("quarter"),
                     F.weekday(d).alias("day_of_week_num"),
                     (F.weekday(d) >= 5).cast("int").alias("is_weekend"))


def lag_features(target: str, lags: Sequence[int], w) -> list[Column]:
    """``lag_k`` = value k rows earlier in the series."""
    return [F.lag(target, k).over(w).alias(f"lag_{k}") for k in lags]


def rolling_features(target: str, windows: Sequence[int], w, std: str = "samp",
                     min_periods=None, prefix: str = "rolling") -> list[Column]:
    """Mean and std of the PREVIOUS ``w`` rows (the current row is
    excluded), NULL unless at least ``min_periods(w)`` (default
    max(1, w // 2)) non-null values are in the frame."""
    out = []
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        need = min_periods(n) if callable(min_periods) else (min_periods or max(1, n // 2))
        enough = F.count(target).over(frame) >= need
        sd = F.stddev_samp if std == "samp" else F.stddev_pop
        out.append(F.when(enough, F.avg(target).over(frame)).alias(f"{prefix}_mean_{n}"))
        out.append(F.when(enough, sd(target).over(frame)).alias(f"{prefix}_std_{n}"))
    return out


def full_window_stats(target: str, n: int, w, prefix: str = "rolling",
                      stats=("mean", "std", "min", "max")) -> list[Column]:
    """Stats over the previous ``n`` rows, only once ``n`` full rows
    exist before the current one (population std)."""
    frame = w.rowsBetween(-n, -1)
    full = F.row_number().over(w) > n
    fns = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return [F.when(full, fns[s](target).over(frame)).alias(f"{prefix}_{s}_{n}") for s in stats]


def rolling_count(cond: Column, n: int, w, name: str) -> Column:
    """How many of the last ``n`` rows (current included) satisfy cond."""
    return F.sum(cond.cast("int")).over(w.rowsBetween(-(n - 1), 0)).alias(name)


def rolling_share(cond: Column, n: int, w, name: str) -> Column:
    """Share of the last ``n`` rows (current included) satisfying cond."""
    return F.avg(cond.cast("double")).over(w.rowsBetween(-(n - 1), 0)).alias(name)


def run_length(df: DataFrame, key, order, value: str, name: str = "streak") -> DataFrame:
    """Length of the current run of equal ``value`` (gaps and islands:
    a change flag, its running sum as island id, row number in the island)."""
    w = series_window(key, order)
    changed = F.coalesce(F.col(value) != F.lag(value, 1).over(w), F.lit(True)).cast("int")
    keys = [key] if isinstance(key, str) else list(key)
    df = df.withColumn("_chg", changed).withColumn("_isl", F.sum("_chg").over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    wi = series_window(keys + ["_isl"], order)
    return df.withColumn(name, F.row_number().over(wi)).drop("_chg", "_isl")


def event_distance(flag: Column, w, rn: Column):
    """Rows since the last flagged row (0 on it, NO_HOLIDAY_YET
    before any) and rows until the next one (NO_HOLIDAY_YET after the last;
    this one looks ahead, so only use it when the calendar is known)."""
    marked = F.when(flag, rn)
    last = F.last(marked, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(marked, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    since = F.coalesce(rn - last, F.lit(NO_HOLIDAY_YET))
    until = F.coalesce(nxt - rn, F.lit(NO_HOLIDAY_YET))
    return since, until


def proximity(since: Column, until: Column, reach: int = 3) -> Column:
    """max(1 - d/(reach+1)) over d = since/until within ``reach``."""
    den = float(reach + 1)
    a = F.when(since <= reach, 1 - since / den)
    b = F.when(until <= reach, 1 - until / den)
    return F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))


def first_difference(value: str, w) -> Column:
    """Value - previous value, 0 on the first row."""
    return F.coalesce(F.col(value) - F.lag(value, 1).over(w), F.lit(0.0))


def ratio_to_group_mean(df: DataFrame, value: str, group: Sequence[str], name: str) -> DataFrame:
    """Value / mean(value over the group) - 1 (e.g. category-day). The means
    are an aggregate joined back, so no task holds the rows of a group."""
    means = df.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.avg(value).alias("_mean"))
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    return df.join(means, same).withColumn(name, F.col(value) / F.col("_mean") - 1).drop("_mean", *[f"_{c}" for c in group])


def fill_forward_backward(col: str, w) -> Column:
    """Forward fill, then backward fill, within the series."""
    fwd = F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    bwd = F.first(col, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(F.col(col), fwd, bwd)


def latest_non_null(df: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """Per key, the newest non-null value of each column (per column,
    not the newest row), as pandas ``groupby().last()``. One aggregate:
    max_by over rows where that column is present."""
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols]
    return df.groupBy(key).agg(*aggs)


def cut_position(df: DataFrame, order: Sequence[str], cuts: Sequence[Column], date_col: str = "date",
                 name: str = "_pos") -> DataFrame:
    """1-based position of each row in (date, tie-break) order, as far as it
    matters for ``cuts`` (positions after which the rows are parted).

    Rows are counted per date (small aggregate) and a running count gives the rows
    before a date. Only rows of a date that a cut falls into are ranked; those of any
    other date are on one side of every cut and are spread over ``_SPREAD`` parts."""
    per_date = df.groupBy(date_col).agg(F.count(F.lit(1)).alias("_n"))
    wd = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, -1)
    before = per_date.select(date_col, "_n", F.coalesce(F.sum("_n").over(wd), F.lit(0)).alias("_before"))
    inside = functools.reduce(lambda a, b: a | b, [(F.col("_before") < c) & (c < F.col("_before") + F.col("_n")) for c in cuts])
    before = before.select(date_col, "_before", inside.alias("_cut"))
    spread = F.when(F.col("_cut"), 0).otherwise(F.pmod(F.xxhash64(*order), F.lit(_SPREAD)))
    rank = F.row_number().over(Window.partitionBy(date_col, "_part").orderBy(*order))
    place = df.join(before, date_col).withColumn("_part", spread).withColumn("_rank", rank)
    return place.withColumn(name, F.col("_before") + F.when(F.col("_cut"), F.col("_rank")).otherwise(1)).drop("_before", "_cut", "_part", "_rank")


def split_by_position(df: DataFrame, order: Sequence[str], ratio: float = 0.8,
                      date_col: str = "date") -> DataFrame:
    """First floor(n * ratio) rows in (date, tie-break) order are
    'train', the rest 'test' (positions from ``cut_position``)."""
    n = df.select(F.count(F.lit(1))).scalar()
    cut = F.floor(n * F.lit(ratio))
    ranked = cut_position(df, order, [cut], date_col)
    return ranked.withColumn("split", F.when(F.col("_pos") <= cut, "train").otherwise("test")) \
                 .drop("_pos")


def split_by_date_position(df: DataFrame, ratio: float = 0.8, date_col: str = "date",
                           dates: DataFrame | None = None) -> DataFrame:
    """Cut at the distinct date with index floor(k * ratio); earlier
    dates train, the rest test. ``dates`` holds the dates of ``df``, if they
    are at hand without computing ``df``."""
    dates = (df if dates is None else dates).select(date_col).distinct()
    k = dates.select(F.count(F.lit(1))).scalar()
    w = Window.orderBy(date_col)
    idx = dates.select(date_col, (F.row_number().over(w) - 1).alias("_i"))
    cut = idx.where(F.col("_i") == F.floor(k * F.lit(ratio))).select(F.min(date_col)).scalar()
    return df.withColumn("split", F.when(F.col(date_col) < cut, "train").otherwise("test"))


def expanding_folds(df: DataFrame, order: Sequence[str], k: int = 3,
                    date_col: str = "date") -> DataFrame:
    """K expanding time folds (as TimeSeriesSplit): test blocks of size
    n // (k + 1) at the end; each fold trains on everything before its block.
    Returns one row per (row, fold) with role train/test."""
    n = df.select(F.count(F.lit(1))).scalar()
    size = F.floor(n / F.lit(k + 1))
    first = n - size * k
    d = cut_position(df, order, [first + size * i for i in range(k + 1)], date_col).withColumn("_pos", F.col("_pos") - 1)
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    x = d.select("*", folds)
    start = first + F.col("fold") * size
    role = (F.when(F.col("_pos") < start, "train")
            .when(F.col("_pos") < start + size, "test"))
    return x.withColumn("role", role).where(F.col("role").isNotNull()).drop("_pos")


def time_blocks(df: DataFrame, order: Sequence[str], k: int = 3, date_col: str = "date", name: str = "fold") -> DataFrame:
    """W21 as one number per row: block 0 is trained on first, block i (1 .. k)
    is the test block of the i-th expanding fold."""
    n = df.select(F.count(F.lit(1))).scalar()
    size = F.floor(n / F.lit(k + 1))
    first = n - size * k
    place = cut_position(df, order, [first + size * i for i in range(k + 1)], date_col).withColumn("_pos", F.col("_pos") - 1)
    block = F.when(F.col("_pos") < first, 0).otherwise(F.floor((F.col("_pos") - first) / size) + 1)
    return place.withColumn(name, block.cast("int")).drop("_pos")


def hash_folds(df: DataFrame, key_cols: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Reproducible fold id pmod(xxhash64(key, seed), k); also gives a
    random-like 80/20 split via fold == 0 as test for k = 5."""
    h = F.xxhash64(*key_cols, F.lit(seed))
    return df.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))


def keyed_folds(df: DataFrame, key: Sequence[Column], k: int = 5, seed: int = 42) -> DataFrame:
    """W22 by a digest that any engine can compute: the first 32 bits of the
    MD5 of the key texts and the seed, modulo ``k``."""
    digest = F.md5(F.concat_ws("|", *key, F.lit(str(seed))))
    return df.withColumn("fold", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def align_dates(df: DataFrame, as_of: str, date_col: str = "date") -> DataFrame:
    """Shift all dates so the latest equals ``as_of``."""
    mx = df.select(F.max(date_col)).scalar()
    return df.withColumn(date_col, F.date_add(F.col(date_col), F.datediff(F.to_date(F.lit(as_of)), mx)))
