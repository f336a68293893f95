"""Calendar spines and interval joins.

A spine has one row per bucket; its size is fixed by the caller (number of
buckets), never by the data, so broadcasting it is always bounded. Events
are aggregated to the bucket grain with an inner range join against the
broadcast spine and then put back on the spine with an equi left join, so
empty buckets appear with 0 and the large side is never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def bucket_spine(spark, as_of: str, n: int, days: int, label: str = "bucket") -> DataFrame:
    """``n`` buckets of ``days`` days ending at ``as_of`` (oldest first).

    Bucket i (1-based) spans [as_of - (n-i+1)*days, as_of - (n-i)*days],
    both ends inclusive, as the reference's weekly counts do.
    """
    if n <= 0:
        raise ValueError("a spine has at least one bucket")
    d = F.to_timestamp_ntz(F.lit(as_of))
    return (spark.range(1, n + 1).select(F.col("id").cast("int").alias(label))
            .withColumn("bucket_start", d - F.make_dt_interval(days=(F.lit(n) - F.col(label) + 1) * days))
            .withColumn("bucket_end", d - F.make_dt_interval(days=(F.lit(n) - F.col(label)) * days)))


def day_spine(spark, start: Column | str, end: Column | str, col_name: str = "date") -> DataFrame:
    """One row per day in [start, end] (dates), built by ``sequence``."""
    s = F.to_date(F.lit(start)) if isinstance(start, str) else start
    e = F.to_date(F.lit(end)) if isinstance(end, str) else end
    return spark.range(1).select(F.explode(F.sequence(s, e)).alias(col_name))


def range_join_sum(events: DataFrame, ts_col: str, spine: DataFrame, key: str,
                   start_col: str = "bucket_start", end_col: str = "bucket_end",
                   aggs: dict[str, Column] | None = None) -> DataFrame:
    """Aggregate events into spine buckets, both ends inclusive.

    An event on a shared edge counts in both buckets. ``aggs`` maps output
    name -> aggregate Column (default: row count). Every spine row is kept;
    missing aggregates become 0.
    """
    aggs = aggs or {"n": F.count(F.lit(1))}
    seconds = lambda c: F.col(c).cast("timestamp").cast("long")
    sp = spine.select(key, start_col, end_col)
    bounds = sp.agg(F.min(start_col).alias("lo"), F.max(end_col).alias("hi"), F.greatest(F.max(seconds(end_col) - seconds(start_col)), F.lit(1)).alias("w"))
    lo, hi, width = (bounds.select(c).scalar() for c in ("lo", "hi", "w"))
    # a cell is as long as the longest bucket: a bucket meets two or three cells, an event one
    cell = lambda c: F.floor(seconds(c) / width).cast("long")
    sp = sp.withColumn("_cell", F.explode(F.sequence(cell(start_col), cell(end_col))))
    ev = events.where((F.col(ts_col) >= lo) & (F.col(ts_col) <= hi)).withColumn("_cell", cell(ts_col))
    joined = ev.join(sp, "_cell").where((F.col(ts_col) >= F.col(start_col)) & (F.col(ts_col) <= F.col(end_col)))
    per_bucket = joined.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])
    out = spine.join(per_bucket, key, "left")
    for n in aggs:
        out = out.withColumn(n, F.coalesce(F.col(n), F.lit(0)))
    return out


def fill_daily_grid(df: DataFrame, group_cols: list[str], date_col: str,
                    zero_cols: list[str]) -> DataFrame:
    """Every day between each group's first and last date; listed
    columns become 0 on filled days.

    The per-group [min, max] range is computed by an aggregate and exploded
    with ``sequence``; the data is then left-joined on (group, date), which
    shuffles on the group keys only once for both sides.
    """
    bounds = df.groupBy(*group_cols).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    grid = bounds.select(*group_cols, F.explode(F.sequence("_lo", "_hi")).alias(date_col))
    out = grid.join(df, group_cols + [date_col], "left")
    for c in zero_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)))
    return out
