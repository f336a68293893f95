"""Deep pages (L2): a page index, so that a page reads its own rows only.

The ordered rows are dealt into ranges, numbered from the counts of the ranges before
theirs, and stored by blocks of ``block_rows`` numbers. Page n then prunes to the one or two
blocks that hold its numbers, however deep it lies; offset and limit would sort and hold
every row before it.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000


def write_page_index(rows: DataFrame, order: list, path: str, block_rows: int = BLOCK_ROWS) -> int:
    """Number ``rows`` (0, 1, ..) by ``order`` and store them under ``path``; returns how many there are."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = dealt.select("*", F.lit(0).cast("int").alias("_part"), F.lit(0).cast("long").alias("_at")).schema

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            place = pa.array(range(at, at + b.num_rows), pa.int64())
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), place], names=[*b.schema.names, "_part", "_at"])

    dealt.mapInArrow(number, schema).write.mode("overwrite").parquet(f"{path}/ranges")
    ranges = spark.read.schema(schema).parquet(f"{path}/ranges")
    counts = ranges.groupBy("_part").agg(F.count("*").alias("_n"))        # one row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"), "_n")
    number_ = (F.col("_before") + F.col("_at")).alias("ordinal")
    out = ranges.join(F.broadcast(counts.select("_part", "_before")), "_part").select(*rows.columns, number_)
    out.withColumn("block", F.expr(f"ordinal div {block_rows}").cast("long")).write.mode("overwrite").partitionBy("block").parquet(f"{path}/pages")
    return counts.agg(F.sum("_n")).first()[0] or 0


def read_page(spark: SparkSession, path: str, page: int, limit: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of page ``page`` (from 1) with their ``ordinal``; a page beyond the last one is empty."""
    first, last = (page - 1) * limit, page * limit - 1
    rows = spark.read.parquet(f"{path}/pages").where(F.col("block").between(first // block_rows, last // block_rows))
    return rows.where(F.col("ordinal").between(first, last)).drop("block").orderBy("ordinal")


def pages(total: int, limit: int) -> int:
    return math.ceil(total / limit)
