"""Readers for the driver's parquet tables.

Each table is one parquet file/folder. Reads are lazy: Catalyst prunes
columns and pushes filters into the scan, so callers select what they need
and never read whole rows for a narrow projection.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose the raw tables to ``spark.sql`` under their own names."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
