"""Named queries: name -> (spark builder, oracle SQL or None).

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables. The oracle is an independent DuckDB statement over the
same parquet tables; queries with no oracle get a brute-force test instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}  # query name -> survey ids covered


def register(name: str, covers: tuple[str, ...] = (), sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        OPERATORS[name] = tuple(covers)
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from larder.plans import (  # noqa: F401
        supplier, platform, billing, reviews, catalogue, features, evaluation,
        answers, chat, events, lifecycle, models, quality, scoring, submissions,
    )
