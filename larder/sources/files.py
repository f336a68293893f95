"""File sources and sinks.

Every reader declares its schema (no inference); every writer is a normal
DataFrame writer, so output is written in parallel by the executors.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.columns import parse_float_or_zero

DEFAULT_MARGIN = 15.0  # margin % when no valid setting is stored (fixed value)

ORDER_HISTORY_SCHEMA = ("date DATE, product_name STRING, category STRING, quantity_sold INT, price DOUBLE, "
                        "day_of_week STRING, is_holiday INT, weather_condition STRING")


def read_order_history(spark: SparkSession, path: str) -> DataFrame:
    """Order-history CSV with a header, typed by the declared schema
    (dates parsed on read; no sort - operators order what they need)."""
    return spark.read.schema(ORDER_HISTORY_SCHEMA).option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """S3: tolerant prediction file (actual, predicted, category, date):
    the first line of every file is a header, blank lines are skipped, lines
    with fewer than 4 comma-separated fields are dropped, a bad number becomes
    0 and the date is trimmed. The CSV reader only drops the headers and splits
    files; with a separator that no line holds, a line stays one field and the
    naive comma splitting is exact."""
    body = (spark.read.schema("line STRING").option("header", True).option("enforceSchema", True)
            .option("sep", "\u0001").option("quote", "").option("escape", "").csv(path)
            .where(F.trim("line") != ""))
    parts = body.select(F.split(F.trim("line"), ",").alias("c")).where(F.size("c") >= 4)
    return parts.select(
        parse_float_or_zero(F.col("c")[0]).alias("actual"),
        parse_float_or_zero(F.col("c")[1]).alias("predicted"),
        F.col("c")[2].alias("category"),
        F.trim(F.col("c")[3]).alias("date"))


def read_margin(spark: SparkSession, path: str, default: float = DEFAULT_MARGIN) -> float:
    """The stored margin, or ``default`` when the file is missing,
    malformed or has no numeric ``margin``. A one-row settings file: the
    value is a job parameter, read once on the driver."""
    try:
        df = spark.read.option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return default
        raise
    if "margin" not in df.columns:
        return default
    row = df.select(F.max(F.col("margin").cast("string").try_cast("double")).alias("m")).first()
    return default if row is None or row["m"] is None else float(row["m"])


def save_margin(spark: SparkSession, path: str, margin) -> float:
    """Validate and replace the stored margin (one-row JSON)."""
    try:
        value = float(margin)
    except (TypeError, ValueError):
        raise ValueError("Invalid margin value") from None
    spark.createDataFrame([(value,)], "margin double").coalesce(1).write.mode("overwrite").json(path)
    return value


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """CSV (with header), JSON or Parquet; ``mode='append'`` adds
    rows (bulk append of generated invoices or notices)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        getattr(w, fmt)(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted preprocessing + model pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
