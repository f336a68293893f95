"""Review statistics, product ratings and notification views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.functions.columns import js_round, round_half_up

STARS = [5, 4, 3, 2, 1]


def platform_reviews(reviews: DataFrame) -> DataFrame:
    """Approved platform reviews (no product): the reference's public set."""
    return reviews.where((F.col("status") == "approved") & F.col("product_id").isNull())


def review_stats(reviews: DataFrame) -> DataFrame:
    """Count, mean (1 dp), % rated 4+ (JS rounding), distinct users."""
    r = platform_reviews(reviews)
    n = F.count(F.lit(1))
    return r.agg(
        n.alias("total_reviews"),
        F.coalesce(round_half_up(F.avg("rating"), 1), F.lit(0.0)).alias("average_rating"),
        F.when(n > 0, js_round(F.count_if(F.col("rating") >= 4) * 100.0 / n)).otherwise(F.lit(0))
         .cast("bigint").alias("satisfaction_rate"),
        F.countDistinct("user_id").alias("verified_customers"))


def admin_review_stats(reviews: DataFrame) -> DataFrame:
    """Counts by status and the approved mean (1 dp)."""
    st = F.col("status")
    return reviews.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(st == "pending").alias("pending_reviews"),
        F.count_if(st == "approved").alias("approved_reviews"),
        F.count_if(st == "rejected").alias("rejected_reviews"),
        F.coalesce(round_half_up(F.avg(F.when(st == "approved", F.col("rating"))), 1), F.lit(0.0))
         .alias("average_rating"))


def most_active_reviewers(reviews: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` users by review count (ties: lower user id); the
    name is the one on the user's first review."""
    g = reviews.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.min_by("user_name", F.struct("created_at", "review_id")).alias("user_name"))
    return g.orderBy(F.desc("review_count"), "user_id").limit(top)


def product_review_stats(reviews: DataFrame) -> DataFrame:
    """Per product: approved count, mean (1 dp) and the five star
    counts (all keys present), in one aggregate."""
    a = reviews.where((F.col("status") == "approved") & F.col("product_id").isNotNull())
    return a.groupBy("product_id").agg(F.count(F.lit(1)).alias("total"), round_half_up(F.avg("rating"), 1).alias("average"),
                                       *[F.count_if(F.col("rating") == s).alias(f"stars_{s}") for s in STARS])


def product_ratings(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Product rating (1 dp, 0 if none) and approved review count."""
    a = (reviews.where((F.col("status") == "approved") & F.col("product_id").isNotNull())
         .groupBy("product_id").agg(round_half_up(F.avg("rating"), 1).alias("rating"),
                                    F.count(F.lit(1)).alias("reviews")))
    r = products.select("product_id", "name").join(a, "product_id", "left")
    return r.select("product_id", "name", F.coalesce("rating", F.lit(0.0)).alias("rating"),
                    F.coalesce("reviews", F.lit(0)).alias("reviews"))


def platform_review_summary(reviews: DataFrame, latest: int = 3) -> DataFrame:
    """The platform mean (5.0 when none) next to the ``latest`` newest
    approved platform reviews."""
    r = platform_reviews(reviews)
    avg = F.coalesce(round_half_up(r.select(F.avg("rating")).scalar(), 1), F.lit(5.0))
    top = r.orderBy(F.desc("created_at"), F.desc("review_id")).limit(latest)
    return top.select("review_id", "user_name", "rating", "created_at",
                      avg.alias("average_rating"))


def unread_counts(notifications: DataFrame) -> DataFrame:
    """Unread notification count per user."""
    return notifications.groupBy("user_id").agg(F.count_if(~F.col("read")).alias("unread_count"))


def latest_per_key(df: DataFrame, key: str, order_cols: list, n: int) -> DataFrame:
    """The newest ``n`` rows per key. ``row_number() <= n`` lets Spark
    insert a partial per-key limit before the shuffle (WindowGroupLimit), so
    a hot key sends only ``n`` rows per map task."""
    w = Window.partitionBy(key).orderBy(*order_cols)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recent_notifications(notifications: DataFrame, n: int = 5) -> DataFrame:
    return latest_per_key(notifications, "user_id",
                          [F.desc("created_at"), F.desc("notification_id")], n)


def public_reviews(reviews: DataFrame, page: int = 1, limit: int = 10) -> DataFrame:
    """L1: a page of the approved platform reviews, featured ones first, then
    the newest (then the larger id), with its position and the total."""
    r = platform_reviews(reviews)
    total = r.select(F.count(F.lit(1))).scalar()
    order = [F.desc("featured"), F.desc("created_at"), F.desc("review_id")]
    rows = r.orderBy(*order).offset((page - 1) * limit).limit(limit)
    w = Window.orderBy(*order)  # over the rows of one page
    return rows.select("review_id", "user_name", "rating", "featured", "created_at",
                       (F.row_number().over(w) + (page - 1) * limit).alias("position"), total.alias("total"))
