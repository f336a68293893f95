"""Review and notification queries: A17-A20, A22, A32, W24."""

from __future__ import annotations

from larder.operators import reviews as op
from larder.plans.registry import register
from larder.plans.sql_binding import with_views
from larder.plans.sqlfrag import rnd
from larder.sources.binding import Marketplace

_PLATFORM = "FROM b_reviews WHERE status = 'approved' AND product_id IS NULL"

STATS_SQL = with_views("b_reviews") + f"""
SELECT COUNT(*) AS total_reviews,
       COALESCE({rnd('AVG(rating)', 1)}, 0.0) AS average_rating,
       CAST(CASE WHEN COUNT(*) > 0 THEN FLOOR(CAST(COUNT(*) FILTER (WHERE rating >= 4) AS DOUBLE) * 100.0 / COUNT(*) + 0.5)
                 ELSE 0 END AS BIGINT) AS satisfaction_rate,
       COUNT(DISTINCT user_id) AS verified_customers
{_PLATFORM}
"""


@register("review_stats", covers=("A17", "U4"), sql=STATS_SQL)
def review_stats(spark, sf_dir):
    return op.review_stats(Marketplace(spark, sf_dir).reviews)


ADMIN_SQL = with_views("b_reviews") + f"""
SELECT COUNT(*) AS total_reviews,
       COUNT(*) FILTER (WHERE status = 'pending') AS pending_reviews,
       COUNT(*) FILTER (WHERE status = 'approved') AS approved_reviews,
       COUNT(*) FILTER (WHERE status = 'rejected') AS rejected_reviews,
       COALESCE({rnd("AVG(rating) FILTER (WHERE status = 'approved')", 1)}, 0.0) AS average_rating
FROM b_reviews
"""


@register("admin_review_stats", covers=("A18",), sql=ADMIN_SQL)
def admin_review_stats(spark, sf_dir):
    return op.admin_review_stats(Marketplace(spark, sf_dir).reviews)


ACTIVE_SQL = with_views("b_reviews") + """
SELECT user_id, COUNT(*) AS review_count,
       arg_min(user_name, (created_at, review_id)) AS user_name
FROM b_reviews GROUP BY user_id
ORDER BY review_count DESC, user_id LIMIT 5
"""


@register("most_active_reviewers", covers=("A18", "L4"), sql=ACTIVE_SQL)
def most_active_reviewers(spark, sf_dir):
    return op.most_active_reviewers(Marketplace(spark, sf_dir).reviews, 5)


PRODUCT_STATS_SQL = with_views("b_reviews") + f"""
SELECT product_id, COUNT(*) AS total, {rnd('AVG(rating)', 1)} AS average,
       COUNT(*) FILTER (WHERE rating = 5) AS stars_5, COUNT(*) FILTER (WHERE rating = 4) AS stars_4,
       COUNT(*) FILTER (WHERE rating = 3) AS stars_3, COUNT(*) FILTER (WHERE rating = 2) AS stars_2,
       COUNT(*) FILTER (WHERE rating = 1) AS stars_1
FROM b_reviews WHERE status = 'approved' AND product_id IS NOT NULL
GROUP BY product_id
"""


@register("product_review_stats", covers=("A19",), sql=PRODUCT_STATS_SQL)
def product_review_stats(spark, sf_dir):
    return op.product_review_stats(Marketplace(spark, sf_dir).reviews)


RATINGS_SQL = with_views("b_reviews", "b_products") + f"""
, a AS (
    SELECT product_id, {rnd('AVG(rating)', 1)} AS rating, COUNT(*) AS reviews
    FROM b_reviews WHERE status = 'approved' AND product_id IS NOT NULL GROUP BY product_id)
SELECT p.product_id, p.name, COALESCE(a.rating, 0.0) AS rating, COALESCE(a.reviews, 0) AS reviews
FROM b_products p LEFT JOIN a ON a.product_id = p.product_id
"""


@register("product_ratings", covers=("A20", "K9", "J1"), sql=RATINGS_SQL)
def product_ratings(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.product_ratings(mk.products, mk.reviews)


SUMMARY_SQL = with_views("b_reviews") + f"""
SELECT review_id, user_name, rating, created_at,
       COALESCE((SELECT {rnd('AVG(rating)', 1)} {_PLATFORM}), 5.0) AS average_rating
{_PLATFORM}
ORDER BY created_at DESC, review_id DESC LIMIT 3
"""


@register("platform_review_summary", covers=("A32", "L3"), sql=SUMMARY_SQL)
def platform_review_summary(spark, sf_dir):
    return op.platform_review_summary(Marketplace(spark, sf_dir).reviews, 3)


PUBLIC_SQL = with_views("b_reviews") + f"""
, r AS (
    SELECT review_id, user_name, rating, featured, created_at,
           ROW_NUMBER() OVER (ORDER BY featured DESC, created_at DESC, review_id DESC) AS position, COUNT(*) OVER () AS total
    {_PLATFORM})
SELECT * FROM r WHERE position <= 10
"""


@register("public_reviews", covers=("L1",), sql=PUBLIC_SQL)
def public_reviews(spark, sf_dir):
    return op.public_reviews(Marketplace(spark, sf_dir).reviews)


UNREAD_SQL = with_views("b_notifications") + """
SELECT user_id, COUNT(*) FILTER (WHERE NOT read) AS unread_count FROM b_notifications GROUP BY user_id
"""


@register("unread_counts", covers=("A22",), sql=UNREAD_SQL)
def unread_counts(spark, sf_dir):
    return op.unread_counts(Marketplace(spark, sf_dir).notifications)


RECENT_SQL = with_views("b_notifications") + """
SELECT * FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, notification_id DESC) AS rank
    FROM b_notifications) t
WHERE rank <= 5
"""


@register("recent_notifications", covers=("W24", "L1"), sql=RECENT_SQL)
def recent_notifications(spark, sf_dir):
    return op.recent_notifications(Marketplace(spark, sf_dir).notifications, 5)
