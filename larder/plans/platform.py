"""Platform (admin) queries: A1-A7, A13-A16, A34, U1, P19."""

from __future__ import annotations

from larder.operators import platform as op
from larder.operators.supplier import supplier_orders
from larder.plans.registry import register
from larder.plans.sql_binding import with_views
from larder.plans.sqlfrag import ratio, rnd
from larder.sources.binding import AS_OF, Marketplace

M = op.DEFAULT_MARGIN
SHARE = repr(M / (100.0 + M))
NOW = f"TIMESTAMP '{AS_OF} 00:00:00'"

STATS_SQL = with_views("b_orders", "b_items", "b_products", "b_buyers", "b_suppliers") + f"""
, o AS (
    SELECT COUNT(*) AS total_orders,
           COUNT(*) FILTER (WHERE created_at >= CAST(DATE '{AS_OF}' AS TIMESTAMP)) AS orders_today,
           COUNT(*) FILTER (WHERE status = 'Pending') AS pending_orders,
           COUNT(*) FILTER (WHERE status = 'Delivered') AS completed_orders,
           COUNT(*) FILTER (WHERE status = 'Cancelled') AS cancelled_orders,
           COALESCE(SUM(CAST(total AS DECIMAL(18,2))), 0) AS gmv,
           COALESCE(SUM(CAST(total AS DECIMAL(18,2))) FILTER (WHERE created_at >= {NOW} - INTERVAL 30 DAY), 0) AS cur30,
           COALESCE(SUM(CAST(total AS DECIMAL(18,2))) FILTER (
               WHERE created_at >= {NOW} - INTERVAL 60 DAY AND created_at < {NOW} - INTERVAL 30 DAY), 0) AS prior30
    FROM b_orders)
, r AS (
    SELECT COALESCE(SUM(CAST(COALESCE(supplier_price, price) * quantity AS DECIMAL(18,2))), 0) AS sr,
           COALESCE(SUM(CAST(COALESCE(marketplace_price, price) * quantity AS DECIMAL(18,2))), 0) AS mr
    FROM b_items WHERE order_id IN (SELECT order_id FROM b_orders WHERE status <> 'Cancelled'))
SELECT o.total_orders,
       (SELECT COUNT(*) FROM b_buyers) AS total_customers,
       (SELECT COUNT(*) FROM b_suppliers) AS total_suppliers,
       (SELECT COUNT(*) FROM b_buyers) + (SELECT COUNT(*) FROM b_suppliers) + 1 AS active_users,
       o.orders_today, o.pending_orders, o.completed_orders, o.cancelled_orders,
       (SELECT COUNT(*) FILTER (WHERE is_active) FROM b_products) AS total_products,
       CAST(o.gmv AS DOUBLE) AS total_gmv,
       CAST(o.cur30 AS DOUBLE) AS current_30d_gmv,
       CAST(o.prior30 AS DOUBLE) AS prior_30d_gmv,
       CASE WHEN o.prior30 > 0 THEN {rnd('(CAST(o.cur30 AS DOUBLE) - CAST(o.prior30 AS DOUBLE)) / CAST(o.prior30 AS DOUBLE) * 100', 1)}
            WHEN o.cur30 > 0 THEN CAST(100 AS DOUBLE) ELSE CAST(12.5 AS DOUBLE) END AS platform_growth_rate,
       {rnd(f"CAST(o.gmv AS DOUBLE) * CAST('{SHARE}' AS DOUBLE)", 2)} AS platform_profit,
       CAST({M} AS DOUBLE) AS margin,
       CAST(r.sr AS DOUBLE) AS supplier_revenue,
       CAST(r.mr AS DOUBLE) AS marketplace_revenue,
       CAST(r.mr - r.sr AS DOUBLE) AS margin_revenue
FROM o, r
"""


@register("platform_stats", covers=("A1", "A2", "A3", "A4", "A5", "P5", "F12"), sql=STATS_SQL)
def platform_stats(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.platform_stats(mk.orders, mk.order_items, mk.products, mk.buyers, mk.suppliers, AS_OF)


WEEKLY_SQL = with_views("b_orders") + f"""
, spine AS (
    SELECT CAST(i AS INTEGER) AS week,
           {NOW} - to_days(CAST((9 - i + 1) * 7 AS INTEGER)) AS s,
           {NOW} - to_days(CAST((9 - i) * 7 AS INTEGER)) AS e
    FROM range(1, 10) t(i))
SELECT week, CAST(s AS DATE) AS week_start, CAST(e AS DATE) AS week_end,
       (SELECT COUNT(*) FROM b_orders WHERE created_at >= s AND created_at <= e) AS orders
FROM spine
"""


@register("weekly_orders", covers=("A6", "J10"), sql=WEEKLY_SQL)
def weekly_orders(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.weekly_orders(spark, mk.orders, AS_OF, 9)


DAILY_SQL = with_views("b_orders") + f"""
, spine AS (
    SELECT CAST(d AS DATE) AS date
    FROM generate_series(DATE '{AS_OF}' - INTERVAL 6 DAY, CAST(DATE '{AS_OF}' AS TIMESTAMP), INTERVAL 1 DAY) t(d))
, rev AS (
    SELECT order_date, SUM(CAST(total AS DECIMAL(18,2))) AS rev
    FROM b_orders WHERE status <> 'Cancelled' GROUP BY order_date)
SELECT s.date, strftime(s.date, '%a') AS label,
       CAST(COALESCE(rev.rev, 0) AS DOUBLE) AS revenue,
       {rnd(f"CAST(COALESCE(rev.rev, 0) AS DOUBLE) * CAST('{SHARE}' AS DOUBLE)", 2)} AS profit
FROM spine s LEFT JOIN rev ON rev.order_date = s.date
"""


@register("daily_revenue", covers=("A7", "J9", "F6", "F10"), sql=DAILY_SQL)
def daily_revenue(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.daily_revenue(spark, mk.orders, AS_OF, 7)


BUYER_SQL = with_views("b_orders", "b_items", "b_products") + """
, per AS (
    SELECT buyer_id,
           CAST(COALESCE(SUM(CAST(total AS DECIMAL(18,2))) FILTER (WHERE status <> 'Cancelled'), 0) AS DOUBLE) AS total_purchases,
           COUNT(*) AS total_orders
    FROM b_orders GROUP BY buyer_id)
, cq AS (
    SELECT o.buyer_id, p.category, SUM(i.quantity) AS qty
    FROM b_items i JOIN b_orders o ON o.order_id = i.order_id AND o.status <> 'Cancelled'
    JOIN b_products p ON p.product_id = i.product_id
    GROUP BY o.buyer_id, p.category)
, fav AS (
    SELECT buyer_id, category AS favorite_category FROM (
        SELECT buyer_id, category,
               ROW_NUMBER() OVER (PARTITION BY buyer_id ORDER BY qty DESC, category) AS rn FROM cq) t
    WHERE rn = 1)
SELECT c.c_custkey AS buyer_id,
       COALESCE(per.total_purchases, 0.0) AS total_purchases,
       COALESCE(per.total_orders, 0) AS total_orders,
       COALESCE(fav.favorite_category, '—') AS favorite_category,
       0 AS disputes
FROM customer c LEFT JOIN per ON per.buyer_id = c.c_custkey
LEFT JOIN fav ON fav.buyer_id = c.c_custkey
"""


@register("buyer_stats", covers=("A13", "J4", "J14"), sql=BUYER_SQL)
def buyer_stats(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.buyer_stats(mk.orders, mk.order_items, mk.products, mk.buyers)


SUPSTATS_SQL = with_views("b_orders", "b_products", "b_reviews") + f"""
, pr AS (SELECT DISTINCT l_orderkey AS order_id, l_suppkey AS supplier_id FROM lineitem)
, cnt AS (
    SELECT pr.supplier_id, COUNT(*) AS n,
           COUNT(*) FILTER (WHERE o.status IN ('Delivered', 'In Transit', 'Pending')) AS done,
           COUNT(*) FILTER (WHERE o.status = 'Delivered') AS delivered,
           COUNT(*) FILTER (WHERE o.status = 'Cancelled') AS cancelled
    FROM pr JOIN b_orders o ON o.order_id = pr.order_id GROUP BY pr.supplier_id)
, listed AS (SELECT supplier_id, COUNT(*) AS listed_products FROM b_products GROUP BY supplier_id)
, rating AS (
    SELECT p.supplier_id, AVG(r.rating) AS avg_rating
    FROM b_reviews r JOIN b_products p ON p.product_id = r.product_id
    WHERE r.status = 'approved' GROUP BY p.supplier_id)
SELECT s.s_suppkey AS supplier_id,
       COALESCE(listed.listed_products, 0) AS listed_products,
       COALESCE({rnd('rating.avg_rating', 1)}, 5.0) AS supplier_rating,
       CASE WHEN COALESCE(cnt.n, 0) > 0 THEN {rnd('CAST(cnt.done AS DOUBLE) * 100.0 / cnt.n', 1)} ELSE 98.2 END
           AS fulfillment_rate,
       CASE WHEN COALESCE(cnt.n, 0) > 0 THEN {rnd(
           'CAST(cnt.delivered AS DOUBLE) * 100.0 / CASE WHEN cnt.n - cnt.cancelled = 0 THEN 1 ELSE cnt.n - cnt.cancelled END', 1)}
            ELSE 95.4 END AS delivery_performance,
       COALESCE(cnt.n, 0) AS total_orders
FROM supplier s
LEFT JOIN listed ON listed.supplier_id = s.s_suppkey
LEFT JOIN rating ON rating.supplier_id = s.s_suppkey
LEFT JOIN cnt ON cnt.supplier_id = s.s_suppkey
"""


@register("supplier_stats", covers=("A14", "J4", "J5"), sql=SUPSTATS_SQL)
def supplier_stats(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    pairs = supplier_orders(mk.order_items, mk.orders)
    return op.supplier_stats(pairs, mk.products, mk.reviews, mk.suppliers)


MARKET_SQL = with_views("b_orders", "b_products", "b_suppliers") + """
, o AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'Delivered') AS d FROM b_orders)
, p AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE stock = 0) AS z FROM b_products WHERE is_active)
, s AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE is_verified) AS v FROM b_suppliers)
SELECT CAST(CASE WHEN o.n > 0 THEN LEAST(100, FLOOR(CAST(o.d AS DOUBLE) * 100.0 / o.n + 0.5)) ELSE 75 END AS BIGINT)
           AS predicted_demand_index,
       CAST(CASE WHEN p.n > 0 THEN FLOOR(CAST(p.z AS DOUBLE) * 100.0 / p.n + 0.5) ELSE 25 END AS BIGINT)
           AS inventory_risk_score,
       CAST(CASE WHEN s.n > 0 THEN FLOOR(CAST(s.v AS DOUBLE) * 100.0 / s.n + 0.5) ELSE 80 END AS BIGINT)
           AS supplier_stability_index
FROM o, p, s
"""


@register("market_indices", covers=("A15", "F7"), sql=MARKET_SQL)
def market_indices(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.market_indices(mk.orders, mk.products, mk.suppliers)


REGION_SQL = with_views("b_orders", "b_buyers") + f"""
, c AS (
    SELECT trim(b.city) AS city, COUNT(*) AS orders
    FROM b_orders o JOIN b_buyers b ON b.user_id = o.buyer_id
    WHERE b.city IS NOT NULL AND trim(b.city) <> ''
    GROUP BY trim(b.city))
SELECT city, orders,
       printf('+%.1f%%', {rnd('5.0 + (CAST(orders AS DOUBLE) * CAST(2.3 AS DOUBLE)) % 20', 1)}) AS demand_growth,
       CASE WHEN orders > 3 THEN 'High Volume Category Demand' ELSE 'Standard Delivery Activity' END AS trend,
       LEAST(99, 70 + orders * 5) AS confidence
FROM c ORDER BY orders DESC, city LIMIT 5
"""


@register("regional_insights", covers=("A16", "L4", "F1", "F5"), sql=REGION_SQL)
def regional_insights(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.regional_insights(mk.orders, mk.buyers, 5)


RISK_SQL = with_views("b_suppliers") + """
SELECT user_id, COALESCE(NULLIF(trim(company), ''), name) AS name, verification_status,
       CASE verification_status WHEN 'approved' THEN 'Low' WHEN 'pending' THEN 'Medium' ELSE 'High' END AS risk
FROM b_suppliers
"""


@register("supplier_risk", covers=("P19", "F12"), sql=RISK_SQL)
def supplier_risk(spark, sf_dir):
    return op.supplier_risk(Marketplace(spark, sf_dir).suppliers)


def _defaults_sql() -> str:
    rows = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in op.REC_DEFAULTS)
    return rows


RECS_SQL = with_views("b_products", "b_suppliers") + f"""
, low AS (
    SELECT 'rec-stock-' || CAST(product_id AS VARCHAR) AS rec_id, 'inventory' AS type,
           printf('{op.REC_STOCK}', name, stock) AS text, 'High' AS importance, 1 AS grp, product_id AS pos
    FROM b_products WHERE is_active AND stock > 0 AND stock < 20 ORDER BY product_id LIMIT 2)
, pend AS (
    SELECT 'rec-verify-' || CAST(user_id AS VARCHAR) AS rec_id, 'supplier' AS type,
           printf('{op.REC_SUPPLIER}', COALESCE(NULLIF(trim(company), ''), name)) AS text,
           'Medium' AS importance, 2 AS grp, user_id AS pos
    FROM b_suppliers WHERE verification_status = 'pending' ORDER BY user_id LIMIT 2)
, found AS (SELECT * FROM low UNION ALL SELECT * FROM pend)
, defs AS (
    SELECT rec_id, type, text, importance, 3 AS grp, CAST(0 AS BIGINT) AS pos
    FROM (VALUES {_defaults_sql()}) v(rec_id, type, text, importance)
    WHERE (SELECT COUNT(*) FROM found) < 3)
SELECT rec_id, type, text, importance FROM (SELECT * FROM found UNION ALL SELECT * FROM defs) a
ORDER BY grp, pos, rec_id LIMIT 4
"""


@register("recommendations", covers=("A34", "U5", "L3", "F5"), sql=RECS_SQL)
def recommendations(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.recommendations(spark, mk.products, mk.suppliers)


FEED_SQL = with_views("b_orders", "b_signups") + """
, o AS (
    SELECT 'order' AS type,
           CASE WHEN status IN ('Completed', 'Delivered') THEN 'Order Completed'
                WHEN status = 'Cancelled' THEN 'Order Cancelled' ELSE 'New Order Placed' END AS title,
           printf('Order of £%.2f is %s.', CAST(ROUND(CAST(total AS DECIMAL(38,10)), 2) AS DOUBLE),
                  COALESCE(status, 'Pending')) AS description,
           created_at AS ts, order_id AS ref_id
    FROM b_orders ORDER BY created_at DESC, order_id DESC LIMIT 5)
, u AS (
    SELECT 'customer' AS type, 'New Customer Registered' AS title,
           printf('User %d joined the platform.', user_id) AS description,
           created_at AS ts, user_id AS ref_id
    FROM b_signups ORDER BY created_at DESC, user_id DESC LIMIT 5)
SELECT * FROM (SELECT * FROM o UNION ALL SELECT * FROM u) a
ORDER BY ts DESC, type, ref_id DESC LIMIT 5
"""


@register("activity_feed", covers=("U1", "L1", "L3", "U2"), sql=FEED_SQL)
def activity_feed(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.activity_feed(mk.orders, mk.signups, 5)
