"""Supplier analytics queries (A8-A12) over the bound driver tables."""

from __future__ import annotations

from larder.operators import supplier as op
from larder.plans.registry import register
from larder.plans.sql_binding import with_views
from larder.plans.sqlfrag import LINE_VALUE, ratio
from larder.sources.binding import AS_OF, Marketplace

# Per (order, supplier) pairs restated in SQL: subtotal from lineitem, status
# from the entry (ROW_NUMBER) or else the order.
_PAIRS = f"""
, pairs AS (
    SELECT l_orderkey AS order_id, l_suppkey AS supplier_id, SUM({LINE_VALUE}) AS subtotal
    FROM lineitem GROUP BY l_orderkey, l_suppkey)
, ps AS (
    SELECT p.order_id, p.supplier_id, p.subtotal, o.order_date, o.payment_status,
           COALESCE(e.status, o.status) AS st
    FROM pairs p JOIN b_orders o ON o.order_id = p.order_id
    LEFT JOIN b_entries e ON e.order_id = p.order_id AND e.supplier_id = p.supplier_id)
"""

_EARN = """
, earn AS (
    SELECT supplier_id, order_id, order_date, subtotal,
           ROUND(subtotal * 0.10, 2) AS fee_d,
           subtotal - ROUND(subtotal * 0.10, 2) AS net_d,
           CASE WHEN st = 'Delivered' AND payment_status = 'Approved' THEN 'Paid'
                WHEN st = 'Delivered' THEN 'Available'
                WHEN st = 'Cancelled' THEN 'Cancelled' ELSE 'Pending' END AS earnings_status
    FROM ps)
"""


def _pairs(mk: Marketplace):
    return op.supplier_orders(mk.order_items, mk.orders)


SUMMARY_SQL = with_views("b_orders", "b_entries", "b_products") + _PAIRS + f"""
, agg AS (
    SELECT supplier_id, COUNT(*) AS total_orders,
           COUNT(*) FILTER (WHERE st = 'Delivered') AS delivered_orders,
           SUM(subtotal) FILTER (WHERE st = 'Delivered') AS revenue,
           SUM(subtotal) AS value_sum
    FROM ps GROUP BY supplier_id)
, low AS (
    SELECT supplier_id, COUNT(*) FILTER (WHERE stock > 0 AND stock < 50) AS low_stock_count
    FROM b_products GROUP BY supplier_id)
SELECT s.s_suppkey AS supplier_id,
       CAST(COALESCE(a.revenue, 0) AS DOUBLE) AS total_revenue,
       COALESCE(a.total_orders, 0) AS total_orders,
       COALESCE(a.delivered_orders, 0) AS delivered_orders,
       {ratio('a.delivered_orders', 'a.total_orders', 100.0, 1)} AS fulfillment_rate,
       {ratio('a.value_sum', 'a.total_orders', 1.0, 2)} AS avg_order_value,
       COALESCE(l.low_stock_count, 0) AS low_stock_count
FROM supplier s
LEFT JOIN agg a ON a.supplier_id = s.s_suppkey
LEFT JOIN low l ON l.supplier_id = s.s_suppkey
"""


@register("supplier_summary", covers=("A8", "A9", "S1", "P4", "P10"), sql=SUMMARY_SQL)
def supplier_summary(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.supplier_summary(_pairs(mk), mk.products, mk.suppliers)


CHART_SQL = with_views("b_orders", "b_entries") + f"""
, pairs AS (
    SELECT l_orderkey AS order_id, l_suppkey AS supplier_id, SUM({LINE_VALUE}) AS subtotal
    FROM lineitem GROUP BY l_orderkey, l_suppkey)
, ps AS (
    SELECT p.supplier_id, p.subtotal, o.order_date, COALESCE(e.status, o.status) AS st
    FROM pairs p JOIN b_orders o ON o.order_id = p.order_id
    LEFT JOIN b_entries e ON e.order_id = p.order_id AND e.supplier_id = p.supplier_id
    WHERE o.order_date >= CAST(date_trunc('month', DATE '{AS_OF}' - INTERVAL 5 MONTH) AS DATE))
SELECT supplier_id, CAST(year(order_date) AS INTEGER) AS year,
       CAST(month(order_date) AS INTEGER) AS month_num,
       CAST(SUM(subtotal) AS DOUBLE) AS revenue, COUNT(*) AS orders,
       strftime(make_date(CAST(year(order_date) AS INTEGER), CAST(month(order_date) AS INTEGER), 1), '%b') AS month
FROM ps WHERE st = 'Delivered'
GROUP BY supplier_id, year(order_date), month(order_date)
"""


@register("supplier_monthly_chart", covers=("A10", "F9", "F10"), sql=CHART_SQL)
def supplier_monthly_chart(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.supplier_monthly_chart(mk.order_items, mk.orders, AS_OF, 5)


BREAKDOWN_SQL = with_views("b_orders", "b_entries") + _PAIRS + _EARN + """
SELECT supplier_id, order_id, order_date,
       upper(right(CAST(order_id AS VARCHAR), 8)) AS order_label,
       strftime(order_date, '%d %b %Y') AS date_label,
       CAST(subtotal AS DOUBLE) AS amount, CAST(fee_d AS DOUBLE) AS fee,
       CAST(net_d AS DOUBLE) AS net, earnings_status
FROM earn WHERE earnings_status <> 'Cancelled'
"""


@register("supplier_earnings_breakdown", covers=("A11", "F2", "F5", "F7"), sql=BREAKDOWN_SQL)
def supplier_earnings_breakdown(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.earnings_breakdown(op.supplier_earnings(_pairs(mk)))


TOTALS_SQL = with_views("b_orders", "b_entries") + _PAIRS + _EARN + """
SELECT supplier_id,
       CAST(COALESCE(SUM(net_d) FILTER (WHERE earnings_status IN ('Paid', 'Available')), 0) AS DOUBLE) AS total_earned,
       CAST(COALESCE(SUM(net_d) FILTER (WHERE earnings_status = 'Pending'), 0) AS DOUBLE) AS pending_payout,
       CAST(COALESCE(SUM(net_d) FILTER (WHERE earnings_status = 'Available'), 0) AS DOUBLE) AS available_payout,
       CAST(COALESCE(SUM(net_d) FILTER (WHERE earnings_status = 'Paid'), 0) AS DOUBLE) AS completed_payout
FROM earn GROUP BY supplier_id
"""


@register("supplier_earnings_totals", covers=("A11",), sql=TOTALS_SQL)
def supplier_earnings_totals(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.earnings_totals(op.supplier_earnings(_pairs(mk)))


PAYOUTS_SQL = with_views("b_orders", "b_entries") + _PAIRS + _EARN + """
SELECT supplier_id,
       'PAY-' || CAST(year(order_date) AS VARCHAR) || '-' || CAST(month(order_date) - 1 AS VARCHAR) AS payout_id,
       CAST(SUM(net_d) AS DOUBLE) AS amount, MAX(order_date) AS payout_date,
       'Direct Deposit' AS method, 'Completed' AS status
FROM earn WHERE earnings_status = 'Paid'
GROUP BY supplier_id, year(order_date), month(order_date)
"""


@register("supplier_payouts", covers=("A12",), sql=PAYOUTS_SQL)
def supplier_payouts(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.supplier_payouts(op.supplier_earnings(_pairs(mk)))
