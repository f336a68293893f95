"""Billing queries: A21 credit position, K2 admission, K3 invoices, K4
payments, K5 credit increases."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import billing as op
from larder.plans.registry import register
from larder.plans.sql_binding import with_views
from larder.sources.binding import Marketplace

POSITION_SQL = with_views("b_invoices", "b_buyers") + """
, per AS (
    SELECT buyer_id,
           SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE status IN ('Unpaid', 'Overdue')) AS out,
           MIN(due_date) FILTER (WHERE status IN ('Unpaid', 'Overdue')) AS next_due,
           COUNT(*) AS invoice_count
    FROM b_invoices GROUP BY buyer_id)
, b AS (
    SELECT user_id AS buyer_id,
           CAST(CASE WHEN credit_limit IS NULL OR credit_limit = 0 OR isnan(credit_limit) THEN 100000.0
                     ELSE credit_limit END AS DOUBLE) AS credit_limit
    FROM b_buyers)
SELECT b.buyer_id, b.credit_limit,
       CAST(COALESCE(per.out, 0) AS DOUBLE) AS outstanding,
       GREATEST(CAST(0.0 AS DOUBLE), b.credit_limit - CAST(COALESCE(per.out, 0) AS DOUBLE)) AS available_credit,
       COALESCE(strftime(per.next_due, '%B %-d, %Y'), 'July 10, 2026') AS next_payment_date,
       COALESCE(per.invoice_count, 0) AS invoice_count
FROM b LEFT JOIN per ON per.buyer_id = b.buyer_id
"""


@register("credit_position", covers=("A21", "F10", "F12", "J1"), sql=POSITION_SQL)
def credit_position(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.credit_position(mk.invoices, mk.buyers)


def _net30(mk: Marketplace):
    return mk.orders.where(F.col("payment_method") == "net30")


ADMISSION_SQL = with_views("b_orders", "b_buyers", "b_invoices") + """
, already AS (
    SELECT i.buyer_id, CAST(SUM(CAST(i.amount AS DECIMAL(18,2))) * 100 AS BIGINT) AS cents
    FROM b_invoices i JOIN b_orders o ON o.order_id = i.order_id
    WHERE i.status IN ('Unpaid', 'Overdue') AND o.payment_method <> 'net30'
    GROUP BY i.buyer_id)
, net AS (
    SELECT o.order_id, o.buyer_id, o.created_at,
           CAST(CAST(o.total AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents,
           CAST(CAST(CASE WHEN b.credit_limit IS NULL OR b.credit_limit = 0 THEN 100000.0
                          ELSE b.credit_limit END AS DECIMAL(18,2)) * 100 AS BIGINT) AS lim,
           COALESCE(a.cents, 0) AS start_at,
           ROW_NUMBER() OVER (PARTITION BY o.buyer_id ORDER BY o.created_at, o.order_id) AS rn
    FROM b_orders o LEFT JOIN b_buyers b ON b.user_id = o.buyer_id
    LEFT JOIN already a ON a.buyer_id = o.buyer_id
    WHERE o.payment_method = 'net30')
, fold AS (
    SELECT buyer_id, rn, order_id, created_at, cents, lim,
           start_at + cents <= lim AS accepted,
           CASE WHEN start_at + cents <= lim THEN start_at + cents ELSE start_at END AS open_after
    FROM net WHERE rn = 1
    UNION ALL
    SELECT n.buyer_id, n.rn, n.order_id, n.created_at, n.cents, n.lim,
           f.open_after + n.cents <= n.lim,
           CASE WHEN f.open_after + n.cents <= n.lim THEN f.open_after + n.cents ELSE f.open_after END
    FROM fold f JOIN net n ON n.buyer_id = f.buyer_id AND n.rn = f.rn + 1)
SELECT order_id, buyer_id, created_at, CAST(cents AS DOUBLE) / 100.0 AS total,
       CAST(lim AS DOUBLE) / 100.0 AS credit_limit, accepted,
       CAST(open_after AS DOUBLE) / 100.0 AS outstanding_after
FROM fold
"""
ADMISSION_SQL = "WITH RECURSIVE " + ADMISSION_SQL[len("WITH "):]


@register("credit_admission", covers=("K2", "K1"), sql=ADMISSION_SQL)
def credit_admission(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.credit_admission(_net30(mk), mk.buyers, mk.invoices)


INVOICES_SQL = ADMISSION_SQL.replace("""SELECT order_id, buyer_id, created_at, CAST(cents AS DOUBLE) / 100.0 AS total,
       CAST(lim AS DOUBLE) / 100.0 AS credit_limit, accepted,
       CAST(open_after AS DOUBLE) / 100.0 AS outstanding_after
FROM fold""", """SELECT 'INV-' || lpad(CAST(f.order_id AS VARCHAR), 10, '0') AS invoice_number,
       f.order_id, f.buyer_id, o.total AS amount, 'Unpaid' AS status,
       o.order_date AS issue_date, CAST(o.order_date + INTERVAL 30 DAY AS DATE) AS due_date
FROM fold f JOIN b_orders o ON o.order_id = f.order_id
WHERE f.accepted""")


@register("net30_invoices", covers=("K3", "S9"), sql=INVOICES_SQL)
def net30_invoices(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    adm = op.credit_admission(_net30(mk), mk.buyers, mk.invoices).where("accepted").select("order_id")
    accepted = mk.orders.join(adm, "order_id", "left_semi")
    return op.issue_invoices(accepted)


PAY_SQL = with_views("b_invoices", "b_payment_requests") + """
, j AS (
    SELECT r.request_id, r.invoice_id, r.user_id, i.invoice_id AS found, i.buyer_id, i.status,
           COUNT(*) FILTER (WHERE i.buyer_id = r.user_id) OVER (
               PARTITION BY r.invoice_id ORDER BY r.requested_at, r.request_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own_before
    FROM b_payment_requests r LEFT JOIN b_invoices i ON i.invoice_id = r.invoice_id)
SELECT request_id, invoice_id, user_id,
       CASE WHEN found IS NULL THEN 'not_found'
            WHEN buyer_id <> user_id THEN 'forbidden'
            WHEN status = 'Paid' OR own_before > 0 THEN 'already_paid' ELSE 'paid' END AS outcome,
       CASE WHEN found IS NULL THEN NULL
            WHEN buyer_id = user_id OR own_before > 0 THEN 'Paid' ELSE status END AS status_after
FROM j
"""


@register("invoice_payments", covers=("K4", "P17"), sql=PAY_SQL)
def invoice_payments(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.pay_invoices(mk.payment_requests, mk.invoices)


CREDIT_SQL = with_views("b_credit_requests", "b_buyers") + """
SELECT r.request_id, r.user_id, r.requested_at, r.target,
       GREATEST(COALESCE(b.credit_limit, 0.0),
                COALESCE(MAX(r.target) OVER (PARTITION BY r.user_id ORDER BY r.requested_at, r.request_id
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS limit_before,
       r.target > GREATEST(COALESCE(b.credit_limit, 0.0),
                COALESCE(MAX(r.target) OVER (PARTITION BY r.user_id ORDER BY r.requested_at, r.request_id
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS accepted
FROM b_credit_requests r LEFT JOIN b_buyers b ON b.user_id = r.user_id
"""


@register("credit_increases", covers=("K5",), sql=CREDIT_SQL)
def credit_increases(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return op.credit_increases(mk.credit_requests, mk.buyers)
