"""Catalogue and order-view queries: P1-P3, P6, P8-P10, P16, P17, P21,
P22, J2, J3, K1, L2, L5."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import catalogue as cat
from larder.operators import orders as ordv
from larder.operators.supplier import supplier_orders
from larder.plans.registry import register
from larder.plans.sql_binding import with_views
from larder.sources.binding import Marketplace

SELL = "CAST(ROUND(CAST(COALESCE(p.base_price, p.price) AS DECIMAL(18,2)) * CAST(1.15 AS DECIMAL(20,10)), 2) AS DOUBLE)"
LABEL = ("CASE WHEN p.stock = 0 THEN 'Out of Stock' WHEN p.stock < 50 THEN 'Low Stock' "
         "ELSE 'In Stock' END")
BUYER_COLS = f"""p.product_id, p.name, p.category, p.stock, p.is_active, p.supplier_id, p.brand,
       s.name AS supplier_name, {SELL} AS selling_price, {SELL} AS marketplace_price,
       {LABEL} AS stock_status, {SELL} AS display_price"""


def _visible(spark, sf_dir, **kw):
    mk = Marketplace(spark, sf_dir)
    v = cat.visible_products(mk.products, mk.suppliers, **kw)
    return cat.role_view(cat.priced(v), kw.get("role"))


BUYER_SQL = with_views("b_products", "b_suppliers") + f"""
SELECT {BUYER_COLS}
FROM b_products p LEFT JOIN b_suppliers s ON s.user_id = p.supplier_id
WHERE p.is_active AND s.verification_status = 'approved'
"""


@register("catalogue_buyer_view", covers=("P16", "P8", "P9", "P10", "J2", "P7"), sql=BUYER_SQL)
def catalogue_buyer_view(spark, sf_dir):
    return _visible(spark, sf_dir, role="buyer")


SEARCH_SQL = with_views("b_products", "b_suppliers") + f"""
SELECT {BUYER_COLS}
FROM b_products p LEFT JOIN b_suppliers s ON s.user_id = p.supplier_id
WHERE p.is_active AND s.verification_status = 'approved' AND p.price <= 1500.0
  AND (COALESCE(regexp_matches(p.name, 'bolt', 'i'), false)
       OR COALESCE(regexp_matches(s.name, 'bolt', 'i'), false)
       OR COALESCE(regexp_matches(p.category, 'bolt', 'i'), false))
"""


@register("catalogue_search", covers=("P6", "P1", "P5", "P16"), sql=SEARCH_SQL)
def catalogue_search(spark, sf_dir):
    return _visible(spark, sf_dir, role="buyer", category="All", max_price=1500.0, search="bolt")


SUPPLIER_VIEW_SQL = with_views("b_products", "b_suppliers") + f"""
SELECT p.product_id, p.name, p.category, p.price, p.stock, p.is_active, p.supplier_id, p.brand,
       s.name AS supplier_name, COALESCE(p.base_price, p.price) AS base_price,
       COALESCE(p.base_price, p.price) AS supplier_price, {LABEL} AS stock_status,
       COALESCE(p.base_price, p.price) AS display_price
FROM b_products p LEFT JOIN b_suppliers s ON s.user_id = p.supplier_id
WHERE p.supplier_id = 3
"""


@register("catalogue_own_supplier_view", covers=("P16", "P8"), sql=SUPPLIER_VIEW_SQL)
def catalogue_own_supplier_view(spark, sf_dir):
    return _visible(spark, sf_dir, role="supplier", requester_id=3, supplier_id=3)


UNAPPROVED_SQL = with_views("b_products", "b_suppliers") + f"""
SELECT {BUYER_COLS}
FROM b_products p LEFT JOIN b_suppliers s ON s.user_id = p.supplier_id
WHERE p.is_active AND p.supplier_id = 4 AND s.verification_status = 'approved'
"""


@register("catalogue_unapproved_supplier", covers=("P16",), sql=UNAPPROVED_SQL)
def catalogue_unapproved_supplier(spark, sf_dir):
    return _visible(spark, sf_dir, role="buyer", supplier_id=4)


PAGE_SQL = BUYER_SQL + "ORDER BY p.product_id DESC LIMIT 20 OFFSET 20\n"


@register("catalogue_page", covers=("L2",), sql=PAGE_SQL)
def catalogue_page(spark, sf_dir):
    return cat.page(_visible(spark, sf_dir, role="buyer"), [F.desc("product_id")], 2, 20, cat.MAX_PAGE_SIZE)


PAGE_INFO_SQL = f"""SELECT total, 2 AS page, CAST(ceil(total / 20.0) AS BIGINT) AS pages
FROM (SELECT COUNT(*) AS total FROM ({BUYER_SQL}) v) t
"""


@register("catalogue_page_info", covers=("L2",), sql=PAGE_INFO_SQL)
def catalogue_page_info(spark, sf_dir):
    return cat.page_info(_visible(spark, sf_dir, role="buyer"), 20, 2, cat.MAX_PAGE_SIZE)


CHEAP_SQL = with_views("b_products") + """
SELECT * FROM b_products WHERE stock > 0 ORDER BY price, product_id LIMIT 10
"""


@register("cheapest_in_stock", covers=("L5",), sql=CHEAP_SQL)
def cheapest_in_stock(spark, sf_dir):
    return cat.cheapest_in_stock(Marketplace(spark, sf_dir).products, 10)


_PAIR_SQL = """
, pairs AS (
    SELECT l_orderkey AS order_id, l_suppkey AS supplier_id,
           SUM(CAST(COALESCE(CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_extendedprice / l_quantity / 1.15 END,
                             l_extendedprice / l_quantity) * l_quantity AS DECIMAL(18,2))) AS subtotal
    FROM lineitem GROUP BY l_orderkey, l_suppkey)
, ps AS (
    SELECT p.supplier_id, p.order_id, o.order_date, o.status AS order_status, e.status AS entry_status,
           COALESCE(e.status, o.status) AS status, CAST(p.subtotal AS DOUBLE) AS total
    FROM pairs p JOIN b_orders o ON o.order_id = p.order_id
    LEFT JOIN b_entries e ON e.order_id = p.order_id AND e.supplier_id = p.supplier_id)
"""

SUP_LIST_SQL = with_views("b_orders", "b_entries") + _PAIR_SQL + """
SELECT supplier_id, order_id, order_date, status, total FROM ps
WHERE order_status <> 'Pending Payment Verification'
"""


@register("supplier_order_list", covers=("P2", "P21", "A9"), sql=SUP_LIST_SQL)
def supplier_order_list(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return ordv.supplier_order_list(supplier_orders(mk.order_items, mk.orders))


SUP_DELIVERED_SQL = with_views("b_orders", "b_entries") + _PAIR_SQL + """
SELECT supplier_id, order_id, order_date, status, total FROM ps
WHERE order_status <> 'Pending Payment Verification' AND entry_status = 'Delivered'
"""


@register("supplier_orders_delivered", covers=("P3", "P2"), sql=SUP_DELIVERED_SQL)
def supplier_orders_delivered(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return ordv.supplier_order_list(supplier_orders(mk.order_items, mk.orders), "Delivered")


SUP_ITEMS_SQL = with_views("b_orders", "b_items") + """
SELECT supplier_id, order_id, line_no, product_id, quantity, COALESCE(supplier_price, price) AS price
FROM b_items
WHERE order_id IN (SELECT order_id FROM b_orders WHERE status <> 'Pending Payment Verification')
"""


@register("supplier_order_items", covers=("P21", "P4"), sql=SUP_ITEMS_SQL)
def supplier_order_items(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return ordv.supplier_order_items(mk.order_items, mk.orders)


BUYER_ITEMS_SQL = with_views("b_orders", "b_items") + """
SELECT o.buyer_id, i.order_id, i.line_no, i.product_id, i.supplier_id, i.quantity, i.price, i.marketplace_price
FROM b_items i JOIN b_orders o ON o.order_id = i.order_id
"""


@register("buyer_order_items", covers=("P22", "J1"), sql=BUYER_ITEMS_SQL)
def buyer_order_items(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return ordv.buyer_order_items(mk.order_items, mk.orders)


def _access_requests(mk: Marketplace):
    e = mk.raw("events").where(F.col("event_type") == "view")
    u = F.col("user_id")
    role = F.when(F.pmod(u, F.lit(3)) == 0, "supplier").when(F.pmod(u, F.lit(3)) == 1, "buyer").otherwise("admin")
    return e.select(F.col("event_id").alias("request_id"), "user_id", role.alias("role"),
                    (F.col("event_id") * 2).alias("order_id"))


ACCESS_SQL = with_views("b_orders") + """
, req AS (
    SELECT event_id AS request_id, user_id,
           CASE user_id % 3 WHEN 0 THEN 'supplier' WHEN 1 THEN 'buyer' ELSE 'admin' END AS role,
           event_id * 2 AS order_id
    FROM events WHERE event_type = 'view')
SELECT r.request_id, r.user_id, r.role, r.order_id,
       CASE WHEN o.order_id IS NULL THEN 'not_found'
            WHEN r.role = 'admin' THEN 'ok'
            WHEN r.role = 'buyer' THEN CASE WHEN o.buyer_id = r.user_id THEN 'ok' ELSE 'forbidden' END
            WHEN NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = r.order_id AND l.l_suppkey = r.user_id)
                 THEN 'forbidden'
            WHEN o.status = 'Pending Payment Verification' THEN 'forbidden'
            ELSE 'ok' END AS decision
FROM req r LEFT JOIN b_orders o ON o.order_id = r.order_id
"""


@register("order_access", covers=("P17", "P2", "P4"), sql=ACCESS_SQL)
def order_access(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return ordv.access_decisions(_access_requests(mk), mk.orders, mk.order_items)


CHECKOUT_SQL = with_views("b_orders", "b_products") + """
, lines AS (
    SELECT l.l_orderkey AS cart_id, l.l_suppkey AS supplier_id, l.l_quantity AS quantity,
           CASE WHEN p.product_id IS NOT NULL
                THEN CAST(ROUND(CAST(p.base_price AS DECIMAL(18,2)) * CAST(1.15 AS DECIMAL(20,10)), 2) AS DOUBLE)
                ELSE l.l_extendedprice / l.l_quantity END AS mp
    FROM lineitem l LEFT JOIN b_products p ON p.product_id = l.l_partkey)
, per AS (
    SELECT cart_id, SUM(CAST(mp AS DECIMAL(18,2)) * CAST(quantity AS DECIMAL(18,4))) AS raw_total,
           COUNT(DISTINCT supplier_id) AS supplier_count, COUNT(*) AS item_count
    FROM lines GROUP BY cart_id)
SELECT o.order_id AS cart_id, o.buyer_id, o.payment_method,
       CAST(ROUND(per.raw_total, 2) AS DOUBLE) AS total, per.supplier_count, per.item_count,
       CASE WHEN o.payment_method = 'bank' THEN 'Pending Payment Verification' ELSE 'Pending' END AS status,
       CASE WHEN o.payment_method = 'bank' THEN 'Pending Verification' ELSE 'Approved' END AS payment_status
FROM b_orders o JOIN per ON per.cart_id = o.order_id
"""


@register("checkout_pricing", covers=("K1", "J3", "P9", "U4"), sql=CHECKOUT_SQL)
def checkout_pricing(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    cart = mk.order_items.select(F.col("order_id").alias("cart_id"), "line_no", "product_id", "quantity",
                                 F.col("price").alias("given_price"), "supplier_id")
    carts = mk.orders.select(F.col("order_id").alias("cart_id"), "buyer_id", "payment_method")
    return ordv.checkout_pricing(cart, mk.products, carts)
