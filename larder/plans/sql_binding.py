"""The marketplace binding restated in plain SQL (DuckDB dialect).

Used only by the correctness oracle: every oracle query starts with
``with_views(...)`` and then states the operator independently of the
DataFrame code. The entry of a (order, supplier) pair, for example, is a
ROW_NUMBER here but a ``min(struct)`` aggregate in Spark.
"""

from __future__ import annotations

_FOOD = "'Fish', 'Meat', 'Vegetables', 'Fruit', 'Dairy', 'Spices', 'Seafood', 'Poultry'"
_CATEGORIES = "'fish', 'meat', 'vegetables', 'fruit', 'dairy', 'spices', 'seafood', 'poultry', 'greens', 'produce'"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "b_orders": ((), """
        SELECT o_orderkey AS order_id, o_custkey AS buyer_id,
               CAST(o_orderdate AS DATE) AS order_date, o_orderdate AS created_at,
               o_totalprice AS total,
               CASE WHEN o_orderstatus = 'F' THEN 'Delivered'
                    WHEN o_orderstatus = 'O' THEN 'In Transit'
                    WHEN o_orderpriority = '5-LOW' THEN 'Cancelled'
                    WHEN o_orderpriority = '1-URGENT' THEN 'Pending Payment Verification'
                    ELSE 'Pending' END AS status,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'Pending Verification'
                    WHEN o_orderpriority = '2-HIGH' THEN 'Rejected'
                    ELSE 'Approved' END AS payment_status,
               CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'net30'
                    WHEN o_orderpriority = '1-URGENT' THEN 'bank' ELSE 'card' END AS payment_method
        FROM orders"""),
    "b_items": ((), """
        SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id,
               l_suppkey AS supplier_id, l_quantity AS quantity,
               l_extendedprice / l_quantity AS price,
               CASE WHEN l_returnflag = 'N' THEN NULL
                    ELSE l_extendedprice / l_quantity / 1.15 END AS supplier_price,
               l_extendedprice / l_quantity AS marketplace_price,
               CAST(l_shipdate AS DATE) AS ship_date
        FROM lineitem"""),
    "b_entries": ((), """
        SELECT order_id, supplier_id,
               CASE WHEN l_linestatus = 'F' THEN 'Delivered'
                    WHEN l_returnflag = 'R' THEN 'Cancelled'
                    WHEN l_returnflag = 'A' THEN 'In Transit'
                    ELSE 'Pending' END AS status
        FROM (SELECT l_orderkey AS order_id, l_suppkey AS supplier_id, l_linestatus, l_returnflag,
                     ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_suppkey
                                        ORDER BY l_linenumber, l_linestatus, l_returnflag) AS rn
              FROM lineitem WHERE l_suppkey % 10 <> 0) t
        WHERE rn = 1"""),
    "b_suppliers": ((), """
        SELECT s_suppkey AS user_id, s_name AS name,
               CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE replace(s_name, 'Supplier#', 'Company #') END AS company,
               CASE WHEN s_suppkey % 4 <> 0 THEN 'approved'
                    WHEN s_suppkey % 8 = 0 THEN 'rejected' ELSE 'pending' END AS verification_status,
               (s_suppkey % 4 <> 0) AS is_verified
        FROM supplier"""),
    "b_buyers": ((), """
        SELECT c_custkey AS user_id, c_name AS name, n_name AS city,
               CAST(CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 1000000 END AS DOUBLE) AS credit_limit
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""),
    "b_products": ((), """
        SELECT p_partkey AS product_id, p_name AS name, p_type AS category,
               p_retailprice AS price, p_retailprice AS base_price,
               (p_size - 1) * 2 AS stock, (p_size % 10 <> 0) AS is_active,
               p_partkey % (SELECT COUNT(*) FROM supplier) AS supplier_id, p_brand AS brand
        FROM part"""),
    "b_reviews": ((), """
        SELECT event_id AS review_id, user_id, 'User ' || CAST(user_id AS VARCHAR) AS user_name,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 50 END AS product_id,
               CAST(event_id % 5 + 1 AS INTEGER) AS rating,
               CASE event_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' ELSE 'rejected' END AS status,
               (event_id % 7 = 0) AS featured, ts AS created_at
        FROM events WHERE event_type = 'purchase'"""),
    "b_notifications": ((), """
        SELECT event_id AS notification_id, user_id,
               CASE event_type WHEN 'purchase' THEN 'payout' WHEN 'click' THEN 'order'
                               WHEN 'view' THEN 'stock' ELSE 'system' END AS type,
               upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) AS title,
               (event_type = 'view') AS read, ts AS created_at
        FROM events"""),
    "b_invoices": ((), """
        SELECT o_orderkey AS invoice_id, o_orderkey AS order_id, o_custkey AS buyer_id,
               o_totalprice AS amount,
               CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Unpaid' ELSE 'Overdue' END AS status,
               CAST(o_orderdate AS DATE) AS issue_date,
               CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS due_date
        FROM orders"""),
    "b_demand": ((), """
        SELECT CAST(l_shipdate AS DATE) AS date, l_partkey AS product_id, p_name AS product_name,
               p_type AS category, l_quantity AS quantity_sold,
               l_extendedprice / l_quantity AS price,
               (2 * CAST(round(l_extendedprice * 100) AS BIGINT) * 10000 + CAST(l_quantity AS BIGINT))
                   // (2 * CAST(l_quantity AS BIGINT)) AS price_micros,
               CASE dayofyear(l_shipdate) % 3 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Rainy' ELSE 'Cloudy' END
                   AS weather_condition,
               CAST(dayofyear(l_shipdate) % 10 = 0 AS INTEGER) AS is_holiday,
               l_orderkey AS order_id, l_linenumber AS line_no, l_suppkey AS supplier_id
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "b_signups": ((), """
        SELECT user_id, ts AS created_at, event_id FROM events WHERE event_type = 'signup'"""),
    "b_payment_requests": ((), """
        SELECT event_id AS request_id, event_id AS invoice_id, user_id, ts AS requested_at
        FROM events WHERE event_type = 'click'"""),
    "b_credit_requests": ((), """
        SELECT event_id AS request_id, user_id, ts AS requested_at,
               CAST(1000000.0 AS DOUBLE) + value * CAST(10000.0 AS DOUBLE) AS target
        FROM events WHERE event_type = 'error'"""),
    "b_chat_products": ((), f"""
        SELECT p_partkey AS product_id, p_name || ' ' || lower([{_FOOD}][p_partkey % 8 + 1]) AS name,
               [{_FOOD}][p_partkey % 8 + 1] AS category, p_retailprice AS price, p_retailprice AS base_price,
               (p_size - 1) * 2 AS stock, (p_size % 10 <> 0) AS is_active,
               p_partkey % (SELECT COUNT(*) FROM supplier) AS supplier_id, p_brand AS brand
        FROM part"""),
    "b_chat_requests": (("b_chat_products",), f"""
        SELECT event_id AS conv_id, CAST(0 AS BIGINT) AS turn,
               CASE WHEN event_id % 3 = 0 THEN NULL WHEN q IN (0, 3) THEN o_custkey ELSE user_id END AS user_id,
               CASE q WHEN 0 THEN 'status of order ' || lpad(CAST(o AS VARCHAR), 24, '0')
                      WHEN 1 THEN 'status of order ' || lpad(CAST(o AS VARCHAR), 24, '0')
                      WHEN 2 THEN 'track order ' || lpad(CAST(o + 1000000000 AS VARCHAR), 24, '0')
                      WHEN 3 THEN 'order ' || lpad(CAST(o AS VARCHAR), 8, '0') WHEN 4 THEN 'track my orders'
                      WHEN 5 THEN 'price of ' || product WHEN 6 THEN 'is there any ' || string_split(product, ' ')[1]
                      WHEN 7 THEN 'price of unobtainium' WHEN 8 THEN 'how much'
                      WHEN 9 THEN 'show me ' || [{_CATEGORIES}][event_id % 10 + 1] || ' products' WHEN 10 THEN 'any unread notifications?'
                      WHEN 11 THEN 'what do clients say?' WHEN 12 THEN 'help me' ELSE 'zzz ' || string_split(product, ' ')[1] END AS message
        FROM (SELECT event_id, user_id, (event_id // 3) % 14 AS q, event_id % (SELECT COUNT(*) FROM orders) AS o,
                     event_id % (SELECT COUNT(*) FROM part) AS p FROM events WHERE event_type = 'click') e
        LEFT JOIN orders ON o_orderkey = o
        LEFT JOIN (SELECT product_id, COALESCE(name, 'anything') AS product FROM b_chat_products) cp ON product_id = p"""),
    "b_messages": (("b_chat_requests",), """
        SELECT conv_id, turn, text AS message FROM conversations WHERE role = 'user'
        UNION ALL
        SELECT -1 - conv_id, turn, message FROM b_chat_requests"""),
}


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named binding views (dependencies first)."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        deps, _ = VIEWS[n]
        for d in deps:
            visit(d)
        ordered.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n][1].strip()})" for n in ordered]
    return "WITH " + ",\n".join(parts) + "\n"
