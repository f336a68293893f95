"""Chat queries: T1-T4 over user turns of ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import chat as op
from larder.plans.registry import register
from larder.plans.sql_binding import with_views
from larder.sources.binding import Marketplace


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _has(words, m="m") -> str:
    return "(" + " OR ".join(f"contains({m}, {_q(w)})" for w in words) + ")"


def _tail(phrases, m="m") -> str:
    expr = "NULL"
    for p in reversed(phrases):
        pos = f"instr({m}, {_q(p)})"
        tail = (f"regexp_replace(regexp_replace(regexp_replace(substring({m}, {pos} + {len(p)}, 1073741824), "
                r"'^\s+|\s+$', '', 'g'), '[?.!,]', '', 'g'), '^\s+|\s+$', '', 'g')")
        expr = f"CASE WHEN {pos} > 0 AND length({tail}) > 1 THEN {tail} ELSE {expr} END"
    return expr


def _hex(pattern: str, col="message") -> str:
    x = f"regexp_extract({col}, '(^|[^A-Za-z0-9_])({pattern})([^A-Za-z0-9_]|$)', 2)"
    return f"CASE WHEN {x} <> '' THEN {x} END"


def _category(m="m") -> str:
    expr = "NULL"
    for c in reversed(op.CATEGORIES):
        words = [c] + (op.VEG_FORMS if c == "vegetables" else [])
        expr = f"CASE WHEN {_has(words, m)} THEN {_q(c)} ELSE {expr} END"
    return expr


def intents_sql() -> str:
    cats = ", ".join(_q(c) for c in op.CATEGORIES)
    skip = ", ".join(_q(w) for w in op.SKIP_WORDS)
    oid = f"COALESCE({_hex(op.LONG_ID)}, CASE WHEN {_has(op.ORDER_ID_HINTS)} THEN {_hex(op.SHORT_ID)} END)"
    names = op.INTENT_ORDER
    s = [f"s{i}" for i in range(7)]
    best = f"GREATEST({', '.join(s)})"
    intent = _q(names[-1])
    for i in reversed(range(7)):
        intent = f"CASE WHEN {s[i]} = {best} THEN {_q(names[i])} ELSE {intent} END"
    return with_views("b_messages") + rf"""
, a AS (
    SELECT conv_id, turn, message, lower(regexp_replace(message, '^\s+|\s+$', '', 'g')) AS m FROM b_messages)
, b AS (
    SELECT conv_id, turn, m, {oid} AS order_id, {_tail(op.PRICE_PHRASES)} AS price_tail,
           {_tail(op.STOCK_PHRASES)} AS stock_tail, {_category()} AS category
    FROM a)
, c AS (
    SELECT *,
        CASE WHEN order_id IS NOT NULL THEN {op.S_ORDER_ID} WHEN {_has(op.ORDER_PHRASES)} THEN {op.S_ORDER_PHRASE}
             WHEN {_has(op.ORDER_KEYWORDS)} THEN {op.S_KEYWORD} ELSE 0.0 END AS s0,
        CASE WHEN price_tail IS NOT NULL THEN {op.S_PHRASE} WHEN {_has(op.PRICE_KEYWORDS)} THEN {op.S_KEYWORD}
             ELSE 0.0 END AS s1,
        CASE WHEN stock_tail IS NOT NULL AND stock_tail NOT IN ({cats}) THEN {op.S_PHRASE}
             WHEN stock_tail IS NOT NULL THEN 0.0
             WHEN {_has(op.STOCK_KEYWORDS)} THEN {op.S_KEYWORD} ELSE 0.0 END AS s2,
        CASE WHEN category IS NULL THEN 0.0 WHEN {_has(op.BROWSE_KEYWORDS)} THEN {op.S_CAT_BROWSE}
             ELSE {op.S_CAT_PLAIN} END AS s3,
        CASE WHEN {_has(op.NOTIFICATION_KEYWORDS)} THEN {op.S_NOTIF} ELSE 0.0 END AS s4,
        CASE WHEN {_has(op.REVIEW_KEYWORDS)} THEN {op.S_REVIEW} ELSE 0.0 END AS s5,
        CASE WHEN {_has(op.HELP_KEYWORDS)} OR {_has(op.GREETING_KEYWORDS)} THEN {op.S_HELP} ELSE 0.0 END AS s6,
        COALESCE(CASE WHEN stock_tail NOT IN ({cats}) THEN stock_tail END, price_tail) AS pn
    FROM b)
, d AS (
    SELECT *, CASE WHEN {best} >= {op.THRESHOLD} THEN {intent} ELSE {_q(names[-1])} END AS intent,
           CAST(CASE WHEN {best} >= {op.THRESHOLD} THEN {best} ELSE {op.FALLBACK_CONFIDENCE} END AS DOUBLE)
               AS confidence
    FROM c)
SELECT conv_id, turn, intent, confidence, order_id, category,
       CASE WHEN intent IN ('PRODUCT_PRICE', 'PRODUCT_STOCK') AND pn IS NULL THEN
            CASE WHEN len(list_filter(string_split_regex(m, '\s+'), lambda w: length(w) > 2 AND NOT list_contains([{skip}], w))) > 0
                 THEN array_to_string(list_filter(string_split_regex(m, '\s+'),
                                                  lambda w: length(w) > 2 AND NOT list_contains([{skip}], w)), ' ') END
            ELSE pn END AS product_name
FROM d
"""


@register("message_intents", covers=("T1", "T2", "T3", "T4", "F1", "F3", "F4", "F13"), sql=intents_sql())
def message_intents(spark, sf_dir):
    msgs = Marketplace(spark, sf_dir).messages
    return op.classify(msgs).select("conv_id", "turn", "intent", "confidence", "order_id", "category",
                                    "product_name")


INTENT_COUNTS_SQL = intents_sql().replace(
    "SELECT conv_id, turn, intent, confidence, order_id, category,", "SELECT intent, COUNT(*) AS messages FROM (SELECT intent,", 1
).rstrip() + ") z GROUP BY intent\n"


@register("intent_counts", covers=("T1", "A2"), sql=INTENT_COUNTS_SQL)
def intent_counts(spark, sf_dir):
    return message_intents(spark, sf_dir).groupBy("intent").agg(F.count(F.lit(1)).alias("messages"))


# ---- look-ups behind the chat intents (T5-T9) -------------------------------

from larder.operators import lookup as lk  # noqa: E402
from larder.session import checkpoint_dir  # noqa: E402
from larder.plans.sql_binding import VIEWS  # noqa: E402,F401

KEY = ["conv_id", "turn"]


def _intents(spark, sf_dir):
    """Classified messages, materialised once in the shared checkpoint
    folder: every look-up branch filters and re-reads this table, and a
    filter on ``intent`` must not be pushed into (and re-evaluate) the rule
    set; the checkpoint also cuts the lineage."""
    checkpoint_dir(spark)
    return op.classify(Marketplace(spark, sf_dir).messages).checkpoint(eager=True)


def _with_intents(*views: str) -> str:
    base = with_views(*views) if views else "WITH "
    sep = ", " if views else ""
    return base + sep + "i AS (" + intents_sql() + ")\n"


LOOKUP_SQL = _with_intents("b_chat_products") + r"""
, req AS (SELECT conv_id, turn, product_name FROM i
          WHERE intent IN ('PRODUCT_PRICE', 'PRODUCT_STOCK') AND product_name IS NOT NULL)
, p AS (SELECT product_id, name, price, stock, category FROM b_chat_products)
, exact AS (SELECT r.conv_id, r.turn, MIN(p.product_id) AS pid FROM req r
            JOIN p ON contains(lower(p.name), lower(r.product_name)) AND length(r.product_name) > 0
            GROUP BY r.conv_id, r.turn)
, words AS (SELECT conv_id, turn, w FROM (
              SELECT conv_id, turn, unnest(string_split_regex(product_name, '\s+')) AS w FROM req) t
            WHERE length(w) > 2)
, byword AS (SELECT w.conv_id, w.turn, MIN(p.product_id) AS pid FROM words w
             JOIN p ON contains(lower(p.name), lower(w.w)) GROUP BY w.conv_id, w.turn)
, hit AS (SELECT r.conv_id, r.turn, p.product_id, p.name, p.price, p.stock, p.category
          FROM req r LEFT JOIN exact e ON e.conv_id = r.conv_id AND e.turn = r.turn
          LEFT JOIN byword b ON b.conv_id = r.conv_id AND b.turn = r.turn
          LEFT JOIN p ON p.product_id = COALESCE(e.pid, b.pid))
, need AS (SELECT * FROM hit WHERE product_id IS NULL OR stock <= 0)
, same AS (SELECT * FROM (
             SELECT n.conv_id, n.turn, q.product_id AS alt_id,
                    ROW_NUMBER() OVER (PARTITION BY n.conv_id, n.turn ORDER BY q.product_id) AS rank
             FROM need n JOIN p q ON q.category = n.category AND q.stock > 0 AND q.product_id <> n.product_id) t
           WHERE rank <= 3)
, nalts AS (SELECT n.conv_id, n.turn, COUNT(s.alt_id) AS na FROM need n
            LEFT JOIN same s ON s.conv_id = n.conv_id AND s.turn = n.turn GROUP BY n.conv_id, n.turn)
, cheap AS (SELECT * FROM (
              SELECT n.conv_id, n.turn, q.product_id AS alt_id, a.na,
                     ROW_NUMBER() OVER (PARTITION BY n.conv_id, n.turn ORDER BY q.price, q.product_id) AS k
              FROM need n JOIN nalts a ON a.conv_id = n.conv_id AND a.turn = n.turn
              JOIN p q ON q.stock > 0 AND (n.product_id IS NULL OR q.product_id <> n.product_id)
              WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.conv_id = n.conv_id AND s.turn = n.turn
                                AND s.alt_id = q.product_id)) t
            WHERE na < 3 AND k <= 5 - na)
, alts AS (SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank, alt_id FROM same
           UNION ALL SELECT conv_id, turn, CAST(na + k AS INTEGER), alt_id FROM cheap)
SELECT conv_id, turn, 'product' AS kind, 0 AS rank, product_id, name, price,
       CASE WHEN stock > 0 THEN stock ELSE 0 END AS stock, category
FROM hit WHERE product_id IS NOT NULL
UNION ALL
SELECT a.conv_id, a.turn, 'alternative', a.rank, p.product_id, p.name, p.price, p.stock, p.category
FROM alts a JOIN p ON p.product_id = a.alt_id
"""


@register("product_lookup", covers=("T5", "U3", "J12", "L5"), sql=LOOKUP_SQL)
def product_lookup(spark, sf_dir):
    msgs = _intents(spark, sf_dir).where(F.col("intent").isin("PRODUCT_PRICE", "PRODUCT_STOCK")
                                         & F.col("product_name").isNotNull())
    return lk.product_lookup(msgs, Marketplace(spark, sf_dir).chat_products, KEY)


CATEGORY_SQL = _with_intents("b_chat_products") + """
, req AS (SELECT conv_id, turn, lower(category) AS word FROM i WHERE intent = 'CATEGORY_SEARCH')
, pat AS (SELECT DISTINCT word, CASE word WHEN 'veg' THEN 'Vegetables' WHEN 'vegetable' THEN 'Vegetables'
                                    WHEN 'seafood' THEN 'Fish|Seafood' WHEN 'fish' THEN 'Fish|Seafood'
                                    ELSE word END AS pat FROM req)
, top AS (SELECT * FROM (
            SELECT pat.word, p.product_id, p.name, p.price, p.stock, p.category,
                   ROW_NUMBER() OVER (PARTITION BY pat.word ORDER BY p.price, p.product_id) AS rank
            FROM pat JOIN b_chat_products p ON p.stock > 0
                 AND (regexp_matches(p.category, pat.pat, 'i') OR contains(lower(p.name), pat.word))) t
          WHERE rank <= 10)
SELECT r.conv_id, r.turn, t.product_id, t.name, t.price, t.stock, t.category, CAST(t.rank AS INTEGER) AS rank
FROM req r JOIN top t ON t.word = r.word
"""


@register("category_products", covers=("T6", "P6"), sql=CATEGORY_SQL)
def category_products(spark, sf_dir):
    msgs = _intents(spark, sf_dir).where(F.col("intent") == "CATEGORY_SEARCH")
    return lk.category_search(msgs, Marketplace(spark, sf_dir).chat_products, KEY)


SEARCH_SQL = _with_intents("b_chat_products", "b_messages") + r"""
, req AS (SELECT i.conv_id, i.turn, m.message FROM i JOIN b_messages m ON m.conv_id = i.conv_id AND m.turn = i.turn
          WHERE i.intent = 'FALLBACK_SEARCH')
, words AS (SELECT DISTINCT conv_id, turn, w FROM (
              SELECT conv_id, turn, unnest(string_split_regex(lower(message), '\s+')) AS w FROM req) t
            WHERE length(w) > 2)
, p AS (SELECT product_id, name, price, stock, category FROM b_chat_products WHERE stock > 0)
, hits AS (SELECT DISTINCT w.conv_id, w.turn, p.product_id FROM words w
           JOIN p ON contains(lower(p.name), w.w) OR contains(lower(p.category), w.w))
, top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, turn ORDER BY product_id) AS rank
                         FROM hits) t WHERE rank <= 5)
, dflt AS (SELECT r.conv_id, r.turn, d.product_id, d.rank FROM req r
           JOIN (SELECT product_id, ROW_NUMBER() OVER (ORDER BY product_id) AS rank FROM p
                 ORDER BY product_id LIMIT 5) d ON TRUE
           WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.conv_id = r.conv_id AND t.turn = r.turn))
SELECT x.conv_id, x.turn, CAST(x.rank AS INTEGER) AS rank, p.product_id, p.name, p.price, p.stock, p.category
FROM (SELECT conv_id, turn, rank, product_id FROM top UNION ALL SELECT conv_id, turn, rank, product_id FROM dflt) x
JOIN p ON p.product_id = x.product_id
"""


@register("search_results", covers=("T7", "U5", "F4"), sql=SEARCH_SQL)
def search_results(spark, sf_dir):
    msgs = _intents(spark, sf_dir).where(F.col("intent") == "FALLBACK_SEARCH")
    return lk.search_fallback(msgs, Marketplace(spark, sf_dir).chat_products, KEY, "message")


TIMELINE_SQL = with_views("b_orders") + """
, steps AS (
    SELECT order_id, 1 AS ord, 'Pending' AS step_status, 'Order Placed' AS label, TRUE AS completed, FALSE AS error
    FROM b_orders
    UNION ALL
    SELECT order_id, 2, 'Pending Payment Verification',
           CASE WHEN payment_status = 'Rejected' THEN 'Payment Rejected'
                WHEN payment_status = 'Approved' THEN 'Payment Verified' ELSE 'Awaiting Payment Verification' END,
           payment_status = 'Approved', payment_status = 'Rejected'
    FROM b_orders WHERE payment_method = 'bank'
    UNION ALL
    SELECT order_id, 3, 'In Transit', 'In Transit', status IN ('In Transit', 'Delivered'), FALSE FROM b_orders
    UNION ALL
    SELECT order_id, 4, 'Delivered', 'Delivered', status = 'Delivered', FALSE FROM b_orders
    UNION ALL
    SELECT order_id, 5, 'Cancelled', 'Order Cancelled', TRUE, TRUE FROM b_orders WHERE status = 'Cancelled')
SELECT order_id, CAST(ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY ord) AS INTEGER) AS step,
       step_status, label, completed, error
FROM steps
"""


@register("order_timeline", covers=("T8", "F13"), sql=TIMELINE_SQL)
def order_timeline(spark, sf_dir):
    return lk.order_timeline(Marketplace(spark, sf_dir).orders)


RECENT_ORDERS_SQL = with_views("b_orders") + """
, top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY buyer_id ORDER BY created_at DESC, order_id DESC) AS rank
          FROM b_orders)
, cnt AS (SELECT l_orderkey AS order_id, COUNT(*) AS item_count FROM lineitem GROUP BY l_orderkey)
SELECT t.buyer_id, CAST(t.rank AS INTEGER) AS rank, t.order_id, t.status, t.total, t.created_at,
       t.payment_status, COALESCE(c.item_count, 0) AS item_count
FROM top t LEFT JOIN cnt c ON c.order_id = t.order_id WHERE t.rank <= 5
"""


@register("recent_orders", covers=("T9", "W24", "L3"), sql=RECENT_ORDERS_SQL)
def recent_orders(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return lk.recent_orders(mk.orders, mk.order_items, 5)


ROUTE_SQL = _with_intents() + """
SELECT conv_id, turn, CASE WHEN conv_id >= 0 AND conv_id % 2 = 0 THEN conv_id END AS user_id, intent,
       CASE WHEN (conv_id < 0 OR conv_id % 2 = 1) AND intent IN ('ORDER_STATUS', 'NOTIFICATIONS') THEN 'login_required'
            WHEN intent = 'ORDER_STATUS' AND order_id IS NULL THEN 'recent_orders'
            WHEN intent = 'ORDER_STATUS' THEN 'order_details'
            WHEN intent IN ('PRODUCT_PRICE', 'PRODUCT_STOCK') AND product_name IS NOT NULL THEN 'product_info'
            WHEN intent = 'CATEGORY_SEARCH' AND category IS NOT NULL THEN 'category_products'
            WHEN intent = 'NOTIFICATIONS' THEN 'notifications'
            WHEN intent = 'REVIEWS' THEN 'reviews'
            WHEN intent = 'GENERAL_HELP' THEN 'help' ELSE 'search_results' END AS response_type
FROM i
"""


@register("chat_routing", covers=("T10",), sql=ROUTE_SQL)
def chat_routing(spark, sf_dir):
    """Even conversations belong to a signed-in buyer (user = conv id); odd
    ones and the derived requests are guests."""
    from larder.operators.quality import route
    c = _intents(spark, sf_dir)
    user = F.when((F.col("conv_id") >= 0) & (F.pmod("conv_id", F.lit(2)) == 0), F.col("conv_id"))
    return route(c.withColumn("user_id", user))
