"""Chat answers (T10) of the derived requests, which reach every branch of the look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import answers as an
from larder.operators import chat as op
from larder.plans.chat import CATEGORY_SQL, LOOKUP_SQL, SEARCH_SQL, intents_sql
from larder.plans.registry import register
from larder.plans.sql_binding import VIEWS, with_views
from larder.session import checkpoint_dir
from larder.sources.binding import Marketplace

def _sql() -> str:
    def over(sql, *more):
        """A look-up's SQL over the requests alone."""
        sql = sql.replace(VIEWS["b_messages"][1].strip(), "SELECT conv_id, turn, message FROM b_chat_requests")
        for a, b in more:
            assert a in sql
            sql = sql.replace(a, b)
        return sql

    lost = """(i.intent = 'FALLBACK_SEARCH' OR (i.intent IN ('PRODUCT_PRICE', 'PRODUCT_STOCK') AND i.product_name IS NULL)
               OR (i.intent = 'CATEGORY_SEARCH' AND i.category IS NULL))"""
    item = "{'name': name, 'price': price, 'stock': stock, 'category': category}"
    login = f"{{'orderFound': false, 'error': {_q(an.LOGIN_ORDERS)}, 'text': {_q(an.LOGIN_ORDERS_TEXT)}}}"
    return with_views("b_orders", "b_buyers", "b_notifications", "b_reviews", "b_chat_requests") + f"""
, i0 AS ({over(intents_sql())})
, i AS (SELECT i0.*, q.user_id FROM i0 JOIN b_chat_requests q USING (conv_id, turn))
, lk AS ({over(LOOKUP_SQL)})
, ct AS ({over(CATEGORY_SQL)})
, se AS ({over(SEARCH_SQL, ("WHERE i.intent = 'FALLBACK_SEARCH'", "WHERE " + lost))})
, alt AS (SELECT conv_id, turn, list({item} ORDER BY rank) AS l FROM lk WHERE kind = 'alternative' GROUP BY 1, 2)
, hit AS (SELECT conv_id, turn, {item} AS product, stock FROM lk WHERE kind = 'product')
, ctl AS (SELECT conv_id, turn, list({item} ORDER BY rank) AS l FROM ct GROUP BY 1, 2)
, sel AS (SELECT conv_id, turn, list({item} ORDER BY rank) AS l FROM se GROUP BY 1, 2)
, nth AS (SELECT *, lpad(CAST(order_id AS VARCHAR), 24, '0') AS did, ROW_NUMBER() OVER (PARTITION BY buyer_id ORDER BY created_at DESC, order_id DESC) AS place FROM b_orders)
, cnt AS (SELECT l_orderkey AS order_id, COUNT(*) AS n FROM lineitem GROUP BY 1)
, rec AS (SELECT buyer_id, list({{'orderId': did, 'status': status, 'total': total, 'itemCount': COALESCE(n, 0)}} ORDER BY place) AS l
          FROM nth LEFT JOIN cnt ON cnt.order_id = nth.order_id WHERE place <= 5 GROUP BY buyer_id)
, fnd AS (
    SELECT i.conv_id, i.turn, arg_min(nth.order_id, place) AS found, bool_or(nth.buyer_id = i.user_id) AS own
    FROM i LEFT JOIN nth ON (length(i.order_id) = 24 AND nth.did = i.order_id)
         OR (length(i.order_id) <> 24 AND nth.buyer_id = i.user_id AND place <= 50 AND (suffix(did, i.order_id) OR prefix(did, i.order_id)))
    WHERE i.intent = 'ORDER_STATUS' AND i.user_id IS NOT NULL AND i.order_id IS NOT NULL GROUP BY 1, 2)
, itm AS (SELECT l_orderkey AS order_id, list({{'name': name, 'quantity': l_quantity}} ORDER BY name, l_quantity) AS l
          FROM lineitem JOIN b_chat_products ON product_id = l_partkey WHERE l_orderkey IN (SELECT found FROM fnd) GROUP BY 1)
, det AS (
    SELECT o.order_id, {{'orderId': lpad(CAST(o.order_id AS VARCHAR), 24, '0'), 'status': status, 'paymentMethod': payment_method,
            'paymentStatus': payment_status, 'total': total, 'createdAt': strftime(created_at, '%Y-%m-%d %H:%M:%S'), 'items': itm.l,
            'timeline': list_filter([
                {{'status': 'Pending', 'label': 'Order Placed', 'completed': true, 'error': false}},
                CASE WHEN payment_method = 'bank' THEN {{'status': 'Pending Payment Verification', 'label': CASE payment_status WHEN 'Rejected' THEN 'Payment Rejected'
                     WHEN 'Approved' THEN 'Payment Verified' ELSE 'Awaiting Payment Verification' END, 'completed': payment_status = 'Approved',
                     'error': payment_status = 'Rejected'}} END,
                {{'status': 'In Transit', 'label': 'In Transit', 'completed': status IN ('In Transit', 'Delivered'), 'error': false}},
                {{'status': 'Delivered', 'label': 'Delivered', 'completed': status = 'Delivered', 'error': false}},
                CASE WHEN status = 'Cancelled' THEN {{'status': 'Cancelled', 'label': 'Order Cancelled', 'completed': true, 'error': true}} END],
                lambda x: x IS NOT NULL)}} AS d
    FROM b_orders o LEFT JOIN itm ON itm.order_id = o.order_id WHERE o.order_id IN (SELECT found FROM fnd))
, nts AS (SELECT user_id, COUNT(*) FILTER (NOT read) AS unread FROM b_notifications GROUP BY 1)
, ntl AS (SELECT user_id, list({{'id': notification_id, 'title': title, 'type': type, 'read': read, 'createdAt': strftime(created_at, '%Y-%m-%d %H:%M:%S')}} ORDER BY k) AS l
          FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, notification_id DESC) AS k FROM b_notifications) WHERE k <= 5 GROUP BY 1)
, plat AS (SELECT * FROM b_reviews WHERE status = 'approved' AND product_id IS NULL)
, rv AS (SELECT list({{'id': review_id, 'userName': user_name, 'rating': rating, 'createdAt': strftime(created_at, '%Y-%m-%d %H:%M:%S')}}
                     ORDER BY created_at DESC, review_id DESC) AS l
         FROM (SELECT * FROM plat ORDER BY created_at DESC, review_id DESC LIMIT 3))
, said AS (
    SELECT i.conv_id, i.turn, i.user_id, i.intent,
           CASE WHEN i.intent = 'ORDER_STATUS' THEN 'order_status' WHEN {lost} THEN 'fallback' WHEN i.intent IN ('PRODUCT_PRICE', 'PRODUCT_STOCK') THEN 'product_info'
                WHEN i.intent = 'CATEGORY_SEARCH' THEN 'category_search' WHEN i.intent = 'NOTIFICATIONS' THEN 'notifications'
                WHEN i.intent = 'REVIEWS' THEN 'reviews' ELSE 'general_help' END AS response_type,
           CASE WHEN i.intent = 'ORDER_STATUS' AND i.user_id IS NULL THEN to_json({login})
                WHEN i.intent = 'ORDER_STATUS' AND i.order_id IS NULL THEN to_json({{'orderFound': false, 'error': {_q(an.NO_ORDER_ID)}, 'recentOrders': COALESCE(rec.l, [])}})
                WHEN i.intent = 'ORDER_STATUS' AND fnd.found IS NULL THEN to_json({{'orderFound': false, 'error': {_q(an.NOT_FOUND)}, 'status': 404}})
                WHEN i.intent = 'ORDER_STATUS' AND NOT fnd.own THEN to_json({{'orderFound': false, 'error': {_q(an.FORBIDDEN)}, 'status': 403}})
                WHEN i.intent = 'ORDER_STATUS' THEN to_json({{'orderFound': true, 'order': det.d}})
                WHEN {lost} THEN to_json({{'message': CASE i.intent WHEN 'FALLBACK_SEARCH' THEN {_q(an.NO_MATCH)} WHEN 'CATEGORY_SEARCH' THEN {_q(an.NO_CATEGORY)}
                                                    ELSE {_q(an.NO_PRODUCT)} END, 'products': COALESCE(sel.l, [])}})
                WHEN i.intent IN ('PRODUCT_PRICE', 'PRODUCT_STOCK') THEN to_json({{'queryType': CASE i.intent WHEN 'PRODUCT_PRICE' THEN 'price' ELSE 'stock' END,
                     'productName': i.product_name, 'product': hit.product, 'inStock': COALESCE(hit.stock > 0, false), 'alternatives': COALESCE(alt.l, [])}})
                WHEN i.intent = 'CATEGORY_SEARCH' THEN to_json({{'category': i.category, 'products': COALESCE(ctl.l, [])}})
                WHEN i.intent = 'NOTIFICATIONS' AND i.user_id IS NULL THEN to_json({{'unreadCount': 0, 'notifications': [], 'text': {_q(an.LOGIN_NOTES)}}})
                WHEN i.intent = 'NOTIFICATIONS' THEN to_json({{'unreadCount': COALESCE(nts.unread, 0), 'notifications': COALESCE(ntl.l, [])}})
                WHEN i.intent = 'REVIEWS' THEN to_json({{'averageRating': COALESCE((SELECT CAST(ROUND(CAST(AVG(rating) AS DECIMAL(38,10)), 1) AS DOUBLE) FROM plat), 5.0),
                                                      'reviews': (SELECT l FROM rv)}})
                ELSE to_json({{'userName': CASE WHEN i.user_id IS NULL THEN 'Guest' ELSE COALESCE(b.name, 'Trader') END}}) END AS data
    FROM i LEFT JOIN rec ON rec.buyer_id = i.user_id LEFT JOIN fnd USING (conv_id, turn) LEFT JOIN det ON det.order_id = fnd.found
    LEFT JOIN hit USING (conv_id, turn) LEFT JOIN alt USING (conv_id, turn) LEFT JOIN ctl USING (conv_id, turn) LEFT JOIN sel USING (conv_id, turn)
    LEFT JOIN nts ON nts.user_id = i.user_id LEFT JOIN ntl ON ntl.user_id = i.user_id LEFT JOIN b_buyers b ON b.user_id = i.user_id)
SELECT conv_id, turn, user_id, intent, response_type, CAST(data AS VARCHAR) AS data FROM said
"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def classified_requests(mk: Marketplace):
    """The requests with their intents, stored once: every branch reads them."""
    checkpoint_dir(mk.spark)
    asked = mk.chat_requests
    found = op.classify(asked.select("conv_id", "turn", "message"))
    return found.join(asked.select("conv_id", "turn", "user_id"), ["conv_id", "turn"]).checkpoint(eager=True)


@register("chat_answers", covers=("T10", "T5", "T6", "T7", "T8", "T9", "U3", "J11", "F15"), sql=_sql())
def chat_answers(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return an.answers(classified_requests(mk), mk.orders, mk.order_items, mk.chat_products, mk.notifications, mk.reviews, mk.buyers)
