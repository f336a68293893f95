"""Product lifecycle (K10) and the notifications of every site (K13, J13), four-source feed.

Derived logs (fixed rules; ids are of the driver tables):
  administrators   the regions: user_id = region key
  product events   view and click events: product = event id mod (products + 3), actor its
                   owner unless the id is divisible by 4 (then supplier id mod suppliers) or
                   by 3 (an administrator); action by id mod 7; stock = event id mod 90
  listing events   accepted activate / deactivate actions
  link decisions   a supplier's decision, once more by mail link, for user ids mod 3 = 1
  product created  1996-01-01 plus product id hours
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.columns import company_or_name, round_half_up
from larder.operators import events as ev
from larder.operators import notify as nt
from larder.plans.events import _VERIFY_SQL, appeals, moderation_events, order_pairs, payment_events, verification_events
from larder.plans.registry import register
from larder.plans.sql_binding import with_views
from larder.sources.binding import Marketplace

ACTIONS = ["stock", "activate", "stock", "deactivate", "delete", "activate", "deactivate"]
DELETE_EVERY = 5               # of the delete slots, one in five


def admins(mk: Marketplace):
    r = mk.raw("region")
    return r.select(F.col("r_regionkey").cast("long").alias("user_id"), F.col("r_name").alias("name"), F.lit("admin").alias("role"))


def product_events(mk: Marketplace):
    e = mk.raw("events").where(F.col("event_type").isin("view", "click"))
    i = F.col("event_id")
    n_products = mk.raw("part").select(F.count(F.lit(1))).scalar()
    n_suppliers = mk.raw("supplier").select(F.count(F.lit(1))).scalar()
    product = F.pmod(i, n_products + F.lit(3))
    admin = F.pmod(i, F.lit(3)) == 0
    actor = (F.when(admin, F.pmod("user_id", F.lit(5))).when(F.pmod(i, F.lit(4)) == 0, F.pmod("user_id", n_suppliers))
             .otherwise(F.pmod(product, n_suppliers)))
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.pmod(i, F.lit(7)) + 1).cast("int"))
    action = F.when((action == "delete") & (F.pmod(F.expr("event_id div 7"), F.lit(DELETE_EVERY)) != 0), "stock").otherwise(action)
    return e.select("event_id", "ts", actor.cast("long").alias("actor_id"), F.when(admin, "admin").otherwise("supplier").alias("role"),
                    product.cast("long").alias("product_id"), action.alias("action"), F.pmod(i, F.lit(90)).cast("long").alias("value"))


LIFECYCLE_SQL = with_views("b_products", "b_suppliers") + """
, pe0 AS (
    SELECT event_id, ts, user_id, event_id % ((SELECT COUNT(*) FROM part) + 3) AS product_id, event_id % 90 AS value,
           CASE event_id % 7 WHEN 1 THEN 'activate' WHEN 3 THEN 'deactivate' WHEN 5 THEN 'activate' WHEN 6 THEN 'deactivate'
                WHEN 4 THEN CASE WHEN (event_id // 7) % 5 = 0 THEN 'delete' ELSE 'stock' END ELSE 'stock' END AS action
    FROM events WHERE event_type IN ('view', 'click'))
, pe AS (
    SELECT event_id, ts, product_id, action, value, CASE WHEN event_id % 3 = 0 THEN 'admin' ELSE 'supplier' END AS role,
           CASE WHEN event_id % 3 = 0 THEN user_id % 5 WHEN event_id % 4 = 0 THEN user_id % (SELECT COUNT(*) FROM supplier)
                ELSE product_id % (SELECT COUNT(*) FROM supplier) END AS actor_id FROM pe0)
, judged AS (
    SELECT pe.*, p.supplier_id AS owner_id, p.name, s.verification_status AS ver,
           (role = 'admin' OR (s.verification_status = 'approved' AND actor_id = p.supplier_id)) AND p.product_id IS NOT NULL AS may
    FROM pe LEFT JOIN b_products p ON p.product_id = pe.product_id LEFT JOIN b_suppliers s ON s.user_id = pe.actor_id)
, oc AS (
    SELECT event_id, ts, actor_id, role, product_id, action, value, owner_id, name,
           CASE WHEN role = 'supplier' AND COALESCE(ver, '') <> 'approved' THEN 'verification_required'
                WHEN owner_id IS NULL OR COUNT(*) FILTER (action = 'delete' AND COALESCE(may, FALSE)) OVER (
                     PARTITION BY product_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'not_found'
                WHEN NOT COALESCE(may, FALSE) THEN 'forbidden' ELSE 'accepted' END AS outcome FROM judged)
, ok AS (SELECT * FROM oc WHERE outcome = 'accepted')
, st AS (SELECT product_id, arg_max(value, {'a': ts, 'b': event_id}) AS stock FROM ok WHERE action = 'stock' GROUP BY 1)
, ls AS (SELECT product_id, arg_max(action, {'a': ts, 'b': event_id}) AS a FROM ok WHERE action IN ('activate', 'deactivate') GROUP BY 1)
, state AS (
    SELECT p.product_id, p.name, p.category, p.supplier_id, CAST(COALESCE(st.stock, p.stock) AS INTEGER) AS stock,
           COALESCE(ls.a = 'activate', p.is_active) AS is_active,
           p.product_id IN (SELECT product_id FROM ok WHERE action = 'delete') AS deleted
    FROM b_products p LEFT JOIN st ON st.product_id = p.product_id LEFT JOIN ls ON ls.product_id = p.product_id)
"""


def _outcomes(mk):
    return nt.lifecycle_outcomes(product_events(mk), mk.products, mk.suppliers)


@register("product_event_outcomes", covers=("K10",), sql=LIFECYCLE_SQL + "SELECT event_id, actor_id, role, product_id, action, outcome FROM oc")
def product_event_outcomes(spark, sf_dir):
    return _outcomes(Marketplace(spark, sf_dir)).select("event_id", "actor_id", "role", "product_id", "action", "outcome")


@register("product_lifecycle", covers=("K10",), sql=LIFECYCLE_SQL + "SELECT * FROM state")
def product_lifecycle(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return nt.lifecycle_state(_outcomes(mk), mk.products)


@register("catalogue_after_lifecycle", covers=("K10", "P16"), sql=LIFECYCLE_SQL + """
SELECT product_id, name, category, supplier_id, stock FROM state
WHERE is_active AND NOT deleted AND supplier_id IN (SELECT user_id FROM b_suppliers WHERE verification_status = 'approved')""")
def catalogue_after_lifecycle(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return nt.listed(nt.lifecycle_state(_outcomes(mk), mk.products), mk.suppliers)


def notification_events(mk: Marketplace):
    """Every event a rule may answer, in the columns of ``notify``."""
    def shape(df, kind, key, **given):
        given = {"kind": F.lit(kind), "event_key": F.concat(F.lit(f"{kind}-"), key.cast("string")), **given}
        kinds = {"user_id": "long", "order_id": "long"}
        cols = [given.get(c, F.lit(None)).cast(kinds.get(c, "string")) if c != "ts" else F.col("ts") for c in nt.EVENT_COLUMNS]
        return df.select(*[c.alias(n) for c, n in zip(cols, nt.EVENT_COLUMNS)])

    names = mk.products.select("product_id", F.col("name").alias("product"))
    title = F.concat(F.lit("Review "), F.col("review_id").cast("string"))
    reviews = mk.reviews.join(names, "product_id", "left").withColumn("ts", F.col("created_at"))
    parts = [shape(reviews, "review", F.col("review_id"), name=F.col("user_name"), subject=F.coalesce("product", F.lit("an order")))]
    moved = nt.changes(moderation_events(mk), ["review_id"], "pending").join(mk.reviews.select("review_id", "user_id"), "review_id")
    parts.append(shape(moved, "review_status", F.concat_ws("-", "review_id", "seq"), user_id=F.col("user_id"), subject=title,
                       status=F.col("status"), before=F.col("before")))
    buyer = mk.buyers.select(F.col("user_id").alias("buyer_id"), F.col("name").alias("buyer"))
    bank = mk.orders.where(F.col("payment_method") == "bank").join(buyer, "buyer_id", "left").withColumn("ts", F.col("created_at"))
    parts.append(shape(bank, "bank_order", F.col("order_id"), name=F.col("buyer"), order_id=F.col("order_id")))
    # line numbers repeat inside an order: the time and the action complete the key of a payment event
    paid = payment_events(mk).distinct().join(mk.orders.select("order_id", "buyer_id"), "order_id")
    short = F.upper(F.expr("right(CAST(order_id AS STRING), 6)"))
    parts.append(shape(paid, "payment", F.concat_ws("-", "order_id", "seq", F.date_format("ts", "yyyyMMdd"), "action"), user_id=F.col("buyer_id"), order_id=F.col("order_id"),
                       subject=short, status=F.col("action")))
    listing = _outcomes(mk).where((F.col("outcome") == "accepted") & F.col("action").isin("activate", "deactivate"))
    listing = (listing.withColumn("status", F.when(F.col("action") == "activate", "active").otherwise("inactive")).withColumn("seq", F.col("event_id"))
               .join(mk.products.select("product_id", F.when(F.col("is_active"), "active").otherwise("inactive").alias("start")), "product_id"))
    listing = nt.changes(listing, ["product_id"]).withColumn("before", F.coalesce("before", "start"))
    parts.append(shape(listing, "listing", F.col("event_id"), user_id=F.col("owner_id"), subject=F.col("name"), status=F.col("status"), before=F.col("before")))
    asked = appeals(mk)
    accepted = ev.appeal_intake(asked, mk.products).where(F.col("outcome") == "accepted").select("appeal_id")
    company = mk.suppliers.select("user_id", company_or_name("company", "name").alias("company"))
    appeal = (asked.join(accepted, "appeal_id").join(names, "product_id").join(company, "user_id")
              .join(mk.raw("events").select(F.col("event_id").alias("appeal_id"), "ts"), "appeal_id"))
    parts.append(shape(appeal, "appeal", F.col("appeal_id"), name=F.col("company"), subject=F.col("product"), notes=F.col("reason")))
    ver = verification_events(mk).withColumn("ts", F.col("updated_at"))
    ver = nt.changes(ver, ["user_id"]).join(company, "user_id")
    parts.append(shape(ver, "verification", F.concat_ws("-", "user_id", "seq"), user_id=F.col("user_id"), name=F.col("company"),
                       status=F.col("status"), before=F.col("before"), notes=F.col("notes")))
    link = ver.where((F.pmod("user_id", F.lit(3)) == 1) & F.col("status").isin("approved", "rejected"))
    parts.append(shape(link, "verification_link", F.col("user_id"), user_id=F.col("user_id"), status=F.col("status")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NOTIFICATIONS_SQL = LIFECYCLE_SQL + _VERIFY_SQL.replace(with_views("b_suppliers"), "") + """
, b_orders AS (SELECT o_orderkey AS order_id, o_custkey AS buyer_id, o_orderdate AS created_at FROM orders WHERE o_orderpriority = '1-URGENT')
, rev AS (
    SELECT event_id AS review_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 50 END AS product_id,
           CASE event_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' ELSE 'rejected' END AS status FROM events WHERE event_type = 'purchase')
, mod_ev AS (
    SELECT review_id, user_id, ts, 0 AS seq, status FROM rev
    UNION ALL SELECT review_id, user_id, ts + INTERVAL 1 HOUR, 1, 'approved' FROM rev WHERE review_id % 5 = 0)
, mod_ch AS (SELECT *, COALESCE(LAG(status) OVER (PARTITION BY review_id ORDER BY ts, seq), 'pending') AS before FROM mod_ev)
, pay AS (
    SELECT DISTINCT l_orderkey AS order_id, l_shipdate AS ts, l_returnflag AS f, b.buyer_id,
           l_linenumber || '-' || strftime(l_shipdate, '%Y%m%d') || '-'
               || CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'R' THEN 'reject' ELSE 'reupload' END AS seq
    FROM lineitem JOIN b_orders b ON b.order_id = l_orderkey)
, lst AS (
    SELECT ok.event_id, ok.ts, ok.owner_id, ok.name, ok.action = 'activate' AS now,
           COALESCE(LAG(ok.action = 'activate') OVER (PARTITION BY ok.product_id ORDER BY ok.ts, ok.event_id), p.is_active) AS was
    FROM ok JOIN b_products p ON p.product_id = ok.product_id WHERE ok.action IN ('activate', 'deactivate'))
, apl AS (
    SELECT e.event_id, e.ts, e.props, p.name AS product, COALESCE(NULLIF(trim(s.company), ''), s.name) AS company
    FROM events e JOIN b_products p ON p.product_id = e.event_id % (SELECT COUNT(*) FROM part) AND p.supplier_id = e.user_id
    JOIN b_suppliers s ON s.user_id = e.user_id WHERE event_type = 'error' AND e.event_id % 6 <> 0 AND length(trim(COALESCE(e.props, ''))) > 0)
, ver AS (
    SELECT ve.*, LAG(ve.status) OVER (PARTITION BY ve.user_id ORDER BY updated_at, seq) AS before,
           COALESCE(NULLIF(trim(s.company), ''), s.name) AS company FROM ve JOIN b_suppliers s ON s.user_id = ve.user_id)
, adm AS (SELECT CAST(r_regionkey AS BIGINT) AS user_id FROM region)
, one AS (SELECT MIN(user_id) AS user_id FROM adm)
, told AS (
    SELECT 'review-' || review_id AS k, 'review_submitted' AS site, adm.user_id, 'New Review Submitted' AS title,
           'User ' || rev.user_id || ' submitted a review for ' || COALESCE(p.name, 'an order') || '.' AS message, 'system' AS type, rev.ts
    FROM rev CROSS JOIN adm LEFT JOIN b_products p ON p.product_id = rev.product_id
    UNION ALL
    SELECT 'review_status-' || review_id || '-' || seq, 'review_decided', user_id,
           'Review ' || CASE status WHEN 'approved' THEN 'Approved' ELSE 'Rejected' END,
           'Your review "Review ' || review_id || '" has been ' || status || '.', 'system', ts
    FROM mod_ch WHERE status <> before AND status <> 'pending'
    UNION ALL
    SELECT 'bank_order-' || order_id, 'payment_requested', one.user_id, 'Payment Verification Request',
           'New payment verification request received from ' || c_name, 'system', created_at
    FROM b_orders CROSS JOIN one LEFT JOIN customer ON c_custkey = buyer_id
    UNION ALL
    SELECT 'payment-' || order_id || '-' || seq, CASE f WHEN 'A' THEN 'payment_approved' ELSE 'payment_rejected' END, buyer_id,
           CASE f WHEN 'A' THEN 'Order Payment Approved' ELSE 'Order Payment Rejected' END,
           CASE f WHEN 'A' THEN 'Your payment has been verified and your order has been confirmed.'
                  ELSE 'Your payment slip has been rejected. Please upload a new payment slip.' END, 'order', ts
    FROM pay WHERE f IN ('A', 'R')
    UNION ALL
    SELECT 'payment-' || pay.order_id || '-' || seq, 'order_available', s.l_suppkey, 'New Order Available',
           'A new verified order is available for processing.', 'order', ts
    FROM pay JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) s ON s.l_orderkey = pay.order_id WHERE f = 'A'
    UNION ALL
    SELECT 'payment-' || order_id || '-' || seq, 'slip_resubmitted', one.user_id, 'Payment Slip Resubmitted',
           'Customer has resubmitted a payment slip for Order #' || right(CAST(order_id AS VARCHAR), 6), 'system', ts
    FROM pay CROSS JOIN one WHERE f = 'N'
    UNION ALL
    SELECT 'listing-' || event_id, 'listing_changed', owner_id,
           CASE WHEN now THEN 'Product Listing Approved' ELSE 'Product Listing Flagged/Rejected' END,
           'Your product listing "' || name || CASE WHEN now THEN '" has been approved and is now active in the marketplace.'
               ELSE '" has been flagged and temporarily deactivated by administrators.' END, 'system', ts
    FROM lst WHERE now <> was
    UNION ALL
    SELECT 'appeal-' || event_id, 'listing_appeal', one.user_id, 'Product Listing Appeal',
           'Supplier "' || company || '" appealed rejection of "' || product || '": ' || props, 'system', ts
    FROM apl CROSS JOIN one
    UNION ALL
    SELECT 'verification-' || user_id || '-' || seq, 'verification_received', user_id,
           CASE WHEN before IS NULL THEN 'Verification Submitted' ELSE 'Verification Documents Updated' END,
           CASE WHEN before IS NULL THEN 'Your business verification request has been successfully submitted and is pending admin review.'
                WHEN before = 'rejected' THEN 'Your business verification documents have been resubmitted and are pending admin review.'
                ELSE 'Your business verification documents have been updated and are pending admin review.' END, 'system', updated_at
    FROM ver WHERE status = 'pending'
    UNION ALL
    SELECT 'verification-' || ver.user_id || '-' || seq, 'verification_to_review', adm.user_id,
           CASE WHEN before IS NULL THEN 'New Supplier Verification Request Submitted' WHEN before = 'rejected' THEN 'Supplier Verification Resubmitted'
                ELSE 'Verification Documents Updated' END,
           '"' || company || '" has submitted business verification documents and requires review.', 'system', updated_at
    FROM ver CROSS JOIN adm WHERE status = 'pending'
    UNION ALL
    SELECT 'verification-' || user_id || '-' || seq, 'verification_by_admin', user_id,
           CASE status WHEN 'approved' THEN 'Verification Approved' WHEN 'rejected' THEN 'Verification Rejected' ELSE 'Information Requested by Admin' END,
           CASE status WHEN 'approved' THEN 'Your business verification has been approved. You can now publish products and receive orders.'
                WHEN 'rejected' THEN 'Your business verification request was rejected. Reason: ' || notes
                ELSE 'Additional business documentation requested: ' || notes END, 'system', updated_at
    FROM ver WHERE status <> 'pending'
    UNION ALL
    SELECT 'verification_link-' || user_id, 'verification_by_link', user_id,
           CASE status WHEN 'approved' THEN 'Verification Approved' ELSE 'Verification Rejected' END,
           CASE status WHEN 'approved' THEN 'Your business verification has been approved. You can now publish products and receive orders.'
                ELSE 'Your business verification request was rejected. Please update your details and resubmit.' END, 'system', updated_at
    FROM ver WHERE status IN ('approved', 'rejected') AND user_id % 3 = 1)
SELECT k || '|' || site || '|' || user_id AS notification_key, site, user_id, title, message, type, FALSE AS read, ts AS created_at FROM told
"""


@register("all_notifications", covers=("K13", "J13", "S9"), sql=NOTIFICATIONS_SQL)
def all_notifications(spark, sf_dir):
    """One row per event, site and recipient, over the thirteen sites."""
    mk = Marketplace(spark, sf_dir)
    return nt.notifications(notification_events(mk), order_pairs(mk), admins(mk))


FEED_SQL = LIFECYCLE_SQL + """
, one AS (SELECT MIN(r_regionkey) AS user_id FROM region)
, u AS (SELECT 'customer' AS type, 'New Customer Registered' AS title, printf('User %d joined the platform.', user_id) AS description, ts, user_id AS ref_id
        FROM events WHERE event_type = 'signup' ORDER BY ts DESC, user_id DESC LIMIT 5)
, o AS (SELECT 'order' AS type, CASE WHEN s = 'Delivered' THEN 'Order Completed' WHEN s = 'Cancelled' THEN 'Order Cancelled' ELSE 'New Order Placed' END AS title,
               printf('Order of £%.2f is %s.', CAST(ROUND(CAST(total AS DECIMAL(38,10)), 2) AS DOUBLE), s) AS description, ts, order_id AS ref_id
        FROM (SELECT o_orderkey AS order_id, o_totalprice AS total, o_orderdate AS ts,
                     CASE WHEN o_orderstatus = 'F' THEN 'Delivered' WHEN o_orderstatus = 'O' THEN 'In Transit' WHEN o_orderpriority = '5-LOW' THEN 'Cancelled'
                          WHEN o_orderpriority = '1-URGENT' THEN 'Pending Payment Verification' ELSE 'Pending' END AS s FROM orders)
        ORDER BY ts DESC, order_id DESC LIMIT 5)
, p AS (SELECT 'product' AS type, 'New Product Listed' AS title,
               printf('%s listed in %s for £%.2f.', name, COALESCE(category, 'Catalog'), CAST(ROUND(CAST(price AS DECIMAL(38,10)), 2) AS DOUBLE)) AS description,
               TIMESTAMP '1996-01-01 00:00:00' + to_hours(CAST(product_id AS BIGINT)) AS ts, product_id AS ref_id
        FROM b_products ORDER BY ts DESC, product_id DESC LIMIT 5)
, a AS (SELECT 'support' AS type, 'Listing Rejection Appeal' AS title,
               'Supplier "' || COALESCE(NULLIF(trim(s.company), ''), s.name) || '" appealed rejection of "' || p.name || '": ' || e.props AS description,
               e.ts, e.event_id AS ref_id
        FROM events e JOIN b_products p ON p.product_id = e.event_id % (SELECT COUNT(*) FROM part) AND p.supplier_id = e.user_id
        JOIN b_suppliers s ON s.user_id = e.user_id WHERE event_type = 'error' AND e.event_id % 6 <> 0 AND length(trim(COALESCE(e.props, ''))) > 0
        ORDER BY e.ts DESC, e.event_id DESC LIMIT 5)
SELECT * FROM (SELECT * FROM u UNION ALL SELECT * FROM o UNION ALL SELECT * FROM p UNION ALL SELECT * FROM a)
"""


@register("activity_feed_sources", covers=("U1", "L3"), sql=FEED_SQL)
def activity_feed_sources(spark, sf_dir, top=5):
    """The newest five of each of four sources: users, orders, products, appeals."""
    mk = Marketplace(spark, sf_dir)
    feed = lambda df, kind, title, said, ts, ref: df.orderBy(F.desc(ts), F.desc(ref)).limit(top).select(
        F.lit(kind).alias("type"), title.alias("title"), said.alias("description"), F.col(ts).alias("ts"), F.col(ref).alias("ref_id"))
    st = F.col("status")
    users = feed(mk.signups, "customer", F.lit("New Customer Registered"), F.format_string("User %d joined the platform.", "user_id"), "created_at", "user_id")
    orders = feed(mk.orders, "order", F.when(st.isin("Completed", "Delivered"), "Order Completed").when(st == "Cancelled", "Order Cancelled")
                  .otherwise("New Order Placed"), F.format_string("Order of £%.2f is %s.", round_half_up("total", 2), F.coalesce(st, F.lit("Pending"))),
                  "created_at", "order_id")
    made = F.to_timestamp_ntz(F.lit("1996-01-01")) + F.make_dt_interval(hours=F.col("product_id"))
    products = feed(mk.products.withColumn("created_at", made), "product", F.lit("New Product Listed"), F.format_string(
        "%s listed in %s for £%.2f.", "name", F.coalesce("category", F.lit("Catalog")), round_half_up("price", 2)), "created_at", "product_id")
    told = nt.notifications(notification_events(mk).where(F.col("kind") == "appeal"), order_pairs(mk), admins(mk))
    ref = F.regexp_extract("notification_key", r"appeal-(\d+)", 1).cast("long")
    appeal = feed(told.withColumn("ref", ref), "support", F.lit("Listing Rejection Appeal"), F.col("message"), "created_at", "ref")
    return users.unionByName(orders).unionByName(products).unionByName(appeal)
