"""Event-log folds (K6-K15) over logs derived from the driver tables.

Derived logs (fixed rules):
  supplier status events  one per lineitem: (order, supplier) at ship date,
                          status from line status / return flag
  admin overrides         P orders '4-NOT SPECIFIED' -> Cancelled 400 days
                          after the order; O orders '3-MEDIUM' -> Delivered
                          one day after the order (later events still win)
  payment actions         lines of bank-paid orders: A approve, R reject,
                          N re-upload, at ship date
  review moderation       each review's status at creation, plus a later
                          approval for review ids divisible by 5
  verification events     per supplier: submit, then decision (or an
                          information request and a re-submission)
  appeals                 error events: product = event id mod #products
  read events             view -> read the previous notification,
                          signup -> read all, error (id mod 4 = 0) -> delete
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import events as ev
from larder.operators import order_state as os_
from larder.operators.reviews import product_ratings
from larder.plans.registry import register
from larder.plans.sql_binding import with_views
from larder.plans.sqlfrag import rnd
from larder.sources.binding import Marketplace, entry_status


def status_events(mk: Marketplace):
    li = mk.raw("lineitem")
    return li.select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("supplier_id"),
                     F.col("l_shipdate").alias("ts"), F.col("l_linenumber").alias("seq"),
                     entry_status(F.col("l_linestatus"), F.col("l_returnflag")).alias("status"))


def overrides(mk: Marketplace):
    o = mk.raw("orders")
    cancel = o.where((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "4-NOT SPECIFIED")) \
              .select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("ts"),
                      F.lit("Cancelled").alias("status"))
    deliver = o.where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "3-MEDIUM")) \
               .select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 1 DAYS")).alias("ts"),
                       F.lit("Delivered").alias("status"))
    return cancel.unionByName(deliver).select(F.col("o_orderkey").alias("order_id"), "ts",
                                              F.lit(0).alias("seq"), "status")


_EVENTS_SQL = """
, sev AS (
    SELECT l_orderkey AS order_id, l_suppkey AS supplier_id, l_shipdate AS ts, l_linenumber AS seq,
           CASE WHEN l_linestatus = 'F' THEN 'Delivered' WHEN l_returnflag = 'R' THEN 'Cancelled'
                WHEN l_returnflag = 'A' THEN 'In Transit' ELSE 'Pending' END AS status
    FROM lineitem)
"""

_ROLLUP_SQL = """
, lat AS (
    SELECT order_id, supplier_id, status FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id, supplier_id ORDER BY ts DESC, seq DESC, status DESC) AS rn
        FROM ev_all) t WHERE rn = 1)
SELECT order_id,
       CASE WHEN n_live = 0 THEN 'Cancelled' WHEN n_delivered = n_live THEN 'Delivered'
            WHEN n_moving > 0 THEN 'In Transit' ELSE 'Pending' END AS order_status, n_live
FROM (SELECT order_id, COUNT(*) FILTER (WHERE status <> 'Cancelled') AS n_live,
             COUNT(*) FILTER (WHERE status = 'Delivered') AS n_delivered,
             COUNT(*) FILTER (WHERE status IN ('In Transit', 'Delivered')) AS n_moving
      FROM lat GROUP BY order_id) g
"""

ROLLUP_SQL = "WITH dummy AS (SELECT 1)" + _EVENTS_SQL + ", ev_all AS (SELECT * FROM sev)" + _ROLLUP_SQL


@register("order_status_rollup", covers=("K6", "U4"), sql=ROLLUP_SQL)
def order_status_rollup(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    last = ev.latest(status_events(mk), ["order_id", "supplier_id"], ["ts", "seq", "status"], ["status"])
    return ev.rollup_status(last)


OVERRIDE_SQL = "WITH dummy AS (SELECT 1)" + _EVENTS_SQL + """
, ov AS (
    SELECT o_orderkey AS order_id, o_orderdate + INTERVAL 400 DAY AS ts, 0 AS seq, 'Cancelled' AS status
    FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED'
    UNION ALL
    SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY, 0, 'Delivered'
    FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM')
, ev_all AS (
    SELECT order_id, supplier_id, ts, seq, status FROM sev
    UNION ALL
    SELECT ov.order_id, p.supplier_id, ov.ts, ov.seq, ov.status
    FROM ov JOIN (SELECT order_id, supplier_id, MIN(ts) AS first_ts,
                         MIN(MIN(ts)) OVER (PARTITION BY order_id) AS order_first
                  FROM sev GROUP BY order_id, supplier_id) p
         ON p.order_id = ov.order_id AND (p.first_ts <= ov.ts OR p.order_first > ov.ts))
""" + _ROLLUP_SQL


@register("order_status_with_overrides", covers=("K7", "K6"), sql=OVERRIDE_SQL)
def order_status_with_overrides(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    se = status_events(mk)
    allev = ev.apply_overrides(se, overrides(mk), se)
    last = ev.latest(allev, ["order_id", "supplier_id"], ["ts", "seq", "status"], ["status"])
    return ev.rollup_status(last)


def payment_events(mk: Marketplace):
    li = mk.raw("lineitem")
    bank = mk.orders.where(F.col("payment_method") == "bank").select(F.col("order_id").alias("l_orderkey"))
    f = F.col("l_returnflag")
    return li.join(bank, "l_orderkey", "left_semi").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("ts"),
        F.col("l_linenumber").alias("seq"),
        F.when(f == "A", "approve").when(f == "R", "reject").otherwise("reupload").alias("action"))


PAYMENT_SQL = with_views("b_orders") + """
, pe AS (
    SELECT l_orderkey AS order_id, l_shipdate AS ts, l_linenumber AS seq,
           CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'R' THEN 'reject' ELSE 'reupload' END AS action
    FROM lineitem WHERE l_orderkey IN (SELECT order_id FROM b_orders WHERE payment_method = 'bank'))
, last AS (
    SELECT order_id, action FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY ts DESC, seq DESC, action DESC) AS rn FROM pe) t
    WHERE rn = 1)
, last_set AS (
    SELECT order_id, action FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY ts DESC, seq DESC, action DESC) AS rn
        FROM pe WHERE action <> 'reject') t
    WHERE rn = 1)
, approved AS (SELECT order_id, MAX(ts) AS ts FROM pe WHERE action = 'approve' GROUP BY order_id)
SELECT l.order_id, l.action,
       CASE l.action WHEN 'approve' THEN 'Approved' WHEN 'reject' THEN 'Rejected' ELSE 'Pending Verification' END
           AS payment_status,
       CASE s.action WHEN 'approve' THEN 'Pending' WHEN 'reupload' THEN 'Pending Payment Verification' END
           AS order_status_reset,
       a.ts AS entries_reset_at
FROM last l LEFT JOIN last_set s ON s.order_id = l.order_id LEFT JOIN approved a ON a.order_id = l.order_id
"""


@register("payment_status_fold", covers=("K8",), sql=PAYMENT_SQL)
def payment_status_fold(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return ev.payment_fold(payment_events(mk))


def order_events(mk: Marketplace):
    """Supplier updates, admin overrides and payment actions in one log."""
    cols = ["order_id", "supplier_id", "ts", "seq", "kind", "status"]
    none = F.lit(None)
    own = status_events(mk).withColumn("kind", F.lit("supplier"))
    admin = overrides(mk).withColumn("kind", F.lit("admin")).withColumn("supplier_id", none.cast("long"))
    paid = (payment_events(mk).withColumnRenamed("action", "kind").withColumn("supplier_id", none.cast("long"))
            .withColumn("status", none.cast("string")))
    return own.select(cols).unionByName(admin.select(cols)).unionByName(paid.select(cols))


def order_pairs(mk: Marketplace):
    """The suppliers of every order; those with key mod 10 = 0 have no entry at first."""
    pairs = mk.raw("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("supplier_id")).distinct()
    return pairs.withColumn("initial", F.pmod("supplier_id", F.lit(10)) != 0)


ORDER_STATE_SQL = with_views("b_orders") + _EVENTS_SQL + """
, pairs AS (SELECT DISTINCT l_orderkey AS order_id, l_suppkey AS supplier_id, l_suppkey % 10 <> 0 AS initial FROM lineitem)
, ev AS (
    SELECT order_id, supplier_id, ts, seq, 0 AS k, 'supplier' AS kind, status FROM sev
    UNION ALL
    SELECT o_orderkey, NULL, o_orderdate + INTERVAL 400 DAY, 0, 1, 'admin', 'Cancelled'
    FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED'
    UNION ALL
    SELECT o_orderkey, NULL, o_orderdate + INTERVAL 1 DAY, 0, 1, 'admin', 'Delivered'
    FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM'
    UNION ALL
    SELECT l_orderkey, NULL, l_shipdate, l_linenumber, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 3 ELSE 4 END,
           CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'R' THEN 'reject' ELSE 'reupload' END, NULL
    FROM lineitem WHERE l_orderkey IN (SELECT order_id FROM b_orders WHERE payment_method = 'bank'))
, seen AS (
    SELECT *, COUNT(*) FILTER (kind = 'supplier') OVER (PARTITION BY order_id ORDER BY ts, seq, k, COALESCE(status, '')
                                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own_before FROM ev)
, fan AS (
    SELECT p.order_id, p.supplier_id, p.initial, e.ts, e.seq, e.k, e.kind, e.status,
           e.own_before = 0 AND NOT bool_or(p.initial) OVER (PARTITION BY p.order_id) AS none_yet
    FROM pairs p JOIN seen e ON e.order_id = p.order_id
    WHERE (e.kind = 'supplier' AND e.supplier_id = p.supplier_id) OR e.kind IN ('admin', 'approve'))
, alive AS (
    SELECT *, initial OR MAX(CASE WHEN kind = 'supplier' OR (kind = 'admin' AND none_yet) THEN 1 ELSE 0 END) OVER (
                  PARTITION BY order_id, supplier_id ORDER BY ts, seq, k, COALESCE(status, '') ROWS UNBOUNDED PRECEDING) = 1 AS here FROM fan)
, newest AS (
    SELECT order_id, supplier_id, CASE WHEN kind = 'approve' THEN 'Pending' ELSE status END AS s,
           ROW_NUMBER() OVER (PARTITION BY order_id, supplier_id ORDER BY ts DESC, seq DESC, k DESC, COALESCE(status, '') DESC) AS rn
    FROM alive WHERE here)
, entries AS (
    SELECT p.order_id, p.supplier_id, COALESCE(n.s, 'Pending') AS s
    FROM pairs p LEFT JOIN newest n ON n.order_id = p.order_id AND n.supplier_id = p.supplier_id AND n.rn = 1
    WHERE n.s IS NOT NULL OR p.initial)
, rolled AS (
    SELECT order_id, COUNT(*) AS n_entries, COUNT(*) FILTER (s <> 'Cancelled') AS n_live, COUNT(*) FILTER (s = 'Delivered') AS done,
           COUNT(*) FILTER (s IN ('In Transit', 'Delivered')) AS moving,
           string_agg(supplier_id || ':' || s, ',' ORDER BY supplier_id) AS entries FROM entries GROUP BY order_id)
, setter AS (SELECT order_id, arg_max({'kind': kind, 'status': status}, {'a': ts, 'b': seq, 'c': k, 'd': COALESCE(status, '')}) AS s
             FROM ev WHERE kind <> 'reject' GROUP BY order_id)
, pay AS (SELECT order_id, arg_max(kind, {'a': ts, 'b': seq, 'c': k}) AS a FROM ev WHERE kind IN ('approve', 'reject', 'reupload') GROUP BY order_id)
SELECT o.order_id,
       CASE WHEN w.s.kind = 'supplier' THEN CASE WHEN n_live = 0 THEN 'Cancelled' WHEN done = n_live THEN 'Delivered'
                                                 WHEN moving > 0 THEN 'In Transit' ELSE 'Pending' END
            WHEN w.s.kind = 'admin' THEN w.s.status WHEN w.s.kind = 'approve' THEN 'Pending'
            WHEN w.s.kind = 'reupload' OR o.payment_method = 'bank' THEN 'Pending Payment Verification' ELSE 'Pending' END AS order_status,
       CASE WHEN p.a = 'approve' THEN 'Approved' WHEN p.a = 'reject' THEN 'Rejected'
            WHEN p.a = 'reupload' OR o.payment_method = 'bank' THEN 'Pending Verification' ELSE 'Approved' END AS payment_status,
       COALESCE(r.n_entries, 0) AS n_entries, COALESCE(r.n_live, 0) AS n_live, COALESCE(r.entries, '') AS entries
FROM b_orders o LEFT JOIN rolled r ON r.order_id = o.order_id LEFT JOIN setter w ON w.order_id = o.order_id
LEFT JOIN pay p ON p.order_id = o.order_id
"""


@register("order_state", covers=("K6", "K7", "K8"), sql=ORDER_STATE_SQL)
def order_state(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return os_.order_state(order_events(mk), order_pairs(mk), mk.orders)


def moderation_events(mk: Marketplace):
    r = mk.reviews
    first = r.select("review_id", F.col("created_at").alias("ts"), F.lit(0).alias("seq"), "status")
    again = r.where(F.pmod("review_id", F.lit(5)) == 0).select(
        "review_id", (F.col("created_at") + F.expr("INTERVAL 1 HOURS")).alias("ts"), F.lit(1).alias("seq"),
        F.lit("approved").alias("status"))
    return first.unionByName(again)


MODERATION_SQL = with_views("b_reviews", "b_products") + f"""
, me AS (
    SELECT review_id, created_at AS ts, 0 AS seq, status FROM b_reviews
    UNION ALL
    SELECT review_id, created_at + INTERVAL 1 HOUR, 1, 'approved' FROM b_reviews WHERE review_id % 5 = 0)
, cur AS (SELECT review_id, status FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY review_id ORDER BY ts DESC, seq DESC) AS rn FROM me) t
          WHERE rn = 1)
, r AS (SELECT b.review_id, b.product_id, b.rating, c.status FROM b_reviews b JOIN cur c ON c.review_id = b.review_id)
, a AS (SELECT product_id, {rnd('AVG(rating)', 1)} AS rating, COUNT(*) AS reviews
        FROM r WHERE status = 'approved' AND product_id IS NOT NULL GROUP BY product_id)
SELECT p.product_id, p.name, COALESCE(a.rating, 0.0) AS rating, COALESCE(a.reviews, 0) AS reviews
FROM b_products p LEFT JOIN a ON a.product_id = p.product_id
"""


@register("moderated_product_ratings", covers=("K9", "A20"), sql=MODERATION_SQL)
def moderated_product_ratings(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    cur = ev.latest(moderation_events(mk), ["review_id"], ["ts", "seq"], ["status"])
    reviews = mk.reviews.drop("status").join(cur.select("review_id", "status"), "review_id")
    return product_ratings(mk.products, reviews)


def verification_events(mk: Marketplace):
    s = mk.suppliers
    t0 = F.to_timestamp_ntz(F.lit("2024-01-01")) + F.make_dt_interval(hours=F.col("user_id"))
    vs = F.col("verification_status")

    def ev_(days, status, note, by, seq):
        return F.struct((t0 + F.make_dt_interval(days=F.lit(days))).alias("updated_at"),
                        F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"),
                        F.lit(note).alias("notes"), F.lit(by).alias("updated_by"), F.lit(seq).alias("seq"))

    steps = F.array(
        ev_(0, "pending", "Documents submitted", "supplier", 0),
        F.when(vs != "pending", ev_(2, vs, "Reviewed", "admin", 1)),
        F.when(vs == "pending", ev_(1, "information_requested", "More documents needed", "admin", 1)),
        F.when(vs == "pending", ev_(3, "pending", "Documents re-submitted", "supplier", 2)))
    return s.select("user_id", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("e")) \
            .select("user_id", "e.*")


_VERIFY_SQL = with_views("b_suppliers") + """
, t AS (SELECT user_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(user_id AS BIGINT)) AS t0,
               verification_status AS vs FROM b_suppliers)
, ve AS (
    SELECT user_id, t0 AS updated_at, 'pending' AS status, 'Documents submitted' AS notes,
           'supplier' AS updated_by, 0 AS seq FROM t
    UNION ALL SELECT user_id, t0 + INTERVAL 2 DAY, vs, 'Reviewed', 'admin', 1 FROM t WHERE vs <> 'pending'
    UNION ALL SELECT user_id, t0 + INTERVAL 1 DAY, 'information_requested', 'More documents needed', 'admin', 1
              FROM t WHERE vs = 'pending'
    UNION ALL SELECT user_id, t0 + INTERVAL 3 DAY, 'pending', 'Documents re-submitted', 'supplier', 2
              FROM t WHERE vs = 'pending')
, h AS (SELECT ve.*, LEAD(updated_at) OVER (PARTITION BY user_id ORDER BY updated_at, seq) AS valid_to FROM ve)
"""

HISTORY_SQL = _VERIFY_SQL + """
SELECT h.user_id, s.name, COALESCE(NULLIF(trim(s.company), ''), s.name) AS company, h.status, h.notes,
       h.updated_by, h.updated_at AS valid_from, h.valid_to, h.valid_to IS NULL AS is_current
FROM h LEFT JOIN b_suppliers s ON s.user_id = h.user_id
"""


@register("verification_history", covers=("K11",), sql=HISTORY_SQL)
def verification_history(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return ev.verification_history(verification_events(mk), mk.suppliers)


LOG_SQL = _VERIFY_SQL + """
SELECT h.user_id, s.name AS user_name, COALESCE(NULLIF(trim(s.company), ''), s.name) AS user_company,
       h.status, h.notes, h.updated_by, h.updated_at
FROM h LEFT JOIN b_suppliers s ON s.user_id = h.user_id
"""


@register("verification_log", covers=("K12", "L6", "F12"), sql=LOG_SQL)
def verification_log(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return ev.verification_log(ev.verification_history(verification_events(mk), mk.suppliers))


NOTIFY_SQL = with_views("b_orders") + """
SELECT p.supplier_id AS user_id, p.order_id, 'New Order Received' AS title,
       printf('Order %d includes your products.', p.order_id) AS message, 'order' AS type,
       FALSE AS read, o.created_at
FROM (SELECT DISTINCT l_orderkey AS order_id, l_suppkey AS supplier_id FROM lineitem) p
JOIN b_orders o ON o.order_id = p.order_id
"""


@register("order_notifications", covers=("K13", "J13", "S9"), sql=NOTIFY_SQL)
def order_notifications(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    pairs = mk.order_items.select("order_id", "supplier_id")
    return ev.order_notifications(pairs, mk.orders)


def appeals(mk: Marketplace):
    e = mk.raw("events").where(F.col("event_type") == "error")
    n = mk.raw("part").select(F.count(F.lit(1))).scalar()
    return e.select(F.col("event_id").alias("appeal_id"), "user_id",
                    F.pmod(F.col("event_id"), n).alias("product_id"),
                    F.when(F.pmod("event_id", F.lit(6)) == 0, F.lit("  ")).otherwise(F.col("props")).alias("reason"))


APPEAL_SQL = with_views("b_products") + """
, ap AS (SELECT event_id AS appeal_id, user_id, event_id % (SELECT COUNT(*) FROM part) AS product_id,
                CASE WHEN event_id % 6 = 0 THEN '  ' ELSE props END AS reason
         FROM events WHERE event_type = 'error')
SELECT ap.appeal_id, ap.user_id, ap.product_id,
       CASE WHEN p.supplier_id IS NULL THEN 'not_found' WHEN p.supplier_id <> ap.user_id THEN 'forbidden'
            WHEN length(trim(COALESCE(ap.reason, ''))) = 0 THEN 'missing_reason' ELSE 'accepted' END AS outcome
FROM ap LEFT JOIN b_products p ON p.product_id = ap.product_id
"""


@register("appeal_intake", covers=("K15", "K10"), sql=APPEAL_SQL)
def appeal_intake(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return ev.appeal_intake(appeals(mk), mk.products)


def read_events(mk: Marketplace):
    e = mk.raw("events")
    t = F.col("event_type")
    return e.where(t.isin("view", "signup") | ((t == "error") & (F.pmod("event_id", F.lit(4)) == 0))).select(
        F.when(t == "view", "read").when(t == "signup", "read_all").otherwise("delete").alias("action"),
        "user_id", F.col("ts"),
        F.when(t == "view", F.col("event_id") - 1).when(t == "error", F.col("event_id") - 2)
         .cast("bigint").alias("notification_id"))


READ_SQL = with_views("b_notifications") + """
, re AS (
    SELECT CASE event_type WHEN 'view' THEN 'read' WHEN 'signup' THEN 'read_all' ELSE 'delete' END AS action,
           user_id, ts,
           CASE event_type WHEN 'view' THEN event_id - 1 WHEN 'error' THEN event_id - 2 END AS notification_id
    FROM events WHERE event_type IN ('view', 'signup') OR (event_type = 'error' AND event_id % 4 = 0))
, one AS (SELECT n.notification_id, MIN(r.ts) AS read_one FROM b_notifications n
          JOIN re r ON r.action = 'read' AND r.notification_id = n.notification_id AND r.ts >= n.created_at
          GROUP BY n.notification_id)
, alls AS (SELECT n.notification_id, MIN(r.ts) AS read_all FROM b_notifications n
           JOIN re r ON r.action = 'read_all' AND r.user_id = n.user_id AND r.ts >= n.created_at
           GROUP BY n.notification_id)
SELECT n.notification_id, n.user_id, n.created_at,
       n.read OR LEAST(one.read_one, alls.read_all) IS NOT NULL AS read,
       LEAST(one.read_one, alls.read_all) AS read_at
FROM b_notifications n LEFT JOIN one ON one.notification_id = n.notification_id
LEFT JOIN alls ON alls.notification_id = n.notification_id
WHERE n.notification_id NOT IN (SELECT notification_id FROM re WHERE action = 'delete')
"""


@register("notification_read_state", covers=("K14",), sql=READ_SQL)
def notification_read_state(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return ev.read_state(mk.notifications, read_events(mk))
