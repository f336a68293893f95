"""Queries whose derived requests reach every outcome: review submissions (J6), invoice
payments (K4), new suppliers (A2), deep pages (L2).

Derived tables (fixed rules):
  review submissions  one per order with id mod 3 = 0 and a second one a day later for ids mod
                      5 = 0; a wrong user for mod 7 = 0, no order for mod 11 = 0, a product
                      (of the first line) for even ids, another one for mod 13 = 0, rating 0
                      for mod 17 = 0
  order reviews       a platform review (no product) belongs to the order of its id
  payment attempts    by the buyer one and three days after each order with id mod 4 <> 0,
                      by another user two days after for ids mod 6 = 0, of an unknown
                      invoice for ids mod 50 = 0
  supplier created    id mod 90 days before "now"
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import billing as bl
from larder.operators import paging as pg
from larder.operators import quality as q
from larder.plans.billing import PAY_SQL
from larder.plans.catalogue import BUYER_SQL, _visible
from larder.plans.registry import register
from larder.plans.sql_binding import VIEWS, with_views
from larder.session import checkpoint_dir
from larder.sources.binding import AS_OF, Marketplace


def submissions(mk: Marketplace):
    o = mk.orders.where(F.pmod("order_id", F.lit(3)) == 0)
    k = F.col("order_id")
    line = mk.raw("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("l"))
    o = o.join(line, "order_id", "left")
    part = F.col("l.l_partkey")
    product = F.when(F.pmod(k, F.lit(13)) == 0, part + 1).when(F.pmod(k, F.lit(2)) == 0, part)
    times = F.explode(F.when(F.pmod(k, F.lit(5)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return o.select((k * 2).alias("request_id"), (F.col("buyer_id") + F.when(F.pmod(k, F.lit(7)) == 0, 1).otherwise(0)).alias("user_id"),
                    F.when(F.pmod(k, F.lit(11)) != 0, k).alias("order_id"), product.alias("product_id"),
                    F.when(F.pmod(k, F.lit(17)) == 0, 0).otherwise(F.pmod(k, F.lit(5)) + 1).cast("int").alias("rating"),
                    F.col("created_at"), times.alias("nth")).select(
        (F.col("request_id") + F.col("nth")).alias("request_id"), "user_id", "order_id", "product_id", "rating",
        (F.col("created_at") + F.make_dt_interval(days=F.col("nth"))).alias("requested_at"))


SUBMIT_SQL = with_views("b_orders", "b_reviews") + """
, ln AS (SELECT l_orderkey AS order_id, min({'a': l_linenumber, 'b': l_partkey}).b AS part FROM lineitem GROUP BY 1)
, sub AS (
    SELECT o.order_id * 2 + nth AS request_id, buyer_id + CASE WHEN o.order_id % 7 = 0 THEN 1 ELSE 0 END AS user_id,
           CASE WHEN o.order_id % 11 <> 0 THEN o.order_id END AS order_id,
           CASE WHEN o.order_id % 13 = 0 THEN part + 1 WHEN o.order_id % 2 = 0 THEN part END AS product_id,
           CASE WHEN o.order_id % 17 = 0 THEN 0 ELSE o.order_id % 5 + 1 END AS rating, created_at + to_days(nth) AS requested_at
    FROM b_orders o LEFT JOIN ln ON ln.order_id = o.order_id, (VALUES (0), (1)) n(nth)
    WHERE o.order_id % 3 = 0 AND (nth = 0 OR o.order_id % 5 = 0))
, fixed AS (
    SELECT s.*, CASE WHEN rating < 1 OR rating > 5 THEN 'invalid_rating' WHEN order_id IS NULL THEN 'order_required'
        WHEN NOT EXISTS (SELECT 1 FROM b_orders o WHERE o.order_id = s.order_id AND o.buyer_id = s.user_id AND o.status = 'Delivered') THEN 'order_not_delivered_or_not_own'
        WHEN product_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = s.order_id AND l.l_partkey = s.product_id) THEN 'product_not_in_order'
        WHEN product_id IS NOT NULL AND EXISTS (SELECT 1 FROM b_reviews r WHERE r.user_id = s.user_id AND r.product_id = s.product_id) THEN 'product_already_reviewed'
        WHEN product_id IS NULL AND EXISTS (SELECT 1 FROM b_reviews r WHERE r.user_id = s.user_id AND r.product_id IS NULL AND r.review_id = s.order_id) THEN 'order_already_reviewed'
        END AS refused FROM sub s)
SELECT request_id, user_id, order_id, product_id,
       CASE WHEN refused IS NOT NULL THEN refused
            WHEN ROW_NUMBER() OVER (PARTITION BY refused IS NULL, user_id, product_id, CASE WHEN product_id IS NULL THEN order_id END
                                    ORDER BY requested_at, request_id) > 1
            THEN CASE WHEN product_id IS NULL THEN 'order_already_reviewed' ELSE 'product_already_reviewed' END
            ELSE 'accepted' END AS outcome
FROM fixed
"""


@register("review_submissions", covers=("J6",), sql=SUBMIT_SQL)
def review_submissions(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    existing = mk.reviews.select("user_id", "product_id", F.when(F.col("product_id").isNull(), F.col("review_id")).alias("order_id"))
    return q.submit_reviews(submissions(mk), mk.orders, mk.order_items, existing).select("request_id", "user_id", "order_id", "product_id", "outcome")


def payment_attempts(mk: Marketplace):
    o, k = mk.orders, F.col("order_id")

    def attempts(n, keep, user, days, invoice=k):
        return o.where(keep).select((k * 4 + n).alias("request_id"), invoice.alias("invoice_id"), user.alias("user_id"),
                                    (F.col("created_at") + F.make_dt_interval(days=F.lit(days))).alias("requested_at"))

    own = F.pmod(k, F.lit(4)) != 0
    buyer = F.col("buyer_id")
    return (attempts(0, own, buyer, 1).unionByName(attempts(1, own, buyer, 3)).unionByName(attempts(2, F.pmod(k, F.lit(6)) == 0, buyer + 1, 2))
            .unionByName(attempts(3, F.pmod(k, F.lit(50)) == 0, buyer, 2, k + 1_000_000_000_000)))


ATTEMPTS_SQL = PAY_SQL.replace(VIEWS["b_payment_requests"][1].strip(), """SELECT * FROM (
        SELECT o_orderkey * 4 AS request_id, o_orderkey AS invoice_id, o_custkey AS user_id, o_orderdate + INTERVAL 1 DAY AS requested_at FROM orders WHERE o_orderkey % 4 <> 0
        UNION ALL SELECT o_orderkey * 4 + 1, o_orderkey, o_custkey, o_orderdate + INTERVAL 3 DAY FROM orders WHERE o_orderkey % 4 <> 0
        UNION ALL SELECT o_orderkey * 4 + 2, o_orderkey, o_custkey + 1, o_orderdate + INTERVAL 2 DAY FROM orders WHERE o_orderkey % 6 = 0
        UNION ALL SELECT o_orderkey * 4 + 3, o_orderkey + 1000000000000, o_custkey, o_orderdate + INTERVAL 2 DAY FROM orders WHERE o_orderkey % 50 = 0)""")


@register("invoice_payment_attempts", covers=("K4", "P17"), sql=ATTEMPTS_SQL)
def invoice_payment_attempts(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    return bl.pay_invoices(payment_attempts(mk), mk.invoices)


NEW_SQL = with_views("b_suppliers") + f"""
SELECT COUNT(*) AS total_suppliers, COUNT(*) FILTER (DATE '{AS_OF}' - to_days(CAST(user_id % 90 AS INTEGER)) >= DATE '{AS_OF}' - INTERVAL 30 DAY)
       AS new_suppliers FROM b_suppliers
"""


@register("new_suppliers", covers=("A2",), sql=NEW_SQL)
def new_suppliers(spark, sf_dir):
    """A2: suppliers in all and those who joined in the last 30 days."""
    s = Marketplace(spark, sf_dir).suppliers
    now = F.to_date(F.lit(AS_OF))
    joined = F.date_sub(now, F.pmod("user_id", F.lit(90)).cast("int"))
    return s.agg(F.count("*").alias("total_suppliers"), F.count_if(joined >= F.date_sub(now, 30)).alias("new_suppliers"))


DEEP_SQL = f"""
WITH v AS ({BUYER_SQL}), n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY product_id DESC) - 1 AS ordinal, COUNT(*) OVER () AS total FROM v)
SELECT * EXCLUDE (total) FROM n WHERE ordinal // 20 = CAST(ceil(total / 20.0) AS BIGINT) // 2
"""


@register("catalogue_deep_page", covers=("L2",), sql=DEEP_SQL)
def catalogue_deep_page(spark, sf_dir, limit=20):
    """The page in the middle of the catalogue, newest first, by the page index."""
    import uuid
    path = f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    total = pg.write_page_index(_visible(spark, sf_dir, role="buyer"), [F.desc("product_id")], path)
    return pg.read_page(spark, path, pg.pages(total, limit) // 2 + 1, limit)
