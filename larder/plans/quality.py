"""Data-quality, profile and routing queries: P11, P13-P15, P18, P20,
F14-F16, A30, A31, W4, J6, J11, J15, M2, T10.

Derived inputs (fixed rules): supplier bank fields and avatars from the
supplier key; product images from the part key; registrations from signup
events; product patches from click events; short-code look-ups from click
events; review submissions from purchase events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.columns import round_half_up
from larder.operators import features as fe
from larder.operators import quality as q
from larder.operators.catalogue import selling_price
from larder.plans import series
from larder.plans.registry import register
from larder.plans.sql_binding import with_views
from larder.plans.sqlfrag import rnd
from larder.sources.binding import Marketplace

IMAGE_TABLE = [("anvil", "/img/anvil.png"), ("bolt", "/img/bolt.png"), ("gear", "/img/gear.png"),
               ("gizmo", "/img/gizmo.png"), ("ring", "/img/ring.png"), ("widget", "/img/widget.png")]


def _bank(mk):
    k = F.col("user_id")
    acct = F.when(F.pmod(k, F.lit(9)) == 0, F.pmod(k, F.lit(1000)).cast("string")) \
            .otherwise(F.lpad(F.pmod(k * 7919, F.lit(100000000)).cast("string"), 8, "0"))
    sort = F.concat_ws("-", *[F.lpad(F.pmod(k * m, F.lit(100)).cast("string"), 2, "0") for m in (1, 7, 13)])
    return mk.suppliers.select("user_id", "name", acct.alias("account_number"), sort.alias("sort_code"))


MASK_SQL = with_views("b_suppliers") + """
, b AS (SELECT user_id, name,
               CASE WHEN user_id % 9 = 0 THEN CAST(user_id % 1000 AS VARCHAR)
                    ELSE lpad(CAST((user_id * 7919) % 100000000 AS VARCHAR), 8, '0') END AS account_number,
               lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST((user_id * 7) % 100 AS VARCHAR), 2, '0')
                   || '-' || lpad(CAST((user_id * 13) % 100 AS VARCHAR), 2, '0') AS sort_code
        FROM b_suppliers)
SELECT user_id, name,
       CASE WHEN length(account_number) > 4 THEN '****' || right(account_number, 4) ELSE account_number END
           AS account_number,
       CASE WHEN length(sort_code) > 4 THEN '**-**-' || right(sort_code, 2) ELSE sort_code END AS sort_code
FROM b
"""


@register("masked_bank_details", covers=("P11", "F6"), sql=MASK_SQL)
def masked_bank_details(spark, sf_dir):
    return q.mask_bank_details(_bank(Marketplace(spark, sf_dir)))


PRODUCT_VALID_SQL = with_views("b_products") + f"""
SELECT product_id, name, category, price, stock,
       array_to_string(list_filter([
           CASE WHEN NOT COALESCE(length(trim(name)) > 0, false) THEN 'name_required' END,
           CASE WHEN NOT COALESCE(category IN ({", ".join(repr(c) for c in q.PRODUCT_CATEGORIES)}), false)
                THEN 'category_enum' END,
           CASE WHEN NOT COALESCE(price >= 0, false) THEN 'price_min_0' END,
           CASE WHEN NOT COALESCE(stock >= 0, false) THEN 'stock_min_0' END], lambda x: x IS NOT NULL), ',')
           AS violations
FROM b_products
"""
PRODUCT_VALID_SQL = ("SELECT *, violations = '' AS valid FROM (" + PRODUCT_VALID_SQL.replace("WITH ", "WITH ", 1)
                     + ") v")


@register("product_validation", covers=("P13",), sql=PRODUCT_VALID_SQL)
def product_validation(spark, sf_dir):
    p = Marketplace(spark, sf_dir).products.select("product_id", "name", "category", "price", "stock")
    return q.validate(p, q.product_rules())


REVIEW_VALID_SQL = with_views("b_reviews") + """
SELECT review_id, user_id, rating, status, violations, violations = '' AS valid FROM (
  SELECT *, array_to_string(list_filter([
           CASE WHEN NOT COALESCE(rating BETWEEN 1 AND 5, false) THEN 'rating_range' END,
           CASE WHEN NOT COALESCE(status IN ('pending', 'approved', 'rejected'), false) THEN 'status_enum' END,
           CASE WHEN user_id IS NULL THEN 'user_required' END,
           CASE WHEN COUNT(*) OVER (PARTITION BY user_id, created_at) > 1 THEN 'unique_user_id_created_at' END],
           lambda x: x IS NOT NULL), ',') AS violations
  FROM b_reviews) t
"""


@register("review_validation", covers=("P13", "U4"), sql=REVIEW_VALID_SQL)
def review_validation(spark, sf_dir):
    r = Marketplace(spark, sf_dir).reviews.select("review_id", "user_id", "rating", "status", "created_at")
    return q.validate(r, q.review_rules(), unique=["user_id", "created_at"]).select(
        "review_id", "user_id", "rating", "status", "violations", "valid")


def _images(mk):
    k = F.col("product_id")
    img = (F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("/uploads/p"), k.cast("string"), F.lit(".png")))
           .when(F.pmod(k, F.lit(3)) == 1, F.lit(""))
           .otherwise(F.concat(F.lit("https://img.example/p"), k.cast("string"), F.lit(".png"))))
    return mk.products.select("product_id", "name", img.alias("image"))


IMAGE_SQL = with_views("b_products") + """
, p AS (SELECT product_id, name,
               CASE product_id % 3 WHEN 0 THEN '/uploads/p' || CAST(product_id AS VARCHAR) || '.png'
                    WHEN 1 THEN '' ELSE 'https://img.example/p' || CAST(product_id AS VARCHAR) || '.png' END AS image
        FROM b_products)
, x AS (SELECT *, CASE """ + " ".join(f"WHEN contains(lower(name), '{k}') THEN '{v}'" for k, v in IMAGE_TABLE) + """
               END AS pick FROM p)
SELECT product_id, name,
       CASE WHEN (image = '' OR starts_with(image, '/uploads/')) AND pick IS NOT NULL THEN pick ELSE image END AS image,
       (CASE WHEN (image = '' OR starts_with(image, '/uploads/')) AND pick IS NOT NULL THEN pick ELSE image END)
           IS DISTINCT FROM image AS changed
FROM x
"""


@register("product_image_fill", covers=("P14",), sql=IMAGE_SQL)
def product_image_fill(spark, sf_dir):
    return q.fill_by_keyword(_images(Marketplace(spark, sf_dir)), "name", "image", IMAGE_TABLE) \
            .select("product_id", "name", "image", "changed")


AVATAR_SQL = with_views("b_suppliers") + """
SELECT user_id, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'https://img.example/s' || CAST(user_id AS VARCHAR) || '.png' END
           AS avatar, user_id % 3 = 0 AS changed
FROM b_suppliers
"""


@register("supplier_avatar_reset", covers=("P15",), sql=AVATAR_SQL)
def supplier_avatar_reset(spark, sf_dir):
    s = Marketplace(spark, sf_dir).suppliers
    k = F.col("user_id")
    av = F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("/uploads/s"), k.cast("string"), F.lit(".png"))) \
          .otherwise(F.concat(F.lit("https://img.example/s"), k.cast("string"), F.lit(".png")))
    return q.reset_local(s.select("user_id", av.alias("avatar")), "avatar")


def _registrations(mk):
    e = mk.raw("events").where(F.col("event_type") == "signup")
    k = F.col("event_id")
    return e.select(k.alias("request_id"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("name"),
                    F.concat(F.lit(" User"), F.pmod(k, F.lit(2000)).cast("string"), F.lit("@Shop.test ")).alias("email"),
                    F.when(F.pmod(k, F.lit(4)) == 0, "admin").when(F.pmod(k, F.lit(4)) == 1, "supplier")
                     .otherwise("buyer").alias("role"), F.col("ts").alias("requested_at"))


REG_SQL = """
WITH r AS (
    SELECT event_id AS request_id, 'User ' || CAST(user_id AS VARCHAR) AS name,
           lower(trim(' User' || CAST(event_id % 2000 AS VARCHAR) || '@Shop.test ')) AS email,
           CASE event_id % 4 WHEN 0 THEN 'buyer' WHEN 1 THEN 'supplier' ELSE 'buyer' END AS role, ts
    FROM events WHERE event_type = 'signup')
, known AS (SELECT DISTINCT 'user' || CAST(c_custkey AS VARCHAR) || '@shop.test' AS email FROM customer)
SELECT request_id, name, email, role,
       CASE WHEN email IN (SELECT email FROM known) THEN 'duplicate_email'
            WHEN ROW_NUMBER() OVER (PARTITION BY email ORDER BY ts, request_id) > 1 THEN 'duplicate_in_batch'
            ELSE 'registered' END AS outcome
FROM r
"""


@register("registrations", covers=("P18", "J12"), sql=REG_SQL)
def registrations(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    existing = mk.raw("customer").select(
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@shop.test")).alias("email"))
    return q.normalise_registrations(_registrations(mk), existing)


def _patches(mk):
    e = mk.raw("events").where(F.col("event_type") == "click")
    n = mk.raw("part").select(F.count(F.lit(1))).scalar()
    k = F.col("event_id")
    return e.select(k.alias("patch_id"), F.pmod(k, n).alias("product_id"), F.col("ts").alias("patched_at"),
                    F.when(F.pmod(k, F.lit(2)) == 0, F.col("value") * 100).alias("price"),
                    F.when(F.pmod(k, F.lit(3)) == 0, F.col("value").cast("int")).alias("stock"))


PATCH_SQL = with_views("b_products") + """
, pt AS (SELECT event_id AS patch_id, event_id % (SELECT COUNT(*) FROM part) AS product_id, ts AS patched_at,
                CASE WHEN event_id % 2 = 0 THEN value * 100 END AS price,
                CASE WHEN event_id % 3 = 0 THEN CAST(trunc(value) AS INTEGER) END AS stock
         FROM events WHERE event_type = 'click')
, last AS (SELECT product_id,
                  arg_max(price, (patched_at, patch_id)) FILTER (WHERE price IS NOT NULL) AS p_price,
                  arg_max(stock, (patched_at, patch_id)) FILTER (WHERE stock IS NOT NULL) AS p_stock
           FROM pt GROUP BY product_id)
SELECT p.product_id, p.name, COALESCE(l.p_price, p.price) AS price, COALESCE(l.p_stock, p.stock) AS stock,
       array_to_string(list_filter([CASE WHEN l.p_price IS NOT NULL THEN 'price' END,
                                    CASE WHEN l.p_stock IS NOT NULL THEN 'stock' END], lambda x: x IS NOT NULL), ',')
           AS updated_fields,
       CAST(ROUND(CAST(COALESCE(l.p_price, p.price) AS DECIMAL(18,2)) * CAST(1.15 AS DECIMAL(20,10)), 2) AS DOUBLE)
           AS selling_price
FROM b_products p LEFT JOIN last l ON l.product_id = p.product_id
"""


@register("product_patches", covers=("P20", "P9", "K10"), sql=PATCH_SQL)
def product_patches(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    base = mk.products.select("product_id", "name", "price", "stock")
    out = q.partial_update(base, _patches(mk), "product_id", ["price", "stock"])
    return out.withColumn("selling_price", selling_price(F.col("price"), 15.0))


PROPS_SQL = """
SELECT event_type, COUNT(*) AS events, SUM(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_sum,
       MAX(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_max,
       COUNT(DISTINCT user_id) AS users
FROM events GROUP BY event_type
"""


@register("event_props_summary", covers=("F15", "F14"), sql=PROPS_SQL)
def event_props_summary(spark, sf_dir):
    e = Marketplace(spark, sf_dir).raw("events")
    k = F.from_json("props", "k bigint")["k"]
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(k).alias("k_sum"),
                                       F.max(k).alias("k_max"), F.countDistinct("user_id").alias("users"))


HASH_SQL = with_views("b_reviews") + """
SELECT review_id, sha256(CAST(user_id AS VARCHAR)) AS user_hash, rating, status FROM b_reviews
"""


@register("pseudonymised_reviews", covers=("F16",), sql=HASH_SQL)
def pseudonymised_reviews(spark, sf_dir):
    r = Marketplace(spark, sf_dir).reviews
    return r.select("review_id", F.sha2(F.col("user_id").cast("string"), 256).alias("user_hash"), "rating", "status")


PROFILE_SQL = with_views("b_demand") + """
SELECT COUNT(*) AS rows, COUNT(DISTINCT product_id) AS distinct_keys,
       array_to_string(list_sort(list_distinct(list(category))), ',') AS categories,
       MIN(date) AS first_date, MAX(date) AS last_date
FROM b_demand
"""


@register("demand_profile", covers=("A30",), sql=PROFILE_SQL)
def demand_profile(spark, sf_dir):
    return q.profile(Marketplace(spark, sf_dir).demand, "date", "product_id", "category")


FILL_SQL = series.PRODUCT_DAY_SQL + f"""
, l AS (SELECT *, LAG(quantity_sold, 7) OVER (PARTITION BY product_id ORDER BY date) AS lag_7 FROM pd)
, m AS (SELECT category, AVG(quantity_sold) AS gm FROM l GROUP BY category)
SELECT l.product_id, l.category, l.date, l.quantity_sold, {rnd('COALESCE(l.lag_7, m.gm)', 6)} AS lag_7
FROM l JOIN m ON m.category = l.category
"""


@register("lag_filled_with_category_mean", covers=("A31", "J7", "F12"), sql=FILL_SQL)
def lag_filled_with_category_mean(spark, sf_dir):
    pd_ = series.product_day(Marketplace(spark, sf_dir))
    w = fe.series_window("product_id", "date")
    x = pd_.select("product_id", "category", "date", "quantity_sold", F.lag("quantity_sold", 7).over(w).alias("lag_7"))
    out = q.fill_with_group_mean(x, "lag_7", ["category"], "quantity_sold")
    return out.select("product_id", "category", "date", "quantity_sold", round_half_up("lag_7", 6).alias("lag_7"))


EXTREMES_SQL = series.PRODUCT_DAY_SQL + f"""
SELECT product_id, date, quantity_sold,
       {rnd('CASE WHEN COUNT(quantity_sold) OVER w7 >= 3 THEN AVG(quantity_sold) OVER w7 END', 6)} AS rolling_mean_7,
       {rnd('CASE WHEN COUNT(quantity_sold) OVER w7 >= 3 THEN STDDEV_SAMP(quantity_sold) OVER w7 END', 6)} AS rolling_std_7,
       CASE WHEN COUNT(quantity_sold) OVER w7 >= 3 THEN MIN(quantity_sold) OVER w7 END AS rolling_min_7,
       CASE WHEN COUNT(quantity_sold) OVER w7 >= 3 THEN MAX(quantity_sold) OVER w7 END AS rolling_max_7
FROM pd WINDOW w7 AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
"""


@register("product_rolling_extremes", covers=("W4",), sql=EXTREMES_SQL)
def product_rolling_extremes(spark, sf_dir):
    pd_ = series.product_day(Marketplace(spark, sf_dir))
    w = fe.series_window("product_id", "date")
    frame = w.rowsBetween(-7, -1)
    enough = F.count("quantity_sold").over(frame) >= 3
    cols = fe.rolling_features("quantity_sold", [7], w, std="samp")
    out = pd_.select("product_id", "date", "quantity_sold", *cols,
                     F.when(enough, F.min("quantity_sold").over(frame)).alias("rolling_min_7"),
                     F.when(enough, F.max("quantity_sold").over(frame)).alias("rolling_max_7"))
    return out.select("product_id", "date", "quantity_sold", round_half_up("rolling_mean_7", 6).alias("rolling_mean_7"),
                      round_half_up("rolling_std_7", 6).alias("rolling_std_7"), "rolling_min_7", "rolling_max_7")


HOLIDAY_SQL = series.GRID_SQL + """
, cal AS (SELECT DISTINCT date FROM b_demand WHERE is_holiday = 1)
, fut AS (SELECT g.category, CAST(g.hi + to_days(CAST(i AS INTEGER)) AS DATE) AS date
          FROM (SELECT category, MAX(date) AS hi FROM grid GROUP BY category) g, range(1, 15) t(i))
, alld AS (SELECT category, date FROM grid UNION ALL SELECT category, date FROM fut)
SELECT a.category, a.date, CASE WHEN c.date IS NULL THEN 0 ELSE 1 END AS holiday
FROM alld a LEFT JOIN cal c ON c.date = a.date
"""


@register("holiday_regressor", covers=("J15", "J9"), sql=HOLIDAY_SQL)
def holiday_regressor(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    g = series.category_grid(mk).select("category", "date")
    last = g.groupBy("category").agg(F.max("date").alias("hi"))
    fut = last.select("category", F.explode(F.sequence(F.date_add("hi", 1), F.date_add("hi", 14))).alias("date"))
    cal = mk.demand.where(F.col("is_holiday") == 1).select("date").distinct().withColumn("h", F.lit(1))
    return (g.unionByName(fut).join(cal, "date", "left")
            .select("category", "date", F.coalesce("h", F.lit(0)).alias("holiday")))


STD_SQL = series.GRID_SQL + f"""
SELECT category, date, demand,
       {rnd('(demand - AVG(demand) OVER (PARTITION BY category)) / STDDEV_POP(demand) OVER (PARTITION BY category)', 6)}
           AS demand_z
FROM grid
"""


@register("standardised_demand", covers=("M2",), sql=STD_SQL)
def standardised_demand(spark, sf_dir):
    g = series.category_grid(Marketplace(spark, sf_dir))
    st = g.groupBy("category").agg(F.avg("demand").alias("_m"), F.stddev_pop("demand").alias("_s"))
    return g.join(st, "category").select(
        "category", "date", "demand", round_half_up((F.col("demand") - F.col("_m")) / F.col("_s"), 6).alias("demand_z"))


SHORT_SQL = with_views("b_orders") + """
, req AS (SELECT event_id AS request_id, user_id, right(CAST(event_id AS VARCHAR), 2) AS code
          FROM events WHERE event_type = 'click')
, cand AS (SELECT buyer_id AS user_id, order_id, created_at, upper(CAST(order_id AS VARCHAR)) AS oid FROM (
             SELECT *, ROW_NUMBER() OVER (PARTITION BY buyer_id ORDER BY created_at DESC, order_id DESC) AS r
             FROM b_orders) t WHERE r <= 50)
SELECT request_id, user_id, code, order_id FROM (
    SELECT r.request_id, r.user_id, r.code, c.order_id,
           ROW_NUMBER() OVER (PARTITION BY r.request_id ORDER BY c.created_at DESC, c.order_id DESC) AS k
    FROM req r JOIN cand c ON c.user_id = r.user_id
    WHERE ends_with(c.oid, upper(trim(r.code))) OR starts_with(c.oid, upper(trim(r.code)))) t
WHERE k = 1
"""


@register("short_id_matches", covers=("J11", "F2", "F3"), sql=SHORT_SQL)
def short_id_matches(spark, sf_dir):
    mk = Marketplace(spark, sf_dir)
    e = mk.raw("events").where(F.col("event_type") == "click")
    req = e.select(F.col("event_id").alias("request_id"), "user_id",
                   F.substring(F.col("event_id").cast("string"), -2, 2).alias("code"))
    return q.match_short_ids(req, mk.orders, 50)


ELIGIBLE_SQL = with_views("b_orders", "b_reviews") + """
, req AS (SELECT event_id AS request_id, user_id, event_id AS order_id, l_partkey AS product_id
          FROM events JOIN lineitem ON l_orderkey = (events.event_id * 3) % (SELECT COUNT(*) FROM orders)
               AND l_linenumber = 1
          WHERE event_type = 'view')
SELECT request_id, user_id, order_id, product_id,
       CASE WHEN NOT EXISTS (SELECT 1 FROM b_orders o WHERE o.order_id = req.order_id AND o.buyer_id = req.user_id
                             AND o.status = 'Delivered') THEN 'order_not_delivered_or_not_own'
            WHEN NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = req.order_id AND l.l_partkey = req.product_id)
                 THEN 'product_not_in_order'
            WHEN EXISTS (SELECT 1 FROM b_reviews r WHERE r.user_id = req.user_id AND r.product_id = req.product_id)
                 THEN 'already_reviewed'
            ELSE 'eligible' END AS outcome
FROM req
"""


@register("review_eligibility", covers=("J6",), sql=ELIGIBLE_SQL)
def review_eligibility(spark, sf_dir):
    """Review submissions from view events: the user reviews line 1's
    product of order (3 x event id) mod #orders, quoting order = event id."""
    mk = Marketplace(spark, sf_dir)
    n = mk.raw("orders").select(F.count(F.lit(1))).scalar()
    e = mk.raw("events").where(F.col("event_type") == "view").select(
        "event_id", "user_id", F.pmod(F.col("event_id") * 3, n).alias("l_orderkey"))
    li = mk.raw("lineitem").where(F.col("l_linenumber") == 1).select("l_orderkey", "l_partkey")
    req = e.join(li, "l_orderkey").select(F.col("event_id").alias("request_id"), "user_id",
                                          F.col("event_id").alias("order_id"), F.col("l_partkey").alias("product_id"))
    return q.review_eligibility(req, mk.orders, mk.order_items, mk.reviews)
