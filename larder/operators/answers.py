"""Chat answers (T10): every classified message with its response type and data.

Each branch of the routing runs once over the messages it concerns and gives at most one
JSON value per message; the branches are disjoint, so their union is the table of
answers. Look-ups are those of ``lookup`` (T5-T9); a price, stock or category question
without a product or category falls back to the product search, as an unknown question
does. Administrators and suppliers are not told apart here: users are buyers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators import lookup as lk
from larder.operators import reviews as rv

KEY = ["conv_id", "turn"]
RECENT = 50                    # orders of a user that a short id is looked up in
# Texts of the answers
LOGIN_ORDERS = "Please log in to track your orders."
LOGIN_ORDERS_TEXT = "To track your orders, please sign in to your account."
LOGIN_NOTES = "Please log in to view your recent notifications."
NO_ORDER_ID = "Please provide a specific Order ID to track."
NOT_FOUND, FORBIDDEN = "Order not found.", "You are not authorised to view this order."
NO_PRODUCT = "I couldn't identify the product you're asking about. Here are some of our available products:"
NO_CATEGORY = "Here are some of our available products:"
NO_MATCH = "I couldn't find a direct match for your request. Here are some products you might be looking for:"


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _products(rows: DataFrame, name: str = "products") -> DataFrame:
    """The rows of each message as one ordered array (at most the results of a look-up)."""
    item = F.struct("name", "price", "stock", "category")
    return rows.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("i")))), lambda x: x["i"]).alias(name))


def display_id(order_id: Column) -> Column:
    return F.lpad(order_id.cast("string"), 24, "0")


def find_orders(asked: DataFrame, orders: DataFrame) -> DataFrame:
    """``KEY``, ``found`` (order id or null) and ``own``.

    A full id is an equi join on the order; a short one is tested against the start and
    end of the ids of the user's ``RECENT`` newest orders, newest first.
    """
    code = F.upper("order_id")
    full = asked.where(F.length("order_id") == 24).select(*KEY, "user_id", code.alias("code"))
    o = orders.select(F.col("order_id").alias("found"), F.col("buyer_id"), F.upper(display_id(F.col("order_id"))).alias("id"))
    full = full.join(o, F.col("code") == F.col("id"), "left").select(*KEY, "found", F.col("buyer_id").eqNullSafe(F.col("user_id")).alias("own"))
    newest = Window.partitionBy("buyer_id").orderBy(F.desc("created_at"), F.desc("order_id"))
    recent = (orders.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= RECENT)
              .select(F.col("buyer_id").alias("user_id"), F.col("order_id").alias("oid"), "place", F.upper(display_id(F.col("order_id"))).alias("id")))
    short = asked.where(F.length("order_id") != 24).select(*KEY, "user_id", code.alias("code"))
    hits = (short.join(recent, "user_id").where(F.col("id").endswith(F.col("code")) | F.col("id").startswith(F.col("code")))
            .groupBy(*KEY).agg(F.min_by("oid", "place").alias("found")))
    short = short.select(*KEY).join(hits, KEY, "left").select(*KEY, "found", F.lit(True).alias("own"))
    return full.unionByName(short)


def answers(messages: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, notifications: DataFrame,
            reviews: DataFrame, users: DataFrame) -> DataFrame:
    """``conv_id, turn, user_id, intent, response_type, data``.

    ``messages`` are classified (intent, order_id, category, product_name, message) with
    user_id null for guests, and are read by every branch: hand in a stored table.
    """
    i, guest = F.col("intent"), F.col("user_id").isNull()
    head = [*KEY, "user_id", "intent"]
    out = []

    def add(rows, kind, data):
        out.append(rows.select(*head, F.lit(kind).alias("response_type"), data.alias("data")))

    no = F.lit(False).alias("orderFound")
    about_orders = messages.where(i == "ORDER_STATUS")
    add(about_orders.where(guest), "order_status", _json(no, F.lit(LOGIN_ORDERS).alias("error"), F.lit(LOGIN_ORDERS_TEXT).alias("text")))
    mine = about_orders.where(~guest)
    asked = mine.where(F.col("order_id").isNotNull()).join(find_orders(mine.where(F.col("order_id").isNotNull()), orders), KEY)
    refused = F.when(F.col("found").isNull(), NOT_FOUND).when(~F.col("own"), FORBIDDEN)
    add(asked.where(refused.isNotNull()), "order_status", _json(no, refused.alias("error"), F.when(F.col("found").isNull(), 404).otherwise(403).alias("status")))
    good = asked.where(refused.isNull()).drop("order_id")
    wanted = good.select(F.col("found").alias("order_id")).distinct()
    o = orders.join(wanted, "order_id", "left_semi")
    line = F.struct("status", "label", "completed", "error")
    steps = lk.order_timeline(o).withColumnRenamed("step_status", "status").groupBy("order_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", line.alias("i")))), lambda x: x["i"]).alias("timeline"))
    names = products.select("product_id", "name")
    bought = items.join(wanted, "order_id", "left_semi").join(names, "product_id", "left").groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("name", "quantity"))).alias("items"))
    detail = o.join(steps, "order_id").join(bought, "order_id", "left").select(F.col("order_id").alias("found"), F.struct(
        display_id(F.col("order_id")).alias("orderId"), "status", F.col("payment_method").alias("paymentMethod"),
        F.col("payment_status").alias("paymentStatus"), "total", _time("created_at").alias("createdAt"), "items", "timeline").alias("order"))
    add(good.join(detail, "found"), "order_status", _json(F.lit(True).alias("orderFound"), F.col("order")))
    recent = lk.recent_orders(orders, items).groupBy(F.col("buyer_id").alias("user_id")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.struct(display_id(F.col("order_id")).alias("orderId"), "status", "total",
                                                              F.col("item_count").alias("itemCount")).alias("i")))), lambda x: x["i"]).alias("recentOrders"))
    open_ = mine.where(F.col("order_id").isNull()).join(recent, "user_id", "left")
    kind = "array<struct<orderId:string,status:string,total:double,itemCount:bigint>>"
    add(open_, "order_status", _json(no, F.lit(NO_ORDER_ID).alias("error"),
                                     F.coalesce(F.col("recentOrders").cast(kind), F.array().cast(kind)).alias("recentOrders")))

    item = "struct<name:string,price:double,stock:int,category:string>"
    none = F.array().cast(f"array<{item}>")
    about = messages.where(i.isin("PRODUCT_PRICE", "PRODUCT_STOCK") & F.col("product_name").isNotNull())
    found = lk.product_lookup(about, products, KEY)
    hit = found.where("kind = 'product'").select(*KEY, F.struct("name", "price", "stock", "category").cast(item).alias("product"))
    others = _products(found.where("kind = 'alternative'"), "alternatives")
    told = about.join(hit, KEY, "left").join(others, KEY, "left")
    add(told, "product_info", _json(
        F.when(i == "PRODUCT_PRICE", "price").otherwise("stock").alias("queryType"), F.col("product_name").alias("productName"), "product",
        F.coalesce(F.col("product.stock") > 0, F.lit(False)).alias("inStock"), F.coalesce(F.col("alternatives").cast(f"array<{item}>"), none).alias("alternatives")))

    in_category = messages.where((i == "CATEGORY_SEARCH") & F.col("category").isNotNull())
    listed = _products(lk.category_search(in_category, products, KEY))
    add(in_category.join(listed, KEY, "left"), "category_search",
        _json("category", F.coalesce(F.col("products").cast(f"array<{item}>"), none).alias("products")))

    lost = messages.where((i == "FALLBACK_SEARCH") | (i.isin("PRODUCT_PRICE", "PRODUCT_STOCK") & F.col("product_name").isNull())
                          | ((i == "CATEGORY_SEARCH") & F.col("category").isNull()))
    said = F.when(i == "FALLBACK_SEARCH", NO_MATCH).when(i == "CATEGORY_SEARCH", NO_CATEGORY).otherwise(NO_PRODUCT)
    offered = _products(lk.search_fallback(lost, products, KEY))
    add(lost.join(offered, KEY, "left"), "fallback", _json(said.alias("message"), F.coalesce(F.col("products").cast(f"array<{item}>"), none).alias("products")))

    notes = messages.where(i == "NOTIFICATIONS")
    zero = F.lit(0).cast("long")
    add(notes.where(guest), "notifications", _json(zero.alias("unreadCount"), F.array().cast("array<string>").alias("notifications"),
                                                   F.lit(LOGIN_NOTES).alias("text")))
    note = F.struct(F.col("notification_id").alias("id"), "title", "type", "read", _time("created_at").alias("createdAt"))
    last = rv.recent_notifications(notifications).groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", note.alias("i")))), lambda x: x["i"]).alias("notifications"))
    shape = "array<struct<id:bigint,title:string,type:string,read:boolean,createdAt:string>>"
    seen = notes.where(~guest).join(rv.unread_counts(notifications), "user_id", "left").join(last, "user_id", "left")
    add(seen, "notifications", _json(F.coalesce("unread_count", zero).alias("unreadCount"),
                                     F.coalesce(F.col("notifications").cast(shape), F.array().cast(shape)).alias("notifications")))

    top = rv.platform_review_summary(reviews)
    review = F.struct(F.col("review_id").alias("id"), F.col("user_name").alias("userName"), "rating", _time("created_at").alias("createdAt"))
    latest = top.select(F.transform(F.array_sort(F.collect_list(F.struct(F.col("created_at").alias("t"), F.col("review_id").alias("r"), review.alias("i")))),
                                    lambda x: x["i"]).alias("r"))
    mean = F.coalesce(top.select(F.max("average_rating")).scalar(), F.lit(5.0))
    add(messages.where(i == "REVIEWS"), "reviews", _json(mean.alias("averageRating"), F.reverse(latest.scalar()).alias("reviews")))

    named = users.select("user_id", F.col("name").alias("userName"))
    helped = messages.where(i == "GENERAL_HELP").join(named, "user_id", "left")
    add(helped, "general_help", _json(F.when(guest, "Guest").otherwise(F.coalesce("userName", F.lit("Trader"))).alias("userName")))

    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
