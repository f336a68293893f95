"""Data-quality and profile operators: masking (P11), schema rules (P13),
keyword fills and rewrites (P14, P15), registration normalisation (P18),
partial updates (P20), profiles (A30), group-mean fill (A31), routing (T10)
and the order/review rule joins (J6, J11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.functions.columns import mask_tail

# Fixed values
PRODUCT_CATEGORIES = ["Fish", "Meat", "Vegetables", "Dairy", "Grains", "Other"]
INVOICE_STATUSES = ["Paid", "Unpaid", "Overdue"]
REVIEW_STATUSES = ["pending", "approved", "rejected"]
ROLES_OPEN_TO_SIGNUP = ["buyer", "supplier"]
LOCAL_UPLOAD_PREFIX = "/uploads/"


def mask_bank_details(users: DataFrame) -> DataFrame:
    """Account number -> '****' + last 4, sort code -> '**-**-' + last
    2, only when longer than 4 characters."""
    return users.withColumn("account_number", mask_tail("account_number", 4, "****")) \
                .withColumn("sort_code", mask_tail("sort_code", 2, "**-**-"))


def validate(df: DataFrame, rules: Sequence[tuple[str, Column]], unique: Sequence[str] = ()) -> DataFrame:
    """Every rule is (code, condition that must hold); adds
    ``violations`` (comma-joined codes, '' when valid) and ``valid``.
    Uniqueness of ``unique`` columns is checked with a per-key count joined
    back (an aggregate, so a hot key is counted map-side)."""
    codes = [F.when(~F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules]
    out = df
    if unique:
        counts = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("_dup"))
        out = out.join(counts, list(unique), "left")
        codes.append(F.when(F.col("_dup") > 1, F.lit("unique_" + "_".join(unique))))
    v = F.array_join(F.filter(F.array(*codes), lambda x: x.isNotNull()), ",")
    out = out.withColumn("violations", v).withColumn("valid", F.col("violations") == "")
    return out.drop("_dup") if unique else out


def product_rules() -> list[tuple[str, Column]]:
    return [("name_required", F.length(F.trim(F.col("name"))) > 0),
            ("category_enum", F.col("category").isin(*PRODUCT_CATEGORIES)),
            ("price_min_0", F.col("price") >= 0),
            ("stock_min_0", F.col("stock") >= 0)]


def review_rules() -> list[tuple[str, Column]]:
    return [("rating_range", F.col("rating").between(1, 5)),
            ("status_enum", F.col("status").isin(*REVIEW_STATUSES)),
            ("user_required", F.col("user_id").isNotNull())]


def fill_by_keyword(df: DataFrame, text: str, target: str, table: Sequence[tuple[str, str]]) -> DataFrame:
    """When ``target`` is empty or a local upload path, the value for the
    first keyword (table order) found in lower(text); else unchanged."""
    t = F.lower(F.col(text))
    pick = F.coalesce(*[F.when(t.contains(k), F.lit(v)) for k, v in table])
    replace = F.coalesce(F.col(target), F.lit("")).isin("") | F.col(target).startswith(LOCAL_UPLOAD_PREFIX)
    new = F.when(replace & pick.isNotNull(), pick).otherwise(F.col(target))
    return df.withColumn("changed", ~F.col(target).eqNullSafe(new)).withColumn(target, new)


def reset_local(df: DataFrame, col: str) -> DataFrame:
    """A local upload path becomes '' (with a changed flag to count)."""
    local = F.col(col).startswith(LOCAL_UPLOAD_PREFIX)
    return df.withColumn("changed", F.coalesce(local, F.lit(False))) \
             .withColumn(col, F.when(local, F.lit("")).otherwise(F.col(col)))


def normalise_registrations(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Role limited to buyer/supplier (else buyer); e-mail lower/trim;
    refused when the e-mail already exists or an earlier request in the same
    batch used it (first by time, then id)."""
    email = F.lower(F.trim(F.col("email")))
    r = requests.withColumn("email", email).withColumn(
        "role", F.when(F.col("role").isin(*ROLES_OPEN_TO_SIGNUP), F.col("role")).otherwise("buyer"))
    known = existing.select(F.lower(F.trim(F.col("email"))).alias("email")).distinct() \
                    .withColumn("_known", F.lit(True))
    w = Window.partitionBy("email").orderBy("requested_at", "request_id")
    r = r.join(known, "email", "left").withColumn("_n", F.row_number().over(w))
    outcome = (F.when(F.col("_known"), "duplicate_email").when(F.col("_n") > 1, "duplicate_in_batch")
               .otherwise("registered"))
    return r.select("request_id", "name", "email", "role", outcome.alias("outcome"))


def partial_update(base: DataFrame, patch: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """P20: the latest patch per key sets only the fields it supplies
    (non-NULL); other fields keep their value."""
    last = patch.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(),
                                                              F.struct("patched_at", "patch_id"))).alias(f"_p_{c}")
                                    for c in cols])
    j = base.join(last, key, "left")
    return j.select(*[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in base.columns],
                    F.array_join(F.filter(F.array(*[F.when(F.col(f"_p_{c}").isNotNull(), F.lit(c)) for c in cols]),
                                          lambda x: x.isNotNull()), ",").alias("updated_fields"))


def profile(df: DataFrame, date_col: str, key: str, category: str) -> DataFrame:
    """Rows, distinct keys, the sorted category list, date range."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("distinct_keys"),
                  F.array_join(F.array_sort(F.collect_set(category)), ",").alias("categories"),
                  F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"))


def fill_with_group_mean(df: DataFrame, col: str, group: Sequence[str], source: str | None = None) -> DataFrame:
    """NULLs of ``col`` take the group mean of ``source`` (default the
    column itself): an aggregate joined back on the group keys."""
    src = source or col
    means = df.groupBy(*group).agg(F.avg(src).alias("_gm"))
    return df.join(means, list(group), "left").withColumn(col, F.coalesce(F.col(col), F.col("_gm"))).drop("_gm")


# Response types per intent (fixed values)
RESPONSE_TYPES = {"ORDER_STATUS": "order_status", "PRODUCT_PRICE": "product_info", "PRODUCT_STOCK": "product_info",
                  "CATEGORY_SEARCH": "category_products", "NOTIFICATIONS": "notifications", "REVIEWS": "reviews",
                  "GENERAL_HELP": "help", "FALLBACK_SEARCH": "search_results"}
LOGIN_REQUIRED = ["ORDER_STATUS", "NOTIFICATIONS"]


def route(classified: DataFrame) -> DataFrame:
    """Response type per classified message; guests asking for orders
    or notifications are told to log in; order questions with an id get the
    order details, others the recent orders; a price, stock or category
    question that names none is searched for."""
    i = F.col("intent")
    rtype = F.coalesce(*[F.when(i == k, F.lit(v)) for k, v in RESPONSE_TYPES.items()])
    guest = F.col("user_id").isNull()
    lost = (i.isin("PRODUCT_PRICE", "PRODUCT_STOCK") & F.col("product_name").isNull()) | ((i == "CATEGORY_SEARCH") & F.col("category").isNull())
    rtype = (F.when(guest & i.isin(*LOGIN_REQUIRED), "login_required").when(lost, "search_results")
             .when((i == "ORDER_STATUS") & F.col("order_id").isNull(), "recent_orders")
             .when(i == "ORDER_STATUS", "order_details").otherwise(rtype))
    return classified.select("conv_id", "turn", "user_id", "intent", rtype.alias("response_type"))


def match_short_ids(requests: DataFrame, orders: DataFrame, recent: int = 50) -> DataFrame:
    """A short order code matches the end or the start of the upper-case
    order id among the user's ``recent`` newest orders (a bounded candidate
    set per user: equi join on the buyer, then the string test)."""
    w = Window.partitionBy("buyer_id").orderBy(F.desc("created_at"), F.desc("order_id"))
    cand = (orders.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= recent)
            .select(F.col("buyer_id").alias("user_id"), "order_id", "created_at",
                    F.upper(F.col("order_id").cast("string")).alias("_oid")))
    code = F.upper(F.trim(F.col("code")))
    j = requests.join(cand, "user_id").where(F.col("_oid").endswith(code) | F.col("_oid").startswith(code))
    w2 = Window.partitionBy("request_id").orderBy(F.desc("created_at"), F.desc("order_id"))
    return (j.withColumn("_k", F.row_number().over(w2)).where(F.col("_k") == 1)
            .select("request_id", "user_id", "code", "order_id"))


def review_eligibility(requests: DataFrame, orders: DataFrame, items: DataFrame, reviews: DataFrame) -> DataFrame:
    """A review needs a Delivered order of the user (semi join), the
    product inside that order (semi join on items) and no earlier review by
    the same user for that product (anti join)."""
    own = orders.where(F.col("status") == "Delivered").select("order_id", F.col("buyer_id").alias("user_id"))
    in_order = items.select("order_id", "product_id").distinct()
    prior = reviews.where(F.col("product_id").isNotNull()).select("user_id", "product_id").distinct()
    ok_order = requests.join(own, ["order_id", "user_id"], "left_semi").select("request_id").withColumn("_o", F.lit(True))
    ok_prod = requests.join(in_order, ["order_id", "product_id"], "left_semi").select("request_id") \
                      .withColumn("_p", F.lit(True))
    dup = requests.join(prior, ["user_id", "product_id"], "left_semi").select("request_id").withColumn("_d", F.lit(True))
    r = requests.join(ok_order, "request_id", "left").join(ok_prod, "request_id", "left") \
                .join(dup, "request_id", "left")
    outcome = (F.when(F.col("_o").isNull(), "order_not_delivered_or_not_own")
               .when(F.col("_p").isNull(), "product_not_in_order")
               .when(F.col("_d").isNotNull(), "already_reviewed").otherwise("eligible"))
    return r.select("request_id", "user_id", "order_id", "product_id", outcome.alias("outcome"))


def submit_reviews(requests: DataFrame, orders: DataFrame, items: DataFrame, existing: DataFrame) -> DataFrame:
    """J6 over a log of submissions (request_id, user_id, order_id, product_id, rating, requested_at).

    Checked in this order: rating 1 to 5, an order, the order own and delivered, the
    product (if any) part of it, no earlier review of the product by the user, or of the
    order if there is no product. An accepted submission is an earlier review for those
    after it: of the submissions that pass, the first one of a thing is accepted.
    ``existing`` has user_id, product_id and, where that is null, order_id.
    """
    own = orders.where(F.col("status") == "Delivered").select("order_id", F.col("buyer_id").alias("user_id"), F.lit(True).alias("_own"))
    sold = items.select("order_id", "product_id").distinct().withColumn("_sold", F.lit(True))
    of_product = existing.where(F.col("product_id").isNotNull()).select("user_id", "product_id").distinct().withColumn("_p", F.lit(True))
    of_order = existing.where(F.col("product_id").isNull()).select("user_id", "order_id").distinct().withColumn("_o", F.lit(True))
    r = (requests.join(own, ["order_id", "user_id"], "left").join(sold, ["order_id", "product_id"], "left")
         .join(of_product, ["user_id", "product_id"], "left").join(of_order, ["user_id", "order_id"], "left"))
    whole = F.col("product_id").isNull()
    refused = (F.when(~F.coalesce(F.col("rating").between(1, 5), F.lit(False)), "invalid_rating").when(F.col("order_id").isNull(), "order_required")
               .when(F.col("_own").isNull(), "order_not_delivered_or_not_own").when(~whole & F.col("_sold").isNull(), "product_not_in_order")
               .when(~whole & F.col("_p").isNotNull(), "product_already_reviewed").when(whole & F.col("_o").isNotNull(), "order_already_reviewed"))
    r = r.withColumn("_refused", refused).withColumn("_thing", F.when(whole, F.col("order_id")))
    thing = ["user_id", "product_id", "_thing"]
    first = r.where(F.col("_refused").isNull()).groupBy(*thing).agg(F.min(F.struct("requested_at", "request_id")).alias("_first"))
    first = first.select(*[F.col(c).alias(f"_{c}") for c in thing], "_first")
    same = (F.col("user_id") == F.col("_user_id")) & F.col("product_id").eqNullSafe(F.col("_product_id")) & F.col("_thing").eqNullSafe(F.col("__thing"))
    r = r.join(first, same, "left")
    late = F.struct("requested_at", "request_id") > F.col("_first")
    again = F.when(whole, "order_already_reviewed").otherwise("product_already_reviewed")
    return r.select(*requests.columns, F.coalesce("_refused", F.when(late, again), F.lit("accepted")).alias("outcome"))
