"""Catalogue look-ups for chat requests (T5-T7), order timelines (T8) and
recent orders (T9).

Matching a table of request strings against product names by substring is
a theta join. Instead of a nested loop (requests x products), candidates
come from an equi join on character n-grams: if ``r`` (length >= 3) is a
substring of ``name`` then the first 3 characters of ``r`` are one of the
3-grams of ``name``; shorter requests use 1- and 2-grams the same way. The
candidate set is then checked with the exact ``contains`` test, so the
result is exact while the join only pairs rows that share a gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

MAX_GRAM = 3
ALTERNATIVES_SAME_CATEGORY = 3   # fixed values of the look-up rules
ALTERNATIVES_TOTAL = 5
CATEGORY_RESULTS = 10
SEARCH_RESULTS = 5
# Category synonyms used by the category search (fixed values)
CATEGORY_PATTERNS = {"veg": "Vegetables", "vegetable": "Vegetables", "seafood": "Fish|Seafood",
                     "fish": "Fish|Seafood"}


def text_grams(texts: DataFrame) -> DataFrame:
    """(text, gram) for every distinct 1..3-gram of each distinct text."""
    t = F.col("text")

    def gram_at(k):  # one-argument lambda: transform passes (element[, index])
        return lambda i: F.substring(t, i, k)

    grams = F.flatten(F.array(*[
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - k + 1, F.lit(1))), gram_at(k))
        for k in range(1, MAX_GRAM + 1)]))
    return texts.select("text", F.explode(F.array_distinct(grams)).alias("gram")).where(F.length("gram") > 0)


def needle_matches(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text) for distinct needles and distinct texts (both lower
    case) where text contains needle: gram equi-join, then the exact test.
    Work grows with distinct values, not with rows; a needle is looked up by
    the rarest of its grams, so a gram of most texts is no hot key."""
    n = needles.select("needle").where(F.length("needle") > 0).distinct()
    size = F.least(F.length("needle"), F.lit(MAX_GRAM))
    own = F.transform(F.sequence(F.lit(1), F.length("needle") - size + 1), lambda i: F.substring(F.col("needle"), i, size))
    grams = text_grams(texts.select("text").distinct())
    many = grams.groupBy("gram").agg(F.count("*").alias("_n"))
    rare = (n.select("needle", F.explode(F.array_distinct(own)).alias("gram")).join(many, "gram", "left")
            .groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram")))
    return (rare.join(grams, "gram").select("needle", "text").distinct()
            .where(F.col("text").contains(F.col("needle"))))


def top_ids_per_needle(needles: DataFrame, products: DataFrame, text_cols: list[str], k: int) -> DataFrame:
    """(needle, product_id, r): the ``k`` lowest product ids whose text
    (any of ``text_cols``, lower case) contains the needle. Each text keeps
    only its own ``k`` lowest ids before the fan-out, which is exact: the
    k lowest of a union lie among the k lowest of each part."""
    parts = [products.select(F.lower(F.col(c)).alias("text"), "product_id") for c in text_cols]
    by_text = parts[0]
    for p in parts[1:]:
        by_text = by_text.unionByName(p)
    wt = Window.partitionBy("text").orderBy("product_id")
    top_text = by_text.distinct().withColumn("_r", F.row_number().over(wt)).where(F.col("_r") <= k).drop("_r")
    m = needle_matches(needles, top_text)
    cand = m.join(top_text, "text").select("needle", "product_id").distinct()
    wn = Window.partitionBy("needle").orderBy("product_id")
    return cand.withColumn("r", F.row_number().over(wn)).where(F.col("r") <= k)


def product_lookup(requests: DataFrame, products: DataFrame, key: list[str],
                   text: str = "product_name") -> DataFrame:
    """T5: per request, the product whose name contains the request (else
    one that contains any request word longer than 2 chars); in stock ->
    that product; otherwise up to 3 in-stock products of its category and
    the cheapest in-stock products to make 5.

    Output rows: key..., kind ('product'/'alternative'), rank, product_id,
    name, price, stock, category.
    """
    prods = products.select("product_id", "name", "price", "stock", "category")
    req = requests.select(*key, F.lower(F.col(text)).alias("needle"))
    words = (requests.select(*key, F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("needle"))
             .where(F.length("needle") > 2))
    best = top_ids_per_needle(req.select("needle").unionByName(words.select("needle")), prods, ["name"], 1)
    exact = req.join(best, "needle").groupBy(*key).agg(F.min("product_id").alias("product_id"))
    by_word = words.join(best, "needle").groupBy(*key).agg(F.min("product_id").alias("product_id"))
    found = (requests.select(*key).join(exact, key, "left")
             .join(by_word.withColumnRenamed("product_id", "_pw"), key, "left")
             .select(*key, F.coalesce("product_id", "_pw").alias("product_id")))
    hit = found.join(prods, "product_id", "left")
    main = hit.where(F.col("product_id").isNotNull()).select(
        *key, F.lit("product").alias("kind"), F.lit(0).alias("rank"), "product_id", "name", "price",
        F.when(F.col("stock") > 0, F.col("stock")).otherwise(F.lit(0)).alias("stock"), "category")
    need = hit.where(F.col("product_id").isNull() | (F.col("stock") <= 0))
    # same-category alternatives: the first 4 in-stock ids per category are
    # enough to leave 3 after removing the product itself
    wcat = Window.partitionBy("category").orderBy("product_id")
    top_cat = (prods.where(F.col("stock") > 0)
               .withColumn("_r", F.row_number().over(wcat))
               .where(F.col("_r") <= ALTERNATIVES_SAME_CATEGORY + 1)
               .select(F.col("category").alias("_cat"), F.col("product_id").alias("alt_id")))
    same = (need.where(F.col("product_id").isNotNull())
            .join(top_cat, F.col("category") == F.col("_cat"))
            .where(F.col("alt_id") != F.col("product_id")))
    ws = Window.partitionBy(*key).orderBy("alt_id")
    same = same.withColumn("rank", F.row_number().over(ws)).where(F.col("rank") <= ALTERNATIVES_SAME_CATEGORY)
    same_ids = same.groupBy(*key).agg(F.collect_list("alt_id").alias("_alts"))
    # cheapest overall: a bounded list (5 + 4 possible exclusions) carried
    # as one array value instead of a join
    k = ALTERNATIVES_TOTAL + ALTERNATIVES_SAME_CATEGORY + 1
    cheap = (prods.where(F.col("stock") > 0).orderBy("price", "product_id").limit(k)
             .select(F.array_sort(F.collect_list(F.struct("price", "product_id"))).alias("c"))).scalar()
    no_ids = F.array().cast("array<bigint>")
    fill = need.join(same_ids, key, "left").select(
        *key, F.coalesce("_alts", no_ids).alias("_alts"), "product_id", cheap.alias("_cheap"))
    excl = F.concat(F.col("_alts"),
                    F.when(F.col("product_id").isNotNull(), F.array(F.col("product_id"))).otherwise(no_ids))
    n_alts = F.size("_alts")
    picks = F.filter("_cheap", lambda x: ~F.array_contains(excl, x["product_id"]))
    room = F.when(n_alts < ALTERNATIVES_SAME_CATEGORY, F.lit(ALTERNATIVES_TOTAL) - n_alts).otherwise(F.lit(0))
    filled = fill.select(*key, n_alts.alias("_n"), F.posexplode(F.slice(picks, F.lit(1), room)).alias("_i", "_c"))
    cheap_rows = filled.select(*key, (F.col("_n") + F.col("_i") + 1).alias("rank"),
                               F.col("_c.product_id").alias("alt_id"))
    alts = (same.select(*key, "rank", "alt_id").unionByName(cheap_rows)
            .join(prods.withColumnRenamed("product_id", "alt_id"), "alt_id")
            .select(*key, F.lit("alternative").alias("kind"), "rank", F.col("alt_id").alias("product_id"),
                    "name", "price", "stock", "category"))
    return main.unionByName(alts)


def category_search(requests: DataFrame, products: DataFrame, key: list[str],
                    word: str = "category") -> DataFrame:
    """In-stock products whose category matches the word's synonym
    pattern or whose name contains the word, cheapest 10 per request.

    Category words come from a fixed list, so the search runs once per
    distinct word (a bounded set) and requests join on the word."""
    words = requests.select(F.lower(F.col(word)).alias("_word")).where(F.col("_word").isNotNull()).distinct()
    pat = F.lit(None).cast("string")
    for k, v in CATEGORY_PATTERNS.items():
        pat = F.when(F.col("_word") == k, F.lit(v)).otherwise(pat)
    pat = F.coalesce(pat, F.col("_word"))
    prods = products.where(F.col("stock") > 0).select("product_id", "name", "price", "stock", "category")
    words = words.withColumn("_pat", F.concat(F.lit("(?i)"), pat))
    # the word set is bounded by the fixed category list, so this non-equi
    # join broadcasts at most a handful of rows
    cand = F.broadcast(words).join(prods, F.regexp_like(F.col("category"), F.col("_pat"))
                                   | F.lower(F.col("name")).contains(F.col("_word")))
    w = Window.partitionBy("_word").orderBy("price", "product_id")
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= CATEGORY_RESULTS)
    r = requests.select(*key, F.lower(F.col(word)).alias("_word"))
    return r.join(top.drop("_pat"), "_word").drop("_word")


def search_fallback(requests: DataFrame, products: DataFrame, key: list[str],
                    text: str = "message") -> DataFrame:
    """The first 5 in-stock products (by id) whose name or category
    contains any request word longer than 2 chars; no match -> the first 5
    in-stock products. Matching runs on distinct words; each word keeps its
    5 lowest ids, so a request gathers at most 5 per distinct word."""
    prods = products.where(F.col("stock") > 0).select("product_id", "name", "price", "stock", "category")
    words = (requests.select(*key, F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("needle"))
             .where(F.length("needle") > 2).distinct())
    per_word = top_ids_per_needle(words.select("needle"), prods, ["name", "category"], SEARCH_RESULTS)
    hits = words.join(per_word, "needle").select(*key, "product_id").distinct()
    w = Window.partitionBy(*key).orderBy("product_id")
    top = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= SEARCH_RESULTS)
    default = (prods.orderBy("product_id").limit(SEARCH_RESULTS)
               .select(F.array_sort(F.collect_list("product_id")).alias("d"))).scalar()
    missing = requests.select(*key).join(top.select(*key).distinct(), key, "left_anti")
    dflt = missing.select(*key, default.alias("_d")) \
                  .select(*key, F.posexplode("_d").alias("_i", "product_id")) \
                  .select(*key, (F.col("_i") + 1).alias("rank"), "product_id")
    return (top.select(*key, "rank", "product_id").unionByName(dflt)
            .join(prods, "product_id")
            .select(*key, "rank", "product_id", "name", "price", "stock", "category"))


def order_timeline(orders: DataFrame) -> DataFrame:
    """Tracking steps per order: placed; payment verification (bank
    payments only); in transit; delivered; cancelled (only when cancelled).
    One row per (order, step)."""
    pm, ps, st = F.col("payment_method"), F.col("payment_status"), F.col("status")
    verified, rejected = ps == "Approved", ps == "Rejected"

    def step(status, label, completed, error=F.lit(False)):
        return F.struct(F.lit(status).alias("step_status"), label.alias("label"),
                        completed.alias("completed"), error.alias("error"))

    steps = F.array(
        step("Pending", F.lit("Order Placed"), F.lit(True)),
        F.when(pm == "bank", step("Pending Payment Verification",
                                  F.when(rejected, "Payment Rejected").when(verified, "Payment Verified")
                                   .otherwise("Awaiting Payment Verification"), verified, rejected)),
        step("In Transit", F.lit("In Transit"), st.isin("In Transit", "Delivered")),
        step("Delivered", F.lit("Delivered"), st == "Delivered"),
        F.when(st == "Cancelled", step("Cancelled", F.lit("Order Cancelled"), F.lit(True), F.lit(True))))
    kept = F.filter(steps, lambda s: s.isNotNull())
    return (orders.select("order_id", F.posexplode(kept).alias("step", "s"))
            .select("order_id", (F.col("step") + 1).alias("step"), "s.*"))


def recent_orders(orders: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """Each buyer's ``n`` newest orders with their item count."""
    w = Window.partitionBy("buyer_id").orderBy(F.desc("created_at"), F.desc("order_id"))
    top = orders.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    counts = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))
    return (top.join(counts, "order_id", "left")
            .select("buyer_id", "rank", "order_id", "status", "total", "created_at", "payment_status",
                    F.coalesce("item_count", F.lit(0)).alias("item_count")))
