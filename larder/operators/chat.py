"""Chat message classification (T1-T4) as Column expressions.

Each intent score is one Column built from substring tests, so a table of
messages is classified in a single projection (whole-stage codegen, no
Python per row). Resolution follows the reference: intents are scanned in a
fixed order and only a strictly greater score replaces the current best,
so ties go to the earlier intent; a best score under 0.5 becomes the
fallback with confidence 0.5. Substring semantics are deliberate ("hi"
inside "shipment" counts as a greeting); ``whole_words=True`` offers the
word-boundary variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Intent names, category words and keyword / phrase lists of
# the classifier, in their original order (order matters: first match wins).
INTENT_ORDER = ["ORDER_STATUS", "PRODUCT_PRICE", "PRODUCT_STOCK", "CATEGORY_SEARCH",
                "NOTIFICATIONS", "REVIEWS", "GENERAL_HELP", "FALLBACK_SEARCH"]
CATEGORIES = ["fish", "meat", "vegetables", "fruit", "dairy", "spices", "seafood", "poultry",
              "greens", "produce"]
ORDER_PHRASES = ["status of order", "track order", "where is my order", "delivery status", "order status"]
ORDER_KEYWORDS = ["order", "orders", "track", "shipment", "delivery", "purchase", "purchases", "history",
                  "reorder"]
ORDER_ID_HINTS = ["order", "status", "track"]
PRICE_PHRASES = ["price of", "how much is", "how much for", "cost of", "price for", "cost for", "value of"]
PRICE_KEYWORDS = ["price", "prices", "cost", "costs", "how much", "value", "cheapest", "lowest price",
                  "affordable", "deals", "discount"]
STOCK_PHRASES = ["stock of", "is there any", "do you have", "is there", "availability of", "in stock"]
STOCK_KEYWORDS = ["stock", "stocks", "available", "availability", "in stock", "in-stock", "quantity",
                  "quantities", "do you have", "bulk", "wholesale"]
BROWSE_KEYWORDS = ["show", "list", "browse", "all", "what", "category", "categories"]
NOTIFICATION_KEYWORDS = ["notification", "notifications", "alert", "alerts", "unread", "messages",
                         "system updates", "payouts"]
REVIEW_KEYWORDS = ["review", "reviews", "feedback", "testimonial", "testimonials", "rating", "ratings",
                   "what do customers say", "what do buyers say", "what do clients say", "client",
                   "clients", "is it good", "reputation"]
HELP_KEYWORDS = ["help", "what can you do", "commands", "options", "menu", "information", "how to use",
                 "help me"]
GREETING_KEYWORDS = ["hello", "hi", "hey", "good morning", "good evening", "howdy", "greetings", "thank",
                     "thanks", "bye", "goodbye", "see you", "great", "awesome"]
SKIP_WORDS = ["price", "prices", "cost", "costs", "how", "much", "value", "cheapest", "lowest",
              "affordable", "deals", "discount", "stock", "stocks", "available", "availability", "in",
              "quantity", "quantities", "do", "you", "have", "bulk", "wholesale", "is", "there", "any",
              "for", "and", "with", "what", "show", "list", "the", "of"]
VEG_FORMS = ["veg", "vegetable"]
# Scores
S_ORDER_ID, S_ORDER_PHRASE, S_KEYWORD, S_PHRASE = 0.95, 0.9, 0.8, 0.9
S_CAT_BROWSE, S_CAT_PLAIN, S_NOTIF, S_REVIEW, S_HELP = 0.9, 0.7, 0.9, 0.9, 0.95
THRESHOLD, FALLBACK_CONFIDENCE = 0.5, 0.5
LONG_ID = r"[a-fA-F0-9]{24}"
SHORT_ID = r"[a-fA-F0-9]{8}"
# ---------------------------------------------------------------------------


def js_trim(c: Column) -> Column:
    """Trim all leading/trailing whitespace (not only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def contains_any(m: Column, words: list[str], whole_words: bool = False) -> Column:
    """Substring test for any of ``words`` as ONE regex (quoted literals in
    an alternation): compact for code generation and a single scan."""
    alt = "|".join(r"\Q" + w + r"\E" for w in words)
    if whole_words:
        return m.rlike(rf"(^|[^A-Za-z0-9_])({alt})([^A-Za-z0-9_]|$)")
    return m.rlike(alt)


def bounded_hex(text: Column, hex_pattern: str) -> Column:
    """First run matching ``hex_pattern`` with ASCII word boundaries on both
    sides (the boundary is matched explicitly so every regex engine agrees);
    NULL when none."""
    got = F.regexp_extract(text, rf"(^|[^A-Za-z0-9_])({hex_pattern})([^A-Za-z0-9_]|$)", 2)
    return F.when(got != "", got)


def phrase_tail(m: Column, phrases: list[str]) -> Column:
    """Text after the first occurrence of the first phrase (in list
    order) whose tail, without ?.!, and trimmed, is longer than 1 char."""
    cands = []
    for p in phrases:
        pos = F.instr(m, p)
        after = F.substring(m, pos + len(p), F.lit(1 << 30))
        tail = js_trim(F.regexp_replace(js_trim(after), r"[?.!,]", ""))
        cands.append(F.when((pos > 0) & (F.length(tail) > 1), tail))
    return F.coalesce(*cands)


def classify(messages: DataFrame, text: str = "message", whole_words: bool = False) -> DataFrame:
    """Add intent, confidence, order_id, product_name, category.

    Built in stages so the normalised text, the phrase tails and each
    keyword-group test are computed once per row and referenced by name
    (one giant nested expression would repeat the regex work and overflow
    code generation).
    """
    m = F.col("_m")

    def has(words):
        return contains_any(m, words, whole_words)

    s1 = messages.withColumn("_m", F.lower(js_trim(F.col(text))))
    cats = [(c, [c] + (VEG_FORMS if c == "vegetables" else [])) for c in CATEGORIES]
    s2 = s1.select(
        "*",
        bounded_hex(F.col(text), LONG_ID).alias("_long"),
        bounded_hex(F.col(text), SHORT_ID).alias("_short"),
        has(ORDER_ID_HINTS).alias("_hint"),
        has(ORDER_PHRASES).alias("_ord_ph"), has(ORDER_KEYWORDS).alias("_ord_kw"),
        phrase_tail(m, PRICE_PHRASES).alias("_ptail"), has(PRICE_KEYWORDS).alias("_price_kw"),
        phrase_tail(m, STOCK_PHRASES).alias("_stail"), has(STOCK_KEYWORDS).alias("_stock_kw"),
        has(BROWSE_KEYWORDS).alias("_browse"),
        has(NOTIFICATION_KEYWORDS).alias("_notif"), has(REVIEW_KEYWORDS).alias("_review"),
        (has(HELP_KEYWORDS) | has(GREETING_KEYWORDS)).alias("_help"),
        *[has(words).alias(f"_cat_{i}") for i, (_, words) in enumerate(cats)])
    category = F.coalesce(*[F.when(F.col(f"_cat_{i}"), F.lit(c)) for i, (c, _) in enumerate(cats)])
    order_id = F.coalesce(F.col("_long"), F.when(F.col("_hint"), F.col("_short")))
    stock_name = F.when(~F.col("_stail").isin(*CATEGORIES), F.col("_stail"))
    s3 = s2.select("*", order_id.alias("order_id"), category.alias("category"),
                   stock_name.alias("_sname"))
    scores = [
        F.when(F.col("order_id").isNotNull(), S_ORDER_ID).when(F.col("_ord_ph"), S_ORDER_PHRASE)
         .when(F.col("_ord_kw"), S_KEYWORD).otherwise(0.0),
        F.when(F.col("_ptail").isNotNull(), S_PHRASE).when(F.col("_price_kw"), S_KEYWORD).otherwise(0.0),
        F.when(F.col("_sname").isNotNull(), S_PHRASE).when(F.col("_stail").isNotNull(), 0.0)
         .when(F.col("_stock_kw"), S_KEYWORD).otherwise(0.0),
        F.when(F.col("category").isNull(), 0.0).when(F.col("_browse"), S_CAT_BROWSE).otherwise(S_CAT_PLAIN),
        F.when(F.col("_notif"), S_NOTIF).otherwise(0.0),
        F.when(F.col("_review"), S_REVIEW).otherwise(0.0),
        F.when(F.col("_help"), S_HELP).otherwise(0.0),
    ]
    # Winner in one expression: the max of (score, -position) is the highest
    # score and, among equal scores, the earliest intent (strictly-greater
    # scan). Each score is referenced once, so plans stay linear in size.
    top = F.array_max(F.array(*[F.struct(sc.alias("score"), F.lit(-i).alias("neg_pos"))
                                for i, sc in enumerate(scores)]))
    s4 = s3.select("*", top.alias("_top"),
                   F.coalesce(F.col("_sname"), F.col("_ptail")).alias("_pn"))
    names = F.array(*[F.lit(n) for n in INTENT_ORDER[:-1]])
    ok = F.col("_top.score") >= THRESHOLD
    s5 = s4.select("*",
                   F.when(ok, F.element_at(names, 1 - F.col("_top.neg_pos")))
                    .otherwise(F.lit(INTENT_ORDER[-1])).alias("intent"),
                   F.when(ok, F.col("_top.score")).otherwise(F.lit(FALLBACK_CONFIDENCE)).alias("confidence"))
    # leftover words for price/stock intents without an extracted name
    words = F.filter(F.split(m, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*SKIP_WORDS))
    leftover = F.when(F.size(words) > 0, F.array_join(words, " "))
    needs = F.col("intent").isin("PRODUCT_PRICE", "PRODUCT_STOCK") & F.col("_pn").isNull()
    out = s5.withColumn("product_name", F.when(needs, leftover).otherwise(F.col("_pn")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])
