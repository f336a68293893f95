"""JSON scoring (S10) and the schema rules of all collections.

Derived tables (fixed rules): a JSON request per demand row, broken in one of eight ways by
(order id + line number) mod 8; a document per event, its collection event id mod 6, with
one field broken by (event id div 6) mod 14.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import features as fe
from larder.operators import scoring as sc
from larder.plans.registry import register
from larder.plans.sql_binding import with_views
from larder.sources.binding import Marketplace


def _body(prefix: str, fields: list[tuple[str, object]], suffix: str = "}"):
    parts = [F.lit(prefix)]
    for i, (name, value) in enumerate(fields):
        parts += [F.lit((", " if i else "") + f'"{name}": '), value]
    return F.concat(*parts, F.lit(suffix))


def request_bodies(mk: Marketplace):
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    d = mk.demand.withColumn("line", F.col("line_no").cast("long"))
    name, cat, wx = quoted(F.col("product_name")), quoted(F.upper("category")), quoted(F.concat(F.lit(" "), F.col("weather_condition")))
    day = quoted(F.lower(F.date_format("date", "EEEE")))
    flag = F.col("is_holiday").cast("string")
    full = [("product_name", name), ("category", cat), ("day_of_week", day), ("is_holiday", flag), ("weather_condition", wx)]
    bodies = [_body("{", full[:4]), F.concat(F.lit('{"product_name": '), name, F.lit(", ")), _body('{"shop": {"id": 7}, ', full),
              _body("{", [*full[:3], ("is_holiday", F.when(F.col("is_holiday") == 1, "true").otherwise("false")), full[4]]),
              _body("{", [*full[:3], ("is_holiday", quoted(F.concat(F.lit(" "), flag, F.lit(" ")))), full[4]]), F.concat(F.lit("["), name, F.lit("]")),
              F.concat(F.lit("﻿"), _body("{", [*full[:3], full[4]])),
              _body("{", [full[0], ("category", F.lit("null")), full[2], ("is_holiday", F.lit("1.7")), full[4]])]
    pick = F.pmod(F.col("order_id") + F.col("line"), F.lit(8))
    return d.select((F.col("order_id") * 1000 + F.col("line")).alias("request_id"),
                    F.coalesce(*[F.when(pick == i, b) for i, b in enumerate(bodies)]).alias("body"))


PARSE_SQL = with_views("b_demand") + r"""
, r AS (
    SELECT order_id * 1000 + line_no AS request_id, (order_id + line_no) % 8 AS k, product_name AS pn, upper(category) AS cat,
           lower(strftime(date, '%A')) AS day, is_holiday AS h, ' ' || weather_condition AS wx FROM b_demand)
, b AS (
    SELECT request_id, CASE k
        WHEN 0 THEN '{"product_name": "' || pn || '", "category": "' || cat || '", "day_of_week": "' || day || '", "is_holiday": ' || h || '}'
        WHEN 1 THEN '{"product_name": "' || pn || '", '
        WHEN 2 THEN '{"shop": {"id": 7}, "product_name": "' || pn || '", "category": "' || cat || '", "day_of_week": "' || day || '", "is_holiday": ' || h || ', "weather_condition": "' || wx || '"}'
        WHEN 3 THEN '{"product_name": "' || pn || '", "category": "' || cat || '", "day_of_week": "' || day || '", "is_holiday": ' || CASE h WHEN 1 THEN 'true' ELSE 'false' END || ', "weather_condition": "' || wx || '"}'
        WHEN 4 THEN '{"product_name": "' || pn || '", "category": "' || cat || '", "day_of_week": "' || day || '", "is_holiday": " ' || h || ' ", "weather_condition": "' || wx || '"}'
        WHEN 5 THEN '["' || pn || '"]'
        WHEN 6 THEN '{"product_name": "' || pn || '", "category": "' || cat || '", "day_of_week": "' || day || '", "weather_condition": "' || wx || '"}'
        ELSE '{"product_name": "' || pn || '", "category": null, "day_of_week": "' || day || '", "is_holiday": 1.7, "weather_condition": "' || wx || '"}' END AS body
    FROM r)
, j AS (SELECT request_id, CASE WHEN json_valid(body) THEN body::JSON END AS v FROM b)
, e AS (
    SELECT request_id, v, CASE WHEN v IS NULL THEN 'Malformed JSON' WHEN json_type(v) <> 'OBJECT' THEN 'Request is not an object'
        WHEN NOT json_exists(v, '$.product_name') THEN 'Missing required feature: product_name'
        WHEN NOT json_exists(v, '$.category') THEN 'Missing required feature: category'
        WHEN NOT json_exists(v, '$.day_of_week') THEN 'Missing required feature: day_of_week'
        WHEN NOT json_exists(v, '$.weather_condition') THEN 'Missing required feature: weather_condition' END AS error FROM j)
, n AS (
    SELECT request_id, error, v->>'$.product_name' AS pn, lower(trim(COALESCE(v->>'$.category', 'None'))) AS cat,
           trim(COALESCE(v->>'$.day_of_week', 'None')) AS day, lower(trim(COALESCE(v->>'$.weather_condition', 'None'))) AS wx,
           CASE json_type(v, '$.is_holiday') WHEN 'BOOLEAN' THEN CASE v->>'$.is_holiday' WHEN 'true' THEN 1 ELSE 0 END
                WHEN 'VARCHAR' THEN COALESCE(CASE WHEN regexp_full_match(trim(v->>'$.is_holiday'), '[+-]?[0-9]+') THEN CAST(trim(v->>'$.is_holiday') AS BIGINT) END, 0)
                ELSE COALESCE(trunc(CAST(v->>'$.is_holiday' AS DOUBLE)), 0) END AS h FROM e)
SELECT request_id, CASE WHEN error IS NULL THEN pn END AS product_name,
       CASE WHEN error IS NULL THEN CASE cat WHEN 'vegetables' THEN 'vegetable' WHEN 'grains' THEN 'grain' ELSE cat END END AS category,
       CASE WHEN error IS NULL THEN upper(substring(day, 1, 1)) || lower(substring(day, 2)) END AS day_of_week,
       CASE WHEN error IS NULL THEN wx END AS weather_condition,
       CASE WHEN error IS NULL THEN CAST(h > 0 AS INTEGER) END AS is_holiday, error
FROM n
"""


@register("json_requests_parsed", covers=("S10", "P12", "F15"), sql=PARSE_SQL)
def json_requests_parsed(spark, sf_dir):
    return sc.parse_requests(request_bodies(Marketplace(spark, sf_dir)))


TEXTS = ["category", "day_of_week", "weather_condition"]


def request_model(mk: Marketplace, rounds: int = 200, depth: int = 4) -> sc.RequestModel:
    """Quantity and price from the request's fields, trained on four of five hash folds of the demand rows."""
    rows = fe.hash_folds(mk.demand, ["order_id", "line_no", "product_id"], 5, 42).where(F.col("fold") != 0).select(
        F.lower("category").alias("category"), F.date_format("date", "EEEE").alias("day_of_week"), F.lower("weather_condition").alias("weather_condition"),
        "is_holiday", "quantity_sold", "price", "order_id", "line_no", "product_id")
    params = dict(kind="boost", rounds=rounds, depth=depth, rate=0.1, subsample=0.8, columns=0.8)
    part = F.pmod(F.xxhash64("order_id", "line_no", "product_id"), F.lit(10))
    return sc.RequestModel.train(rows, TEXTS, ["is_holiday"], ["quantity_sold", "price"], params, part)


@register("json_request_scores", covers=("S10", "M5", "M7"))
def json_request_scores(spark, sf_dir):
    """Every JSON request: both predictions, or the reason of its refusal."""
    mk = Marketplace(spark, sf_dir)
    scored = request_model(mk).score(sc.parse_requests(request_bodies(mk)), ["request_id", "error"])
    return scored.select("request_id", F.col("pred_quantity_sold").alias("quantity_sold"), F.col("pred_price").alias("price"), "error")


# ------------------------------------------------------------ schema rules

COLLECTIONS = list(sc.SCHEMAS)


def documents(mk: Marketplace) -> dict:
    """One table per collection, each with ``doc_id`` and ``b`` (which field is broken)."""
    e = mk.raw("events").select(F.col("event_id").alias("doc_id"), F.pmod("event_id", F.lit(6)).alias("c"),
                                F.pmod(F.expr("event_id div 6"), F.lit(14)).alias("b"))
    i, b = F.col("doc_id"), F.col("b")
    text, num = i.cast("string"), i.cast("double")

    def f(name, good, *bad):
        """``good`` unless ``b`` names one of the (number, value) pairs."""
        good = good if not isinstance(good, str) else F.lit(good)
        kind = None
        for at, value in bad:
            good = F.when(b == at, F.lit(value) if value is not None else F.lit(None)).otherwise(good)
        return good.alias(name) if kind is None else good

    entry = lambda name, price, qty: F.struct(name.alias("name"), price.alias("price"), qty.alias("quantity"))
    fish, two, three = F.lit("Cod"), F.lit(2.5), F.lit(3.0)
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    items = F.array(entry(fish, two, three), F.when(b == 4, entry(F.lit(" "), two, three)).when(b == 5, entry(fish, none_d, three))
                    .when(b == 6, entry(fish, two, none_d)).otherwise(entry(fish, two, three)))
    status = lambda s, t: F.struct(s.alias("supplier"), t.alias("status"))
    sup = F.array(F.when(b == 7, status(none_s, F.lit("Pending"))).when(b == 8, status(text, F.lit("Lost"))).otherwise(status(text, F.lit("Pending"))))
    of = {
        "product": [f("name", text, (0, "  ")), f("category", "Fish", (1, None), (2, "Toys")), f("price", num, (3, None), (4, -1.0)), f("basePrice", num, (5, None)),
                    f("sellingPrice", num, (6, None)), f("unit", "kg", (7, ""), (8, None)), f("stock", i.cast("int"), (9, None)), f("supplier", text, (10, None))],
        "review": [f("userId", text, (0, None)), f("userName", text, (1, "")), f("userRole", "buyer", (2, None)), f("rating", F.lit(4.0), (3, None), (4, 0.0), (5, 6.0)),
                   f("title", "Good", (6, None), (7, "t" * 61)), f("review", "Fine", (8, ""), (9, "r" * 501)), f("orderId", text, (10, None)),
                   f("status", "pending", (11, "open"), (12, None))],
        "order": [f("buyer", text, (0, None)), f("total", num, (1, None)), f("status", "Pending", (2, "Lost"), (9, None)),
                  f("paymentStatus", "Approved", (3, "Paid")), items.alias("items"), sup.alias("supplierStatuses")],
        "invoice": [f("buyer", text, (0, None)), F.when(b == 1, F.lit(" ")).when(b == 6, F.concat(F.lit("inv-"), (F.expr("doc_id div 200")).cast("string")))
                    .otherwise(F.concat(F.lit("INV-x"), text)).alias("invoiceNumber"), f("amount", num, (2, None), (3, -0.5)), f("status", "Paid", (4, "Open")),
                    f("dueDate", F.lit("2024-01-01"), (5, None))],
        "user": [f("name", text, (0, "")), F.when(b == 1, none_s).when(b == 5, F.concat(F.lit(" USER"), F.expr("doc_id div 200").cast("string")))
                 .when(b == 6, F.concat(F.lit("user"), F.expr("doc_id div 200").cast("string"))).otherwise(F.concat(F.lit("u"), text, F.lit("@x"))).alias("email"),
                 f("password", "secret!", (2, None), (3, "short")), f("role", "buyer", (4, "guest")), f("verificationStatus", "pending", (7, "unknown"))],
        "notification": [f("user", text, (0, None)), f("title", "Hello", (1, " ")), f("message", "There", (2, None)), f("type", "order", (3, "mail"), (4, None))],
    }
    return {name: e.where(F.col("c") == n).select("doc_id", *of[name]) for n, name in enumerate(COLLECTIONS)}


def _schema_sql() -> str:
    """Which codes a broken document must show, stated per collection and break."""
    by_break = {
        "product": {0: "name:required", 1: "category:required", 2: "category:enum", 3: "price:required", 4: "price:min", 5: "basePrice:required",
                    6: "sellingPrice:required", 7: "unit:required", 10: "supplier:required"},
        "review": {0: "userId:required", 1: "userName:required", 2: "userRole:required", 3: "rating:required", 4: "rating:min", 5: "rating:max", 6: "title:required",
                   7: "title:maxlength", 8: "review:required", 9: "review:maxlength", 10: "orderId:required", 11: "status:enum"},
        "order": {0: "buyer:required", 1: "total:required", 2: "status:enum", 3: "paymentStatus:enum", 4: "items[].name:required", 5: "items[].price:required",
                  6: "items[].quantity:required", 7: "supplierStatuses[].supplier:required", 8: "supplierStatuses[].status:enum"},
        "invoice": {0: "buyer:required", 1: "invoiceNumber:required", 2: "amount:required", 3: "amount:min", 4: "status:enum", 5: "dueDate:required"},
        "user": {0: "name:required", 1: "email:required", 2: "password:required", 3: "password:minlength", 4: "role:enum", 7: "verificationStatus:enum"},
        "notification": {0: "user:required", 1: "title:required", 2: "message:required", 3: "type:enum"}}
    whens = " ".join(f"WHEN c = {n} AND b = {k} THEN '{v}'" for n, name in enumerate(COLLECTIONS) for k, v in by_break[name].items())
    names = ", ".join(f"'{n}'" for n in COLLECTIONS)
    return f"""
WITH e AS (SELECT event_id AS doc_id, event_id % 6 AS c, (event_id // 6) % 14 AS b FROM events)
, k AS (
    SELECT *, CASE WHEN c = 3 AND b = 1 THEN '' WHEN c = 3 AND b = 6 THEN 'inv-' || (doc_id // 200)
                   WHEN c = 4 AND b IN (5, 6) THEN 'user' || (doc_id // 200) END AS key FROM e)
, s AS (SELECT *, CASE {whens} ELSE '' END AS one, key IS NOT NULL AND COUNT(*) OVER (PARTITION BY c, key) > 1 AS twice FROM k)
, v AS (SELECT [{names}][c + 1] AS collection, doc_id,
               concat_ws(',', NULLIF(one, ''), CASE WHEN twice THEN CASE c WHEN 3 THEN 'invoiceNumber:unique' ELSE 'email:unique' END END) AS violations FROM s)
SELECT collection, doc_id, violations, violations = '' AS valid FROM v
"""


@register("schema_violations", covers=("P13",), sql=_schema_sql())
def schema_violations(spark, sf_dir):
    """Every document of six collections with the schema rules it breaks."""
    out = None
    for name, docs in documents(Marketplace(spark, sf_dir)).items():
        part = sc.violations(docs, sc.SCHEMAS[name]).select(F.lit(name).alias("collection"), "doc_id", "violations", "valid")
        out = part if out is None else out.unionByName(part)
    return out
