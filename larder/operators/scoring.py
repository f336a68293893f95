"""Scoring of JSON requests (S10) and the schema rules of all collections.

A request body is parsed once into a VARIANT; a body that is no JSON, no object or lacks a
required field is refused with the reason, extra fields are ignored, and the flag may be a
boolean, a number or text. The saved model travels as one row (levels, bin edges, trees), and
the same expressions score a table or a stream of files.

The schema rules are one table of (field, rule, argument) per collection, compiled into
one expression; ``items[].name`` addresses the elements of an array of structs. Unique keys
are counted by an aggregate (map-side for hot keys).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import boosting as bo
from larder.operators.models import CATEGORY_SYNONYMS, capitalize
from larder.session import checkpoint_dir

# Request fields in the order they are checked
REQUIRED = ["product_name", "category", "day_of_week", "weather_condition"]
MALFORMED, NO_OBJECT = "Malformed JSON", "Request is not an object"


def parse_requests(bodies: DataFrame) -> DataFrame:
    """``request_id``, the normalised fields (P12) and ``error`` (null if accepted) of ``body`` texts.

    A step per select: what the next step uses more than once (the parsed body, a field, its
    text, the error) is worked out once a row and kept as a column.
    """
    fields = [*REQUIRED, "is_holiday"]
    get = lambda c, path, kind: F.try_variant_get(c, path, kind)
    bare = F.when(F.col("body").startswith("\ufeff"), F.substring("body", 2, 1 << 30)).otherwise(F.col("body"))
    rows = bodies.select("request_id", bare.alias("body"))
    # a body that parses is an object if it opens with a brace
    rows = rows.select("request_id", F.try_parse_json("body").alias("v"), F.ltrim("body", F.lit(" \t\r\n")).startswith("{").alias("object"))
    rows = rows.select("request_id", "v", "object", *[get("v", f"$.{f}", "variant").alias(f) for f in fields])
    missing = F.coalesce(*[F.when(F.col(f).isNull(), F.lit(f"Missing required feature: {f}")) for f in REQUIRED])
    error = F.when(F.col("v").isNull(), MALFORMED).when(~F.col("object"), NO_OBJECT).otherwise(missing)
    # a null counts as the text it prints as
    text = lambda f: F.trim(F.coalesce(get(f, "$", "string"), F.lit("None")))
    rows = rows.select("request_id", error.alias("error"), get("product_name", "$", "string").alias("product_name"),
                       F.lower(text("category")).alias("category"), text("day_of_week").alias("day_of_week"),
                       F.lower(text("weather_condition")).alias("weather_condition"), F.col("is_holiday").alias("flag"),
                       F.schema_of_variant("is_holiday").alias("kind"), F.trim(get("is_holiday", "$", "string")).alias("flag_text"))
    size = get("flag", "$", "double")
    number = F.when(F.col("kind") == "BOOLEAN", get("flag", "$", "boolean").cast("int")).when(
        F.col("kind") == "STRING", F.when(F.col("flag_text").rlike(r"^[+-]?\d+$"), F.col("flag_text").try_cast("long"))
    ).otherwise(F.floor(F.abs(size)) * F.signum(size))
    cat = F.col("category")
    made = {"product_name": F.col("product_name"),
            "category": F.coalesce(*[F.when(cat == k, F.lit(x)) for k, x in CATEGORY_SYNONYMS.items()], cat),
            "day_of_week": capitalize(F.col("day_of_week")), "weather_condition": F.col("weather_condition"),
            "is_holiday": F.when(F.coalesce(number, F.lit(0)) > 0, 1).otherwise(0)}
    return rows.select("request_id", *[F.when(F.col("error").isNull(), c).alias(n) for n, c in made.items()], "error")


class RequestModel:
    """A fitted model of several targets over coded text fields and numbers."""

    def __init__(self, levels: dict[str, list[str]], numbers: list[str], targets: list[str], fitted: bo.Fitted):
        self.levels, self.numbers, self.targets, self.fitted = levels, numbers, targets, fitted

    @staticmethod
    def code(column: str, levels: list[str]) -> Column:
        """Place of a level (one after the last for an unseen or null one)."""
        place = F.array_position(F.array(*[F.lit(x) for x in levels]).cast("array<string>"), F.col(column))
        return F.when(F.coalesce(place, F.lit(0)) > 0, place - 1).otherwise(len(levels)).cast("double").alias(f"{column}_code")

    @classmethod
    def train(cls, rows: DataFrame, texts: list[str], numbers: list[str], targets: list[str], params: dict, part: Column) -> RequestModel:
        """Rows of equal fields train as one row of their mean and weight, in parts by ``part``.

        The rows are read once: the levels and the codes come from the rows of distinct fields."""
        checkpoint_dir(rows.sparkSession)
        few = rows.groupBy(*texts, *numbers, part.alias("_part")).agg(*[F.avg(t).alias(t) for t in targets], F.count("*").alias("_n")).checkpoint(eager=True)
        levels = {}
        for c in texts:      # the fields have few levels: categories, weekdays, weathers
            levels[c] = [r[0] for r in few.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).collect()]
        features = [f"{c}_code" for c in texts] + numbers
        coded = few.select(*[cls.code(c, x) for c, x in levels.items()], *numbers, "_part", *targets, "_n")
        fitted = bo.fit(coded, features, targets, [{**params, "target": i} for i in range(len(targets))], weight="_n", keys=[*features, "_part"])
        return cls(levels, numbers, targets, fitted)

    def score(self, requests: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """``columns`` of ``requests`` (else all) with one ``pred_<target>`` each; rows with an ``error`` get none."""
        columns = columns or requests.columns
        error = ["error"] if "error" in requests.columns else []
        needed = dict.fromkeys([*columns, *self.levels, *self.numbers, *error])
        made = {f"pred_{t}": i for i, t in enumerate(self.targets)}
        out = self.fitted.predict(requests.select(*needed), made, levels={f"{c}_code": (c, x) for c, x in self.levels.items()},
                                  hand_on=list(dict.fromkeys([*columns, *error])))
        keep = F.col("error").isNull() if error else F.lit(True)
        return out.select(*columns, *[F.when(keep, F.col(c)).alias(c) for c in made])

    def save(self, spark: SparkSession, path: str) -> None:
        head = {"levels": self.levels, "numbers": self.numbers, "targets": self.targets, "features": self.fitted.features,
                "edges": [e.tolist() for e in self.fitted.edges], "errors": self.fitted.errors}
        spark.createDataFrame([(json.dumps(head), [bytes(t) for t in self.fitted.trees])], "head string, trees array<binary>").coalesce(1) \
             .write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RequestModel:
        import numpy as np
        row = spark.read.parquet(path).first()
        head = json.loads(row["head"])
        rows = [{**e, "trees": bytes(t)} for e, t in zip(head["errors"], row["trees"], strict=True)]
        fitted = bo.Fitted(head["features"], [np.array(e) for e in head["edges"]], rows)
        return cls(head["levels"], head["numbers"], head["targets"], fitted)


# ------------------------------------------------------------ schema rules

# Fixed values: (field, rule, argument) of the six collections; ``default`` fills an absent field first
SCHEMAS = {
    "product": [("name", "required", None), ("category", "required", None),
                ("category", "enum", ["Fish", "Meat", "Vegetables", "Dairy", "Grains", "Other"]), ("price", "required", None), ("price", "min", 0),
                ("basePrice", "required", None), ("sellingPrice", "required", None), ("unit", "default", "kg"), ("unit", "required", None),
                ("stock", "default", 0), ("stock", "required", None), ("supplier", "required", None)],
    "review": [("userId", "required", None), ("userName", "required", None), ("userRole", "required", None), ("rating", "required", None),
               ("rating", "min", 1), ("rating", "max", 5), ("title", "required", None), ("title", "maxlength", 60), ("review", "required", None),
               ("review", "maxlength", 500), ("orderId", "required", None), ("status", "enum", ["pending", "approved", "rejected"])],
    "order": [("buyer", "required", None), ("total", "required", None),
              ("status", "enum", ["Pending Payment Verification", "Pending", "In Transit", "Delivered", "Cancelled"]),
              ("paymentStatus", "enum", ["Pending Verification", "Approved", "Rejected"]), ("items[].name", "required", None),
              ("items[].price", "required", None), ("items[].quantity", "required", None), ("supplierStatuses[].supplier", "required", None),
              ("supplierStatuses[].status", "enum", ["Pending", "In Transit", "Delivered", "Cancelled"])],
    "invoice": [("buyer", "required", None), ("invoiceNumber", "required", None), ("amount", "required", None), ("amount", "min", 0),
                ("status", "enum", ["Paid", "Unpaid", "Overdue"]), ("dueDate", "required", None), ("invoiceNumber", "unique", None)],
    "user": [("name", "required", None), ("email", "required", None), ("password", "required", None), ("password", "minlength", 6),
             ("role", "enum", ["buyer", "supplier", "admin"]),
             ("verificationStatus", "enum", ["unverified", "pending", "approved", "rejected", "information_requested", "expired"]),
             ("email", "unique", None)],
    "notification": [("user", "required", None), ("title", "required", None), ("message", "required", None),
                     ("type", "enum", ["order", "stock", "system", "payout"])],
}


def _broken(value: Column, kind: str, rule: str, argument) -> Column:
    text = kind == "string"
    if rule == "required":       # an empty or blank text counts as absent
        return value.isNull() | (F.trim(value) == "") if text else value.isNull()
    checks = {"enum": lambda: ~value.isin(*argument), "min": lambda: value < argument, "max": lambda: value > argument,
              "minlength": lambda: F.length(value) < argument, "maxlength": lambda: F.length(value) > argument}
    return F.coalesce(checks[rule](), F.lit(False))       # a rule on an absent optional field holds


def _name(field: str, rule: str) -> str:
    return f"{field}:{rule}"


def violations(docs: DataFrame, rules: list[tuple]) -> DataFrame:
    """``docs`` with ``violations`` (codes ``field:rule`` in rule order, comma-joined) and ``valid``."""
    for field, rule, value in rules:
        if rule == "default":
            docs = docs.withColumn(field, F.coalesce(F.col(field), F.lit(value)))
    codes = []
    for n, (field, rule, argument) in enumerate(rules):
        if rule == "default":
            continue
        code = F.lit(_name(field, rule))
        if rule == "unique":
            key = F.lower(F.trim(F.col(field)))
            counts = docs.groupBy(key.alias("_key")).agg(F.count("*").alias(f"_n{n}")).where(F.col("_key").isNotNull() & (F.col(f"_n{n}") > 1))
            docs = docs.join(counts, key == F.col("_key"), "left").drop("_key")
            codes.append(F.when(F.col(f"_n{n}") > 1, code))
        elif "[]." in field:
            array, inner = field.split("[].")
            kind = docs.schema[array].dataType.elementType[inner].dataType.simpleString()
            bad = F.exists(F.col(array), lambda e: _broken(e[inner], kind, rule, argument))  # noqa: B023  called at once
            codes.append(F.when(F.coalesce(bad, F.lit(False)), code))
        else:
            codes.append(F.when(_broken(F.col(field), docs.schema[field].dataType.simpleString(), rule, argument), code))
    found = F.array_join(F.filter(F.array(*codes), lambda x: x.isNotNull()), ",")
    return docs.withColumn("violations", found).withColumn("valid", F.col("violations") == "")
