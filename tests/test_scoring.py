"""JSON scoring and schema rules: refusal reasons, odd flags, saved model on a stream, every rule broken."""

import tempfile

from pyspark.sql import functions as F

from larder.operators import scoring as sc
from larder.plans import scoring as ps
from larder.sources.binding import Marketplace
from larder.streaming import folds
from tests.conftest import MEDIUM, SMALL

GOOD = '{"product_name": "Cod", "category": " Vegetables ", "day_of_week": "monDAY", "weather_condition": " Rainy", "is_holiday": %s}'


def _parsed(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    return [r.asDict() for r in sc.parse_requests(df).orderBy("request_id").collect()]


def test_refusals_have_a_reason(spark):
    bodies = ["{", "", None, "[1]", '"text"', "{}", '{"product_name": 1, "category": 2, "day_of_week": 3}', GOOD % "0"]
    got = [r["error"] for r in _parsed(spark, bodies)]
    assert got == [sc.MALFORMED, sc.MALFORMED, sc.MALFORMED, sc.NO_OBJECT, sc.NO_OBJECT, "Missing required feature: product_name",
                   "Missing required feature: weather_condition", None]


def test_flag_and_fields_are_normalised(spark):
    flags = {"true": 1, "false": 0, "2": 1, "-3": 0, "0.9": 0, "1.9": 1, '"1"': 1, '" 4 "': 1, '"1.5"': 0, '"yes"': 0, "null": 0, '{"a": 1}': 0}
    got = _parsed(spark, [GOOD % f for f in flags])
    assert [r["is_holiday"] for r in got] == list(flags.values())
    r = got[0]
    assert (r["category"], r["day_of_week"], r["weather_condition"]) == ("vegetable", "Monday", "rainy")
    odd = _parsed(spark, ['﻿{"x": [1], "product_name": null, "category": null, "day_of_week": null, "weather_condition": 5}'])[0]
    assert odd == {"request_id": 0, "product_name": None, "category": "none", "day_of_week": "None", "weather_condition": "5", "is_holiday": 0, "error": None}


def test_saved_model_scores_a_stream_of_files_as_a_table(spark):
    mk = Marketplace(spark, SMALL)
    path = tempfile.mkdtemp(prefix="larder-model-")
    ps.request_model(mk, rounds=5, depth=2).save(spark, path)
    model = sc.RequestModel.load(spark, path)
    bodies = ps.request_bodies(mk).where(F.col("request_id") % 3 == 0)
    folder, out = tempfile.mkdtemp(prefix="larder-json-"), tempfile.mkdtemp(prefix="larder-json-")
    bodies.repartition(3).write.mode("overwrite").parquet(folder)
    src = spark.readStream.schema(bodies.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    folds.run_available(model.score(sc.parse_requests(src)), f"{out}/rows", f"{out}/ckpt", mode="append")
    got = spark.read.parquet(f"{out}/rows").select("request_id", "pred_quantity_sold", "pred_price", "error")
    want = ps.request_model(mk, rounds=5, depth=2).score(sc.parse_requests(bodies)).select(got.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    refused = got.where("error IS NOT NULL")
    assert refused.count() > 0 and refused.where("pred_price IS NOT NULL").isEmpty() and got.where("error IS NULL AND pred_price IS NULL").isEmpty()


def test_unseen_levels_are_scored(spark):
    model = ps.request_model(Marketplace(spark, SMALL), rounds=3, depth=2)
    body = '{"product_name": "?", "category": "stones", "day_of_week": "Never", "weather_condition": "fog"}'
    rows = sc.parse_requests(spark.createDataFrame([(1, body)], "request_id long, body string"))
    assert model.score(rows).first()["pred_price"] > 0


def test_every_rule_of_every_collection_is_broken(spark):
    found = ps.schema_violations(spark, MEDIUM).where("NOT valid").select("collection", F.explode(F.split("violations", ",")).alias("v")).distinct().collect()
    # a defaulted field of a type without an empty value cannot be absent
    want = {(c, f"{f}:{r}") for c, rules in sc.SCHEMAS.items() for f, r, _ in rules if r != "default"} - {("product", "stock:required")}
    assert {(r.collection, r.v) for r in found} == want


def test_rules_on_absent_optional_fields_and_empty_arrays_hold(spark):
    docs = spark.createDataFrame([(1, None, [], None), (2, "x", None, [("5", None)])],
                                 "buyer long, status string, items array<struct<name:string,price:double,quantity:double>>, "
                                 "supplierStatuses array<struct<supplier:string,status:string>>")
    docs = docs.withColumn("total", F.lit(1.0)).withColumn("paymentStatus", F.lit(None).cast("string"))
    assert [r.violations for r in sc.violations(docs, sc.SCHEMAS["order"]).orderBy("buyer").collect()] == ["", "status:enum"]


def test_metrics_and_best_parameters_are_written_as_json(spark):
    from larder.plans import models as pm
    from larder.sources.files import write_table
    path = tempfile.mkdtemp(prefix="larder-metrics-")
    grid = {"rounds": [2], "depth": [2], "rate": [0.1], "alpha": [0.0, 1.0]}
    table = pm.tuned_boosted_cv(spark, SMALL, draws=2, grid=grid)
    write_table(table, path, "json")
    back = spark.read.schema(table.schema).json(path)
    assert sorted(map(tuple, back.select(table.columns).collect()), key=str) == sorted(map(tuple, table.collect()), key=str)
    assert back.where("best").count() == 1
