"""Cases of state folds, readers and models that the driver tables do not show."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from larder.operators import billing, events, models
from larder.sources import files

DAY = datetime.datetime(2024, 1, 1)


def at(n):
    return DAY + datetime.timedelta(days=n)


def test_payment_fold_keeps_the_last_value_of_each_field(spark):
    log = [(1, "approve", 1), (1, "reupload", 2), (2, "approve", 1), (2, "reject", 2), (3, "reject", 1),
           (4, "reupload", 1), (4, "approve", 2)]
    df = spark.createDataFrame([(o, at(t), 0, a) for o, a, t in log], "order_id long, ts timestamp, seq int, action string")
    got = {r.order_id: (r.payment_status, r.order_status_reset, r.entries_reset_at) for r in events.payment_fold(df).collect()}
    assert got == {1: ("Pending Verification", "Pending Payment Verification", at(1)), 2: ("Rejected", "Pending", at(1)),
                   3: ("Rejected", None, None), 4: ("Approved", "Pending", at(2))}


def test_only_the_first_payment_pays(spark):
    inv = spark.createDataFrame([(1, 7, "Unpaid"), (2, 7, "Paid")], "invoice_id long, buyer_id long, status string")
    req = [(10, 1, 8, at(0)), (11, 1, 7, at(1)), (12, 1, 7, at(2)), (13, 2, 7, at(0)), (14, 9, 7, at(0))]
    got = billing.pay_invoices(spark.createDataFrame(req, "request_id long, invoice_id long, user_id long, requested_at timestamp"), inv)
    assert {r.request_id: (r.outcome, r.status_after) for r in got.collect()} == {
        10: ("forbidden", "Unpaid"), 11: ("paid", "Paid"), 12: ("already_paid", "Paid"), 13: ("already_paid", "Paid"),
        14: ("not_found", None)}


def test_override_sets_existing_entries_or_creates_all(spark):
    schema = "order_id long, supplier_id long, ts timestamp, seq int, status string"
    log = spark.createDataFrame([(1, 1, at(1), 1, "Pending"), (1, 2, at(9), 1, "Pending"), (2, 3, at(9), 1, "Pending"),
                                 (2, 4, at(9), 1, "Pending")], schema)
    over = spark.createDataFrame([(1, at(5), 0, "Cancelled"), (2, at(5), 0, "Cancelled")],
                                 "order_id long, ts timestamp, seq int, status string")
    got = events.apply_overrides(log, over, log).where("status = 'Cancelled'")
    assert {(r.order_id, r.supplier_id) for r in got.collect()} == {(1, 1), (2, 3), (2, 4)}


def test_predictions_of_several_files(spark, tmp_path):
    df = spark.createDataFrame([(float(i), i + 0.5, "fish", f"2024-01-{i:02d}") for i in range(1, 10)],
                               "actual double, predicted double, category string, date string")
    files.write_table(df.repartition(3), str(tmp_path / "p"), "csv")
    back = files.read_predictions(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "odd.csv").write_text('actual,predicted,category,date\n\n1,x,"a, 2024-01-01 \n1,2\n  \n3,4,b,d,e\n')
    odd = files.read_predictions(spark, str(tmp_path / "odd.csv"))
    assert sorted(map(tuple, odd.collect())) == [(1.0, 0.0, '"a', "2024-01-01"), (3.0, 4.0, "b", "d")]


def test_margin_default_only_without_a_file(spark, tmp_path):
    assert files.read_margin(spark, str(tmp_path / "none")) == files.DEFAULT_MARGIN
    files.save_margin(spark, str(tmp_path / "m"), "20")
    assert files.read_margin(spark, str(tmp_path / "m")) == 20


def test_unseen_level_encodes_as_zeros(spark):
    from pyspark.ml import Pipeline
    stages, outs = models.one_hot_stages(["c"])
    fitted = Pipeline(stages=stages).fit(spark.createDataFrame([("a",), ("b",), ("d",)], "c string"))
    got = {r.c: r[outs[0]].toArray().tolist() for r in fitted.transform(
        spark.createDataFrame([("a",), ("b",), ("zzz",)], "c string")).collect()}
    assert got == {"a": [1, 0, 0], "b": [0, 1, 0], "zzz": [0, 0, 0]}


def test_ar_forecast_reads_no_test_value(spark):
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=80)) + 50
    cut = datetime.date(2024, 3, 1)
    dates = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(80)]

    def run(values):
        df = spark.createDataFrame([("k", d, float(v)) for d, v in zip(dates, values, strict=True)], "k string, date date, v double")
        return [r.predicted for r in models.ar2_forecast(df, "k", "v", cut).orderBy("date").collect()]

    changed = y.copy()
    changed[65:] += 1000
    got = run(y)
    assert got == run(changed)
    n = sum(d < cut for d in dates)
    d = np.diff(y[:n])
    x = np.stack([np.ones(len(d) - 2), d[1:-1], d[:-2]], axis=1)
    c = np.linalg.lstsq(x, d[2:], rcond=None)[0]
    level, d0, d1, want = y[n - 1], d[-1], d[-2], []
    for _ in range(80 - n):
        d0, d1 = c @ [1, d0, d1], d0
        level += d0
        want.append(level)
    assert np.allclose(got, want, atol=1e-6)


def test_seasonal_regression_of_a_thousand_series(spark):
    days = spark.range(120).select(F.date_add(F.lit(datetime.date(2024, 1, 1)), F.col("id").cast("int")).alias("date"),
                                   F.col("id").alias("t"))
    grid = (days.crossJoin(spark.range(1000).select(F.col("id").alias("k")))
            .select("k", "date", (F.col("t") % 29 == 0).cast("int").alias("is_holiday"),
                    (F.col("k") + F.col("t") * 0.1 + 3 * F.sin(2 * np.pi * F.datediff("date", F.lit(datetime.date(2000, 1, 1))) / 7)
                     + F.when(F.col("t") % 29 == 0, 5).otherwise(0)).alias("v")))
    cut = datetime.date(2024, 4, 1)
    out = models.seasonal_regression(grid.where(F.col("date") < F.lit(cut)), grid.where(F.col("date") >= F.lit(cut)), "k", "v")
    row = out.agg(F.countDistinct("k"), F.max(F.abs(F.col("actual") - F.col("predicted"))),
                  F.min(F.col("upper") - F.col("lower"))).first()
    assert row[0] == 1000 and row[1] < 1.0 and row[2] >= 0
    x = out.where("k = 7").orderBy("date").first()
    assert abs(x.trend + x.weekly + x.yearly + x.holiday - x.predicted) < 1e-9


def test_supplier_orders_part_the_lines_by_their_number(spark, monkeypatch):
    from larder.operators import supplier as sup
    lines = spark.createDataFrame([(i // 4 if i % 17 else None, i, i % 3, 2.0 + i % 5, None if i % 2 else 1.5, 2.0) for i in range(400)],
                                  "order_id long, line_no int, supplier_id long, price double, supplier_price double, quantity double")
    orders = spark.createDataFrame([(i, "Pending", "Approved", None) for i in [*range(90), 5, 6]],
                                   "order_id long, status string, payment_status string, order_date date")
    want = sorted(map(str, sup.supplier_orders(lines, orders).collect()))
    monkeypatch.setattr(sup, "TASK_ROWS", 20)
    dealt = sup.supplier_orders(lines, orders)
    assert sorted(map(str, dealt.collect())) == want
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString() and sup.dealt_by(lines, "order_id").rdd.getNumPartitions() == 20


def test_encoding_computes_its_rows_once_more_at_most(spark):
    import datetime
    from larder.plans import features as pf
    rows = [(datetime.date(2020, 1, 1) + datetime.timedelta(days=i % 20), ["b", "a", None, "late"][3 if i % 20 > 17 else i % 3], i) for i in range(60)]
    df = spark.createDataFrame(rows, "date date, category string, n int").repartition(3)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    got = pf.encoded(df.mapInArrow(count, df.schema), ["category"]).collect()
    assert made.value == 2 * 60         # the dates and levels, and the rows
    assert {(r["category_column"], tuple(r["category_vec"].toArray())) for r in got} == {("category_a", (1.0, 0.0)), ("category_b", (0.0, 1.0)), (None, (0.0, 0.0))}
    assert {r["split"] for r in got if r["date"] < datetime.date(2020, 1, 17)} == {"train"} and sum(r["split"] == "test" for r in got) == 12


def test_requests_are_parsed_once_a_row(spark):
    from larder.operators import scoring as sc
    whole = '{"product_name": "p", "category": %s, "day_of_week": " MONDAY ", "weather_condition": null, "is_holiday": %s}'
    bodies = [(whole % ('" Grains"', '" +2 "'), ("p", "grain", "Monday", "none", 1, None)), (whole % ("1.50", "0.5"), ("p", "1.5", "Monday", "none", 0, None)),
              ("﻿ \t\r\n" + whole % ('"FISH"', "true"), ("p", "fish", "Monday", "none", 1, None)), (whole % ('{"a": [1]}', "{}"), ("p", '{"a":[1]}', "Monday", "none", 0, None)),
              ("﻿﻿{}", (None,) * 5 + (sc.MALFORMED,)), (None, (None,) * 5 + (sc.MALFORMED,)), (' ["{"]', (None,) * 5 + (sc.NO_OBJECT,)),
              ('"{"', (None,) * 5 + (sc.NO_OBJECT,)), (" {}", (None,) * 5 + ("Missing required feature: product_name",))]
    rows = sc.parse_requests(spark.createDataFrame([(i, b) for i, (b, _) in enumerate(bodies)], "request_id long, body string"))
    assert [tuple(r)[1:] for r in rows.orderBy("request_id").collect()] == [want for _, want in bodies]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") < 20 and plan.count("schemaOfVariant(") == 1


def test_equal_rows_of_later_batches_are_not_predicted_again(monkeypatch):
    from larder.operators import boosting as bo
    trees = bo.Trees(1.0, 1.0)
    trees.add({"feature": np.array([0, -1, -1]), "cut": np.array([4, 0, 0]), "left": np.array([1, -1, -1]), "value": np.array([0.0, 2.0, 3.0]), "gain": np.zeros(3)})
    walked, walk = [], bo.Trees._walk
    monkeypatch.setattr(bo.Trees, "_walk", lambda self, x: (walked.append(len(x)), walk(self, x))[1])
    for width in (3, 11):
        x, known = np.random.default_rng(width).integers(0, 9, (500, width)).astype(np.uint8), {}
        x[:, 1:] //= 8
        want = walk(trees, x)
        assert np.array_equal(trees.predict_kept(x, known), want) and np.array_equal(trees.predict(x), want)
        walked.clear()
        assert np.array_equal(trees.predict_kept(x[::-1], known), want[::-1]) and not walked
        monkeypatch.setattr(bo, "KNOWN_ROWS", 7)
        assert np.array_equal(trees.predict_kept(x[:5], known), want[:5]) and np.array_equal(trees.predict_kept(x, known), want)
        monkeypatch.undo()
        monkeypatch.setattr(bo.Trees, "_walk", lambda self, x: (walked.append(len(x)), walk(self, x))[1])


def test_request_model_reads_its_rows_once(spark):
    from larder.operators import scoring as sc
    read = spark.sparkContext.accumulator(0)

    def counted(it):
        for b in it:
            read.add(b.num_rows)
            yield b
    rows = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("c"), (F.col("id") % 2).cast("int").alias("n"),
                                   (F.col("id") % 3 + F.col("id") % 2).cast("double").alias("y"), "id")
    model = sc.RequestModel.train(rows.mapInArrow(counted, rows.schema), ["c"], ["n"], ["y"], dict(kind="boost", rounds=5, depth=2), F.col("id") % 10)
    assert read.value == 300 and model.levels == {"c": ["c0", "c1", "c2"]}
    asked = spark.createDataFrame([(1, "c1", 0, None), (2, None, 1, None), (3, "new", 1, None), (4, "c1", 0, "bad"), (5, "c1", 0, None)], "k int, c string, n int, error string")
    got = [tuple(r) for r in model.score(asked, ["k"]).orderBy("k").collect()]
    assert got[0][1] == got[4][1] and got[1][1] == got[2][1] != got[0][1] and got[3] == (4, None)
    assert model.score(asked).columns == ["k", "c", "n", "error", "pred_y"]


def test_supplier_orders_part_few_lines_too(spark, monkeypatch):
    from larder.operators import supplier as sup
    lines = spark.range(400).select((F.col("id") % 90).alias("order_id"), F.col("id").cast("int").alias("line_no"), (F.col("id") % 3).alias("supplier_id"),
                                    F.lit(2.0).alias("price"), F.lit(None).cast("double").alias("supplier_price"), F.lit(1.0).alias("quantity"))
    orders = spark.range(90).select(F.col("id").alias("order_id"), F.lit("Pending").alias("status"), F.lit("Approved").alias("payment_status"),
                                    F.lit(None).cast("date").alias("order_date"))
    want = sorted(map(str, sup.supplier_orders(lines, orders).collect()))
    monkeypatch.setattr(sup, "TASK_ROWS", 200)      # two parts, fewer than the session's
    dealt = sup.supplier_orders(lines, orders)
    assert sorted(map(str, dealt.collect())) == want and "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString()
    assert sup.dealt_by(lines, "order_id").rdd.getNumPartitions() == 2
