"""Batch = stream: the streaming folds end in the same state as the batch
operators over the same events."""

import datetime
import os
import tempfile

from pyspark.sql import functions as F

from larder.operators import billing, events as ev, order_state
from larder.plans.events import order_events, order_pairs, status_events
from larder.sources.binding import Marketplace
from larder.streaming import folds, state
from tests.conftest import SMALL


def _stage(df, folder, by_year_col):
    """Write one parquet file per year so the stream sees ordered batches."""
    years = sorted(r[0] for r in df.select(F.year(by_year_col)).distinct().collect())
    for y in years:
        df.where(F.year(by_year_col) == y).coalesce(1).write.parquet(os.path.join(folder, f"y{y}"))
    return years


def _stream(spark, folder, schema):
    paths = sorted(os.path.join(folder, d) for d in os.listdir(folder))
    staged = tempfile.mkdtemp(prefix="larder-src-")
    # one flat folder, files named in year order, one file per trigger
    for i, p in enumerate(paths):
        for f in sorted(os.listdir(p)):
            if f.endswith(".parquet"):
                os.link(os.path.join(p, f), os.path.join(staged, f"{i:04d}-{f}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(staged)


def test_status_rollup_stream_equals_batch(spark):
    mk = Marketplace(spark, SMALL)
    evs = status_events(mk)
    work = tempfile.mkdtemp(prefix="larder-k6-")
    _stage(evs, os.path.join(work, "in"), "ts")
    src = _stream(spark, os.path.join(work, "in"), evs.schema)
    out = os.path.join(work, "out")
    folds.run_available(folds.stream_status_rollup(src), out, os.path.join(work, "ckpt"))
    got = folds.final_state(spark, out, ["order_id"])
    last = ev.latest(evs, ["order_id", "supplier_id"], ["ts", "seq", "status"], ["status"])
    want = ev.rollup_status(last)
    assert got.select("order_id", "order_status", "n_live").exceptAll(want).count() == 0
    assert want.exceptAll(got.select("order_id", "order_status", "n_live")).count() == 0


def test_credit_admission_stream_equals_batch(spark):
    mk = Marketplace(spark, SMALL)
    net = mk.orders.where(F.col("payment_method") == "net30").select("order_id", "buyer_id", "created_at", "total")
    work = tempfile.mkdtemp(prefix="larder-k2-")
    _stage(net, os.path.join(work, "in"), "created_at")
    src = _stream(spark, os.path.join(work, "in"), net.schema)
    out = os.path.join(work, "out")
    folds.run_available(folds.stream_credit_admission(src, mk.buyers), out, os.path.join(work, "ckpt"))
    got = spark.read.parquet(out)
    assert got.where("late").count() == 0
    want = billing.credit_admission(net, mk.buyers).select("order_id", "accepted", "outstanding_after")
    g = got.select("order_id", "accepted", "outstanding_after")
    assert g.exceptAll(want).count() == 0 and want.exceptAll(g).count() == 0


def test_windowed_counts_stream_equals_batch(spark):
    mk = Marketplace(spark, SMALL)
    o = mk.orders.select("order_id", "created_at", "total")
    work = tempfile.mkdtemp(prefix="larder-a6-")
    _stage(o, os.path.join(work, "in"), "created_at")
    src = _stream(spark, os.path.join(work, "in"), o.schema)
    out = os.path.join(work, "out")
    folds.run_available(folds.windowed_counts(src, "created_at", "7 days", "3650 days", "total"), out,
                        os.path.join(work, "ckpt"))
    got = folds.final_state(spark, out, ["window_start", "window_end"]).select("window_start", "window_end", "n")
    want = (o.groupBy(F.window(F.col("created_at").cast("timestamp"), "7 days").alias("w")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _chunks(spark, df, parts):
    """A stream over ``parts`` files, one per trigger, in no order of time."""
    folder = tempfile.mkdtemp(prefix="larder-mixed-")
    df.repartition(parts).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _final(spark, out, cols, key):
    rows = spark.read.parquet(out).where("NOT late")
    last = rows.groupBy(*key).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, [*key, "batch_id"]).select(cols)


def test_order_state_stream_equals_batch(spark):
    mk = Marketplace(spark, SMALL)
    events, pairs = order_events(mk), order_pairs(mk)
    work = tempfile.mkdtemp(prefix="larder-k8-")
    src = _chunks(spark, events, 3)
    folds.run_available(state.stream_order_state(src, pairs, mk.orders, "40000 days", "40000 days"), f"{work}/out", f"{work}/ckpt")
    want = order_state.order_state(events, pairs, mk.orders)
    got = _final(spark, f"{work}/out", want.columns, ["order_id"])
    touched = want.join(events.select("order_id").distinct(), "order_id", "left_semi").select(want.columns)
    assert got.exceptAll(touched).count() == 0 and touched.exceptAll(got).count() == 0


def _case(spark, rows):
    events = spark.createDataFrame([(o, s, datetime.datetime(2024, 1, d), i, k, st) for i, (o, s, d, k, st) in enumerate(rows)],
                                   "order_id long, supplier_id long, ts timestamp, seq long, kind string, status string")
    pairs = spark.createDataFrame([(1, 5, True), (1, 6, True), (2, 5, False), (3, 5, True)], "order_id long, supplier_id long, initial boolean")
    orders = spark.createDataFrame([(1, "bank"), (2, "card"), (3, "card"), (4, "bank")], "order_id long, payment_method string")
    return events, pairs, orders


def test_approval_resets_entries_and_a_new_slip_waits(spark):
    rows = [(1, 5, 1, "supplier", "Delivered"), (1, None, 2, "approve", None), (1, None, 3, "reupload", None)]
    got = {r.order_id: tuple(r)[1:] for r in order_state.order_state(*_case(spark, rows)).collect()}
    assert got[1] == ("Pending Payment Verification", "Pending Verification", 2, 2, "5:Pending,6:Pending")
    assert got[4] == ("Pending Payment Verification", "Pending Verification", 0, 0, "")
    rows += [(1, 6, 4, "supplier", "In Transit"), (1, None, 5, "reject", None), (1, 99, 6, "supplier", "Cancelled"),
             (2, None, 2, "admin", "Cancelled"), (2, 5, 1, "supplier", "Delivered")]
    got = {r.order_id: tuple(r)[1:] for r in order_state.order_state(*_case(spark, rows)).collect()}
    assert got[1] == ("In Transit", "Rejected", 2, 2, "5:Pending,6:In Transit")      # 99 is no supplier of the order
    assert got[2] == ("Cancelled", "Approved", 1, 0, "5:Cancelled") and got[3] == ("Pending", "Approved", 1, 1, "5:Pending")
    # an override of an order without entries makes them
    got = {r.order_id: tuple(r)[1:] for r in order_state.order_state(*_case(spark, [(2, None, 1, "admin", "In Transit")])).collect()}
    assert got[2] == ("In Transit", "Approved", 1, 1, "5:In Transit")


def test_closed_order_leaves_state_and_late_rows_are_set_aside(spark):
    folder, work = tempfile.mkdtemp(prefix="larder-late-"), tempfile.mkdtemp(prefix="larder-k8-")
    batches = [[(3, 5, 1, "supplier", "Delivered")], [(1, 5, 20, "supplier", "In Transit")], [(1, 5, 21, "supplier", "In Transit")],
               [(3, 5, 2, "supplier", "Cancelled")]]
    for i, rows in enumerate(batches):
        events, pairs, orders = _case(spark, rows)
        events.coalesce(1).write.parquet(f"{folder}/b{i}")
        part = next(f for f in os.listdir(f"{folder}/b{i}") if f.endswith(".parquet"))
        os.link(f"{folder}/b{i}/{part}", f"{folder}/{i}.parquet")
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "?.parquet").parquet(folder)
    folds.run_available(state.stream_order_state(src, pairs, orders, "2 days", "1 day"), f"{work}/out", f"{work}/ckpt")
    out = spark.read.parquet(f"{work}/out").where("order_id = 3").orderBy("batch_id").collect()
    assert [(r.order_status, r.closed, r.late) for r in out][:2] == [("Delivered", False, False), ("Delivered", True, False)]
    assert out[-1].late and all(r.order_status == "Delivered" for r in out if not r.late)


def test_credit_stream_starts_at_the_open_invoices(spark):
    mk = Marketplace(spark, SMALL)
    net = mk.orders.where(F.col("payment_method") == "net30").select("order_id", "buyer_id", "created_at", "total")
    work = tempfile.mkdtemp(prefix="larder-k2-")
    _stage(net, os.path.join(work, "in"), "created_at")
    src = _stream(spark, os.path.join(work, "in"), net.schema)
    start = billing.open_balances(mk.invoices, net)
    folds.run_available(state.stream_credit(src, mk.buyers, start), f"{work}/out", f"{work}/ckpt")
    got = spark.read.parquet(f"{work}/out")
    assert got.where("late").count() == 0
    want = billing.credit_admission(net, mk.buyers, mk.invoices).select("order_id", "accepted", "outstanding_after")
    g = got.select("order_id", "accepted", "outstanding_after")
    assert g.exceptAll(want).count() == 0 and want.exceptAll(g).count() == 0
