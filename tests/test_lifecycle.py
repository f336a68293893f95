"""Product lifecycle and notifications: every outcome and site occurs, small cases, repeated batches."""

import datetime
import os
import tempfile

from pyspark.sql import functions as F

from larder.operators import notify as nt
from larder.plans import lifecycle as lc
from larder.plans.events import order_pairs, payment_events
from larder.sources.binding import Marketplace
from larder.streaming import folds
from tests.conftest import MEDIUM, SMALL

DAY = datetime.datetime(2024, 5, 1)


def test_every_outcome_and_site_occurs(spark):
    outcomes = {r[0] for r in lc.product_event_outcomes(spark, MEDIUM).select("outcome").distinct().collect()}
    assert outcomes == {"accepted", "forbidden", "not_found", "verification_required"}
    told = lc.all_notifications(spark, MEDIUM)
    assert {r[0] for r in told.select("site").distinct().collect()} == set(nt.SITES) and len(nt.SITES) == 13
    assert told.count() == told.select("notification_key").distinct().count()
    state = lc.product_lifecycle(spark, MEDIUM)
    assert state.where("deleted").count() > 0
    hidden = lc.catalogue_after_lifecycle(spark, MEDIUM).join(state.where("deleted").select("product_id"), "product_id")
    assert hidden.isEmpty()


def _events(spark, rows):
    return spark.createDataFrame([(i, DAY + datetime.timedelta(hours=i), *r) for i, r in enumerate(rows)],
                                 "event_id long, ts timestamp, actor_id long, role string, product_id long, action string, value long")


def test_lifecycle_refusals_in_order_and_tombstone(spark):
    products = spark.createDataFrame([(1, "Cod", "fish", 7, 5, True), (2, "Rye", "grain", 8, 4, True)],
                                     "product_id long, name string, category string, supplier_id long, stock int, is_active boolean")
    suppliers = spark.createDataFrame([(7, "approved"), (8, "pending"), (9, "approved")], "user_id long, verification_status string")
    rows = [(7, "supplier", 1, "stock", 12), (9, "supplier", 1, "stock", 99), (8, "supplier", 2, "stock", 99), (0, "admin", 2, "deactivate", 0),
            (7, "supplier", 5, "stock", 1), (9, "supplier", 1, "delete", 0), (7, "supplier", 1, "delete", 0), (0, "admin", 1, "activate", 0),
            (77, "supplier", 1, "stock", 1)]
    out = nt.lifecycle_outcomes(_events(spark, rows), products, suppliers)
    got = [r.outcome for r in out.orderBy("event_id").collect()]
    assert got == ["accepted", "forbidden", "verification_required", "accepted", "not_found", "forbidden", "accepted", "not_found",
                   "verification_required"]
    state = nt.lifecycle_state(out, products)
    assert {(r.product_id, r.stock, r.is_active, r.deleted) for r in state.collect()} == {(1, 12, True, True), (2, 4, False, False)}
    assert nt.listed(state, suppliers).isEmpty()


def _told(spark, rows, admins=((1,), (2,))):
    cols = "event_key string, kind string, ts timestamp, user_id long, order_id long, name string, subject string, status string, before string, notes string"
    events = spark.createDataFrame([(f"e{i}", kind, DAY, *rest) for i, (kind, *rest) in enumerate(rows)], cols)
    pairs = spark.createDataFrame([(10, 70), (10, 71), (10, 70)], "order_id long, supplier_id long")
    office = spark.createDataFrame(list(admins), "user_id long")
    return sorted((r.site, r.user_id, r.title, r.message) for r in nt.notifications(events, pairs, office).collect())


def test_rules_answer_changes_only(spark):
    same = ("listing", 5, None, None, "Cod", "active", "active", None)
    assert _told(spark, [same, ("review_status", 5, None, None, "T", "pending", "approved", None),
                         ("review_status", 5, None, None, "T", "rejected", "rejected", None)]) == []
    assert _told(spark, [("listing", 5, None, None, "Cod", "inactive", "active", None)]) == [
        ("listing_changed", 5, "Product Listing Flagged/Rejected",
         'Your product listing "Cod" has been flagged and temporarily deactivated by administrators.')]


def test_recipients_of_an_approval_a_review_and_a_rejection(spark):
    got = _told(spark, [("payment", 3, 10, None, "000010", "approve", None, None)])
    assert [(s, u) for s, u, *_ in got] == [("order_available", 70), ("order_available", 71), ("payment_approved", 3)]
    assert [u for _, u, *_ in _told(spark, [("review", None, None, "Ann", "an order", None, None, None)])] == [1, 2]
    assert [u for _, u, *_ in _told(spark, [("bank_order", None, 10, "Ann", None, None, None, None)])] == [1]
    assert _told(spark, [("bank_order", None, 10, "Ann", None, None, None, None)], admins=[(None,)]) == []
    got = _told(spark, [("verification", 8, None, "Firm", None, "rejected", "pending", "  ")])
    assert got[0][3].endswith("Reason:   ") and _told(spark, [("verification", 8, None, "Firm", None, "rejected", "pending", None)])[0][3].endswith(
        "Reason: No reason provided.")


def test_resubmission_texts_follow_the_previous_status(spark):
    titles = {}
    for before in (None, "rejected", "information_requested"):
        got = _told(spark, [("verification", 8, None, "Firm", None, "pending", before, None)])
        titles[before] = sorted({(s, t) for s, _, t, _ in got})
        assert len(got) == 3                      # the supplier and both administrators
    assert titles[None] == [("verification_received", "Verification Submitted"),
                            ("verification_to_review", "New Supplier Verification Request Submitted")]
    assert titles["rejected"][1][1] == "Supplier Verification Resubmitted"
    assert titles["information_requested"][1][1] == "Verification Documents Updated"


def test_stream_of_payment_events_appends_each_batch_once(spark):
    mk = Marketplace(spark, SMALL)
    shape = payment_events(mk).distinct().join(mk.orders.select("order_id", "buyer_id"), "order_id").select(
        F.concat_ws("-", F.lit("payment"), "order_id", "seq", F.col("ts").cast("string"), "action").alias("event_key"), F.lit("payment").alias("kind"), "ts",
        F.col("buyer_id").alias("user_id"), "order_id", F.lit("").alias("name"), F.col("order_id").cast("string").alias("subject"),
        F.col("action").alias("status"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("notes"))
    folder, out = tempfile.mkdtemp(prefix="larder-k13-"), tempfile.mkdtemp(prefix="larder-k13-")
    shape.repartition(3).write.mode("overwrite").parquet(folder)
    office = lc.admins(mk).select("user_id")
    src = spark.readStream.schema(shape.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    # the same stream from a new checkpoint writes the same batches over themselves
    for run in range(2):
        folds.run_available(nt.notifications(src, order_pairs(mk), office), out, os.path.join(out, f"_ckpt{run}"), mode="append")
    got = spark.read.parquet(*[os.path.join(out, d) for d in os.listdir(out) if d.startswith("batch=")])
    want = nt.notifications(shape, order_pairs(mk), office)
    assert got.count() == want.count() == got.select("notification_key").distinct().count()
    assert got.select("notification_key").exceptAll(want.select("notification_key")).isEmpty()
