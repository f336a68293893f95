"""One order state from all its events (K6, K7 and K8 together).

Events of an order, in the order (ts, seq, kind, status):
  supplier   the supplier sets its own entry (made if it has none); the order's status
             becomes the roll-up of the entries
  admin      sets the order and every entry; entries are made for all suppliers of an
             order that has none
  approve    payment approved: the order and every entry go back to Pending
  reject     payment rejected; nothing else
  reupload   a new slip: the order waits for payment verification, entries stay

``admin`` and ``approve`` are barriers: an entry holds its supplier's last status only if
that came after the last barrier. So the state follows from the first and last events of
an order and of its suppliers (aggregates that combine map-side and do not depend on the
order of arrival); no event list is gathered. ``larder.streaming.state`` keeps the same
few facts per order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# place of a kind among events of one instant
KINDS = {"supplier": 0, "admin": 1, "approve": 2, "reject": 3, "reupload": 4}
BARRIERS, PAYMENTS = ("admin", "approve"), ("approve", "reject", "reupload")
WAITING = "Pending Payment Verification"
PAYMENT_STATUS = {"approve": "Approved", "reject": "Rejected", "reupload": "Pending Verification"}
STATE = "order_id long, order_status string, payment_status string, n_entries long, n_live long, entries string"


def order_state(events: DataFrame, pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """``STATE`` rows of every order.

    ``events``: order_id, supplier_id, ts, seq, kind, status. ``pairs``: order_id,
    supplier_id, initial (an entry exists from the start). ``orders``: order_id,
    payment_method. Events of suppliers that are not part of the order are refused.
    """
    kind = F.col("kind")
    place = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[kind]
    events = events.join(pairs.select("order_id", "supplier_id", F.lit(True).alias("known")), ["order_id", "supplier_id"], "left")
    events = events.where((kind != "supplier") | F.col("known")).select(
        "order_id", "supplier_id", "kind", "status", F.struct("ts", "seq", place.alias("place"), F.coalesce("status", F.lit(""))).alias("rank"))
    at = F.col("rank")
    sets, barrier, admin, own = kind != "reject", kind.isin(*BARRIERS), kind == "admin", kind == "supplier"
    per_order = events.groupBy("order_id").agg(
        F.max_by(F.struct("kind", "status"), F.when(sets, at)).alias("setter"), F.max(F.when(barrier, at)).alias("barrier"),
        F.max_by(F.when(admin, F.col("status")).otherwise("Pending"), F.when(barrier, at)).alias("barrier_status"),
        F.min(F.when(admin, at)).alias("first_admin"), F.min(F.when(own, at)).alias("first_own"),
        F.max_by(kind, F.when(kind.isin(*PAYMENTS), at)).alias("payment"))
    mine = events.where(own).groupBy("order_id", "supplier_id").agg(
        F.max_by("status", "rank").alias("own_status"), F.max("rank").alias("own_last"), F.min("rank").alias("own_first"))
    started = pairs.groupBy("order_id").agg(F.max("initial").alias("any_initial"))
    e = (pairs.join(mine, ["order_id", "supplier_id"], "left").join(per_order, "order_id", "left").join(started, "order_id"))
    # an override of an order without entries makes them all
    made = ~F.col("any_initial") & F.col("first_admin").isNotNull() & (
        F.col("first_own").isNull() | (F.col("first_own") > F.col("first_admin")))
    before = F.col("initial") | F.coalesce(F.col("own_first") < F.col("barrier"), F.lit(False)) | (made & (F.col("first_admin") <= F.col("barrier")))
    after = F.col("own_last").isNotNull() & (F.col("barrier").isNull() | (F.col("own_last") > F.col("barrier")))
    status = (F.when(after, F.col("own_status")).when(F.col("barrier").isNotNull() & before, F.col("barrier_status"))
              .when(F.col("initial"), "Pending"))
    e = e.select("order_id", "supplier_id", status.alias("s")).where("s IS NOT NULL")
    live = F.col("s") != "Cancelled"
    rolled = e.groupBy("order_id").agg(
        F.count("*").alias("n_entries"), F.count_if(live).alias("n_live"), F.count_if(F.col("s") == "Delivered").alias("done"),
        F.count_if(F.col("s").isin("In Transit", "Delivered")).alias("moving"),
        F.array_sort(F.collect_list(F.struct("supplier_id", "s"))).alias("list"))      # the suppliers of one order
    rollup = (F.when(F.col("n_live") == 0, "Cancelled").when(F.col("done") == F.col("n_live"), "Delivered")
              .when(F.col("moving") > 0, "In Transit").otherwise("Pending"))
    out = orders.select("order_id", "payment_method").join(rolled, "order_id", "left").join(per_order.select("order_id", "setter", "payment"),
                                                                                           "order_id", "left")
    bank = F.col("payment_method") == "bank"
    k = F.col("setter.kind")
    order_status = (F.when(k == "supplier", rollup).when(k == "admin", F.col("setter.status")).when(k == "approve", "Pending")
                    .when(k == "reupload", WAITING).when(bank, WAITING).otherwise("Pending"))
    paid = F.coalesce(*[F.when(F.col("payment") == a, s) for a, s in PAYMENT_STATUS.items()],
                      F.when(bank, "Pending Verification").otherwise("Approved"))
    text = F.array_join(F.transform("list", lambda x: F.concat(x["supplier_id"].cast("string"), F.lit(":"), x["s"])), ",")
    zero = F.lit(0).cast("long")
    return out.select("order_id", order_status.alias("order_status"), paid.alias("payment_status"), F.coalesce("n_entries", zero).alias("n_entries"),
                      F.coalesce("n_live", zero).alias("n_live"), F.coalesce(text, F.lit("")).alias("entries"))
