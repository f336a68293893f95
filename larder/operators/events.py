"""State changes as folds over event logs (section K), batch form.

The reference mutates stored documents one request at a time. Here each
state is a fold over an append-only log: the latest event per key (a
``max_by`` aggregate, which combines map-side, so a hot key costs no more
than its partial aggregates), followed by a roll-up where needed. The
streaming forms in ``larder.streaming`` produce the same final tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.functions.columns import company_or_name


def latest(events: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Latest value(s) per key by (order columns) — ties broken by the
    later columns of ``order``."""
    rank = F.struct(*order)
    return events.groupBy(*key).agg(
        *[F.max_by(F.col(v), rank).alias(v) for v in values],
        F.max(rank).alias("_last")).select(*key, *values, F.col("_last").alias("last_event"))


def rollup_status(entries: DataFrame, status: str = "status") -> DataFrame:
    """K6 roll-up per order: Cancelled entries are ignored; none left ->
    Cancelled; all Delivered -> Delivered; any In Transit or Delivered ->
    In Transit; else Pending."""
    s = F.col(status)
    live = s != "Cancelled"
    g = entries.groupBy("order_id").agg(
        F.count_if(live).alias("n_live"),
        F.count_if(live & (s == "Delivered")).alias("n_delivered"),
        F.count_if(live & s.isin("In Transit", "Delivered")).alias("n_moving"))
    overall = (F.when(F.col("n_live") == 0, "Cancelled")
               .when(F.col("n_delivered") == F.col("n_live"), "Delivered")
               .when(F.col("n_moving") > 0, "In Transit").otherwise("Pending"))
    return g.select("order_id", overall.alias("order_status"), "n_live")


def apply_overrides(status_events: DataFrame, overrides: DataFrame, pairs: DataFrame) -> DataFrame:
    """K7: an admin override (order_id, ts, seq, status) sets every
    supplier entry of the order that exists at that time; only when there is
    none, entries are created for all the order's suppliers. Later supplier
    events still apply after it."""
    first = status_events.groupBy("order_id", "supplier_id").agg(F.min("ts").alias("_first"))
    order_first = first.groupBy("order_id").agg(F.min("_first").alias("_order_first"))
    fan = (overrides.join(pairs.select("order_id", "supplier_id").distinct(), "order_id")
           .join(first, ["order_id", "supplier_id"], "left").join(order_first, "order_id", "left")
           .where(F.col("_order_first").isNull() | (F.col("_order_first") > F.col("ts"))
                  | (F.col("_first") <= F.col("ts"))))
    cols = ["order_id", "supplier_id", "ts", "seq", "status"]
    return status_events.select(*cols).unionByName(fan.select(*cols))


def payment_fold(events: DataFrame) -> DataFrame:
    """K8: per field, the latest event that sets it wins. Payment status:
    approve -> Approved, reject -> Rejected, re-upload -> Pending
    Verification. Order status: approve -> Pending, re-upload -> Pending
    Payment Verification; a rejection leaves it. ``entries_reset_at`` is the
    last approval, which resets the supplier entries to Pending."""
    rank = F.struct("ts", "seq", "action")
    a = F.col("action")
    sets_order = F.when(a != "reject", rank)
    last = events.groupBy("order_id").agg(
        F.max_by(a, rank).alias("action"), F.max_by(a, sets_order).alias("_order_action"),
        F.max(F.when(a == "approve", F.col("ts"))).alias("entries_reset_at"))
    o = F.col("_order_action")
    return last.select(
        "order_id", "action",
        F.when(a == "approve", "Approved").when(a == "reject", "Rejected")
         .otherwise("Pending Verification").alias("payment_status"),
        F.when(o == "approve", "Pending").when(o == "reupload", "Pending Payment Verification")
         .alias("order_status_reset"), "entries_reset_at")


def verification_history(events: DataFrame, users: DataFrame) -> DataFrame:
    """Type-2 history of supplier verification: each event is a
    version valid from its time to the next event's time (open ended for
    the current one); ``is_current`` marks the latest."""
    w = Window.partitionBy("user_id").orderBy("updated_at", "seq")
    h = events.select("*", F.lead("updated_at").over(w).alias("valid_to"))
    u = users.select("user_id", "name", "company")
    return h.join(u, "user_id", "left").select(
        "user_id", "name", company_or_name("company", "name").alias("company"),
        "status", "notes", "updated_by", F.col("updated_at").alias("valid_from"), "valid_to",
        F.col("valid_to").isNull().alias("is_current"))


def verification_log(history: DataFrame) -> DataFrame:
    """The flattened history with user columns (newest first when
    ordered by ``updated_at``)."""
    return history.select("user_id", F.col("name").alias("user_name"),
                          F.col("company").alias("user_company"), "status", "notes", "updated_by",
                          F.col("valid_from").alias("updated_at"))


def order_notifications(pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """One 'order' notification per distinct supplier of each
    order (an equi join on the order's own suppliers, never a cross join)."""
    sup = pairs.select("order_id", "supplier_id").distinct()
    o = orders.select("order_id", "created_at", "total")
    return sup.join(o, "order_id").select(
        F.col("supplier_id").alias("user_id"), "order_id",
        F.lit("New Order Received").alias("title"),
        F.format_string("Order %d includes your products.", "order_id").alias("message"),
        F.lit("order").alias("type"), F.lit(False).alias("read"), "created_at")


def appeal_intake(appeals: DataFrame, products: DataFrame) -> DataFrame:
    """An appeal is accepted only from the product's owner and with a
    non-blank reason; otherwise a refusal code."""
    p = products.select("product_id", F.col("supplier_id").alias("owner_id"))
    j = appeals.join(p, "product_id", "left")
    outcome = (F.when(F.col("owner_id").isNull(), "not_found")
               .when(F.col("owner_id") != F.col("user_id"), "forbidden")
               .when(F.length(F.trim(F.coalesce("reason", F.lit("")))) == 0, "missing_reason")
               .otherwise("accepted"))
    return j.select("appeal_id", "user_id", "product_id", outcome.alias("outcome"))


def read_state(notifications: DataFrame, read_events: DataFrame) -> DataFrame:
    """read_at = the first read event at or after creation, where a
    read event targets one notification or (notification_id NULL) all of
    the user's notifications up to that time; deleted ones are removed."""
    one = read_events.where(F.col("action") == "read").select(
        "notification_id", F.col("ts").alias("read_ts"))
    n = notifications.select("notification_id", "user_id", "created_at", "read")
    r1 = n.join(one, "notification_id", "left").where(
        F.col("read_ts").isNull() | (F.col("read_ts") >= F.col("created_at")))
    first_one = r1.groupBy("notification_id").agg(F.min("read_ts").alias("read_one"))
    # read-all: per user, the first read-all at/after creation. An as-of look-up
    # within a user's day (notifications sort before events at the same instant);
    # if that day has none, the first one of the user's next day that has. No task
    # holds more of a user than a day, or one row per day.
    allr = read_events.where(F.col("action") == "read_all").select(
        "user_id", F.col("ts").alias("t"), F.lit(1).alias("kind"),
        F.lit(None).cast("bigint").alias("notification_id"))
    mine = n.select("user_id", F.col("created_at").alias("t"), F.lit(0).alias("kind"), "notification_id")
    both = mine.unionByName(allr).withColumn("day", F.to_date("t"))
    wf = (Window.partitionBy("user_id", "day").orderBy("t", "kind", "notification_id")
          .rowsBetween(0, Window.unboundedFollowing))
    nxt = F.first(F.when(F.col("kind") == 1, F.col("t")), ignorenulls=True).over(wf)
    days = both.groupBy("user_id", "day").agg(F.min(F.when(F.col("kind") == 1, F.col("t"))).alias("_first"))
    later = Window.partitionBy("user_id").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    days = days.select("user_id", "day", F.first("_first", ignorenulls=True).over(later).alias("_later"))
    w = (both.select("user_id", "day", "notification_id", "kind", nxt.alias("_same_day")).where(F.col("kind") == 0)
         .join(days, ["user_id", "day"], "left")
         .select("notification_id", F.coalesce("_same_day", "_later").alias("read_all")))
    deleted = read_events.where(F.col("action") == "delete").select("notification_id")
    out = (n.join(first_one, "notification_id", "left").join(w, "notification_id", "left")
           .join(deleted, "notification_id", "left_anti"))
    read_at = F.least("read_one", "read_all")
    return out.select("notification_id", "user_id", "created_at",
                      (F.col("read") | read_at.isNotNull()).alias("read"), read_at.alias("read_at"))
