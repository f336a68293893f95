"""All notifications of the marketplace from one rule table.

A rule names the event it answers, a condition on it, whom it addresses and the texts.
``notifications`` compiles the table into one pass over the events: every event is
exploded into the rules that hold for it, then each kind of recipient is one equi join
(the suppliers of the order, the users of a role) or a column of the event. State changes
are recognised on the status before and after (``before`` / ``status`` of the event).

Event columns: event_key, kind, ts, user_id (whom a direct rule addresses), order_id,
name (who acted), subject (what it is about), status, before, notes.
A notification has the key of its event, rule and recipient, so that writing it twice
gives the same row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT_COLUMNS = ["event_key", "kind", "ts", "user_id", "order_id", "name", "subject", "status", "before", "notes"]


def _said(template: str, *columns: str) -> Column:
    return F.format_string(template, *columns) if columns else F.lit(template)


def _is(**values) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in values.items()])


def rules() -> list[dict]:
    """The sites, their conditions and texts."""
    changed = ~F.col("status").eqNullSafe(F.col("before"))
    again = F.col("before").isin("approved", "pending", "information_requested")
    submitted = F.col("status") == "pending"
    notes = lambda default: F.when(F.length(F.coalesce("notes", F.lit(""))) > 0, F.col("notes")).otherwise(default)
    decided = "Your business verification has been approved. You can now publish products and receive orders."
    submitted_title = F.when((F.col("before") == "rejected") | again, "Verification Documents Updated").otherwise("Verification Submitted")
    submitted_text = (F.when(F.col("before") == "rejected", "Your business verification documents have been resubmitted and are pending admin review.")
                      .when(again, "Your business verification documents have been updated and are pending admin review.")
                      .otherwise("Your business verification request has been successfully submitted and is pending admin review."))
    return [
        dict(site="review_submitted", kind="review", to="admins", title=_said("New Review Submitted"),
             message=_said("%s submitted a review for %s.", "name", "subject")),
        dict(site="review_decided", kind="review_status", to="user", when=changed & F.col("status").isin("approved", "rejected"),
             title=F.concat(F.lit("Review "), F.initcap("status")), message=_said('Your review "%s" has been %s.', "subject", "status")),
        dict(site="payment_requested", kind="bank_order", to="first_admin", title=_said("Payment Verification Request"),
             message=_said("New payment verification request received from %s", "name")),
        dict(site="payment_approved", kind="payment", to="user", type="order", when=_is(status="approve"), title=_said("Order Payment Approved"),
             message=_said("Your payment has been verified and your order has been confirmed.")),
        dict(site="order_available", kind="payment", to="suppliers", type="order", when=_is(status="approve"),
             title=_said("New Order Available"), message=_said("A new verified order is available for processing.")),
        dict(site="payment_rejected", kind="payment", to="user", type="order", when=_is(status="reject"), title=_said("Order Payment Rejected"),
             message=_said("Your payment slip has been rejected. Please upload a new payment slip.")),
        dict(site="slip_resubmitted", kind="payment", to="first_admin", when=_is(status="reupload"), title=_said("Payment Slip Resubmitted"),
             message=_said("Customer has resubmitted a payment slip for Order #%s", "subject")),
        dict(site="listing_changed", kind="listing", to="user", when=changed,
             title=F.when(F.col("status") == "active", "Product Listing Approved").otherwise("Product Listing Flagged/Rejected"),
             message=F.when(F.col("status") == "active", _said('Your product listing "%s" has been approved and is now active in the marketplace.', "subject"))
             .otherwise(_said('Your product listing "%s" has been flagged and temporarily deactivated by administrators.', "subject"))),
        dict(site="listing_appeal", kind="appeal", to="first_admin", title=_said("Product Listing Appeal"),
             message=_said('Supplier "%s" appealed rejection of "%s": %s', "name", "subject", "notes")),
        dict(site="verification_received", kind="verification", to="user", when=submitted, title=submitted_title, message=submitted_text),
        dict(site="verification_to_review", kind="verification", to="admins", when=submitted,
             title=F.when(F.col("before") == "rejected", "Supplier Verification Resubmitted").when(again, "Verification Documents Updated")
             .otherwise("New Supplier Verification Request Submitted"),
             message=_said('"%s" has submitted business verification documents and requires review.', "name")),
        dict(site="verification_by_link", kind="verification_link", to="user", when=F.col("status").isin("approved", "rejected"),
             title=F.concat(F.lit("Verification "), F.initcap("status")),
             message=F.when(F.col("status") == "approved", decided)
             .otherwise("Your business verification request was rejected. Please update your details and resubmit.")),
        dict(site="verification_by_admin", kind="verification", to="user", when=~submitted,
             title=F.when(F.col("status") == "approved", "Verification Approved").when(F.col("status") == "rejected", "Verification Rejected")
             .otherwise("Information Requested by Admin"),
             message=F.when(F.col("status") == "approved", decided)
             .when(F.col("status") == "rejected", F.concat(F.lit("Your business verification request was rejected. Reason: "), notes("No reason provided.")))
             .otherwise(F.concat(F.lit("Additional business documentation requested: "), notes("Please review.")))),
    ]


SITES = ("review_submitted", "review_decided", "payment_requested", "payment_approved", "order_available", "payment_rejected",
         "slip_resubmitted", "listing_changed", "listing_appeal", "verification_received", "verification_to_review",
         "verification_by_link", "verification_by_admin")


def notifications(events: DataFrame, pairs: DataFrame, admins: DataFrame) -> DataFrame:
    """One row per event, site and recipient.

    ``pairs``: the suppliers of each order. ``admins``: user_id. ``first_admin`` is the
    smallest id. Without administrators nobody is told.
    """
    found = F.array(*[F.when((F.col("kind") == r["kind"]) & F.coalesce(r.get("when", F.lit(True)), F.lit(False)), F.struct(
        F.lit(r["site"]).alias("site"), F.lit(r["to"]).alias("to"), F.lit(r.get("type", "system")).alias("type"),
        r["title"].alias("title"), r["message"].alias("message"))) for r in rules()])
    told = events.select("event_key", "ts", "user_id", "order_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("n"))
    told = told.select("event_key", "ts", "user_id", "order_id", "n.*")
    cols = ["event_key", "site", "user_id", "title", "message", "type", "ts"]
    direct = told.where(F.col("to") == "user").select(cols)
    sold = told.where(F.col("to") == "suppliers").drop("user_id").join(
        pairs.select("order_id", F.col("supplier_id").alias("user_id")).distinct(), "order_id").select(cols)
    role = admins.select(F.lit("admins").alias("to"), "user_id").unionByName(
        admins.agg(F.min("user_id").alias("user_id")).select(F.lit("first_admin").alias("to"), "user_id"))
    office = told.where(F.col("to").isin("admins", "first_admin")).drop("user_id").join(role, "to").where("user_id IS NOT NULL").select(cols)
    out = direct.unionByName(sold).unionByName(office)
    return out.select(F.concat_ws("|", "event_key", "site", F.col("user_id").cast("string")).alias("notification_key"), *cols[1:-1],
                      F.lit(False).alias("read"), F.col("ts").alias("created_at"))


def changes(events: DataFrame, key: list[str], start: str | None = None, order=("ts", "seq")) -> DataFrame:
    """Adds ``before``: the status the same thing had last (``start`` at first)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return events.withColumn("before", F.coalesce(F.lag("status").over(w), F.lit(start).cast("string")))


# ------------------------------------------------------------ product lifecycle

def lifecycle_outcomes(events: DataFrame, products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Adds ``outcome`` to product events (event_id, ts, actor_id, role, product_id, action, value).

    A supplier needs an approved verification, the product must exist (known and not yet
    deleted), and only its owner or an administrator may act, in that order of refusal.
    Whether an actor may delete does not depend on other events, so the first permitted
    delete of a product is one aggregate, and what comes after it finds no product.
    """
    owner = products.select("product_id", F.col("supplier_id").alias("owner_id"), "name")
    state = suppliers.select(F.col("user_id").alias("actor_id"), F.col("verification_status").alias("verification"))
    e = events.join(owner, "product_id", "left").join(state, "actor_id", "left")
    supplier = F.col("role") == "supplier"
    allowed = (~supplier | F.col("verification").eqNullSafe("approved")) & F.col("owner_id").isNotNull() & (
        ~supplier | (F.col("actor_id") == F.col("owner_id")))
    e = e.withColumn("allowed", F.coalesce(allowed, F.lit(False)))
    rank = F.struct("ts", "event_id")
    gone = e.where(F.col("allowed") & (F.col("action") == "delete")).groupBy("product_id").agg(F.min(rank).alias("gone"))
    e = e.join(gone, "product_id", "left")
    outcome = (F.when(supplier & ~F.col("verification").eqNullSafe("approved"), "verification_required")
               .when(F.col("owner_id").isNull() | (rank > F.col("gone")), "not_found")
               .when(~F.col("allowed"), "forbidden").otherwise("accepted"))
    return e.withColumn("outcome", outcome).drop("verification", "allowed", "gone")


def lifecycle_state(outcomes: DataFrame, products: DataFrame) -> DataFrame:
    """Products after the accepted events: last stock, last listing state, deleted flag (tombstone)."""
    ok = outcomes.where(F.col("outcome") == "accepted")
    rank, action, value = F.struct("ts", "event_id"), F.col("action"), F.col("value")
    last = ok.groupBy("product_id").agg(
        F.max_by(value, F.when(action == "stock", rank)).alias("_stock"), F.max_by(action, F.when(action.isin("activate", "deactivate"), rank)).alias("_list"),
        F.max((action == "delete").cast("int")).alias("_gone"))
    return products.join(last, "product_id", "left").select(
        "product_id", "name", "category", "supplier_id", F.coalesce(F.col("_stock").cast("int"), F.col("stock")).alias("stock"),
        F.coalesce(F.col("_list") == "activate", F.col("is_active")).alias("is_active"), (F.coalesce("_gone", F.lit(0)) == 1).alias("deleted"))


def listed(state: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The catalogue after the lifecycle: deleted and inactive products and those of suppliers without approval are hidden."""
    approved = suppliers.where(F.col("verification_status") == "approved").select(F.col("user_id").alias("supplier_id"))
    return state.where(F.col("is_active") & ~F.col("deleted")).join(approved, "supplier_id", "left_semi").select(
        "product_id", "name", "category", "supplier_id", "stock")
