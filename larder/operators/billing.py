"""Billing: credit position, invoice issue, payments, credit increases and
the sequential credit admission of net-30 orders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.functions.columns import cents, from_cents, money, or_default

# Fixed values
DEFAULT_CREDIT_LIMIT = 100000.0
DEFAULT_NEXT_PAYMENT = "July 10, 2026"  # shown when nothing is open
NET_TERMS_DAYS = 30
OPEN = ("Unpaid", "Overdue")


def credit_position(invoices: DataFrame, buyers: DataFrame) -> DataFrame:
    """Limit (0/NULL -> default), outstanding = Unpaid + Overdue,
    available = max(0, limit - outstanding), earliest open due date."""
    is_open = F.col("status").isin(*OPEN)
    per = invoices.groupBy("buyer_id").agg(
        F.sum(F.when(is_open, cents("amount"))).alias("out_cents"),
        F.min(F.when(is_open, F.col("due_date"))).alias("next_due"),
        F.count(F.lit(1)).alias("invoice_count"))
    b = buyers.select(F.col("user_id").alias("buyer_id"),
                      or_default("credit_limit", DEFAULT_CREDIT_LIMIT).cast("double").alias("credit_limit"))
    r = b.join(per, "buyer_id", "left")
    out = from_cents(F.coalesce(F.col("out_cents"), F.lit(0)))
    return r.select(
        "buyer_id", "credit_limit",
        out.alias("outstanding"),
        F.greatest(F.lit(0.0), F.col("credit_limit") - out).alias("available_credit"),
        F.coalesce(F.date_format("next_due", "MMMM d, yyyy"), F.lit(DEFAULT_NEXT_PAYMENT))
         .alias("next_payment_date"),
        F.coalesce(F.col("invoice_count"), F.lit(0)).alias("invoice_count"))


def issue_invoices(accepted_orders: DataFrame) -> DataFrame:
    """K3: one Unpaid invoice per accepted order, due 30 days after issue.

    The invoice number is derived from the order id (the reference draws a
    random one), so reruns give the same numbers.
    """
    return accepted_orders.select(
        F.concat(F.lit("INV-"), F.lpad(F.col("order_id").cast("string"), 10, "0")).alias("invoice_number"),
        "order_id", "buyer_id",
        F.col("total").alias("amount"),
        F.lit("Unpaid").alias("status"),
        F.col("order_date").alias("issue_date"),
        F.date_add("order_date", NET_TERMS_DAYS).alias("due_date"))


def pay_invoices(requests: DataFrame, invoices: DataFrame) -> DataFrame:
    """K4: decision per payment request (request_id, invoice_id, user_id,
    requested_at): not_found / forbidden (not the buyer) / already_paid / paid.
    Of the buyer's own requests for one invoice only the earliest pays; later
    ones find it paid."""
    inv = invoices.select(F.col("invoice_id").alias("inv_id"), "buyer_id", F.col("status").alias("inv_status"))
    j = requests.join(inv, requests.invoice_id == inv.inv_id, "left")
    outcome = (F.when(F.col("inv_id").isNull(), "not_found")
               .when(F.col("buyer_id") != F.col("user_id"), "forbidden")
               .when((F.col("inv_status") == "Paid") | (F.struct("requested_at", "request_id") > F.col("first_own")),
                     "already_paid")
               .otherwise("paid"))
    own = (F.col("inv_id").isNotNull()) & (F.col("buyer_id") == F.col("user_id"))
    first = (j.where(own).groupBy(F.col("inv_id").alias("_inv"))
             .agg(F.min(F.struct("requested_at", "request_id")).alias("first_own")))
    j = j.join(first, F.col("inv_id") == F.col("_inv"), "left")
    # a forbidden request sees the invoice as the buyer's earlier requests left it
    paid_before = (F.col("inv_status") == "Paid") | (F.col("first_own") <= F.struct("requested_at", "request_id"))
    return j.select("request_id", "invoice_id", "user_id", outcome.alias("outcome"),
                    F.when(F.col("inv_id").isNotNull() & F.coalesce(paid_before, F.lit(False)), "Paid")
                    .otherwise(F.col("inv_status")).alias("status_after"))


def credit_increases(requests: DataFrame, buyers: DataFrame) -> DataFrame:
    """K5: a request is accepted when its target exceeds the limit in force,
    i.e. the starting limit and every earlier request (accepted requests
    raise the limit to their target, so the limit is a running max)."""
    b = buyers.select(F.col("user_id"), F.col("credit_limit").alias("start_limit"))
    w = (Window.partitionBy("user_id").orderBy("requested_at", "request_id")
         .rowsBetween(Window.unboundedPreceding, -1))
    r = requests.join(b, "user_id", "left")
    prev = F.max("target").over(w)
    limit_before = F.greatest(F.coalesce("start_limit", F.lit(0.0)), F.coalesce(prev, F.lit(0.0)))
    return r.select(
        "request_id", "user_id", "requested_at", "target",
        limit_before.alias("limit_before"),
        (F.col("target") > limit_before).alias("accepted"))


ADMISSION_SCHEMA = ("order_id long, buyer_id long, created_at timestamp_ntz, total double, "
                    "credit_limit double, accepted boolean, outstanding_after double")


def _admit_partition(batches):
    """Fold over rows sorted by (buyer, time): accept when the open balance
    plus the order fits the limit; rejected orders consume nothing. State is
    one buyer's balance, so memory does not grow with a buyer's history."""
    cur_buyer, open_cents = None, 0
    for pdf in batches:
        if pdf.empty:
            continue
        acc, after = [], []
        for b, tot, lim, start in zip(pdf["buyer_id"].to_numpy(), pdf["total_cents"].to_numpy(),
                                      pdf["limit_cents"].to_numpy(), pdf["start_cents"].to_numpy()):
            if b != cur_buyer:
                cur_buyer, open_cents = b, int(start)
            ok = open_cents + tot <= lim
            if ok:
                open_cents += tot
            acc.append(bool(ok))
            after.append(open_cents / 100.0)
        yield pd.DataFrame({
            "order_id": pdf["order_id"], "buyer_id": pdf["buyer_id"], "created_at": pdf["created_at"],
            "total": pdf["total_cents"] / 100.0, "credit_limit": pdf["limit_cents"] / 100.0,
            "accepted": acc, "outstanding_after": after})


def open_balances(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """``buyer_id, start_cents``: unpaid and overdue invoices of orders other than ``orders``."""
    return (invoices.where(F.col("status").isin(*OPEN)).join(orders.select("order_id"), "order_id", "left_anti")
            .groupBy("buyer_id").agg(F.sum((money("amount") * 100).cast("long")).alias("start_cents")))


def credit_admission(orders: DataFrame, buyers: DataFrame, invoices: DataFrame | None = None) -> DataFrame:
    """K2: sequential credit check of net-30 orders per buyer.

    Not a running sum (a refused order does not consume credit), so it is
    an ordered fold: hash-partition by buyer, sort within partitions by
    (buyer, time, id), and stream each partition through ``mapInPandas``.
    Money is folded in integer cents, so the result is exact. With ``invoices``,
    a buyer starts at the unpaid and overdue ones of orders that are not replayed
    here; without, at zero.
    """
    lim = or_default("credit_limit", DEFAULT_CREDIT_LIMIT)
    b = buyers.select(F.col("user_id").alias("buyer_id"),
                      (money(lim) * 100).cast("long").alias("limit_cents"))
    o = orders.select("order_id", "buyer_id", "created_at",
                      (money("total") * 100).cast("long").alias("total_cents"))
    j = o.join(b, "buyer_id", "left").fillna({"limit_cents": int(DEFAULT_CREDIT_LIMIT * 100)})
    if invoices is None:
        j = j.withColumn("start_cents", F.lit(0).cast("long"))
    else:
        j = j.join(open_balances(invoices, orders), "buyer_id", "left").fillna({"start_cents": 0})
    n = int(j.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    srt = j.repartition(n, "buyer_id").sortWithinPartitions("buyer_id", "created_at", "order_id")
    return srt.mapInPandas(_admit_partition, ADMISSION_SCHEMA)
