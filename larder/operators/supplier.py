"""Supplier analytics: summary, monthly chart, earnings and payouts.

The reference answers one supplier per request; these operators answer all
suppliers in one job. The shared building block is ``supplier_orders``: one
row per (order, supplier) with the supplier's item subtotal and its
effective status. It joins items to orders on ``order_id`` first and then
aggregates by (order_id, supplier_id): the join's hash partitioning on
``order_id`` already clusters the aggregate, so lineitem is shuffled once,
into as many parts as its rows need (``TASK_ROWS``): a task's sort and its
table of groups do not grow with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import (cents, cents_to_money, display_id, from_cents, money,
                                      round_half_up, safe_ratio)

TASK_ROWS = 250_000  # item rows of one task of the join and the aggregate
FEE_RATE = 0.10  # platform commission on supplier earnings (fixed value)
# Order / entry statuses (fixed values); entries are packed as rank*16+code
STATUSES = ["Pending Payment Verification", "Pending", "In Transit", "Delivered", "Cancelled"]


def line_value(price="price", supplier_price="supplier_price", quantity="quantity"):
    """Supplier-side value of an item line: (supplier price, else price) x qty."""
    return money(F.coalesce(F.col(supplier_price), F.col(price)) * F.col(quantity))


def dealt_by(rows: DataFrame, key: str, task_rows: int | None = None) -> DataFrame:
    """``rows`` hashed by ``key`` into parts of about ``task_rows`` (the count reads no column).

    Parts of a given number are not merged to the size of a file, and an aggregate by ``key``
    after a broadcast join holds the groups of one part, not those of a whole file split."""
    parts = -(-rows.count() // (task_rows or TASK_ROWS))
    return rows.repartition(parts, key) if parts > 1 else rows


def supplier_orders(items: DataFrame, orders: DataFrame,
                    statuses: DataFrame | None = None) -> DataFrame:
    """(order_id, supplier_id, subtotal, subtotal_cents, status,
    payment_status, order_date, entry_status, effective_status).

    ``effective_status`` is the supplier's own status entry when one exists,
    else the order status (A9). Entries come either from per-line
    ``entry_rank`` (bigint, lowest wins) / ``entry_status`` columns of
    ``items`` or from a separate ``statuses`` table keyed by (order_id,
    supplier_id). The first entry is found with ``min`` over
    rank * 16 + status code, so every aggregate buffer is a LONG and Spark
    hash-aggregates (no sort of the partial aggregates).
    """
    o = orders.select("order_id", "status", "payment_status", "order_date")
    cols = ["order_id", "supplier_id", cents(F.coalesce(F.col("supplier_price"), F.col("price"))
                                             * F.col("quantity")).alias("line_cents")]
    per_line = statuses is None and "entry_status" in items.columns
    names = F.array(*[F.lit(x) for x in STATUSES])
    if per_line:
        code = F.array_position(names, F.col("entry_status"))
        cols.append(F.when(F.col("entry_status").isNotNull(), F.col("entry_rank") * 16 + code).alias("packed"))
    j = dealt_by(items.select(*cols), "order_id").join(o, "order_id")
    aggs = [F.sum("line_cents").alias("subtotal_cents")]
    if per_line:
        aggs.append(F.min("packed").alias("packed"))
    g = j.groupBy("order_id", "supplier_id", "status", "payment_status", "order_date").agg(*aggs)
    if per_line:
        # guard: element_at over a literal array with a NULL index is not NULL
        # on this Spark version, so decode only present entries
        g = g.withColumn("entry_status", F.when(F.col("packed").isNotNull(),
                                                F.element_at(names, F.pmod("packed", F.lit(16)).cast("int")))) \
             .drop("packed")
    elif statuses is None:
        g = g.withColumn("entry_status", F.lit(None).cast("string"))
    else:
        s = statuses.select("order_id", "supplier_id", F.col("status").alias("entry_status"))
        g = g.join(s, ["order_id", "supplier_id"], "left")
    return (g.withColumn("subtotal", cents_to_money("subtotal_cents"))
             .withColumn("effective_status", F.coalesce("entry_status", "status")))


def supplier_summary(pairs: DataFrame, products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Revenue of delivered orders, order counts, fulfilment %, average
    order value and low-stock product count, for every supplier."""
    delivered = F.col("effective_status") == "Delivered"
    stats = pairs.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(delivered).alias("delivered_orders"),
        F.sum(F.when(delivered, F.col("subtotal_cents"))).alias("revenue_cents"),
        F.sum("subtotal_cents").alias("value_cents"),
    )
    low = products.groupBy("supplier_id").agg(
        F.count_if((F.col("stock") > 0) & (F.col("stock") < 50)).alias("low_stock_count"))
    base = suppliers.select(F.col("user_id").alias("supplier_id"))
    r = base.join(stats, "supplier_id", "left").join(low, "supplier_id", "left")
    total = F.coalesce(F.col("total_orders"), F.lit(0))
    return r.select(
        "supplier_id",
        from_cents(F.coalesce(F.col("revenue_cents"), F.lit(0))).alias("total_revenue"),
        total.alias("total_orders"),
        F.coalesce(F.col("delivered_orders"), F.lit(0)).alias("delivered_orders"),
        safe_ratio("delivered_orders", total, 100.0, 1).alias("fulfillment_rate"),
        safe_ratio(from_cents("value_cents"), total, 1.0, 2).alias("avg_order_value"),
        F.coalesce(F.col("low_stock_count"), F.lit(0)).alias("low_stock_count"),
    )


def month_start_back(as_of: str, months_back: int):
    """First day of the month ``months_back`` months before ``as_of``.

    The reference keeps the clock time on that day; we start at midnight.
    """
    return F.trunc(F.add_months(F.to_date(F.lit(as_of)), -months_back), "month")


def supplier_monthly_chart(items: DataFrame, orders: DataFrame, as_of: str,
                           months_back: int = 5) -> DataFrame:
    """A10: delivered revenue and order count per supplier and month, from
    the first of the month ``months_back`` months before ``as_of``.

    The date filter is applied to orders before the join, so it reaches the
    orders scan and shrinks the lineitem join input.
    """
    recent = orders.where(F.col("order_date") >= month_start_back(as_of, months_back))
    pairs = supplier_orders(items, recent)
    d = pairs.where(F.col("effective_status") == "Delivered")
    return (d.groupBy("supplier_id", F.year("order_date").alias("year"),
                      F.month("order_date").alias("month_num"))
            .agg(from_cents(F.sum("subtotal_cents")).alias("revenue"),
                 F.count(F.lit(1)).alias("orders"))
            .withColumn("month", F.date_format(F.make_date("year", "month_num", F.lit(1)), "MMM")))


def earnings_state(effective_status, payment_status):
    delivered = F.col(effective_status) == "Delivered"
    return (F.when(delivered & (F.col(payment_status) == "Approved"), "Paid")
            .when(delivered, "Available")
            .when(F.col(effective_status) == "Cancelled", "Cancelled")
            .otherwise("Pending"))


def supplier_earnings(pairs: DataFrame) -> DataFrame:
    """A11 breakdown: per (supplier, order) gross, 10 % fee, net and state.

    Amounts are decimals rounded HALF_UP to cents. All states are kept;
    ``earnings_breakdown`` drops Cancelled rows as the reference's listing does.
    """
    gross = F.col("subtotal")
    fee = F.round(gross * F.lit(FEE_RATE).cast("decimal(3,2)"), 2)
    return pairs.select(
        "supplier_id", "order_id", "order_date",
        display_id("order_id").alias("order_label"),
        F.date_format("order_date", "dd MMM yyyy").alias("date_label"),
        gross.cast("double").alias("amount"),
        fee.cast("double").alias("fee"),
        F.round(gross - fee, 2).cast("double").alias("net"),
        earnings_state("effective_status", "payment_status").alias("earnings_status"),
    )


def earnings_breakdown(earnings: DataFrame) -> DataFrame:
    return earnings.where(F.col("earnings_status") != "Cancelled")


def earnings_totals(earnings: DataFrame) -> DataFrame:
    """A11 totals per supplier: earned (paid + available), pending, available,
    completed."""
    st = F.col("earnings_status")
    net = cents("net")

    def total(cond):
        return from_cents(F.coalesce(F.sum(F.when(cond, net)), F.lit(0)))

    return earnings.groupBy("supplier_id").agg(
        total(st.isin("Paid", "Available")).alias("total_earned"),
        total(st == "Pending").alias("pending_payout"),
        total(st == "Available").alias("available_payout"),
        total(st == "Paid").alias("completed_payout"),
    )


def supplier_payouts(earnings: DataFrame) -> DataFrame:
    """Monthly payouts from Paid rows; id PAY-<year>-<0-based month>,
    dated by the newest order of the month."""
    paid = earnings.where(F.col("earnings_status") == "Paid")
    g = paid.groupBy("supplier_id", F.year("order_date").alias("year"),
                     F.month("order_date").alias("month_num")).agg(
        from_cents(F.sum(cents("net"))).alias("amount"),
        F.max("order_date").alias("payout_date"))
    return g.select(
        "supplier_id",
        F.concat(F.lit("PAY-"), F.col("year").cast("string"), F.lit("-"),
                 (F.col("month_num") - 1).cast("string")).alias("payout_id"),
        "amount", "payout_date",
        F.lit("Direct Deposit").alias("method"),
        F.lit("Completed").alias("status"),
    )
