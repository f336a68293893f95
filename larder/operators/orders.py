"""Order views and access rules (P2, P3, P17, P21, P22) and checkout
pricing (J3, K1).

Items stay flat (one row per order line) so filters on item fields reach
the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import cents, from_cents
from larder.operators.catalogue import DEFAULT_MARGIN, selling_price
from larder.operators.supplier import line_value

HIDDEN_FROM_SUPPLIERS = "Pending Payment Verification"


def supplier_order_list(pairs: DataFrame, status: str | None = None) -> DataFrame:
    """P2 + P21: a supplier's orders (never those awaiting payment
    verification), with the supplier's own status and a total recomputed
    from their own items at base price. ``status`` filters on the supplier's
    own status entry (P3, element match); orders without an entry for the
    supplier never match a status filter."""
    df = pairs.where(F.col("status") != HIDDEN_FROM_SUPPLIERS)
    if status is not None and status.lower() != "all":
        df = df.where(F.col("entry_status") == status)
    return df.select("supplier_id", "order_id", "order_date",
                     F.col("effective_status").alias("status"),
                     F.col("subtotal").cast("double").alias("total"))


def supplier_order_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    """P21 item part: own items only, price := base (supplier) price, the
    marketplace price dropped."""
    o = orders.where(F.col("status") != HIDDEN_FROM_SUPPLIERS).select("order_id")
    it = items.join(o, "order_id", "left_semi")
    return it.select("supplier_id", "order_id", "line_no", "product_id", "quantity",
                     F.coalesce("supplier_price", "price").alias("price"))


def buyer_order_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    """A buyer's order lines without the supplier price."""
    o = orders.select("order_id", "buyer_id")
    return items.join(o, "order_id").select(
        "buyer_id", "order_id", "line_no", "product_id", "supplier_id", "quantity",
        "price", "marketplace_price")


def access_decisions(requests: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Per request (request_id, user_id, role, order_id): not_found,
    forbidden (buyer not owner; supplier not involved or order awaiting
    payment verification) or ok (admins see all)."""
    inv = items.select("order_id", F.col("supplier_id").alias("inv_supplier")).distinct()
    o = orders.select(F.col("order_id").alias("o_id"), "buyer_id", F.col("status").alias("o_status"))
    r = requests.join(o, requests.order_id == o.o_id, "left")
    r = r.join(inv, (r.order_id == inv.order_id) & (r.user_id == inv.inv_supplier)
               & (r.role == "supplier"), "left").drop(inv.order_id)
    role = F.col("role")
    decision = (F.when(F.col("o_id").isNull(), "not_found")
                .when(role == "admin", "ok")
                .when(role == "buyer", F.when(F.col("buyer_id") == F.col("user_id"), "ok").otherwise("forbidden"))
                .when(F.col("inv_supplier").isNull(), "forbidden")
                .when(F.col("o_status") == HIDDEN_FROM_SUPPLIERS, "forbidden")
                .otherwise("ok"))
    return r.select("request_id", "user_id", "role", "order_id", decision.alias("decision"))


def initial_statuses(payment_method):
    pm = F.col(payment_method)
    bank = pm == "bank"
    return (F.when(bank, "Pending Payment Verification").otherwise("Pending"),
            F.when(bank, "Pending Verification").otherwise("Approved"))


def checkout_pricing(cart: DataFrame, products: DataFrame, carts: DataFrame,
                     margin: float = DEFAULT_MARGIN) -> DataFrame:
    """Price each cart line from the catalogue (marketplace price =
    selling price, supplier price = base price; an unknown product keeps the
    given price for both), then per cart: total (2 dp), distinct suppliers
    and initial order/payment status from the payment method.

    cart:  (cart_id, line_no, product_id, quantity, given_price, supplier_id)
    carts: (cart_id, buyer_id, payment_method)
    """
    p = products.select("product_id", F.col("base_price").alias("p_base"),
                        F.col("supplier_id").alias("p_supplier"))
    lines = cart.join(p, "product_id", "left")
    known = F.col("p_base").isNotNull()
    mp = F.when(known, selling_price(F.col("p_base"), margin)).otherwise(F.col("given_price"))
    sp = F.when(known, F.col("p_base")).otherwise(F.col("given_price"))
    priced = lines.select("cart_id", "line_no", "product_id", "quantity",
                          F.coalesce("supplier_id", "p_supplier").alias("supplier_id"),
                          mp.alias("marketplace_price"), sp.alias("supplier_price"))
    line = F.col("marketplace_price").cast("decimal(18,2)") * F.col("quantity").cast("decimal(18,4)")
    per = priced.groupBy("cart_id").agg(
        F.sum(cents(line)).alias("total_cents"),
        F.count_distinct("supplier_id").alias("supplier_count"),
        F.count(F.lit(1)).alias("item_count"))
    status, pay = initial_statuses("payment_method")
    return (carts.join(per, "cart_id")
            .select("cart_id", "buyer_id", "payment_method",
                    from_cents("total_cents").alias("total"),
                    "supplier_count", "item_count",
                    status.alias("status"), pay.alias("payment_status")))
