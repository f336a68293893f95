"""Catalogue: visibility, role views, margin pricing, search and paging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import money, stock_label

DEFAULT_MARGIN = 15.0
MAX_PAGE_SIZE = 100  # page size cap of the product listing (fixed value)


def optional_eq(c: str, value) -> Column:
    """Equality filter; None, 'All' or 'all' means no filter."""
    if value is None or (isinstance(value, str) and value.lower() == "all"):
        return F.lit(True)
    return F.col(c) == F.lit(value)


def text_match(cols: list[str], pattern: str, regex: bool = False) -> Column:
    """Case-insensitive match over several columns (OR).

    ``regex=True`` treats the pattern as a regular expression, as the
    reference does with raw input; the default escapes it (literal search).
    """
    pat = pattern if regex else re.escape(pattern)
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.col(c).rlike("(?i)" + pat), F.lit(False))
    return cond


def selling_price(base: Column, margin: float) -> Column:
    """round(base x (1 + m/100), 2) on decimals (HALF_UP)."""
    factor = F.lit(1 + margin / 100.0).cast("decimal(20,10)")
    return F.round(base.cast("decimal(18,2)") * factor, 2).cast("double")


def priced(products: DataFrame, margin: float = DEFAULT_MARGIN) -> DataFrame:
    """Add base/selling/supplier/marketplace prices and the stock label."""
    base = F.coalesce(F.col("base_price"), F.col("price"))
    sell = selling_price(base, margin)
    return (products.withColumn("base_price", base)
            .withColumn("selling_price", sell)
            .withColumn("supplier_price", base)
            .withColumn("marketplace_price", sell)
            .withColumn("stock_status", stock_label("stock")))


def role_view(products: DataFrame, role: str | None) -> DataFrame:
    """Suppliers see base prices, buyers/guests selling prices, admins
    everything; ``display_price`` follows the role."""
    if role == "supplier":
        return products.withColumn("display_price", F.col("base_price")) \
                       .drop("selling_price", "marketplace_price")
    df = products.withColumn("display_price", F.col("selling_price"))
    if role in (None, "buyer", "guest"):
        df = df.drop("price", "base_price", "supplier_price")
    return df


def visible_products(products: DataFrame, suppliers: DataFrame, role: str | None = None,
                     requester_id=None, category=None, max_price: float | None = None,
                     supplier_id=None, search: str | None = None, regex: bool = False) -> DataFrame:
    """Catalogue visibility.

    Non-admins (other than a supplier asking for their own listing) see only
    active products. Without ``supplier_id`` non-admins see approved
    suppliers only (semi join); asking for an unapproved supplier gives no
    rows. ``max_price`` compares the BASE price. Search is over product
    name, supplier name and category.
    """
    admin = role == "admin"
    own = role == "supplier" and supplier_id is not None and requester_id == supplier_id
    sup = suppliers.select(F.col("user_id").alias("supplier_id"),
                           F.col("name").alias("supplier_name"),
                           F.col("verification_status"))
    df = products.join(sup, "supplier_id", "left")
    if not (admin or own):
        df = df.where(F.col("is_active"))
    df = df.where(optional_eq("category", category))
    if max_price is not None:
        df = df.where(F.col("price") <= F.lit(float(max_price)))
    if supplier_id is not None:
        ok = F.lit(admin or own) | (F.col("verification_status") == "approved")
        df = df.where((F.col("supplier_id") == F.lit(supplier_id)) & ok)
    elif not admin:
        df = df.where(F.col("verification_status") == "approved")
    if search:
        df = df.where(text_match(["name", "supplier_name", "category"], search, regex))
    return df.drop("verification_status")


def page(df: DataFrame, order_cols: list, page_no: int = 1, limit: int = 20,
         cap: int | None = None) -> DataFrame:
    """L2: rows (page-1)*limit .. page*limit of the ordering (a bounded
    top-k: Spark plans sort + offset + limit as TakeOrderedAndProject)."""
    limit = min(limit, cap) if cap else limit
    return df.orderBy(*order_cols).offset((page_no - 1) * limit).limit(limit)


def page_info(df: DataFrame, limit: int = 20, page_no: int = 1,
              cap: int | None = None) -> DataFrame:
    """L2: total rows and page count ceil(total / limit) for a filter."""
    limit = min(limit, cap) if cap else limit
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(page_no).alias("page"),
        F.ceil(F.col("total") / F.lit(limit)).cast("bigint").alias("pages"))


def cheapest_in_stock(products: DataFrame, k: int) -> DataFrame:
    """The ``k`` cheapest in-stock products (ties: lower id)."""
    return products.where(F.col("stock") > 0).orderBy("price", "product_id").limit(k)
