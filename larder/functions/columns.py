"""Column helpers shared by the operators (all JVM-side built-ins).

Rounding policy: money and ratios are rounded on DECIMAL with HALF_UP, never
on binary doubles, so ``1.005`` rounds to ``1.01`` on every engine. Results
leave as DOUBLE (a short decimal converts to the same double everywhere).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """Exact 2-dp amount; sums of these are exact and order-independent."""
    return col(c).cast(MONEY)


def cents(c) -> Column:
    """Exact money in integer cents (HALF_UP to the cent). Sums of cents are
    exact and use fixed-width LONG buffers, so Spark hash-aggregates them
    (a DECIMAL(28,2) sum buffer would force a sort-based aggregate)."""
    return (money(c) * 100).cast("bigint")


def from_cents(c) -> Column:
    """Cents back to a DOUBLE amount (the correctly rounded value of the
    exact decimal, identical to casting the decimal sum)."""
    return col(c) / F.lit(100.0)


def cents_to_money(c) -> Column:
    """Cents as an exact DECIMAL(20,2) for further decimal arithmetic."""
    return (col(c).cast("decimal(20,0)") / F.lit(100)).cast("decimal(20,2)")


def round_half_up(c, digits: int = 2) -> Column:
    """Decimal HALF_UP rounding of a double/decimal, returned as DOUBLE."""
    return F.round(col(c).cast("decimal(38,10)"), digits).cast("double")


def js_round(c) -> Column:
    """JavaScript Math.round: floor(x + 0.5) (halves go up, also below zero)."""
    return F.floor(col(c) + F.lit(0.5))


def safe_ratio(num, den, scale: float = 1.0, digits: int | None = None,
               default=0.0) -> Column:
    """scale * num / den, ``default`` when den is 0 or NULL (ANSI-safe)."""
    den_c = col(den)
    r = F.when((den_c.isNull()) | (den_c == 0), F.lit(None)) \
         .otherwise(col(num).cast("double") * F.lit(scale) / den_c.cast("double"))
    if digits is not None:
        r = round_half_up(r, digits)
    return F.coalesce(r, F.lit(default).cast("double"))


def or_default(c, default) -> Column:
    """JavaScript ``x || default``: NULL, 0, '' and NaN fall back."""
    c = col(c)
    return F.when(c.isNull() | (c == 0) | F.isnan(c), F.lit(default)).otherwise(c)


def parse_float_or_zero(c) -> Column:
    """``parseFloat(x) || 0`` over a string column (numeric prefix, else 0)."""
    prefix = F.regexp_extract(F.trim(col(c)), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)
    return F.coalesce(prefix.try_cast("double"), F.lit(0.0))


def display_id(c, n: int = 8) -> Column:
    """Last ``n`` characters of an id, upper-cased (order/invoice labels)."""
    return F.upper(F.substring(col(c).cast("string"), -n, n))


def nullif_blank(c) -> Column:
    c = col(c)
    return F.when(F.trim(c) == "", F.lit(None)).otherwise(c)


def company_or_name(company, name) -> Column:
    return F.coalesce(nullif_blank(company), col(name))


def stock_label(stock) -> Column:
    s = col(stock)
    return (F.when(s == 0, "Out of Stock").when(s < 50, "Low Stock")
            .otherwise("In Stock"))


def mask_tail(c, keep: int, prefix: str) -> Column:
    """Mask all but the last ``keep`` characters when longer than 4."""
    c = col(c)
    return F.when(F.length(c) > 4, F.concat(F.lit(prefix), F.substring(c, -keep, keep))) \
            .otherwise(c)
