"""Small SQL text helpers for oracle statements (DuckDB dialect)."""

from __future__ import annotations


def rnd(expr: str, digits: int) -> str:
    """HALF_UP rounding on DECIMAL, result DOUBLE (mirrors round_half_up)."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def ratio(num: str, den: str, scale: float = 1.0, digits: int | None = None,
          default: str = "0.0") -> str:
    """scale * num / den in DOUBLE, ``default`` when den is 0 or NULL."""
    core = f"CAST({num} AS DOUBLE) * CAST({scale!r} AS DOUBLE) / CAST({den} AS DOUBLE)"
    if digits is not None:
        core = rnd(core, digits)
    return (f"CAST(CASE WHEN {den} IS NULL OR {den} = 0 THEN {default} "
            f"ELSE {core} END AS DOUBLE)")


LINE_VALUE = ("CAST(COALESCE(CASE WHEN l_returnflag = 'N' THEN NULL "
              "ELSE l_extendedprice / l_quantity / 1.15 END, "
              "l_extendedprice / l_quantity) * l_quantity AS DECIMAL(18,2))")
