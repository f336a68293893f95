"""Compare a Spark result with its DuckDB oracle (used by tests and tools).

Strict: same column names, same row count and the same multiset of rows as
Python values (floats exactly; a tolerant pass only labels near misses).
"""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

from larder.sources.tables import TABLES


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, tol=False):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) if tol else v
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v.normalize()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return tuple(_norm(x, tol) for x in v)
    return v


def compare(scols, srows, ocols, orows) -> tuple[str, str]:
    """Return (status, detail) with status OK / NEAR / FAIL."""
    if sorted(scols) != sorted(ocols):
        return "FAIL", f"columns spark={scols} oracle={ocols}"
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    oi = [ocols.index(c) for c in order]
    S = [tuple(r[i] for i in si) for r in srows]
    O = [tuple(r[i] for i in oi) for r in orows]
    if len(S) != len(O):
        return "FAIL", f"rows spark={len(S)} oracle={len(O)}"
    exact = Counter(tuple(_norm(v) for v in r) for r in S) == Counter(tuple(_norm(v) for v in r) for r in O)
    if exact:
        return "OK", f"{len(S)} rows"
    cs = Counter(tuple(_norm(v, True) for v in r) for r in S)
    co = Counter(tuple(_norm(v, True) for v in r) for r in O)
    if cs == co:
        return "NEAR", f"{len(S)} rows equal to 1e-6 only"
    return "FAIL", (f"cols={order} spark-only={list((cs - co).elements())[:2]} "
                    f"oracle-only={list((co - cs).elements())[:2]}")
