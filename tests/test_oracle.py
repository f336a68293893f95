"""Every registered query with an oracle matches DuckDB on sf0.001; the
rest run and return a stable schema."""

import math

import pytest

import __spark_entry__ as se
from larder.plans.verify import compare
from tests.conftest import SMALL

QUERIES = se.queries()
ORACLE = se.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck_small, name):
    df = QUERIES[name](spark, SMALL)
    cur = duck_small.execute(ORACLE[name])
    status, detail = compare(df.columns, [tuple(r) for r in df.collect()],
                             [d[0] for d in cur.description], cur.fetchall())
    assert status == "OK", detail


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_oracle(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert rows, name
    numbers = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    assert all(r[c] is None or math.isfinite(r[c]) for r in rows for c in numbers)


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert len(df.collect()) > 0
