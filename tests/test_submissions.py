"""Derived requests reach every outcome; deep pages equal the ordered rows and read one block."""

import tempfile

from pyspark.sql import functions as F

from larder.operators import paging as pg
from larder.plans import submissions as sb
from tests.conftest import MEDIUM


def _outcomes(df):
    return {r[0] for r in df.select("outcome").distinct().collect()}


def test_every_outcome_occurs(spark):
    assert _outcomes(sb.review_submissions(spark, MEDIUM)) == {
        "accepted", "invalid_rating", "order_required", "order_not_delivered_or_not_own", "product_not_in_order", "product_already_reviewed",
        "order_already_reviewed"}
    assert _outcomes(sb.invoice_payment_attempts(spark, MEDIUM)) == {"paid", "already_paid", "forbidden", "not_found"}
    assert 0 < sb.new_suppliers(spark, MEDIUM).first()["new_suppliers"] < 100


def test_pages_cover_the_order_without_gaps(spark):
    rows = spark.range(1003).select(F.pmod(F.col("id") * 37, F.lit(501)).alias("score"), "id")
    path = tempfile.mkdtemp(prefix="larder-pages-")
    total = pg.write_page_index(rows.repartition(5), [F.desc("score"), "id"], path, block_rows=100)
    want = [tuple(r) for r in rows.orderBy(F.desc("score"), "id").collect()]
    assert total == 1003 and pg.pages(total, 30) == 34
    got = []
    for page in (1, 2, 17, 34, 35):
        part = [tuple(r)[:2] for r in pg.read_page(spark, path, page, 30, block_rows=100).collect()]
        assert part == want[(page - 1) * 30:page * 30]
        got.append(len(part))
    assert got == [30, 30, 30, 13, 0]
    # page 17 prunes to the blocks of its own rows
    plan = pg.read_page(spark, path, 17, 30, block_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "block" in plan
