"""Findings of the second review on the training-data operators."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from larder.llm import mixing, token_counts
from tests.llm.conftest import make_docs


def test_mix_of_rows_repeated_across_the_cut_keeps_the_budget(spark):
    rows = [(1, "one two three", "a")] * 4000 + [(1, "one two three", "b")] * 500 + [(2, "four five", "b")] * 3000
    rows += [(3, "", "a")] * 3 + [(None, "six", None)] * 2000
    docs = make_docs(spark, rows).repartition(4)
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
    for options in ({}, {"share": 0.4}, {"share": 2.5, "max_epochs": 3}):
        copies = mixing.schedule(mixing._sizes(docs), **options).groupBy("_id", "source").agg(
            F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).alias("n"), F.first("budget").alias("budget")).collect()
        want = Counter({(r["_id"], r.source): r.n for r in copies if r.n})
        mixed = mixing.mix(docs, **options)
        got = Counter({(r.doc_id, r.source): r.n for r in mixed.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()})
        assert got == want
        assert mixed.agg(F.sum(words)).first()[0] <= copies[0].budget
