"""Rows that repeat id and text many times: results of every row, work that does not square."""

import hashlib
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from larder.llm import repeats, toxicity, vectors
from tests.llm.conftest import make_docs, prose


def plain_repeats(rows):
    seen = Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update({data[i:i + 200] for i in range(len(data) - 199)})
        for w, n in Counter(data[i:i + 200] for i in range(len(data) - 199)).items():
            seen[w] += n - 1
    out = Counter()
    for doc, text in rows:
        data = (text or "").encode()
        hit = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - 199):
            if seen[data[i:i + 200]] > 1:
                hit[i:i + 200] = True
        spans = int((hit[1:] & ~hit[:-1]).sum() + hit[0])
        kept = bytes(np.frombuffer(data, np.uint8)[~hit[:-1]])
        out[(doc, len(data), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_suffix_dedup_of_repeated_rows_matches_plain(spark):
    shared = prose(60, 40)
    rows = ([(1, prose(61, 60) + shared)] * 4 + [(2, prose(61, 60) + shared)] + [(None, prose(62, 50) + shared)] * 3 + [(3, "short")] * 5
            + [(4, None)] * 2 + [(5, prose(63, 80))] + [(6, shared + prose(64, 50))])
    docs = make_docs(spark, [(i, t, "a") for i, t in rows]).repartition(4)
    assert Counter(tuple(r)[:5] for r in repeats.remove_repeats(docs).collect()) == plain_repeats(rows)


def test_suffix_dedup_of_20000_equal_rows(spark):
    docs = make_docs(spark, [(1, prose(65, 300), "a")]).crossJoin(spark.range(20_000).select(F.col("id").alias("extra")))
    start = time.time()
    out = repeats.remove_repeats(docs.repartition(8)).groupBy("doc_id", "n_removed", "kept_sha256").count().collect()
    assert [(r.doc_id, r["count"], r.kept_sha256) for r in out] == [(1, 20_000, hashlib.sha256(b"").hexdigest())]
    assert time.time() - start < 120


def test_toxic_sample_takes_a_repeated_text_once(spark):
    words = "vile" * 3
    rows = [(i, f"{words} " * 5 + prose(i, 20) if i % 2 else prose(i, 30), "a") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    once = toxicity.train(make_docs(spark, rows), labels, min_toxic=2)
    often = toxicity.train(make_docs(spark, rows + rows[:4] * 300).repartition(6), labels, min_toxic=2, sample_rows=200)
    assert set(once.units.tolist()) & set(often.units.tolist())
    assert len(once.units) and np.isfinite(often.scores).all()


def test_vector_slices_give_the_same_rows():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300))], names=["id"])
    parts = list(vectors._slices([batch]))
    assert [p.num_rows for p in parts] == [512, 512, 276] and pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
