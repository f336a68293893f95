"""Flat token files cut anywhere: counts at every block size, documents over many files."""

import os
from collections import Counter

import numpy as np
import pytest

from larder.llm import token_counts
from larder.llm.common import staging_path
from tests.llm.conftest import edge_texts, make_docs, prose


@pytest.mark.parametrize("block_bytes", [2, 14, 4096])
def test_counts_at_every_block_size(spark, block_bytes):
    rows = [(1, "a b", "x"), (None, "", "x"), (-5, None, "x"), (1 << 62, "some words here", "x"), (2, "z", "x")]
    if block_bytes > 100:
        rows += edge_texts() + [(900, prose(70, 3000), "x")]
    docs = make_docs(spark, rows).repartition(3)
    whole = Counter(tuple(r) for r in token_counts.report(docs).collect())
    assert Counter(tuple(r) for r in token_counts.report(docs, block_bytes=block_bytes).collect()) == whole
    assert sum(whole.values()) == len(rows)


def test_files_are_bounded_and_a_document_spans_them(spark):
    path = staging_path(spark, "flat-test")
    token_counts.write_flat(make_docs(spark, [(7, prose(71, 4000), "x"), (8, "end", "x")]).coalesce(1), path, block_bytes=1000)
    sizes = [os.path.getsize(os.path.join(path.removeprefix("file:"), f)) for f in os.listdir(path.removeprefix("file:")) if f.startswith("part")]
    assert max(sizes) == 1002 and len(sizes) > 10
    found = {r.doc_id: (r.block, r.n_tokens) for r in token_counts.count_tokens(spark, path).collect()}
    assert found[7][0] == found[8][0] == len(sizes) - 1 or found[7][0] >= len(sizes) - 2
    assert found[7][1] > 4000


def test_scan_of_a_block_against_a_plain_walk():
    rng = np.random.default_rng(8)
    stream = []
    for doc in range(40):
        head = token_counts._id_values([doc if doc % 7 else None])[0].tolist()
        stream += head + rng.integers(1, 300, rng.integers(0, 9)).tolist() + [0]
    values = np.array(stream, np.uint16)
    for size in (5, 17, 64, len(values)):
        rows = [r for i in range(0, len(values), size)
                for b in token_counts._scan(f"part-00003-x-c{i // size:03d}", values[i:i + size]) for r in b.to_pylist()]
        assert sum(r["n"] for r in rows) == len(values) - 40           # all but the separators
        assert sum(r["ends"] for r in rows) == 40
