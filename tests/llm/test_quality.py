"""Quality rules: counts against a plain version, sketches against exact quantiles, edge cases."""

import re
from collections import Counter

import numpy as np
import pytest

from larder.llm import quality
from tests.llm.conftest import edge_texts, make_docs, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    runs = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit))


def odd_texts():
    rows = edge_texts()
    rows += [(700, "a b c d e f g h " * 40 + "\nx\n\n x\nx", "q"), (701, "\x0b\x0c\r\n\t", "q"), (702, "## $$ <a> |\n" * 30, "q"),
             (703, "one two three four five six seven\n" * 3, "q"), (704, prose(40, 128) + " " + prose(41, 7) + " " + prose(40, 128), None),
             (705, " non breaking spaces are words", "q"), (706, "z " * 40_000 + prose(42, 3000), "q"),
             (707, "\n".join(prose(50 + i % 130, 3) for i in range(700)) + "\n", "q"), (708, "x" * 300_000, "q")]
    return rows


@pytest.mark.parametrize("long_text", [quality.LONG_TEXT, 1000, 0])
def test_counts_match_plain_in_rows_and_in_pieces(spark, long_text):
    rows = odd_texts()
    got = quality.measure(make_docs(spark, rows).repartition(5), long_text)
    assert Counter((r.doc_id, *[r[c] for c in quality.COUNTS]) for r in got.collect()) == Counter(
        (i, *plain_counts(t)) for i, t, _ in rows)


def test_sketch_quartiles_are_within_their_bound(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(6, 1.5, 4000), np.zeros(300)]).astype(int)
    rows = [(i, 10, int(v), 0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_symbols long, zero long").selectExpr(
        "doc_id", "'en' AS lang", "string(doc_id % 3) AS source", "n_words", "zero AS word_chars", "n_symbols * 10 div 10000 AS n_symbols",
        "zero AS n_lines", "zero AS n_dup_lines", "n_symbols AS n_repeat_words")
    bins = quality.sketches(df)
    for keys in (["lang", "source"], ["lang"], []):
        for r in quality.quartiles(bins, keys).where("metric = 'repeat_share'").collect():
            part = np.sort(values[np.arange(len(values)) % 3 == int(r["source"])] if "source" in keys else values) * 1000
            for q, share in ((r["q1"], 1), (r["q3"], 3)):
                exact = part[-(-len(part) * share // 4) - 1]
                assert q <= exact <= q + q / 64 + 1


def test_merged_sketches_equal_one_sketch(spark):
    docs = quality.measure(make_docs(spark, odd_texts()))
    whole = quality.sketches(docs.selectExpr("doc_id", "'x' AS lang", "'y' AS source", *quality.COUNTS))
    merged = quality.quartiles(quality.sketches(docs), [])
    assert sorted(merged.collect()) == sorted(quality.quartiles(whole, []).collect())


def test_a_source_sets_its_own_fences(spark):
    """Code-like texts are ordinary in their source and rejected among prose."""
    code = "if (a < b) { x = y | z; } else { # $v = %w & 7 > 2 }"
    rows = [(i, prose(i, 60), "prose") for i in range(300)] + [(1000 + i, f"{code} " + prose(i, 25), "code") for i in range(300)]
    rows += [(5000, f"{code} " + prose(900, 25), "prose"), (5001, prose(901, 60), "code"), (5002, prose(902, 5), "prose"),
             (5003, "again and again and more of it here " * 20, "prose")]
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.report(make_docs(spark, rows).repartition(6)).collect()}
    assert kept[5000] == (False, False) and kept[5002] == (True, False) and kept[5003] == (True, False)
    assert all(kept[i] == (False, True) for i, _, _ in rows if i < 5000)


def test_small_groups_use_their_language_and_null_groups_count(spark):
    rows = [(i, prose(i, 60), None) for i in range(150)] + [(900, prose(900, 60), "tiny"), (901, "# $ % & " * 10, "tiny"), (None, None, None)]
    out = quality.report(make_docs(spark, rows)).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.kept for r in out if r.doc_id in (900, 901)} == {900: True, 901: False}


def test_salted_and_broadcast_fences_agree(spark, monkeypatch):
    measured = quality.measure(make_docs(spark, odd_texts()))
    limits = quality.fences(quality.sketches(measured))
    near = Counter(quality.judge(measured, limits).collect())
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    assert Counter(quality.judge(measured, limits).collect()) == near


def test_many_repeated_rows_and_empty_table(spark, no_docs):
    rows = [(7, prose(3, 60), "hot")] * 3000
    out = quality.report(make_docs(spark, rows)).collect()
    assert len(out) == 3000 and len(set(out)) == 1 and out[0].kept
    assert quality.report(no_docs).count() == 0
