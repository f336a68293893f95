"""The pipeline stage by stage against plain versions, then run() as a whole."""

import os
import zlib
from array import array
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import mixing, toxicity
from tests.llm.conftest import DOC_SCHEMA, edge_texts, make_docs, prose
from tests.llm.test_operators import bench_words, brute_components, rows_of, shingles, toxic_corpus

ITEMS = [(1, prose(11, 15)), (2, prose(2, 60)), (3, "one two, THREE!"), (4, None), (5, ""), (6, prose(999, 40))]
KEY = ("doc_id", "text", "source")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Toxic and clean documents, then the edge cases (null ids and texts, repeats, copies, passages)."""
    corpus, labels = toxic_corpus(spark)
    shifted = [(None if i is None else i + 100_000, t, s) for i, t, s in edge_texts()]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = corpus.unionByName(make_docs(spark, shifted))
    docs.repartition(5).write.parquet(os.path.join(folder, "documents.parquet"))
    labels.write.parquet(os.path.join(folder, "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    return folder


@pytest.fixture(scope="module")
def steps(spark, tables, tmp_path_factory):
    """The table before each stage and after the last, each written and read back."""
    out = [spark.read.parquet(os.path.join(tables, "documents.parquet"))]
    folder = tmp_path_factory.mktemp("steps")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], tables).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing",
                                                      "token_files"]
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, tables, steps):
    before, after = steps[:2]
    model = toxicity.train(before, spark.read.parquet(os.path.join(tables, "labels.parquet")))
    scores = {}
    for r in toxicity.score(before.withColumn("doc_id", F.xxhash64("doc_id", "text")), model).collect():
        scores[r.doc_id] = r.score
    want = Counter()
    for r in before.withColumn("key", F.xxhash64("doc_id", "text")).collect():
        if scores[r.key] < 0.5:
            want[tuple(r[k] for k in KEY)] += 1
    assert rows_of(after, *KEY) == want
    gone = rows_of(before, *KEY) - rows_of(after, *KEY)
    planted = {i for i in range(0, 1200, 6)}
    assert len(planted & {k[0] for k in gone}) > 0.97 * len(planted)
    assert sum(k[0] not in planted for k in gone) < 10
    assert all(k[0] is not None and k[0] < 100_000 for k in gone)


def test_one_of_each_group_stays(steps):
    before, after = [df.select(*KEY).collect() for df in steps[1:3]]
    sets = [shingles(r.text) for r in before]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = brute_components(range(len(sets)), links)
    groups = {}
    want = Counter(tuple(r) for r, s in zip(before, sets, strict=True) if not s)
    for k, r in enumerate(before):
        if sets[k]:
            groups.setdefault(root[k], []).append(r)
    got = Counter(tuple(r) for r in after)
    assert not want - got
    for rows in groups.values():
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        kept = [(i, t, s) for i, t, s in got.elements() if any((i, t, s) == tuple(r) for r in rows)]
        assert len(kept) == 1 and kept[0][0] == (min(ids) if ids else None)
    assert len(after) == sum(want.values()) + len(groups)


def test_contaminated_documents_go(steps):
    before, after = steps[2:4]
    windows = set()
    for _, t in ITEMS:
        w = bench_words(t)
        m = min(13, len(w))
        windows |= {tuple(w[a:a + m]) for a in range(len(w) - m + 1)} if w else set()
    want = Counter()
    for r in before.select(*KEY).collect():
        w, hit = bench_words(r.text), set()
        for m in {len(k) for k in windows}:
            for a in range(len(w) - m + 1):
                if tuple(w[a:a + m]) in windows:
                    hit |= set(range(a, a + m))
        if not hit or 20 * len(hit) < len(w):
            want[tuple(r)] += 1
    assert rows_of(after, *KEY) == want
    assert before.count() > after.count()


def test_mix_takes_what_the_schedule_says(steps):
    before, after = steps[3:5]
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
    taken = Counter()
    for r in mixing.mix_report(before).collect():
        taken[r.doc_id] += r.taken
    got = Counter()
    for r in after.select("doc_id", words.alias("n")).collect():
        got[r.doc_id] += r.n
    assert +got == +taken
    size = Counter()
    for r in before.select("doc_id", words.alias("n")).collect():
        size[r.doc_id] += r.n
    assert all(got[i] <= 2 * size[i] for i in got)
    assert sum(got.values()) > 1.4 * sum(size.values())


def test_token_files_hold_every_copy(steps):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    before, files = steps[4].collect(), steps[5].collect()
    ids = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in before]
    assert (Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in files)
            == Counter((i, len(x), zlib.crc32(array("I", x).tobytes())) for i, x in ids))
    at = 0
    for r in sorted(files, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run_equals_the_stages(spark, tables, steps):
    names = ("doc_id", "n_tokens", "ids_crc32")
    assert rows_of(corpus_pipeline.run(spark, tables), *names) == rows_of(steps[-1], *names)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
