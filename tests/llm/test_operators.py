"""Operators against brute-force versions on small tables with edge cases:
nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import (decontam, jaccard, mixing, repeats, secrets, token_counts, tokens, toxicity, urls, vectors)
from larder.llm.common import components
from tests.llm.conftest import edge_texts, make_docs, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.select(*names).collect())


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# ------------------------------------------------------------------ 1 secrets

SHAPES = [("assign", re.compile(r'((?i:password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)'), 2, 6),
          ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def brute_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, group, least) in enumerate(SHAPES)
             for m in p.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(found)


def test_secret_base_spans(docs):
    expected = Counter()
    for i, t, _ in edge_texts():
        s = brute_spans(t)
        kinds = Counter(x[3] for x in s)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in s)
        expected[(i, kinds["assign"], kinds["access"], kinds["hex"], sha(joined))] += 1
    assert rows_of(secrets.find_secrets(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == expected


def test_secret_battery_adds_random_tokens_only(spark):
    import random
    draw = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(draw.choice(alphabet) for _ in range(44)) for _ in range(10)]
    words = ["international", "administration", "counterrevolutionary", "telecommunications", "uncharacteristically"]
    texts = [(i, "the " + draw.choice(words) + draw.choice(words) + " of " + draw.choice(words), "a") for i in range(300)]
    texts += [(1000 + i, f"use {k} now", "a") for i, k in enumerate(keys)]
    texts.append((2000, "https/path/of/some/ordinary/web/page and-a-long-slug-with-many-words", "a"))
    got = {r.doc_id: r for r in secrets.find_secrets(make_docs(spark, texts)).collect()}
    assert sum(got[1000 + i].n_random for i in range(len(keys))) >= 8
    assert sum(r.n_random for i, r in got.items() if i < 1000 or i == 2000) == 0
    for i, k in enumerate(keys):
        if got[1000 + i].n_random:
            assert got[1000 + i].spans == f"random:4:{4 + len(k)}"


# ------------------------------------------------------------------ 2 repeats

def brute_repeats(texts, depth=200):
    data = [(i, (t or "").encode()) for i, t, _ in texts]
    seen = Counter(b[p:p + depth] for _, b in data for p in range(len(b) - depth + 1))
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - depth + 1):
            if seen[b[p:p + depth]] > 1:
                gone[p:p + depth] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        yield i, len(b), int(gone.sum()), spans, sha(kept)


def test_repeated_bytes(docs):
    assert (rows_of(repeats.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
            == Counter(brute_repeats(edge_texts())))


def test_repeated_bytes_at_every_border(spark):
    """Passages of 195 to 215 bytes planted at different places; pieces of long texts overlap."""
    texts = []
    for k in range(195, 216):
        passage = prose(500 + k, 60)[:k]
        texts += [(2 * k, prose(k, 30)[:k] + passage + prose(k + 1000, 40), "a"),
                  (2 * k + 1, prose(k + 2000, 20 + k % 7) + passage, "a")]
    assert (rows_of(repeats.remove_repeats(make_docs(spark, texts)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
            == Counter(brute_repeats(texts)))


def test_runs_of_one_long_text_equal_those_of_its_pieces(monkeypatch):
    import pyarrow as pa
    text = prose(77, 4000).encode()
    whole = repeats.window_runs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    starts = set()
    for a in range(0, len(text), 5000):
        part = np.frombuffer(text[a:a + 5000 + repeats.DEPTH - 1], np.uint8)
        _, first, last, *_ = repeats.window_runs(part, np.array([0, len(part)]))
        starts |= {p + a for x, y in zip(first, last, strict=True) for p in range(x, y + 1)}
    assert starts == {p for x, y in zip(whole[1], whole[2], strict=True) for p in range(x, y + 1)}


# ------------------------------------------------------------------ 3 decontamination

def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_decontamination(spark, docs):
    items = [(1, prose(11, 15)), (2, prose(2, 60)), (3, "one two, THREE!"), (4, None), (5, ""), (6, prose(999, 40)),
             (30, "one two, THREE!"), (7, "tick " * 14), (8, prose(12, 90).split()[3])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        m = min(13, len(w))
        for a in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[a:a + m])].add(i)
    expected = Counter()
    for i, t, _ in edge_texts():
        w = bench_words(t)
        hit, found = set(), set()
        for m in {len(k) for k in windows}:
            for a in range(len(w) - m + 1):
                if (k := tuple(w[a:a + m])) in windows:
                    hit |= set(range(a, a + m))
                    found |= windows[k]
        digest = sha(",".join(sorted(map(str, found))))
        expected[(i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontam.report(docs, bench), *columns) == expected
    none = decontam.report(docs, bench.limit(0))
    assert none.where("contaminated OR n_hit > 0").count() == 0 and none.count() == len(edge_texts())
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for k, n in expected.items() if not k[-1])


# ------------------------------------------------------------------ 4 and 7 tokens

def test_token_pages(docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [(i, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x, _ in edge_texts()]
    got = tokens.report(docs).collect()
    assert (Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
            == Counter((i, len(x), zlib.crc32(array("I", x).tobytes())) for i, x in texts))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.cumsum([0] + [r.n_tokens for r in ordered[:-1]]))
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("high", [1, 2, 300, 50257, 2 ** 32 - 1])
def test_pfor_round_trip(n, high):
    x = np.random.default_rng(n + high).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    x[: n // 40] = high - 1
    page = tokens.pack_page(x)
    assert (tokens.unpack_page(page) == x).all()
    if n > 500:
        assert (tokens.unpack_page(page, 2, 4) == x[256:512]).all()


def test_encoder_equals_the_library_on_odd_texts():
    import random

    import public_tokenizers as P
    from tokenizers import Tokenizer
    draw = random.Random(3)
    parts = ["a", "B", "é", "ɏ", "ɐ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2028", "'s", "'", "'ll", "1", "²",
             "٣", "漢", "!", tokens.END_TEXT, "𝒳", "\u0301", "_", "\r\n", "<|", "\x00"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.choice([0, 1, 3, 40]))) for _ in range(2000)]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for special in (True, False):
        library.encode_special_tokens = not special
        got = tokens.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN, special).encode(texts)
        assert [array("I", library.encode(x, add_special_tokens=False).ids).tobytes() for x in texts] == got


def test_token_counts(docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    expected = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in edge_texts())
    assert rows_of(token_counts.report(docs), "doc_id", "n_tokens") == expected


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_separators_across_blocks(block):
    values = np.array([5, 5, 0, 0, 7, 0, 1, 2, 3, 0], np.uint16)
    start, stop = token_counts.separators(values, block=block)
    assert list(zip(start.tolist(), stop.tolist(), strict=True)) == [(0, 2), (3, 3), (4, 5), (6, 9)]


# ------------------------------------------------------------------ 5 mixing

def test_mix(docs):
    sizes = Counter()
    for _, t, s in edge_texts():
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:                                              # reshare until none is above its cap
        rate = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * rate > 2 * sizes[s]]
        if not full:
            target |= {s: weight[s] * rate for s in free}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    out = mixing.mix_report(docs).collect()
    assert len(out) == len(edge_texts())
    source = {(r.doc_id, r.size) for r in out}
    assert all(0 <= r.taken <= 2 * r.size for r in out) and source
    by_target = defaultdict(int)
    largest = defaultdict(int)
    for r in out:
        by_target[(r.source_size, round(r.target, 6))] += r.taken
        largest[(r.source_size, round(r.target, 6))] = max(largest[(r.source_size, round(r.target, 6))], r.size)
    expected = defaultdict(float)
    for s in order:
        expected[(sizes[s], round(target[s], 6))] += target[s]
    assert set(by_target) == set(expected)
    for k, taken in by_target.items():
        assert abs(taken - expected[k]) <= 2 * largest[k]
    assert sum(r.taken for r in out) <= 1.5 * sum(sizes.values())
    assert rows_of(mixing.mix_report(docs), "doc_id", "size", "taken") == Counter((r.doc_id, r.size, r.taken) for r in out)


def test_mix_rows(docs):
    taken = Counter()
    for r in mixing.mix_report(docs).collect():
        if r.size:
            taken[r.doc_id] += r.taken
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.select("doc_id", F.regexp_count("text", F.lit(mixing.WORD)).alias("n")).collect():
        if r.n:
            got[r.doc_id] += r.n
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}


# ------------------------------------------------------------------ 6 URLs

def test_url_rules(spark):
    cases = [("http://a.net/x", "a.net", "/x", "net/", "block"), ("https://EXAMPLE.net/en/1?q=/de/", "example.net", "/en/1", "example.net/en/", "allow"),
             ("http://example.net/en", "example.net", "/en", "net/", "block"), ("x://b.example.com/de/#f", "b.example.com", "/de/", "example.com/de/", "block"),
             ("http://q.org/fr/", "q.org", "/fr/", "org/fr/", "allow"), ("http://forg/fr/", "forg", "/fr/", None, "allow"),
             ("http://a.net", "a.net", "", None, "allow"), ("http://net/", "net", "/", "net/", "block"), (None, "", "", None, "allow"),
             ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://x.com/y.net/", "x.com", "/y.net/", None, "allow"),
             ("http://my.spam-farm.io/p", "my.spam-farm.io", "/p", None, "block"), ("http://É.Net/é/\n?", "É.net", "/é/\n", "net/", "block"),
             ("http://a://b.net/", "a:", "//b.net/", None, "allow"), ("http://" + "a" * 3000 + ".net/", "a" * 3000 + ".net", "/", "net/", "block")]
    pages = spark.createDataFrame([(i, c[0], "h", "r") for i, c in enumerate(cases)], "page_id long, url string, html string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in urls.filter_urls(pages).collect()}
    for i, c in enumerate(cases):
        assert got[i] == c[1:], c
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_automaton_equals_regular_expressions():
    import random
    draw = random.Random(1)
    globs = ["".join(draw.choice(["a", "b", "/", "?", "*", "**"]) for _ in range(draw.randint(0, 9))) for _ in range(60)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    texts = ["".join(draw.choice("ab/c") for _ in range(draw.randint(0, 10))) for _ in range(300)] + [""]
    hits = urls.GlobAutomaton(globs).match(texts)
    for k, g in enumerate(globs):
        form = re.escape(g).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", ".")
        want = [bool(re.fullmatch(form, t)) for t in texts]
        assert hits[:, k].tolist() == want, g


# ------------------------------------------------------------------ 8 Jaccard

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    m = min(5, len(w))
    return {tuple(w[i:i + m]) for i in range(len(w) - m + 1)} if w else set()


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def brute_jaccard(texts):
    sets = [shingles(t) for _, t, _ in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = brute_components(range(len(sets)), links)
    least = {}
    for k, (i, _, _) in enumerate(texts):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    return Counter((i, len(sets[k]), least.get(root[k]) if sets[k] else i) for k, (i, _, _) in enumerate(texts)), root, sets


def test_near_duplicates(docs):
    expected, root, sets = brute_jaccard(edge_texts())
    assert rows_of(jaccard.report(docs), "doc_id", "n_shingles", "component_id") == expected
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not s for s in sets) + len({root[k] for k, s in enumerate(sets) if s})


def chains(seed, n=120):
    """Copies edited step by step: ends of a chain do not link, neighbours do."""
    import random
    draw = random.Random(seed)
    texts, words = [], prose(seed, n).split()
    for _ in range(14):
        words = list(words)
        for _ in range(draw.choice([0, 1, 2, 4, 9])):
            words[draw.randrange(len(words))] = f"w{draw.randrange(10 ** 6)}"
        if draw.random() < 0.3:
            words = words[: int(len(words) * 0.95)]
        texts.append(" ".join(words))
    return texts


def test_near_duplicate_chains(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)                 # several blocks per cell
    monkeypatch.setattr(jaccard, "BOX", 3)
    texts = [(1000 - k, t, "a") for k, t in enumerate(t for s in range(30, 42) for t in chains(s))]
    texts += [(2000 + i, prose(60, 40) + " " + prose(70 + i, 4 + i), "a") for i in range(25)]
    expected, _, _ = brute_jaccard(texts)
    assert rows_of(jaccard.report(make_docs(spark, texts)), "doc_id", "n_shingles", "component_id") == expected


def test_box_bound_loses_no_link():
    r = np.random.default_rng(5)
    points = r.poisson(3, (200, jaccard.GROUPS)).astype(np.int64)
    points[100:] = points[:100] + (r.random((100, jaccard.GROUPS)) < 0.1)
    n = points.sum(axis=1)
    a, b = jaccard.tree_pairs(points.astype(np.uint8), n, np.arange(200))
    got = {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(x, y) for x in range(200) for y in range(x + 1, 200)
            if jaccard.linked(np.minimum(points[x], points[y]).sum(), n[x], n[y])}
    assert got == want and len(want) >= 100
    full = np.full((2, jaccard.GROUPS), 255, np.uint8)           # counts of 255 or more
    assert len(jaccard.tree_pairs(full, np.array([70_000, 75_000]), np.arange(2))[0]) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 300), (7, 90)] + [(500, 500 + k) for k in range(1, 40)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    root = brute_components(nodes, [e for e in edges if e[0] != e[1]])
    low = defaultdict(lambda: 10 ** 9)
    for n in nodes:
        low[root[n]] = min(low[root[n]], n)
    assert got == {n: low[root[n]] for n in nodes}


# ------------------------------------------------------------------ 9 vectors

@pytest.mark.parametrize("cell_rows,block_rows", [(4096, 4096), (15, 7)])
def test_vectors(spark, cell_rows, block_rows):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    more = [base[i % 6] + 0.12 * r.normal(size=16) for i in range(120)]
    vecs = [v.astype("f4").tolist() for v in [*base, *more, base[0], base[0], 3 * base[1]]]
    vecs += [None, [], [0.0] * 16, [-0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15,
             [1.0, 2.0], [2.0, 4.1], [1e-30] * 16, [1e30] * 16]
    rows = [(1000 - k, v, "l", "x") for k, v in enumerate(vecs)]
    rows.append((1000, vecs[0], "l", "x"))                  # a repeated row
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, mult string")
    good = [k for k, (_, v, _, _) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for x in good:
        for y in good:
            u, v = np.array(rows[x][1], np.float32).astype(float), np.array(rows[y][1], np.float32).astype(float)
            if x != y and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.9:
                links.append((x, y))
    degree = Counter(a for a, _ in links)
    root = brute_components(range(len(rows)), links)
    low = defaultdict(lambda: 10 ** 9)
    for k in range(len(rows)):
        low[root[k]] = min(low[root[k]], rows[k][0])
    expected = Counter((i, degree[k], low[root[k]], low[root[k]] == i) for k, (i, *_) in enumerate(rows))
    got = vectors.near_duplicates(table, cell_rows=cell_rows, block_rows=block_rows)
    assert rows_of(got, "vec_id", "n_links", "component_id", "kept") == expected
    assert vectors.near_duplicates(table.limit(0)).count() == 0


# ------------------------------------------------------------------ 10 toxicity

def plain_segments(scores, cost):
    """All maximal scoring segments by definition, recursively."""
    best = (0.0, None, None)
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b] - cost
            if total > best[0] + 1e-12:
                best = (total, a, b)
    if best[1] is None:
        return []
    total, a, b = best
    right = [(s, x + b + 1, y + b + 1) for s, x, y in plain_segments(scores[b + 1:], cost)]
    return plain_segments(scores[:a], cost) + [best] + right


def test_maximal_segments():
    r = np.random.default_rng(2)
    for _ in range(300):
        scores = np.where(r.random(25) < 0.4, r.random(25) * 3, 0)
        place = np.flatnonzero(scores)
        got = toxicity.maximal_segments(place, scores[place], 0.5)
        want = plain_segments(scores.tolist(), 0.5)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert np.allclose([s for s, _, _ in got], [s for s, _, _ in want])


def toxic_corpus(spark, n=1200):
    bad = ["wretch", "fool", "dolt"]
    texts, marks = [], []
    for i in range(n):
        words = prose(3000 + i, 60 + i % 50).split()
        if i % 6 == 0:
            words[10:10] = [bad[i % 3], bad[(i // 3) % 3], "x", bad[i % 2]]
        texts.append((i, " ".join(words), "a"))
        marks.append((i, 1 if i % 6 == 0 else 0, "z"))
    return make_docs(spark, texts), spark.createDataFrame(marks, "doc_id long, toxic int, text string")


def test_toxicity_held_out(spark, docs, no_docs):
    corpus, labels = toxic_corpus(spark)
    out = toxicity.report(corpus, labels).collect()
    assert len(out) == 1200
    held = [r for r in out if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in out)
    assert np.mean([(r.doc_id % 6 == 0) == (r.predicted == 1) for r in held]) > 0.99
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    model = toxicity.train(corpus, labels)
    edge = toxicity.score(docs, model).collect()
    assert len(edge) == len(edge_texts()) and all(r.score < 0.5 for r in edge)
    kept = toxicity.clean(corpus, labels)
    assert kept.columns == corpus.columns and abs(kept.count() - 1000) < 20
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                                1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows_of(toxicity.report(corpus, flipped), "doc_id", "score") == Counter((r.doc_id, r.score) for r in out)
    assert toxicity.report(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0
    assert toxicity.report(no_docs, labels).count() == 0


# ------------------------------------------------------------------ empty tables

@pytest.mark.parametrize("operator", [secrets.find_secrets, repeats.remove_repeats, tokens.report, token_counts.report,
                                      mixing.mix_report, mixing.mix, jaccard.report, jaccard.keep_one])
def test_empty_documents(no_docs, operator):
    assert operator(no_docs).count() == 0


def test_empty_decontamination(spark, no_docs):
    bench = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    assert decontam.report(no_docs, bench).count() == 0


def test_bytes_are_spelled_as_the_vocabulary_does():
    text = "".join(map(chr, [*range(0x300), 0x20AC, 0x1F600]))
    assert tokens.byte_letters(text) == "".join(chr(tokens._BYTE_LETTERS.get(b, b)) for b in text.encode())
    assert tokens.byte_letters("") == "" and tokens.byte_letters(" a\n") == "ĠaĊ"


def test_new_pieces_are_many_to_a_call_and_merge_as_if_alone():
    import public_tokenizers as P
    code = tokens.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN, True)
    library, calls = code._tokenizer.model, []

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def tokenize(self, letters):
            calls.append(letters)
            return library.tokenize(letters)

    class Holder:
        model = Counted()

    code._tokenizer = Holder()
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}'s" for i in range(k, k + 200)) for k in (0, 100)]
    got = code.encode(texts)
    assert len(calls) <= 10                                  # 300 different words
    assert got == [b"".join(array("I", [t.id for t in library.tokenize(tokens.byte_letters(p))]).tobytes()
                            for w in (t.replace(" ", "\n ").split("\n")) for p in (w[:-2], "'s")) for t in texts]
    assert code.encode(texts) == got and len(calls) <= 10


def test_pieces_are_cut_as_the_pattern_does():
    import random

    import public_tokenizers as P
    import regex
    draw = random.Random(5)
    parts = ["a", "s", "t", "re", "ve", "ll", "'", "'s", "'re", "'rest", "'v", " ", "  ", "\n", "\xa0", "1", "²", "漢", "𝒳", "\u0301",
             "!", "\u3000", "\x1c", "\x85", "\u200b", "\ufeff", "é", "\U0010ffff", "\x00"]
    texts = ["", "", " ", "'", "x'", "'r", " 's"] + ["".join(draw.choice(parts) for _ in range(draw.choice([0, 1, 2, 3, 30])))
                                                     for _ in range(3000)] + [""]
    code = tokens.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN, False)
    pieces, ends = code._cut(texts)
    cut = regex.compile(P.PATTERN).findall
    assert pieces.to_pylist() == [p.encode() for t in texts for p in cut(t)]
    assert ends.tolist() == np.cumsum([len(cut(t)) for t in texts]).tolist()
    assert code.encode([]) == [] and code.encode(["", ""]) == [b"", b""]
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert code._cut([points])[0].to_pylist() == [p.encode() for p in cut(points)]
