"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item (a shorter item is
one window). Both sides keep, for every window, the minimum ``gram``-word hash
inside it (leftmost of equals): two equal windows always keep the same one, so
joining the kept fingerprints finds every shared window. A joined fingerprint
carries the hashes of the windows that chose it; these extend the hit to the
exact windows it stands for. Items shorter than the window are winnowed at
their own length.

Work per row is linear in the text. The join is an equi join: distinct benchmark
fingerprints are counted and broadcast up to ``BROADCAST_ROWS`` of them (12 MB),
beyond it both sides are shuffled by fingerprint. Its output is at most one row per document window and
never document x item pairs of a common phrase, because benchmark windows are
distinct before the join. Items are attached to distinct (document, window)
rows only.

Defined results: null and empty texts have no words and are never contaminated;
repeated rows get equal results, one row per input row; an empty benchmark
marks nothing. Extra columns are ignored. A text is hashed in one piece: one text of 32 MB takes
about 1.3 GB of its Python worker (measured in `jaccard`), so the longest text bounds the worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import (RangeHash, as_long, byte_class, gram_hashes, keyed, mix64, stage,
                               text_blocks, word_spans)

# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z, over UTF-8 bytes
WORD_BYTES = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])

_ROW = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("width", pa.int32()),
                  ("print", pa.int64()), ("start", pa.int64()), ("windows", pa.list_(pa.int64()))])
_ROW_SQL = "doc_id long, rk long, width int, print long, start long, windows array<long>"
BROADCAST_ROWS = 1_000_000      # 12 bytes each; beyond it the join shuffles
HEADER = 0                      # width of the row that carries a text's word count


def _winnow(words, owner, width, gram):
    """(fingerprint, first window, number of windows, window hashes) per kept gram."""
    gram = min(gram, width)
    span = width - gram + 1
    window, start = gram_hashes(words, owner, width)
    if not len(start):
        return None
    grams, first = gram_hashes(words, owner, gram)
    at = np.zeros(len(words), np.int64)
    at[first] = np.arange(len(first))
    where = at[start]                               # gram index of each window's first gram
    best, value = where.copy(), grams[where]
    for j in range(1, span):
        other = grams[where + j]
        less = other < value
        best[less] = where[less] + j
        value[less] = other[less]
    new = np.ones(len(start), bool)
    new[1:] = (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    return mix64(value[head] + np.uint64(width)), head, start, window


def fingerprints(texts: DataFrame, widths: list[int], gram: int, window: int) -> DataFrame:
    """Winnowed rows of every text: ``window`` itself, and each width in ``widths``.

    One HEADER row per text has its number of words in ``start``. Texts shorter
    than ``window`` also give one row of their own length when ``widths`` is None
    (the benchmark side).
    """

    def cut(batches):
        for block in text_blocks(batches):
            s, e, owner = word_spans(block, WORD_BYTES)
            words = RangeHash(block.data, fold=True)(s, e) if len(s) else np.zeros(0, np.uint64)
            count = np.bincount(owner, minlength=block.rows.num_rows)
            base = np.cumsum(count) - count
            ids = block.rows.column(0)
            rks = block.rows.column(1)
            n = block.rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [ids, rks, pa.array(np.full(n, HEADER, np.int32)), pa.array(np.zeros(n, np.int64)),
                 pa.array(count.astype(np.int64)),
                 pa.ListArray.from_arrays(np.zeros(n + 1, np.int32), pa.array([], pa.int64()))], schema=_ROW)
            jobs = [(window, words, owner, base)]
            if widths is None:
                for m in np.unique(count[(count > 0) & (count < window)]):
                    mine = (count[owner] == m) if len(owner) else np.zeros(0, bool)
                    own = np.cumsum(np.where(count == m, count, 0)) - np.where(count == m, count, 0)
                    jobs.append((int(m), words[mine], owner[mine], own))
            else:
                jobs += [(m, words, owner, base) for m in widths]
            for m, w, o, b in jobs:
                kept = _winnow(w, o, m, gram)
                if kept is None:
                    continue
                prints, head, start, hashes = kept
                row = o[start[head]]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), rks.take(pa.array(row)),
                     pa.array(np.full(len(head), m, np.int32)), pa.array(as_long(prints)),
                     pa.array(start[head] - b[row]),
                     pa.ListArray.from_arrays(pa.array(np.append(head, len(start)).astype(np.int32)),
                                              pa.array(as_long(hashes)))], schema=_ROW)

    return texts.select("doc_id", "rk", "text").mapInArrow(cut, _ROW_SQL)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, gram: int = 5,
                  ratio: int = 20) -> DataFrame:
    """doc_id, rk, n_words, n_hit, n_items, items_sha256, contaminated per document.

    ``contaminated``: some word is hit and ``ratio * n_hit >= n_words``.
    """
    bench = items.select(F.col("item_id").alias("doc_id"), "text")
    bench = stage(fingerprints(keyed(bench), None, gram, window).where(F.col("width") != HEADER)
                  .select(F.col("doc_id").alias("item_id"), "width", "print",
                          F.explode("windows").alias("window")).distinct(), "decontam-bench")
    # lengths of short items: at most window - 1 values
    widths = sorted(r[0] for r in bench.where(F.col("width") < window).select("width").distinct().collect())
    wanted = bench.select(F.col("width").alias("_w"), F.col("print").alias("_p")).distinct()
    wanted = stage(wanted.unionAll(docs.sparkSession.createDataFrame([(HEADER, 0)], "_w int, _p long")),
                   "decontam-prints")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = fingerprints(keyed(docs), widths, gram, window)
    rows = stage(rows.join(wanted, (F.col("width") == F.col("_w")) & (F.col("print") == F.col("_p")),
                           "left_semi"), "decontam-hits")
    texts = rows.where(F.col("width") == HEADER).select("doc_id", "rk", F.col("start").alias("n_words"))
    hit = (rows.where(F.col("width") != HEADER)
           .select(F.coalesce("doc_id", F.lit(0)).alias("_id"), "rk", "width", "start",
                   F.posexplode("windows").alias("_j", "window")))
    known = bench.select("width", "window").distinct()
    hit = stage(hit.join(known, ["width", "window"], "left_semi")
                .select("_id", "rk", "width", "window", (F.col("start") + F.col("_j")).alias("a")).distinct(),
                "decontam-windows")
    # union of the hit windows: each adds what lies beyond the furthest end so far
    order = Window.partitionBy("_id", "rk").orderBy("a", "width")
    end = F.col("a") + F.col("width")
    seen = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    covered = (hit.select("_id", "rk", F.greatest(
        F.lit(0), end - F.greatest("a", F.coalesce(seen, F.col("a")))).alias("new"))
        .groupBy("_id", "rk").agg(F.sum("new").alias("n_hit")))
    found = (hit.select("_id", "rk", "width", "window").distinct()
             .join(bench.select("width", "window", "item_id").distinct(), ["width", "window"])
             .select("_id", "rk", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("_id", "rk").agg(F.count("*").alias("n_items"),
                                       F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items")))
    per = covered.join(found, ["_id", "rk"], "left").withColumnRenamed("rk", "_rk")
    out = texts.join(per, (F.coalesce("doc_id", F.lit(0)) == F.col("_id")) & (F.col("rk") == F.col("_rk")), "left")
    zero = F.lit(0).cast("long")
    hits = F.coalesce("n_hit", zero)
    return out.select("doc_id", "rk", "n_words", hits.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
                      F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
                      ((hits > 0) & (ratio * hits >= F.col("n_words"))).alias("contaminated"))


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    return contamination(docs, items, **options).drop("rk")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept."""
    bad = (contamination(docs, items, **options).where("contaminated")
           .select(F.col("doc_id").alias("_bad_id"), F.col("rk").alias("_bad_rk")).distinct())
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"),
                      F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("_key"))
    return own.join(bad, F.col("_doc").eqNullSafe(F.col("_bad_id")) & (F.col("_key") == F.col("_bad_rk")),
                    "left_anti").select("_row.*")


SQL = r"""
WITH low AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark),
items AS (
  SELECT id AS item_id, least(len(w), 13) AS m,
         unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2),
                               lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS win
  FROM low WHERE side = 1 AND len(w) > 0),
known AS (SELECT DISTINCT m, win FROM items),
sizes AS (SELECT DISTINCT m FROM items),
wins AS (
  SELECT l.id, s.m, unnest(range(1, len(w) - s.m + 2)) AS a, l.w
  FROM low l, sizes s WHERE side = 0 AND len(w) >= s.m),
hit AS (
  SELECT x.id, x.m, x.a, k.win FROM (SELECT id, m, a, array_to_string(w[a:a + m - 1], ' ') AS win FROM wins) x
  JOIN known k ON x.m = k.m AND x.win = k.win),
words AS (SELECT id, count(DISTINCT p) AS n_hit
          FROM (SELECT id, unnest(range(a, a + m)) AS p FROM hit) GROUP BY id),
found AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT h.id, CAST(i.item_id AS VARCHAR) AS item
        FROM hit h JOIN items i ON h.m = i.m AND h.win = i.win) GROUP BY id)
SELECT l.id AS doc_id, CAST(len(l.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l.w) AS contaminated
FROM low l LEFT JOIN words USING (id) LEFT JOIN found USING (id) WHERE l.side = 0
"""
