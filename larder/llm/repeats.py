"""Repeated-span removal: a depth-limited, most-significant-first radix refinement.

Every byte position starts a suffix, and only its first ``DEPTH`` bytes matter:
two suffixes that agree that far are a repeated window. Suffixes are not listed
one by one. All windows of a text that share their minimum ``GRAM``-byte hash
(their anchor, leftmost of equals) form one run of neighbours; equal windows
always have equal anchors at equal distance. The passes go from the coarsest
common digit to single windows, and at each pass groups of one leave:

1. anchors are grouped by their gram; an anchor alone in its group is dropped
   with all its windows (most of the corpus ends here);
2. runs with the same bytes from the first to the last window are repeated as a
   whole; one of each kind stays to be compared with the others;
3. the remaining runs are cut into nodes of ``NODE`` window places. A node whose
   common core is alone is dropped, a node with all bytes equal to another's is
   repeated, the others go on;
4. the windows left are grouped one by one: equal groups are repeated windows.

Groups are counted with map-side combining and joined back by key, so a passage
shared by a third of the corpus never meets in one task, and nothing is
collected. Hashes are 64 bits within a group of equal grams (another 64 bits).
Texts move twice, zstd-packed: to cut the contexts of the runs of pass 3, and to
remove the bytes.

Defined results: null and empty texts are empty and keep the hash of no bytes;
texts shorter than ``DEPTH`` keep everything; repeated rows are occurrences of
their own (rows that repeat id and text are cut once, their result repeated); an empty table gives no rows; extra columns are ignored. Texts beyond
the block size are cut into overlapping pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import RangeHash, as_long, keyed, mix64, stage, text_blocks

DEPTH = 200
GRAM = 48
NODE = 16
PIECE = 1 << 19                # window starts handled at once; positions fit 20 bits
PLACE = np.uint64((1 << 20) - 1)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by block prefixes and suffixes."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def window_runs(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, gram: int = GRAM):
    """Runs of windows with one anchor in texts given by ``offsets``.

    Returns text row, first and last window start, anchor (all relative to
    ``data``), gram hash, and hash of all bytes of the run.
    """
    sizes = np.diff(offsets)
    starts = offsets[:-1]
    room = np.maximum(sizes - depth + 1, 0)
    total = int(room.sum())
    if total == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64)
    row = np.repeat(np.arange(len(sizes)), room)
    p = np.arange(total) - np.repeat(np.cumsum(room) - room, room) + starts[row]
    ranges = RangeHash(data)
    grams = ranges.sliding(gram)
    packed = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_minimum(packed, depth - gram + 1)[p] & PLACE).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    last = np.r_[head[1:], total] - 1
    first, final, at = p[head], p[last], anchor[head]
    whole = mix64(ranges(first, final + depth) ^ ((at - first) * 256 + (at - final)).astype(np.uint64))
    return row[head], first, final, at, grams[at], whole


_RUN = "doc_id long, rk long, gram long, whole long, first long, last long, anchor long"


def _runs(texts: DataFrame) -> DataFrame:
    """One row per run: places are byte offsets in the text."""

    def cut(batches):
        for block in text_blocks(batches, limit=PIECE):
            pieces = [(block.data, block.offsets, 0)]
            if len(block.data) > 2 * PIECE:                     # one very long text
                pieces = [(block.data[a:a + PIECE + DEPTH - 1], None, a) for a in range(0, len(block.data), PIECE)]
            for data, offsets, shift in pieces:
                if offsets is None:
                    offsets = np.array([0, len(data)])
                row, first, last, at, gram, whole = window_runs(data, offsets)
                if not len(row):
                    continue
                base = offsets[row] - shift
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [block.rows.column(0).take(take), block.rows.column(1).take(take), pa.array(as_long(gram)),
                     pa.array(as_long(whole)), pa.array(first - base), pa.array(last - base), pa.array(at - base)],
                    names=["doc_id", "rk", "gram", "whole", "first", "last", "anchor"])

    return texts.select("doc_id", "rk", "text").mapInArrow(cut, _RUN)


def _packed_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, rk, packed): texts as zstd frames, for the shuffles."""

    def pack(batches):
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array([squeeze(t.as_buffer()) for t in part.column(2)], pa.binary())],
                    names=["doc_id", "rk", "packed"])

    return texts.select("doc_id", "rk", "text").mapInArrow(pack, "doc_id long, rk long, packed binary")


def _same(left: str = "doc_id", right: str = "_id"):
    return F.col(left).eqNullSafe(F.col(right)) & (F.col("rk") == F.col("_rk"))


def _contexts(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds the bytes from the first window to the end of the last one to ``runs``."""
    per = (runs.groupBy(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"))
           .agg(F.collect_list(F.struct("gram", "first", "last", "anchor", "open")).alias("runs")))

    def cut(batches):
        import zstandard
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for r in range(batch.num_rows):
                text = expand(batch.column(2)[r].as_py())
                runs = batch.column(3)[r].values
                n = len(runs)
                first, last = np.asarray(runs.field("first")), np.asarray(runs.field("last"))
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column(0)[r], n), pa.repeat(batch.column(1)[r], n), runs.field("gram"),
                     runs.field("first"), runs.field("last"), runs.field("anchor"), runs.field("open"),
                     pa.array([text[a:b + DEPTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)],
                              pa.binary())],
                    names=["doc_id", "rk", "gram", "first", "last", "anchor", "open", "bytes"])

    joined = _packed_texts(texts).join(per, _same()).select("doc_id", "rk", "packed", "runs")
    return joined.mapInArrow(cut, "doc_id long, rk long, gram long, first long, last long, anchor long, "
                                  "open boolean, bytes binary")


def _flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _keys(contexts: DataFrame, width: int) -> DataFrame:
    """Cuts runs into nodes of ``width`` distances to the anchor (1: windows).

    Per node: ``core`` hashes the bytes all its windows share, ``whole`` all
    bytes of the windows it holds; ``low``/``high`` are their starts in the text.
    """

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                data, offsets = _flat_bytes(part.column(7))
                ranges = RangeHash(data)
                first, last, anchor = (np.asarray(part.column(i)) for i in (3, 4, 5))
                near, far = anchor - last, anchor - first          # distances of the run
                node = near // width
                count = far // width - node + 1
                row = np.repeat(np.arange(len(first)), count)
                node = node[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                lo, hi = np.maximum(node * width, near[row]), np.minimum(node * width + width - 1, far[row])
                here = offsets[row] + far[row]                     # the anchor's place in ``data``
                core = mix64(ranges(here - node * width, here - (node * width + width - 1) + DEPTH)
                             ^ node.astype(np.uint64))
                whole = mix64(ranges(here - hi, here - lo + DEPTH) ^ (lo * 256 + hi).astype(np.uint64))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), part.column(2).take(take),
                     part.column(6).take(take), pa.array(as_long(core)), pa.array(as_long(whole)),
                     pa.array(anchor[row] - hi), pa.array(anchor[row] - lo), pa.array(anchor[row])],
                    names=["doc_id", "rk", "gram", "open", "core", "whole", "first", "last", "anchor"])

    return contexts.mapInArrow(cut, "doc_id long, rk long, gram long, open boolean, core long, whole long, "
                                    "first long, last long, anchor long")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """(_gram, _key) that occur more than once."""
    return stage(rows.groupBy(F.col("gram").alias("_gram"), F.col(key).alias("_key"))
                 .agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "repeat-shared")


def _on(key: str):
    return (F.col("gram") == F.col("_gram")) & (F.col(key) == F.col("_key"))


def repeated_intervals(texts: DataFrame) -> DataFrame:
    """doc_id, rk, first, last: starts of repeated windows, as inclusive intervals."""
    runs = _runs(texts)
    # counted keys are written first: a join of two plain shuffles can split a hot key
    grams = stage(runs.groupBy(F.col("gram").alias("_gram")).agg(F.count("*").alias("_n"))
                  .where("_n > 1").drop("_n"), "repeat-grams")
    runs = stage(runs.join(grams, F.col("gram") == F.col("_gram"), "left_semi"), "repeat-runs")
    kinds = stage(runs.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct(
        "doc_id", "rk", "first", "last", "anchor")).alias("one")), "repeat-kinds")
    many = kinds.where("n > 1").select(F.col("gram").alias("_gram"), F.col("whole").alias("_key"))
    whole = runs.join(many, _on("whole"), "left_semi").select("doc_id", "rk", "first", "last")
    # runs of their own kind, and one run of each repeated kind they may share windows with
    open_grams = (kinds.groupBy(F.col("gram").alias("_gram"))
                  .agg(F.count_if(F.col("n") == 1).alias("alone"), F.count("*").alias("kinds"))
                  .where("alone > 0 AND kinds > 1").select("_gram"))
    compare = (kinds.join(open_grams, F.col("gram") == F.col("_gram"), "left_semi")
               .select("one.doc_id", "one.rk", "gram", "one.first", "one.last", "one.anchor",
                       (F.col("n") == 1).alias("open")))
    contexts = stage(_contexts(texts, compare), "repeat-contexts")
    nodes = stage(_keys(contexts, NODE), "repeat-nodes")
    equal = _shared(nodes, "whole")
    done = nodes.where("open").join(equal, _on("whole"), "left_semi").select("doc_id", "rk", "first", "last")
    left = (nodes.join(_shared(nodes, "core"), _on("core"), "left_semi"))
    # one node of each kind is enough to compare with; kinds that repeat are decided
    left = (left.groupBy("gram", "core", "whole").agg(F.count("*").alias("n"), F.min(F.struct(
            "doc_id", "rk", "first", "last", "anchor", "open")).alias("one"))
            .select("gram", "one.doc_id", "one.rk", F.col("one.first").alias("nf"), F.col("one.last").alias("nl"),
                    F.col("one.anchor").alias("na"), (F.col("one.open") & (F.col("n") == 1)).alias("undecided")))
    own = left.select(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"), F.col("gram").alias("_gram"),
                      "nf", "nl", "na", "undecided")
    cut = (contexts.join(own, _same() & (F.col("gram") == F.col("_gram")) & (F.col("anchor") == F.col("na"))
                         & (F.col("first") <= F.col("nf")) & (F.col("nl") <= F.col("last")))
           .select("doc_id", "rk", "gram", F.col("nf").alias("first"), F.col("nl").alias("last"), "anchor",
                   F.col("undecided").alias("open"),
                   F.expr("substring(bytes, int(nf - first) + 1, int(nl - nf) + %d)" % DEPTH).alias("bytes")))
    windows = stage(_keys(cut, 1).select("doc_id", "rk", "gram", "whole", "first", "last", "open"), "repeat-windows")
    single = (windows.where("open").join(_shared(windows, "whole"), _on("whole"), "left_semi")
              .select("doc_id", "rk", "first", "last"))
    return whole.unionAll(done).unionAll(single)


def _remove(text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[int, int, str]:
    """Bytes removed, maximal runs removed, hash of what is kept."""
    order = np.argsort(first, kind="stable")
    start, end = first[order], last[order] + DEPTH
    reach = np.maximum.accumulate(end)
    head = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    a, b = start[head], reach[np.r_[head[1:], len(start)] - 1]
    kept = hashlib.sha256()
    at = 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        kept.update(text[at:x])
        at = y
    kept.update(text[at:])
    return int((b - a).sum()), len(a), kept.hexdigest()


def _with_count(work, batches):
    """Hands the last column (a row count) past ``work``, which keeps rows and their order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        out = pa.Table.from_batches(list(work([batch.select(batch.schema.names[:-1])])))
        yield from out.append_column("_n", batch.column(batch.num_columns - 1)).combine_chunks().to_batches()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs``.

    Rows that repeat both id and text are worked on as one text: every window of it
    also starts in the other row, so all of it is repeated, and its result counts for
    each of its rows.
    """
    base = keyed(docs)
    copies = stage(base.groupBy(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk")).agg(F.count("*").alias("_n"))
                   .where("_n > 1"), "repeat-copies")
    texts, found = base, None
    if not copies.isEmpty():
        alike = base.join(copies, _same(), "left_semi").groupBy("doc_id", "rk").agg(F.first("text").alias("text"))
        texts = stage(base.join(copies, _same(), "left_anti").unionByName(alike), "repeat-texts")
        last = (F.octet_length("text") - DEPTH).cast("long")
        found = (texts.join(copies, _same(), "left_semi")
                 .select("doc_id", "rk", F.lit(0).cast("long").alias("first"), last.alias("last")).where("last >= 0"))
    inside = repeated_intervals(texts)
    found = ((inside if found is None else inside.unionAll(found)).groupBy(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"))
             .agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last")))

    def remove(batches):
        import zstandard
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                text = expand(batch.column(1)[r].as_py())
                first, last = batch.column(2)[r], batch.column(3)[r]
                cut = ((0, 0, hashlib.sha256(text).hexdigest()) if not first.is_valid else
                       _remove(text, np.asarray(first.values), np.asarray(last.values)))
                out.append((batch.column(0)[r].as_py(), len(text), *cut))
            if out:
                a, b, c, d, e = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()),
                     pa.array(d, pa.int64()), pa.array(e, pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _packed_texts(texts).join(found, _same(), "left")
    spec = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if texts is base:
        return joined.select("doc_id", "packed", "first", "last").mapInArrow(remove, spec)
    joined = joined.select("doc_id", "rk", "packed", "first", "last").join(
        copies.withColumnsRenamed({"_id": "_cid", "_rk": "_crk"}), F.col("doc_id").eqNullSafe(F.col("_cid")) & (F.col("rk") == F.col("_crk")), "left")
    one = joined.where("_n IS NULL").select("doc_id", "packed", "first", "last").mapInArrow(remove, spec)
    # a text of many rows is cut once and its result row repeated
    many = joined.where("_n IS NOT NULL").select("doc_id", "packed", "first", "last", "_n").mapInArrow(
        lambda batches: _with_count(remove, batches), spec + ", _n long")
    many = many.select("*", F.explode(F.expr("sequence(1L, _n)"))).drop("col", "_n")
    return one.unionByName(many)
