"""N-gram Jaccard join with count vectors in R-tree boxes.

A document is the set of its distinct 5-word shingles; two documents link if
``100 * |intersection| >= 80 * |union|``. Documents with equal sets are one class
and only classes are joined.

* Every set becomes a point: its shingles are hashed into ``GROUPS`` groups and
  counted. The overlap of two sets is at most the sum of the coordinate minima
  of their points, and of two boxes the sum of the minima of their upper corners.
* The index is partitioned so that it can be joined in many tasks: two linked
  sets share one of their first ``n - ceil(0.8 n) + 1`` shingles in any common
  order (here: shingles that a bounded sketch over all documents finds frequent
  come last, else by hash), so points meet in the cells of those shingles. Cells
  of one document are dropped.
* First each cell links its members to one hub, the member with most of its
  prefix shared. The exact test runs on the texts; the links give components.
* Then each cell that still holds several components packs its points, ordered by
  size, into boxes and compares box against box, then point against point; pairs
  of one component need no test. The cells a pair survives in are counted: that
  is the overlap of its prefixes, a second bound. Surviving pairs are tested
  exactly.

The result is exact: a pair of different components that shares a cell is either
ruled out by its bound or tested. Large cells are cut into blocks of ``BLOCK`` points
and joined block against block; hubs with many members are salted. Links are kept as
a spanning set, never as all pairs.

Defined results: null and empty texts (or texts without words) have an empty set,
link with nothing and are their own component; repeated rows are copies; an
empty table gives no rows; extra columns are ignored. A null doc_id takes part
but never names a component, unless the component has no other id. A text is hashed in one piece: one text of 32 MB takes
about 1.3 GB of its Python worker (measured), so the longest text bounds the worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import (RangeHash, as_long, byte_class, components, gram_hashes, keyed, mix64,
                               release_memory, stage, text_blocks, unstage, word_spans)

WORD_BYTES = byte_class([(0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF)])     # [^\x20\x09-\x0D]+
SHINGLE = 5
LINK = (80, 100)               # intersection / union
GROUPS = 256                   # one byte each; 255 stands for any larger count
SKETCH_BITS = 20               # 8 MB of counters
SKETCH_PARTS = 64
BOX = 32                       # points of an R-tree leaf
BLOCK = 256                    # points of a cell handled at once
HUB_ROWS = 1000                # members tested against one copy of a hub


def linked(overlap, a, b):
    """The contract's test on sizes and overlap (numbers, arrays or columns)."""
    return LINK[1] * overlap >= LINK[0] * (a + b - overlap)


def prefix_length(n: np.ndarray) -> np.ndarray:
    """n - ceil(t n) + 1, in whole numbers."""
    return n - (LINK[0] * n + LINK[1] - 1) // LINK[1] + 1


def shingle_sets(block, width: int = SHINGLE):
    """Distinct (text row, shingle hash) pairs of a block, sorted by row and hash."""
    starts, ends, owner = word_spans(block, WORD_BYTES)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = RangeHash(block.data, fold=True)(starts, ends)
    grams, first = gram_hashes(words, owner, width)
    rows, hashes = [owner[first]], [grams]
    count = np.bincount(owner, minlength=block.rows.num_rows)
    for m in range(1, width):                     # short texts: the whole sequence
        mine = count[owner] == m
        if mine.any():
            g, f = gram_hashes(words[mine], owner[mine], m)
            rows.append(owner[mine][f])
            hashes.append(g)
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _sketch(texts: DataFrame) -> np.ndarray:
    """Occurrences (documents) of shingles by hash slot, over all texts; bounded size."""
    slots = 1 << SKETCH_BITS
    width = slots // SKETCH_PARTS

    def count(batches):
        total = np.zeros(slots, np.uint32)
        for block in text_blocks(batches):
            _, value = shingle_sets(block)
            total += np.bincount((value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64),
                                 minlength=slots).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(SKETCH_PARTS)), pa.array([p.tobytes() for p in total.reshape(SKETCH_PARTS, width)], pa.binary())],
            names=["part", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}                 # at most SKETCH_PARTS
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
                                         names=["part", "counts"])

    rows = (texts.select("text").mapInArrow(count, "part long, counts binary").repartition("part")
            .mapInArrow(add, "part long, counts binary").collect())
    out = np.zeros((SKETCH_PARTS, width), np.int64)
    for r in rows:
        out[r["part"]] += np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def _levels(sketch: np.ndarray) -> np.ndarray:
    """Per slot: half-doublings by which it exceeds 1.25 times the mean, at least 0."""
    mean = max(sketch.mean(), 1.0)
    return np.minimum(np.floor(2 * np.log2(np.maximum(sketch / mean / 1.25, 1.0))), 31).astype(np.uint8)


_SET = "doc_id long, rk long, n long, sig1 long, sig2 long, prefix array<long>, last long, point binary"


def _sets(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """Per text: set size, 128-bit set signature, prefix shingles, count vector."""

    def build(batches):
        for block in text_blocks(batches):
            row, value = shingle_sets(block)
            rows = block.rows.num_rows
            n = np.bincount(row, minlength=rows)
            cut = np.concatenate([[0], np.cumsum(n)])
            sigs = []
            for salt in (0x1234567, 0x89ABCDE):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(value ^ np.uint64(salt)))]).astype(np.uint64)
                sigs.append(total[cut[1:]] - total[cut[:-1]])
            slot = (value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            order = np.lexsort((value, levels[slot], row))
            keep = np.where(n > 0, prefix_length(n), 0)
            place = np.arange(len(row)) - cut[row]
            prefix = value[order][place < keep[row]]
            # place of the last prefix shingle in the common order
            last = np.zeros(rows, np.uint64)
            end = (cut[:-1] + keep - 1)[n > 0]
            last[n > 0] = (levels[slot[order[end]]].astype(np.uint64) << np.uint64(58)) | (value[order[end]] >> np.uint64(6))
            group = (mix64(value) % np.uint64(GROUPS)).astype(np.int64)
            points = np.bincount(row * GROUPS + group, minlength=rows * GROUPS).reshape(rows, GROUPS)
            points = np.minimum(points, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), block.rows.column(1), pa.array(n.astype(np.int64)), pa.array(as_long(sigs[0])),
                 pa.array(as_long(sigs[1])),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)),
                                          pa.array(as_long(prefix))),
                 pa.array(as_long(last)), pa.array([p.tobytes() for p in points], pa.binary())],
                names=["doc_id", "rk", "n", "sig1", "sig2", "prefix", "last", "point"])

    return texts.select("doc_id", "rk", "text").mapInArrow(build, _SET)


def _pack(texts: DataFrame) -> DataFrame:
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


def _texts_of(pairs: DataFrame, texts: DataFrame, whom: DataFrame) -> DataFrame:
    """(uid, packed) of the classes in ``pairs``; a repeated row only repeats its tests."""
    need = pairs.select(F.col("a").alias("uid")).unionAll(pairs.select("b")).distinct()
    need = whom.join(need, "uid", "left_semi")
    return stage(_pack(texts).join(need, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rk") == F.col("_rk")))
                 .select("uid", "packed"), "jaccard-texts")


def _one_set(packed: bytes, expand) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array([expand(packed)], pa.binary())], names=["text"])
    return np.concatenate([shingle_sets(b)[1] for b in text_blocks([batch], release=False)])


def verify(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, tested on their texts (``packed``: uid, packed).

    ``b`` is the hub: its set is built once per salt and its members stream past.
    """
    sizes = pairs.groupBy(F.col("b").alias("_b")).agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("_s"))
    salted = (pairs.join(sizes, F.col("b") == F.col("_b"))
              .select("a", "b", F.pmod(F.xxhash64("a"), F.col("_s")).cast("int").alias("salt"), "_s"))
    members = (salted.join(packed, F.col("a") == F.col("uid"))
               .select("b", "salt", F.col("a").alias("member"), "packed"))
    hubs = (sizes.select(F.col("_b").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("salt"))
            .join(packed, F.col("b") == F.col("uid")).select("b", "salt", F.lit(None).cast("long").alias("member"), "packed"))

    def test(batches):
        import zstandard
        expand = zstandard.ZstdDecompressor().decompress
        now, own = None, None
        for batch in batches:
            b, member = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = []
            for r in range(batch.num_rows):
                value = _one_set(batch.column(3)[r].as_py(), expand)
                if member[r] is None:
                    now, own = b[r], value
                elif now == b[r]:
                    overlap = len(np.intersect1d(own, value, assume_unique=True))
                    if linked(overlap, len(own), len(value)):
                        out.append((member[r], b[r]))
            if out:
                a, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    rows = hubs.unionAll(members).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("member").asc_nulls_first())
    return rows.mapInArrow(test, "a long, b long")


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most overlap of sets at points ``a`` and ``b``: sum of the coordinate minima."""
    least = np.minimum(a, b)
    total = least.sum(axis=-1, dtype=np.int64)
    if least.dtype == np.uint8:
        total[(least == 255).any(axis=-1)] = np.iinfo(np.int32).max      # a count that may be larger
    return total


def boxes(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """R-tree leaves over points ordered by size: bounds, upper corners, least sizes."""
    cut = np.arange(0, len(points), BOX)
    return np.r_[cut, len(points)], np.maximum.reduceat(points, cut, axis=0), np.minimum.reduceat(sizes, cut)


def tree_pairs(points: np.ndarray, sizes: np.ndarray, label: np.ndarray,
               side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different label whose bound allows a link (indexes into the input).

    With ``side``, only pairs of different sides.
    """
    order = np.argsort(sizes, kind="stable")
    p, n, c = points[order], sizes[order], label[order]
    d = np.arange(len(order)) if side is None else side[order]
    cut, upper, least = boxes(p, n)
    left, right = [], []
    for i in range(len(upper)):
        most = bound(upper[i][None, :], upper[i:])
        for j in (i + np.flatnonzero(linked(most, least[i], least[i:]))).tolist():
            a, b = slice(cut[i], cut[i + 1]), slice(cut[j], cut[j + 1])
            x, y = np.nonzero((c[a][:, None] != c[b][None, :]) & (d[a][:, None] != d[b][None, :])
                              & linked(np.minimum(n[a][:, None], n[b][None, :]), n[a][:, None], n[b][None, :]))
            x, y = x + cut[i], y + cut[j]
            if i == j:
                x, y = x[x < y], y[x < y]
            good = linked(bound(p[x], p[y]), n[x], n[y])
            left.append(order[x[good]])
            right.append(order[y[good]])
    z = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (z, z)


_PAIR = "a long, b long, na long, nb long, la long, lb long, common long"


def _cell_pairs(rows: DataFrame) -> DataFrame:
    """Candidate pairs of the cells in ``rows`` and in how many cells they were seen.

    Columns cell, low, high, own, uid, label, n, last, point; ``low``/``high`` number
    the two blocks joined and ``own`` the row's; rows come sorted by cell and blocks.
    """
    hold = 16_384

    def pairs(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            batch = pa.Table.from_batches(held).combine_chunks()
            cell, low, high, own, uid, label, n, last = (batch.column(i).to_numpy() for i in range(8))
            points = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint8).reshape(-1, GROUPS)
            cut = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            a, b = [], []
            for at, end in zip(cut.tolist(), [*cut[1:].tolist(), len(cell)], strict=True):
                s = slice(at, end)
                if end - at > 1 and (label[s] != label[at]).any():
                    x, y = tree_pairs(points[s], n[s], label[s], own[s] if low[at] != high[at] else None)
                    a.append(x + at)
                    b.append(y + at)
            if not a:
                return
            a, b = np.concatenate(a), np.concatenate(b)
            turn = uid[a] > uid[b]
            a, b = np.where(turn, b, a), np.where(turn, a, b)
            order = np.lexsort((uid[b], uid[a]))
            a, b = a[order], b[order]
            head = np.flatnonzero(np.r_[True, (uid[a][1:] != uid[a][:-1]) | (uid[b][1:] != uid[b][:-1])] if len(a) else [])
            seen = np.diff(np.r_[head, len(a)])
            a, b = a[head], b[head]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (uid[a], uid[b], n[a], n[b], last[a], last[b], seen)],
                names=["a", "b", "na", "nb", "la", "lb", "common"])

        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, hold)
                if held and size >= hold:                # go on to the end of the open cell
                    end = held[-1]
                    same = np.ones(piece.num_rows, bool)
                    for k in range(3):
                        same &= piece.column(k).to_numpy() == end.column(k)[-1].as_py()
                    lead = len(same) if same.all() else int(np.argmin(same))
                    if lead < len(same):
                        if lead:
                            held.append(piece.slice(0, lead))
                        yield from flush()
                        held, size = [], 0
                        at += lead
                        continue
                held.append(piece)
                size += piece.num_rows
                at += piece.num_rows
        if held:
            yield from flush()
            held.clear()
        release_memory()

    return rows.mapInArrow(pairs, _PAIR)


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rk, n, class id ``uid``) per row, and spanning links (a, b) of classes."""
    texts = keyed(docs)
    levels = _levels(_sketch(texts))
    sets = stage(_sets(texts, levels).withColumn("uid", F.monotonically_increasing_id()), "jaccard-sets")
    same = ["sig1", "sig2", "n"]
    classes = sets.groupBy(*same).agg(F.min("uid").alias("uid"), F.count("*").alias("copies"))
    classes = stage(classes, "jaccard-classes")
    member = stage(sets.select("doc_id", "rk", *same)
                   .join(classes.select(*same, "uid"), same).select("doc_id", "rk", "n", "uid"), "jaccard-member")
    # rows of a class beyond its first; written, so that their size is known to the joins
    copies = stage(sets.select(*same, F.col("uid").alias("other")).join(classes.where("copies > 1"), same)
                   .where("uid != other").select(F.col("other").alias("uid")), "jaccard-copies")
    heads = sets.where("n > 0").join(copies, "uid", "left_anti")
    rows = heads.select("uid", F.explode("prefix").alias("cell"))
    shared = stage(rows.groupBy(F.col("cell").alias("_cell")).agg(F.count("*").alias("df")).where("df > 1"),
                   "jaccard-shared")
    cells = stage(rows.join(shared, F.col("cell") == F.col("_cell")).select("cell", "uid", "df"), "jaccard-cells")
    unstage(shared)
    info = stage(heads.join(cells.groupBy("uid").agg(F.count("*").alias("held")), "uid")
                 .select("uid", "doc_id", "rk", "n", "last", "point", (F.col("held") / F.size("prefix")).alias("share")),
                 "jaccard-info")
    unstage(sets, classes, copies)
    # hubs: the member with most of its prefix shared
    ranked = cells.join(info.select("uid", "share", F.col("n").alias("size")), "uid")
    hub = (ranked.groupBy(F.col("cell").alias("_cell"))
           .agg(F.max(F.struct("share", (-F.col("uid")).alias("u"), "size")).alias("top")))
    stars = (ranked.join(hub, F.col("cell") == F.col("_cell"))
             .select(F.col("uid").alias("a"), (-F.col("top.u")).alias("b"), F.col("size").alias("na"),
                     F.col("top.size").alias("nb"))
             .where((F.col("a") != F.col("b")) & linked(F.least("na", "nb"), F.col("na"), F.col("nb")))
             .select("a", "b").distinct())
    # both directions of a pair are one test
    stars = stage(stars.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
                  .agg(F.max_by("b", "b").alias("b"))
                  .select(F.when(F.col("b") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("a"), "b"),
                  "jaccard-stars")
    whom = info.select("uid", F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"))
    packed = _texts_of(stars, texts, whom)
    found = stage(verify(stars, packed), "jaccard-links")
    unstage(packed)
    parted = components(found, "a", "b", "jaccard-parts")
    label = parted.withColumnRenamed("id", "_uid")
    labelled = (cells.join(label, F.col("uid") == F.col("_uid"), "left")
                .select("cell", "uid", "df", F.coalesce("component_id", "uid").alias("label")))
    labelled = stage(labelled, "jaccard-labelled")
    unstage(cells, found)
    mixed = (labelled.groupBy(F.col("cell").alias("_cell"))
             .agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi"))
    open_cells = labelled.join(mixed, F.col("cell") == F.col("_cell")).select("cell", "uid", "label", "df")
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("uid"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = (open_cells.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other)
              .join(info.select("uid", "n", "last", "point"), "uid")
              .select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own",
                      "uid", "label", "n", "last", "point")
              .repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high"))
    # All shingles that two prefixes share up to the end of the one that ends first
    # were seen; beyond it, the set of that one has only n - prefix length more.
    ends_first = [F.col(f"n{x}") - F.expr(f"n{x} - ceil({LINK[0]} * n{x} / {LINK[1]}) + 1") for x in "ab"]
    beyond = (F.when(F.col("la") < F.col("lb"), ends_first[0]).when(F.col("lb") < F.col("la"), ends_first[1])
              .otherwise(F.greatest(*ends_first)))
    rest = (_cell_pairs(placed).groupBy("a", "b", "na", "nb", "la", "lb").agg(F.sum("common").alias("common"))
            .where(linked(F.col("common") + beyond, F.col("na"), F.col("nb"))).select("a", "b"))
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stage(rest.join(tested, ["a", "b"], "left_anti"), "jaccard-rest")
    unstage(labelled, stars)
    packed = _texts_of(rest, texts, whom)
    more = verify(rest, packed).distinct()
    parts = label.select(F.col("_uid").alias("a"), F.col("component_id").alias("b")).where("a != b")
    edges = stage(parts.unionAll(more), "jaccard-all-links")
    unstage(packed, rest, info, parted)
    return member, edges


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, rk, n_shingles, component_id and a flag for the one row kept of each component."""
    member, edges = join(docs)
    parts = components(edges, "a", "b", "jaccard-components")
    label = parts.withColumnRenamed("id", "_uid")
    rows = stage(member.join(label, F.col("uid") == F.col("_uid"), "left")
                 .select("doc_id", "rk", F.col("n").alias("n_shingles"),
                         F.coalesce("component_id", "uid").alias("root")), "jaccard-members")
    unstage(member, edges, parts)
    # written, so that the join reads two plain shuffles and AQE can split a large component
    least = stage(rows.where("n_shingles > 0").groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("low")),
                  "jaccard-least")
    return (rows.join(least, (F.col("root") == F.col("_root")) & (F.col("n_shingles") > 0), "left")
            .select("doc_id", "rk", "n_shingles", F.coalesce("low", "doc_id").alias("component_id")))


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("rk")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component (that of the smallest doc_id), all columns kept.

    Documents with an empty set all stay; of rows that repeat both doc_id and text
    one stays.
    """
    member, edges = join(docs)
    parts = components(edges, "a", "b", "jaccard-components")
    label = parts.withColumnRenamed("id", "_uid")
    rows = (member.where("n > 0").join(label, F.col("uid") == F.col("_uid"), "left")
            .select(F.coalesce("component_id", "uid").alias("root"),
                    F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rk").alias("row")))
    rows = stage(rows.groupBy("root", "row").agg(F.count("*").alias("times")), "jaccard-rows")
    unstage(member, edges, parts)
    # written, so that the joins read two plain shuffles and AQE can split a large component
    first = stage(rows.groupBy("root").agg(F.min("row").alias("kept")), "jaccard-first")
    drop = (rows.join(first, "root").where("row != kept")
            .select(F.col("row.doc_id").alias("_id"), F.col("row.rk").alias("_rk")))
    again = (rows.join(first, "root").where("row = kept AND times > 1")
             .select(F.col("row.doc_id").alias("_id"), F.col("row.rk").alias("_rk")))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_rk"))
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), key.alias("_key"))
    left = own.join(drop, same, "left_anti")
    if again.isEmpty():
        return left.select("_row.*")
    once = left.join(again, same, "left_semi").dropDuplicates(["_doc", "_key"])
    return left.join(again, same, "left_anti").unionAll(once).select("_row.*")


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2),
         lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
  FROM docs WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
overlap AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
link AS (
  SELECT a, b FROM overlap o JOIN sizes x ON o.a = x.doc_id JOIN sizes y ON o.b = y.doc_id
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS id, a AS other FROM edge UNION SELECT r.id, e.b FROM reach r JOIN edge e ON r.other = e.a),
part AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN part ON part.id = d.doc_id
"""
