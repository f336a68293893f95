"""Embedding near-dedup: exact metric range join over pivot cells.

Cosine >= t is an angle of at most ``arccos(t)``, and angles between directions
obey the triangle inequality. Pivots (vectors drawn by hash order) cut the
sphere into cells; a vector's home is the nearest pivot. With ``r`` the largest
angle of a cell's own vectors to its pivot, a vector can link into a cell only
if its angle to that pivot is at most ``r + arccos(t)`` and at most its own home
angle plus ``2 arccos(t)``; it visits exactly those cells. Each cell then joins
alone: own vectors against all visitors, so every ordered pair is seen once, in
the cell of its first vector.

Cells with many own vectors are cut into blocks of ``block_rows``; a task holds
one block and streams the visitors past it, so no group is collected. Equal
vectors are one class with a multiplicity before the join. A block returns link
counts and a spanning forest of its links, never the pairs. Linking is tested in
single precision with a margin and decided in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths never link; rows that
repeat a vec_id are compared as separate vectors; an empty table gives no rows;
labels and extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import components, stage

MARGIN = 1e-4                  # single-precision guard around the threshold
ANGLE_SLACK = 1e-6             # rounding guard of the cell bounds
_PLACED = "cell long, block int, visitor boolean, id long, mult long, vec array<double>"
_FOUND = "id long, linked long, a long, b long"


def _matrix(column) -> np.ndarray:
    """(rows x dim) of a list column whose rows have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def _slices(batches, rows: int = 512):
    """Batches of at most ``rows`` rows: an angle matrix has that many rows and one column per pivot."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _by_dim(batch: pa.RecordBatch, column: int):
    sizes = np.asarray(batch.column(column).value_lengths())
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        part = batch.take(pa.array(rows))
        yield int(d), part, _matrix(part.column(column))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)        # no overflow of squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(v) @ pivots.T, -1.0, 1.0))


class _Forest:
    """Components of a block's own rows, merged from rows linked by one visitor."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:                                  # pointer jumping to the roots
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


class _CellBlock:
    """Own rows of one (cell, block), and what the visitors found so far."""

    def __init__(self):
        self.ids, self.mults, self.vecs = [], [], []
        self.ready = False

    def add(self, ids, mults, vecs):
        self.ids.append(ids)
        self.mults.append(mults)
        self.vecs.append(vecs)

    def close(self):
        self.id = np.concatenate(self.ids)
        self.mult = np.concatenate(self.mults)
        self.vec = _unit(np.concatenate(self.vecs))
        self.low = self.vec.astype(np.float32)
        self.linked = self.mult - 1
        self.forest = _Forest(len(self.id))
        self.ready = True

    def visit(self, ids, mults, vecs, threshold: float, step: int = 1024):
        """Yield (visitor, own) links, one per linked visitor."""
        for at in range(0, len(ids), step):
            v = _unit(vecs[at:at + step])
            vid, vm = ids[at:at + step], mults[at:at + step]
            near = (self.low @ v.astype(np.float32).T) >= np.float32(threshold - MARGIN)
            own, other = np.nonzero(near)
            keep = np.zeros(len(own), bool)
            for p in range(0, len(own), 1 << 17):        # decide in double precision
                o, w = own[p:p + (1 << 17)], other[p:p + (1 << 17)]
                keep[p:p + (1 << 17)] = ((np.einsum("ij,ij->i", self.vec[o], v[w]) >= threshold)
                                         & (self.id[o] != vid[w]))
            own, other = own[keep], other[keep]
            if not len(own):
                continue
            np.add.at(self.linked, own, vm[other])
            order = np.argsort(other, kind="stable")
            own, other = own[order], other[order]
            head = np.flatnonzero(np.r_[True, other[1:] != other[:-1]])
            lead = np.repeat(own[head], np.diff(np.r_[head, len(own)]))
            self.forest.merge(own, lead)
            yield vid[other[head]], self.id[own[head]]

    def results(self):
        yield pa.table({"id": pa.array(self.id), "linked": pa.array(self.linked.astype(np.int64)),
                        "a": pa.array(self.id), "b": pa.array(self.id[self.forest.label])}).to_batches()[0]


def links(vectors: DataFrame, threshold: float = 0.9, cell_rows: int = 4096, max_pivots: int = 4096,
          block_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(id, n_links) per class and spanning links (a, b).

    ``vectors`` has columns ``id`` (unique), ``mult`` and ``vec`` (finite, not
    zero). ``cell_rows`` sets the number of pivots (at most ``max_pivots``, a
    bounded broadcast); it changes the speed, never the result.
    """
    reach = math.acos(threshold) + ANGLE_SLACK
    n = vectors.count()
    k = max(1, min(max_pivots, -(-n // cell_rows)))
    drawn = [r["vec"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(k).select("vec").collect()]
    # every length that occurs needs a pivot (lengths: a handful of model sizes)
    have = {len(p) for p in drawn}
    for r in vectors.groupBy(F.size("vec").alias("d")).agg(F.min_by("vec", "id").alias("vec")).collect():
        if r["d"] not in have:
            drawn.append(r["vec"])
    lengths = np.array([len(p) for p in drawn])
    pivots = {int(d): (np.flatnonzero(lengths == d),
                       _unit(np.array([drawn[i] for i in np.flatnonzero(lengths == d)], np.float64)))
              for d in np.unique(lengths)}

    def homes(batches):
        for batch in _slices(batches):
            for d, part, m in _by_dim(batch, 2):
                cells, p = pivots[d]
                angle = _angles(m, p)
                home = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[home]), pa.array(angle[np.arange(len(m)), home])], names=["cell", "angle"])

    own = vectors.select("id", "mult", "vec")
    stats = {r["cell"]: (r["r"], r["n"]) for r in own.mapInArrow(homes, "cell long, angle double")
             .groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()}
    radius = np.array([stats.get(c, (-10.0, 0))[0] for c in range(len(drawn))])
    blocks = np.array([max(1, -(-stats.get(c, (0, 0))[1] // block_rows)) for c in range(len(drawn))])

    def place(batches):
        for batch in _slices(batches):
            for d, part, m in _by_dim(batch, 2):
                cells, p = pivots[d]
                angle = _angles(m, p)
                home = angle.argmin(axis=1)
                at_home = angle[np.arange(len(m)), home]
                r = np.arange(len(m))
                ids = np.asarray(part.column(0))
                cell = cells[home]
                block = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[cell]
                visits = angle <= np.minimum(radius[cells][None, :], at_home[:, None] + reach) + reach
                row, col = np.nonzero(visits)
                times = blocks[cells[col]]
                row, col = np.repeat(row, times), np.repeat(col, times)
                turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                for take, c, b, visitor in ((r, cell, block, False), (row, cells[col], turn, True)):
                    for s in range(0, len(take), 8192):
                        t = part.take(pa.array(take[s:s + 8192]))
                        size = t.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c[s:s + size].astype(np.int64)), pa.array(b[s:s + size].astype(np.int32)),
                             pa.array([visitor] * size), t.column(0), t.column(1), t.column(2)],
                            names=["cell", "block", "visitor", "id", "mult", "vec"])

    def join(batches):
        now, held = None, None
        for batch in batches:
            cell, block = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            kind = batch.column(2).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])
                                       | (kind[1:] != kind[:-1])])
            for a, b in zip(cut, np.r_[cut[1:], len(cell)], strict=True):
                if (cell[a], block[a]) != now:
                    if held is not None and held.ready:
                        yield from held.results()
                    now, held = (cell[a], block[a]), _CellBlock()
                part = batch.slice(a, b - a)
                ids, mults = np.asarray(part.column(3)), np.asarray(part.column(4))
                vecs = _matrix(part.column(5))
                if not kind[a]:
                    held.add(ids, mults, vecs)
                    continue
                if not held.ready:
                    if not held.ids:                     # a block without own rows
                        continue
                    held.close()
                for x, y in held.visit(ids, mults, vecs, threshold):
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int64()), pa.array(x), pa.array(y)],
                        names=["id", "linked", "a", "b"])
        if held is not None and held.ready:
            yield from held.results()

    placed = (own.mapInArrow(place, _PLACED).repartition("cell", "block")
              .sortWithinPartitions("cell", "block", "visitor"))
    found = stage(placed.mapInArrow(join, _FOUND), "vector-links")
    return (found.where("id IS NOT NULL").select("id", F.col("linked").alias("n_links")),
            found.where("a != b").select("a", "b"))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``embeddings``."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.coalesce((F.size("embedding") > 0)
                       & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                       & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one component value
    rows = stage(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                                   F.when(sound, F.transform(vec, lambda x: x + F.lit(0.0))).alias("vec"))
                 .withColumn("uid", F.monotonically_increasing_id()), "vectors")
    good = rows.where("vec IS NOT NULL")
    classes = stage(good.groupBy("vec").agg(F.min("uid").alias("id"), F.count("*").alias("mult"),
                                            F.min("vec_id").alias("low")), "vector-classes")
    counted, edges = links(classes.select("id", "mult", "vec"), threshold, **options)
    labels = components(edges, "a", "b", "vector-components")
    # smallest vec_id of a component, over its classes
    member = (classes.select("id", "vec", "low").join(counted, "id")
              .join(labels, "id", "left").withColumn("root", F.coalesce("component_id", "id")))
    least = member.groupBy("root").agg(F.min("low").alias("component"))
    member = (member.join(least, "root")
              .select(F.col("vec").alias("_vec"), "n_links", "component"))
    out = rows.join(member, F.col("vec") == F.col("_vec"), "left")
    component = F.when(F.coalesce("n_links", F.lit(0)) > 0, F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def report(embeddings: DataFrame, **options) -> DataFrame:
    return near_duplicates(embeddings, **options)


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (
  SELECT a AS id, a AS other FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a),
part AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, v.vec_id) AS component_id,
       v.vec_id = coalesce(component_id, v.vec_id) AS kept
FROM v LEFT JOIN part ON v.vec_id = part.id LEFT JOIN degree ON v.vec_id = degree.id
"""
