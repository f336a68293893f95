"""Helpers shared by the training-data operators.

* ``documents_of`` / ``keyed``: one schema for every text operator, with a row
  key that tells rows sharing a ``doc_id`` (or having none) apart.
* ``text_blocks``: Arrow batches cut into byte blocks of whole texts, so the
  numpy work of a task holds a bounded piece of the input.
* ``word_spans`` / ``span_hashes``: vectorised words and 64-bit hashes of any
  byte range (polynomial prefix sums modulo 2^64, then a bit mixer).
* ``stage``: a table written to the shared checkpoint folder and read back;
  it cuts lineage, survives lost executors and gives AQE real sizes.
* ``small_batches``: bounds what a Python worker is handed at once.
* ``components``: connected components by alternating star contraction.
* ``running_sum``: a prefix sum over a total order without a single-task window.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.session import checkpoint_dir
from larder.sources.tables import read_table

BLOCK_BYTES = 1 << 19          # numpy work unit of a task
ARROW_ROWS = 1000              # whole texts handed to a Python worker at once
ARROW_BYTES = 8 << 20
NO_ID = -(1 << 63)             # stands for a null doc_id inside row keys


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """``(doc_id, rk, text, *extra)``; a null text is empty, ``rk`` hashes (id, text).

    Rows that repeat both id and text share ``rk`` and get equal results.
    """
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("rk"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``ARROW_ROWS`` rows and ``ARROW_BYTES`` bytes.

    The default of 10,000 rows holds that many whole texts at once in the executor's
    direct memory and in its Python workers. Smaller settings of the user stay.
    """
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def release_memory() -> None:
    """Give freed memory of a Python worker back; the worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:       # a C library without it
        pass


# ------------------------------------------------------------ staged tables

_STAGED: list[tuple[SparkSession, str]] = []


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, removed at exit."""
    path = f"{checkpoint_dir(spark)}/larder-{name}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(_drop_staged)
    _STAGED.append((spark, path))
    return path


def _drop_staged() -> None:
    for spark, path in _STAGED:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session is gone: nothing left to ask
            return


def drop_staged(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The write's own shuffle files are dropped as soon as it ends.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def unstage(*staged: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in staged:
        drop_staged(table.sparkSession, table.staged_path)


# ------------------------------------------------------------ bytes and hashes

_MUL = 0x9E3779B97F4A7C15 | 1   # odd: invertible modulo 2^64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer over uint64 (in a new array)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=2)
def _powers(size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    base = (_MUL + 2 * salt * 0x1000193) & ((1 << 64) - 1)
    inverse = pow(base, -1, 1 << 64)

    def run(b):
        out = np.empty(size, np.uint64)
        out[0] = 1
        have = 1
        while have < size:                       # doubling: p[i + n] = p[i] * b^n
            step = np.uint64(pow(b, have, 1 << 64))
            more = min(have, size - have)
            out[have:have + more] = out[:more] * step
            have += more
        return out

    return run(base), run(inverse)


@functools.lru_cache(maxsize=8)
def _byte_codes(fold: bool, salt: int) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold:
        codes[65:91] += np.uint64(32)
    return mix64((codes + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
                 + np.uint64(salt * 77 + 1)) | np.uint64(1)


class RangeHash:
    """64-bit hashes of byte ranges of one buffer; equal bytes, equal hash.

    ``fold`` hashes A-Z as a-z. Distinct ``salt`` values give independent hashes.
    """

    def __init__(self, data: np.ndarray, fold: bool = False, salt: int = 0):
        size = max(1 << 16, 1 << int(len(data) + 1).bit_length())
        power, self._inverse = _powers(size, salt)
        self._prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_codes(fold, salt)[data] * power[:len(data)], out=self._prefix[1:])

    def __call__(self, start, end) -> np.ndarray:
        raw = (self._prefix[end] - self._prefix[start]) * self._inverse[start]
        return mix64(raw + np.asarray(end - start).astype(np.uint64) * np.uint64(_MUL))

    def sliding(self, width: int) -> np.ndarray:
        """Hashes of every range of ``width`` bytes."""
        n = len(self._prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = (self._prefix[width:] - self._prefix[:n]) * self._inverse[:n]
        return mix64(raw + np.uint64((width * _MUL) & ((1 << 64) - 1)))


class Block:
    """Whole texts, back to back: bytes, offsets and the rows they came from."""

    __slots__ = ("rows", "data", "offsets")

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def owner(self, position: np.ndarray) -> np.ndarray:
        """Row index of each byte position."""
        return np.searchsorted(self.offsets, position, side="right") - 1

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(self.rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def text_blocks(batches, column: str = "text", limit: int = BLOCK_BYTES, release: bool = True):
    """Cut the Arrow batches of a task into blocks of whole texts of about ``limit`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        if not pa.types.is_large_string(texts.type) and not pa.types.is_large_binary(texts.type):
            texts = texts.cast(pa.large_binary()) if pa.types.is_binary(texts.type) else texts.cast(pa.large_string())
        _, raw_offsets, raw = texts.buffers()
        offsets = np.frombuffer(raw_offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), len(texts))
            yield Block(batch.slice(at, end - at), whole[offsets[at]:offsets[end]],
                        offsets[at:end + 1] - offsets[at])
            at = end
    if release:
        release_memory()


def byte_class(pairs: list[tuple[int, int]]) -> np.ndarray:
    """Lookup table of a byte class given as inclusive ranges."""
    table = np.zeros(256, bool)
    for a, b in pairs:
        table[a:b + 1] = True
    return table


def word_spans(block: Block, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owning row of the maximal runs of ``word_bytes``."""
    inside = word_bytes[block.data]
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, block.owner(starts)


def gram_hashes(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words of one text, and its first word index."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(owner[:n] == owner[width - 1:])
    out = np.full(len(first), width, np.uint64)
    for j in range(width):
        out *= np.uint64(_MUL)
        out += words[first + j]
    return mix64(out), first


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


# ------------------------------------------------------------ graph and order

def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """Connected components of the links ``(a, b)``: rows ``(id, component_id)``.

    Alternating star contraction: every node hands its larger neighbours to its
    smallest one, then its smaller ones to the smallest. Each round is two
    aggregations with map-side minima and two equi joins against a side that
    has one row per node; rounds grow with the logarithm of the diameter. Only
    nodes with a link appear. Nothing but a row count and checksum per round
    reaches the driver. The result is read from a staged table, which ``unstage``
    of the result removes.
    """
    e = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
              .where("u > v").distinct(), name)
    before = None
    while True:
        low = (e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
               .groupBy(F.col("u").alias("x")).agg(F.min("v").alias("low"))
               .select("x", F.least("x", "low").alias("low")))
        large = (e.join(low, F.col("v") == F.col("x"))
                 .select("u", F.col("low").alias("v")).where("u > v").distinct())
        first = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("low"))
        small = large.join(first, F.col("u") == F.col("x"))
        last = e
        e = stage(small.select(F.explode(F.array(
            F.struct(F.col("u"), F.col("low").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("s"))
            .select("s.u", "s.v").where("u > v").distinct(), name)
        unstage(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    label = e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionAll(roots)
    label.staged_path = e.staged_path
    return label


def running_sum(df: DataFrame, group: list[str], order: list, value: str, slot, out: str) -> DataFrame:
    """``out`` = sum of ``value`` up to and with this row, within ``group`` by ``order``.

    ``slot`` must not decrease along the order; it cuts a group into pieces that
    are summed by separate tasks. The sums of the pieces (one row per group and
    slot) are combined first and their own running sum is joined back, so a
    group holding most rows is not ordered by one task.
    """
    df = df.withColumn("_slot", slot)
    keys = [*group, "_slot"]
    pieces = df.groupBy(*keys).agg(F.sum(value).alias("_piece"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    base = pieces.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(F.sum("_piece").over(
        over.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cond = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return (df.withColumn("_own", F.sum(value).over(within)).join(base, cond)
            .withColumn(out, F.col("_own") + F.col("_base"))
            .drop("_own", "_base", "_slot", *[f"_{k}" for k in keys]))
