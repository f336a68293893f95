"""Token counts by scanning flat, unindexed token files for separators.

A stream is a sequence of little-endian uint16 values with nothing around it: value 0 ends
a document, ``id + 1`` is token ``id``, and six control values in the reserved range above
the vocabulary spell the doc_id at the start of each document. Every write task makes one
stream and cuts it into files of ``BLOCK_BYTES``, wherever that falls: a document may
span files. Spark's own text writer makes the files (its record separator is one more end
value at the end of a file), so they live in any store that Spark writes.

The scan takes one file as a task's unit of work, however long the documents are. It finds
the separators of a block with vectorised comparisons, counts the documents that lie inside
the block, and hands on the lengths of its open ends: what comes before the first and
after the last separator. A prefix scan over the blocks of a stream (two short rows per
block) numbers the documents that cross borders, and their open lengths add up. No index, no
shuffle of text or tokens.

Defined results: null and empty texts count 0 tokens; repeated rows are counted
each; a null doc_id comes back as null; an empty table gives no rows; extra columns are
ignored; a text of any length is cut like the others. The end marker's string inside a text
is ordinary text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import keyed, release_memory, stage, staging_path
from larder.llm.tokens import TOKENIZER, encoded_texts, encoder

BLOCK_VALUES = 1 << 20
BLOCK_BYTES = 8 << 20          # of a file; even
CONTROL, DIGITS, RADIX = 51_200, 6, 12       # doc_id + 2^63 in six 12-bit digits; all ones: null
END = 0


def _id_values(doc_ids: list) -> np.ndarray:
    """(rows x DIGITS) control values of the ids; null is a digit run beyond 64 bits."""
    out = np.full((len(doc_ids), DIGITS), CONTROL + (1 << RADIX) - 1, np.uint16)
    real = [i for i, d in enumerate(doc_ids) if d is not None]
    value = np.array([doc_ids[i] + (1 << 63) for i in real], np.uint64)
    for k in range(DIGITS):
        digit = (value >> np.uint64(RADIX * (DIGITS - 1 - k))) & np.uint64((1 << RADIX) - 1)
        out[real, k] = digit.astype(np.uint16) + np.uint16(CONTROL)
    return out


def _ids_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    digits = values.astype(np.int64) - CONTROL
    null = digits[:, 0] == (1 << RADIX) - 1           # a 64-bit id has at most 4 bits here
    total = np.zeros(len(digits), np.uint64)
    for k in range(DIGITS):
        total = (total << np.uint64(RADIX)) | digits[:, k].astype(np.uint64)
    return (total ^ np.uint64(1 << 63)).view(np.int64), null


def write_flat(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, block_bytes: int = BLOCK_BYTES) -> None:
    """Encode every text into flat token files of ``block_bytes`` under ``path``."""
    schema = pa.schema([("record", pa.binary())])

    def encode(batches):
        code, stream = encoder(tokenizer, False), bytearray()
        for batch in batches:
            heads = _id_values(batch.column(0).to_pylist())
            for row, ids in encoded_texts(batch, "text", code):
                stream += heads[row].tobytes()
                stream += (np.frombuffer(ids, "<u4") + 1).astype("<u2").tobytes()
                stream += b"\0\0"
                while len(stream) >= block_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(stream[:block_bytes])], pa.binary())], schema=schema)
                    del stream[:block_bytes]
        if stream:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(stream)], pa.binary())], schema=schema)
        release_memory()

    (keyed(docs).select("doc_id", "text").mapInArrow(encode, "record binary")
     .select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\0\0").option("maxRecordsPerFile", 1).text(path))


def separators(values: np.ndarray, end: int = END, block: int = BLOCK_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every document of a stream, by blocks."""
    found = [np.flatnonzero(values[a:a + block] == end) for a in range(0, len(values), block)]
    counts = np.array([len(f) for f in found], np.int64)
    ordinal = np.cumsum(counts) - counts                     # prefix scan: documents ended before a block
    stops = np.empty(int(counts.sum()), np.int64)
    for i, f in enumerate(found):
        stops[ordinal[i]:ordinal[i] + len(f)] = f + i * block
    starts = np.zeros(len(stops), np.int64)
    starts[1:] = stops[:-1] + 1                              # also across block borders
    return starts, stops


NAME = re.compile(r"part-(\d+)-.*-c(\d+)")       # stream and block of a file of the writer
DOCUMENT, LEAD, TAIL = 0, 1, 2
_SCAN = pa.schema([("stream", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()),
                   ("start", pa.int64()), ("n", pa.int64()), ("head", pa.list_(pa.int32())), ("ends", pa.bool_())])
_SCAN_SQL = "stream long, block long, kind int, place long, doc_id long, start long, n long, head array<int>, ends boolean"


def _scan(name: str, values: np.ndarray):
    """The whole documents of a block, and its open ends."""
    stream, block = (int(x) for x in NAME.search(name).groups())
    start, stop = separators(values)
    inside = len(start) - 1
    if inside > 0:
        ids, null = _ids_of(values[start[1:, None] + np.arange(DIGITS)])
        none = pa.nulls(inside, _SCAN.field("head").type)
        yield pa.RecordBatch.from_arrays(
            [pa.array([stream] * inside), pa.array([block] * inside), pa.array([DOCUMENT] * inside, pa.int32()), pa.array(np.arange(1, inside + 1)),
             pa.array(ids, mask=null), pa.array(start[1:]), pa.array(stop[1:] - start[1:]), none, pa.array([True] * inside)], schema=_SCAN)
    ends = [(LEAD, 0, int(stop[0]) if len(stop) else len(values), len(stop) > 0)]
    if len(stop) and stop[-1] + 1 < len(values):
        ends.append((TAIL, int(stop[-1]) + 1, len(values), False))
    for kind, a, b, closed in ends:
        row = [stream, block, kind, 0, None, a, b - a, values[a:min(a + DIGITS, b)].tolist(), closed]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SCAN, strict=True)], schema=_SCAN)


def count_tokens(spark: SparkSession, path: str) -> DataFrame:
    """stream, block, place (number of its end separator in that block), doc_id, n_tokens."""

    def scan(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                data = batch.column(1)[r].as_buffer()
                if data.size > 2:                           # the last value is the writer's
                    yield from _scan(batch.column(0)[r].as_py().rsplit("/", 1)[-1], np.frombuffer(data, "<u2")[:-1])
        release_memory()

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = stage(files.mapInArrow(scan, _SCAN_SQL), "token-scan")
    whole = found.where(F.col("kind") == DOCUMENT).select("stream", "block", "place", "doc_id", (F.col("n") - DIGITS).alias("n_tokens"))
    # a document ends with the first lead that holds a separator: the leads closed before give its number
    order = Window.partitionBy("stream").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, -1)
    ends = found.where(F.col("kind") != DOCUMENT).withColumn("number", F.coalesce(F.sum(F.col("ends").cast("long")).over(order), F.lit(0)))
    heads = F.array_sort(F.collect_list(F.struct("block", "kind", "head")))
    crossing = ends.groupBy("stream", "number").agg(F.max("block").alias("block"), F.sum("n").alias("n"),
                                                    F.slice(F.flatten(F.transform(heads, lambda x: x["head"])), 1, DIGITS).alias("head"))

    def identify(batches):
        for batch in batches:
            if batch.num_rows:
                ids, null = _ids_of(np.array(batch.column(3).to_pylist(), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.zeros(batch.num_rows, np.int64)),
                                                  pa.array(ids, mask=null), batch.column(2)], names=["stream", "block", "place", "doc_id", "n_tokens"])

    crossed = crossing.select("stream", "block", (F.col("n") - DIGITS).alias("n_tokens"), "head").mapInArrow(
        identify, "stream long, block long, place long, doc_id long, n_tokens long")
    return whole.unionByName(crossed)


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document of ``docs``: its number of tokens, from flat files."""
    spark = docs.sparkSession
    path = staging_path(spark, "flat-tokens")
    write_flat(docs, path, **options)
    return count_tokens(spark, path).select("doc_id", "n_tokens")
