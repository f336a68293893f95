"""Sorted runs of rows: sequences of any length without one task per sequence.

``sorted_rows`` range-partitions rows by a key and an order inside it, so one key
may span many partitions. A key that starts and ends inside a partition is whole
there; only the first and last key of a partition can go on elsewhere, and the
operators treat those pieces apart.

``sha256_runs`` is the digest of the rows of each key in order. A digest has to read
its bytes one after the other, so a key that spans partitions is joined from packed
pieces, in order, by a stream that holds one piece at a time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import release_memory, small_batches, stage

PACKED_BYTES = 1 << 18         # text of one packed piece


def sorted_rows(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Rows in ascending order (nulls first), dealt into ranges."""
    small_batches(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)


def rows_of(batches, *names):
    """Tuples of the named columns, batch after batch."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
    release_memory()


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def batches_of(rows, schema: pa.Schema, size: int = 500):
    """Arrow batches of an iterator of tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield as_batch(held, schema)
            held = []
    if held:
        yield as_batch(held, schema)


def sha256_runs(df: DataFrame, keys: list[str], order: list[str], payload: str, separator: str = ",") -> DataFrame:
    """``keys`` (longs, no nulls) and ``sha256``: of each key's payloads, joined in order."""
    sep = separator.encode()

    def pack(batches):
        part, seq, key, held, size, first, pieces = TaskContext.get().partitionId(), 0, None, [], 0, True, 0

        def close(last):
            nonlocal seq, pieces
            data = sep.join(held)
            whole = not (first or last or pieces)
            seq, pieces = seq + 1, pieces + 1
            return (*key, part, seq, hashlib.sha256(data).hexdigest() if whole else None, None if whole else data)

        for *now, value in rows_of(batches, *keys, payload):
            if key is not None and now != key:
                yield close(False)
                held, size, first, pieces = [], 0, False, 0
            elif size > PACKED_BYTES:
                pieces += 1                 # never whole
                yield close(False)
                held, size = [], 0
            key = now
            held.append(value.encode())
            size += len(held[-1]) + 1
        if key is not None:
            yield close(True)

    schema = pa.schema([(c, pa.int64()) for c in keys] + [("part", pa.int32()), ("seq", pa.int32()),
                                                         ("sha256", pa.string()), ("data", pa.binary())])
    names = ", ".join(f"{c} long" for c in keys)
    pieces = stage(sorted_rows(df.select(*keys, *order, payload), keys, order).mapInArrow(
        lambda batches: batches_of(pack(batches), schema, 200), f"{names}, part int, seq int, sha256 string, data binary"), "digest-runs")

    def join(batches):
        key, state = None, None
        for *now, data in rows_of(batches, *keys, "data"):
            if now != key:
                if key is not None:
                    yield (*key, state.hexdigest())
                key, state = now, hashlib.sha256(data)
            else:
                state.update(sep + data)
        if key is not None:
            yield (*key, state.hexdigest())

    out = pa.schema([(c, pa.int64()) for c in keys] + [("sha256", pa.string())])
    split = (pieces.where("sha256 IS NULL").repartition(*keys).sortWithinPartitions(*keys, "part", "seq")
             .mapInArrow(lambda batches: batches_of(join(batches), out), f"{names}, sha256 string"))
    done = pieces.where("sha256 IS NOT NULL").select(*keys, "sha256").unionAll(split)
    done.staged_path = pieces.staged_path
    return done
