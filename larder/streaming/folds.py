"""Structured Streaming forms of the event folds.

Each fold keeps a small per-key state (``applyInPandasWithState``), so a
key's whole history is never buffered: the K6 state is one entry per
supplier of an order, the K2 state one balance per buyer. Outputs are
written per micro-batch with ``foreachBatch`` (idempotent per batch id),
and the final table is the last emitted row per key, which equals the
batch fold over the same events when events arrive in time order. Events
older than what a key has already folded are emitted as ``late`` instead
of being silently re-ordered (the side table of the rule in SURVEY 2.K).
"""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

STATUS_OUT = "order_id long, order_status string, n_live long"
STATUS_STATE = "entries string"


def _rollup(entries: dict) -> tuple[str, int]:
    live = [s for (_, _, s) in entries.values() if s != "Cancelled"]
    if not live:
        return "Cancelled", 0
    if all(s == "Delivered" for s in live):
        return "Delivered", len(live)
    if any(s in ("In Transit", "Delivered") for s in live):
        return "In Transit", len(live)
    return "Pending", len(live)


def _status_fold(key, batches, state):
    entries = json.loads(state.get[0]) if state.exists else {}
    for pdf in batches:
        for sup, ts, seq, st in zip(pdf["supplier_id"], pdf["ts"], pdf["seq"], pdf["status"]):
            k = str(int(sup))
            rank = (pd.Timestamp(ts).value, int(seq), st)
            cur = entries.get(k)
            if cur is None or tuple(cur) < rank:
                entries[k] = list(rank)
    state.update((json.dumps(entries),))
    status, n_live = _rollup({k: tuple(v) for k, v in entries.items()})
    yield pd.DataFrame({"order_id": [int(key[0])], "order_status": [status], "n_live": [n_live]})


def stream_status_rollup(events: DataFrame) -> DataFrame:
    """K6 on a stream of (order_id, supplier_id, ts, seq, status) events:
    the latest entry per supplier kept in state, roll-up emitted on update."""
    return events.groupBy("order_id").applyInPandasWithState(
        _status_fold, STATUS_OUT, STATUS_STATE, "update", GroupStateTimeout.NoTimeout)


CREDIT_OUT = ("order_id long, buyer_id long, created_at timestamp_ntz, total double, credit_limit double, "
              "accepted boolean, outstanding_after double, late boolean")
CREDIT_STATE = "open_cents long, last_ts long, last_id long"


def _credit_fold(key, batches, state):
    open_cents, last_ts, last_id = state.get if state.exists else (0, -(1 << 62), -(1 << 62))
    rows = pd.concat(list(batches), ignore_index=True)
    rows = rows.sort_values(["created_at", "order_id"], kind="mergesort")
    out = {c: [] for c in ("order_id", "buyer_id", "created_at", "total", "credit_limit", "accepted",
                           "outstanding_after", "late")}
    for oid, ts, tot, lim in zip(rows["order_id"], rows["created_at"], rows["total_cents"], rows["limit_cents"]):
        t = pd.Timestamp(ts).value
        late = (t, int(oid)) < (last_ts, last_id)
        ok = (not late) and open_cents + int(tot) <= int(lim)
        if ok:
            open_cents += int(tot)
        if not late:
            last_ts, last_id = t, int(oid)
        for c, v in (("order_id", int(oid)), ("buyer_id", int(key[0])), ("created_at", ts),
                     ("total", int(tot) / 100.0), ("credit_limit", int(lim) / 100.0), ("accepted", ok),
                     ("outstanding_after", open_cents / 100.0), ("late", late)):
            out[c].append(v)
    state.update((open_cents, last_ts, last_id))
    yield pd.DataFrame(out)


def stream_credit_admission(orders: DataFrame, buyers: DataFrame) -> DataFrame:
    """K2 on a stream of net-30 orders: stream-static join for the buyer's
    limit, then a per-buyer balance in state (one micro-batch's rows for a
    buyer are folded in time order)."""
    from larder.functions.columns import money, or_default
    from larder.operators.billing import DEFAULT_CREDIT_LIMIT
    lim = or_default("credit_limit", DEFAULT_CREDIT_LIMIT)
    b = buyers.select(F.col("user_id").alias("buyer_id"), (money(lim) * 100).cast("long").alias("limit_cents"))
    o = orders.select("order_id", "buyer_id", "created_at", (money("total") * 100).cast("long").alias("total_cents"))
    j = o.join(b, "buyer_id", "left").fillna({"limit_cents": int(DEFAULT_CREDIT_LIMIT * 100)})
    return j.groupBy("buyer_id").applyInPandasWithState(
        _credit_fold, CREDIT_OUT, CREDIT_STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, width: str, watermark: str, value: str | None = None) -> DataFrame:
    """A6 re-aimed for streams: tumbling-window counts (and sums) with a
    watermark, emitted once a window is final (append mode)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.sum(value).alias("total"))
    # watermarks need TIMESTAMP event time (session time zone UTC: same instant)
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return (events.withWatermark(ts, watermark).groupBy(F.window(ts, width).alias("w")).agg(*aggs)
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "n", *(["total"] if value else [])))


def stream_location(spark: SparkSession, name: str) -> str:
    """Checkpoint folder for a streaming query under the shared checkpoint
    directory named by the session (never a machine-local default)."""
    from larder.session import checkpoint_dir
    base = checkpoint_dir(spark)
    return os.path.join(base, "streams", name)


def run_available(sdf: DataFrame, out_path: str, checkpoint: str, mode: str = "update") -> None:
    """Process everything available now; each micro-batch is written under
    ``out_path/batch=<id>`` (overwrite of that batch only, so a retried
    batch after a failure replaces its own output)."""
    def write(batch_df, batch_id):
        batch_df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
                .parquet(os.path.join(out_path, f"batch={batch_id}"))

    # stateful processors need this store; a query keeps the one it starts with
    spark, key = sdf.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (sdf.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .foreachBatch(write).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def final_state(spark: SparkSession, out_path: str, key: list[str]) -> DataFrame:
    """The last emitted row per key across all micro-batches."""
    df = spark.read.parquet(out_path)
    cols = [c for c in df.columns if c not in key and c not in ("batch_id", "batch")]
    return (df.groupBy(*key).agg(*[F.max_by(c, "batch_id").alias(c) for c in cols]))
