"""Order state and credit admission as stateful streams with a start state and timers.

``transformWithStateInPandas`` keeps, per order, the few facts that
``larder.operators.order_state`` aggregates (first and last ranks), so the final state
does not depend on the order of arrival. The orders open when the stream starts come in
as its initial state. An order that is Delivered or Cancelled is closed ``retention``
after its last event by an event-time timer: its state shrinks to a mark, and rows that
come later still are emitted with ``late`` true (the side table), not folded.

Credit admission takes every buyer's open invoices as initial state, so it ends where
the batch query does.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from larder.functions.columns import money, or_default
from larder.operators.billing import DEFAULT_CREDIT_LIMIT
from larder.operators.order_state import BARRIERS, KINDS, PAYMENT_STATUS, PAYMENTS, STATE, WAITING

STATE_OUT = STATE + ", closed boolean, late boolean"
NEW = {"pairs": {}, "bank": False, "own": {}, "setter": None, "barrier": None, "barrier_status": None, "first_admin": None,
       "first_own": None, "payment": None, "last": 0, "closed": False}


def _millis(ts) -> int:
    return pd.Timestamp(ts).value // 1_000_000


def fold(state: dict, rank: list, kind: str, supplier, status) -> None:
    """One event into the facts of an order."""
    if kind == "supplier":
        supplier = str(int(supplier))
        if supplier not in state["pairs"]:
            return
        own = state["own"].get(supplier)
        if own is None:
            state["own"][supplier] = [rank, rank, status]
        else:
            own[0] = min(own[0], rank)
            if rank > own[1]:
                own[1:] = [rank, status]
        state["first_own"] = min(state["first_own"] or rank, rank)
    if kind == "admin":
        state["first_admin"] = min(state["first_admin"] or rank, rank)
    if kind in BARRIERS and (state["barrier"] is None or rank > state["barrier"]):
        state["barrier"], state["barrier_status"] = rank, status if kind == "admin" else "Pending"
    if kind in PAYMENTS and (state["payment"] is None or rank > state["payment"][0]):
        state["payment"] = [rank, kind]
    if kind != "reject" and (state["setter"] is None or rank > state["setter"][0]):
        state["setter"] = [rank, kind, status]


def entries_of(state: dict) -> dict[int, str]:
    made = (not any(state["pairs"].values()) and state["first_admin"] is not None
            and (state["first_own"] is None or state["first_own"] > state["first_admin"]))
    out = {}
    for supplier, initial in state["pairs"].items():
        own, barrier = state["own"].get(supplier), state["barrier"]
        if own and (barrier is None or own[1] > barrier):
            out[int(supplier)] = own[2]
        elif barrier is not None and (initial or (own and own[0] < barrier) or (made and state["first_admin"] <= barrier)):
            out[int(supplier)] = state["barrier_status"]
        elif initial:
            out[int(supplier)] = "Pending"
    return dict(sorted(out.items()))


def row_of(key: int, state: dict, late: bool = False) -> tuple:
    entries = entries_of(state)
    live = [s for s in entries.values() if s != "Cancelled"]
    rollup = ("Cancelled" if not live else "Delivered" if all(s == "Delivered" for s in live)
              else "In Transit" if any(s in ("In Transit", "Delivered") for s in live) else "Pending")
    _, kind, status = state["setter"] or (None, None, None)
    order = {"supplier": rollup, "admin": status, "approve": "Pending", "reupload": WAITING}.get(
        kind, WAITING if state["bank"] else "Pending")
    paid = PAYMENT_STATUS[state["payment"][1]] if state["payment"] else "Pending Verification" if state["bank"] else "Approved"
    text = ",".join(f"{k}:{v}" for k, v in entries.items())
    return key, order, paid, len(entries), len(live), text, state["closed"], late


class OrderState(StatefulProcessor):
    def __init__(self, retention_ms: int):
        self.retention = retention_ms

    def init(self, handle):
        self.handle = handle
        self.value = handle.getValueState("order", "facts string")

    def _get(self):
        return json.loads(self.value.get()[0]) if self.value.exists() else json.loads(json.dumps(NEW))

    def _put(self, state):
        self.value.update((json.dumps(state),))

    def handleInitialState(self, key, initialState, timerValues):  # noqa: N802, N803
        state = self._get()
        for supplier, initial, method in zip(initialState["supplier_id"], initialState["initial"], initialState["payment_method"]):
            if supplier is not None and not pd.isna(supplier):
                state["pairs"][str(int(supplier))] = bool(initial)
            state["bank"] = method == "bank"
        self._put(state)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        state, late = self._get(), 0
        for pdf in rows:
            for ts, seq, kind, supplier, status in zip(pdf["ts"], pdf["seq"], pdf["kind"], pdf["supplier_id"], pdf["status"]):
                if state["closed"]:
                    late += 1
                    continue
                status = None if status is None or status != status else status
                fold(state, [pd.Timestamp(ts).value, int(seq), KINDS[kind], status or ""], kind, supplier, status)
                state["last"] = max(state["last"], _millis(ts))
        out = [row_of(int(key[0]), state)] if not state["closed"] else []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if out and out[0][1] in ("Delivered", "Cancelled"):
            self.handle.registerTimer(state["last"] + self.retention)
        self._put(state)
        out += [row_of(int(key[0]), state, True)] * late
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE_OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        state = self._get()
        state["closed"] = True
        row = row_of(int(key[0]), state)
        self._put(json.loads(json.dumps(NEW)) | {"closed": True})
        yield pd.DataFrame([row], columns=[c.split()[0] for c in STATE_OUT.split(", ")])

    def close(self):
        pass


def stream_order_state(events: DataFrame, pairs: DataFrame, orders: DataFrame, retention: str = "30 days",
                       watermark: str = "1 day") -> DataFrame:
    """``STATE_OUT`` rows, one per order and micro-batch. ``events`` has a timestamp ``ts``."""
    start = (orders.select("order_id", "payment_method").join(pairs, "order_id", "left")
             .select("order_id", "supplier_id", F.coalesce("initial", F.lit(False)).alias("initial"), "payment_method").groupBy("order_id"))
    hold = int(pd.Timedelta(retention).total_seconds() * 1000)
    # the operator would drop rows behind the watermark by itself: it is handed the time as a plain column
    plain = (F.col("at") + F.expr("INTERVAL 0 SECONDS")).alias("ts")
    rows = (events.withColumn("at", F.col("ts").cast("timestamp")).drop("ts").withWatermark("at", watermark)
            .select("order_id", "supplier_id", plain, "seq", "kind", "status"))
    return (rows.groupBy("order_id")
            .transformWithStateInPandas(OrderState(hold), STATE_OUT, "Update", "EventTime", start))


CREDIT_OUT = ("order_id long, buyer_id long, total double, credit_limit double, accepted boolean, outstanding_after double, late boolean")


class CreditState(StatefulProcessor):
    def init(self, handle):
        self.value = handle.getValueState("balance", "cents long, last_ts long, last_id long")

    def handleInitialState(self, key, initialState, timerValues):  # noqa: N802, N803
        self.value.update((int(initialState["start_cents"].sum()), -(1 << 62), -(1 << 62)))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        cents, last_ts, last_id = self.value.get() if self.value.exists() else (0, -(1 << 62), -(1 << 62))
        data = pd.concat(list(rows), ignore_index=True).sort_values(["created_at", "order_id"], kind="mergesort")
        out = []
        for order, ts, total, limit in zip(data["order_id"], data["created_at"], data["total_cents"], data["limit_cents"]):
            at = (pd.Timestamp(ts).value, int(order))
            late = at < (last_ts, last_id)
            ok = not late and cents + int(total) <= int(limit)
            cents += int(total) if ok else 0
            last_ts, last_id = (last_ts, last_id) if late else at
            out.append((int(order), int(key[0]), int(total) / 100.0, int(limit) / 100.0, ok, cents / 100.0, late))
        self.value.update((int(cents), int(last_ts), int(last_id)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CREDIT_OUT.split(", ")])

    def close(self):
        pass


def stream_credit(orders: DataFrame, buyers: DataFrame, start: DataFrame) -> DataFrame:
    """K2 on a stream: ``start`` (buyer_id, start_cents) opens every balance."""
    limit = or_default("credit_limit", DEFAULT_CREDIT_LIMIT)
    b = buyers.select(F.col("user_id").alias("buyer_id"), (money(limit) * 100).cast("long").alias("limit_cents"))
    o = orders.select("order_id", "buyer_id", "created_at", (money("total") * 100).cast("long").alias("total_cents"))
    j = o.join(b, "buyer_id", "left").fillna({"limit_cents": int(DEFAULT_CREDIT_LIMIT * 100)})
    return j.groupBy("buyer_id").transformWithStateInPandas(CreditState(), CREDIT_OUT, "Update", "None", start.groupBy("buyer_id"))
