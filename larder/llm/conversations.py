"""Conversation structure repair: the cheapest edits, by Hirschberg's divide and conquer.

A conversation is read as the initials of its roles. It is in order when they are
nothing, or an optional system turn followed by user / assistant pairs. Four states
follow that rule: nothing yet, after the system turn, after a user, after an assistant.
A row turns the state into another at the least cost of keeping, re-roling or deleting
it, with turns inserted before it: a 4 x 4 table of costs (``ROWS``). Tables of
consecutive rows multiply (least sum over the state between them).

* Reconstruction halves a run of rows: a four-state cost vector runs forward from its
  start and one backward from its end, they meet in the middle, the best crossing state
  splits the problem in two, and so on. Only vectors are kept, so space is linear.
* Among equal costs the crossing with the least audit wins. The forward vector carries
  the order of its four prefixes; two prefixes that consumed the same rows end in a row's
  letter and are never prefixes of each other, so that order decides whatever follows.
* A conversation of any length: rows are range-sorted, so a long conversation is cut into
  pieces of ``PIECE_ROWS`` rows. Each piece gives its table, tables are multiplied
  ``FAN`` at a time up a tree, and the same crossing search walks the tree down again and
  fixes the states between pieces; then every piece is rebuilt on its own.

Defined results: null role, text (and null id or turn in the damage key) become one
space; a null conv_id is one conversation; a null turn comes first; rows of one turn go by
role, text (its first 64 code points, then a hash); repeated rows are duplicates; very long
texts only pass through; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import stage, unstage
from larder.llm.runs import batches_of, rows_of, sorted_rows

PIECE_ROWS = 512
PIECE_BYTES = 1 << 20
FAN = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
STATES = 4                     # nothing yet, after system, after user, after assistant
USER, ASSISTANT = 2, 3
NEVER = 1 << 40
NEXT = {0: USER, 1: USER, 2: ASSISTANT, 3: USER}   # the state after a user or assistant turn
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


# ------------------------------------------------------------ tables of rows and pieces

def _table(paths):
    """Cost, order and text of the best edits between states, from (p, q, cost, text)."""
    best = {}
    for p, q, cost, text in paths:
        best[p, q] = min(best.get((p, q), (NEVER, "")), (cost, text))
    cost = [[best.get((p, q), (NEVER, ""))[0] for q in range(STATES)] for p in range(STATES)]
    text = [[best.get((p, q), (NEVER, ""))[1] for q in range(STATES)] for p in range(STATES)]
    order = [[sorted(text[p]).index(text[p][q]) for q in range(STATES)] for p in range(STATES)]
    return cost, order, text


def _row_paths(initial: str, fault: str):
    for p in range(STATES):
        at, inserted = p, ""
        for _ in range(STATES):
            cost = INSERT * len(inserted)
            yield p, at, cost + DELETE, inserted + "D"
            if fault not in "bd":
                extra = TRUNCATED if fault == "t" else 0
                if initial == "s" and at == 0:
                    yield p, 1, cost + KEEP + extra, inserted + "K"
                if initial == ROLE[NEXT[at]][0]:
                    yield p, NEXT[at], cost + KEEP + extra, inserted + "K"
                yield p, NEXT[at], cost + REROLE + extra, inserted + "R"
            at, inserted = NEXT[at], inserted + "I"


def _end_paths():
    for p in range(STATES):
        at, inserted = p, ""
        for _ in range(STATES):
            if at in (0, ASSISTANT):
                yield p, 0, INSERT * len(inserted), inserted
            at, inserted = NEXT[at], inserted + "I"


# by initial and fault: '-' none, 't' truncated, 'b' blank, 'd' duplicate
ROWS = {i + f: _table(_row_paths(i, f)) for i in "sua?" for f in "-tbd"}
END = _table(_end_paths())


def forward(tables, start):
    """Cost of every state after ``tables``, from vector ``start`` of (cost, order)."""
    cost, order = start
    for c, o, *_ in tables:
        new, keys = [], []
        for q in range(STATES):
            best = min((cost[m] + c[m][q], order[m], o[m][q]) for m in range(STATES))
            new.append(min(best[0], NEVER))
            keys.append(best[1:])
        ranked = sorted(set(keys))
        cost, order = new, [ranked.index(k) for k in keys]
    return cost, order


def backward(tables, cost):
    """Least cost from every state before ``tables`` to the end vector ``cost``."""
    for c, *_ in reversed(tables):
        cost = [min(c[m][q] + cost[q] for q in range(STATES)) for m in range(STATES)]
    return cost


def unit(state: int):
    return [0 if q == state else NEVER for q in range(STATES)], [0] * STATES


def product(tables):
    """The table of a run of rows or pieces."""
    rows = [forward(tables, unit(p)) for p in range(STATES)]
    return [r[0] for r in rows], [r[1] for r in rows]


def crossings(tables, p: int, q: int) -> list[int]:
    """The state after each table on the cheapest, audit-least way from ``p`` to ``q``."""
    out = [q] * len(tables)
    todo = [(0, len(tables), p, q)]
    while todo:
        lo, hi, p, q = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        cost, order = forward(tables[lo:mid], unit(p))
        rest = backward(tables[mid:hi], unit(q)[0])
        m = min(range(STATES), key=lambda s: (cost[s] + rest[s], order[s]))
        out[mid - 1] = m
        todo += [(lo, mid, p, m), (mid, hi, m, q)]
    return out


def last_state(cost, order):
    """Cheapest end after a vector: (total cost, state before the end)."""
    m = min(range(STATES), key=lambda s: (cost[s] + END[0][s][0], order[s]))
    return cost[m] + END[0][m][0], m


def rebuild(roles, texts, faults, p, q, ends: bool):
    """Audit letters and repaired ``role:text`` lines of a run of rows between two states."""
    tables = [ROWS[_initial(r) + f] for r, f in zip(roles, faults, strict=True)]
    audit, lines, at = [], [], p
    for table, role, text, state in zip(tables, roles, texts, crossings(tables, p, q), strict=True):
        letters = table[2][at][state]
        audit.append(letters)
        for letter in letters[:-1]:
            at = NEXT[at]
            lines.append(f"{ROLE[at]}:")
        if letters[-1] != "D":
            lines.append(f"{role if letters[-1] == 'K' else ROLE[state]}:{text}")
        at = state
    if ends:
        audit.append(END[2][at][0])
        for _ in END[2][at][0]:
            at = NEXT[at]
            lines.append(f"{ROLE[at]}:")
    return "".join(audit), lines


def _initial(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "?"


# ------------------------------------------------------------ damage and pieces

def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage; a dropped row stays as a marker with ``live`` false."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    hit = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text"), space)
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(hit == 4, "user").otherwise(F.coalesce(F.col("role"), space))
    live = hit != 0
    copies = F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), live.alias("live"),
        F.when(live, role).otherwise("").alias("role"), F.when(live, text).otherwise("").alias("text"),
        F.monotonically_increasing_id().alias("uid"), F.explode(copies).alias("copy"))
    return rows.withColumn("head", F.substring("text", 1, 64)).withColumn("hash", F.xxhash64("text"))


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
PIECE = ("part int, seq int, whole boolean, faults string, roles array<string>, texts array<string>, "
         "digests array<binary>, first_turn long, last_turn long, turns long")
_ARROW = pa.schema([("conv_id", pa.int64())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                   + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("part", pa.int32()), ("seq", pa.int32()),
                      ("whole", pa.bool_()), ("faults", pa.string()), ("roles", pa.list_(pa.string())),
                      ("texts", pa.list_(pa.string())), ("digests", pa.list_(pa.binary())), ("first_turn", pa.int64()),
                      ("last_turn", pa.int64()), ("turns", pa.int64())])
_NOTHING = hashlib.sha256(b"").hexdigest()


def _illegal(roles) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


def _whole_result(roles, texts, faults):
    tables = [ROWS[_initial(r) + f] for r, f in zip(roles, faults, strict=True)]
    cost, q = last_state(*forward(tables, unit(0)))
    audit, lines = rebuild(roles, texts, faults, 0, q, True)
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _scan(batches, piece_rows: int, piece_bytes: int):
    """Whole conversations as results, the others as pieces."""
    part, seq = TaskContext.get().partitionId(), 0
    conv, started, first = None, False, True
    roles, texts, faults, digests, turns, seen, size, pieces = [], [], [], [], [], set(), 0, 0

    def close(last):
        nonlocal seq
        seq += 1
        known = [t for t in turns if t is not None]
        distinct = len(set(known))
        whole = not (first or last or pieces)
        if not whole:
            return (conv, *[None] * 8, part, seq, False, "".join(faults), list(roles), list(texts), list(digests),
                    known[0] if known else None, known[-1] if known else None, distinct)
        cost, audit, sha = _whole_result(roles, texts, faults)
        gaps = known[-1] - known[0] + 1 - distinct if known else 0
        return (conv, gaps, *[faults.count(f) for f in "bdt"], _illegal(roles), cost, audit, sha,
                part, seq, True, *[None] * 7)

    def clear():
        for held in (roles, texts, faults, digests, turns):
            held.clear()

    for now, turn, live, role, text in rows_of(batches, "conv_id", "turn", "live", "role", "text"):
        if started and now != conv:
            yield close(False)
            clear()
            seen, size, pieces, first = set(), 0, 0, False
        elif len(roles) >= piece_rows or size > piece_bytes:
            pieces += 1
            yield close(False)
            clear()
            size = 0
        conv, started = now, True
        if not live:
            continue
        visible = VISIBLE.search(text)
        digest = None
        if visible is None:
            fault = "b"
        else:
            digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            fault = "d" if digest in seen else "-" if text.rstrip(" \t\n\r\x0b\x0c")[-1] in ".!?" else "t"
        if fault == "d":
            digest = None                  # already known as one
        elif digest is not None:
            seen.add(digest)
        roles.append(role)
        texts.append(text)
        faults.append(fault)
        digests.append(digest)
        turns.append(turn)
        size += len(text)
    if started:
        yield close(True)


def pieces_of(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    rows = sorted_rows(damage(conversations), ["conv_id"], ["turn", "role", "head", "hash", "uid", "copy"])
    rows = rows.select("conv_id", "turn", "live", "role", "text")
    return stage(rows.mapInArrow(lambda b: batches_of(_scan(b, piece_rows, PIECE_BYTES), _ARROW, 200),
                                 f"{RESULT}, {PIECE}"), "repair-pieces")


# ------------------------------------------------------------ conversations of several pieces

def _late_duplicates(pieces: DataFrame) -> DataFrame:
    """``part, seq, late``: rows of a piece whose role and text an earlier partition has.

    A partition offers each text of a conversation once, so a group has at most one row
    per partition.
    """
    rows = pieces.select("conv_id", "part", "seq", F.posexplode("digests").alias("pos", "digest")).where("digest IS NOT NULL")
    order = Window.partitionBy("conv_id", "digest").orderBy("part", "seq", "pos")
    return (rows.withColumn("n", F.row_number().over(order)).where("n > 1")
            .groupBy("part", "seq").agg(F.collect_list("pos").alias("late")))



def _flat(table):
    return [x for row in table for x in row]


def _square(values):
    v = [int(x) for x in values]
    return [v[i * STATES:(i + 1) * STATES] for i in range(STATES)]


def _leaf(batches):
    schema = pa.schema([("key", pa.string()), ("idx", pa.int64()), ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int64()))])

    def rows():
        for key, idx, roles, faults in rows_of(batches, "key", "idx", "roles", "faults"):
            cost, order = product([ROWS[_initial(r) + f] for r, f in zip(roles, faults, strict=True)])
            yield key, idx, _flat(cost), _flat(order)
    yield from batches_of(rows(), schema)


def _multiply(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("idx")
    cost, order = product([(_square(c), _square(o)) for c, o in zip(pdf["cost"], pdf["rank"], strict=True)])
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "idx": [int(pdf["up"].iloc[0])], "cost": [_flat(cost)], "rank": [_flat(order)]})


def _descend(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("idx")
    p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
    after = crossings([(_square(c), _square(o)) for c, o in zip(pdf["cost"], pdf["rank"], strict=True)], p, q)
    return pd.DataFrame({"key": pdf["key"], "idx": pdf["idx"], "p": [p, *after[:-1]], "q": after})


def _top(batches):
    schema = pa.schema([("key", pa.string()), ("idx", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("total", pa.int64())])

    def rows():
        for key, idx, cost, order in rows_of(batches, "key", "idx", "cost", "rank"):
            total, q = last_state(_square(cost)[0], _square(order)[0])
            yield key, idx, 0, q, total
    yield from batches_of(rows(), schema)


def _between(pieces: DataFrame, fan: int):
    """States before and after every piece, and the total cost of every conversation."""
    spec = "key string, idx long, cost array<long>, rank array<long>"
    levels = [stage(pieces.select("key", "idx", "roles", "faults").mapInArrow(_leaf, spec), "repair-tables")]
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        up = levels[-1].withColumn("up", F.floor(F.col("idx") / fan).cast("long"))
        levels.append(stage(up.groupBy("key", "up").applyInPandas(_multiply, spec), "repair-tables"))
    top = stage(levels[-1].mapInArrow(_top, "key string, idx long, p int, q int, total long"), "repair-top")
    held = [*levels, top]
    states = top.select("key", "idx", "p", "q")
    for level in reversed(levels[:-1]):
        above = states.select("key", F.col("idx").alias("up"), "p", "q")
        rows = level.withColumn("up", F.floor(F.col("idx") / fan).cast("long")).join(above, ["key", "up"])
        states = stage(rows.groupBy("key", "up").applyInPandas(_descend, "key string, idx long, p int, q int"), "repair-states")
        held.append(states)
    return states, top.select("key", "total"), held


_REBUILT = pa.schema([("key", pa.string()), ("conv_id", pa.int64()), ("idx", pa.int64()), ("audit", pa.string()), ("data", pa.string()),
                      ("lines", pa.int64()), ("illegal", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                      ("truncated", pa.int64()), ("n", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
                      ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("total", pa.int64())])
_REBUILT_SQL = ("key string, conv_id long, idx long, audit string, data string, lines long, illegal long, blank long, duplicate long, "
                "truncated long, n long, head string, tail string, first_turn long, last_turn long, turns long, total long")


def _rebuild_pieces(batches):
    def rows():
        for key, conv, idx, roles, texts, faults, p, q, last, first_turn, last_turn, turns, total in rows_of(
                batches, "key", "conv_id", "idx", "roles", "texts", "faults", "p", "q", "last", "first_turn", "last_turn", "turns", "total"):
            audit, lines = rebuild(roles, texts, faults, p, q, last)
            yield (key, conv, idx, audit, "\n".join(lines), len(lines), _illegal(roles), *[faults.count(f) for f in "bdt"], len(roles),
                   roles[0][:1] if roles else None, roles[-1][:1] if roles else None, first_turn, last_turn, turns, total)
    yield from batches_of(rows(), _REBUILT, 20)


def _fold_pieces(batches):
    """Streams the pieces of each conversation, in order, into one result."""
    schema = pa.schema(list(_ARROW)[:9])

    def rows():
        key, held = None, None
        for now, *row in rows_of(batches, *[f.name for f in _REBUILT]):
            if now != key:
                if key is not None:
                    yield finish(held)
                key, held = now, {"conv": row[0], "audit": [], "sha": hashlib.sha256(), "lines": 0, "counts": [0, 0, 0], "illegal": 0,
                                  "tail": None, "low": None, "high": None, "turns": 0, "total": row[-1]}
            _, _, audit, data, lines, illegal, blank, duplicate, truncated, n, head, tail, low, high, turns, _ = row
            held["audit"].append(audit)
            if lines:
                held["sha"].update((("\n" if held["lines"] else "") + data).encode())
                held["lines"] += lines
            held["counts"] = [a + b for a, b in zip(held["counts"], (blank, duplicate, truncated), strict=True)]
            held["illegal"] += illegal
            if n:
                if held["tail"] is not None and held["tail"] + head not in LEGAL:
                    held["illegal"] += 1
                held["tail"] = tail
            if turns:
                held["turns"] += turns - (held["high"] == low)
                held["low"], held["high"] = low if held["low"] is None else held["low"], high
        if key is not None:
            yield finish(held)

    def finish(h):
        gaps = h["high"] - h["low"] + 1 - h["turns"] if h["turns"] else 0
        return (h["conv"], gaps, *h["counts"], h["illegal"], h["total"], "".join(h["audit"]), h["sha"].hexdigest())

    yield from batches_of(rows(), schema, 20)


def repair(conversations: DataFrame, piece_rows: int = PIECE_ROWS, fan: int = FAN) -> DataFrame:
    """One row per conversation: faults found, edit cost, audit letters, digest of the repaired turns."""
    found = pieces_of(conversations, piece_rows)
    names = [f.name for f in list(_ARROW)[:9]]
    open_ = found.where(~F.col("whole")).drop(*names[1:], "whole")
    late = _late_duplicates(open_)
    fixed = F.when(F.col("late").isNull(), F.col("faults")).otherwise(F.array_join(F.transform(
        F.split("faults", ""), lambda c, i: F.when(F.array_contains("late", i), "d").otherwise(c)), ""))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    order = Window.partitionBy("key").orderBy("part", "seq")
    # the number of a piece in its conversation comes from slim rows: the texts are not ordered by one task
    index = open_.select(key.alias("key"), "part", "seq").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    index = index.withColumn("last", F.lead("idx").over(order).isNull())
    pieces = stage(open_.join(late, ["part", "seq"], "left").withColumn("faults", fixed).drop("late", "digests")
                   .join(index, ["part", "seq"]), "repair-open")
    states, totals, held = _between(pieces, fan)
    rebuilt = (pieces.join(states, ["key", "idx"]).join(totals, "key")
               .select("key", "conv_id", "idx", "roles", "texts", "faults", "p", "q", "last", "first_turn", "last_turn", "turns", "total")
               .mapInArrow(_rebuild_pieces, _REBUILT_SQL))
    result = (rebuilt.repartition("key").sortWithinPartitions("key", "idx").mapInArrow(_fold_pieces, RESULT))
    out = stage(found.where("whole").select(*names).unionAll(result), "repair-result")
    unstage(found, pieces, *held)
    return out


def report(conversations: DataFrame) -> DataFrame:
    return repair(conversations)


# DuckDB has no crc32: its table comes from the polynomial, applied byte by byte. The
# suffix search below walks rows from the last to the first with four (cost, audit) pairs.
CRC_TABLE_SQL = """
bits(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text, beside ``tab``."""
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({text}) + 1), lambda i: "
            f"CAST(ascii({text}[i]) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


def _offer(cost, letter: str, state: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a}}"


def _step_sql() -> str:
    """One row: deleting, keeping, re-roling; then up to two inserts before it."""
    after = {"o": "u", "s": "u", "u": "a", "a": "u"}
    rows, once, twice = [], [], []
    for s, nxt in after.items():
        offers = [_offer(2, "D", f"b.{s}")]
        offers += [f"CASE WHEN r.fault IN ('-', 't') THEN {_offer('r.extra + 1', 'R', f'b.{nxt}')} END",
                   f"CASE WHEN r.fault IN ('-', 't') AND r.initial = '{nxt}' THEN {_offer('r.extra', 'K', f'b.{nxt}')} END"]
        if s == "o":
            offers.append(f"CASE WHEN r.fault IN ('-', 't') AND r.initial = 's' THEN {_offer('r.extra', 'K', 'b.s')} END")
        rows.append(f"list_min([{', '.join(offers)}]) AS {s}")
        once.append(f"list_min([{s}, {_offer(5, 'I', nxt)}]) AS {s}")
    twice = once
    return (f"SELECT conv, i, {', '.join(twice)} FROM (SELECT conv, i, {', '.join(once)} FROM ("
            f"SELECT r.conv, r.i, {', '.join(rows)} FROM best b JOIN faults r ON r.conv = b.conv AND r.i = b.i - 1))")


SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
keyed AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT keyed.*, {crc_sql("k")} % 20 AS hit FROM keyed, tab),
damaged AS (
  SELECT conv, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM hit, (VALUES (0), (1)) AS c(copy) WHERE hit <> 0 AND (copy = 0 OR hit = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM damaged),
judged AS (
  SELECT *, CASE WHEN shown = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN right(shown, 1) IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault FROM numbered),
faults AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS extra,
         left(lag(role) OVER (PARTITION BY conv ORDER BY i), 1) || left(role, 1) AS pair FROM judged),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv),
best(conv, i, o, s, u, a) AS (
  SELECT conv, n + 1, {{'c': 0, 'a': ''}}, {{'c': 10, 'a': 'II'}}, {{'c': 5, 'a': 'I'}}, {{'c': 0, 'a': ''}} FROM counts
  UNION ALL
  {_step_sql()}),
answer AS (SELECT conv, o.c AS cost, o.a AS audit FROM best WHERE i = 1),
letters AS (
  SELECT conv, place_no, audit[place_no] AS letter, CAST(sum(CASE WHEN audit[place_no] = 'I' THEN 0 ELSE 1 END) OVER w AS BIGINT) AS i,
         CAST(sum(CASE WHEN audit[place_no] = 'D' THEN 0 ELSE 1 END) OVER w AS BIGINT) AS place
  FROM (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS place_no FROM answer)
  WINDOW w AS (PARTITION BY conv ORDER BY place_no ROWS UNBOUNDED PRECEDING)),
kept AS (
  SELECT l.conv, l.place_no, l.place, l.letter, r.role, r.text,
         max(CASE WHEN l.place = 1 AND l.letter = 'K' AND left(r.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv) AS sys
  FROM letters l LEFT JOIN faults r ON r.conv = l.conv AND r.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'),
lines AS (
  SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END
                          || ':' || coalesce(text, ''), chr(10) ORDER BY place_no) AS body FROM kept GROUP BY conv)
SELECT k.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, CAST(coalesce(w.cost, 0) AS BIGINT) AS cost,
       coalesce(w.audit, '') AS audit, sha256(coalesce(l.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM keyed) k LEFT JOIN counts c USING (conv) LEFT JOIN answer w USING (conv)
LEFT JOIN lines l USING (conv)
"""
