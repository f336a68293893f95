"""Conversation repair and prefix trie against plain versions, at every piece size."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from larder.llm import conversations, trie
from larder.sources.tables import read_table
from tests.conftest import MEDIUM

SCHEMA = "conv_id long, turn long, role string, text string, key string, idx long, part int, a long, depth long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], SCHEMA)


def odd_rows():
    rows = [(None, 0, "user", "Hi there."), (None, 1, "assistant", "Yes."), (1, None, None, None), (1, None, "user", "One."),
            (1, 3, "assistant", "Two"), (1, 3, "assistant", "Two more!"), (2, 5, "", "x."), (2, 6, "weird", ""), (2, 9, "system", "S."),
            (3, 0, "system", "Rules."), (3, 1, "user", "Q?"), (3, 2, "assistant", "A."), (3, 3, "user", "Q?"), (3, 4, "assistant", "A. \n\t"),
            (4, 0, "user", "é" * 60 + "."), (4, 0, "user", "é" * 60 + "!" + "x" * 70), (5, 0, "user", "word " * 60_000 + "."),
            (6, 0, "user", "same."), (6, 0, "user", "same."), (6, 0, "user", "same.")]
    roles, x = ["system", "user", "assistant", "user", "assistant", "tool"], 12345
    for conv in range(100, 140):
        for turn in range(conv % 23):
            x = (x * 1103515245 + 12345) % (1 << 31)
            text = ["Fine.", "cut off", "Really?", f"turn {turn}.", f"n {x % 7}!", ""][(x >> 8) % 6]
            rows.append((conv, turn + (turn > 9) * 2, roles[(x >> 16) % 6], text))
    x = 99
    for turn in range(700):          # one conversation that spans partitions
        x = (x * 1103515245 + 12345) % (1 << 31)
        rows.append((700, turn, roles[(x >> 16) % 6], f"text {(x >> 8) % 150}" + ".!? "[(x >> 20) % 4]))
    return rows


# ------------------------------------------------------------ repair

def crc(text):
    return zlib.crc32(text.encode())


def plain_repair(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        hit = crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}") % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        kept = convs[conv]
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        kept += [(turn, role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64]))
        faults, seen = [], set()
        for _, role, text in kept:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not shown else "d" if (role, text) in seen else "-" if shown[-1] in ".!?" else "t")
            seen.add((role, text))
        known = [t for t, _, _ in kept if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))

        best = {(len(kept), s): None for s in "0sua"}
        for i in range(len(kept), -1, -1):
            for s in "0sua":
                best[i, s] = (10 ** 9, "")
            for _ in range(3):       # inserts stay at the same row
                for s in "0sua":
                    offers = [best[i, s]]
                    step = "a" if s == "u" else "u"
                    c, audit = best[i, step]
                    offers.append((c + 5, "I" + audit))
                    if i == len(kept):
                        if s in "0a":
                            offers.append((0, ""))
                    else:
                        c, audit = best[i + 1, s]
                        offers.append((c + 2, "D" + audit))
                        role, f = kept[i][1], faults[i]
                        if f in "-t":
                            extra = 5 if f == "t" else 0
                            c, audit = best[i + 1, step]
                            offers.append((c + 1 + extra, "R" + audit))
                            if role[:1] == step:
                                offers.append((c + extra, "K" + audit))
                            if role[:1] == "s" and s == "0":
                                c, audit = best[i + 1, "s"]
                                offers.append((c + extra, "K" + audit))
                    best[i, s] = min(offers)
        cost, audit = best[0, "0"]
        lines, at, s = [], 0, "0"
        for letter in audit:
            step = "a" if s == "u" else "u"
            full = {"u": "user", "a": "assistant"}[step]
            if letter == "I":
                lines.append(f"{full}:")
                s = step
                continue
            _, role, text = kept[at]
            at += 1
            if letter == "K":
                s = "s" if role[:1] == "s" else step
                lines.append(f"{role}:{text}")
            elif letter == "R":
                s = step
                lines.append(f"{full}:{text}")
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(f) for f in "bdt"], illegal,
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df, **sizes):
    return {r[0]: tuple(r)[1:] for r in conversations.repair(df, **sizes).collect()}


@pytest.mark.parametrize("sizes", [{}, {"piece_rows": 3, "fan": 2}, {"piece_rows": 1, "fan": 3}])
def test_repair_matches_plain(spark, sizes):
    rows = odd_rows()
    got, want = repaired(frame(spark, rows).repartition(5), **sizes), plain_repair(rows)
    assert got == want


def test_repair_whole_table(spark):
    table = read_table(spark, MEDIUM, "conversations")
    assert repaired(table) == plain_repair([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_repair_empty(spark):
    assert conversations.repair(frame(spark, [])).count() == 0


def test_repair_of_repeated_rows(spark):
    rows = [(8, 2, "user", "again.")] * 3000 + [(9, None, "user", "null turn")] * 500
    assert repaired(frame(spark, rows).repartition(6)) == plain_repair(rows)


def test_crossings_are_least_of_all_paths():
    """Every sequence of up to three rows: crossing search against the plain suffix search."""
    kinds = sorted(conversations.ROWS)
    for a in kinds:
        for b in kinds:
            for c in kinds:
                tables = [conversations.ROWS[k] for k in (a, b, c)]
                cost, q = conversations.last_state(*conversations.forward(tables, conversations.unit(0)))
                at, audit = 0, ""
                for table, state in zip(tables, conversations.crossings(tables, 0, q)):
                    audit += table[2][at][state]
                    at = state
                audit += conversations.END[2][at][0]
                best = {s: (0 if s in (0, 3) else 10 ** 9, "") for s in range(4)}
                best = {s: min((conversations.END[0][s][0], conversations.END[2][s][0]), best[s]) for s in range(4)}
                for table in reversed(tables):
                    best = {p: min((table[0][p][m] + best[m][0], table[2][p][m] + best[m][1]) for m in range(4)) for p in range(4)}
                assert (cost, audit) == best[0], (a, b, c)


# ------------------------------------------------------------ trie

def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in convs.values():
        turns.sort(key=lambda r: (*r[:3], r[3][:64]))
    rebuilt = {}
    for conv, turns in convs.items():
        h = crc(str(conv)) % 6
        rebuilt[conv] = [t[2:] for t in convs.get(conv - conv % 100, [])[:h] + turns[h:]]
    members = defaultdict(list)
    for conv, turns in sorted(rebuilt.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = sum(saved[c] for c in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(str(c) for c in m if len(rebuilt[c]) == len(n)).encode()).hexdigest())
                  for n, m in members.items())


def nodes(df, **sizes):
    return sorted(tuple(r) for r in trie.build(df, **sizes).collect())


def trie_rows():
    rows = [(None, 0, "user", "no one"), (0, 0, "user", "Hi."), (0, 1, "assistant", None), (0, 1, None, "tie"), (0, None, "user", "first")]
    for conv in [*range(1, 60), *range(100, 130), *range(205, 215), 301, 302]:
        for turn in range(conv % 9):
            rows.append((conv, turn, ["user", "assistant"][turn % 2], f"t{turn} {'x' * (conv % 3) if turn > 3 else ''}"))
    rows += [(conv, turn, "user", "copy " + str(turn)) for conv in range(400, 460) for turn in range(6)]
    rows += [(conv, turn, "user", f"long {turn}") for conv in (500, 501, 517) for turn in range(60)]
    rows += [(600, 0, "user", "word " * 60_000), (600, 0, "user", "same"), (600, 0, "user", "same")]
    return rows


@pytest.mark.parametrize("slot, shard", [(4096, 200_000), (7, 30), (1, 1)])
def test_trie_matches_plain(spark, slot, shard):
    rows = trie_rows()
    assert nodes(frame(spark, rows).repartition(5), slot=slot, shard_rows=shard) == plain_trie(rows)


def test_trie_whole_table(spark):
    table = read_table(spark, MEDIUM, "conversations")
    assert nodes(table) == plain_trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_trie_empty(spark):
    assert trie.build(frame(spark, [])).count() == 0
    assert trie.build(frame(spark, [(None, 0, "user", "x")])).count() == 0


def test_slot_table_is_minimal_and_verified():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    a[:1000] = a[0]                                   # equal halves must not meet
    a, b = trie.distinct_keys(a, b)
    table = trie.SlotTable(a, b)
    assert sorted(table(a, b)) == list(range(len(a)))
    assert (table(a, b + np.uint64(1)) == -1).all()
    assert len(trie.SlotTable(a[:0], b[:0])(a, b)) == len(a)
