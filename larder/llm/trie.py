"""Conversation prefix trie over slot tables of prefix digests.

Every prefix of a rebuilt conversation has a 128-bit digest: the exclusive-or, over its
turns, of hashes of the turn and its place. It does not depend on how a conversation is
cut, so prefixes of a conversation of any length come from pieces of ``SLOT`` turns.

* Rows (conversation, depth) are dealt by block of conversations and piece. A task takes
  bounded shards of them, enumerates the distinct digests of a shard and gives each a slot
  by a minimal perfect hash (levels of bit tables; a key that meets another moves one
  level down). A slot keeps both halves of its digest, so a look-up of a foreign digest is
  refused, and a digest met with two depths, lengths or parents stops the job.
* First pass: counts and smallest members are scattered into flat arrays by slot. The
  arrays of all shards merge by digest into the node table.
* Second pass: a shard scatters what each conversation holds beyond its piece at the last
  prefix it has there and adds children to parents through the parent-slot array, deepest
  first. Leaves and tokens below a node are sums over its members: a childless node counts
  with its smallest member, and a node's own text with its owner, the smallest member.
  Thus shards add up, whatever conversations they hold, and neither a first turn that a
  third of all conversations share nor a very long conversation meets in one task.

Defined results: a null conv_id is no conversation; a null role or text is empty; turns go
by turn (null first), then role, the first 64 code points of the text and its hash; repeated
rows are separate turns; a conversation without turns is a member of the root alone; an empty
table gives no nodes; extra columns are ignored; long texts only give a hash and a length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import mix64, release_memory, stage, unstage
from larder.llm.conversations import CRC_TABLE_SQL, crc_sql
from larder.llm.runs import batches_of, rows_of, sha256_runs, sorted_rows

BLOCK = 100                    # conversations that share a base conversation
MOST_SHARED = 6                # fewer than this many turns come from the base
SLOT = 4096                    # turns of one piece of a conversation
SHARD_ROWS = 200_000
HOT_SHARE = 1000               # a parent of more than 1/HOT_SHARE of all nodes joins by broadcast
GAMMA = 1.5


class SlotTable:
    """Minimal perfect hash of distinct 128-bit keys, with the keys kept for verification."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, rest, base = [], np.arange(len(a)), 0
        slots = np.empty(len(a), np.int64)
        while len(rest):
            size = max(int(GAMMA * len(rest)), 2)
            at = self._place(a[rest], b[rest], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = base + np.cumsum(alone) - 1
            self.levels.append((size, alone, rank))
            placed = alone[at]
            slots[rest[placed]] = rank[at[placed]]
            base += int(placed.sum())
            rest = rest[~placed]
        self.a, self.b = np.empty(len(a), np.uint64), np.empty(len(a), np.uint64)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def _place(a, b, level, size):
        salt = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % (1 << 64))
        return (mix64(mix64(a + salt) ^ (b * np.uint64(0xD1342543DE82EF95))) % np.uint64(size)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for keys that are not in the table."""
        out, rest = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (size, alone, rank) in enumerate(self.levels):
            if not len(rest):
                break
            at = self._place(a[rest], b[rest], level, size)
            hit = alone[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        known = out >= 0
        known[known] = (self.a[out[known]] == a[known]) & (self.b[out[known]] == b[known])
        out[~known] = -1
        return out


def distinct_keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first]


# ------------------------------------------------------------ turns and prefixes

def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, a, b, size``: place, hashes and code points of every turn."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.substring(text, 1, 64).alias("head"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("second"), text, role).alias("b"), F.length(text).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("uid"))
    rows = sorted_rows(rows, ["conv_id"], ["turn", "role", "head", "a", "uid"]).select("conv_id", "a", "b", "size")
    schema = pa.schema([(n, pa.int64()) for n in ("conv_id", "pos", "a", "b", "size", "part")])

    def number(batches):
        part, conv, pos = TaskContext.get().partitionId(), None, 0
        for now, a, b, size in rows_of(batches, "conv_id", "a", "b", "size"):
            conv, pos = now, 0 if now != conv else pos + 1
            yield now, pos, a, b, size, part

    rows = stage(rows.mapInArrow(lambda x: batches_of(number(x), schema, 10_000),
                                 "conv_id long, pos long, a long, b long, size long, part long"), "trie-turns")
    # a conversation goes on into a partition only as its first one: at most one row per partition
    held = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offset = held.withColumn("before", before).where("before > 0").select("conv_id", "part", "before")
    out = rows.join(F.broadcast(offset), ["conv_id", "part"], "left")
    out = out.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "a", "b", "size")
    out.staged_path = rows.staged_path
    return out


def _slot(pos, slot):
    return F.floor(pos / slot).cast("long")


def rebuilt_turns(turns: DataFrame, slot: int = SLOT) -> DataFrame:
    """``conv_id, depth, a, b, size, total`` of the rebuilt conversations; depth 0 once each."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(BLOCK))
    bases = convs.where(F.pmod("conv_id", F.lit(BLOCK)) == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("long")
    info = (convs.withColumn("base", base).withColumn("h", shared).join(bases, "base", "left")
            .withColumn("take", F.least("h", F.coalesce("base_n", F.lit(0)))))
    info = stage(info.select("conv_id", "base", "h", "take", "n", (F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
                             .alias("total")), "trie-info")
    first = (turns.where((F.pmod("conv_id", F.lit(BLOCK)) == 0) & (F.col("pos") < MOST_SHARED - 1))
             .withColumnRenamed("conv_id", "base").join(info.drop("n"), "base").where("pos < take")
             .select("conv_id", (F.col("pos") + 1).alias("depth"), "a", "b", "size", "total"))
    # own turns meet their conversation's row piece by piece, so that a long one is not one key
    per_slot = info.where("n > h").select("conv_id", "h", "take", "total", F.explode(
        F.sequence(F.lit(0), _slot(F.col("n") - 1, slot))).alias("slot"))
    own = (turns.withColumn("slot", _slot(F.col("pos"), slot)).join(per_slot, ["conv_id", "slot"]).where("pos >= h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("take") + 1).alias("depth"), "a", "b", "size", "total"))
    zero = F.lit(0).cast("long")
    root = info.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("size"), "total")
    out = first.unionAll(own).unionAll(root)
    out.staged_path = info.staged_path
    return out


PATH = ("conv_id", "depth", "total", "size", "a", "b", "pa", "pb", "upto")


def prefixes(turns: DataFrame, slot: int = SLOT) -> DataFrame:
    """Every prefix: its digest (a, b), its parent's (pa, pb), ``size`` of its last turn, ``upto`` of all."""
    at = F.col("depth") > 0
    rows = turns.select("conv_id", "depth", "total", "size", F.when(at, F.xxhash64("a", "depth")).otherwise(0).alias("x"),
                        F.when(at, F.xxhash64("b", "depth", F.lit(1))).otherwise(0).alias("y"))
    rows = rows.withColumn("slot", _slot(F.greatest(F.col("depth") - 1, F.lit(0)), slot))
    within = Window.partitionBy("conv_id", "slot").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.bit_xor("x").over(within).alias("a"), F.bit_xor("y").over(within).alias("b"),
                       F.sum("size").over(within).alias("upto"))
    # what the earlier pieces of a long conversation hold
    long = turns.where(F.col("total") > slot).select("conv_id", "depth", "size", F.xxhash64("a", "depth").alias("x"),
                                                     F.xxhash64("b", "depth", F.lit(1)).alias("y")).where("depth > 0")
    pieces = long.groupBy("conv_id", _slot(F.col("depth") - 1, slot).alias("slot")).agg(
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("size").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv_id", "slot", F.bit_xor("x").over(earlier).alias("a0"), F.bit_xor("y").over(earlier).alias("b0"),
                           F.sum("size").over(earlier).alias("upto0")).where("slot > 0")
    rows = rows.join(pieces, ["conv_id", "slot"], "left")
    for c in ("a", "b"):
        rows = rows.withColumn(c, F.col(c).bitwiseXOR(F.coalesce(F.col(f"{c}0"), F.lit(0))))
    rows = rows.withColumn("upto", F.col("upto") + F.coalesce("upto0", F.lit(0)))
    rows = rows.withColumn("pa", F.col("a").bitwiseXOR(F.col("x"))).withColumn("pb", F.col("b").bitwiseXOR(F.col("y")))
    return stage(rows.select(*PATH), "trie-prefixes")


def _dealt(rows: DataFrame, order: list, slot: int) -> DataFrame:
    """Rows dealt by block and piece, sorted so that a piece of a conversation is contiguous."""
    block = F.floor(F.col("conv_id") / BLOCK).alias("block")
    piece = _slot(F.greatest(F.col("depth") - 1, F.lit(0)), slot)
    rows = rows.withColumn("block", block).withColumn("slot", piece).repartition("block", "slot")
    return rows.sortWithinPartitions("block", "slot", "conv_id", *order)


# ------------------------------------------------------------ numpy passes over shards

def _shards(batches, limit: int):
    """Rows as column arrays, cut only between pieces of conversations."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        conv, slot = (table.column(table.schema.get_field_index(c)).to_numpy() for c in ("conv_id", "slot"))
        change = np.flatnonzero((conv[1:] != conv[:-1]) | (slot[1:] != slot[:-1]))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield table.slice(0, cut)
        held, n = [table.slice(cut)], table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    release_memory()


def _arrays(shard, *names):
    return {n: shard.column(shard.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names}


def _columns(names, arrays):
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64()) for x in arrays],
                                      names=list(names))


NODE = ("a", "b", "pa", "pb", "depth", "size", "n_convs", "conv_id")


def _enumerate(batches, shard_rows: int):
    """Nodes of each shard: parents, depth, size, member count, smallest member."""
    for shard in _shards(batches, shard_rows):
        x = _arrays(shard, "conv_id", "depth", "size", "a", "b", "pa", "pb")
        a, b = x["a"].view(np.uint64), x["b"].view(np.uint64)
        table = SlotTable(*distinct_keys(a, b))
        slot, n = table(a, b), len(table.a)
        count = np.bincount(slot, minlength=n)
        low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(low, slot, x["conv_id"])
        facts = []
        for name in ("pa", "pb", "depth", "size"):
            flat = np.empty(n, np.int64)
            flat[slot] = x[name]
            if not (flat[slot] == x[name]).all():
                raise ValueError("two prefixes share a digest")
            facts.append(flat)
        yield _columns(NODE, [table.a, table.b, *facts, count, low])


def _accumulate(batches, shard_rows: int, piece_turns: int):
    """Sums over the members of each node: leaves, code points of all and of owned turns below."""
    for shard in _shards(batches, shard_rows):
        info = _arrays(shard, "conv_id", "slot", "depth", "size", "a", "b", "pa", "pb", "upto", "known", "first_own", "leaf",
                       "own_size", "all_size")
        fact = info["known"] == 1              # a conversation's facts, before its prefixes
        at = np.flatnonzero(~fact)
        if not len(at):
            continue
        fact_row = np.maximum.accumulate(np.where(fact, np.arange(len(fact)), -1))[at]
        x = {k: v[at] for k, v in info.items()}
        first_own, leaf, own_size, all_size = (info[k][fact_row] for k in ("first_own", "leaf", "own_size", "all_size"))
        a, b = x["a"].view(np.uint64), x["b"].view(np.uint64)
        piece = x["slot"]
        # links stay inside a piece: a shard may hold a later piece without its first one
        table = SlotTable(*distinct_keys(a, b))
        slot, n = table(a, b), len(table.a)
        flat = {k: np.empty(n, np.int64) for k in ("depth", "size")}
        for k in flat:
            flat[k][slot] = x[k]
        parent = np.full(n, -1, np.int64)
        parent[slot] = table(x["pa"].view(np.uint64), x["pb"].view(np.uint64))
        lowest = np.empty(n, np.int64)
        lowest[slot] = np.where(piece == 0, 0, piece * piece_turns + 1)
        parent[flat["depth"] <= lowest] = -1
        last = np.ones(len(at), bool)
        last[:-1] = (x["conv_id"][1:] != x["conv_id"][:-1]) | (piece[1:] != piece[:-1])
        owned = x["depth"] >= first_own
        count, leaves, whole, mine = (np.zeros(n, np.int64) for _ in range(4))
        end = slot[last]
        np.add.at(count, end, 1)
        np.add.at(leaves, end, leaf[last])
        np.add.at(whole, end, (all_size - x["upto"])[last])
        np.add.at(mine, end, np.where(owned, all_size - x["upto"], own_size)[last])
        np.add.at(mine, slot[owned], x["size"][owned])
        order = np.argsort(-flat["depth"], kind="stable")
        cuts = np.flatnonzero(np.diff(flat["depth"][order])) + 1
        for level in np.split(order, cuts):
            whole[level] += count[level] * flat["size"][level]
            up = level[parent[level] >= 0]
            for total in (count, leaves, whole, mine):
                np.add.at(total, parent[up], total[up])
        yield _columns(("a", "b", "n_leaves", "saved_tokens"), [table.a, table.b, leaves, whole - mine])


# ------------------------------------------------------------ the trie

def _check(column: str):
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(
        F.raise_error(F.lit("two prefixes share a digest")).cast("long")).alias(column)


def nodes_of(path: DataFrame, slot: int = SLOT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    part = _dealt(path, ["depth"], slot).mapInArrow(lambda b: _enumerate(b, shard_rows), ", ".join(f"{c} long" for c in NODE))
    merged = part.groupBy("a", "b").agg(*[_check(c) for c in ("pa", "pb", "depth", "size")], F.sum("n_convs").alias("n_convs"),
                                        F.min("conv_id").alias("conv_id"))
    return stage(merged, "trie-merged")


def _parent_ids(nodes: DataFrame) -> DataFrame:
    """Adds ``parent_conv_id``. Children of very wide nodes meet them by broadcast."""
    wide = nodes.where(F.col("n_children") * HOT_SHARE > nodes.count())     # fewer than HOT_SHARE nodes
    wide = F.broadcast(wide.select(F.col("a").alias("wa"), F.col("b").alias("wb"), F.col("conv_id").alias("wide_id")))
    hot = (F.col("pa") == F.col("wa")) & (F.col("pb") == F.col("wb")) & (F.col("depth") > 0)
    rows = nodes.join(wide, hot, "left").drop("wa", "wb")
    done = F.col("wide_id").isNotNull() | (F.col("depth") == 0)
    parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    near = rows.where(~done).join(parents, ["pa", "pb"], "left").drop("wide_id")
    return near.unionByName(rows.where(done).withColumnRenamed("wide_id", "parent_conv_id"))


def build(conversations: DataFrame, slot: int = SLOT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    turns = numbered_turns(conversations)
    rebuilt = rebuilt_turns(turns, slot)
    path = prefixes(rebuilt, slot)
    merged = nodes_of(path, slot, shard_rows)
    children = merged.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = stage(merged.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("first_own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"),
                                          F.sum("size").alias("own_size"))
    sizes = path.groupBy("conv_id").agg(F.sum("size").alias("all_size"), F.max("total").alias("total"))
    facts = sizes.join(owners, "conv_id", "left").select(
        "conv_id", "all_size", F.coalesce("first_own", F.lit((1 << 62))).alias("first_own"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.coalesce("own_size", F.lit(0)).alias("own_size"),
        F.explode(F.sequence(F.lit(0), _slot(F.greatest(F.col("total") - 1, F.lit(0)), slot))).alias("k"))
    zero = F.lit(0).cast("long")
    # the facts of a conversation come before each of its pieces: an ordinary sort brings them together
    facts = facts.select("conv_id", F.when(F.col("k") == 0, 0).otherwise(F.col("k") * slot + 1).alias("depth"),
                         *[zero.alias(c) for c in PATH[2:]], F.lit(1).cast("long").alias("known"), "first_own", "leaf", "own_size", "all_size")
    rows = path.select(*PATH, zero.alias("known"), *[zero.alias(c) for c in ("first_own", "leaf", "own_size", "all_size")])
    sums = (_dealt(facts.unionByName(rows), [F.col("known").desc(), "depth"], slot)
            .mapInArrow(lambda b: _accumulate(b, shard_rows, slot), "a long, b long, n_leaves long, saved_tokens long").groupBy("a", "b")
            .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    ends = path.where("depth = total").select("a", "b", "conv_id", F.col("conv_id").cast("string").alias("id"))
    digests = sha256_runs(ends, ["a", "b"], ["conv_id"], "id")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = (_parent_ids(nodes).join(sums, ["a", "b"]).join(digests, ["a", "b"], "left")
           .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                   F.coalesce("sha256", nothing).alias("ends_sha256")))
    out = stage(out, "trie-result")
    unstage(turns, rebuilt, path, merged, nodes, digests)
    return out


def report(conversations: DataFrame) -> DataFrame:
    return build(conversations)


# A prefix is spelled by the digests of its turns here, so ancestors are its left parts.
SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
own AS (
  SELECT conv_id, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS t, length(coalesce(text, '')) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, {crc_sql("k")} % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS k FROM own), tab),
turns AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.t, o.size FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, o.t, o.size FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h
  UNION ALL
  SELECT conv_id, -1, 0, '', 0 FROM convs),
paths AS (
  SELECT conv_id, size, row_number() OVER w - 1 AS depth, string_agg(t, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix,
         lead(t) OVER w IS NULL AS ends FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY prefix, depth),
kids AS (SELECT left(prefix, length(prefix) - 32) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT left(n.prefix, 32 * CAST(a AS BIGINT)) AS prefix, sum((n.n_convs - 1) * n.size) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM nodes) n LEFT JOIN kids k ON k.prefix = n.prefix GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.prefix = n.prefix LEFT JOIN kids k ON k.prefix = n.prefix
LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = left(n.prefix, length(n.prefix) - 32)
"""
