"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a seeded shuffle, offered
``max_epochs`` times. A document copy gets the virtual finish time
``words served by its source so far / target of the source``; all copies are
put in that order and the mix is the prefix that fits the total budget. Every
source therefore advances at its own rate and reaches its target at virtual
time 1, whatever the order of the input.

Defined results: null text has size 0; a null source is a source of its own
(last in order); repeated rows are separate documents; an empty table gives an
empty mix; a source without words has target 0 and its documents are taken 0
words (one copy in ``mix``). Extra columns are passed through by ``mix``. Of a text only
its size is used. Rows that share a doc_id (or have none) share one piece of the order, which
one task sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import running_sum, stage

WORD = r"[^\x20\x09-\x0D]+"
SLOT_DIGITS = 3                # 16^3 pieces of a source's order
FINISH_SLOTS = 4096            # pieces of one unit of virtual time


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """One row per source: rank, weight, source_size, target.

    ``share`` of all words is split by weight; a target stops at ``max_epochs``
    times the source's size and the excess is reshared by weight. With the
    sources ordered by cap / weight, the rate that fills the budget follows
    from the sums before and after each source, so no loop is needed. The
    window runs over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                        (F.col("source_rank") % len(weights) + 1).cast("int"))
    per = (per.withColumn("source_rank", F.row_number().over(
               one.orderBy(F.col("source").asc_nulls_last())) - 1)
           .withColumn("weight", pick)
           .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(one))
           .withColumn("cap", F.lit(int(max_epochs)) * F.col("source_size")))
    by_cap = one.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("rate", (F.col("budget") - before) / rest)
    fill = F.min(F.when(F.col("rate") <= F.col("cap") / F.col("weight"),
                        F.struct(F.col("cap") / F.col("weight"), "source_rank", "rate"))).over(one)["rate"]
    cap = F.col("cap").cast("double")
    return per.select("source", "source_rank", "weight", "source_size", "budget",
                      F.coalesce(F.least(cap, fill * F.col("weight")), cap).alias("target"))


def schedule(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: int = 2,
             seed: str = "mix") -> DataFrame:
    """``docs`` columns ``_id, _rk, source, size`` plus source_size, target, copies."""
    order = F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":" + seed)))
    docs = stage(docs.withColumn("_order", order), "mix-docs")
    targets = source_targets(docs, weights, share, max_epochs)
    queue = running_sum(docs, ["source"], ["_order", "_id", "_rk"], "size",
                        F.substring("_order", 1, SLOT_DIGITS), "served")
    t = targets.withColumnRenamed("source", "_source")
    queue = stage(queue.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "mix-queue")
    finish = [F.when(F.col("target") > 0, (F.col("served") + e * F.col("source_size")) / F.col("target"))
              for e in range(max_epochs)]
    rank = [F.struct(finish[e].alias("f"), F.col("source_rank").alias("r"), F.lit(e).alias("e"),
                     F.col("_order").alias("o"), F.col("_id").alias("i"), F.col("_rk").alias("k"))
            for e in range(max_epochs)]
    offers = (queue.where("size > 0 AND target > 0")
              .select("size", "budget", F.explode(F.array(*rank)).alias("at")))
    served = running_sum(offers, [], ["at"], "size",
                         F.floor(F.col("at.f") * FINISH_SLOTS), "total")
    last = served.where("total <= budget").agg(F.max("at").alias("at")).first()["at"]
    if last is None:
        taken = F.lit(0)
    else:
        cut = F.struct(F.lit(last.f).alias("f"), F.lit(last.r).alias("r"), F.lit(last.e).alias("e"),
                       F.lit(last.o).alias("o"), F.lit(last.i).cast("long").alias("i"),
                       F.lit(last.k).cast("long").alias("k"))
        taken = sum((F.when((F.col("size") > 0) & (F.col("target") > 0) & (r <= cut), 1).otherwise(0)
                     for r in rank), F.lit(0))
    return queue.withColumn("copies", taken.cast("long")).withColumn("finish", finish[0])


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_id"),
                       F.xxhash64("doc_id", "text").alias("_rk"), "source",
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: size, its source's size and target, words taken."""
    s = schedule(_sizes(docs), **options)
    return s.select(F.col("_id").alias("doc_id"), "size", F.col("source_size").cast("long"), "target",
                    (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: each taken copy of each document, all input columns.

    A document without words costs nothing and stays once. Rows come range
    sorted by virtual finish time of their first copy; the copies of a row
    follow each other's epochs in the schedule, not in the file. Rows equal in
    doc_id, text and source share the copies that the schedule gives their group:
    where the budget cuts a group, its first rows get more than the others.
    """
    epochs = options.get("max_epochs", 2)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    least = [F.count_if(copies >= e) for e in range(1, epochs + 1)]
    groups = schedule(_sizes(docs), **options).groupBy(
        F.col("_id").alias("_sid"), F.col("_rk").alias("_srk"), F.col("source").alias("_ssource")).agg(
        F.min("finish").alias("finish"), F.count(F.lit(1)).alias("_n"), F.array(*least).alias("_least"))
    groups = stage(groups.where("_least[0] > 0"), "mix-groups")
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_mid"),
                      F.xxhash64("doc_id", "text").alias("_mrk"), F.col("source").alias("_msource"))
    same = (F.col("_mid").eqNullSafe(F.col("_sid")) & (F.col("_mrk") == F.col("_srk"))
            & F.col("_msource").eqNullSafe(F.col("_ssource")))
    split = F.exists("_least", lambda x: (x > 0) & (x < F.col("_n")))
    even = own.join(groups.where(~split), same).withColumn("_place", F.lit(1).cast("long"))
    # a source's queue has one place at the cut for each epoch, so few groups are split by it
    among = Window.partitionBy("_mid", "_mrk", "_msource").orderBy(F.xxhash64(F.to_json("_row")))
    cut = own.join(F.broadcast(groups.where(split)), same).withColumn("_place", F.row_number().over(among).cast("long"))
    taken = F.size(F.filter("_least", lambda x: x >= F.col("_place")))
    kept = even.unionByName(cut).withColumn("_copies", taken).where("_copies > 0")
    return (kept.repartitionByRange(F.col("finish"), F.col("_mid")).sortWithinPartitions("finish", "_mid")
            .withColumn("_epoch", F.explode(F.expr("sequence(1, _copies)"))).select("_row.*"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS o
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r
  FROM docs GROUP BY source),
capped AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget, 2 * source_size AS cap
  FROM per),
rated AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
         (budget - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, r
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, r
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate
  FROM capped),
fill AS (SELECT rate FROM rated WHERE rate <= ratio ORDER BY ratio, r LIMIT 1),
targets AS (
  SELECT source, r, source_size, budget,
         coalesce(least(CAST(cap AS DOUBLE), (SELECT rate FROM fill) * weight), CAST(cap AS DOUBLE)) AS target
  FROM rated),
queue AS (
  SELECT d.doc_id, d.size, d.o, t.r, t.source_size, t.budget, t.target,
         sum(d.size) OVER (PARTITION BY t.r ORDER BY d.o, d.doc_id ROWS UNBOUNDED PRECEDING) AS served
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
offers AS (
  SELECT doc_id, size, o, r, budget, e,
         CAST(served + e * source_size AS DOUBLE) / target AS f
  FROM queue, (VALUES (0), (1)) AS v(e) WHERE size > 0 AND target > 0),
ranked AS (
  SELECT *, sum(size) OVER (ORDER BY f, r, e, o, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM offers),
picked AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM ranked WHERE total <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(p.taken, 0) AS taken
FROM queue q LEFT JOIN picked p ON q.doc_id = p.doc_id
"""
