"""Toxic passages by maximum-scoring segments of word log-odds.

Learning (labels of the training folds only, at most ``sample_rows`` labelled
texts drawn by hash order, rows that repeat id and text once):

1. the units of a word are the word itself and its beginnings (compounds of one
   stem share them). Documents per unit are counted among toxic and other sample
   documents; the frequency of the candidate units over ALL documents is the
   Dirichlet prior. The score of a unit is its log-odds with that prior, kept if
   its z-value is high enough; a word scores as its best unit;
2. every word then costs ``word_cost``; the smoothed frequencies of clean text
   give the decay rate of chance segments (root of sum p * exp(rate * score) = 1);
3. on a fold of the sample that gave no counts, the best segments of documents
   labelled clean give the scale of the extreme-value law
   ``P(S > x) = 1 - exp(-scale * n * exp(-rate * x))``, and a logistic curve over
   the extreme-value scores gives the probability of the label.

Scoring reads each whole text once: words, their scores, and all maximal
scoring segments in one linear pass (Ruzzo and Tompa) over the scored words; a
segment is a passage if its expected number by chance is below ``max_expected``.
The model (at most ``model_units`` units, those of the highest share of toxic documents
before the z-value test) is the only thing sent to tasks.

Defined results: null and empty texts have no words and get the score of a text
without evidence; repeated rows get equal scores; a null doc_id counts as the
empty string in the fold rule; without any training label every score is 0; an
empty table gives no rows. Label, language, source and doc_id are no inputs of a
score; extra columns are ignored. A text is hashed in one piece: one text of 32 MB takes
about 1.3 GB of its Python worker (measured in `jaccard`), so the longest text bounds the worker.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import RangeHash, as_long, byte_class, keyed, mix64, stage, text_blocks, word_spans

WORD_BYTES = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
FOLDS = 5                       # fold 0 is held out, fold 4 calibrates, the others count


def fold(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


BEGINNINGS = (5, 6, 7, 8, 9, 10)      # bytes


def word_units(block) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Owner of each word, hashes of its units (0: none), and the word hashes."""
    starts, ends, owner = word_spans(block, WORD_BYTES)
    if not len(starts):
        z = np.zeros(0, np.uint64)
        return owner, [z] * (len(BEGINNINGS) + 1), z
    ranges = RangeHash(block.data, fold=True)
    word = mix64(ranges(starts, ends) ^ np.uint64(0x5EED))
    units = [word]
    for k in BEGINNINGS:
        unit = np.zeros(len(starts), np.uint64)
        longer = np.flatnonzero(ends - starts > k)
        unit[longer] = ranges(starts[longer], starts[longer] + k)
        units.append(unit)
    return owner, units, word


@dataclass
class Model:
    units: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))   # sorted hashes
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    word_cost: float = 0.25
    rate: float = 1.0
    scale: float = 1.0
    curve: np.ndarray | None = None       # logistic weights over ``features``
    max_expected: float = 0.01

    def hits(self, block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner of every word; places and scores of the scored ones."""
        owner, units, word = word_units(block)
        if not len(self.units) or not len(word):
            return owner, np.zeros(0, np.int64), np.zeros(0)
        _, first, back = np.unique(word, return_index=True, return_inverse=True)
        best = np.zeros(len(first))
        for unit in units:
            at, found = _find(self.units, unit[first])
            best[found] = np.maximum(best[found], self.scores[at])
        score = best[back]
        place = np.flatnonzero(score > 0)
        return owner, place, score[place]

    def surprise(self, score, n: int):
        """-ln of the expected number of chance segments as good as ``score``."""
        return self.rate * score - math.log(max(self.scale * n, 1e-12))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the sorted ``table`` and in ``keys`` of the keys it holds."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    found = np.flatnonzero(table[at] == keys)
    return at[found], found


def _incidence(owner: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, unit) pairs, sorted by unit."""
    order = np.lexsort((owner, unit))
    owner, unit = owner[order], unit[order]
    new = np.ones(len(unit), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], unit[new]


def maximal_segments(place: np.ndarray, score: np.ndarray, cost: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last place) of a text.

    ``place`` are the indexes of words with a score; every word costs ``cost``.
    One pass with a stack; a run of unscored words is one negative step.
    """
    # total before, total after, first, last, entry below with a smaller total before
    stack: list[tuple[float, float, int, int, int]] = []
    total, previous = 0.0, -1
    for p, s in zip(place.tolist(), score.tolist(), strict=True):
        total -= cost * (p - previous - 1)
        before, total, previous = total, total + s - cost, p
        if total <= before:
            continue
        left, right, first = before, total, p
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, p, j))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(r - l, a, b) for l, r, a, b, _ in stack]


def features(model: Model, segments: list[tuple[float, int, int]], n: int) -> tuple[float, float, int]:
    """Extreme-value score of the best segment, summed excess, number of passages."""
    if not segments or n == 0:
        return 0.0, 0.0, 0
    surprise = [model.surprise(s, n) for s, _, _ in segments]
    limit = -math.log(model.max_expected)
    good = [x for x in surprise if x >= limit]
    return max(0.0, max(surprise)), sum(good), len(good)


def _design(best, total, passages) -> np.ndarray:
    best, total = np.asarray(best, float), np.asarray(total, float)
    return np.stack([np.ones(len(best)), np.minimum(best, 30) / 10, (best > 0).astype(float),
                     np.log1p(total) / 5, np.log1p(np.asarray(passages, float))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


_FEATURE_SQL = "doc_id long, toxic int, n long, best double, total double, passages int, spans string, raw double"
_FEATURES = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("n", pa.int64()), ("best", pa.float64()),
                       ("total", pa.float64()), ("passages", pa.int32()), ("spans", pa.string()),
                       ("raw", pa.float64())])


def _scan(texts: DataFrame, model: Model) -> DataFrame:
    """Segment features of each row of ``texts`` (doc_id, toxic, text)."""

    def scan(batches):
        for block in text_blocks(batches):
            owner, place, score = model.hits(block)
            rows = block.rows.num_rows
            count = np.bincount(owner, minlength=rows)
            base = np.cumsum(count) - count
            cut = np.searchsorted(owner[place], np.arange(rows + 1)) if len(place) else np.zeros(rows + 1, int)
            best, total, raw = np.zeros(rows), np.zeros(rows), np.zeros(rows)
            passages, spans = np.zeros(rows, np.int32), [""] * rows
            limit = -math.log(model.max_expected)
            for r in np.flatnonzero(np.diff(cut)):
                p = place[cut[r]:cut[r + 1]] - base[r]
                found = maximal_segments(p, score[cut[r]:cut[r + 1]], model.word_cost)
                n = int(count[r])
                best[r], total[r], passages[r] = features(model, found, n)
                raw[r] = max((s for s, _, _ in found), default=0.0)
                spans[r] = ",".join(f"{a}:{b + 1}" for s, a, b in found if model.surprise(s, n) >= limit)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), block.rows.column(1), pa.array(count.astype(np.int64)), pa.array(best),
                 pa.array(total), pa.array(passages), pa.array(spans, pa.string()), pa.array(raw)],
                schema=_FEATURES)

    return texts.select("doc_id", "toxic", "text").mapInArrow(scan, _FEATURE_SQL)


def _unit_counts(texts: DataFrame) -> DataFrame:
    """unit, n_toxic, n_clean: documents of the sample that hold a unit."""

    def count(batches):
        for block in text_blocks(batches):
            owner, units, _ = word_units(block)
            toxic = block.column("toxic")
            for unit in units:
                real = unit != 0
                o, u = _incidence(owner[real], unit[real])
                if not len(u):
                    continue
                head = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                bad = np.add.reduceat(toxic[o].astype(np.int64), head)
                every = np.diff(np.r_[head, len(u)])
                yield pa.RecordBatch.from_arrays([pa.array(as_long(u[head])), pa.array(bad), pa.array(every - bad)],
                                                 names=["unit", "n_toxic", "n_clean"])

    return (texts.select("toxic", "text").mapInArrow(count, "unit long, n_toxic long, n_clean long")
            .groupBy("unit").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean")))


def _background(texts: DataFrame, table: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that hold each candidate unit, and (document, unit) pairs, over all texts."""

    def count(batches):
        counts, everything = np.zeros(len(table), np.int64), 0
        for block in text_blocks(batches):
            owner, units, word = word_units(block)
            if not len(word):
                continue
            _, first, back = np.unique(word, return_index=True, return_inverse=True)
            pairs = np.unique(owner * len(first) + back)
            own, kind = pairs // len(first), pairs % len(first)
            for unit in units:
                u = unit[first]
                everything += int((u[kind] != 0).sum())
                at, found = _find(table, u)
                place = np.full(len(first), -1)
                place[found] = at
                hit = place[kind] >= 0
                _, held = _incidence(own[hit], place[kind[hit]])
                counts += np.bincount(held, minlength=len(table))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[everything, counts[some]])],
                                         names=["place", "n"])

    rows = (texts.select("text").mapInArrow(count, "place long, n long")
            .groupBy("place").agg(F.sum("n").alias("n")).collect())      # at most model_units + 1 rows
    out, everything = np.zeros(len(table), np.int64), 0
    for r in rows:
        if r["place"] < 0:
            everything = r["n"]
        else:
            out[r["place"]] = r["n"]
    return out, everything


def _rate(frequency: np.ndarray, score: np.ndarray, cost: float) -> float:
    """Positive root of E[exp(rate * step)] = 1 under corpus frequencies."""
    rest = 1 - frequency.sum()

    def excess(x):
        return (frequency * np.exp(np.minimum(x * (score - cost), 700))).sum() + rest * math.exp(-x * cost) - 1

    low, high = 1e-6, 1e-6
    while excess(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(low, 1e-3)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, model_units: int = 65_536,
          min_toxic: int = 4, prior_share: float = 0.1, min_z: float = 3.0, word_cost: float = 0.25,
          max_expected: float = 0.01) -> Model:
    """Fit the model; ``labels`` (doc_id, toxic) outside the training folds are not read.

    ``prior_share``: weight of the corpus prior against the sample's counts.
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    base = keyed(docs)
    # an id may stand on many rows: the bound holds for different texts, each taken once
    drawn = (base.select("doc_id", "rk").join(F.broadcast(known), "doc_id").groupBy("doc_id", "rk").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id", "rk").limit(sample_rows))
    sample = stage(base.join(F.broadcast(drawn.withColumnsRenamed({"doc_id": "_id", "rk": "_rk"})),
                             (F.col("doc_id") == F.col("_id")) & (F.col("rk") == F.col("_rk")))
                   .groupBy("doc_id", "rk").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).drop("rk"), "toxic-sample")
    model = Model(word_cost=word_cost, max_expected=max_expected)
    learn = sample.where(fold(F.col("doc_id")) != FOLDS - 1)
    counts = stage(_unit_counts(learn), "toxic-units")
    sums = counts.agg(F.sum("n_toxic"), F.sum("n_clean")).first()
    n_toxic, n_clean = sums[0] or 0, sums[1] or 0
    share = F.col("n_toxic") / (F.col("n_clean") + F.lit(1))
    top = (counts.where((F.col("n_toxic") >= min_toxic) & (share * n_clean > n_toxic))
           .orderBy(F.desc(share), "unit").limit(model_units).collect())
    if n_toxic and n_clean and top:
        top.sort(key=lambda r: r["unit"] & ((1 << 64) - 1))
        table = np.array([r["unit"] for r in top], np.int64).view(np.uint64)
        yt = np.array([r["n_toxic"] for r in top], float)
        yc = np.array([r["n_clean"] for r in top], float)
        seen, everything = _background(base, table)
        prior = prior_share * (n_toxic + n_clean)
        a = prior * np.maximum(seen, 1) / max(everything, 1)
        at, ac = yt + a, yc + a
        odds = np.log(at / (n_toxic + prior - at)) - np.log(ac / (n_clean + prior - ac))
        keep = (odds / np.sqrt(1 / at + 1 / ac) >= min_z) & (odds > word_cost)
        model.units, model.scores = table[keep], odds[keep]
        if keep.any():
            model.rate = _rate(ac[keep] / (n_clean + prior), model.scores, word_cost)
    judged = _scan(sample.where(fold(F.col("doc_id")) == FOLDS - 1), model)
    cal = judged.select("toxic", "n", "raw").collect()                       # at most sample_rows rows
    clean = [(r["n"], r["raw"]) for r in cal if r["toxic"] == 0 and r["n"] > 0]
    if clean:
        n, x = np.array(clean, float).T
        model.scale = len(n) / (n * np.exp(-model.rate * x)).sum()
    if cal:
        seen = _scan(sample.where(fold(F.col("doc_id")) == FOLDS - 1), model).select(
            "toxic", "best", "total", "passages").collect()
        x = _design([r["best"] for r in seen], [r["total"] for r in seen], [r["passages"] for r in seen])
        model.curve = _logistic(x, np.array([r["toxic"] for r in seen], float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages, spans (word ranges of the passages) per row of ``docs``."""
    seen = _scan(keyed(docs).select("doc_id", F.lit(0).alias("toxic"), "text"), model)
    return seen.select("doc_id", _probability(model).alias("score"), "passages", "spans")


def _probability(model: Model):
    if model.curve is None:
        return F.lit(0.0)
    w = [float(x) for x in model.curve]
    z = (F.lit(w[0]) + w[1] * F.least(F.col("best"), F.lit(30.0)) / 10 + w[2] * F.when(F.col("best") > 0, 1.0).otherwise(0.0)
         + w[3] * F.log1p("total") / 5 + w[4] * F.log1p(F.col("passages").cast("double")))
    return 1 / (1 + F.exp(-z))


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    model = train(docs, labels, **options)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages", "spans")


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` scored below one half, all columns kept."""
    model = train(docs, labels, **options)
    bad = (_scan(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), F.lit(0).alias("toxic"),
                             F.coalesce("text", F.lit("")).alias("text")), model)
           .where(_probability(model) >= 0.5).select(F.col("doc_id").alias("_bad")).distinct())
    own = docs.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", "text").alias("_key"))
    return own.join(bad, F.col("_key") == F.col("_bad"), "left_anti").select("_row.*")
