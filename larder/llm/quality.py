"""Quality rules with adaptive thresholds, all in DataFrame functions.

Fixed rules (``base_failed``) look at one text alone. The adaptive part replaces
further fixed cutoffs by fences learned from the corpus:

* four ratios of every text (``METRICS``) go into one quantile sketch per language,
  source and metric. The sketch is a log-linear histogram: a value keeps its seven
  leading bits, so a quantile is known to within 1/64 of itself. Sketches merge by
  adding their counts, which is exact and independent of order, and a group of any
  size is pre-aggregated by the tasks that read it;
* sketches of a language and of everything are merged from those of its groups. A
  group of fewer than ``LEAST_GROUP`` texts uses its language, a small language all;
* a fence lies ``REACH`` interquartile ranges beyond the quartiles, a range counting
  as at least the metric's ``slack``, so that a uniform group does not reject
  ordinary variation;
* the fences join the measured texts on language and source.

A text is measured inside its own row, without a shuffle. A text of more than
``LONG_TEXT`` code points is cut into rows of 128 words and of 128 lines instead and
gives the same numbers, so no task holds the words of a very long text as one array.

Defined results: a null text has no words and fails the fixed rules; a null language
or source is a group of its own; repeated rows are judged alike; ties at a fence are
kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import stage, unstage

SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
LONG_TEXT = 1 << 20            # code points; longer texts are measured in rows
PIECE = 128                    # words or lines of such a row
LEAST_GROUP = 100
REACH = 3
KEPT_BITS = 7                  # leading bits a sketch keeps of a value
BROADCAST_GROUPS = 10_000      # fences of more groups join by a salted shuffle
SALTS = 16

# metric: (numerator, denominator, scale, slack, has a lower fence). Five lines are
# added, so that one repeated line does not decide a text of a few lines.
METRICS = {
    "word_length": ("word_chars", "n_words", 100, 50, True),
    "symbol_share": ("n_symbols", "n_words", 10_000, 300, False),
    "dup_line_share": ("n_dup_lines", "(n_lines + 5)", 10_000, 500, False),
    "repeat_share": ("n_repeat_words", "n_words", 10_000, 500, False),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def _windows(words: Column, first_only: Column | None = None) -> Column:
    """Hashes of the runs of ``WINDOW`` words (those that start before ``first_only``)."""
    def of(h):
        last = F.size(h) - WINDOW
        if first_only is not None:
            last = F.least(last, first_only - 1)
        runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))
        return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>"))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _covered(starts: Column) -> Column:
    """Words covered by windows at the ascending ``starts``."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(starts, zero, lambda a, x: F.struct(
        (x + WINDOW).alias("end"), (a["n"] + x + WINDOW - F.greatest(a["end"], x)).alias("n")), lambda a: a["n"])


def _repeated_words(words: Column) -> Column:
    def count(runs):
        pairs = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = _let(pairs, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(
            (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())))
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), 0).otherwise(_covered(starts))
    return _let(_windows(words), count)


def _measure_in_rows(docs: DataFrame) -> DataFrame:
    """The counts of texts that fit one row."""
    def of(words):
        chars = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))
        return F.struct(F.size(words).alias("n_words"), chars.alias("word_chars"),
                        _repeated_words(words).alias("n_repeat_words"))

    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD_CHAR))
    symbols = F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))
    out = docs.select("doc_id", "lang", "source", _let(_words(F.col("text")), of).alias("w"), symbols.alias("n_symbols"),
                      _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("u"))).alias("l"))
    return out.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", F.col("l.n").alias("n_lines"),
                      (F.col("l.n") - F.col("l.u")).alias("n_dup_lines"), "w.n_repeat_words")


def _measure_long(docs: DataFrame) -> DataFrame:
    """The same counts from rows of ``PIECE`` words or lines of a text."""
    word = rf"{WORD_CHAR}++[\x20\x09-\x0D]*+"
    pieces = F.regexp_extract_all("text", F.lit(rf"(?:{word}){{1,{PIECE}}}+"), F.lit(0))
    ahead = rf"^(?:{word}){{0,{WINDOW - 1}}}+"
    rows = docs.select("uid", F.explode(_let(pieces, lambda p: F.transform(p, lambda c, i: F.struct(
        i.alias("i"), c.alias("own"), F.regexp_extract(F.coalesce(F.get(p, i + 1), F.lit("")), ahead, 0).alias("next"))))).alias("p"))
    rows = rows.select("uid", "p.i", _words(F.col("p.own")).alias("own"), _words(F.concat("p.own", "p.next")).alias("words"))
    chars = F.aggregate("own", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))
    counts = rows.groupBy("uid").agg(F.sum(F.size("own")).alias("n_words"), F.sum(chars).alias("word_chars"))
    runs = rows.select("uid", "i", F.posexplode(_windows(F.col("words"), F.size("own"))).alias("k", "h"))
    runs = runs.select("uid", "h", (F.col("i") * PIECE + F.col("k")).alias("at"))
    found = runs.withColumn("n", F.count("*").over(Window.partitionBy("uid", "h"))).where("n > 1")
    before = F.lag("at").over(Window.partitionBy("uid").orderBy("at"))
    covered = (found.withColumn("gap", F.least(F.lit(WINDOW), F.coalesce(F.col("at") - before, F.lit(WINDOW))))
               .groupBy("uid").agg(F.sum("gap").alias("n_repeat_words")))
    chunks = F.regexp_extract_all("text", F.lit(rf"(?:[^\n]*+\n){{1,{PIECE}}}+|[^\n]++"), F.lit(0))
    lines = (docs.select("uid", F.explode(chunks).alias("c")).select("uid", F.explode(F.split("c", "\n", -1)).alias("line"))
             .where(F.col("line").rlike(WORD_CHAR)).groupBy("uid", F.sha2("line", 256).alias("line")).agg(F.count("*").alias("n")))
    lines = lines.groupBy("uid").agg(F.sum("n").alias("n_lines"), F.sum(F.col("n") - 1).alias("n_dup_lines"))
    symbols = F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))
    out = docs.select("uid", "doc_id", "lang", "source", symbols.alias("n_symbols"))
    for part in (counts, covered, lines):
        out = out.join(part, "uid", "left")
    return out.drop("uid").na.fill(0, list(COUNTS))


def measure(docs: DataFrame, long_text: int = LONG_TEXT) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every text, staged."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source",
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = F.length("text")
    long = stage(docs.where(size > long_text).withColumn("uid", F.monotonically_increasing_id()), "quality-long")
    both = [x.select("doc_id", "lang", "source", *[F.col(c).cast("long").alias(c) for c in COUNTS])
            for x in (_measure_in_rows(docs.where(size <= long_text)), _measure_long(long))]
    out = stage(both[0].unionAll(both[1]), "quality-counts")
    unstage(long)
    return out


def _value(metric: str) -> Column:
    above, below, scale, _, _ = METRICS[metric]
    return F.when(F.col("n_words") > 0, F.expr(f"({scale} * {above}) div {below}"))


def sketches(measured: DataFrame) -> DataFrame:
    """Bin counts: ``lang, source, metric, bin, n``; a bin is named by its least value."""
    rows = measured.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), _value(m).alias("v")) for m in METRICS])).alias("x"))
    rows = rows.select("lang", "source", "x.metric", "x.v").where("v IS NOT NULL")
    width = F.pow(F.lit(2), F.greatest(F.length(F.bin("v")) - KEPT_BITS, F.lit(0))).cast("long")
    return rows.groupBy("lang", "source", "metric", (F.col("v") - F.col("v") % width).alias("bin")).agg(F.count("*").alias("n"))


def quartiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged to ``keys``: ``n, q1, q3`` of each metric."""
    merged = bins.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    merged = merged.withColumn("upto", upto).withColumn("all", F.sum("n").over(group))
    return merged.groupBy(*keys, "metric").agg(
        F.max("all").alias("n"), F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("bin"))).alias("q3"))


def fences(bins: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """One row per language and source: ``low_<metric>`` and ``high_<metric>``."""
    levels = {"s": ["lang", "source"], "l": ["lang"], "a": []}
    out = None
    for tag, keys in levels.items():
        part = quartiles(bins, keys).select(*[F.col(k).alias(f"{tag}_{k}") for k in keys], F.col("metric").alias(f"{tag}_metric"),
                                            F.struct("n", "q1", "q3").alias(tag))
        if out is None:
            out = part.select(F.col("s_lang").alias("lang"), F.col("s_source").alias("source"), F.col("s_metric").alias("metric"), "s")
            continue
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{tag}_{k}")) for k in [*keys, "metric"]])
        out = out.join(part, same).drop(*[f"{tag}_{k}" for k in [*keys, "metric"]])
    used = F.when(F.col("s.n") >= least_group, F.col("s")).when(F.col("l.n") >= least_group, F.col("l")).otherwise(F.col("a"))
    out = out.select("lang", "source", "metric", used.alias("u"))
    slack = F.create_map(*[F.lit(x) for m, v in METRICS.items() for x in (m, v[3])])
    reach = REACH * F.greatest(F.col("u.q3") - F.col("u.q1"), slack[F.col("metric")])
    # the upper end of a bin counts as its value: the sketch's error never rejects a text
    out = out.select("lang", "source", "metric", (F.col("u.q1") - reach).alias("low"),
                     (F.expr("u.q3 + u.q3 div 64") + reach).alias("high"))
    pick = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}") for m in METRICS for c in ("low", "high")]
    return out.groupBy("lang", "source").agg(*pick)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept``; ``limits`` is joined on language and source."""
    lim = stage(limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                              *[c for c in limits.columns if c not in ("lang", "source")]), "quality-fences")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    if lim.count() <= BROADCAST_GROUPS:
        rows = measured.join(F.broadcast(lim), same, "left")
    else:            # a source may hold a third of the rows: its rows are dealt over salted copies of its fences
        lim = lim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALTS)))
        rows = salted.join(lim, same & (F.col("salt") == F.col("_salt")), "left").drop("salt", "_salt")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    inside = F.lit(True)
    for metric, (_, _, _, _, lower) in METRICS.items():
        v = F.coalesce(_value(metric), F.lit(0))
        inside = inside & F.coalesce(v <= F.col(f"high_{metric}"), F.lit(True))
        if lower:
            inside = inside & F.coalesce(v >= F.col(f"low_{metric}"), F.lit(True))
    return rows.select(*measured.columns, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def judged(docs: DataFrame, long_text: int = LONG_TEXT) -> DataFrame:
    """Every document's counts and verdict."""
    measured = measure(docs, long_text)
    return judge(measured, fences(sketches(measured)))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                               "base_failed", "kept")


def _sql() -> str:
    values = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, {s} * {a} // {b} AS v, {k} AS slack FROM counts WHERE n_words > 0"
                                for m, (a, b, s, k, _) in METRICS.items())
    levels = []
    for tag, keys in (("s", "lang, source"), ("l", "lang"), ("a", "")):
        by = f"{keys}, metric" if keys else "metric"
        levels.append(f"""
{tag}_run AS (SELECT {by}, bin, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}) AS total
  FROM (SELECT {by}, bin, sum(n) AS n FROM bins GROUP BY {by}, bin)),
{tag}_q AS (SELECT {by}, max(total) AS n, min(bin) FILTER (upto * 4 >= total) AS q1, min(bin) FILTER (upto * 4 >= total * 3) AS q3
  FROM {tag}_run GROUP BY {by})""")
    pick = "CASE WHEN s.n >= {g} THEN s.{c} WHEN l.n >= {g} THEN l.{c} ELSE a.{c} END"
    q1, q3 = (pick.format(g=LEAST_GROUP, c=c) for c in ("q1", "q3"))
    lower = ", ".join(f"'{m}'" for m, v in METRICS.items() if v[4])
    return rf"""
WITH docs AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
keyed AS (SELECT *, row_number() OVER () AS u FROM docs),
runs AS (SELECT u, i, array_to_string(w[i:i + 7], ' ') AS run FROM (SELECT u, w, unnest(range(1, len(w) - 6)) AS i FROM keyed WHERE len(w) >= 8)),
again AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, run) AS n FROM runs) WHERE n > 1),
covered AS (SELECT u, sum(least(8, coalesce(i - before, 8))) AS n
  FROM (SELECT u, i, lag(i) OVER (PARTITION BY u ORDER BY i) AS before FROM again) GROUP BY u),
counts AS (
  SELECT k.u, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM keyed k LEFT JOIN covered c ON c.u = k.u),
vals AS (SELECT x.*, c.u FROM ({values.replace("SELECT doc_id,", "SELECT u AS uu, doc_id,")}) x JOIN counts c ON c.u = x.uu),
bins AS (SELECT lang, source, metric, v - v % CAST(pow(2, greatest(length(bin(v)) - {KEPT_BITS}, 0)) AS BIGINT) AS bin, count(*) AS n
  FROM vals GROUP BY ALL),{",".join(levels)},
used AS (SELECT x.u, x.metric, x.v, x.slack, {q1} AS q1, {q3} AS q3
  FROM vals x JOIN s_q s ON s.lang IS NOT DISTINCT FROM x.lang AND s.source IS NOT DISTINCT FROM x.source AND s.metric = x.metric
  JOIN l_q l ON l.lang IS NOT DISTINCT FROM x.lang AND l.metric = x.metric JOIN a_q a ON a.metric = x.metric),
verdict AS (SELECT u, bool_and(v <= q3 + q3 // 64 + {REACH} * greatest(q3 - q1, slack)
    AND (metric NOT IN ({lower}) OR v >= q1 - {REACH} * greatest(q3 - q1, slack))) AS inside FROM used GROUP BY u),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(inside, true) AS kept
FROM base LEFT JOIN verdict ON verdict.u = base.u
"""


SQL = _sql()
