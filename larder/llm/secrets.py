"""Secret scans: known shapes plus a randomness test battery, all in DataFrame functions.

Base spans are the leftmost non-overlapping matches of three fixed shapes. The
battery adds long unbroken tokens that look drawn at random:

* the encoding is the smallest alphabet that holds the token (hex, upper base32,
  lower letters, base36, base62, base64, base64url);
* three tests ask whether the token fits a uniform draw from that alphabet:
  chi-squared of the symbol counts, runs above and below the middle symbol, and
  lag-one serial correlation; a token that fails one is ordinary;
* two statistics ask how unlikely it is for ordinary words: the symbol
  collisions and the changes of character class, against rates measured on all
  word-like tokens of the corpus. Their moments depend on the token's length, so
  a short token needs a stronger deviation;
* the combined p-values of all candidates pass a Benjamini-Hochberg bound within
  length bands. P-values are binned (rounded up), so the bound needs one count per
  band and bin and no global order.

Each text is read once. Positions come from the lengths of the pieces between
the matches, and only texts with a match leave the scan with more than an id.

Defined results: a null text is empty; texts without spans give empty strings and
zero counts; repeated rows give equal results; an empty table gives no rows; extra
columns are ignored. Offsets are code points, end exclusive. A text is one value of its
row and a token of the battery one array of its symbols, so the longest of them bounds a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import stage

# The shapes, in reporting order, with the least length that counts
# (of the second group for assignments, of the whole match otherwise).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
RANDOM = "random"
# Cheap forms for the row filter: a text without a hit here has no counting match.
GATES = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

LEAST = 20
TOKEN = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
# encoding, pattern, alphabet: the first that fits is used
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (("digits", r"^[0-9]+$", DIGIT), ("hex", r"^[0-9a-f]+$", DIGIT + LOWER[:6]),
             ("HEX", r"^[0-9A-F]+$", DIGIT + UPPER[:6]), ("lower", r"^[a-z]+$", LOWER),
             ("base32", r"^[A-Z2-7]+$", UPPER + DIGIT[2:8]), ("base36", r"^[A-Z0-9]+$", UPPER + DIGIT),
             ("lower36", r"^[a-z0-9]+$", LOWER + DIGIT), ("base62", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGIT),
             ("base64", r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGIT + "+/"),
             ("base64url", r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGIT + "-_"),
             ("mixed", r"^.*$", UPPER + LOWER + DIGIT + "+/-_"))
MAX_Z = 3.3                     # a randomness test beyond it rejects the token
DISCOVERY_RATE = 0.001
BINS_PER_NAT = 10
WORDLIKE = r"^[A-Za-z]?[a-z]+$"
BANDS = (32, 64, 128)           # token lengths that start a new band


def _lengths(parts: Column) -> Column:
    return F.transform(parts, F.length)


def scan(docs: DataFrame) -> DataFrame:
    """uid, doc_id and, per kind, gap, match and value lengths; tokens of the battery."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = []
    for kind, pattern, group, _ in KINDS:
        found = F.struct(_lengths(F.split(text, pattern, -1)).alias("gap"),
                         _lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("size"),
                         _lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("value"))
        columns.append(F.when(text.rlike(GATES[kind]), found).alias(kind))
    tokens = F.struct(_lengths(F.split(text, TOKEN, -1)).alias("gap"),
                      F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("token"))
    columns.append(F.when(text.rlike("[A-Za-z0-9+/_-]{20}"), tokens).alias("tokens"))
    return (docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"),
                        *columns))


def _placed(rows: DataFrame) -> DataFrame:
    """Adds start and end to rows (uid, kind, i, gap, size)."""
    order = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))


def base_spans(scanned: DataFrame) -> DataFrame:
    """uid, rank, kind, start, end of the spans of the fixed shapes."""
    parts = []
    for rank, (kind, _, _, least) in enumerate(KINDS):
        at = (scanned.where(F.col(kind).isNotNull())
              .select("uid", F.posexplode(F.col(f"{kind}.size")).alias("i", "size"), F.col(kind).alias("m"))
              .select("uid", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), "i", "size",
                      F.element_at("m.gap", F.col("i") + 1).alias("gap"),
                      F.element_at("m.value", F.col("i") + 1).alias("value"), F.lit(least).alias("least")))
        parts.append(at)
    rows = _placed(reduce(DataFrame.unionAll, parts))
    return rows.where("value >= least").select("uid", "rank", "kind", "start", "end")


def _classes(symbols: Column) -> Column:
    return F.transform(symbols, lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1)
                       .when(c.between("0", "9"), 2).otherwise(3))


def _changes(classes: Column, n: Column) -> Column:
    pairs = F.zip_with(F.slice(classes, 1, n - 1), F.slice(classes, 2, n - 1), lambda a, b: F.when(a == b, 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def measure(tokens: DataFrame) -> DataFrame:
    """Adds the battery's statistics to rows with a ``token`` column."""
    body = F.regexp_replace("token", "=+$", "")
    encoding = F.coalesce(*[F.when(F.col("body").rlike(p), F.lit(i)) for i, (_, p, _) in enumerate(ENCODINGS)])
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])
    t = (tokens.withColumn("body", body).withColumn("n", F.length("body").cast("double"))
         .withColumn("encoding", encoding)
         .withColumn("alphabet", F.element_at(alphabets, F.col("encoding") + 1))
         .withColumn("size", F.length("alphabet").cast("double"))
         .withColumn("symbols", F.split("body", "")))
    t = t.withColumn("counts", F.transform(F.split("alphabet", ""), lambda c: (
        F.length("body") - F.length(F.replace(F.col("body"), c, F.lit("")))).cast("double")))
    t = t.withColumn("codes", F.transform("symbols", lambda c: F.instr(F.col("alphabet"), c).cast("double")))
    n, a = F.col("n"), F.col("size")
    squares = _total(F.transform("counts", lambda c: c * c))
    chi = a / n * squares - n
    middle = (a + 1) / 2
    high = F.transform("codes", lambda x: F.when(x > middle, 1).otherwise(0))
    n1 = F.aggregate(high, F.lit(0), lambda s, x: s + x).cast("double")
    n2 = n - n1
    runs = _changes(high, F.length("body")) + 1
    runs_mean = 2 * n1 * n2 / n + 1
    runs_var = (runs_mean - 1) * (runs_mean - 2) / (n - 1)
    mean = _total(F.col("codes")) / n
    spread = _total(F.transform("codes", lambda x: (x - mean) * (x - mean)))
    lag = _total(F.zip_with(F.slice("codes", 1, F.length("body") - 1), F.slice("codes", 2, F.length("body") - 1),
                            lambda x, y: (x - mean) * (y - mean)))
    return (t.withColumn("squares", squares)
            .withColumn("z_chi", (chi - (a - 1)) / F.sqrt(2 * (a - 1) * (1 - 1 / n)))
            .withColumn("z_runs", F.when(runs_var > 0, (runs - runs_mean) / F.sqrt(runs_var)).otherwise(F.lit(99.0)))
            .withColumn("z_lag", F.when(spread > 0, (lag / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0)))
            .withColumn("changes", _changes(_classes(F.col("symbols")), F.length("body")).cast("double"))
            .withColumn("wordlike", F.col("body").rlike(WORDLIKE))
            .withColumn("fits", (F.col("encoding") > 0) & (F.col("z_chi") <= MAX_Z)
                        & (F.abs("z_runs") <= MAX_Z) & (F.abs("z_lag") <= MAX_Z) & (n >= LEAST))
            .drop("symbols", "codes", "alphabet"))


def _ordinary_rates(measured: DataFrame) -> dict[str, float]:
    """Sums of squared and cubed symbol shares, and class changes per place, of all word-like tokens."""
    words = measured.where("wordlike")
    letters = words.select(F.explode(F.split(F.lower("body"), "")).alias("c")).groupBy("c").count()
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    share = letters.select((F.col("count") / total).alias("p"))
    p = share.agg(F.sum(F.col("p") ** 2), F.sum(F.col("p") ** 3)).first()
    c = words.agg(F.sum("changes"), F.sum(F.col("n") - 1)).first()
    # without word-like tokens: letters of equal share, and one change in 20 places
    return {"p2": p[0] or 1 / 26, "p3": p[1] or 1 / 26 ** 2,
            "change": ((c[0] or 0) + 5) / ((c[1] or 0) + 100)}


def random_spans(scanned: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """uid, start, end of the tokens that the battery and the discovery bound accept."""
    rows = (scanned.where("tokens IS NOT NULL")
            .select("uid", F.posexplode("tokens.token").alias("i", "token"), "tokens")
            .select("uid", F.lit(RANDOM).alias("kind"), "i", "token", F.length("token").alias("size"),
                    F.element_at("tokens.gap", F.col("i") + 1).alias("gap")))
    measured = stage(measure(_placed(rows).drop("gap", "size", "i", "kind")), "secret-tokens")
    r = _ordinary_rates(measured)
    n, p2, p3 = F.col("n"), r["p2"], r["p3"]
    expected = n + n * (n - 1) * p2
    variance = 2 * n * (n - 1) * (p2 - p2 * p2) + 4 * n * (n - 1) * (n - 2) * max(p3 - p2 * p2, 0.0)
    z_even = (expected - F.col("squares")) / F.sqrt(F.greatest(variance, F.lit(1.0)))
    z_change = ((F.col("changes") - (n - 1) * r["change"]) / F.sqrt((n - 1) * r["change"] * (1 - r["change"])))
    z = (z_even + z_change) / F.sqrt(F.lit(2.0))
    band = sum((F.when(n >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
    # -ln p of the normal upper tail, rounded down to a bin
    nats = F.when(z > 0, 0.717 * z + 0.416 * z * z).otherwise(0.0)
    judged = measured.select("uid", "start", "end", "fits", band.alias("band"),
                             F.floor(F.least(nats, F.lit(200.0)) * BINS_PER_NAT).alias("bin"))
    bins = judged.groupBy("band", "bin").agg(F.count("*").alias("all"), F.count_if("fits").alias("hits"))
    tests = F.sum("all").over(Window.partitionBy("band"))
    passed = F.sum("hits").over(Window.partitionBy("band").orderBy(F.desc("bin")))
    bound = (bins.withColumn("tests", tests).withColumn("passed", passed)
             .where(F.col("tests") * F.exp(-F.col("bin") / BINS_PER_NAT) <= rate * F.col("passed"))
             .groupBy("band").agg(F.min("bin").alias("least_bin")))
    return (judged.where("fits").join(F.broadcast(bound), "band").where("bin >= least_bin")
            .select("uid", "start", "end"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_random per row of ``docs``."""
    scanned = stage(scan(docs), "secret-scan")
    base = base_spans(scanned)
    extra = random_spans(scanned).select("uid", F.lit(len(KINDS)).alias("rank"), F.lit(RANDOM).alias("kind"),
                                         "start", "end")
    # an added span that touches a base span adds nothing
    both = base.unionAll(extra)
    order = Window.partitionBy("uid").orderBy("start", "rank")
    base_end = F.max(F.when(F.col("rank") < len(KINDS), F.col("end"))).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    next_base = F.min(F.when(F.col("rank") < len(KINDS), F.col("start"))).over(
        order.rowsBetween(0, Window.unboundedFollowing))
    both = (both.withColumn("before", base_end).withColumn("after", next_base)
            .where((F.col("rank") < len(KINDS)) | ((F.coalesce("before", F.lit(-1)) <= F.col("start"))
                                                   & (F.coalesce("after", F.col("end")) >= F.col("end")))))
    spans = both.groupBy(F.col("uid").alias("_uid")).agg(
        *[F.count_if(F.col("rank") == i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)],
        F.count_if(F.col("rank") == len(KINDS)).alias("n_random"),
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("s"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    per = spans.withColumn("base", joined(F.filter("s", lambda x: x["rank"] < len(KINDS)))).withColumn("spans", joined(F.col("s")))
    out = scanned.select("uid", "doc_id").join(per, F.col("uid") == F.col("_uid"), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *[F.coalesce(f"n_{k[0]}", zero).alias(f"n_{k[0]}") for k in KINDS],
                      F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_random", zero).alias("n_random"))
