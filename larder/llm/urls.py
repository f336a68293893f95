"""URL filters: all glob rules at once with a bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL ``host + path`` (A-Z of the host in
lower case; scheme, query and fragment cut). ``?`` is one character, ``*`` any
run without a slash, ``**`` any run. The literals of all rules are laid out in
one bit vector of 64-bit words; one Shift-And step per character moves all
rules of all URLs of an Arrow batch at the same time, and wildcard positions
keep their bit. The scan reads only the URL column and needs no shuffle.

Defined results: a null URL, or one without ``://``, has empty host and path
and so only rules that accept the empty string fit it; of several fitting rules
the one with the largest priority decides, the first of equal ones. Repeated
rows are judged each, an empty table gives no rows, extra columns are ignored; a
URL is read once, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    label: str | None          # reported name; None for method rules
    verdict: str               # "allow" or "block"
    globs: tuple[str, ...]
    priority: int


def site_rule(site: str, verdict: str) -> Rule:
    """``host/path-prefix``: fits the host and its subdomains; longer is stronger."""
    return Rule(site, verdict, (site + "**", "*." + site + "**"), len(site))


# The site rules of the filter.
SITE_RULES = (site_rule("net/", "block"), site_rule("example.net/en/", "allow"),
              site_rule("example.com/de/", "block"), site_rule("org/fr/", "allow"))

# Globs that judge the URLs no site rule fits (else allowed).
METHOD_BLOCKS = ("**spam**", "**casino**", "**porn**", "**viagra**", "**/wp-login.php", "**.exe", "**.zip")
METHOD_RULES = tuple(Rule(None, "block", (g,), -1) for g in METHOD_BLOCKS)


class GlobAutomaton:
    """Shift-And masks of many globs; ``match`` gives a (texts x globs) matrix."""

    def __init__(self, globs: list[str]):
        places: list[tuple[int, str]] = []       # (bit, literal or "?")
        loop_any: list[int] = []
        loop_segment: list[int] = []
        starts, accepts, bit = [], [], 0
        for g in globs:
            starts.append(bit)
            i = 0
            while i < len(g):
                if g.startswith("**", i):
                    loop_any.append(bit)
                    i += 2
                elif g[i] == "*":
                    loop_segment.append(bit)
                    i += 1
                else:
                    bit += 1
                    places.append((bit, g[i]))
                    i += 1
            accepts.append(bit)
            bit += 1
        self.words = bit // 64 + 1
        self.alphabet = np.array(sorted({ord(c) for _, c in places if c != "?"} | {ord("/")}), np.uint32)
        # row 0: any character that no rule names
        self.step = np.zeros((len(self.alphabet) + 1, self.words), np.uint64)
        for b, c in places:
            if c == "?":
                self.step[:, b // 64] |= np.uint64(1 << (b % 64))
            else:
                row = int(np.searchsorted(self.alphabet, ord(c))) + 1
                self.step[row, b // 64] |= np.uint64(1 << (b % 64))
        everywhere, segment = self._mask(loop_any), self._mask(loop_segment)
        self.keep = np.tile(everywhere | segment, (len(self.alphabet) + 1, 1))
        self.keep[int(np.searchsorted(self.alphabet, ord("/"))) + 1] = everywhere
        self.start = self._mask(starts)
        self.accept = np.array(accepts, np.int64)

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def match(self, texts: list[str]) -> np.ndarray:
        n = len(texts)
        state = np.tile(self.start, (n, 1))
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.alphabet, codes)
        at[at == len(self.alphabet)] = 0
        symbol = np.where(self.alphabet[at] == codes, at + 1, 0)
        first = (np.cumsum(lengths) - lengths)[order]
        falling = lengths[order]
        state = state[order]
        for t in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-falling, -t, side="left"))   # texts longer than t
            s = state[:live]
            c = symbol[first[:live] + t]
            moved = s << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[c]) | (s & self.keep[c])
        hit = (state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty((n, len(self.accept)), bool)
        out[order] = hit.astype(bool)
        return out


def filter_urls(pages: DataFrame, rules=SITE_RULES + METHOD_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``."""
    rules = sorted(rules, key=lambda r: -r.priority)     # stable: first of equals wins
    globs = [g for r in rules for g in r.globs]
    owner = np.array([i for i, r in enumerate(rules) for _ in r.globs])
    labels = np.array([r.label for r in rules] + [None], object)
    verdicts = np.array([r.verdict for r in rules] + [default], object)
    automaton = GlobAutomaton(globs)

    @F.pandas_udf("rule string, verdict string")
    def judge(url: pd.Series) -> pd.DataFrame:
        hits = automaton.match(url.tolist())
        best = np.where(hits, owner[None, :], len(rules)).min(axis=1, initial=len(rules))
        return pd.DataFrame({"rule": labels[best], "verdict": verdicts[best]})

    url = F.coalesce(F.col("url"), F.lit(""))
    parts = r"^(?s).*?://([^/?#]*)([^?#]*)"
    split = pages.select("page_id", F.translate(F.regexp_extract(url, parts, 1), *AZ).alias("host"),
                         F.regexp_extract(url, parts, 2).alias("path"))
    return (split.withColumn("_v", judge(F.concat("host", "path")))
            .select("page_id", "host", "path", "_v.rule", "_v.verdict"))


def _site_sql(site: str) -> str:
    host, path = site.split("/", 1)
    return (f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')")


SQL = rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS sep FROM pages),
rest AS (SELECT page_id, CASE WHEN sep > 0 THEN substr(url, sep + 3) ELSE '' END AS rest FROM u),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{AZ[0]}', '{AZ[1]}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_site_sql(r.label)} THEN '{r.label}'"
                           for r in sorted(SITE_RULES, key=lambda r: -r.priority))} END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{r.label}' THEN '{r.verdict}'" for r in SITE_RULES)}
            WHEN {" OR ".join(f"(host || path) GLOB '{g.replace('**', '*')}'" for g in METHOD_BLOCKS)} THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""
