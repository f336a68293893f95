"""The training-corpus pipeline: filter, deduplicate, decontaminate, mix, tokenise.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept. All but the last return the columns of ``documents``; the last returns one
row per document copy of the token files. Between stages the rows are written as
Parquet to the shared folder and read back, so a lost executor costs one stage.

Defined results: see the operators. A null text is never toxic, is in no group
of near duplicates, is never contaminated, costs the mix nothing and holds only
the end id in the token files. Extra columns are carried to the last stage.
"""

from __future__ import annotations

import os

from larder.llm import decontam, jaccard, mixing, tokens, toxicity
from larder.llm.common import stage, unstage


def _table(spark, sf_dir, name):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity model scores below one half (operator 10)."""
    return toxicity.clean(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of linked documents (operator 8)."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that the benchmark does not contaminate (operator 3)."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """The taken copies of each document, in mixing order (operator 5)."""
    return mixing.mix(docs)


def token_files(spark, docs, sf_dir):
    """Token files written and read back: one row per document copy (operator 4)."""
    return tokens.report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", token_files),
]

# A trained model and a tokenizer library decide rows: no SQL form. tests/llm
# holds run() against a plain version of every stage.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
