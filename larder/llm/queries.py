"""Registered queries of the training-data operators (thin, production parameters)."""

from __future__ import annotations

from larder.llm import conversations, decontam, jaccard, mixing, quality, repeats, secrets, token_counts, tokens, toxicity, trie, urls, vectors
from larder.llm.common import documents_of
from larder.sources.tables import read_table


def op1_secret_scan(spark, sf_dir):
    return secrets.find_secrets(documents_of(spark, sf_dir))


def op2_suffix_dedup(spark, sf_dir):
    return repeats.remove_repeats(documents_of(spark, sf_dir))


def op3_decontamination(spark, sf_dir):
    return decontam.report(documents_of(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op4_token_files(spark, sf_dir):
    return tokens.report(documents_of(spark, sf_dir))


def op5_source_mix(spark, sf_dir):
    return mixing.mix_report(documents_of(spark, sf_dir))


def op6_url_filters(spark, sf_dir):
    return urls.filter_urls(read_table(spark, sf_dir, "pages"))


def op7_token_counts(spark, sf_dir):
    return token_counts.report(documents_of(spark, sf_dir))


def op8_ngram_jaccard(spark, sf_dir):
    return jaccard.report(documents_of(spark, sf_dir))


def op9_embedding_near_dedup(spark, sf_dir):
    return vectors.report(read_table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark, sf_dir):
    return toxicity.report(documents_of(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op11_quality_rules(spark, sf_dir):
    return quality.report(documents_of(spark, sf_dir))


def op12_conversation_repair(spark, sf_dir):
    return conversations.report(read_table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark, sf_dir):
    return trie.report(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_token_files": op4_token_files,
    "op5_source_mix": op5_source_mix,
    "op6_url_filters": op6_url_filters,
    "op7_token_counts": op7_token_counts,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_quality_rules": op11_quality_rules,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE = {
    "op3_decontamination": decontam.SQL,
    "op5_source_mix": mixing.SQL,
    "op6_url_filters": urls.SQL,
    "op8_ngram_jaccard": jaccard.SQL,
    "op9_embedding_near_dedup": vectors.SQL,
    "op11_quality_rules": quality.SQL,
    "op12_conversation_repair": conversations.SQL,
    "op13_prefix_trie": trie.SQL,
}
