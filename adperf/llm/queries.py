"""The operators over the given tables, as (spark, table folder) -> DataFrame, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    collocations, common, conversation_trie, decontamination, fingerprints, html_text, jaccard_join, language_id, lm_scoring, packing, pii,
    suffix_dedup, token_counts, url_filters,
)

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark, sf_dir):
    return packing.pack(common.read(spark, sf_dir, "documents"), WORD_BPE)


def op2_lm_scoring(spark, sf_dir):
    return lm_scoring.lm_scores(common.read(spark, sf_dir, "documents"), common.remainder("doc_id", 7) == 2)


def op3_language_id(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    held_out = common.remainder("doc_id", 4) == 2
    found = language_id.language_of(docs, language_id.fit(docs, ~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.*")


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.components(common.read(spark, sf_dir, "documents")).drop("row_key")


def op5_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(common.read(spark, sf_dir, "documents"))


def op6_pii(spark, sf_dir):
    return pii.report(common.read(spark, sf_dir, "documents"))


def op7_url_filters(spark, sf_dir):
    """Each page as fetched on some day, against a dated list of the hosts that the pages have."""
    pages = common.read(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (F.col("page_id") * 7919 % 365).alias("fetched_day"))
    return url_filters.judge(captures, url_filters.entries_of_hosts(pages), fetched="fetched_day")


def op8_token_counts(spark, sf_dir):
    counted = token_counts.token_counts(common.read(spark, sf_dir, "documents"), WORD_BPE)
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op9_html_text(spark, sf_dir):
    return html_text.main_texts(common.read(spark, sf_dir, "pages"))


def op10_decontamination(spark, sf_dir):
    docs, benchmark = (common.read(spark, sf_dir, table) for table in ("documents", "benchmark"))
    return decontamination.contamination(docs, benchmark)


def op11_suffix_dedup(spark, sf_dir):
    cut = suffix_dedup.without_repeats(common.read(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_conversation_trie(spark, sf_dir):
    seqs = conversation_trie.sequences(common.read(spark, sf_dir, "conversations"))
    number = F.col("conv_id")
    return conversation_trie.trie(conversation_trie.rebuilt(seqs, number - number % 5, F.crc32(number.cast("string")) % 9))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(common.read(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_packing": op1_packing,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_language_id": op3_language_id,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_fingerprints": op5_fingerprints,
        "op6_pii": op6_pii,
        "op7_url_filters": op7_url_filters,
        "op8_token_counts": op8_token_counts,
        "op9_html_text": op9_html_text,
        "op10_decontamination": op10_decontamination,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_collocations": op13_collocations,
    }


def oracle_sql():
    return {
        "op7_url_filters": url_filters.SQL,
        "op11_suffix_dedup": suffix_dedup.SQL,
        "op12_conversation_trie": conversation_trie.SQL,
        "op13_collocations": collocations.SQL,
    }
