"""From documents to packed training sequences, stage by stage.

Every stage takes the documents its predecessor kept and returns them with their
columns; the last one returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adperf.llm import common, decontamination, jaccard_join, language_id, packing, pii
from adperf.llm.queries import WORD_BPE
from adperf.session import materialize


#: Near copies share that many percent of their shingles of so many words; op4 has values of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Idle Python workers stay beside later stages, so their word caches are kept smaller than where packing runs alone.
CACHED_WORDS = 200_000


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is rejected: no letters, or far from all that the labels teach."""
    return language_id.keep_languages(docs, language_id.fit(docs, F.lit(True)))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    return decontamination.keep_clean(docs, common.read(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what gives it away replaced."""
    return pii.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents by sequence."""
    return packing.pack(docs, WORD_BPE, cached_words=CACHED_WORDS)


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", keep_clean_of_benchmark),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: Trained centroids and tokenizers have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
