"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

The windows of an item are its runs of ``size`` consecutive words; a shorter item
is one window. A document contains a window only if it contains all its words, so
the one word of the window that is rarest in the corpus is a sufficient prefix:
only positions of such words are joined. What meets is bounded by position (the
window has to begin and end within the document), and the words that stand there
are joined to the windows.

Words are counted and joined in a coarser case folding, so that the exact one
(A to Z only) is needed only for documents that hold a prefix word.

The prefix words are broadcast if their table was found small; otherwise the
positions are shuffled by word. Texts are read again only for documents that met one.

Defined results: NULL text and NULL items have no words; rows that are equal get
the same result, one row each; items with the same id count once, an item without
id counts as the id ``null``; an empty benchmark hits nothing and an empty
document table gives no rows; other columns are not read, ``keep_clean`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common

# What stands between words, before case folding as well as after it.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    """The words, with an empty one at the end if the text ends in a gap or has no word."""
    return F.split(F.regexp_replace(text, "^" + _GAP, ""), _GAP)


def exact_words(text: Column) -> Column:
    return F.filter(_split(F.translate(text, UPPER, LOWER)), lambda w: w != "")


def folded(text: Column) -> Column:
    """A case folding that maps equal exact words to equal words, whatever stands around them."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _words_of_corpus(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, F.posexplode(_split(folded(F.col("text")))).alias("place", "word"))


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """One row per item and window: ``item_id`` as text, ``window`` of exact words."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
        exact_words(F.coalesce("text", F.lit(""))).alias("words"),
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return items.select("item_id", "words", F.explode(starts).alias("start")).select(
        "item_id", F.slice("words", F.col("start"), F.lit(size)).alias("window")
    ).distinct()


def rarest_word(wins: DataFrame, docs: DataFrame) -> DataFrame:
    """Each window with the ``word`` that its documents are found by, and the words before it (``before``)."""
    vocabulary = materialize(wins.select(F.explode("window").alias("word")).select(folded(F.col("word")).alias("word")).distinct())
    counted = _words_of_corpus(docs).select("word").join(
        common.broadcast_if_small(vocabulary, F.octet_length("word")), "word"
    ).groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    places = wins.select("item_id", "window", F.posexplode("window").alias("before", "word")).withColumn(
        "word", folded(F.col("word"))
    )
    order = F.struct(F.coalesce("times", F.lit(0)).alias("times"), F.col("word"), F.col("before"))
    return (
        places.join(counted, "word", "left")
        .groupBy("item_id", "window").agg(F.min(order).alias("first"))
        # A word that the corpus has nowhere settles the window.
        .where(F.col("first.times") > 0)
        .select("item_id", "window", F.col("first.word").alias("word"), F.col("first.before").alias("before"))
    )


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per distinct document that holds a window: ``row_key``, ``n_hit``, ``n_items``, ``items`` (sorted ids)."""
    read = common.texts(docs)
    wins = materialize(rarest_word(materialize(windows(benchmark, size)), read))
    joined = lambda words: F.array_join(words, " ")
    prefixes = wins.select("word", "before", F.size("window").alias("size")).distinct()
    keyed = read.select(common.row_key().alias("row_key"), "text")
    # Where a window may begin; a start before the text cannot be.
    start = F.col("place") - F.col("before")
    met = materialize(
        _words_of_corpus(keyed, "row_key")
        .join(common.broadcast_if_small(prefixes, F.octet_length("word")), "word").where(start >= 0)
        .groupBy("row_key").agg(F.collect_set(F.struct(start.alias("low"), "size")).alias("met"))
    )
    wanted = keyed.join(common.broadcast_if_small(met.select("row_key"), F.lit(8)), "row_key", "left_semi")
    runs = (
        wanted.dropDuplicates(["row_key"]).join(met, "row_key")
        .select("row_key", F.explode(common.let(exact_words(F.col("text")), lambda words: F.transform(
            F.filter("met", lambda m: m["low"] + m["size"] <= F.size(words)),
            lambda m: F.struct(
                m["low"].alias("low"), (m["low"] + m["size"]).alias("high"),
                joined(F.slice(words, m["low"] + 1, m["size"])).alias("run"),
            ),
        ))).alias("at"))
    )
    verified = runs.select("row_key", "at.*").join(
        common.broadcast_if_small(
            wins.select("item_id", joined("window").alias("run")), F.octet_length("run") + F.octet_length("item_id")
        ),
        "run",
    ).groupBy("row_key").agg(
        F.collect_set(F.struct("low", "high")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, r: F.struct(
            F.greatest(a["upto"], r["high"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), r["high"] - F.greatest(r["low"], a["upto"]))).alias("n"),
        ),
    )["n"]
    return verified.select(
        "row_key", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    n_words = common.let(
        _split(F.col("text")), lambda words: F.size(words) - F.when(F.element_at(words, -1) == "", 1).otherwise(0)
    )
    every = common.texts(docs).select("doc_id", common.row_key().alias("row_key"), n_words.cast("long").alias("n_words"))
    none = F.lit(0).cast("long")
    return every.join(hits(docs, benchmark, size), "row_key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents without a hit, with their own columns."""
    found = materialize(hits(docs, benchmark, size).select(F.col("row_key").alias("__hit")))
    keyed = docs.withColumn("__row", common.row_key())
    small = common.broadcast_if_small(found, F.lit(8))
    return keyed.join(small, F.col("__row") == F.col("__hit"), "left_anti").drop("__row")
