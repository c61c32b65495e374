"""Collocations of two and three words, by dynamic itemset counting over shards.

The corpus is encoded once into blocks of numbered words, dealt to ``shards``.
Scans go round the shards, all lengths at a time: words are counted in the first
round; a pair is counted in every shard that is scanned after both of its words
were seen ``least`` times, and a triple in every shard that is scanned after both
of its pairs were and the shard knows them (it is told at the start of each round). Each phrase stops after one full round
of its own, so late starters are finished in a later round. A block gets to know
what became frequent from tables joined by digest, one row for each distinct phrase
of a block; no vocabulary is sent to all tasks.

Phrases keep their language apart: digests of words (64 bits) contain it. Scores are
exact decimals, for counts up to 10^15.

Defined results: a NULL text is an empty one, a NULL language is ``und``; rows of
one id and repeated rows count each. No candidates give no rows. Ties are ordered as
the columns say. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adperf.session import discard, materialize

from . import common, hashing

#: Bytes of text in a block, and how many of them are split into words at a time.
BLOCK, PART = 16 << 20, 2 << 20
#: Parts of a language whose best phrases are found apart.
SALTS = 64

BLOCKS = "block long, stream binary, digests array<long>, words array<string>, langs array<string>, counts array<long>"
COUNTED = "level int, a long, b long, c long, block long, count long"
SETTLED = "block long, pairs binary, waits binary, speaks binary, totals binary"

# What ends a piece, what parts words.
BREAKS, SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_CLASS = np.zeros(256, np.int8)
_CLASS[list(SPACES)], _CLASS[list(BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NEVER = np.int64(1 << 40)


def _tokens(rows: pa.RecordBatch):
    """Digest of each word, whether a piece begins with it, and each distinct word with its text and language."""
    text = rows.column("text")
    bounds = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    body = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    data = np.full(len(body) + len(text) + 1, BREAKS[-1], np.uint8)
    data[np.arange(len(body)) + np.repeat(np.arange(len(text)), np.diff(bounds))] = _LOWER[body]
    kind = _CLASS[data]
    edge = np.diff((kind == 0).astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    breaks = np.cumsum(kind == 2)[starts]
    begins = np.diff(breaks, prepend=-1) != 0
    h = hashing.prefixes(data)
    size = ends - starts
    longest = int(size.max(initial=0))
    digest = common.mix(h[ends] - h[starts] * hashing.powers(longest + 1)[size] + size.astype(np.uint64))
    doc = np.searchsorted(bounds + np.arange(len(bounds)), starts, "right") - 1
    digest = common.mix(digest ^ rows.column("lang_key").to_numpy().view(np.uint64)[doc])
    distinct, first = np.unique(digest, return_index=True)
    letters, at = hashing.gather(data, starts[first], size[first])
    words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(letters)])
    return digest, begins, distinct, words, rows.column("lang").take(pa.array(doc[first]))


def _encode(shards: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for rows in common.blocks(batches, PART):
            held.append(_tokens(rows))
            size += rows.column("text").nbytes
            if size >= BLOCK:
                yield _block(held, ((part << 24) | number) * shards + (part + number) % shards)
                held, size, number = [], 0, number + 1
        if held:
            yield _block(held, ((part << 24) | number) * shards + (part + number) % shards)

    return encode


def _block(parts: list, number: int) -> pa.RecordBatch:
    digests, begins, own, words, langs = zip(*parts)
    digest, begins = np.concatenate(digests), np.concatenate(begins)
    distinct, local, counts = np.unique(digest, return_inverse=True, return_counts=True)
    stream = np.zeros(len(digest) + int(begins.sum()) + 1, np.uint32)
    stream[np.arange(len(digest)) + np.cumsum(begins)] = local + 1
    own = np.concatenate(own)
    first = pa.array(np.unique(own, return_index=True)[1])
    common.give_back()
    return pa.record_batch({
        "block": pa.array([number], pa.int64()),
        "stream": pa.array([zstandard.compress(stream.tobytes(), 3)], pa.binary()),
        "digests": pa.array([distinct.view(np.int64)], pa.list_(pa.int64())),
        "words": _one_list(pa.concat_arrays(words).take(first)),
        "langs": _one_list(pa.concat_arrays(langs).take(first)),
        "counts": pa.array([counts], pa.list_(pa.int64())),
    })


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _next_scan(after: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """The first scan of the shard that comes later than ``after``."""
    return shard + shards * np.maximum(0, -(-(after + 1 - shard) // shards))


def _scan(step: int, shards: int):
    """One block and what it is told: counts of the phrases that start here at this step."""
    shard = step % shards

    def scan(blocks: pa.Table, told: pa.Table) -> pa.Table:
        ids = np.frombuffer(zstandard.decompress(blocks.column("stream")[0].as_py()), np.uint32).astype(np.int64)
        digests = blocks.column("digests").combine_chunks().values.to_numpy().view(np.uint64)
        kind = told.column("kind").to_numpy()
        words = told.filter(pa.array(kind == 1))
        frequent = np.full(len(digests) + 1, _NEVER)
        frequent[words.column("what").to_numpy() + 1] = words.column("since").to_numpy()
        wide = len(digests) + 1
        left, right = ids[:-1], ids[1:]
        place = np.flatnonzero((np.maximum(frequent[left], frequent[right]) < step) & (left > 0) & (right > 0))
        asked = _next_scan(np.maximum(frequent[left[place]], frequent[right[place]]), shard, shards)
        code = left[place] * wide + right[place]
        out = []

        found, counts = np.unique(code[asked == step], return_counts=True)
        out.append((2, _pair(digests, found, wide), None, None, counts))

        mine = kind == 2
        if mine.any():
            known, wait, speaks = (
                np.concatenate([np.frombuffer(x, kind) for x in told.column(c).drop_null().to_pylist()])
                for c, kind in (("pairs", np.int64), ("waits", np.int32), ("speaks", bool))
            )
            order = np.argsort(known)
            known, wait, speaks = known[order], wait[order].astype(np.int64), speaks[order]
            pair = _pair(digests, code, wide)
            which = np.minimum(np.searchsorted(known, pair), len(known) - 1)
            hit = known[which] == pair
            place, code, which = place[hit], code[hit], which[hit]
            # a pair is told from the round after it became frequent, to blocks that had asked before
            starts = np.maximum(asked[hit] + shards, (wait[which] // shards + 1) * shards + shard)
            # pairs that this block has to spell out, once each
            spoken, first = np.unique(np.where((starts == step) & speaks[which], which, -1), return_index=True)
            first = first[spoken >= 0]
            words = digests.view(np.int64)
            x, y = code[first] // wide - 1, code[first] % wide - 1
            out.append((1, known[which[first]], words[x], words[y], np.zeros(len(first), np.int64)))
            # triples: two known pairs one word apart
            after = np.flatnonzero(place[1:] == place[:-1] + 1)
            now = after[np.maximum(starts[after], starts[after + 1]) == step]
            triple, counts = np.unique(which[now] * len(known) + which[now + 1], return_counts=True)
            out.append((3, known[triple // len(known)], known[triple % len(known)], None, counts))
        number = blocks.column("block")[0].as_py()
        common.give_back()
        return pa.concat_tables([_counted(number, *part) for part in out])

    return scan


def _pair(digests: np.ndarray, code: np.ndarray, wide: int) -> np.ndarray:
    x, y = digests[code // wide - 1], digests[code % wide - 1]
    return common.mix(x * np.uint64(0xA24BAED4963EE407) + common.mix(y)).view(np.int64)


def _counted(block: int, level: int, a, b, c, count) -> pa.Table:
    n = len(a)
    column = lambda values, kind: pa.nulls(n, kind) if values is None else pa.array(values, kind)
    return pa.table({
        "level": np.full(n, level, np.int32), "a": pa.array(a, pa.int64()), "b": column(b, pa.int64()), "c": column(c, pa.int64()),
        "block": np.full(n, block, np.int64), "count": pa.array(count, pa.int64()),
    })


def _settle(least: int):
    """Rows of a pair side by side: if it is frequent, since which step, in all, and which block spells it out.

    What a block is told of many pairs is packed into one row.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.whole_runs(batches, "a", 200_000):
            a, block, step, count = (rows.column(c).to_numpy() for c in ("a", "block", "step", "count"))
            order = np.lexsort((block, step, a))
            a, block, step, count = a[order], block[order], step[order], count[order]
            begins = np.ones(len(a), bool)
            begins[1:] = a[1:] != a[:-1]
            starts, run = np.flatnonzero(begins), np.cumsum(begins) - 1
            total = np.add.reduceat(count, starts)
            so_far = np.cumsum(count)
            so_far -= (so_far - count)[starts][run]
            since = np.minimum.reduceat(np.where(so_far >= least, step, np.iinfo(np.int32).max), starts)
            keep = np.flatnonzero(total[run] >= least)
            keep = keep[np.argsort(block[keep], kind="stable")]
            if not len(keep):
                continue
            # one row for each block, with all it is told
            cuts = np.flatnonzero(np.diff(block[keep], prepend=-1))
            packed = [(a, np.int64), (since[run], np.int32), (begins, bool), (np.where(begins, total[run], 0), np.int64)]
            pieces = [[x.tobytes() for x in np.split(v[keep].astype(kind), cuts[1:])] for v, kind in packed]
            yield pa.record_batch({
                "block": block[keep][cuts],
                **{name: pa.array(piece, pa.binary()) for name, piece in zip(("pairs", "waits", "speaks", "totals"), pieces)},
            })

    return settle


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each frequent pair once, with its count."""
    for rows in batches:
        for pairs, speaks, totals in zip(*(rows.column(c).to_pylist() for c in ("pairs", "speaks", "totals"))):
            one = np.frombuffer(speaks, bool)
            yield pa.record_batch({"a": np.frombuffer(pairs, np.int64)[one], "count": np.frombuffer(totals, np.int64)[one]})


def _words_of(blocks: DataFrame, shard: int, shards: int) -> DataFrame:
    """Counts of the words of a shard."""
    each = F.explode(F.arrays_zip("digests", "words", "langs", "counts"))
    words = blocks.where(F.col("block") % shards == shard).select(each.alias("w")).select("w.*")
    return words.groupBy(F.col("digests").alias("word")).agg(
        F.min("langs").alias("lang"), F.min("words").alias("text"), F.sum("counts").alias("count")
    )


def counted(docs: DataFrame, least: int = 10, shards: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (``word``, ``lang``, ``text``, ``count``); pairs seen ``least`` times (``pair``, ``first``, ``second``, ``count``)
    and triples (``left`` and ``right`` pair, ``count``), by the shards in turn."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("lang_key"))
    blocks = materialize(texts.mapInArrow(_encode(shards), BLOCKS))
    parts = common.shuffle_parts(spark)
    words = settled = None
    scans, asks = [], []
    for step in range(3 * shards):
        shard = step % shards
        here = blocks.where(F.col("block") % shards == shard)
        if words is not None:
            entries = here.select("block", F.posexplode("digests").alias("at", "word"))
            known = words.where(F.col("since").isNotNull()).select("word", "since")
            told = entries.join(known, "word").select(
                F.col("block").alias("to"), F.lit(1).alias("kind"), F.col("at").cast("long").alias("what"), "since",
                *[F.lit(None).cast("binary").alias(c) for c in ("pairs", "waits", "speaks")],
            )
            if shard == 0 and asks:  # a new round: what has become frequent so far
                if settled is not None:
                    discard(settled)
                every = asks[0]
                for more in asks[1:]:
                    every = every.unionByName(more)
                settled = materialize(every.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(_settle(least), SETTLED))
            if settled is not None:
                told = told.unionByName(
                    settled.where(F.col("block") % shards == shard)
                    .select(
                        F.col("block").alias("to"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("what"),
                        F.lit(None).cast("int").alias("since"), "pairs", "waits", "speaks",
                    )
                )
            streams = here.select("block", "stream", "digests").repartition(parts, "block").groupBy("block")
            out = materialize(
                streams.cogroup(told.repartition(parts, "to").groupBy("to")).applyInArrow(_scan(step, shards), COUNTED)
            )
            scans.append(out)
            if step < 2 * shards:
                asks.append(out.where("level = 2").select("a", "block", "count", F.lit(step).alias("step")))
        if step < shards:
            new = _words_of(blocks, shard, shards).withColumn("since", F.lit(None).cast("int"))
            old = words
            both = new if old is None else old.unionByName(new)
            summed = both.groupBy("word").agg(
                F.min("lang").alias("lang"), F.min("text").alias("text"), F.sum("count").alias("count"), F.min("since").alias("since")
            )
            since = F.coalesce("since", F.when(F.col("count") >= least, F.lit(step)))
            words = materialize(summed.withColumn("since", since))
            if old is not None:
                discard(old)
    found = scans[0]
    for more in scans[1:]:
        found = found.unionByName(more)
    spelled = found.where("level = 1").select("a", F.col("b").alias("first"), F.col("c").alias("second"))
    pairs = materialize(
        settled.mapInArrow(_spoken, "a long, count long").join(spelled, "a").withColumnRenamed("a", "pair")
    )
    triples = found.where("level = 3").groupBy(F.col("a").alias("left"), F.col("b").alias("right")).agg(F.sum("count").alias("count"))
    triples = materialize(triples.where(F.col("count") >= least))
    discard(blocks, settled, *scans)
    return words, pairs, triples


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), in whole numbers of up to 38 digits."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    square = F.lit(1_000_000).cast("decimal(7,0)") * a * a
    return F.call_function("div", square, left * right)


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, top: int = 2000, shards: int = 2) -> DataFrame:
    """The ``top`` phrases of each language by their lowest-scoring cut."""
    words, pairs, triples = counted(docs, least, shards)
    known = words.where(F.col("count") >= least)
    one, two = (
        known.select(F.col("word").alias(side), F.col("text").alias(f"{side}_text"), F.col("count").alias(f"{side}_count"), *more)
        for side, more in (("first", ["lang"]), ("second", []))
    )
    named = materialize(pairs.join(one, "first").join(two, "second"))
    left, right = (
        named.select(
            F.col("pair").alias(side),
            F.col("count").alias(f"{side}_pair_count"),
            F.concat_ws(" ", "first_text", "second_text").alias(f"{side}_text"),
            F.col("first_count").alias(f"{side}_first"),
            F.col("second_count").alias(f"{side}_second"),
            F.col("second_text").alias(f"{side}_last"),
            *more,
        )
        for side, more in (("left", ["lang"]), ("right", []))
    )
    long = materialize(triples.join(left, "left").join(right, "right"))
    inside = F.explode(F.array(
        F.when(100 * F.col("count") >= percent * F.col("left_pair_count"), F.col("left")),
        F.when(100 * F.col("count") >= percent * F.col("right_pair_count"), F.col("right")),
    )).alias("pair")
    covered = long.select(inside).where(F.col("pair").isNotNull()).distinct()
    a = F.col("count")
    cut = lambda k, x, y: F.struct(_score(a, x, y).alias("score"), F.lit(k).alias("k"), x.alias("l"), y.alias("r"))
    short = named.join(covered, "pair", "left_anti").select(
        "lang", F.concat_ws(" ", "first_text", "second_text").alias("phrase"), a.alias("a"),
        cut(1, F.col("first_count"), F.col("second_count")).alias("cut"),
    )
    long = long.select(
        "lang", F.concat_ws(" ", "left_text", "right_last").alias("phrase"), a.alias("a"),
        F.least(
            cut(1, F.col("left_first"), F.col("right_pair_count")), cut(2, F.col("left_pair_count"), F.col("right_second"))
        ).alias("cut"),
    )
    every = short.unionByName(long).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = every.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("count").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Of the query over ``documents``.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
occurrences AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM lists, (VALUES (1), (2), (3)) lengths(k) WHERE len(w) >= k
),
counts AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM occurrences GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE k > 1 AND f >= 10),
parts AS (
  SELECT lang, phrase, k, f AS a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS head, array_to_string(list_slice(w, cut + 1, k), ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
),
cuts AS (
  SELECT p.*, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM parts p JOIN counts x ON x.lang = p.lang AND x.phrase = p.head JOIN counts y ON y.lang = p.lang AND y.phrase = p.rest
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
covered AS (
  SELECT lang, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) AS phrase, f
  FROM candidates WHERE k = 3
),
most AS (SELECT lang, phrase, max(f) AS f FROM covered GROUP BY lang, phrase),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN most m ON m.lang = s.lang AND m.phrase = s.phrase WHERE m.f IS NULL OR 100 * m.f < 50 * s.a
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
