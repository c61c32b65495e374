"""Exact removal of passages that an earlier document has, by a suffix sort over hash comparisons.

A byte goes if a string of ``length`` bytes covers it that also starts in a
document with a smaller id. Texts are taken as UTF-8 bytes, judged on the input.

1. Every window of ``length`` bytes has an anchor, the seed of ``SEED`` bytes in it
   with the smallest hash. Equal windows have the same anchor at the same distance,
   so neighbours with one anchor travel as one piece, and only pieces whose anchor
   is in more than one document travel at all.
2. The pieces of an anchor meet, each distinct text of a block of documents once.
   The suffixes that begin their windows are dealt by anchor and distance and sorted
   (``suffix_sort``); runs of suffixes with ``length`` bytes in common share the
   smallest id of their documents. An anchor with more than ``MOST`` texts is dealt
   by window instead, so that no task holds it whole.
3. The blocks learn the smallest ids of their pieces and cut the texts.

Rows of texts are shuffled by block for each step; a block is a set of rows of bounded
size. The tables between the steps are stored, which frees the shuffle files before them.

Defined results: a NULL text is an empty one. A NULL id counts as larger than every
other. Rows with one id don't take anything from each other, repeated rows get the
same result each. Texts shorter than ``length`` stay. No rows give no rows. Other
columns of the documents are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.session import discard, materialize

from . import common, hashing, suffix_sort

#: Bytes of an anchor, at most the length of a window.
SEED = 20
#: Texts of an anchor beyond which it is dealt by window.
MOST = 4096
#: Bytes of text in a block of documents, on average.
BLOCK = 8 << 20
#: Window starts hashed at a time, and suffixes sorted at a time.
STEP, SORTED = 1 << 20, 1 << 17

_PLACE = np.uint64((1 << 24) - 1)
_LAST = np.iinfo(np.int64).max

ANCHORS = "key long, block int, pieces int, several boolean"
ANSWERS = "block int, key long, hot boolean"
PIECES = "key long, shift int, hot boolean, text binary, low long, high long, block int, at int"
FOUND = "block int, at int, hot boolean, skip int, count int, low long"
CUT = "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary"


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Block:
    """The distinct rows of a block in a fixed order, their bytes one after another, and the pieces of their windows."""

    def __init__(self, rows: pa.Table, length: int):
        keys = rows.column("row_key").to_numpy()
        distinct, first, self.inverse = np.unique(keys, return_index=True, return_inverse=True)
        rows = rows.select(["id", "text"]).take(pa.array(first)).combine_chunks()
        self.ids = rows.column("id").to_numpy()
        texts = rows.column("text").combine_chunks() if rows.num_rows else pa.chunked_array([pa.array([], pa.string())]).combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        body = texts.buffers()[2] if len(texts) else None
        self.data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        self.bounds = (offsets - offsets[0]).astype(np.int64)
        self.length = length
        self._anchors()

    def _anchors(self) -> None:
        """Runs of windows with the same anchor: first window, windows, anchor's hash and distance, hash of the bytes."""
        data, length, parts = self.data, self.length, []
        seed = min(SEED, length)
        for x in range(0, max(0, len(data) - length + 1), STEP):
            y = min(x + STEP, len(data) - length + 1)
            h = hashing.prefixes(data[x : y + length - 1])
            seeds = common.mix(h[seed:] - h[:-seed] * hashing.powers(seed + 1)[seed])
            at = _smallest((seeds & ~_PLACE) | np.arange(len(seeds), dtype=np.uint64), length - seed + 1)
            at = (at & _PLACE).astype(np.int64)
            doc = np.searchsorted(self.bounds, np.array([x, y - 1]), "right") - 1
            ends = np.repeat(self.bounds[doc[0] + 1 : doc[1] + 2], np.diff(np.clip(self.bounds[doc[0] : doc[1] + 2], x, y)))
            inside = np.flatnonzero(np.arange(x, y) + length <= ends)
            if not len(inside):
                continue
            cuts = np.flatnonzero((np.diff(inside) > 1) | (np.diff(at[inside]) != 0)) + 1
            starts = np.concatenate([[0], cuts])
            counts = np.diff(np.append(starts, len(inside)))
            first = inside[starts]
            shift = at[first] - first
            long = counts + length - 1
            body = h[first + long] - h[first] * hashing.powers(int(long.max()) + 1)[long]
            content = common.mix(body + shift.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + counts.astype(np.uint64))
            parts.append((first + x, counts, seeds[at[first]].astype(np.int64), shift, content.astype(np.int64)))
        joined = [np.concatenate(p) for p in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
        self.first, self.counts, self.keys, self.shifts, self.contents = joined
        self.docs = np.searchsorted(self.bounds, self.first, "right") - 1

    def pieces(self, which: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
        """The chosen runs as pieces, hot ones by window; ``of`` is the first piece with the same bytes."""
        cold = which & ~hot
        owner, step = hashing.spread(np.zeros(int((which & hot).sum()), np.int64), self.counts[which & hot])
        windows = self.first[which & hot][owner] + step
        hashes = hashing.hashes_at(self.data, windows, self.length).astype(np.int64)
        found = {
            "at": np.concatenate([self.first[cold], windows]),
            "count": np.concatenate([self.counts[cold], np.ones(len(windows), np.int64)]),
            "key": np.concatenate([self.keys[cold], hashes ^ 0x2545F4914F6CDD1D]),
            "shift": np.concatenate([self.shifts[cold], np.zeros(len(windows), np.int64)]),
            "id": np.concatenate([self.ids[self.docs[cold]], self.ids[self.docs[which & hot][owner]]]),
            "hot": np.concatenate([np.zeros(int(cold.sum()), bool), np.ones(len(windows), bool)]),
        }
        content = np.concatenate([self.contents[cold], hashes])
        order = np.argsort(content, kind="stable")
        begins = np.ones(len(order), bool)
        begins[1:] = content[order][1:] != content[order][:-1]
        of = np.empty(len(order), np.int64)
        of[order] = order[np.flatnonzero(begins)][np.cumsum(begins) - 1] if len(order) else order
        alike = (found["count"] == found["count"][of]) & (found["shift"] == found["shift"][of]) & (found["hot"] == found["hot"][of])
        lengths = np.where(alike, found["count"] + self.length - 1, 8 if self.length >= 8 else 0)
        if self.length >= 8:
            alike &= hashing.same(hashing.words(self.data), found["at"], found["at"][of], lengths)
        found["of"] = np.where(alike, of, np.arange(len(of)))  # hashes that lied keep a piece of their own
        return found


def _seen(length: int):
    def seen(rows: pa.Table) -> pa.Table:
        block = Block(rows, length)
        ids = block.ids[block.docs]
        order = np.lexsort((block.contents, block.keys))
        keys, contents, ids = block.keys[order], block.contents[order], ids[order]
        other = np.ones(len(keys), bool)
        other[1:] = keys[1:] != keys[:-1]
        texts = other.copy()
        texts[1:] |= contents[1:] != contents[:-1]
        starts = np.flatnonzero(other)
        if not len(starts):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.bool_())], ["key", "block", "pieces", "several"])
        several = np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts)
        number = rows.column("block")[0].as_py()
        common.give_back()
        return pa.table({
            "key": keys[starts],
            "block": np.full(len(starts), number, np.int32),
            "pieces": np.add.reduceat(texts, starts, dtype=np.int32),
            "several": several,
        })

    return seen


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: those of anchors in several documents."""
    for rows in common.whole_runs(batches, "key", 50_000):
        keys = rows.column("key").to_numpy()
        begins = np.ones(len(keys), bool)
        begins[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(begins)
        run = np.cumsum(begins) - 1
        several = np.maximum.reduceat(rows.column("several").to_numpy(zero_copy_only=False), starts)
        shared = (several | (np.diff(np.append(starts, len(keys))) > 1))[run]
        hot = (np.add.reduceat(rows.column("pieces").to_numpy(), starts, dtype=np.int64) > MOST)[run]
        yield pa.record_batch({"block": rows.column("block").to_numpy()[shared], "key": keys[shared], "hot": hot[shared]})


def _sent(length: int):
    def sent(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows, length)
        asked = answers.column("key").to_numpy()
        order = np.argsort(asked)
        asked, hot = asked[order], answers.column("hot").to_numpy(zero_copy_only=False)[order]
        if not len(asked) or not len(block.keys):
            return pa.table({name: pa.array([], kind) for name, kind in _piece_types()})
        place = np.minimum(np.searchsorted(asked, block.keys), len(asked) - 1)
        which = asked[place] == block.keys
        found = block.pieces(which, hot[place])
        low, high = found["id"].copy(), found["id"].copy()
        np.minimum.at(low, found["of"], found["id"])
        np.maximum.at(high, found["of"], found["id"])
        own = np.flatnonzero(found["of"] == np.arange(len(low)))
        data, bounds = hashing.gather(block.data, found["at"][own], found["count"][own] + length - 1)
        texts = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        number = rows.column("block")[0].as_py()
        common.give_back()
        return pa.table({
            "key": found["key"][own],
            "shift": found["shift"][own].astype(np.int32),
            "hot": found["hot"][own],
            "text": texts,
            "low": low[own],
            "high": high[own],
            "block": np.full(len(own), number, np.int32),
            "at": found["at"][own].astype(np.int32),
        })

    return sent


def _piece_types():
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return [(name, kinds[kind]) for name, kind in (field.split() for field in PIECES.split(", "))]


def _sorted(length: int):
    """Pieces sorted by anchor: the smallest id of each window, where the block has a larger one."""

    def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
        keys, shift = rows.column("key").to_numpy(), rows.column("shift").to_numpy()
        low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
        # pieces of several blocks with the same text count as one
        text = rows.column("text").dictionary_encode()
        code = text.indices.to_numpy().astype(np.int64)
        order = np.lexsort((code, shift, keys))
        other = np.ones(len(order), bool)
        other[1:] = (keys[order][1:] != keys[order][:-1]) | (shift[order][1:] != shift[order][:-1]) | (code[order][1:] != code[order][:-1])
        starts = np.flatnonzero(other)
        piece_of = np.empty(len(order), np.int64)
        piece_of[order] = np.cumsum(other) - 1
        lowest = np.minimum.reduceat(low[order], starts)
        one = order[starts]
        texts = rows.column("text").take(pa.array(one))
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        counts = np.diff(bounds) - length + 1
        owner, step = hashing.spread(np.zeros(len(one), np.int64), counts)
        at = bounds[:-1][owner] + step
        best = lowest[owner]
        # suffixes by anchor and distance; a single one has nothing to be compared with
        run = np.cumsum(np.concatenate([[True], keys[one][1:] != keys[one][:-1]])) - 1
        distance = shift[one][owner] - step
        cell = run[owner] * (2 * length) + distance + length
        by_cell = np.argsort(cell, kind="stable")
        cells = cell[by_cell]
        edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
        several = np.diff(edges) > 1
        if several.any():
            chosen, place = hashing.spread(edges[:-1][several], np.diff(edges)[several])
            members = by_cell[place]
            segments = np.concatenate([[0], np.cumsum(np.diff(edges)[several])])
            back = np.empty(len(data) + 1, np.int64)
            back[at[members]] = members  # a place of the data is one suffix
            done, begins = suffix_sort.classes(data, at[members], segments, length)
            suffix = back[done]
            heads = np.flatnonzero(begins)
            least = np.minimum.reduceat(best[suffix], heads)
            best = best.copy()
            best[suffix] = least[np.cumsum(begins) - 1]
        # back to the rows, in runs of windows with the same smallest id
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        row, window = hashing.spread(first[piece_of], counts[piece_of])
        value = best[window]
        want = value < high[row]
        row, skip, value = row[want], (window - first[piece_of][row])[want], value[want]
        heads = np.ones(len(row), bool)
        heads[1:] = (row[1:] != row[:-1]) | (skip[1:] != skip[:-1] + 1) | (value[1:] != value[:-1])
        heads = np.flatnonzero(heads)
        size = np.diff(np.append(heads, len(row)))
        row = row[heads]
        return pa.record_batch({
            "block": rows.column("block").to_numpy()[row],
            "at": rows.column("at").to_numpy()[row],
            "hot": rows.column("hot").to_numpy(zero_copy_only=False)[row],
            "skip": skip[heads].astype(np.int32),
            "count": size.astype(np.int32),
            "low": value[heads],
        })

    def settle_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.whole_runs(batches, "key", SORTED // 16):
            yield settle(rows)

    return settle_all


def _cut(length: int):
    def cut(rows: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(rows, length)
        gone = np.zeros(len(block.data) + 1, np.int32)
        at = found.column("at").to_numpy()
        if len(at):
            hot = found.column("hot").to_numpy(zero_copy_only=False)
            run = np.searchsorted(block.first, at, "right") - 1
            which = np.isin(block.keys, block.keys[run])
            pieces = block.pieces(which, np.isin(block.keys, block.keys[run[hot]]))
            order = np.argsort(at, kind="stable")
            at = at[order]
            skip, count, low = (found.column(c).to_numpy()[order] for c in ("skip", "count", "low"))
            told = pieces["at"][pieces["of"]]
            left, right = np.searchsorted(at, told, "left"), np.searchsorted(at, told, "right")
            piece, line = hashing.spread(left, right - left)
            bad = pieces["id"][piece] > low[line]
            piece, line = piece[bad], line[bad]
            start = pieces["at"][piece] + skip[line]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + count[line] + length - 1, -1)
        gone = np.cumsum(gone[:-1]) > 0
        return _cut_rows(block, rows, gone)

    return cut


def _cut_rows(block: Block, rows: pa.Table, gone: np.ndarray) -> pa.Table:
    bounds = block.bounds
    edge = np.zeros(len(gone) + 1, bool)
    edge[1:-1] = gone[1:] != gone[:-1]
    edge[bounds] = True
    cuts = np.flatnonzero(edge)[:-1]
    stops = np.flatnonzero(edge)[1:]
    removed = gone[cuts] if len(gone) else np.zeros(0, bool)
    starts, stops = cuts[removed], stops[removed]
    doc = np.searchsorted(bounds, starts, "right") - 1
    per_doc = np.searchsorted(doc, np.arange(len(bounds)))
    runs = pa.StructArray.from_arrays([pa.array(starts - bounds[doc]), pa.array(stops - bounds[doc])], ["start", "stop"])
    removed_lists = pa.ListArray.from_arrays(pa.array(per_doc.astype(np.int32)), runs)
    kept_before = np.concatenate([[0], np.cumsum(~gone)])[bounds]
    kept = pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(kept_before.astype(np.int32)), pa.py_buffer(block.data[~gone])]
    )
    back = pa.array(block.inverse)
    result = pa.table({
        "doc_id": rows.column("doc_id"),
        "n_bytes": np.diff(bounds)[block.inverse],
        "removed": removed_lists.take(back),
        "kept": kept.take(back),
    })
    common.give_back()
    return result


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``removed`` (maximal runs of bytes, end exclusive) and ``kept`` (the other bytes)."""
    if length < 8:
        raise ValueError("windows have eight bytes at least")
    spark = docs.sparkSession
    texts = common.texts(docs).withColumn("digest", F.xxhash64("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = common.shuffle_parts(spark)
    blocks = max(2 * least, -(-size // BLOCK))
    parts = max(least, -(-size // (8 * BLOCK)))
    # copies share a block, where they count as one; texts that would fill it with copies are dealt by row
    copies = texts.groupBy("digest").agg((F.count(F.lit(1)) * F.max(F.octet_length("text"))).alias("bytes"))
    crowded = materialize(copies.where(F.col("bytes") > BLOCK).select("digest", F.lit(True).alias("crowded")))
    row_key = common.row_key()
    placed = F.when(F.col("crowded"), row_key).otherwise(F.col("digest"))
    keyed = texts.join(common.broadcast_if_small(crowded, F.lit(8)), "digest", "left").select(
        F.pmod(F.xxhash64(placed), F.lit(blocks)).cast("int").alias("block"),
        row_key.alias("row_key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
    )
    by_block = keyed.repartition(parts, "block").groupBy("block")
    anchors = by_block.applyInArrow(_seen(length), ANCHORS)
    answers = materialize(anchors.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shared, ANSWERS))
    pieces = by_block.cogroup(answers.repartition(parts, "block").groupBy("block")).applyInArrow(_sent(length), PIECES)
    found = materialize(pieces.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_sorted(length), FOUND))
    discard(answers)
    return by_block.cogroup(found.repartition(parts, "block").groupBy("block")).applyInArrow(_cut(length), CUT)


#: Of the query over ``documents``.
SQL = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (
  SELECT r, doc_id, unnest(range(0, octet_length(b) - 49)) AS k,
    unnest(list_transform(range(0, octet_length(b) - 49), lambda i: array_slice(b, i + 1, i + 50))) AS w
  FROM texts
),
firsts AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w HAVING count(*) > 1),
bad AS (SELECT windows.r, windows.k FROM windows JOIN firsts ON windows.w = firsts.w AND firsts.low < windows.doc_id),
marked AS (
  SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 50 THEN 0 ELSE 1 END AS begins FROM bad
),
numbered AS (SELECT r, k, sum(begins) OVER (PARTITION BY r ORDER BY k) AS run FROM marked),
spans AS (SELECT r, run, min(k) AS a, max(k) + 50 AS z FROM numbered GROUP BY r, run),
gaps AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans),
pieces AS (
  SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS ends,
    string_agg(hex(array_slice(b, since + 1, a)), '' ORDER BY a) AS head
  FROM gaps JOIN texts USING (r) GROUP BY r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || hex(array_slice(b, coalesce(ends, 0) + 1, octet_length(b))))) AS kept_sha256
FROM texts LEFT JOIN pieces USING (r)
"""
