"""N-gram Jaccard join by count-vector R-trees, and the groups that its links form.

A document is the set of its distinct word shingles; equal sets are one class and
are joined once. Shingles are hashed into ``GROUPS`` groups, and a class is the
point of its counts per group. Two classes share at most the sum of the coordinate
minima of their points, so an R-tree whose nodes keep the largest coordinate per
group (and the range of sizes) leaves out whole subtrees that cannot reach the
threshold. What survives is verified on the sets themselves.

One tree over a corpus would not fit a task, so the trees are built per cell. A cell
holds the classes that have one shingle in their prefix: the first
n - ceil(t * n) + 1 shingles in an order all share; two sets that reach the threshold t
have a prefix shingle in common, so no pair is lost. The order is by digest, with
shingles that were found in many prefixes last, marked in a bit map of fixed size:
passages that many documents share make no cells then. (A bit that two shingles
share only changes the order.)

Links are needed for groups, not for their own sake. First every class is compared
with the nearest and the smallest of its surviving partners. Then cells whose
classes are not all in one group yet give all surviving pairs between groups, so
every link between different groups is found and none is dropped; pairs within one
group are not enumerated again. Classes without a surviving partner are left out
then, and sets are read once, for those that have one. Two classes meet in all cells
of the prefix shingles they share, so they are compared only where the shingles
before it in their prefixes differ, and where enough of both is left from there on:
in the first cell that they share, nothing before it is common. A finer point is
asked last there: one bit per group, set if its count is odd, with at least ``FINE``
groups per shingle up to ``MOST_FINE`` of them. Each bit in which two classes differ is
a shingle that only one of them has, so pairs that share their coarse counts by chance
are not listed. A task gives each pair once, whatever the number of its cells.

Digests of shingles and sets have 64 bits.

Defined results: NULL text and texts without words have an empty set and are alone;
rows with equal sets are one group, also repeated ids; an id that is NULL counts
last, and a group of NULL ids has the NULL id; an empty table gives no rows; other
columns of the documents are not read, ``one_of_each`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common

GROUPS, LEAF = 128, 32
BITS = 24
OFTEN = 20
#: Points of a tree's lowest level that a search gathers at once, or one level if it has more.
GATHERED = 1 << 17
#: Groups per shingle of the finer points, and the most groups they have (powers of two).
FINE, MOST_FINE = 2, 1 << 13
#: Words of finer points that a search compares at once.
COMPARED = 1 << 20
#: Pairs of classes that a task holds to give each of them once.
HELD = 1 << 20


def _joined(digests: np.ndarray, size: int) -> np.ndarray:
    """Digests of all windows of ``size`` words."""
    count = max(0, len(digests) - size + 1)
    joint = np.full(count, size, np.uint64)
    for k in range(size):
        joint = common.mix(joint * np.uint64(0xD6E8FEB86659FD93) + digests[k : count + k])
    return joint


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle digests of each text; a shorter text is one shingle of all its words."""
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    known = coded.dictionary
    data, ends = known.buffers()[2], np.frombuffer(known.buffers()[1], "<i4")[known.offset : known.offset + len(known) + 1].tolist()
    data = data.to_pybytes() if data else b""
    digest = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:])]
    codes, at = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    empty = known.index("").as_py()  # white space at an end of a text leaves an empty word
    if empty >= 0:
        at = np.concatenate([[0], np.cumsum(codes != empty)])[at]
        codes = codes[codes != empty]
    every = np.array(digest, np.uint64)[codes]
    windows = _joined(every, words)
    sets = []
    for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
        if end - start < words:
            sets.append(_joined(every[start:end], end - start)[: end - start])
            continue
        own = np.sort(windows[start : end - words + 1])
        sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
    return sets


def class_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def prefix(own: np.ndarray, percent: int, often: np.ndarray | None) -> np.ndarray:
    size = len(own) - -(-percent * len(own) // 100) + 1
    if often is not None:
        late = marked(often, own)
        if late[:size].any():
            own = np.concatenate([own[~late], own[late]])
    return own[:size]


def point(own: np.ndarray) -> bytes:
    """Counts per group, by low bits (the order goes by high ones), in one byte each if they fit."""
    counts = np.bincount((own & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype("u1" if counts.max() < 256 else "<u4").tobytes()


def odd_groups(own: np.ndarray) -> bytes:
    """One bit per fine group, by low bits, set if its count is odd; the number of groups is a power of two."""
    groups = 64
    while groups < min(FINE * len(own), MOST_FINE):
        groups *= 2
    counts = np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def bit_map(rows: DataFrame, column: str) -> np.ndarray:
    """Marks the low bits of a 64-bit column; the driver gets 2^BITS bits whatever the number of rows."""
    low = F.col(column).bitwiseAND((1 << BITS) - 1)
    words = rows.groupBy(F.shiftright(low, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 AS INT))")).alias("bits")
    ).collect()
    out = np.zeros(1 << (BITS - 6), np.int64)
    for r in words:
        out[r["word"]] = r["bits"]
    return out.view(np.uint8)


def marked(bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    at = (digests & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _read_sets(words: int, percent: int):
    """A row per document, and one per block and class for each prefix shingle."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            sets = shingle_sets(block.column("text"), words)
            classes = np.array([class_of(s) for s in sets], np.int64)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id"), block.column("row_key"), pa.array(classes),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([point(s) for s in sets]), pa.nulls(n, pa.int64()),
            ], ["doc_id", "row_key", "class", "n", "point", "key"])
            first = {c: s for c, s in zip(classes.tolist(), sets) if len(s)}
            keys = [prefix(s, percent, None) for s in first.values()]
            if keys:
                every = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    *(pa.nulls(len(every), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())),
                    pa.array(every),
                ], ["doc_id", "row_key", "class", "n", "point", "key"])

    return read


def _prefixes(words: int, percent: int, often):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            sets = {class_of(s): s for s in shingle_sets(block.column("text"), words) if len(s)}
            keys = [prefix(s, percent, often.value) for s in sets.values()]
            if keys:
                lengths = [len(k) for k in keys]
                owner, every = np.repeat(np.array(list(sets), np.int64), lengths), np.concatenate(keys).view(np.int64)
                # The shingle before; the first one has its own class there, which no other has.
                before = np.concatenate([every[:1], every[:-1]])
                first = np.cumsum([0, *lengths[:-1]])
                before[first] = owner[first]
                place = np.arange(len(every)) - np.repeat(first, lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column) for column in (every, owner, before, place)], ["key", "class", "before", "place"]
                )

    return read


def _wanted_sets(words: int, wanted):
    """Sets of the documents that the bit map of ``row_key`` marks, and their finer points."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("row_key").to_numpy().view(np.uint64)
            chosen = batch.take(pa.array(np.flatnonzero(marked(wanted.value, keys))))
            for block in common.blocks(iter([chosen])):
                sets = shingle_sets(block.column("text"), words)
                yield pa.RecordBatch.from_arrays([
                    block.column("row_key"), pa.array([s.tobytes() for s in sets], pa.binary()),
                    pa.array([odd_groups(s) for s in sets], pa.binary()),
                ], ["row_key", "shingles", "odd"])

    return read


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key``, cut only between keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif held and held[0].column("key")[0].as_py() != keys[0]:
            yield pa.concat_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, class) in this order, each once, those whose key has two classes at least."""
    for batch in _by_key(batches):
        key, owner = batch.column("key").to_numpy(), batch.column("class").to_numpy()
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        key, owner = key[new], owner[new]
        before, place = (batch.column(c).to_numpy()[new] for c in ("before", "place"))
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.repeat(np.diff([*start, len(key)]), np.diff([*start, len(key)])) > 1
        if many.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(column[many]) for column in (key, owner, before, place)], ["key", "class", "before", "place"]
            )


class CountTree:
    """An R-tree over the points of one cell, packed in order of size; level 0 are the points."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        self.upper, self.low, self.high = [points], [sizes], [sizes]
        while len(self.upper[-1]) > LEAF:
            at = np.arange(0, len(self.upper[-1]), LEAF)
            self.upper.append(np.maximum.reduceat(self.upper[-1], at))
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))

    def reach(self, level: int, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which of the nodes may hold something as similar to the points ``q`` as asked for."""
        p, size = self.percent, self.low[0][q]
        at = np.flatnonzero((100 * self.high[level][nodes] >= p * size) & (p * self.low[level][nodes] <= 100 * size))
        nodes, q, size = nodes[at], q[at], size[at]
        least = np.maximum(self.low[level][nodes], (p * size + 99) // 100)
        return at[(100 + p) * shared(self.upper[level][nodes], self.upper[0][q]) >= p * (size + least)]

    def pairs(self, before: np.ndarray, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Surviving pairs (earlier, later) in order of size that differ in ``before``, and in ``group`` if given."""
        count = len(self.low[0])
        step = max(1, min(64, GATHERED // count))
        for first in range(0, count, step):
            q = np.arange(first, min(first + step, count))
            top = len(self.upper) - 1
            nodes = np.tile(np.arange(len(self.upper[top])), len(q))
            q = np.repeat(q, len(self.upper[top]))
            for level in range(top, -1, -1):
                if not level:
                    asked = (nodes < q) & (before[nodes] != before[q])
                    if group is not None:
                        asked &= group[nodes] != group[q]
                    nodes, q = nodes[asked], q[asked]
                kept = self.reach(level, nodes, q)
                nodes, q = nodes[kept], q[kept]
                if level:
                    below = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                    q = np.repeat(q, LEAF)[below < len(self.upper[level - 1])]
                    nodes = below[below < len(self.upper[level - 1])]
            yield nodes, q


def shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The most that two sets can share, by the counts of their groups."""
    return np.minimum(one, two).sum(axis=1, dtype=np.int64)


def points_of(batch: pa.RecordBatch) -> np.ndarray:
    found = batch.column("point").to_pylist()
    if all(len(p) == GROUPS for p in found):
        return np.frombuffer(b"".join(found), "u1").reshape(-1, GROUPS)
    return np.stack([np.frombuffer(p, "u1" if len(p) == GROUPS else "<u4").astype(np.uint32) for p in found])


class FinePoints:
    """The finer points of the rows of a batch (``odd_groups``), of any sizes."""

    def __init__(self, odd: pa.Array):
        found = odd.to_pylist()
        self.words = np.frombuffer(b"".join(found), "<u8")
        self.length = np.array([len(p) // 8 for p in found], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def folded(self, rows: np.ndarray, length: int) -> np.ndarray:
        """The points with so many words only: what falls into one group is odd if an odd number of its parts is."""
        out = self.words[self.start[rows, None] + np.arange(length)]
        parts = self.length[rows] // length
        for part in range(1, parts.max(initial=1)):
            more = np.flatnonzero(parts > part)
            out[more] ^= self.words[self.start[rows[more], None] + np.arange(part * length, (part + 1) * length)]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The fewest shingles that only one of two sets has."""
        out = np.zeros(len(a), np.int64)
        least = np.minimum(self.length[a], self.length[b])
        for length in np.unique(least).tolist():
            those = np.flatnonzero(least == length)
            step = max(1, COMPARED // length)
            for at in (those[k : k + step] for k in range(0, len(those), step)):
                differ = self.folded(a[at], length) ^ self.folded(b[at], length)
                out[at] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        return out


def surviving(
    batch: pa.RecordBatch, points: np.ndarray, percent: int, group: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of each cell that the points and places leave possible. Cells of one small size are searched side by side.

    In the first cell that two classes share, all that they share comes from there on.
    """
    key, size, before, place = (batch.column(c).to_numpy() for c in ("key", "n", "before", "place"))
    rest = size - place
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    members = np.diff([*start, len(key)])
    for count in np.unique(members[members <= LEAF]):
        cells = start[members == count]
        for i, j in combinations(range(count), 2):
            a, b = cells + i, cells + j
            asked = before[a] != before[b] if group is None else (before[a] != before[b]) & (group[a] != group[b])
            a, b = a[asked], b[asked]
            near = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
            a, b = a[near], b[near]
            late = (100 + percent) * np.minimum(rest[a], rest[b]) < percent * (size[a] + size[b])
            a, b = a[~late], b[~late]
            kept = (100 + percent) * shared(points[a], points[b]) >= percent * (size[a] + size[b])
            yield a[kept], b[kept]
    for first, count in zip(start[members > LEAF], members[members > LEAF]):
        order = first + np.argsort(size[first : first + count], kind="stable")
        tree = CountTree(points[order], size[order], percent)
        for a, b in tree.pairs(before[order], None if group is None else group[order]):
            a, b = order[a], order[b]
            kept = (100 + percent) * np.minimum(rest[a], rest[b]) >= percent * (size[a] + size[b])
            yield a[kept], b[kept]


def _partners(percent: int):
    """Per class the nearest surviving partner (by the bound) and the smallest one, over the cells of a batch."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_key(batches):
            owner, size = batch.column("class").to_numpy(), batch.column("n").to_numpy()
            points = points_of(batch)
            near: dict[int, tuple[float, int]] = {}
            least: dict[int, int] = {}
            for a, b in surviving(batch, points, percent):
                most = shared(points[a], points[b])
                bound = most / (size[a] + size[b] - most)
                one, two = np.concatenate([owner[a], owner[b]]), np.concatenate([owner[b], owner[a]])
                bound = np.concatenate([bound, bound])
                order = np.lexsort((two, -bound, one))
                for k in order[np.concatenate([[True], one[order][1:] != one[order][:-1]])[: len(order)]]:
                    c = int(one[k])
                    near[c] = max(near.get(c, (-1.0, 0)), (float(bound[k]), -int(two[k])))
                order = np.lexsort((two, one))
                for k in order[np.concatenate([[True], one[order][1:] != one[order][:-1]])[: len(order)]]:
                    c = int(one[k])
                    least[c] = min(least.get(c, int(two[k])), int(two[k]))
            yield pa.RecordBatch.from_arrays([
                pa.array(list(near), pa.int64()), pa.array([v[0] for v in near.values()], pa.float64()),
                pa.array([-v[1] for v in near.values()], pa.int64()), pa.array([least[c] for c in near], pa.int64()),
            ], ["class", "bound", "near", "least"])

    return search


def _pairs_between(percent: int):
    """Surviving pairs of classes whose groups differ, each once per task as long as ``HELD`` pairs can be held.

    Pairs whose finer points (``odd``, if the rows have them) differ too much are not given.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((2, 0), np.int64)
        for batch in _by_key(batches):
            owner, group, size = (batch.column(c).to_numpy() for c in ("class", "label", "n"))
            fine = FinePoints(batch.column("odd")) if "odd" in batch.schema.names else None
            found = []
            for a, b in surviving(batch, points_of(batch), percent, group):
                if fine is not None:
                    both = size[a] + size[b]
                    kept = (100 + percent) * (both - fine.apart(a, b)) >= 2 * percent * both
                    a, b = a[kept], b[kept]
                if len(a):
                    found.append((owner[a], owner[b]))
            if found:
                one, two = (np.concatenate(side) for side in zip(*found))
                held = np.unique(np.concatenate([held, np.stack([np.minimum(one, two), np.maximum(one, two)])], axis=1), axis=1)
            if held.shape[1] > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["a", "b"])
                held = held[:, :0]
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["a", "b"])

    return search


def _reached(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                one, two = (np.frombuffer(s.as_buffer(), "<u8") for s in (left, right))
                both = len(np.intersect1d(one, two, assume_unique=True))
                kept.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return verify


def groups(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``class, label``: the smallest class reachable by edges (``a, b``), or after some rounds one that is."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    done = 0
    while rounds is None or done < rounds:
        near = both.join(labels, both["b"] == labels["class"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["class"] == near["a"]).select(
            "class", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        lower = materialize(lower)
        ahead = lower.select(F.col("class").alias("at"), F.col("label").alias("next"))
        labels = materialize(lower.join(ahead, F.col("label") == F.col("at")).select("class", "was", F.col("next").alias("label")))
        done += 1
        if rounds is None and not labels.where(F.col("was") != F.col("label")).limit(1).count():
            break
        labels = labels.select("class", "label")
    return labels.select("class", "label")


def components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: ``doc_id, row_key, n_shingles, component_id``."""
    return _labelled(docs, words, percent).drop("label")


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """As ``components``, with the ``label`` of the document's group; it is NULL without shingles."""
    spark = docs.sparkSession
    parts = common.shuffle_parts(spark)
    read = common.texts(docs, common.row_key().alias("row_key")).withColumn("doc_id", F.col("doc_id").cast("long"))
    table = materialize(read.mapInArrow(
        _read_sets(words, percent), "doc_id long, row_key long, class long, n long, point binary, key long"
    ))
    own = table.where(F.col("key").isNull()).select("doc_id", "row_key", "class", "n", "point")
    counted = table.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    often = spark.sparkContext.broadcast(bit_map(counted.where(F.col("times") > OFTEN), "key"))
    cells = materialize(
        read.select("text").mapInArrow(_prefixes(words, percent, often), "key long, class long, before long, place long")
        .repartition(parts, "key").sortWithinPartitions("key", "class")
        .mapInArrow(_shared, "key long, class long, before long, place long")
    )
    classes = materialize(own.where(F.col("n") > 0).groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.first("n").alias("n"),
        F.first("point").alias("point"),
    ))
    points = classes.select("class", "n", "point")

    def in_cells(rows: DataFrame, points: DataFrame, search, schema: str) -> DataFrame:
        return rows.join(points, "class").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(search, schema)

    partners = in_cells(cells, points, _partners(percent), "class long, bound double, near long, least long").groupBy("class").agg(
        F.max_by("near", F.struct("bound", -F.col("near"))).alias("near"), F.min("least").alias("least")
    )
    first = materialize(
        partners.select("class", F.explode(F.array("near", "least")).alias("other"))
        .select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
    )

    # Every class that has a surviving partner anywhere is in one of these pairs, so their sets are read once.
    asked = first.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    chosen = materialize(asked.join(classes, "class").select("class", "row_key"))
    wanted = spark.sparkContext.broadcast(bit_map(chosen, "row_key"))
    sets = materialize(
        read.select("row_key", "text").mapInArrow(_wanted_sets(words, wanted), "row_key long, shingles binary, odd binary")
        .join(common.broadcast_if_small(chosen, F.lit(16)), "row_key").select("class", "shingles", "odd").dropDuplicates(["class"])
    )

    def verified(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("left"))
        two = sets.select(F.col("class").alias("b"), F.col("shingles").alias("right"))
        return materialize(pairs.join(one, "a").join(two, "b").mapInArrow(_reached(percent), "a long, b long"))

    links = verified(first)
    labels = groups(links)
    labelled = cells.join(common.broadcast_if_small(chosen.select("class"), F.lit(8)), "class").join(
        common.broadcast_if_small(labels, F.lit(16)), "class", "left"
    ).select("key", "class", "before", "place", F.coalesce("label", "class").alias("label"))
    open_keys = labelled.groupBy("key").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("key")
    finer = points.join(sets.select("class", "odd"), "class")
    between = in_cells(labelled.join(open_keys, "key"), finer, _pairs_between(percent), "a long, b long")
    second = materialize(between.distinct().join(first, ["a", "b"], "left_anti"))
    links = links.union(verified(second))
    grouped = classes.select("class", "doc_id").join(groups(links), "class", "left").select(
        "class", "doc_id", F.coalesce("label", "class").alias("label")
    )
    grouped = materialize(grouped)
    smallest = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(smallest, "label").select("class", "component_id", "label")
    return own.join(named, "class", "left").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "label",
    )


def one_of_each(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """The documents without those that another one of their group stands for, with their own columns.

    The smallest id of a group stays, NULL ids last; of rows with that id, the one with the smallest digest. Only ids and
    digests are joined, not texts.
    """
    found = materialize(_labelled(docs, words, percent))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    stays = materialize(
        found.where(F.col("label").isNotNull()).groupBy("label")
        .agg(F.min_by("row_key", first).alias("stays"), (F.min("row_key") != F.max("row_key")).alias("many"))
        .where("many").select("label", "stays")
    )
    gone = materialize(
        found.join(common.broadcast_if_small(stays, F.lit(16)), "label").where(F.col("row_key") != F.col("stays"))
        .select(F.col("row_key").alias("__gone")).distinct()
    )
    keyed = docs.withColumn("__row", common.row_key())
    kept = keyed.join(common.broadcast_if_small(gone, F.lit(8)), F.col("__row") == F.col("__gone"), "left_anti")
    again = materialize(
        found.where(F.col("n_shingles") > 0).groupBy("row_key").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
        .select(F.col("row_key").alias("__many"))
    )
    marked = kept.join(common.broadcast_if_small(again, F.lit(8)), F.col("__row") == F.col("__many"), "left")
    single = marked.where(F.col("__many").isNull()).select(*docs.columns)
    repeated = marked.where(F.col("__many").isNotNull()).dropDuplicates(["__row"]).select(*docs.columns)
    return single.unionByName(repeated)
