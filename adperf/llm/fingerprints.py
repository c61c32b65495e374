"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is the set of its paragraphs' digests; long paragraphs are cut at sentence
ends and long sentences every eight words, and a paragraph that comes again counts
as another one. A sketch has three tables of cells; each digest is added to one
cell of each: a count, the XOR of digests and the XOR of their check words. Two
sketches subtract cell by cell, which leaves what differs. Cells that hold a single
digest are peeled until nothing is left; when the peeling stops early, both are
sketched again with four times the cells. Likeness is the share of digests that
the two have in common: 1 - differing / (first + second), and 1 for two empty texts.

Defined results: NULL text counts as empty; documents are ordered by falling id,
equal ids by text, NULL ids last; the last one's neighbour is the first, and a
single document is its own neighbour; an empty table gives no rows; other columns
of the documents are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TABLES, SLOTS, GROWTH = 3, 8, 4
_TURN = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_CELL = np.dtype([("count", "<i2"), ("key", "<u8"), ("check", "<u4")])
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def paragraphs(text: str) -> list[str]:
    pieces = []
    for line in text.split("\n"):
        line = line.strip()
        if len(line) <= 80:
            pieces.append(line)
            continue
        for sentence in _SENTENCE.split(line):
            words = sentence.split()
            pieces += [" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
    return [p for p in pieces if p]


def digests(text: str) -> np.ndarray:
    """One per paragraph; the second and later times a paragraph comes are told apart."""
    keys = np.array([xxhash.xxh3_64_intdigest(p) for p in paragraphs(text)], np.uint64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    place = np.arange(len(keys))
    again = np.concatenate([[False], keys[1:] == keys[:-1]]) if len(keys) else np.zeros(0, bool)
    times = place - np.maximum.accumulate(np.where(again, 0, place)) if len(keys) else place
    return keys + times.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)


def _check(keys: np.ndarray) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)).astype(np.uint32)


class Sketches:
    """Many sketches side by side, each with its own number of slots (a power of two) per table."""

    def __init__(self, slots: np.ndarray):
        self.shift = (64 - np.round(np.log2(slots)).astype(np.int64)).astype(np.uint64)
        self.slots = slots.astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.slots * TABLES)])
        size = int(self.start[-1])
        self.count, self.key = np.zeros(size, np.int32), np.zeros(size, np.uint64)
        self.check = np.zeros(size, np.uint32)

    def cells(self, owner: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        return [
            self.start[owner] + t * self.slots[owner] + ((keys * _TURN[t]) >> self.shift[owner]).astype(np.int64)
            for t in range(TABLES)
        ]

    def add(self, owner: np.ndarray, keys: np.ndarray, sign) -> list[np.ndarray]:
        """Add (sign 1) or take away (-1); gives the touched cells."""
        check, touched = _check(keys), self.cells(owner, keys)
        for at in touched:
            np.add.at(self.count, at, np.broadcast_to(np.asarray(sign, np.int32), at.shape))
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)
        return touched

    def text(self, k: int) -> str:
        a, b = self.start[k], self.start[k + 1]
        cells = np.empty(b - a, _CELL)
        cells["count"], cells["key"], cells["check"] = self.count[a:b] & 0x7FFF, self.key[a:b], self.check[a:b]
        return base64.b64encode(cells.tobytes()).decode()

    def minus(self, other: "Sketches", left: np.ndarray, right: np.ndarray) -> "Sketches":
        """Sketch ``left[i]`` of this without ``right[i]`` of the other; all have the same slots."""
        out = Sketches(self.slots[left])
        width = np.arange(TABLES * SLOTS)
        a, b = (self.start[left][:, None] + width).ravel(), (other.start[right][:, None] + width).ravel()
        out.count[:] = self.count[a] - other.count[b]
        out.key[:], out.check[:] = self.key[a] ^ other.key[b], self.check[a] ^ other.check[b]
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """Per sketch the number of recovered digests, and whether nothing is left. Empties the cells."""
        owner_of = np.repeat(np.arange(len(self.slots)), self.slots * TABLES)
        found = np.zeros(len(self.slots), np.int64)
        look = np.arange(len(self.count))
        while len(look):
            single = look[(np.abs(self.count[look]) == 1) & (self.check[look] == _check(self.key[look]))]
            if not len(single):
                break
            owner, keys, sign = owner_of[single], self.key[single].copy(), self.count[single].copy()
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])])
            owner, keys, sign = owner[new], keys[new], sign[new]
            found += np.bincount(owner, minlength=len(found))
            look = np.unique(np.concatenate(self.add(owner, keys, -sign)))
        left = np.bincount(owner_of, (self.count != 0) | (self.key != 0), len(found))
        return found, left == 0


def sketches(many: list[np.ndarray], slots: np.ndarray) -> Sketches:
    made = Sketches(slots)
    if len(many):
        made.add(np.repeat(np.arange(len(many)), [len(k) for k in many]), np.concatenate(many), 1)
    return made


def differing(one: list[np.ndarray], two: list[np.ndarray], left: Sketches, right: Sketches, at: np.ndarray) -> np.ndarray:
    """How many digests ``one[i]`` and ``two[i]`` do not share; ``right[at[i]]`` is the sketch of ``two[i]``."""
    pairs = np.arange(len(one))
    found, whole = left.minus(right, pairs, at).peel()
    slots = SLOTS
    while not whole.all():
        slots *= GROWTH
        again = np.flatnonzero(~whole)
        size = np.full(len(again), slots)
        both = sketches([one[i] for i in again], size)
        if sum(len(two[i]) for i in again):
            both.add(
                np.repeat(np.arange(len(again)), [len(two[i]) for i in again]),
                np.concatenate([two[i] for i in again]), -1,
            )
        found[again], whole[again] = both.peel()
    return found


def compare(texts: list[str], following: list[str]) -> dict[str, list]:
    """Fingerprints of the texts, of their edited versions, and the likeness to these and to the following texts."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following)]
    own, new = [digests(t) for t in texts], [digests(t) for t in edited]
    after = own[1:] + [digests(following[-1])]  # a block's texts follow each other
    base = lambda many: sketches(many, np.full(len(many), SLOTS))
    first, second, third = base(own), base(new), base(after)

    def near(two, right):
        apart = differing(own, two, first, right, np.arange(len(own)))
        size = np.array([len(a) + len(b) for a, b in zip(own, two)])
        return 1.0 - apart / np.maximum(size, 1)

    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": [first.text(k) for k in range(len(texts))],
        "edited_fingerprint": [second.text(k) for k in range(len(texts))],
        "near_edited": near(new, second),
        "near_next": near(after, third),
    }


def _compare_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of ids, in falling order, each followed by copies of the next range's first document."""
    held: list[tuple] = []
    size = 0

    def result(rows: list[tuple], after: str) -> pa.RecordBatch:
        texts = [r[2] for r in rows]
        made = compare(texts, texts[1:] + [after])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in rows], pa.int64()), *(pa.array(v) for v in made.values())], ["doc_id", *made]
        )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("range", "doc_id", "text", "copy"))
        for key, doc_id, text, copy in zip(*columns):
            if held and held[-1][0] != key:
                raise ValueError(f"range {held[-1][0]} has no copy of the document that follows it")
            if copy:
                if held:  # the first copy ends the range; more of them are rows with the same id
                    yield result(held, text)
                    held, size = [], 0
                continue
            if held and size > common.BLOCK_BYTES // 2:
                yield result(held, text)
                held, size = [], 0
            held.append((key, doc_id, text))
            size += len(text)
    if held:
        raise ValueError(f"range {held[-1][0]} has no copy of the document that follows it")


def _highest_of(steps: np.ndarray):
    """The highest key of each range of a batch; a range goes up to its step, the last one has none."""

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.sort(batch.column("key").to_numpy())
            number = np.searchsorted(steps, keys)
            last = np.flatnonzero(np.append(number[1:] != number[:-1], True)) if len(keys) else number
            yield pa.RecordBatch.from_arrays([pa.array(number[last].astype(np.int32)), pa.array(keys[last])], ["range", "key"])

    return highest


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document with its own and the edited text's fingerprint and their likeness."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    read = common.texts(docs, key.alias("key")).withColumn("doc_id", F.col("doc_id").cast("long"))
    ranges = 4 * common.shuffle_parts(spark)
    ids = read.select("key")
    if ids.first() is None:
        return spark.createDataFrame([], RESULT)
    steps = ids.approxQuantile("key", [(k + 1) / ranges for k in range(ranges - 1)], 1 / (4 * ranges))
    # Quantiles are doubles, which are no ids above 2^53; each bound is an id that exists, the first of its range in falling order.
    steps = np.array(sorted({min(int(s), (1 << 63) - 1) for s in steps}), np.int64)
    highest = ids.mapInArrow(_highest_of(steps), "range int, key long").groupBy("range").agg(F.max("key").alias("key"))
    bounds = np.array(sorted(r["key"] for r in highest.collect()), np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            number = np.searchsorted(bounds, keys)
            first = np.flatnonzero(bounds[number] == keys)
            again = batch.take(pa.array(first))
            for rows, at, copy in ((batch, number, 0), (again, (number[first] + 1) % len(bounds), 1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int32)), *(rows.column(c) for c in ("doc_id", "text", "key")),
                     pa.array(np.full(rows.num_rows, copy, np.int32))],
                    ["range", "doc_id", "text", "key", "copy"],
                )

    return (
        read.select("doc_id", "text", "key")
        .mapInArrow(place, "range int, doc_id long, text string, key long, copy int")
        .repartition(common.shuffle_parts(spark), "range")
        .sortWithinPartitions("range", "copy", F.desc("key"), "text")
        .mapInArrow(_compare_in_order, RESULT)
    )
