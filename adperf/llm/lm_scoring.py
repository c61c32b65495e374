"""Language-model scores from a weighted backoff automaton.

Words and word pairs of the training texts are the arcs of an automaton: the
root has an arc for every word, a state for each word has an arc for every word
seen after it, and a failure arc to the root. With c the training counts and
``strength`` the weight of the shorter history (Dirichlet smoothing),

    root arc      log10 (c(w) + 1) / (N + V + 1)
    arc           log10 (c(hw) + strength * P(w)) / (c(h) + strength)
    failure arc   log10 strength / (c(h) + strength)

so that from every state the words and one unknown word add up to one. A text is
read once from left to right: each word takes the arc of the state or the failure
arc and the root's, and leads to the state of that word.

The counts cover the whole corpus, so no task holds the automaton. Documents are
read in blocks; a block sends the digests of its distinct words and pairs, packed
by ranges of the digest, with its own training counts. Each range adds up what
all blocks sent and answers every block in the block's own order. A block then
has the part of the automaton that its texts can reach, and traverses them. A very
common word is one digest in each block. Digests have 64 bits; two entries that
share one would add their counts.

Defined results: NULL text counts as empty and is scored as its end alone;
repeated rows are scored once each and counted as often as they occur; without
training texts every word has the root's single unknown arc; an empty table
gives no rows; other columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common

START, END = b" s", b" e"  # no word has a space
BLOCK_BYTES = 8 << 20
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
TEXTS, WORDS, PAIRS = 0, 1, 2


class Block:
    """Words and pairs of some texts, each numbered in the order of its digest."""

    def __init__(self, texts: pa.Array):
        split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts))
        found = split.flatten()
        whole = pa.compute.binary_length(found).to_numpy() > 0  # white space at an edge leaves an empty word
        text_of = np.repeat(np.arange(len(split)), pa.compute.list_value_length(split).to_numpy())[whole]
        coded = found.filter(pa.array(whole)).dictionary_encode()
        known = len(coded.dictionary)
        lengths = np.bincount(text_of, minlength=len(split)) + 2
        self.first = np.cumsum([0, *lengths[:-1]])
        ids = np.empty(int(lengths.sum()), np.int32)
        ids[np.arange(len(text_of)) + 2 * text_of + 1] = coded.indices.to_numpy()
        ids[self.first], ids[self.first + lengths - 1] = known, known + 1
        digests = np.array(
            [*map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), *map(xxhash.xxh3_64_intdigest, (START, END))],
            np.uint64,
        )
        self.words, number = np.unique(digests, return_inverse=True)
        ids = number.astype(np.int32)[ids]
        self.owner = np.repeat(np.arange(len(texts)), lengths - 1)
        follows = np.ones(len(ids), bool)
        follows[self.first] = False
        at = np.flatnonzero(follows)
        self.state, self.word = ids[at - 1], ids[at]
        pairs, order = np.unique(self.state.astype(np.int64) << 32 | self.word, return_inverse=True)
        joint = common.mix(common.mix(self.words[pairs >> 32]) + self.words[pairs & 0xFFFFFFFF] * np.uint64(0xD6E8FEB86659FD93))
        self.pairs, number = np.unique(joint, return_inverse=True)
        self.pair = number[order]
        self.start, self.end = (
            np.searchsorted(self.words, np.uint64(xxhash.xxh3_64_intdigest(mark))) for mark in (START, END)
        )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in numbered blocks; they are stored, so that both uses have the same ones."""
    block = TaskContext.get().partitionId() << 32
    for rows in common.blocks(batches, BLOCK_BYTES):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_batch(rows)
        payload = zstandard.compress(sink.getvalue(), 3)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.array([TEXTS], pa.int32()),
             pa.array([payload], pa.binary())], ["block", "part", "kind", "payload"],
        )
        block += 1


def _rows(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(payload)).read_all().combine_chunks()


def _send(parts: int):
    """For every range of digests those of a block, with its training counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                rows = _rows(payload.as_buffer())
                found = Block(rows.column("text").chunk(0))
                train = ~rows.column("held_out").to_numpy()[found.owner]
                out = []
                for kind, digests, used in ((WORDS, found.words, found.word), (PAIRS, found.pairs, found.pair)):
                    counts = np.bincount(used[train], minlength=len(digests)).astype(np.uint32)
                    ends = [*np.searchsorted(digests, common.ends(parts)), len(digests)]
                    for part in range(parts):
                        a, b = ends[part], ends[part + 1]
                        if a < b:
                            steps = np.diff(digests[a:b], prepend=np.uint64(0))
                            out.append((block, part, kind, common.pack(steps), common.pack(counts[a:b])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in
                     zip(zip(*out), [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])],
                    ["block", "part", "kind", "payload", "counts"],
                )

    return send


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one range: the summed counts, to each block in its order, and one row with the range's totals."""
    for run in common.runs(batches, ["part", "kind"]):
        sent = [np.cumsum(common.unpack(r["payload"], "<u8"), dtype=np.uint64) for r in run]
        digests, number = np.unique(np.concatenate(sent), return_inverse=True)
        own = np.concatenate([common.unpack(r["counts"], "<u4") for r in run])
        counts = np.bincount(number, own, len(digests)).astype(np.int64)
        ends = np.cumsum([len(s) for s in sent])[:-1]
        kind, part = run[0]["kind"], run[0]["part"]
        answers = [common.pack(counts[n].astype(np.uint32)) for n in np.split(number, ends)]
        blocks = [r["block"] for r in run]
        total, known = (int(counts.sum()), int((counts > 0).sum())) if kind == WORDS else (0, 0)
        size = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*blocks, None], pa.int64()), pa.array([part] * (size + 1), pa.int32()),
             pa.array([kind] * (size + 1), pa.int32()), pa.array([*answers, None], pa.binary()),
             pa.array([None] * size + [total], pa.int64()), pa.array([None] * size + [known], pa.int64())],
            ["block", "part", "kind", "payload", "tokens", "types"],
        )


class Automaton:
    """The arcs that one block's texts can reach."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, tokens: int, types: int, strength: float):
        self.block = block
        root = (words + 1.0) / (tokens + types + 1)
        context = words.astype(float)
        context[block.start] = words[block.end]  # every training text has one start and one end
        self.root = np.log10(root)
        self.fail = np.log10(strength / (context + strength))
        self.known = words > 0
        state, word = np.empty(len(pairs), np.int64), np.empty(len(pairs), np.int64)
        state[block.pair], word[block.pair] = block.state, block.word
        self.seen = pairs > 0
        self.arc = np.log10((pairs + strength * root[word]) / (context[state] + strength))

    def traverse(self, size: int) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, root score, score. After a word the state is that word's."""
        b = self.block
        weight = np.where(self.seen[b.pair], self.arc[b.pair], self.fail[b.state] + self.root[b.word])
        add = lambda values: np.bincount(b.owner, values, size)
        return np.bincount(b.owner, minlength=size), add(self.known[b.word]), add(self.root[b.word]), add(weight)


def _score(tokens: int, types: int, strength: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in common.runs(batches, ["block"]):
            rows = _rows(run[0]["payload"])
            block = Block(rows.column("text").chunk(0))
            counts = {
                kind: np.concatenate([common.unpack(r["payload"], "<u4") for r in run if r["kind"] == kind])
                for kind in (WORDS, PAIRS)
            }
            automaton = Automaton(block, counts[WORDS], counts[PAIRS], tokens, types, strength)
            n, known, base, total = automaton.traverse(rows.num_rows)
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id").combine_chunks(), rows.column("held_out").combine_chunks(),
                pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                pa.array(np.full(len(n), tokens, np.int64)), pa.array(base), pa.array(total),
            ], [part.split()[0] for part in SCORES.split(", ")])

    return score


def lm_scores(docs: DataFrame, held_out, strength: float = 1000.0) -> DataFrame:
    """One row per document, learned from those whose ``held_out`` is false."""
    read = common.texts(docs, held_out.alias("held_out")).withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = common.range_parts(read)
    sent = materialize(read.mapInArrow(_blocks, "block long, part int, kind int, payload binary"))
    asked = sent.mapInArrow(_send(parts), "block long, part int, kind int, payload binary, counts binary")
    answered = materialize(
        asked.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(
            _answer, "block long, part int, kind int, payload binary, tokens long, types long"
        )
    )
    tokens, types = (
        answered.where(F.col("block").isNull())
        .agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    )
    columns = ["block", "kind", "part", "payload"]
    together = sent.select(*columns).unionByName(
        answered.where(F.col("block").isNotNull()).select(*columns)
    )
    return (
        together.repartition(parts, "block").sortWithinPartitions("block", "kind", "part")
        .mapInArrow(_score(tokens, types, strength), SCORES)
    )
