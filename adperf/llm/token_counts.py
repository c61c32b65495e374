"""Token counts from distinct pre-tokens.

Documents are read in blocks. A block keeps how often each of its documents holds
each distinct pre-token, and sends its distinct pre-tokens by ranges of their
digest. A range counts the pieces of every pre-token once, however many blocks
sent it, and answers each block in the block's order; the block joins the answers
to its frequencies and sums per document. No token ids are kept. A pre-token is one
entry of a block however many documents hold it, so a very common one is sent no
more often than there are blocks.

Defined results: NULL text counts as empty, with no bytes and no tokens;
repeated rows give one row each; an empty table gives no rows; other columns of
the documents are not read.
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
from .wordbpe import tokenizer, words_of

BLOCK_BYTES = 8 << 20
SENT = "block long, part int, payload binary"
COUNTS = "doc_id long, n_bytes long, n_tokens long"


def _send(tokenizer_path: str, parts: int):
    """Per block the frequencies of its documents (no part), and for each range the pre-tokens it asks for."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for rows in common.blocks(batches, BLOCK_BYTES):
            words, held, direct = [], np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
            for place, text in enumerate(rows.column("text").to_pylist()):
                own = words_of(text)
                if own is None:
                    direct[place] = tokenizer(tokenizer_path).count_text(text)
                else:
                    words += own
                    held[place] = len(own)
            coded = pa.array(words, pa.string()).dictionary_encode()
            del words
            distinct = coded.dictionary.to_pylist()
            digests = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)
            part = np.searchsorted(common.ends(parts), digests, side="right") - 1
            order = np.lexsort((np.argsort(pa.compute.sort_indices(coded.dictionary).to_numpy()), part))
            number = np.argsort(order)[coded.indices.to_numpy()]  # words in the order they are sent
            pairs, times = np.unique(np.repeat(np.arange(rows.num_rows), held) << 32 | number, return_counts=True)
            frequencies = pa.RecordBatch.from_arrays([
                rows.column("doc_id"), pa.compute.binary_length(rows.column("text")).cast(pa.int64()), pa.array(direct),
                pa.array(np.bincount(pairs >> 32, minlength=rows.num_rows)),
            ], ["doc_id", "n_bytes", "direct", "distinct"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, frequencies.schema) as writer:
                writer.write_batch(frequencies)
            packed = [zstandard.compress(sink.getvalue().to_pybytes(), 3),
                      common.pack((pairs & 0xFFFFFFFF).astype(np.uint32)), common.pack(times.astype(np.uint32))]
            out = [(block, -1 - k, data) for k, data in enumerate(packed)]
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                asked = "\n".join(distinct[i] for i in order[bounds[k] : bounds[k + 1]])
                out.append((block, k, zstandard.compress(asked.encode(), 3)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32(), pa.binary()])],
                ["block", "part", "payload"],
            )
            block += 1

    return send


def _answer(tokenizer_path: str):
    """For one range: pieces of each distinct pre-token, counted once, to each block in its order."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in common.runs(batches, ["part"]):
            asked = [zstandard.decompress(r["payload"]).decode().split("\n") for r in run]
            coded = pa.array([w for words in asked for w in words], pa.string()).dictionary_encode()
            pieces = tokenizer(tokenizer_path).count(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            ends = np.cumsum([len(words) for words in asked])[:-1]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["block"] for r in run], pa.int64()), pa.array([r["part"] for r in run], pa.int32()),
                pa.array([common.pack(own.astype(np.uint32)) for own in np.split(pieces, ends)], pa.binary()),
            ], ["block", "part", "payload"])

    return answer


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one block: its frequencies joined to the pieces, summed per document."""
    for run in common.runs(batches, ["block"]):
        own = {r["part"]: r["payload"] for r in run if r["part"] < 0}
        rows = pa.ipc.open_stream(zstandard.decompress(own[-1])).read_all()
        number, times = common.unpack(own[-2], "<u4"), common.unpack(own[-3], "<u4")
        pieces = [common.unpack(r["payload"], "<u4") for r in run if r["part"] >= 0]
        pieces = np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
        place = np.repeat(np.arange(rows.num_rows), rows.column("distinct").to_numpy())
        joined = np.bincount(place, pieces[number].astype(np.int64) * times, rows.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([
            rows.column("doc_id").combine_chunks(), rows.column("n_bytes").combine_chunks(),
            pa.array(rows.column("direct").to_numpy() + joined),
        ], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens``."""
    read = common.texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = common.range_parts(read)
    sent = materialize(read.mapInArrow(_send(tokenizer_path, parts), SENT))
    answers = (
        sent.where(F.col("part") >= 0).repartition(parts, "part").sortWithinPartitions("part")
        .mapInArrow(_answer(tokenizer_path), SENT)
    )
    together = sent.where(F.col("part") < 0).unionByName(answers)
    return together.repartition(parts, "block").sortWithinPartitions("block", "part").mapInArrow(_sum, COUNTS)
