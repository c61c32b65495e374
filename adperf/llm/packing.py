"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of
the longest as fit, then one for each binary digit of the rest. Each piece is a
sequence of its own, so no sequence crosses documents and none is padded; pieces
of one length form a bucket from which batches of equal length are drawn. The
work is one pass over the documents without a shuffle.

Defined results: NULL text counts as empty, and an empty text is its end id
alone; repeated rows are packed once each, with sequence ids of their own; an
empty table gives no pieces; other columns of the documents are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordbpe import tokenizer

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
)


def binary_lengths(total: int, longest: int) -> list[int]:
    """Powers of two that add up to ``total``, none above ``longest``, in falling order."""
    whole, rest = divmod(total, longest)
    return [longest] * whole + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    longest: int = 4096,
    end_id: int = 2,
    with_ids: bool = False,
    cached_words: int = 700_000,
) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids as an array.

    ``cached_words`` bounds the words whose ids a Python worker keeps, about 170
    bytes each; fewer take less memory and more time, for the same pieces.

    ``bucket`` is the exponent of the length. It also leads the sequence id, so
    sequences in order of their ids come bucket by bucket.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length has to be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path, cached_words)
        task = TaskContext.get().partitionId() << 32
        made = 0
        for block in common.blocks(batches):
            rows, ids = [], []
            for doc_id, coded in zip(
                block.column("doc_id").to_pylist(), words.ids_of_all(block.column("text").to_pylist())
            ):
                coded += end
                total, start = len(coded) // 4, 0
                for length in binary_lengths(total, longest):
                    piece = coded[4 * start : 4 * (start + length)]
                    bucket = length.bit_length() - 1
                    sequence = bucket << 59 | task | made
                    rows.append((doc_id, start, length, zlib.crc32(piece), total, sequence, 0, bucket))
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                    made += 1
                    start += length
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.int64()] * 7 + [pa.int32()])]
            names = PIECES.replace(" long", "").replace(" int", "").split(", ")
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    read = common.texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return read.mapInArrow(cut, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces with ids as one folder per length, as a loader of equal-length batches reads them."""
    pieces.write.partitionBy("bucket").parquet(path)
