from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from adperf.llm import common, packing, queries, token_counts, wordbpe
from tests.llm.odd import empty_documents, odd_documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.WORD_BPE)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_cached_words_give_the_library_ids(library):
    own, dealt = wordbpe.WordTokenizer(queries.WORD_BPE, most_words=50), random.Random(1)
    signs = [chr(c) for c in [*range(0, 0x260), *range(0x300, 0x330), 0x212A, 0x3A3, 0x2028, 0x2019, 0x1F600, 0x4E2D]]
    signs += ["'s", "<|endoftext|>", "'re"] * 20 + list("abc de") * 40
    texts = ["".join(dealt.choices(signs, k=dealt.randrange(30))) for _ in range(2000)]
    assert [np.frombuffer(i, "<u4").tolist() for i in own.ids_of_all(texts)] == [ids(library, t) for t in texts]


def pieces_are_right(library, docs, rows):
    expected = Counter()
    for d in docs:
        own = [*ids(library, d.text), 2]
        expected[d.doc_id] += len(own)
        for start in (r.start for r in rows if r.doc_id == d.doc_id):
            assert start < len(own) or docs.count(d) == 0 or sum(e.doc_id == d.doc_id for e in docs) > 1
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0
    assert got == expected
    assert len({r.sequence_id for r in rows}) == len(rows)


@pytest.mark.parametrize("odd", [False, True])
def test_packing(spark, sf_dir, library, odd):
    docs = odd_documents(spark) if odd else common.read(spark, sf_dir, "documents")
    rows = packing.pack(docs, queries.WORD_BPE).collect()
    found = docs.select("doc_id", "text").collect()
    pieces_are_right(library, found, rows)
    want = Counter()
    for d in found:
        own, start = np.array([*ids(library, d.text), 2], "<u4"), 0
        for length in packing.binary_lengths(len(own), 4096):
            want[d.doc_id, start, zlib.crc32(own[start : start + length].tobytes()), len(own)] += 1
            start += length
    assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in rows) == want


def test_packed_files_round_trip(spark, library, tmp_path):
    docs = odd_documents(spark)
    packing.write_buckets(packing.pack(docs, queries.WORD_BPE, with_ids=True), str(tmp_path / "packed"))
    read = spark.read.parquet(str(tmp_path / "packed")).where("doc_id = 7").orderBy("start").collect()
    text = next(r.text for r in docs.collect() if r.doc_id == 7)
    assert [i for r in read for i in r.ids] == [*ids(library, text), 2]
    assert all(1 << r.bucket == r.length for r in read)


@pytest.mark.parametrize("odd", [False, True])
def test_token_counts(spark, sf_dir, library, odd, monkeypatch):
    docs = odd_documents(spark) if odd else common.read(spark, sf_dir, "documents")
    rows = token_counts.token_counts(docs, queries.WORD_BPE).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(ids(library, r.text))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want


def test_empty_tables(spark):
    none = empty_documents(spark)
    assert packing.pack(none, queries.WORD_BPE).count() == 0
    assert token_counts.token_counts(none, queries.WORD_BPE).count() == 0


def test_blocks_split_by_bytes(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 50, 1, 1, 1, 200, 2)]})
    made = [b.column("text").to_pylist() for b in common.blocks(iter([batch, batch.slice(0, 0), batch]), 60)]
    assert [t for b in made for t in b] == batch.column("text").to_pylist() * 2
    assert all(len(b) == 1 or sum(map(len, b)) <= 60 for b in made)


def test_token_counts_of_many_blocks_in_each_of_many_ranges(spark, sf_dir, library, monkeypatch):
    monkeypatch.setattr(common, "RANGE_BYTES", 16 << 10)
    docs = common.read(spark, sf_dir, "documents").repartition(30, "doc_id")
    made, ranges = token_counts._send, []
    monkeypatch.setattr(token_counts, "_send", lambda path, parts: ranges.append(parts) or made(path, parts))
    rows = token_counts.token_counts(docs, queries.WORD_BPE).collect()
    assert ranges[0] > 4 * common.shuffle_parts(spark)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(ids(library, r.text))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
