from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from adperf.llm import fingerprints, queries
from tests.llm.odd import empty_documents, odd_documents


def likeness(a, b):
    """Shared paragraphs by plain multisets."""
    one, two = Counter(fingerprints.paragraphs(a)), Counter(fingerprints.paragraphs(b))
    size = sum(one.values()) + sum(two.values())
    return 1.0 if not size else 1 - sum(((one - two) + (two - one)).values()) / size


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0]), reverse=True)
    rows = [(k, t or "") for k, t in rows]
    out = {}
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.setdefault(key, []).append((
            len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(text, edited), 9),
            round(likeness(text, after), 9),
        ))
    return {k: sorted(v) for k, v in out.items()}


def result(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)))
    return {k: sorted(v) for k, v in out.items()}


def test_equals_brute_force_over_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op5_fingerprints(spark, sf_dir).collect()
    assert result(rows) == brute([(r.doc_id, r.text) for r in docs.collect()])
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert result(fingerprints.fingerprints(docs).collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_one_document_is_its_own_neighbour_and_none_gives_none(spark):
    docs = odd_documents(spark).where("doc_id = 1")
    assert [r.near_next for r in fingerprints.fingerprints(docs).collect()] == [1.0]
    assert fingerprints.fingerprints(empty_documents(spark)).count() == 0


def test_peeling_recovers_any_number_of_digests():
    dealt = random.Random(5)
    sets = [np.array(sorted(dealt.sample(range(1, 1 << 62), n)), np.uint64) for n in (0, 1, 7, 60, 900, 5000)]
    other = [s[: len(s) // 2] for s in sets]
    base = lambda many: fingerprints.sketches(many, np.full(len(many), fingerprints.SLOTS))
    found = fingerprints.differing(sets, other, base(sets), base(other), np.arange(len(sets)))
    assert found.tolist() == [len(s) - len(s) // 2 for s in sets]


def test_ids_that_are_no_doubles(spark):
    dealt = random.Random(7)
    high = (1 << 63) - 1
    keys = [*(dealt.randrange(-(1 << 63) + 1, high) for _ in range(150)), high, high - 1, high - 1, *range((1 << 60) + 1, (1 << 60) + 150)]
    rows = [(k, f"text of {dealt.random()}\nand {dealt.random()}", None, None) for k in keys]
    docs = odd_documents(spark, rows)
    assert result(fingerprints.fingerprints(docs).collect()) == brute(
        sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[1] or "")
    )


def test_rows_still_held_are_an_error():
    batch = pa.RecordBatch.from_pydict({"range": [0, 0], "doc_id": [2, 1], "text": ["a", "b"], "copy": [0, 0]})
    with pytest.raises(ValueError):
        list(fingerprints._compare_in_order(iter([batch])))
