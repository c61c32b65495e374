"""Removal of repeated passages against a brute force over all windows, and the suffix sort against sorted()."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adperf.llm import suffix_dedup, suffix_sort
from tests.llm.odd import empty_documents, odd_documents


def brute_force(rows, length):
    """Per row (id, text): removed runs and kept bytes, straight from the definition."""
    first = {}
    texts = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, data in texts:
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            first[w] = min(first.get(w, float("inf")), i)
    out = []
    for i, data in texts:
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        edges = [k for k in range(len(data) + 1) if (k < len(data) and gone[k]) != (k > 0 and gone[k - 1])]
        runs = list(zip(edges[::2], edges[1::2]))
        out.append((len(data), runs, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def result(docs, length=50):
    rows = suffix_dedup.without_repeats(docs, length).collect()
    return sorted(
        ((r.doc_id, r.n_bytes, [(x.start, x.stop) for x in r.removed], bytes(r.kept)) for r in rows), key=repr
    )


def expected(rows, length=50):
    return sorted(((i, *found) for (i, _), found in zip(rows, brute_force(rows, length))), key=repr)


def passages(seed):
    """Short texts over few letters, long shared passages at all distances, copies and hot passages."""
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice("abcde fgh") for _ in range(rnd.randint(40, 130))) for _ in range(6)]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rnd.randint(0, 5)):
            kind = rnd.random()
            if kind < 0.5:
                part = rnd.choice(shared)
                cut = rnd.randint(0, 20)
                text += part[cut : len(part) - rnd.randint(0, 20)]
            elif kind < 0.6:
                text += "ab" * rnd.randint(10, 60)
            else:
                text += "".join(rnd.choice("abc déf€ghij") for _ in range(rnd.randint(1, 90)))
        rows.append((rnd.choice([None, i, i, i, i // 2]), text))
    return rows + rows[:5]


@pytest.mark.parametrize("most", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)  # 3: nearly every shared anchor is dealt by window
    rows = passages(most)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(docs) == expected(rows)


def test_equals_brute_force_on_the_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(docs) == expected(rows)


def test_chunks_of_windows_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 64)
    rows = passages(7)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_shorter_windows(spark):
    rows = passages(11)[:60]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), 12) == expected(rows, 12)
    with pytest.raises(ValueError):
        suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 7)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(docs) == expected(rows)


def test_empty_table(spark):
    assert suffix_dedup.without_repeats(empty_documents(spark)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=120).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(1, 60), st.data())
def test_suffix_sort_equals_sorted(text, depth, data):
    text += b"a" * depth
    places = data.draw(st.lists(st.integers(0, len(text) - depth), unique=True))
    cut = data.draw(st.integers(0, len(places)))
    at, segments = np.array(places, np.int64), np.array([0, cut, len(places)])
    done, begins = suffix_sort.classes(np.frombuffer(text, np.uint8), at, segments, depth)
    for a, b in ((0, cut), (cut, len(places))):
        part = [text[p : p + depth] for p in done[a:b]]
        assert part == sorted(text[p : p + depth] for p in places[a:b])
        assert list(begins[a:b]) == [k == 0 or part[k] != part[k - 1] for k in range(b - a)]


def test_hashes_that_lie_are_found_out(monkeypatch):
    """With hashes of one bit nothing is in order; the next salt is taken until the bytes agree."""
    rnd = np.random.default_rng(3)
    text = rnd.integers(97, 99, 300).astype(np.uint8)
    honest = suffix_sort.Suffixes._equal
    monkeypatch.setattr(
        suffix_sort.Suffixes, "_equal",
        lambda self, a, b, n: honest(self, a, b, n) if self.salt else np.ones(len(a), bool),
    )
    made = suffix_sort.Suffixes.__init__
    monkeypatch.setattr(
        suffix_sort.Suffixes, "__init__",
        lambda self, data, depth, salt=0: (made(self, data, depth, salt), setattr(self, "salt", salt))[0],
    )
    done, _ = suffix_sort.classes(text, np.arange(250), np.array([0, 250]), 40)
    found = [text[p : p + 40].tobytes() for p in done]
    assert found == sorted(found)
