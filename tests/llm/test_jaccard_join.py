from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from adperf.llm import common, jaccard_join, queries
from tests.llm.odd import empty_documents, odd_documents


def shingles(text, words=4):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + words]) for k in range(len(found) - words + 1)}


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    lead = list(range(len(docs)))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= 85 * (len(a) + len(b) - shared):
                    lead[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        known = [k for k in (key, least.get(root(i))) if k is not None]
        least[root(i)] = min(known) if known else None
    return Counter((key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(docs))


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_equals_brute_force_over_the_given_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in common.read(spark, sf_dir, "documents").collect()]
    want = brute(docs)
    assert any(r[0] != r[2] for r in want)
    assert result(queries.op4_jaccard_join(spark, sf_dir)) == want


def near_copies(dealt, count):
    """Chains and stars of edited copies around the threshold, and texts that share a long passage only."""
    passage = " ".join(dealt.choice("abcdefgh") * dealt.randrange(1, 6) for _ in range(60))
    out = []
    for _ in range(count):
        words = ["".join(dealt.choices("abcdefghij", k=4)) for _ in range(dealt.choice([6, 30, 80]))]
        for _ in range(dealt.choice([1, 3, 12])):
            out.append(" ".join(words))
            for _ in range(dealt.choice([0, 1, 1, 2])):
                words[dealt.randrange(len(words))] = "x" + str(dealt.random())
        out.append(passage + " " + " ".join(dealt.choices(words, k=5)))
    return out


def test_groups_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 4)  # trees of several levels
    texts = near_copies(random.Random(2), 25)
    docs = odd_documents(spark, [(100 + k, t, None, None) for k, t in enumerate(texts)])
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(jaccard_join.components(docs)) == want
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    stay = Counter({k: 1 for k, _, c in want if k is not None and k == c})
    stay.update(k for k, _, c in want.elements() if k is None)
    assert Counter(r.doc_id for r in kept.collect()) == stay


def test_empty_table(spark):
    assert jaccard_join.components(empty_documents(spark)).count() == 0
    assert jaccard_join.one_of_each(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("count", [3, 40, 3000])
def test_tree_loses_no_pair(count):
    dealt = np.random.default_rng(count)
    points = np.sort(dealt.poisson(dealt.choice([1, 2, 6], (count, 1)), (count, jaccard_join.GROUPS)), axis=0)
    order = np.argsort(points.sum(axis=1), kind="stable")
    points = points[order]
    size = points.sum(axis=1)
    found = {(a, b) for x, y in jaccard_join.CountTree(points, size, 85).pairs(np.arange(count)) for a, b in zip(x.tolist(), y.tolist())}
    for i in range(0, count, 1 + count // 50):
        shared = np.minimum(points[i], points[i + 1 :]).sum(axis=1)
        want = np.flatnonzero(185 * shared >= 85 * (size[i] + size[i + 1 :])) + i + 1
        assert all((i, int(j)) in found for j in want)


def cells(places):
    """A batch for each cell of two classes of 100 shingles with equal points, from their places there."""
    point = np.full(jaccard_join.GROUPS, 1, "u1").tobytes()
    for key, (one, two) in enumerate(places):
        yield pa.RecordBatch.from_pydict({
            "key": [key, key], "class": [1, 2], "before": [2 * key, 2 * key + 1], "place": [one, two],
            "label": [1, 2], "n": [100, 100], "point": [point, point],
        })


def test_a_pair_is_asked_where_enough_is_left_and_given_once_per_task():
    given = lambda places: [p for b in jaccard_join._pairs_between(80)(cells(places)) for p in zip(*b.to_pydict().values())]
    assert given([(0, 0), (5, 4), (7, 9), (11, 11)]) == [(1, 2)]
    assert given([(12, 3), (3, 12), (15, 15)]) == []  # 89 of 100 have to be shared
    partners = jaccard_join._partners(80)
    assert sum(b.num_rows for b in partners(cells([(11, 11)]))) == 2 and not sum(b.num_rows for b in partners(cells([(12, 0)])))


@pytest.mark.parametrize("sizes", [(3, 3), (60, 70), (120, 140), (250, 260), (9000, 11000)])
def test_finer_points_differ_in_no_more_than_the_sets(sizes):
    dealt = np.random.default_rng(sizes[0])
    draw = lambda n: dealt.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + dealt.integers(0, 2, n, np.uint64)
    common_part, sets = draw(min(sizes)), []
    for size in sizes:
        for kept in (0, min(sizes) // 2, min(sizes) * 9 // 10, min(sizes)):
            sets.append(np.concatenate([common_part[:kept], draw(size - kept)]))
    fine = jaccard_join.FinePoints(pa.array([jaccard_join.odd_groups(s) for s in sets]))
    a, b = (side.ravel() for side in np.indices((len(sets), len(sets))))
    true = [len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)]
    found = fine.apart(a, b)
    assert all(found <= true) and not any((found - true) % 2)
    assert all(found[k] >= 0.1 * (len(sets[a[k]]) + len(sets[b[k]])) for k in range(len(true)) if true[k] > min(sizes) > 60)


def test_long_texts_that_share_a_passage_are_not_listed_in_pairs(spark, monkeypatch):
    tables, store = [], jaccard_join.materialize

    def counted(rows):
        kept = store(rows)
        if kept.columns == ["a", "b"]:
            tables.append(kept.count())
        return kept

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    dealt = random.Random(7)
    passage = [f"p{k}" for k in range(100)]
    texts = [" ".join([*passage, *(f"{dealt.getrandbits(60):x}" for _ in range(10_000))]) for _ in range(15)]
    texts.append(texts[3] + " end")
    docs = odd_documents(spark, [(100 + k, t, None, None) for k, t in enumerate(texts)]).where("doc_id >= 100")
    found = {r.doc_id: r.component_id for r in jaccard_join.components(docs).collect()}
    assert found == {**{100 + k: 100 + k for k in range(15)}, 115: 103}
    asked, linked, _, listed, *_ = tables
    assert asked > 10 and linked == 1 and listed == 0  # of more than 80 pairs whose coarse points are alike


def test_one_row_of_a_group_stays_whatever_the_ids(spark):
    def versions(name, count):
        words = [f"{name}{k}" for k in range(200)]
        return [" ".join([*words[:100], f"other{v}", *words[101:]]) for v in range(count)]

    rows = [
        *[(None, t, None, None) for t in versions("a", 3)],
        *[(50, t, None, None) for t in versions("b", 3)],
        *[(k, t, None, None) for k, t in zip((None, 62, 61, 61), versions("c", 4))],
        *[(70, t, None, None) for t in versions("d", 1) * 2],
        (None, None, None, None), (None, "", None, None),
    ]
    docs = odd_documents(spark, rows).where("coalesce(doc_id, 50) >= 50 and coalesce(text, '') <> 'no id'")
    assert docs.count() == len(rows)
    kept = jaccard_join.one_of_each(docs).collect()
    assert Counter((r.doc_id, r.text.split()[0][0]) for r in kept if r.text) == Counter([(None, "a"), (50, "b"), (61, "c"), (70, "d")])
    assert sum(not r.text for r in kept) == 2
