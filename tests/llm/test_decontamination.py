from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from adperf.llm import common, decontamination, queries
from tests.llm.odd import empty_documents, odd_documents


def words(text):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, size=10):
    where = {}
    for item, text in items:
        found = words(text)
        for s in range(max(1, len(found) - size + 1)) if found else ():
            where.setdefault(tuple(found[s : s + size]), set()).add("null" if item is None else str(item))
    sizes = {len(w) for w in where}
    out = []
    for key, text in docs:
        found, hit, ids = words(text), set(), set()
        for n in sizes:
            for s in range(len(found) - n + 1):
                if (run := tuple(found[s : s + n])) in where:
                    hit.update(range(s, s + n))
                    ids |= where[run]
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((key, len(found), len(hit), len(ids), digest, bool(hit)))
    return Counter(out)


def result(df):
    return Counter(
        (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()
    )


@pytest.mark.parametrize("bound", [4 << 20, 0])
def test_equals_brute_force_over_the_given_tables(spark, sf_dir, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    docs = [(r.doc_id, r.text) for r in common.read(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in common.read(spark, sf_dir, "benchmark").collect()]
    want = brute(docs, items)
    assert sum(r[5] for r in want) > 0
    assert result(queries.op10_decontamination(spark, sf_dir)) == want


ITEMS = [
    (1, "It is.\nYES it is, as it"), (1, "It is.\nYES it is, as it"), (2, None), (3, ""), (None, "ONE"),
    (4, "goes on, and on; again. The long text goes on and ON again the long"), (5, "ΑΣ ÄÖ"), (6, "no such words"),
    (7, "one"), (8, "before it was so"),
]


def test_odd_rows(spark):
    docs = odd_documents(spark, [(30, "x ΑΣ.ÄÖ y", "el", None), (31, "ας äö", None, None), (32, "ΑΣ ÄÖ", None, None)])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = result(decontamination.contamination(docs, items))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    kept = decontamination.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({k[0]: n for k, n in got.items() if not k[5]})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = odd_documents(spark)
    assert not any(r.contaminated for r in decontamination.contamination(docs, none).collect())
    assert decontamination.keep_clean(docs, none).count() == docs.count()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.contamination(empty_documents(spark), items).count() == 0
