"""Collocations against a brute force that counts every phrase, and the scans against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from adperf.llm import collocations
from tests.llm.odd import empty_documents, odd_documents

SCHEMA = "doc_id long, text string, lang string"


def counts_of(rows):
    found = Counter()
    for _, text, lang, *_ in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    found["und" if lang is None else lang, tuple(w[i : i + k])] += 1
    return found


def brute_force(rows, least=10, percent=50, top=2000):
    f = counts_of(rows)
    out = []
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        inside = (q for (other, q), c in candidates.items() if other == lang and len(q) > len(p) and 100 * c >= percent * a)
        if any(p == q[i : i + len(p)] for q in inside for i in range(len(q) - len(p) + 1)):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        n = sum(c for (other, q), c in f.items() if other == lang and len(q) == 1)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n, score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


def result(docs, **how):
    return sorted(tuple(r) for r in collocations.collocations(docs, **how).collect())


def chatter(seed, n=400):
    rnd = random.Random(seed)
    words = ["a", "b", "c", "D", "é", "new york", "san  jose", "x-y", "Q"] + [f"w{i}" for i in range(25)]
    return [
        (i, "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", ". ", ",", "\n", " \x0b"]) for _ in range(rnd.randint(0, 40))),
         rnd.choice(["en", "en", "de", None, "und"]))
        for i in range(n)
    ]


@pytest.mark.parametrize("shards", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, shards):
    monkeypatch.setattr(collocations, "BLOCK", 1500)  # many blocks, so that phrases start at different scans
    monkeypatch.setattr(collocations, "PART", 700)
    rows = chatter(shards)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert result(docs, shards=shards) == brute_force(rows)


def test_late_phrases_are_counted_in_every_shard(spark, monkeypatch):
    """Words that only the last shard makes frequent: their pairs and triples start late and still get whole counts."""
    monkeypatch.setattr(collocations, "BLOCK", 200)
    rows = [(i, "rare red fox. " * (1 if i < 40 else 9), "en") for i in range(48)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    words, pairs, triples = collocations.counted(docs, 100, 3)
    assert {r["count"] for r in words.collect()} == {112}
    assert sorted(r["count"] for r in pairs.collect()) == [112, 112]
    assert [r["count"] for r in triples.collect()] == [112]
    assert result(docs, least=100, shards=3) == brute_force(rows, 100)


def test_ranks_and_limits(spark):
    rows = chatter(9)
    assert result(spark.createDataFrame(rows, SCHEMA), top=7, percent=90) == brute_force(rows, percent=90, top=7)


def test_large_counts_are_exact(spark):
    row = spark.range(1).select(
        *(collocations.F.lit(v).alias(n) for n, v in (("a", 900_000_000_001), ("l", 900_000_000_007), ("r", 910_000_000_003)))
    ).select(collocations._score(*(collocations.F.col(c) for c in "alr")).alias("s"))
    assert row.first().s == 10**6 * 900_000_000_001**2 // (900_000_000_007 * 910_000_000_003)


def test_odd_rows(spark):
    docs = odd_documents(spark, [(20 + i, "It is so it is", None, None) for i in range(12)])
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    assert result(docs) == brute_force(rows)


def test_tables_without_candidates(spark):
    assert result(empty_documents(spark)) == []
    assert result(spark.createDataFrame([(1, None, None), (2, "a b c", "en")], SCHEMA)) == []
