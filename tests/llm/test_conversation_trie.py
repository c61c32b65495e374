"""The trie of conversations against a brute force over dictionaries."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adperf.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute_force(full):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, who in members.items()
    ) if full else []


def result(df):
    seqs = conversation_trie.sequences(df)
    number = F.col("conv_id")
    found = conversation_trie.trie(conversation_trie.rebuilt(seqs, number - number % 5, F.crc32(number.cast("string")) % 9))
    return sorted(map(tuple, found.collect()), key=lambda r: (*r[:2], r[2] is not None, *r[3:]))


def expected(rows):
    return sorted(brute_force(rebuilt(rows)), key=lambda r: (*r[:2], r[2] is not None, *r[3:]))


def talks(seed, n=300):
    """Many shared first turns, identical conversations, one very long one."""
    rnd = random.Random(seed)
    rows = []
    for c in range(0, n, rnd.choice([1, 1, 2])):
        for turn in range(rnd.choice([1, 2, 3, 3, 12])):
            text = "hello" if turn == 0 and rnd.random() < 0.5 else rnd.choice(["a", "bé", "", None, f"own {c}"])
            rows.append((c, turn, rnd.choice(["user", "bot", None]) if turn else "user", text))
    rows += [(n + 5, t, "user", f"t{t // 3}") for t in range(400)] + [(n + 6, t, "user", f"t{t // 3}") for t in range(250)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("turns", [conversation_trie.TURNS, 40])
def test_equals_brute_force(spark, monkeypatch, seed, turns):
    monkeypatch.setattr(conversation_trie, "TURNS", turns)  # 40: most nodes of the longest cross tasks
    rows = talks(seed)
    assert result(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_identical_conversations(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 2000, 5) for t in range(3)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(7)) == expected(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "nobody's", 1), (3, None, None, None, 2), (3, 1, "user", "x", 3), (3, 1, "user", "x", 3),
        (3, 1, "bot", "x", 4), (5, 1, "user", "", 5), (6, 2, "user", "long " * 50_000, 6), (-7, 1, "user", "x", 7), (7, 1, "user", "x", 7),
    ]
    docs = spark.createDataFrame(rows, SCHEMA + ", n int").withColumns({c: F.lit("x") for c in ("seq", "base", "digest", "pos", "key", "part")})
    assert result(docs) == expected(rows)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=6), min_size=1, unique=True))
def test_ends_of_candidates(texts):
    """Both binary searches against looking at every sequence."""
    texts.sort()
    shared = [-1] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(texts, texts[1:])]
    table = conversation_trie._minima(np.array(shared))
    for i, text in enumerate(texts):
        for d in range(len(text) + 1):
            having = [k for k, other in enumerate(texts) if other[:d] == text[:d] and len(other) >= d]
            one, depth = np.array([i]), np.array([d])
            assert conversation_trie.left_ends(table, one, depth)[0] == having[0]
            assert conversation_trie.right_ends(table, one, depth)[0] == having[-1]
