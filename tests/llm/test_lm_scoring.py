from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adperf.llm import common, lm_scoring, queries
from tests.llm.odd import empty_documents, odd_documents


def brute(rows, strength=1000.0):
    def tokens(text):
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]

    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    words, pairs = Counter(), Counter()
    for key, text in rows:
        if not held(key):
            found = tokens(text)
            words.update(found)
            pairs.update(zip([False, *found], found))
    n, v = sum(words.values()), len(words)
    out = []
    for key, text in rows:
        found = tokens(text)
        root = {w: (words[w] + 1) / (n + v + 1) for w in found}
        context = lambda h: words[None] if h is False else words[h]
        score = sum(
            math.log10((pairs[h, w] + strength * root[w]) / (context(h) + strength))
            for h, w in zip([False, *found], found)
        )
        base = sum(math.log10(root[w]) for w in found)
        out.append((key, held(key), len(found), sum(words[w] > 0 for w in found), n, round(base, 4), round(score, 4)))
    return Counter(out)


def result(df):
    return Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4))
        for r in df.collect()
    )


def test_equals_brute_force_over_the_given_documents(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(queries.op2_lm_scoring(spark, sf_dir)) == brute(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = result(lm_scoring.lm_scores(docs, common.remainder("doc_id", 7) == 2))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert lm_scoring.lm_scores(empty_documents(spark), common.remainder("doc_id", 7) == 2).count() == 0


def test_arcs_of_a_state_add_up_to_one():
    block = lm_scoring.Block(pa.array(["a b a c", "b a", "c"]))
    words = np.bincount(block.word, minlength=len(block.words))
    pairs = np.bincount(block.pair, minlength=len(block.pairs))
    tokens, types = words.sum(), (words > 0).sum()
    made = lm_scoring.Automaton(block, words, pairs, tokens, types, 2.0)
    state = block.state[1]
    seen = {w: made.arc[p] for s, w, p in zip(block.state, block.word, block.pair) if s == state}
    total = sum(10 ** x for x in seen.values())
    total += 10 ** made.fail[state] * (
        sum(10 ** made.root[w] for w in range(len(words)) if words[w] and w not in seen) + 1 / (tokens + types + 1)
    )
    assert total == pytest.approx(1.0)


def test_many_blocks_in_each_of_many_ranges(spark, sf_dir, monkeypatch):
    docs = common.read(spark, sf_dir, "documents").repartition(30, "doc_id")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0]
    assert common.range_parts(common.texts(docs)) == common.shuffle_parts(spark)
    monkeypatch.setattr(common, "RANGE_BYTES", size // 40)
    assert 40 <= common.range_parts(common.texts(docs)) <= 41
    made, ranges = lm_scoring._send, []
    monkeypatch.setattr(lm_scoring, "_send", lambda parts: ranges.append(parts) or made(parts))
    got = result(lm_scoring.lm_scores(docs, common.remainder("doc_id", 7) == 2))
    assert 40 <= ranges[0] <= 41
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
