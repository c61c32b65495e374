from __future__ import annotations

from collections import Counter
from itertools import combinations

import corpus_pipeline
from adperf.llm import common, queries
from tests.llm import test_decontamination, test_jaccard_join, test_pii
from tests.llm.odd import odd_documents


def test_each_stage_does_what_its_brute_force_version_does(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    docs = common.read(spark, sf_dir, "documents")
    first = stages["language_id"](spark, docs, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in first.collect()}
    assert first.columns == docs.columns
    assert all(any(c.isalpha() for c in texts[k]) for k in kept)
    assert kept == {k for k, t in texts.items() if any(c.isalpha() for c in t)}

    second = stages["ngram_jaccard_join"](spark, first, sf_dir)
    rows = [(k, texts[k]) for k in kept]
    single = {k for k, _, c in test_jaccard_join.brute(rows) if k == c}
    assert {r.doc_id for r in second.collect()} == single

    third = stages["benchmark_decontamination"](spark, second, sf_dir)
    items = [(r.item_id, r.text) for r in common.read(spark, sf_dir, "benchmark").collect()]
    clean = {r[0] for r in test_decontamination.brute([(k, texts[k]) for k in single], items) if not r[5]}
    assert {r.doc_id for r in third.collect()} == clean < single

    fourth = stages["pii"](spark, third, sf_dir)
    found = {r[0]: r for r in test_pii.brute([(k, texts[k]) for k in clean])}
    made = {r.doc_id: r for r in fourth.collect()}
    assert set(made) == clean and fourth.columns == docs.columns
    assert all((made[k].text == texts[k]) == (not found[k][6]) for k in clean)
    assert all(made[k].n_chars == len(made[k].text) for k in clean)

    last = stages["packing"](spark, fourth, sf_dir)
    pieces = Counter()
    for r in last.collect():
        pieces[r.doc_id] += r.length
    assert set(pieces) == clean
    whole = corpus_pipeline.run(spark, sf_dir)
    assert Counter(whole.select("doc_id", "start", "ids_crc32").collect()) == Counter(
        last.select("doc_id", "start", "ids_crc32").collect()
    )


def test_odd_rows_go_through_every_stage(spark, sf_dir):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        assert made.columns == docs.columns
        made.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_all_operators_are_registered():
    import __spark_entry__ as driver

    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.queries()}
    assert set(queries.queries()) | {"pipeline"} <= set(driver.queries())


def five_word_groups(rows):
    """Groups by links of a 5-word Jaccard of 0.8 at least, pair by pair; the smallest id of each."""
    sets = {k: test_jaccard_join.shingles(t, 5) for k, t in rows}
    lead = {k: k for k in sets}

    def root(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            one, two = sorted((root(a), root(b)))
            lead[two] = one
    return {root(k) for k in sets}


def test_near_copies_are_those_of_five_words_and_four_fifths(spark, sf_dir):
    rows = []
    for base, (size, changed) in enumerate([(100, (30, 70)), (150, (30, 70, 110)), (200, (30, 70, 110, 150)), (100, (20, 50, 80))]):
        words = [f"w{base}x{k}" for k in range(size)]
        rows.append((100 + 10 * base, " ".join(words)))
        rows.append((101 + 10 * base, " ".join(f"new{k}" if k in changed else w for k, w in enumerate(words))))
    assert {k for k, _, c in test_jaccard_join.brute(rows) if k == c} == {k for k, _ in rows}
    docs = odd_documents(spark, [(k, t, None, None) for k, t in rows]).where("doc_id >= 100")
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(five_word_groups(rows)) == [100, 110, 120, 130, 131]


def test_near_copies_of_the_given_documents(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, sf_dir)
    assert {r.doc_id for r in kept.collect()} == five_word_groups(rows)
