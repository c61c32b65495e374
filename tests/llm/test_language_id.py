from __future__ import annotations

import zlib

from adperf.llm import common, language_id, queries
from tests.llm.odd import empty_documents, odd_documents


def test_held_out_accuracy_and_contract(spark, sf_dir):
    docs = {r.doc_id: r for r in common.read(spark, sf_dir, "documents").collect()}
    rows = queries.op3_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    lettered = [r for r in rows if r.held_out and any(c.isalpha() for c in docs[r.doc_id].text)]
    assert all(r.lang_pred != "und" for r in lettered)
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in lettered)
    assert right >= 0.97 * len(lettered)
    assert sum(r.rejected for r in rows) == sum(r.lang_pred == "und" for r in rows)


def test_odd_rows_and_foreign_text(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~(common.remainder("doc_id", 4) == 2))
    odd = odd_documents(spark, [(20, "漢字仮名交じり文です。これは日本語の文章です。" * 5, None, None)])
    rows = odd.select("doc_id", language_id.language_of(odd, model).alias("f")).collect()
    found = {r.doc_id: r.f for r in rows}
    assert len(rows) == odd.count()
    assert all(found[k].lang_pred == "und" and found[k].rejected and found[k].score == 0 for k in (2, 3, 6, 9))
    assert found[20].rejected
    kept = language_id.keep_languages(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(not r.f.rejected for r in rows)


def test_nothing_to_learn_from(spark):
    none = language_id.fit(empty_documents(spark), common.remainder("doc_id", 4) != 2)
    assert none is None
    odd = odd_documents(spark)
    assert {r.f.lang_pred for r in odd.select(language_id.language_of(odd, none).alias("f")).collect()} == {"und"}


def test_ties_go_to_the_first_language(spark):
    rows = [(k, "same words in both", lang) for k, lang in enumerate(["b", "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, common.remainder("doc_id", 4) >= 0)
    assert language_id.predict(model, "same words in both")[0] == "a"
