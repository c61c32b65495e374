"""Rows that every operator has to take: nulls, empty and very long texts, repeats, clashing extra columns."""

from __future__ import annotations

LONG = "The long text goes on, and on; again. " * 6000
ODD = [
    (1, "Is it so? It is.\nYes it is, as it was before it was so.", "en", "src1"),
    (2, None, "en", "src1"),
    (3, "", None, None),
    (4, LONG, "en", "src2"),
    (5, "Is it so? It is.\nYes it is, as it was before it was so.", "en", "src1"),
    (5, "Is it so? It is.\nYes it is, as it was before it was so.", "en", "src1"),
    (6, " \t\n ", "de", "src3"),
    (7, "Ünïcode ÄÖ ß 中文 😀 é <|endoftext|> don't x\u001cy", "de", "src3"),
    (None, "no id", "fr", None),
    (8, "one", "fr", "src4"),
    (9, "12345 !!! 67", None, "src4"),
]


def odd_documents(spark, more=()):
    """``ODD`` with extra columns that carry the names operators use inside."""
    extra = ["start", "length", "score", "word", "block", "key", "words", "part", "row_key", "n_words"]
    rows = [(*row, 0 if row[1] is None else len(row[1]), *([None] * len(extra))) for row in [*ODD, *more]]
    columns = "doc_id long, text string, lang string, source string, n_chars long, "
    return spark.createDataFrame(rows, columns + ", ".join(f"{c} string" for c in extra))


def empty_documents(spark):
    return odd_documents(spark).where("false")
