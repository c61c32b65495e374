"""Personal data: fixed patterns, and information-theoretic sanitisation of what gives it away.

E-mail and IP addresses, card and phone numbers are found by pattern. Each value
is a protected entity. From the whole corpus, the pointwise mutual information of
an entity e and a term t that stands within ``window`` words of it,

    PMI(t, e) = log2 n(t, e) * N / (n(t) * n(e)),       IC(e) = log2 N / n(e)

(n: documents), says how much of the entity's information content the term
discloses: PMI / IC is 1 if the term is found nowhere else. A term that stands with
an entity in at least ``support`` documents is generalised to its class in these
documents if the ratio reaches ``generalise`` and removed if it reaches ``remove``,
wherever it stands in them. Documents without an entity are never touched.

All of it is DataFrame operations. Pattern positions come from the lengths of the
matches and of what lies between them; patterns are written so that matching takes
time in proportion to the text. Only the terms near entities are counted over the
corpus, and pairs are aggregated before they are shuffled.

Defined results: NULL text counts as empty (and stays NULL in ``sanitise``); rows
that are equal get the same result, one row each; an entity found in every document
discloses nothing; an empty table gives no rows; other columns are not read,
``sanitise`` keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common

KINDS = ("email", "ip", "card", "phone")
#: Possessive, and not begun inside what has failed before: the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs for the pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LABELS = {kind: f"[{kind.upper()}]" for kind in KINDS}
WORD, GAP = r"[\p{L}\p{N}]++", r"[^\p{L}\p{N}]++"
_STEP = 256


@dataclass(frozen=True)
class Disclosure:
    window: int = 8
    support: int = 3
    generalise: float = 0.6
    remove: float = 0.9


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """For each element the sum of those before it; in steps, so that long arrays take no quadratic time."""
    part = lambda k: F.slice(lengths, k * _STEP + 1, F.lit(_STEP))
    steps = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _STEP).cast("int"))

    def running(sums: Column) -> Column:
        return common.let(
            F.transform(sums, lambda _, k: _total(F.slice(sums, F.lit(1), k))),
            lambda offsets: F.flatten(F.transform(offsets, lambda offset, k: F.aggregate(
                part(k),
                F.struct(offset.alias("at"), F.array().cast("array<int>").alias("out")),
                lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")),
                lambda a: a["out"],
            ))),
        )

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(
        common.let(F.transform(steps, lambda k: _total(part(k))), running)
    )


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost matches in order, with code point positions and the text on both sides."""

    def placed(s: Column) -> Column:
        gaps, values = s["gaps"], s["values"]
        lengths = F.transform(values, lambda v, i: F.length(v) + F.length(F.get(gaps, i)))
        return common.let(lengths, lambda sizes: common.let(_before(sizes), lambda before: F.transform(
            values, lambda v, i: F.struct(
                (F.get(before, i) + F.length(F.get(gaps, i))).alias("start"),
                (F.get(before, i) + F.get(sizes, i)).alias("end"),
                v.alias("value"), F.get(gaps, i).alias("left"), F.get(gaps, i + 1).alias("right"),
            )
        )))

    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values")
    )
    return common.let(found, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)
    doubled = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(
        (size - i) % 2 == 1,
        F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substr(digits, i, F.lit(1)).cast("int") + 1),
    ).otherwise(F.substr(digits, i, F.lit(1)).cast("int")))
    return _total(doubled) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        low = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]|)"
        return F.forall(F.split(value, r"\."), lambda p: F.rlike(p, F.lit(f"^{low}$")))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _found(text: Column, kind: str, window: int) -> Column:
    """Spans of one kind, each with its entity and the terms near it."""
    spans = F.filter(_matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
    entity = lambda m: F.concat(
        F.lit(f"{kind}:"), _digits(m["value"]) if kind in ("card", "phone") else F.lower(m["value"])
    )
    near = lambda m: F.concat(
        F.reverse(F.slice(F.reverse(_terms(m["left"])), 1, window)), F.slice(_terms(m["right"]), 1, window)
    )
    kept = F.transform(spans, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), entity(m).alias("entity"), near(m).alias("near")
    ))
    none = F.array().cast("array<struct<start:int,end:int,entity:string,near:array<string>>>")
    return F.when(F.rlike(text, F.lit(NEEDS[kind])), kept).otherwise(none)


def _base(docs: DataFrame, window: int) -> DataFrame:
    """``row_key, text`` and one column of spans per kind; text is NULL where there are none."""
    read = common.texts(docs)
    found = read.select(
        "doc_id", common.row_key().alias("row_key"), "text", *[_found(F.col("text"), k, window).alias(k) for k in KINDS]
    )
    return found.withColumn("text", F.when(sum(F.size(k) for k in KINDS) > 0, F.col("text")))


def disclosing_terms(docs: DataFrame, base: DataFrame, rule: Disclosure) -> DataFrame:
    """``entity, term, removed`` for every term that discloses an entity; ``base`` is stored."""
    total = base.count()
    every = F.concat(*[F.col(k) for k in KINDS])
    entities = base.where(F.col("text").isNotNull()).select(F.explode(F.array_distinct(
        F.transform(every, lambda m: m["entity"])
    )).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    pairs = (
        base.where(F.col("text").isNotNull()).select(F.explode(_pairs()).alias("at"))
        .groupBy("at.entity", "at.term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= rule.support)
    )
    pairs = materialize(pairs)
    terms = materialize(pairs.select("term").distinct())
    words = common.texts(docs).select(F.explode(F.array_distinct(F.split(F.lower("text"), GAP))).alias("term"))
    counted = words.join(common.broadcast_if_small(terms, F.octet_length("term")), "term").groupBy("term").agg(
        F.count(F.lit(1)).alias("n_term")
    )
    pmi = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    return pairs.join(counted, "term").join(entities, "entity").where(information > 0).select(
        "entity", "term", (pmi / information).alias("ratio")
    ).where(F.col("ratio") >= rule.generalise).select("entity", "term", (F.col("ratio") >= rule.remove).alias("removed"))


def _pairs() -> Column:
    """Each entity of a document with each term near it, once."""
    every = F.concat(*[F.col(k) for k in KINDS])
    return F.array_distinct(F.flatten(F.transform(every, lambda m: F.transform(
        m["near"], lambda t: F.struct(m["entity"].alias("entity"), t.alias("term"))
    ))))


def term_spans(docs: DataFrame, base: DataFrame, rule: Disclosure) -> DataFrame:
    """``row_key, terms``: where disclosing terms stand in documents that hold the entity."""
    told = materialize(disclosing_terms(docs, base, rule))
    width = F.octet_length("entity") + F.octet_length("term")
    private = base.where(F.col("text").isNotNull()).dropDuplicates(["row_key"])
    listed = (
        private.select("row_key", F.explode(_pairs()).alias("at")).select("row_key", "at.*")
        .join(common.broadcast_if_small(told, width), ["entity", "term"])
        .groupBy("row_key", "term").agg(F.max("removed").alias("removed"))
        .groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("told"))
    )
    taken = F.concat(*[F.col(k) for k in KINDS])
    words = F.filter(_matches(F.col("text"), WORD), lambda w: F.try_element_at(F.col("told"), F.lower(w["value"])).isNotNull())
    free = F.filter(words, lambda w: ~F.exists(taken, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    return private.join(listed, "row_key").select("row_key", F.transform(free, lambda w: F.struct(
        w["start"].alias("start"), w["end"].alias("end"),
        F.try_element_at(F.col("told"), F.lower(w["value"])).alias("removed"),
        F.rlike(w["value"], F.lit("[0-9]")).alias("number"),
    )).alias("terms")).where(F.size("terms") > 0)


def find(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """``doc_id, row_key``, the spans of each kind, and those of disclosing ``terms``; one row per document."""
    base = materialize(_base(docs, rule.window))
    with_terms = term_spans(docs, base, rule)
    return base.drop("text").join(with_terms, "row_key", "left")


def listed(kinds: tuple[str, ...], with_terms: bool) -> Column:
    """Spans as ``kind:start:end`` by kind, then start, joined by commas."""
    parts = [(kind, kind) for kind in kinds] + ([("term", "terms")] if with_terms else [])

    def named(kind: str, column: str) -> Column:
        return F.transform(F.col(column), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    texts = [named(*part) for part in parts]
    return F.array_join(F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in texts]), ",")


def report(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term``."""
    return find(docs, rule).select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(KINDS, False), 256).alias("base_sha256"),
        listed(KINDS, True).alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"),
    )


def _redacted(text: Column) -> Column:
    """The text with every span replaced; spans that overlap are replaced as one, by the first one's label."""
    def labelled(kind: str) -> Column:
        return F.transform(F.col(f"__{kind}"), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(LABELS[kind]).alias("label")
        ))

    spans = [labelled(kind) for kind in KINDS]
    spans.append(F.coalesce(F.transform(F.col("__terms"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.when(s["removed"], "").when(s["number"], "[NUMBER]").otherwise("[TERM]").alias("label"),
    )), F.array().cast("array<struct<start:int,end:int,label:string>>")))
    piece = lambda a, s: F.concat(
        F.substr(text, a["upto"] + 1, s["start"] - a["upto"]), s["label"]
    )
    return F.aggregate(
        F.array_sort(F.concat(*spans)),
        F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["end"]).alias("upto"),
            F.when(s["start"] >= a["upto"], F.array_append(a["out"], piece(a, s))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["upto"] + 1, F.length(text))),
    )


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """The documents with personal data and disclosing terms replaced, and ``n_chars`` brought up to date.

    Documents without personal data do not take part in the join.
    """
    base = materialize(_base(docs, rule.window))
    terms = materialize(term_spans(docs, base, rule).select(
        F.col("row_key").alias("__key"), F.col("terms").alias("__terms")
    ))
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumns({f"__{k}": _found(text, k, 0) for k in KINDS})
    any_span = sum(F.size(f"__{k}") for k in KINDS) > 0
    private = marked.where(any_span).withColumn("__row", common.row_key())
    changed = private.join(terms, F.col("__row") == F.col("__key"), "left").withColumn("text", _redacted(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return marked.where(~any_span).select(*docs.columns).unionByName(changed.select(*docs.columns))
