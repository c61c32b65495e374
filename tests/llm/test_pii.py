from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from adperf.llm import common, pii, queries
from tests.llm.odd import empty_documents, odd_documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = re.compile(r"[^\W_]+")


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        odd = [int(d) for d in digits[::-1]]
        return 16 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(odd)) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def spans(text):
    return [
        (kind, m.start(), m.end(), m[0]) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if holds(kind, m[0])
    ]


def brute(docs, rule=pii.Disclosure()):
    docs = [(k, t or "") for k, t in docs]
    both, terms, entities, near = Counter(), Counter(), Counter(), []
    for _, text in docs:
        pairs = set()
        for kind, a, b, value in spans(text):
            entity = (kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower())
            found = [list(re.finditer(PATTERNS[kind], text))]
            places = [m.span() for m in found[0]]
            i = places.index((a, b))
            left = text[places[i - 1][1] if i else 0 : a]
            right = text[b : places[i + 1][0] if i + 1 < len(places) else len(text)]
            around = WORD.findall(left.lower())[-rule.window :] + WORD.findall(right.lower())[: rule.window]
            pairs |= {(entity, t) for t in around}
            pairs |= {(entity, None)}
        near.append(pairs)
        both.update(p for p in pairs if p[1] is not None)
        entities.update({e for e, _ in pairs})
        terms.update(set(WORD.findall(text.lower())))
    n, told = len(docs), set()
    for (entity, term), c in both.items():
        information = math.log2(n / entities[entity])
        if c >= rule.support and information > 0:
            if math.log2(c * n / (terms[term] * entities[entity])) / information >= rule.generalise:
                told.add((entity, term))
    out = []
    for (key, text), pairs in zip(docs, near):
        base = spans(text)
        listed = [f"{k}:{a}:{b}" for k, a, b, _ in base]
        terms_here = {t for p in pairs if p in told for t in [p[1]]}
        more = [
            f"term:{m.start()}:{m.end()}" for m in WORD.finditer(text)
            if m[0].lower() in terms_here and not any(a < m.end() and m.start() < b for _, a, b, _ in base)
        ]
        counts = Counter(k for k, *_ in base)
        out.append((key, *(counts[k] for k in PATTERNS), hashlib.sha256(",".join(listed).encode()).hexdigest(),
                    ",".join(listed + more)))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in df.collect())


def test_equals_brute_force_over_the_given_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in common.read(spark, sf_dir, "documents").collect()]
    want = brute(docs)
    assert sum(sum(r[1:5]) for r in want) > 0
    assert result(queries.op6_pii(spark, sf_dir)) == want


CARD = "4539 1488 0343 6467"
MORE = [
    (40, "a@b.com_x@y.org, c@d and é@f.gh 1.2.3.4.5.6.7.8 and 256.1.1.1 00001.2.3.4", None, None),
    (41, f"{CARD} {CARD}-1 +49 (30) 1234-5678. +1 +12 345 678 9012345678", None, None),
    (42, "😀 ä" + "x.y" * 300 + "@z.de " + "1" * 2000 + " " + "7 " * 600 + f"+{'1.' * 400}2 x@y.zz", None, None),
    *[(50 + k, f"Contact Zorgon the Wizard at zorgon{k // 5}@mail.test now" + " filler" * (k % 3), "en", "s") for k in range(10)],
    *[(70 + k, "the wizard said now at the mail", "en", "s") for k in range(30)],
]


def test_odd_rows_and_disclosing_terms(spark):
    docs = odd_documents(spark, MORE)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert any("term:" in r[6] for r in want)
    assert result(pii.report(docs)) == want
    made = pii.sanitise(docs)
    assert made.columns == docs.columns
    texts = {r.doc_id: r for r in made.collect()}
    assert made.count() == docs.count()
    plain = {r[0] for r in want if not any(r[1:5])}
    assert all(texts[k].text == t for k, t in rows if k in plain)
    assert "[EMAIL]" in texts[50].text and "zorgon" not in texts[50].text.lower()
    assert not any(spans(texts[k].text or "") for k in texts if k not in plain)
    assert texts[50].n_chars == len(texts[50].text)


def test_random_texts_match_the_plain_patterns(spark):
    dealt = random.Random(3)
    letters = ["a", "B.", "_", "@", "-", "+", "1", "23", " ", ".", "(", ")", "4539148803436467", "é", "😀", "%", "\n", "9.9.9.9"]
    rows = [(k, "".join(dealt.choices(letters, k=dealt.randrange(60))), None, None) for k in range(400)]
    docs = odd_documents(spark, rows)
    assert result(pii.report(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    none = empty_documents(spark)
    assert pii.report(none).count() == 0 and pii.sanitise(none).count() == 0
