"""Main text of web pages by a tree-structured graphical model of their DOM.

The nodes of a page are its block elements and, below them, its runs of text
(inline markup belongs to the run it stands in). Each is content or not. Every node
has a potential from what it looks like (element, words in its class and id; for
runs of text their length, share of links and closing punctuation) and every edge
one from the labels of parent and child, by the child's kind. Sum-product messages
pass from the leaves to the root and back; a run of text is kept when its marginal
is at least one half.

Potentials are smoothed counts over labelled pages. A page is labelled when its own
markup says where its article is (one ``article`` or ``main`` element); the fixed
names below that mark menus, adverts and the like count as ``PRIOR`` labelled nodes
each, so that a kind no labelled page has is still known. The fit reads about
``sample`` pages, chosen by a digest of the id (a documented bound); the
extraction is one pass over whole pages without a shuffle.

Defined results: NULL html counts as empty; a page without a kept run has an empty
text; repeated rows give one row each; an empty table gives no rows; other columns
of the pages are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Elements of the HTML standard by what they do to the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "script style noscript template svg math iframe object embed canvas audio video head title button select option "
    "textarea datalist map".split()
)
#: What can stand in a head; anything else ends an open one, as its end tag may be left out.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
            "tbody": {"table"}, "tfoot": {"table"}}
# Words in class and id by what they mark.
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip",
    "advert": "ad ads adv advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored",
    "remark": "comment comments reply replies disqus respond discussion",
    "side": "sidebar side aside widget widgets related recommended more share sharing social tags",
    "frame": "header footer masthead copyright legal topbar bottom",
    "notice": "cookie cookies notice consent popup modal alert gdpr overlay subscribe newsletter signup login",
    "article": "article content post entry story text body main",
}
_NAME = {word: kind for kind, words in NAMES.items() for word in words.split()}
EXCLUDED = frozenset("nav header footer aside form menu dialog".split())
ARTICLES = frozenset(["article", "main"])
PRIOR = 1000.0
#: Nodes that each kind of child counts for following its parent's label, and for not doing so.
FOLLOW = (10.0, 0.25)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def _name_kind(attributes: str) -> str:
    """The first marking word in class, id or role; words that mark no content go first."""
    found = {
        _NAME[part.lower()] for value in _NAMED.findall(attributes) for part in _PART.findall(value) if part.lower() in _NAME
    }
    plain = found - {"article"}
    return min(plain) if plain else "article" if found else ""


class Page:
    """Nodes in page order: ``tag``, ``kind`` (element and name, or ``#text``), ``parent``, ``text`` of runs, ``look``."""

    def __init__(self, source: str):
        self.tag, self.kind, self.parent, self.text, self.look = ["#root"], ["#root"], [-1], [""], ["#root"]
        self._open: list[tuple[str, int]] = [("#root", 0)]  # element, node it stands in
        self._run: list[str] = []
        self._linked = self._size = 0
        self._links = self._dropped = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while True:
            token = _TOKEN.search(source, at)
            if token is None:
                self._say(source[at:])
                break
            self._say(source[at : token.start()])
            at = token.end()
            closing, name, attributes = token[1], token[2], token[3]
            if name is None:
                closing, name, attributes = token[4], token[5], token[6]
            if name is None:
                continue
            name = name.lower()
            if not closing and name not in HEAD:
                self._end_head(name)
            if closing:
                self._close(name)
            elif name in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                at = len(source) if end is None else source.find(">", end.start()) + 1 or len(source)
            else:
                self._start(name, attributes)
        self._flush()

    def _say(self, text: str) -> None:
        if self._dropped and text.strip(" \t\n\f\r"):
            self._end_head("#text")
        if text and not self._dropped:
            self._run.append(text)
            if self._links:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._run:
            text = " ".join(entities.unescape("".join(self._run)).split())
            if text:
                share = self._linked / max(1, sum(map(len, self._run)))
                words = text.count(" ") + 1
                length = "1" if words < 3 else "3" if words < 10 else "10" if words < 30 else "30"
                links = "none" if share == 0 else "some" if share < 0.5 else "most"
                look = f"#text {length} {links} {'end' if text[-1] in '.!?:…' else 'open'}"
                self._add("#text", "#text", text, look)
        self._run, self._linked = [], 0

    def _add(self, tag: str, kind: str, text: str, look: str) -> int:
        self.parent.append(self._open[-1][1])
        self.tag.append(tag)
        self.kind.append(kind)
        self.text.append(text)
        self.look.append(look)
        return len(self.tag) - 1

    def _end_head(self, name: str) -> None:
        """End a head that the element or text would stand in; ``body`` also ends what is open in the head."""
        if self._open[-1][0] == "head":
            self._cut(len(self._open) - 1)
        elif name == "body" and self._dropped:
            for k in range(len(self._open) - 1, 0, -1):
                if self._open[k][0] == "head":
                    self._cut(k)

    def _start(self, name: str, attributes: str) -> None:
        if name == "head" and any(n == "head" for n, _ in self._open):
            return
        if name == "br" or name == "wbr":
            if name == "br" and not self._dropped:
                self._run.append(" ")
            return
        if name in BLOCKS:
            self._flush()
            self._end_implied(name)
        if name in VOID:
            return
        if name in BLOCKS:
            named = _name_kind(attributes) if "=" in attributes else ""
            node = self._add(name, f"{name} {named}", "", f"{name} {named}")
        else:
            node = self._open[-1][1]
        if attributes.endswith("/"):
            return
        self._open.append((name, node))
        self._links += name == "a"
        self._dropped += name in DROPPED

    def _end_implied(self, name: str) -> None:
        """A block ends an open paragraph; items, rows and cells end their like within the same list or table."""
        ends, barrier = CLOSES.get(name, set()), BARRIERS.get(name, set())
        for k in range(len(self._open) - 1, 0, -1):
            open_name = self._open[k][0]
            if open_name == "p" or open_name in ends:
                self._cut(k)
            elif open_name in BLOCKS and (not ends or open_name in barrier):
                break

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        for k in range(len(self._open) - 1, 0, -1):
            open_name = self._open[k][0]
            if open_name == name:
                if any(n in BLOCKS for n, _ in self._open[k + 1 :]):
                    self._flush()
                self._cut(k)
                return
            if name not in BLOCKS and open_name in BLOCKS:
                return  # inline ends do not reach out of their block

    def _cut(self, k: int) -> None:
        for name, _ in self._open[k:]:
            self._links -= name == "a"
            self._dropped -= name in DROPPED
        del self._open[k:]

    def labels(self) -> list[bool] | None:
        """What the page's own markup says of each node, or None if it does not say where the article is."""
        roots = [i for i, t in enumerate(self.tag) if t in ARTICLES]
        if not roots or self.tag.count("article") > 1:
            return None
        inside = []
        for i, tag in enumerate(self.tag):
            up = i > 0 and inside[self.parent[i]]
            named = self.kind[i].partition(" ")[2]
            inside.append((up or i == roots[0]) and tag not in EXCLUDED and named in ("", "article"))
        return inside


class Model:
    """Potentials from counts of (what, key, parent's label, label); see ``count``."""

    def __init__(self, counts: dict[tuple[str, str, int, int], float]):
        looks: dict[str, list[float]] = {}
        edges: dict[str, list[list[float]]] = {}
        totals = [0.0, 0.0]
        for (what, key, up, label), n in counts.items():
            if what == "look":
                if key.endswith(" ") and key[:-1] not in EXCLUDED | ARTICLES:
                    continue  # a plain element says no more than its edge does
                looks.setdefault(key, [0.0, 0.0])[label] += n
                totals[label] += n
            else:
                edges.setdefault(key, [[0.0, 0.0], [0.0, 0.0]])[up][label] += n
        for kind in NAMES:
            looks.setdefault(f"name {kind}", [0.0, 0.0])[kind == "article"] += PRIOR
        for tag in EXCLUDED | ARTICLES:
            looks.setdefault(f"{tag} ", [0.0, 0.0])[tag in ARTICLES] += PRIOR
        sizes = [t + len(looks) for t in totals]
        self.looks = {key: ((n[0] + 0.5) / sizes[0], (n[1] + 0.5) / sizes[1]) for key, n in looks.items()}
        smooth = lambda n, up: tuple((n[k] + FOLLOW[k != up]) / (sum(n) + sum(FOLLOW)) for k in (0, 1))
        self.edges = {key: (smooth(n[0], 0), smooth(n[1], 1)) for key, n in edges.items()}
        self.follow = (smooth([0, 0], 0), smooth([0, 0], 1))
        self.apart = (self.follow[0], self.follow[0])

    def node(self, look: str) -> tuple[float, float]:
        if look in self.looks:
            return self.looks[look]
        return self.looks.get(f"name {look.partition(' ')[2]}", (1.0, 1.0))

    def edge(self, kind: str) -> tuple[tuple[float, float], tuple[float, float]]:
        """Chances of the labels under either label of the parent; what is marked as no content is so anywhere."""
        tag, _, name = kind.partition(" ")
        if tag in EXCLUDED or name not in ("", "article"):
            return self.apart
        return self.edges.get(kind, self.follow)

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of every node, by messages up and then down the tree."""
        size = len(page.tag)
        parent, edges = page.parent, [self.edge(kind) for kind in page.kind]
        low, high = map(list, zip(*map(self.node, page.look)))
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * size
        for i in range(size - 1, 0, -1):
            (a, b), (c, d) = edges[i]
            x, y = low[i], high[i]
            m0, m1 = a * x + b * y, c * x + d * y
            total = m0 + m1
            m0, m1 = max(m0 / total, 1e-12), max(m1 / total, 1e-12)
            sent[i] = (m0, m1)
            p = parent[i]
            x, y = low[p] * m0, high[p] * m1
            total = x + y
            low[p], high[p] = x / total, y / total
        down: list[tuple[float, float]] = [(1.0, 1e-6)] * size  # nothing holds the root: a page is no content itself
        out = [0.0] * size
        for i in range(size):
            if i:
                p = parent[i]
                u0, u1 = down[p][0] * low[p] / sent[i][0], down[p][1] * high[p] / sent[i][1]
                (a, b), (c, d) = edges[i]
                x, y = u0 * a + u1 * c, u0 * b + u1 * d
                total = x + y
                down[i] = (max(x / total, 1e-12), max(y / total, 1e-12))
            x, y = down[i][0] * low[i], down[i][1] * high[i]
            out[i] = y / (x + y)
        return out


def extract(model: Model, source: str) -> str:
    page = Page(source)
    kept = model.marginals(page)
    return "\n".join(text for text, share in zip(page.text, kept) if text and share >= 0.5)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each look has each label, and each kind of child each label under each label."""
    counts: Counter = Counter()
    for batch in batches:
        for source in batch.column("html").to_pylist():
            page = Page(source)
            labels = page.labels()
            if labels is None:
                continue
            for i in range(1, len(labels)):
                label = int(labels[i])
                counts["look", page.look[i], 0, label] += 1
                counts["edge", page.kind[i], int(labels[page.parent[i]]), label] += 1
    rows = [(*key, n) for key, n in counts.items()]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
    columns = zip(*rows) if rows else [[]] * 5
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["what", "key", "parent", "label", "n"]
    )


def fit(pages: DataFrame, sample: int = 2000) -> Model:
    """Potentials from about ``sample`` pages; their number of kinds is fixed by the element and name lists."""
    total = pages.count()
    place = F.pmod(F.xxhash64(F.col("page_id").cast("string"), F.lit("page sample")), F.lit(1 << 30)) / (1 << 30)
    chosen = pages.where(F.col("html").isNotNull() & (place < min(1.0, sample / max(1, total))))
    counted = chosen.select("html").mapInArrow(count, "what string, key string, parent int, label int, n long")
    rows = counted.groupBy("what", "key", "parent", "label").agg(F.sum("n").alias("n")).collect()
    return Model({(r["what"], r["key"], r["parent"], r["label"]): float(r["n"]) for r in rows})


def main_text(spark, model: Model) -> Column:
    """The main text of the column ``html``."""
    shared = spark.sparkContext.broadcast(model)
    common.bound_batches(spark)

    @F.pandas_udf("string")
    def text(source: pd.Series) -> pd.Series:
        return source.map(lambda s: extract(shared.value, s))

    return text(F.coalesce(F.col("html"), F.lit("")))


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    text = main_text(pages.sparkSession, fit(pages))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
