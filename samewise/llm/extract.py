"""Main text of HTML pages by a tree-structured graphical model.

The blocks of a page are the nodes of a tree; each is content or not.  Node
potentials come, for each element and by whether names around it speak against
content, from discrete features of its text (link
density, length, punctuation, telling words, being hidden), parent-child potentials from how
labels follow each other down the tree for the elements and the kinds of class
names of both; they are counted on labelled pages, and where few were seen the
parent's element counts less.
Sum-product messages upward and downward give every block's marginal, and the
text of blocks with a marginal of at least AT is kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Node, parse
from .html_pages import labelled_pages

AT = 0.5
#: The blocks below one parent are alike, so the evidence of many counts as that of so many.
SIBLINGS = 3
TRAIN_PAGES = 1500
SMOOTH = 0.3

# Parts of class and id names by what they tell; the first that occurs counts.
NAMES = {
    "comment": "comment comments reply replies discussion disqus respond commentlist",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs sitemap",
    "notice": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe subscription signup paywall banner overlay toast dialog",
    "side": "sidebar aside rail widget widgets related recommended recommendations popular trending more",
    "footer": "footer bottom copyright legal imprint colophon contentinfo",
    "header": "header masthead topbar logo branding",
    "share": "share sharing social tags buttons",
    "content": "content article post entry story main body text page blog",
}
WORDS = re.compile(r"\b(cookies?|subscribe|newsletter|sign up|log in|privacy policy|advertisement|share this)\b", re.I)
_NAME_OF = {word: i + 1 for i, words in enumerate(NAMES.values()) for word in words.split()}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SIZES = (18, 9 + 1, 2 * 18, 5, 5, 3, 2, 2)


@lru_cache(maxsize=4096)
def name_kind(attrs: str) -> int:
    kinds = {_NAME_OF[p] for p in (x.lower() for x in _PARTS.findall(attrs)) if p in _NAME_OF}
    return min(kinds, default=0)


def features(nodes: list[Node]) -> list[tuple[int, ...]]:
    """One tuple of discrete features for each node."""
    letters, linked = [n.letters for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        letters[p] += letters[i]
        linked[p] += linked[i]
    kinds = [name_kind(n.attrs) if n.attrs else 0 for n in nodes]
    found = []
    for i, n in enumerate(nodes):
        size = n.letters
        density = 4 if not letters[i] else min(3, int(4 * linked[i] / letters[i]))
        length = 0 if not size else 1 if size < 25 else 2 if size < 80 else 3 if size < 200 else 4
        ends = 0 if not size else 1 if any(x[-1] in ".!?:;…。" for x in n.runs) else 2
        telling = bool(0 < size < 300 and any(WORDS.search(x) for x in n.runs))
        around = 0 < kinds[i] < len(NAMES) or 0 < kinds[max(n.parent, 0)] < len(NAMES)  # it or its parent is named as something other than content
        found.append((n.group, kinds[i], 2 * n.group + around, density, length, ends, int(telling), int(n.hidden)))
    return found


_CHILDREN = _SIZES[0] * _SIZES[1]


def _edge_kind(parent: tuple[int, ...], child: tuple[int, ...]) -> int:
    """Kind of an edge: the parent's element and whether its names tell nothing, content or something else; the child's element and names."""
    above = 3 * parent[0] + (0 if not parent[1] else 1 if parent[1] == len(NAMES) else 2)
    return above * _CHILDREN + child[0] * _SIZES[1] + child[1]


@dataclass
class Model:
    """node[f][element][value]: odds of content against the rest; edge[kinds of parent and child]: P(child | parent) as (00, 01, 10, 11); root: odds of the root."""

    node: list[list[list[float]]]
    edge: list[tuple[float, float, float, float]]
    root: float

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for every node, by sum-product on the tree."""
        up0, up1 = [1.0] * len(nodes), []
        tables = self.node
        seen = features(nodes)
        edges = [self.edge[_edge_kind(seen[max(n.parent, 0)], f)] for n, f in zip(nodes, seen)]
        below = [0] * len(nodes)
        for n in nodes[1:]:
            below[n.parent] += 1
        for n, f in zip(nodes, seen):
            odds = 1.0
            for table, value in zip(tables, f[3:]):
                odds *= table[f[2]][value]
            many = below[max(n.parent, 0)]
            up1.append(odds if many <= SIBLINGS else odds ** (SIBLINGS / many))
        to0, to1 = [1.0] * len(nodes), [1.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # upward: children come after parents
            a, b = up0[i], up1[i]
            s = a + b
            a, b = a / s, b / s
            up0[i], up1[i] = a, b
            p = nodes[i].parent
            t00, t01, t10, t11 = edges[i]
            m0, m1 = t00 * a + t01 * b, t10 * a + t11 * b
            s = m0 + m1
            to0[i], to1[i] = m0 / s, m1 / s
            a, b = up0[p] * to0[i], up1[p] * to1[i]
            s = a + b
            up0[p], up1[p] = a / s, b / s
        out = [0.0] * len(nodes)
        be0, be1 = [0.0] * len(nodes), [0.0] * len(nodes)
        be0[0], be1[0] = up0[0], up1[0] * self.root
        for i, n in enumerate(nodes):  # downward
            if i:
                p = n.parent
                t00, t01, t10, t11 = edges[i]
                c0, c1 = be0[p] / max(to0[i], 1e-300), be1[p] / max(to1[i], 1e-300)
                be0[i] = up0[i] * (c0 * t00 + c1 * t10)
                be1[i] = up1[i] * (c0 * t01 + c1 * t11)
            s = be0[i] + be1[i] or 1.0
            be0[i], be1[i] = be0[i] / s, be1[i] / s
            out[i] = be1[i]
        return out

    def text(self, html: str | None, at: float = AT) -> str:
        """The page's main text; empty for null or empty html."""
        if not html:
            return ""
        nodes, runs = parse(html)
        marginal = self.marginals(nodes)
        return "\n".join(text for i, text in runs if marginal[i] >= at)


_GOLD = re.compile(r"data-gold\s*=\s*([\"']?)([01])\1")


def fit(pages: list[str], smooth: float = SMOOTH) -> Model:
    """Potentials counted on pages whose blocks carry data-gold; blocks without it are left out."""
    node = [[[[smooth, smooth] for _ in range(n)] for _ in range(_SIZES[2])] for n in _SIZES[3:]]
    edge = [[0.0] * 4 for _ in range(3 * _SIZES[0] * _CHILDREN)]
    for html in pages:
        # the label rides in the id, which the parser keeps, and is taken out again before features are made
        nodes, _ = parse(_GOLD.sub(r'id="gold\2" ', html))
        gold = []
        for n in nodes:
            m = re.search(r"gold([01])", n.attrs)
            gold.append(int(m[1]) if m else None)
            n.attrs = re.sub(r"gold[01]", "", n.attrs).strip()
        gold[0] = 1
        seen = features(nodes)
        for i, f in enumerate(seen):
            if gold[i] is None:
                continue
            for table, value in zip(node, f[3:]):
                table[f[2]][value][gold[i]] += 1
            above = gold[nodes[i].parent]
            if i and above is not None:
                edge[_edge_kind(seen[nodes[i].parent], f)][2 * above + gold[i]] += 1
    odds = [[[(b / sum(x[1] for x in one)) / (a / sum(x[0] for x in one)) for a, b in one] for one in table] for table in node]
    # the child alone stands behind what was seen of the pair, and labels handed down behind that
    child = [[sum(edge[above * _CHILDREN + c][k] for above in range(3 * _SIZES[0])) for k in range(4)] for c in range(_CHILDREN)]
    rows = []
    for kind, counts in enumerate(edge):
        row = []
        for y, handed in ((0, (0.98, 0.02)), (1, (0.2, 0.8))):
            few = child[kind % _CHILDREN][2 * y : 2 * y + 2]
            base = [(n + 4 * h) / (sum(few) + 4) for n, h in zip(few, handed, strict=True)]
            own = counts[2 * y : 2 * y + 2]
            row += [(n + 4 * b) / (sum(own) + 4) for n, b in zip(own, base, strict=True)]
        rows.append(tuple(row))
    return Model(odds, rows, exp(4.0))


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of pages.

    Null or empty html, and pages without content, give an empty text.  Repeated
    rows give repeated results; an empty table gives no rows.  Very long pages are
    read whole, in time in proportion to their length.  A line break (br) is white
    space within its block.  Columns
    of other names are not read, whatever they are.  Pages are not shuffled.
    """
    held = model or fit(labelled_pages(TRAIN_PAGES))
    sent = pages.sparkSession.sparkContext.broadcast(held)  # a few hundred numbers

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [sent.value.text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = base.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
