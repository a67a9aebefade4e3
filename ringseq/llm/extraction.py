"""Main text of web pages by a graphical model on the DOM tree.

Every block element and every run of text is a variable, content or not. A node's own potential is a weighted sum of
features: its element, the words of its class, id and role, and for text its length, links and marks. A parent and a child
share a potential of two by two, of four kinds: for element or text children, below the page's body or further down. Messages go upward from the leaves and
downward from the root (sum-product), and give each node's exact marginal, as the graph is a tree. Runs of text whose
marginal is at least one half are the blocks of the main text.

The potentials are trained by the exact gradient of the likelihood on labelled pages: pages() writes them, with a label
on each element, from a grammar of several families of layouts (see `layouts`). Their number and seed are parameters.

Features are kept as lists of those that are there, and pages are taken together up to a number of nodes, so memory follows
the nodes of a few pages, or of one long page.

Defined results: null and empty pages, and pages without content, have an empty text; white space inside a block, line
breaks included, is one space; character references are decoded once; unclosed tags end with the page.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import mapped
from .dom import HEADINGS, Node, tree
from .layouts import pages

# Words in class, id or role by what they say, in a few languages.
WORDS = {
    "nav": "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager paging tabs toc skip topbar toolbar sitemap",
    "head": "header masthead logo branding brand banner top sitehead hero tagline",
    "foot": "footer foot bottom copyright colophon contentinfo legal imprint impressum credits",
    "side": "sidebar side aside complementary rail widget widgets related recommended recommendations trending popular more latest teaser promo tags tagcloud",
    "ad": "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promotion promoted werbung anzeige publicidad publicite dfp outbrain taboola commercial",
    "notice": "cookie cookies consent gdpr notice notices alert alertdialog popup modal overlay warning message dialog paywall subscribe subscription announcement banderole toast",
    "comment": "comment comments commentlist reply replies respond response responses disqus discussion kommentar kommentare commentaires comentarios reader readers thread",
    "form": "form search login signin signup register newsletter contact poll survey input field",
    "share": "share sharing social follow facebook twitter print buttons meta byline author bio rating likes",
    "main": "article main content post entry story body text hentry maincontent articlebody blog page document prose",
}
_KIND = {w: k for k, ws in WORDS.items() for w in ws.split()}
_SPLIT = re.compile(r"[^0-9A-Za-z]+|(?<=[a-z0-9])(?=[A-Z])")
_TAGS = ["article", "main", "section", "div", "p", "heading", "list", "table", "nav", "header", "footer", "aside", "form", "quote", "head", "page", "other"]
_TAG_OF = {"ul": "list", "ol": "list", "li": "list", "dl": "list", "dt": "list", "dd": "list", "menu": "nav", "dir": "list", "form": "form", "button": "form", "select": "form", "option": "form", "optgroup": "form", "fieldset": "form", "legend": "form", "search": "form", "dialog": "form", "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote", "html": "page", "body": "page", "#page": "page"} | {h: "heading" for h in HEADINGS} | {t: "table" for t in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption")}
_COLUMN = {k: i for i, k in enumerate([f"<{t}>" for t in _TAGS] + [f".{k}" for k in WORDS] + ["hidden", "text", "long", "longer", "links", "linked", "ends", "mark", "one word", "under heading", "under list", "under p", "1"])}
WIDTH = len(_COLUMN)
_MARK = re.compile(r"©|copyright|all rights reserved|cookie|alle rechte|tous droits|todos los derechos", re.I)


def _words(source: str) -> tuple[str, ...]:
    return _words_of_short(source) if len(source) < 200 else _words_of_short.__wrapped__(source)


@lru_cache(maxsize=8192)
def _words_of_short(source: str) -> tuple[str, ...]:
    return tuple(sorted({k for w in _SPLIT.split(source) if (k := _KIND.get(w.lower()))}))


def _element(n: Node) -> list[int]:
    tag = _TAG_OF.get(n.tag, n.tag)
    out = [_COLUMN["1"], _COLUMN[f"<{tag if tag in _TAGS else 'other'}>"]]
    if n.attrs:
        a = n.attrs
        source = " ".join(a[k] for k in ("class", "id", "role", "itemprop", "aria-label") if k in a)
        out += [_COLUMN[f".{k}"] for k in _words(source)]
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
            out.append(_COLUMN["hidden"])
    return out


class Graph:
    """Several pages' trees: features as (node, column, value), parents, nodes by depth, and each node's kind of edge (2 for
    text, 1 more below the body)."""

    def __init__(self, pages: list[list[Node]]):
        node, column, value, parent, depth, kind, c, base = [], [], [], [], [], [], _COLUMN, 0

        def mark(k: int, where: int, x: float = 1.0) -> None:
            node.append(k)
            column.append(where)
            value.append(x)

        for nodes in pages:
            for n in nodes:
                k, above = len(parent), nodes[n.parent]
                parent.append(base + n.parent if n.parent >= 0 else -1)
                depth.append(depth[base + n.parent] + 1 if n.parent >= 0 else 0)
                kind.append(2 * (n.text is not None) + (_TAG_OF.get(above.tag) == "page") if n.parent >= 0 else 0)
                if n.text is None:
                    for where in set(_element(n)):
                        mark(k, where)
                    continue
                size, under = len(n.text), _TAG_OF.get(above.tag, above.tag)
                mark(k, c["text"])
                mark(k, c["long"], min(1.0, size / 80))
                mark(k, c["longer"], min(1.0, size / 400))
                for where, x in (("links", n.links / size), ("linked", n.links > 0.5 * size), ("ends", n.text[-1] in ".!?…\"”"), ("mark", size < 300 and _MARK.search(n.text)), ("one word", " " not in n.text)):
                    if x:
                        mark(k, c[where], x if where == "links" else 1.0)
                if under in ("heading", "list", "p"):
                    mark(k, c[f"under {under}"])
            base = len(parent)
        self.size, self.parent, self.kind = base, np.array(parent, np.int64), np.array(kind, np.int64)
        self.node, self.column, self.value = np.array(node, np.int64), np.array(column, np.int64), np.array(value, float)
        levels = np.array(depth, np.int64)
        order = np.argsort(levels, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(levels[order])) + 1)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Of each node: its features' weighted sum."""
        return np.bincount(self.node, self.value * weights[self.column], self.size)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each feature: its values times x of their nodes."""
        return np.bincount(self.column, self.value * x[self.node], WIDTH)


class Model:
    """weights by feature; table [4 kinds of edge, 2, 2]: parent's label, child's label."""

    def __init__(self, weights: np.ndarray, table: np.ndarray):
        self.weights, self.table = weights, table

    def marginals(self, g: Graph) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and [n, 2, 2] of each node with its parent (zeros at roots)."""
        n, parent, levels, kind = g.size, g.parent, g.levels, g.kind
        up = np.zeros((n, 2))  # own potential and the children's messages
        up[:, 1] = g.scores(self.weights)
        edge, message = self.table[kind], np.zeros((n, 2))
        for own in levels[:0:-1]:
            s = edge[own] + up[own][:, None, :]
            message[own] = np.logaddexp(s[:, :, 0], s[:, :, 1])
            p = parent[own]  # ascending, as nodes are in page order
            first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            up[p[first]] += np.add.reduceat(message[own], first, axis=0)
        down, pair = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for own in levels[1:]:
            p = parent[own]
            rest = up[p] + down[p] - message[own]  # all that the parent knows but from this child
            s = rest[:, :, None] + edge[own]
            down[own] = np.logaddexp(s[:, 0], s[:, 1])
            joint = s + up[own][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            e = np.exp(joint)
            pair[own] = e / e.sum(axis=(1, 2), keepdims=True)
        both = up + down
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50))), pair


@lru_cache(maxsize=4)
def train(n: int = 500, seed: int = 5, steps: int = 200, l2: float = 0.003, without: str | None = None) -> Model:
    """Fit on n labelled pages; without: a family of layouts that is left out."""
    labelled = [labels_of(tree(h)) for h in pages(n, seed, without=without)]
    trees, y = [t for t, _ in labelled], np.array([v for _, own in labelled for v in own], float)
    g = Graph(trees)
    inner = np.concatenate(g.levels[1:])
    seen = np.zeros((4, 2, 2))
    np.add.at(seen, (g.kind[inner], y[g.parent[inner]].astype(int), y[inner].astype(int)), 1)
    model = Model(np.zeros(WIDTH), np.zeros((4, 2, 2)))
    m, v = [0.0, 0.0], [0.0, 0.0]
    for t in range(1, steps + 1):
        p, pair = model.marginals(g)
        hoped = np.stack([pair[g.kind == k].sum(axis=0) for k in range(4)])
        for k, (value, gradient) in enumerate(((model.weights, g.sums(y - p)), (model.table, seen - hoped))):
            gradient = gradient / len(trees) - l2 * value
            m[k], v[k] = 0.9 * m[k] + 0.1 * gradient, 0.99 * v[k] + 0.01 * gradient * gradient
            value += 0.15 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return model


def labels_of(nodes: list[Node]) -> tuple[list[Node], list[int]]:
    """A labelled page's nodes and labels. <x-text> marks content that has no element of its own; it is taken out."""
    label: list[int] = []
    for n in nodes:
        own = n.attrs.get("data-y")
        label.append(int(own) if own else label[n.parent] if n.parent >= 0 else 0)
    at, kept, y = {-1: -1}, [], []
    for i, n in enumerate(nodes):
        if n.tag == "x-text":
            at[i] = at[n.parent]
            continue
        at[i] = len(kept)
        kept.append(Node(n.tag, at[n.parent], n.attrs, n.text, n.links))
        y.append(label[i])
    return kept, y


def main_texts(model: Model, html: list[str | None], nodes: int = 50_000) -> list[str]:
    """Of pages, which are taken together up to a number of nodes."""
    out, held, size = [], [], 0

    def solve() -> None:
        base = 0
        if held:
            p, _ = model.marginals(Graph(held))
            for own in held:
                out.append("\n\n".join(n.text for i, n in enumerate(own) if n.text is not None and p[base + i] >= 0.5))
                base += len(own)
            held.clear()

    for h in html:
        held.append(tree(h or ""))
        size += len(held[-1])
        if size >= nodes:
            solve()
            size = 0
    solve()
    return out


def extract(docs: DataFrame, html: str = "html", to: str = "text", model: Model | None = None) -> DataFrame:
    """docs with the main text of the column html."""
    model = model or train()
    return mapped(docs, html, to, "string", lambda pages: main_texts(model, pages))
