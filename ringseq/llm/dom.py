"""A tolerant reader of HTML: block elements as a tree, with runs of text as its leaves.

Every byte is looked at a bounded number of times, whatever the page: open elements are found by name, a search that
failed is not repeated, and elements deeper than DEEP become children of the last one above it, as in browsers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Fixed values of HTML: elements that begin a block, whose inside is no text of the page, whose inside is text only, whose end is a mark of their own only, and that a start tag closes.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = RAW | {"template", "svg"}
SCOPES = ("td", "th", "table", "caption", "button")
TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Depth of the tree.
DEEP = 512

# a tag whose quoted values hold no angle bracket: such a match ends before the next one, so attempts never overlap
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/<>]*+)")
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in DROPPED}
_LONG_REFERENCE = re.compile(r"&#(?:0*+([0-9]*+)|[xX]0*+([0-9a-fA-F]*+));?")
_NAMED = frozenset(("class", "id", "role", "itemprop", "aria-label", "hidden", "aria-hidden", "style", "data-y"))


@dataclass
class Node:
    tag: str
    parent: int
    attrs: dict[str, str] = field(default_factory=dict)
    text: str | None = None
    links: int = 0


def _short(m: re.Match) -> str:
    """A numeric reference without needless zeros; one beyond all characters is the replacement character."""
    digits = m[1] if m[2] is None else m[2]
    return "�" if len(digits) > 7 else m[0] if len(m[0]) < 12 else f"&#{'x' * (m[2] is not None)}{digits or 0};"


def decoded(text: str) -> str:
    """Character references decoded once."""
    return unescape(_LONG_REFERENCE.sub(_short, text)) if "&" in text else text


def attributes(source: str) -> dict[str, str]:
    """Those that say what an element is for."""
    if "=" not in source and "hidden" not in source:
        return {}
    out = {}
    for name, value in _ATTR.findall(source):
        if (name := name.lower()) in _NAMED:
            out.setdefault(name, decoded(value.strip("\"'")))
    return out


class _Tags:
    """The tags of a page, in order: (text before, closing, name, source of attributes); name is empty for marks that say nothing."""

    def __init__(self, html: str):
        self.html, self.at, self.last, self.quotes, self.gone = html, 0, html.rfind(">"), True, set()

    def __iter__(self):
        html, end = self.html, len(self.html)
        while self.at < end:
            i = html.find("<", self.at)
            if i < 0:
                yield html[self.at :], False, "", ""
                return
            before, self.at = html[self.at : i], i
            if m := _TAG.match(html, i):
                self.at = m.end()
                yield before, m[1] == "/", m[2].lower(), m[3]
                continue
            yield (before, *self._odd(i))

    def _odd(self, i: int) -> tuple[bool, str, str]:
        """What stands at a '<' that doesn't begin a plain tag."""
        html = self.html
        if html.startswith("<!--", i):
            j = html.find("-->", i + 4)
            self.at = len(html) if j < 0 else j + 3
            return False, "", ""
        m = _NAME.match(html, i + 1)
        if not m and html[i + 1 : i + 2] not in ("!", "?") or i > self.last and not m:
            self.at = i + 1  # a mark in the text
            return False, "<", ""
        if i > self.last:  # a tag that never ends
            self.at = len(html)
            return False, "", ""
        j = self._end(m.end()) if m and self.quotes else -1
        if j < 0:
            j = html.find(">", i)
        self.at = j + 1
        return (m[1] == "/", m[2].lower(), html[m.end() : j]) if m else (False, "", "")

    def _end(self, at: int) -> int:
        """Of a tag, past the quoted values from `at` on; -1 if it has none, and then no later tag is tried."""
        while m := _STOP.search(self.html, at):
            if m[0] == ">":
                return m.start()
            at = self.html.find(m[0], m.end()) + 1
            if not at:
                break
        self.quotes = False
        return -1

    def skip(self, tag: str) -> None:
        """Past the end of an element whose inside is no text; without an end, the page's for one that holds only text."""
        m = _END[tag].search(self.html, self.at) if tag not in self.gone and self.at <= self.last else None
        if m:
            self.at = m.end()
        else:
            self.gone.add(tag)
            if tag in RAW:
                self.at = len(self.html)


class _Open:
    """The elements that are open: nodes on a stack, and their places in it by tag."""

    def __init__(self):
        self.nodes, self.tags, self.places = [0], ["#page"], {}

    def place(self, *tags: str) -> int:
        """Of the innermost of some tags; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.places[self.tags.pop()].pop()
            self.nodes.pop()

    def parent(self) -> int:
        return self.nodes[min(len(self.nodes), DEEP) - 1]


def tree(html: str) -> list[Node]:
    """Nodes in page order, a parent before its children; the first is the page. Leaves have text; links: characters of it in links."""
    nodes, open_, anchor = [Node("#page", -1)], _Open(), 0
    run: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            if text := " ".join("".join(run).split()):
                nodes.append(Node("#text", open_.parent(), text=text, links=min(linked, len(text))))
            run.clear()
            linked = 0

    tags = _Tags(html)
    for text, closing, tag, source in tags:
        if text:
            text = decoded(text)
            run.append(text)
            if anchor:
                linked += len(text)
        if not tag:
            continue
        if tag == "<":
            run.append(tag)
        elif closing:
            if tag == "a":
                anchor = 0
            elif (tag in BLOCKS or "-" in tag) and tag not in ("body", "html"):
                at = open_.place(tag)
                if at and (tag in TABLE or at >= open_.place(*SCOPES)):
                    flush()
                    open_.cut(at)
        elif tag in DROPPED:
            if not source.endswith("/"):
                tags.skip(tag)
        elif tag == "a":
            anchor = 1
        elif tag == "hr":
            flush()
        elif tag == "br":
            run.append(" ")
        elif tag in BLOCKS or "-" in tag:
            if tag in ("html", "body") and open_.place(tag):
                continue
            top = open_.tags[-1]
            if top == "p" or top in HEADINGS and tag in HEADINGS:
                flush()
                open_.cut(len(open_.nodes) - 1)
            if tag in CLOSES:
                these, upto = CLOSES[tag]
                at = open_.place(*these)
                if at > open_.place(*upto):
                    flush()
                    open_.cut(at)
            flush()
            nodes.append(Node(tag, open_.parent(), attributes(source)))
            open_.push(len(nodes) - 1, tag)
    flush()
    return nodes
