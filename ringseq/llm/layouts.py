"""Labelled web pages from a grammar: families of layouts, each with its own skeleton, elements and names.

An element that begins or ends content has data-y, 1 or 0; others have their parent's label. <x-text> marks content that has
no element of its own. Words are invented: syllables of a consonant, a vowel and at times a final consonant.
"""

from __future__ import annotations

import random

_ONSETS, _VOWELS, _FINALS = "b c d f g h j k l m n p r s t v w z br cl dr fl gr pl pr qu sh sp st th tr".split(), "a e i o u ai ea ie oo ou é ö ñe".split(), ["", "", "", "l", "m", "n", "r", "s", "t", "nd", "ng", "st"]


class Writer:
    """Makes parts of a page from a source of random numbers."""

    def __init__(self, r: random.Random):
        self.r = r
        self.lower = r.random() < 0.95  # names of elements
        self.loose = r.random() < 0.35  # ends of paragraphs and list items are left out

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        return "".join(self.r.choice(_ONSETS) + self.r.choice(_VOWELS) + self.r.choice(_FINALS) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self, a: int = 4, b: int = 20) -> str:
        r, kind = self.r, self.r.random()
        said = [self.word() for _ in range(r.randint(a, b))]
        if kind < 0.05:
            said = [w.upper() for w in said]
        elif kind < 0.12:  # noise, as in scanned or machine-made text
            said = [w + r.choice(("", "", "~~", "@@", "=", "++", "^^", "/", "&lt;&gt;")) for w in said]
        elif kind < 0.2:
            said[r.randrange(len(said))] = str(r.randint(1, 99999))
        if self.chance(0.3) and len(said) > 6:
            said[r.randrange(1, len(said) - 1)] += r.choice((",", ";", " &mdash;", " &amp;"))
        text = " ".join(said)
        return text[:1].upper() + text[1:] + r.choice((".", ".", ".", ".", "!", "?", "", "&hellip;"))

    def prose(self, most: int = 7) -> str:
        r, out = self.r, []
        for _ in range(r.randint(1, most)):
            s = self.sentence()
            if self.chance(0.15):
                s = r.choice(("<em>{}</em>", "<b>{}</b>", "<strong>{}", "<span class=x>{}</span>", "<a href='/n'>{}</a>", "<i>{}", "<code>{}</code>", "<q>{}</q>", "<u>{}</u>")).replace("{}", s)
            out.append(s)
        return r.choice((" ", " ", " ", "\n", "<br>", "<br/> ")).join(out)

    def tag(self, name: str, inner: str, names: str = "", y: int | None = None, end: bool = True) -> str:
        """names: of which one may be its class, id or role."""
        r, mark = self.r, "" if y is None else f' data-y="{y}"'
        name = name if self.lower else name.upper()
        if names:
            own = r.choice(names.split())
            own = r.choice(("{}", "{}", "{}", "the-{}", "{}-1", "{} wide", "box {}", "js-{}", "{}Area", "x_{}")).replace("{}", own)
            mark += r.choice((f' class="{own}"', f" class='{own}'", f" id={own.split()[0]}", f' id="{own.split()[0]}" class="u{r.randint(1, 9)}"'))
        return f"<{name}{mark}>{inner}" + (f"</{name}>" if end else "") + r.choice(("", "", "\n", "\n  "))

    def links(self, kind: str = "ul", a: int = 2, b: int = 9) -> str:
        own = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(self.r.randint(a, b))]
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{x}" + "</li>" * (not self.loose) for x in own) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ", " &raquo; ")).join(own)

    def block(self) -> str:
        r, k = self.r, self.r.random()
        if k < 0.7:
            return self.tag("p", self.prose(), end=not self.loose)
        if k < 0.77:
            return self.tag(r.choice(("h2", "h2", "h3", "h4")), self.words(2, 7).capitalize())
        if k < 0.84:
            return self.tag(r.choice(("ul", "ol")), "".join(self.tag("li", self.prose(2), end=not self.loose) for _ in range(r.randint(1, 6))))
        if k < 0.88:
            return self.tag("blockquote", r.choice((self.prose(3), f"<p>{self.prose(3)}</p>")))
        if k < 0.91:
            return self.tag("pre", "\n".join(self.words(1, 6) for _ in range(r.randint(1, 5))))
        if k < 0.94:
            return self.tag("table", "".join(f"<tr><td>{self.word()}</td><td>{self.sentence(2, 8)}</td></tr>" for _ in range(r.randint(1, 5))))
        if k < 0.97:
            return self.tag("figure", f'<img src="i.png" alt="{self.words(1, 3)}">' + self.tag("figcaption", self.sentence()))
        return self.tag("div", self.prose())

    def body(self) -> list[str]:
        if self.chance(0.1):  # hardly a text
            return [self.tag("p", self.r.choice((self.words(1, 4), self.sentence(1, 5))))]
        return [self.block() for _ in range(self.r.choice((1, 2, 3, 4, 6, 9, 14)))]

    def title(self) -> str:
        return self.tag("h1", self.sentence(2, 10))

    def advert(self) -> str:
        inner = self.r.choice((self.prose(2), f"<p>{self.prose(2)}</p>", f"<a href=/go>{self.sentence()}</a>", f"<div>{self.words(1, 3)}</div>{self.prose(1)}"))
        return self.tag(self.r.choice(("div", "div", "aside", "section", "p")), inner, "ad ads advert advertisement adbox ad-slot sponsor sponsored promo promoted commercial", 0)

    def notice(self) -> str:
        inner = self.r.choice((self.prose(2), f"<p>{self.prose(3)}</p>")) + f"<button>{self.words(1, 2)}</button>" * self.chance(0.6)
        return self.tag(self.r.choice(("div", "div", "section", "dialog")), inner, "cookie cookies cookie-bar consent gdpr notice alert popup modal overlay message paywall announcement", 0)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 5)}</label><input type=text name=a><button type=submit>{self.word()}</button>"
        if self.chance(0.3):
            inner += f"<select><option>{self.word()}<option>{self.words(1, 2)}</select>"
        if self.chance(0.4):
            inner = f"<p>{self.prose(2)}</p>" + inner
        if self.chance(0.5):
            return self.tag("form", inner, self.r.choice(("", "search login signup newsletter contact survey")), 0)
        return self.tag(self.r.choice(("div", "section")), self.tag("h3", self.words(1, 4)) * self.chance(0.5) + f"<p>{self.prose(2)}</p>" * self.chance(0.5) + f"<form>{inner}</form>", "newsletter signup subscribe login search contact poll", 0)

    def comments(self, deep: int = 2) -> str:
        def one(left: int) -> str:
            said = self.tag("span", self.words(1, 2)) * self.chance(0.4) + self.r.choice((f"<p>{self.prose(3)}</p>", self.prose(3)))
            return self.tag(self.r.choice(("div", "li", "article", "div")), said + (one(left - 1) if left and self.chance(0.3) else ""), "comment reply response comment-body post-reply user-comment")

        inner = self.tag("h3", self.words(1, 3)) * self.chance(0.5) + "".join(one(deep) for _ in range(self.r.randint(1, 5)))
        return self.tag(self.r.choice(("div", "section", "ol", "aside")), inner, "comments comment-list replies responses discussion reader-comments thread disqus", 0)

    def share(self) -> str:
        return self.tag(self.r.choice(("div", "ul", "p")), self.links(self.r.choice(("ul", "line"))), "share sharing social follow tags related byline", 0)

    def side(self) -> str:
        inner = "".join(self.tag("h4", self.words(1, 3)) + self.r.choice((self.links(), f"<p>{self.prose(2)}</p>", self.links("line"))) for _ in range(self.r.randint(1, 3)))
        return self.tag(self.r.choice(("aside", "aside", "div", "div", "section")), inner, "sidebar side widget widgets rail related more-stories recommended trending popular", 0)

    def menu(self) -> str:
        kind = self.r.choice(("ul", "ul", "line"))
        name = self.r.choice(("nav", "nav", "nav", "div", "ul" if kind == "line" else "div"))
        return self.tag(name, self.links(kind), "" if name == "nav" and self.chance(0.6) else "nav menu navbar navigation breadcrumb topmenu tabs main-nav", 0)

    def top(self) -> str:
        inner = self.r.choice((f"<a href=/>{self.words(1, 3)}</a>", f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(1, 4)}</p>", f"<h2>{self.words(1, 2)}</h2><p>{self.sentence()}</p>"))
        name = self.r.choice(("header", "header", "div"))
        return self.tag(name, inner + (self.menu() if self.chance(0.3) else ""), "" if name == "header" and self.chance(0.6) else "header masthead banner logo branding topbar", 0)

    def foot(self) -> str:
        inner = self.r.choice(("&copy; ", "Copyright ", "(c) ", "")) + self.sentence(2, 10) + self.links(self.r.choice(("ul", "line"))) * self.chance(0.4) + f"<p>{self.prose(2)}</p>" * self.chance(0.4)
        name = self.r.choice(("footer", "footer", "div"))
        return self.tag(name, inner, "" if name == "footer" and self.chance(0.6) else "footer foot bottom copyright colophon legal imprint", 0)

    def some(self, parts: list, p: float) -> str:
        return "".join(f() for f in self.r.sample(parts, len(parts)) if self.chance(p))

    def strewn(self, blocks: list[str], p: float = 0.3) -> str:
        """Blocks with adverts, links and notices among them."""
        out = list(blocks)
        for make in (self.advert, self.share, self.notice, self.form, self.side):
            if self.chance(p / 2 if make != self.advert else p):
                out.insert(self.r.randint(0, len(out)), make())
        return "".join(out)


def _semantic(w: Writer) -> str:
    """Elements that say what they are."""
    inner = w.title() * w.chance(0.85) + w.strewn(w.body()) + (w.comments() if w.chance(0.15) else "")
    article = w.tag("article", inner, w.r.choice(("", "", "post story entry")), 1)
    if w.chance(0.4):
        article = w.tag("main", w.some([w.advert, w.share], 0.15) + article + w.some([w.comments, w.side, w.share], 0.3), "", 0)
    return w.some([w.top, w.menu, w.notice, w.advert, w.form], 0.55) + article + w.some([w.side, w.comments, w.advert, w.form], 0.4) + (w.foot() if w.chance(0.85) else "")


def _named(w: Writer) -> str:
    """All divisions, told apart by their names."""
    inner = w.title() * w.chance(0.85) + w.strewn(w.body())
    content = w.tag("div", inner, "content post entry article story main-text article-body post-body entry-content text page-text", 1)
    if w.chance(0.4):
        content = w.tag("div", content + (w.comments() if w.chance(0.5) else ""), "wrap column col left inner", 0)
    out = w.some([w.top, w.menu, w.notice, w.advert], 0.6) + content + w.some([w.side, w.comments, w.share, w.form], 0.45) + w.foot()
    return w.tag("div", out, "wrapper page container root") if w.chance(0.6) else out


def _main(w: Writer) -> str:
    """A main element, or one of that role, with headed sections."""
    sections = "".join(w.tag("section", w.tag("h2", w.words(2, 6)) + "".join(w.body()[:4])) for _ in range(w.r.randint(1, 3)))
    inner = w.title() + sections + w.some([w.advert, w.share, w.notice], 0.2)
    main = f'<div role="main" data-y="1">{inner}</div>' if w.chance(0.3) else w.tag("main", inner, w.r.choice(("", "content")), 1)
    return w.some([w.menu, w.top, w.form, w.notice], 0.5) + main + w.some([w.side, w.comments, w.advert, w.form], 0.4) + w.foot()


def _flat(w: Writer) -> str:
    """Blocks of the article lie beside all others."""
    blocks = [w.title()] * w.chance(0.8) + w.body()
    blocks = [b.replace(">", ' data-y="1">', 1) for b in blocks]
    return w.some([w.top, w.menu, w.notice], 0.7) + w.strewn(blocks, 0.25) + w.some([w.comments, w.side, w.share], 0.35) + (w.foot() if w.chance(0.8) else "")


def _tables(w: Writer) -> str:
    """Columns of a table."""
    inner = w.title() * w.chance(0.8) + w.strewn(w.body(), 0.15)
    cells = [w.tag("td", w.links(w.r.choice(("ul", "line"))), "menu nav sidebar links", 0), w.tag("td", inner, w.r.choice(("", "content text main")), 1)]
    if w.chance(0.4):
        cells.append(w.tag("td", w.advert() + w.side(), "right side ads", 0))
    top = f'<tr><td colspan="3" data-y="0" class="header">{w.words(1, 4)}</td></tr>' * w.chance(0.6)
    foot = f'<tr><td colspan="3" data-y="0" class="footer">{w.sentence()}</td></tr>' * w.chance(0.6)
    return f'<table data-y="0">{top}<tr>{"".join(cells)}</tr>{foot}</table>' + (w.foot() if w.chance(0.4) else "")


def _deep(w: Writer) -> str:
    """Many divisions without meaning around everything."""
    def nest(inner: str, y: int | None) -> str:
        for _ in range(w.r.randint(0, 4)):
            inner = f'<div class="c{w.r.randint(10, 99)}-{w.r.randint(0, 9)}"{"" if y is None else f" data-y={y}"}>{inner}</div>'
        return inner

    inner = w.title() * w.chance(0.85) + "".join(nest(b, 1) if w.chance(0.2) else b for b in w.body())
    article = nest(w.tag(w.r.choice(("article", "section", "div")), inner, "article story post body content", 1), 0)
    others = lambda parts, p: "".join(nest(f(), 0) for f in parts if w.chance(p))
    return f'<div id="app">{others([w.top, w.menu, w.notice, w.form], 0.6)}{article}{others([w.share, w.side, w.comments, w.advert, w.foot], 0.5)}</div>'


def _bare(w: Writer) -> str:
    """A text, and at most a menu and a last line."""
    inner = w.r.choice((lambda: f'<x-text data-y="1">{w.prose()}</x-text>', lambda: w.tag("div", "".join(w.body()), "", 1), lambda: "".join(b.replace(">", ' data-y="1">', 1) for b in w.body())))()
    return w.some([w.menu], 0.4) + inner + w.some([w.foot], 0.4)


FAMILIES = {"semantic": _semantic, "named": _named, "main": _main, "flat": _flat, "tables": _tables, "deep": _deep, "bare": _bare}
_SCRIPTS = ['<script>if (a < b) { document.write("<div>"); }</script>', '<script type="application/ld+json">{"@type": "NewsArticle"}</script>', "<style>.a > .b { color: red }</style>", "<link rel=stylesheet href=/s.css>", "<noscript><img src=/t.gif></noscript>", "<!-- <p>old</p> -->"]


def page(w: Writer, family: str) -> str:
    inner = FAMILIES[family](w)
    head = "".join(w.r.sample(_SCRIPTS, w.r.randint(0, 3)))
    inner = inner if w.chance(0.5) else w.r.choice(_SCRIPTS[:3] + _SCRIPTS[5:]) + inner
    if w.chance(0.1):
        return inner
    return f"<!doctype html>\n<html><head><title>{w.sentence()}</title>{head}</head><body>{inner}" + w.r.choice(("</body></html>", "</body>\n</html>\n", ""))


def pages(n: int, seed: int, without: str | None = None, only: str | None = None) -> list[str]:
    """n pages, the families in turn; without or only: a family."""
    r = random.Random(seed)
    names = [only] if only else [f for f in FAMILIES if f != without]
    return [page(Writer(r), names[i % len(names)]) for i in range(n)]
