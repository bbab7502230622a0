"""Labelled pages to train the extractor on: layouts written by rule, as lists of (tag path, text, is main text).

A page is a tree of regions (menu, header, advert, sidebar, notice, form, comments, footer,
article). The containers' tags and class names vary; on a quarter of the pages the names are random letters, and the tags of some
say nothing, so that lengths, links, repetition, order and the place beside the longest text have to tell; some pages are text without
any tag. The texts are made-up words.
"""

from __future__ import annotations

import html
import random
import re

#: Containers of each region: tags with class names or ids that pages commonly use.
_MENU = ("nav", 'nav class="main-nav"', 'div class="menu"', 'div id="navigation"', 'ul class="navbar"', 'div class="breadcrumb"', 'div role="navigation"')
_HEADER = ("header", 'div id="header"', 'header class="site-header"', 'div class="masthead"', 'div class="topbar"')
_AD = ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'aside class="ad-slot"', 'div class="banner"', 'div class="sponsored"', 'div class="promo"', 'section class="sponsor"')
_SIDE = ("aside", 'div class="sidebar"', 'aside class="sidebar"', 'div id="sidebar"', 'div class="related"', 'section class="widget"', 'div class="recommended"', 'div class="share social"')
_NOTICE = ('div class="notice"', 'div class="cookie-notice"', 'div class="cookie banner"', 'div id="consent"', 'div class="alert"', 'div class="popup modal"', 'div role="alert"', 'div class="disclaimer"')
_FORM = ("form", 'form class="search"', 'form class="newsletter"', 'div class="subscribe"', 'form class="login"', 'form action="/post"')
_COMMENTS = ('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div class="replies"', 'div class="discussion comment"')
_FOOTER = ("footer", 'div id="footer"', 'footer class="site-footer"', 'div class="footer"', 'div class="copyright"', 'div class="bottom legal"')
_ARTICLE = ("article", "main", 'article class="post"', 'div class="content"', 'div class="article-body"', 'div id="content"', 'div class="post entry"', 'main class="main"', 'section class="story"', 'div class="text"', "div", "section", "")


def region_names() -> set[str]:
    """The words in the names of the listed containers."""
    listed = " ".join((*_MENU, *_HEADER, *_AD, *_SIDE, *_NOTICE, *_FORM, *_COMMENTS, *_FOOTER, *_ARTICLE))
    return {word for names in re.findall(r'(?:class|id|role)="([^"]*)"', listed) for word in re.findall("[a-z]+", names)}


def _sentence(rng: random.Random, low: int, high: int, stop: str = ".") -> str:
    words = ["".join(rng.choice(("ka", "lo", "mi", "ter", "an", "sol", "be", "ri", "du", "ne", "é", "ü")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    return (" ".join(words).capitalize() + stop) if words else ""


def _text(rng: random.Random, sentences: int) -> str:
    return " ".join(_sentence(rng, 3, 18) for _ in range(sentences))


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.parts, self.truth = rng, [], []
        #: How containers are named: as listed, by random letters, or by random letters and tags that say nothing.
        self.style = rng.choice((*("listed",) * 6, "random", "bare"))

    def tag(self, name: str, inner) -> None:
        if name and self.style != "listed" and name.split(" ")[0] not in ("ul", "ol", "li", "table", "tr", "form"):
            tag = name.split(" ")[0] if self.style == "random" else "div"
            name = tag + self.rng.choice(("", f' class="q{self.rng.randrange(10**6):x}z"', f' id="x{self.rng.randrange(10**6):x}"'))
        if name:
            self.parts.append(f"<{name}>")
        inner()
        if name:
            self.parts.append(f"</{name.split(' ')[0]}>")

    def leaf(self, name: str, text: str, main: bool, linked: bool = False) -> None:
        shown = html.escape(text, quote=False)
        self.parts.append(f"<{name}>" + (f'<a href="/x">{shown}</a>' if linked else shown) + f"</{name.split(' ')[0]}>")
        self.truth.append((text, main))

    def menu(self) -> None:
        for _ in range(self.rng.randint(2, 7)):
            self.leaf("li", _sentence(self.rng, 1, 2, ""), False, linked=True)

    def lines(self, low: int, high: int, names=("p", "div", "span")) -> None:
        for _ in range(self.rng.randint(1, 2)):
            name = self.rng.choice(names)
            self.leaf("div" if name == "span" else name, _sentence(self.rng, low, high, self.rng.choice((".", "", "!"))), False, linked=self.rng.random() < 0.2)

    def side(self) -> None:
        self.leaf("h3", _sentence(self.rng, 1, 3, ""), False)
        self.lines(3, 15)
        self.menu()

    def form(self) -> None:
        for name in ("label", "p", "button"):
            self.leaf(name, _sentence(self.rng, 1, 6, ""), False)

    def comments(self) -> None:
        self.leaf("h3", _sentence(self.rng, 1, 3, ""), False)
        for _ in range(self.rng.randint(1, 5)):
            self.tag(self.rng.choice(('div class="comment"', "li", 'article class="comment"')), lambda: (self.leaf("div", _sentence(self.rng, 1, 3, ""), False), self.leaf("p", _text(self.rng, self.rng.randint(1, 3)), False)))

    def article(self) -> None:
        rng = self.rng
        if rng.random() < 0.8:
            self.leaf("h1", _sentence(rng, 3, 10, ""), True)
        for _ in range(rng.choice((0, 1, 1, 2, 4, 8, 14))):
            kind = rng.random()
            if kind < 0.72:
                self.leaf("p", _text(rng, rng.choice((1, 1, 2, 4, 8))), True)
            elif kind < 0.79:
                self.leaf("h2", _sentence(rng, 1, 7, ""), True)
            elif kind < 0.83:
                self.leaf("blockquote", _text(rng, 2), True)
            elif kind < 0.87:
                self.tag("ul", lambda: [self.leaf("li", _sentence(rng, 3, 12, ""), True) for _ in range(3)])
            elif kind < 0.9:
                self.tag("table", lambda: self.tag("tr", lambda: [self.leaf("td", _sentence(rng, 1, 4, ""), True) for _ in range(3)]))
            elif kind < 0.92:
                self.leaf("pre", _sentence(rng, 3, 15, ""), True)
            elif kind < 0.95:
                self.tag(rng.choice(_AD), lambda: self.lines(3, 15))
            elif kind < 0.98:
                self.tag(rng.choice(_SIDE + _NOTICE), lambda: self.lines(3, 15))
            else:
                self.tag(rng.choice(_FORM), self.form)


def labelled_page(seed: int) -> tuple[str, list[tuple[str, bool]]]:
    """One page: html, and its blocks in order with whether each is main text."""
    rng = random.Random(seed)
    page = _Page(rng)
    if rng.random() < 0.04:  # plain text
        text = _text(rng, rng.randint(1, 12))
        return html.escape(text, quote=False), [(text, True)]
    region = {"menu": (_MENU, page.menu), "header": (_HEADER, lambda: page.lines(1, 6, ("h1", "p", "div"))), "ad": (_AD, lambda: page.lines(1, 25)), "side": (_SIDE, page.side)}
    region |= {"notice": (_NOTICE, lambda: page.lines(4, 25)), "form": (_FORM, page.form), "comments": (_COMMENTS, page.comments), "footer": (_FOOTER, lambda: page.lines(2, 25))}

    def some(*names: str, share: float = 0.5) -> None:
        for name in names:
            if rng.random() < share:
                page.tag(rng.choice(region[name][0]), region[name][1])

    def body() -> None:
        if rng.random() < 0.1:  # nothing but the article, or what there is of a page that is cut off
            page.tag(rng.choice(_ARTICLE[:-1]), page.article)
            return
        some("notice", share=0.3)
        some("header", "menu", share=0.7)
        some("ad", "form", "side", share=0.35)
        page.tag(rng.choice(_ARTICLE), page.article)
        some("ad", "side", "notice", share=0.35)
        some("comments", "form", share=0.35)
        some("menu", share=0.2)
        some("footer", share=0.85)

    page.parts.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
    page.tag(rng.choice(("", "", 'div class="wrapper"', 'div id="page"', 'div class="container"')), body)
    page.parts.append("</body></html>")
    return "".join(page.parts), page.truth


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, list[tuple[str, bool]]]]:
    return [labelled_page(seed * 1_000_003 + i) for i in range(n)]
