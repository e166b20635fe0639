"""Labelled page layouts from a seeded rule: the training set of the main-text
classifier. The given pages carry no labels, so node labels come from layouts
whose parts are known: article parts are content, everything round them is
not. Words are random letters; only structure, lengths, links and attribute
tokens can be learnt."""

from __future__ import annotations

import random

#: Attribute names a page uses for each part.
TOKENS = {
    "main": ["content", "main", "article", "post", "entry-content", "story", "article-body", "post-content", "text", "page-content"],
    "nav": ["nav", "menu", "navbar", "breadcrumb", "topnav", "navigation", "tabs", "pagination", "toc-menu"],
    "header": ["header", "masthead", "site-header", "banner", "logo", "top"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom", "imprint"],
    "side": ["sidebar", "aside", "widget", "related", "rail", "popular", "recommended", "tags", "trending"],
    "notice": ["cookie", "notice", "consent", "alert", "modal", "popup", "gdpr", "newsletter", "overlay"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner-ad", "advertisement"],
    "form": ["form", "search", "login", "subscribe", "signup", "contact-form"],
    "comments": ["comments", "comment", "replies", "discussion", "responses", "comment-list", "respond"],
    "share": ["share", "social", "sharing", "buttons", "tools"],
}
WRAPPERS = ["wrapper", "container", "page", "layout", "row", "col", "outer", "inner", "site", "root"]


class Layout:
    """Writes one page; nodes carry ``data-y`` 1 (content) or 0."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("abcdefghijklmnoprstuvwzéäñ") for _ in range(self.r.randint(1, 9)))

    def words(self, lo: int, hi: int) -> str:
        out = [self.word() for _ in range(self.r.randint(lo, hi))]
        for i in range(6, len(out), self.r.randint(5, 9)):
            out[i] += self.r.choice([",", ",", "."])
        return " ".join(out).capitalize()

    def sentence(self, lo: int = 2, hi: int = 60) -> str:
        return self.words(lo, hi) + "."

    def attr(self, kind: str) -> str:
        if self.r.random() < 0.25:
            return ""
        name = self.r.choice(TOKENS[kind] if kind in TOKENS else WRAPPERS)
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def node(self, tag: str, y: int, inner: str, attr: str = "") -> str:
        return f'<{tag}{attr} data-y="{y}">{inner}</{tag}>'

    def links(self, n: int, y: int = 0) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(n)]
        if self.r.random() < 0.7:
            return self.node("ul", y, "".join(self.node("li", y, x) for x in items))
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def paragraph(self, y: int) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.08:
            return f'<p data-y="{y}"><b>{self.sentence(1, 14)}<br>'  # left open
        text = self.sentence(1, 12) if kind < 0.3 else " ".join(self.sentence(4, 30) for _ in range(r.randint(1, 12)))
        if r.random() < 0.2:
            text += f' <a href="/{self.word()}">{self.words(1, 3)}</a> ' + self.words(2, 9) + "."
        if r.random() < 0.15:
            text = f"<em>{self.words(1, 3)}</em> " + text
        return self.node("div" if r.random() < 0.05 else "p", y, text)

    def body_parts(self, y: int) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(self.node(r.choice(["h1", "h1", "h2"]), y, self.words(2, 10)))
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            out.append(self.paragraph(y))
            k = r.random()
            if k < 0.08:
                out.append(self.node(r.choice(["h2", "h3"]), y, self.words(1, 8)))
            elif k < 0.13:
                out.append(self.node(r.choice(["ul", "ol"]), y, "".join(self.node("li", y, self.sentence(2, 18)) for _ in range(r.randint(2, 6)))))
            elif k < 0.16:
                out.append(self.node("blockquote", y, self.paragraph(y)))
            elif k < 0.18:
                out.append(self.node("pre", y, self.words(4, 20)))
            elif k < 0.20:
                cells = lambda: "".join(self.node("td", y, self.words(1, 5)) for _ in range(3))
                out.append(self.node("table", y, "".join(self.node("tr", y, cells()) for _ in range(r.randint(2, 4)))))
            elif k < 0.25:
                out.append(self.boiler(r.choice(["ad", "share", "side", "notice", "form"])))
        return "".join(out)

    def boiler(self, kind: str) -> str:
        r = self.r
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        if r.random() < 0.45:
            tag = r.choice(["div", "section", "ul" if kind in ("nav", "share") else "div"])
        if tag == "ul":
            return self.node("ul", 0, "".join(self.node("li", 0, f'<a href="/{self.word()}">{self.words(1, 3)}</a>') for _ in range(r.randint(2, 9))), self.attr(kind))
        if kind in ("nav", "share"):
            inner = self.links(r.randint(2, 12))
        elif kind == "header":
            inner = self.node("div", 0, self.words(1, 4), self.attr("header")) + (self.links(r.randint(2, 7)) if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = f"&copy; {self.words(1, 5)} &middot; {self.sentence(3, 14)}" + (self.links(r.randint(1, 6)) if r.random() < 0.5 else "")
        elif kind == "side":
            inner = self.node("h3", 0, self.words(1, 4)) + self.links(r.randint(2, 8)) + (self.node("p", 0, self.sentence(3, 20)) if r.random() < 0.4 else "")
        elif kind in ("ad", "notice"):
            inner = self.sentence(2, 14) + ("" if r.random() < 0.5 else self.node("p", 0, self.sentence(3, 20))) + ("<button>OK</button>" if r.random() < 0.3 else "")
        elif kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input type=text><button>{self.words(1, 2)}</button>" + (self.node("p", 0, self.sentence(3, 12)) if r.random() < 0.4 else "")
        else:  # comments
            one = lambda: self.node("div", 0, self.node("span", 0, self.words(1, 2)) + self.node("p", 0, " ".join(self.sentence(3, 16) for _ in range(r.randint(1, 3)))), self.attr("comments"))
            inner = self.node("h3", 0, self.words(1, 2)) + "".join(one() for _ in range(r.randint(1, 6)))
        if kind in ("ad", "notice", "comments") and tag in ("div", "section"):
            attr = f' {r.choice(["class", "id"])}="{r.choice(TOKENS[kind])}"'  # else nothing tells them from text
        else:
            attr = self.attr(kind)
        return self.node(tag, 0, inner, attr)

    def page(self) -> str:
        r = self.r
        main = self.node(r.choice(["article", "article", "main", "div", "section"]), 1, self.body_parts(1), self.attr("main"))
        for _ in range(r.choice([0, 0, 1, 2])):
            main = self.node(r.choice(["div", "main", "section"]), 1, main, self.attr("wrap") if r.random() < 0.6 else self.attr("main"))
        before = [self.boiler(k) for k in ("notice", "header", "nav", "ad", "form", "side") if r.random() < {"nav": 0.8, "header": 0.5}.get(k, 0.3)]
        after = [self.boiler(k) for k in ("share", "comments", "side", "ad", "notice", "form", "footer") if r.random() < {"footer": 0.85, "comments": 0.4}.get(k, 0.25)]
        inner = "".join(before) + main + "".join(after)
        if r.random() < 0.3:
            inner = self.node("div", 1, inner, self.attr("wrap"))
        return f"<html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body data-y=\"1\">{inner}</body></html>"


def pages(n: int, seed: int = 1) -> list[str]:
    return [Layout(seed * 1_000_003 + i).page() for i in range(n)]
