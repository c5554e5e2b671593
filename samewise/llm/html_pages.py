"""Labelled pages for the extraction model, drawn from a few page grammars.

Each block carries data-gold: 1 for the article's text, 0 for what stands around
it.  The pages are invented; their number and seed are parameters.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren tu sha vel dor pin gat us er an th ing or be".split()
# Phrases that stand around articles.
NOTICES = ("We use cookies to improve your visit.", "Subscribe to our newsletter.", "Sign up for free today.", "Please accept our privacy policy.", "This site uses cookies. Accept all?", "Log in to continue.")
FOOTERS = ("&copy; 2024 All rights reserved.", "Copyright &copy; example.com &middot; Privacy &middot; Terms", "Contact us | Imprint | Terms of use")
CONTENT_NAMES = ("content", "post-body", "entry-content", "article-body", "story", "main-content", "article__text")
BOILER_NAMES = {
    "nav": ("nav", "menu", "main-menu", "breadcrumbs", "pagination", "site-nav", "toolbar"),
    "header": ("header", "site-header", "masthead", "topbar", "logo"),
    "footer": ("footer", "site-footer", "bottom", "legal", "copyright"),
    "side": ("sidebar", "related", "widget", "recommended", "popular-posts", "more-stories", "trending", "right-rail"),
    "notice": ("cookie-banner", "notice", "newsletter", "alert", "popup", "modal", "consent", "subscribe-box", "paywall"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot"),
    "comment": ("comments", "comment-list", "replies", "discussion", "reader-comments", "respond"),
    "share": ("share", "social", "share-buttons", "tags"),
}


class Grammar:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 3)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize() + self.r.choice("....,!?")

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5, 8))))

    def links(self, tag: str = "li") -> str:
        n = self.r.randint(1, 8)
        return "".join(f'<{tag} data-gold="0"><a href="#">{" ".join(self.word() for _ in range(self.r.randint(1, 4)))}</a></{tag}>' for _ in range(n))

    def name(self, kind: str) -> str:
        if self.r.random() < 0.15:
            return ""
        return f' {self.r.choice(("class", "id", "class"))}="{self.r.choice(BOILER_NAMES[kind])}"'

    def boiler(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            inner = f'<ul data-gold="0">{self.links()}</ul>'
            return f'<nav data-gold="0">{inner}</nav>' if r.random() < 0.6 else f'<div data-gold="0" class="{r.choice(BOILER_NAMES["nav"])}">{inner}</div>'
        if kind == "header":
            return f'<header data-gold="0"{self.name(kind)}>{r.choice((f"<h1 data-gold=0>{self.word()} {self.word()}</h1>", f"<div data-gold=0>{self.word()}</div>", f"<p data-gold=0>{self.sentence(2, 6)}</p>"))}{self.boiler("nav") if r.random() < 0.4 else ""}</header>'
        if kind == "footer":
            text = r.choice((*FOOTERS, f"&copy; {self.word()} &middot; {self.sentence()}"))
            return f'<footer data-gold="0"{self.name(kind)}>{text if r.random() < 0.5 else f"<p data-gold=0>{text}</p>"}</footer>'
        if kind == "form":
            return f'<form data-gold="0"><p data-gold="0">{self.sentence(2, 5)}</p><label data-gold="0">{self.word()}</label><input><button data-gold="0">{self.word()}</button></form>'
        if kind == "comment":
            one = lambda: f'<{(t := r.choice(("div", "li", "article", "p")))} data-gold="0"{r.choice(("", " class=comment", " class=reply"))}>{r.choice((self.prose(), f"<p data-gold=0>{self.prose()}</p>"))}</{t}>'
            return f'<{(t := r.choice(("section", "div", "div", "ul")))} data-gold="0" {r.choice(("class", "id"))}="{r.choice(BOILER_NAMES[kind])}"><h3 data-gold="0">{self.word()}</h3>{"".join(one() for _ in range(r.randint(1, 5)))}</{t}>'
        tag = "aside" if kind == "side" and r.random() < 0.5 else r.choice(("div", "div", "section", "p"))
        if kind == "notice":
            inner = r.choice(NOTICES)
        elif kind == "side":
            inner = r.choice((f"<h3 data-gold=0>{self.word()}</h3><ul data-gold=0>{self.links()}</ul>", f"<p data-gold=0>{self.prose()}</p>", self.links("p")))
        else:
            inner = r.choice((self.sentence(), self.prose(), f"<p data-gold=0>{self.sentence()}</p>", f"<a href=#>{self.sentence(2, 6)}</a>"))
        named = f' {r.choice(("class", "id", "class", "role" if kind == "notice" else "class"))}="{r.choice(BOILER_NAMES[kind])}"'
        return f'<{tag} data-gold="0"{named}>{inner}</{tag}>'

    def block(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.62:
            text = self.prose()
            if r.random() < 0.2:
                text += f" <a href=#>{self.word()}</a> {self.sentence(2, 5)}"
            return f'<p data-gold="1">{text}</p>'
        if kind < 0.7:
            return f'<p data-gold="1"><b>{self.prose()}<br>'
        if kind < 0.78:
            return f'<h2 data-gold="1">{" ".join(self.word() for _ in range(r.randint(1, 6)))}</h2>'
        if kind < 0.85:
            return f'<ul data-gold="1">{"".join(f"<li data-gold=1>{self.sentence(2, 12)}</li>" for _ in range(r.randint(2, 5)))}</ul>'
        if kind < 0.9:
            return f'<blockquote data-gold="1"><p data-gold="1">{self.prose()}</p></blockquote>'
        if kind < 0.94:
            return f'<table data-gold="1"><tr data-gold="1"><td data-gold="1">{self.word()}</td><td data-gold="1">{self.sentence(1, 4)}</td></tr></table>'
        if kind < 0.97:
            return f'<div data-gold="1">{self.prose()}</div>'
        return self.boiler(r.choice(("ad", "share", "side", "notice")))

    def page(self) -> str:
        r = self.r
        title = " ".join(self.word() for _ in range(r.randint(2, 9)))
        head = r.choice((f"<h1 data-gold=1>{title}</h1>", f"<h1 data-gold=1>{title}</h1>", f"<header data-gold=1><h1 data-gold=1>{title}</h1></header>", ""))
        body = head + "".join(self.block() for _ in range(r.choice((1, 2, 3, 5, 8, 12))))
        shape = r.random()
        if shape < 0.5:
            main = f'<article data-gold="1">{body}</article>'
        elif shape < 0.65:
            main = f'<main data-gold="1">{body}</main>'
        elif shape < 0.75:
            main = f'<main data-gold="1"><article data-gold="1">{body}</article></main>'
        else:
            main = f'<div data-gold="1" {r.choice(("class", "id"))}="{r.choice(CONTENT_NAMES)}">{body}</div>'
        before = [self.boiler(k) for k in ("header", "nav", "notice", "ad", "side") if r.random() < 0.5]
        after = [self.boiler(k) for k in ("share", "comment", "side", "ad", "form", "notice", "footer") if r.random() < 0.5]
        inside = "".join([*before, main, *after])
        if r.random() < 0.3:
            inside = f'<div data-gold="1" class="{r.choice(("wrapper", "page", "container", "layout"))}">{inside}</div>'
        return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style></head><body data-gold="1">{inside}</body></html>'


def labelled_pages(n: int, seed: int = 2) -> list[str]:
    grammar = Grammar(seed)
    return [grammar.page() for _ in range(n)]
