"""Labelled pages for the extractor: pages of many layouts with random text, each block known to be article or not."""

from __future__ import annotations

import random

SYLLABLES = ("an", "er", "on", "th", "re", "ti", "en", "st", "ble", "ing", "ou", "la", "de", "que", "sch", "ung", "ción", "ado", "ê", "au")
# Words that tell what a block is for, as pages use them.
MENU = ("home", "about", "contact", "news", "sports", "shop", "login", "archive", "help", "faq")
FOOT = ("copyright", "all rights reserved", "privacy policy", "terms of use", "imprint", "sitemap")
NOTE = ("we use cookies", "accept all", "subscribe to our newsletter", "sign up", "enable javascript", "your consent")
SAY = ("reply", "says", "posted by", "comments", "log in to comment", "likes")
ADS = ("advertisement", "sponsored", "buy now", "sale", "limited offer")
SIDE = ("related articles", "most read", "popular posts", "tags", "follow us", "share on")


class Page:
    """Collects html and the label of each block's text, in order."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.html: list[str] = []
        self.blocks: list[tuple[str, int]] = []

    def words(self, n: int) -> str:
        r = self.rng
        text = " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(max(1, n)))
        return text[:1].upper() + text[1:] + r.choice((".", ".", "", "?"))

    def block(self, tag: str, text: str, label: int, attrs: str = "", link: bool = False) -> None:
        inner = f'<a href="/{self.rng.randint(1, 99)}">{text}</a>' if link else text
        end = f"</{tag}>" if tag not in ("p", "li", "td") or self.rng.random() < 0.85 else ""
        self.html.append(f"<{tag}{attrs}>{inner}{end}")
        self.blocks.append((text, label))

    def name(self, *names: str) -> str:
        kind = self.rng.random()
        word = self.rng.choice(names)
        return f' class="{word}"' if kind < 0.45 else f' id="{word}"' if kind < 0.75 else f' class="{word} {self.rng.choice(("box", "col", "wrap", "c1"))}"' if kind < 0.9 else ""

    def menu(self) -> None:
        tag = self.rng.choice(("nav", "nav", "nav", "div", "ul", "header"))
        attrs = "" if tag == "nav" and self.rng.random() < 0.6 else self.name("menu", "nav", "navbar", "topnav", "breadcrumb")
        self.html.append(f"<{tag}{attrs}>" + ("<ul>" if tag != "ul" else ""))
        for _ in range(self.rng.randint(2, 8)):
            self.block("li", self.rng.choice(MENU) if self.rng.random() < 0.4 else self.words(self.rng.randint(1, 2)), 0, link=True)
        self.html.append(("</ul>" if tag != "ul" else "") + f"</{tag}>")

    def header(self) -> None:
        tag = self.rng.choice(("header", "header", "div"))
        self.html.append(f"<{tag}{self.name('header', 'masthead', 'site-header', 'banner') if tag == 'div' or self.rng.random() < 0.4 else ''}>")
        self.block(self.rng.choice(("div", "p", "h2", "span", "h1")), self.words(self.rng.randint(1, 6)), 0, link=self.rng.random() < 0.4)
        self.html.append(f"</{tag}>")

    def small(self, kind: str) -> None:
        r = self.rng
        tags = {"ad": ("div", "div", "aside", "ins"), "note": ("div", "div", "section", "dialog"), "side": ("aside", "aside", "div", "section"), "form": ("form",), "say": ("div", "section", "ol", "div"), "foot": ("footer", "footer", "div")}
        names = {
            "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner-ad"), "note": ("cookie", "cookie-notice", "notice", "consent", "alert", "newsletter", "popup"),
            "side": ("sidebar", "related", "widget", "share", "social", "tags"), "form": ("search", "signup", "contact-form"), "say": ("comments", "comment-list", "disqus", "respond", "replies"), "foot": ("footer", "site-footer", "copyright", "legal"),
        }
        cues = {"ad": ADS, "note": NOTE, "side": SIDE, "form": NOTE, "say": SAY, "foot": FOOT}
        tag = r.choice(tags[kind])
        bare = tag in ("aside", "footer", "form") and r.random() < 0.6
        self.html.append(f"<{tag}{'' if bare else self.name(*names[kind])}>")
        for _ in range(r.randint(1, 5) if kind in ("side", "say") else r.randint(1, 2)):
            text = self.words(r.randint(2, 30) if kind in ("say", "ad", "foot") else r.randint(1, 9))
            if r.random() < 0.4:
                text = f"{r.choice(cues[kind]).capitalize()} {text}"
            if kind == "say":
                self.html.append(f'<div{self.name("comment", "comment-body", "reply")}>')
                if r.random() < 0.5:
                    self.block("span" if r.random() < 0.3 else "h4", self.words(2), 0)
            self.block(r.choice(("p", "p", "li", "div", "span")), text, 0, link=kind == "side" and r.random() < 0.7)
            if kind == "say":
                self.html.append("</div>")
        if kind == "form" or (kind in ("note", "say") and r.random() < 0.4):
            self.html.append('<form><input type="text" name="q"><button>Send</button></form>' if kind != "form" else '<input name="q"><label>Mail</label>')
        self.html.append(f"</{tag}>")

    def article(self) -> None:
        r = self.rng
        shells = ((("article", ""),), (("main", ""), ("article", "")), (("main", ""),), (("div", self.name("content", "post", "entry-content", "article-body", "story")),), (("div", ' id="page"'), ("article", ' class="post"')), (("section", self.name("content", "article")),), (("table", ""), ("tr", ""), ("td", "")))
        shell = r.choices(shells, (6, 4, 3, 4, 3, 1, 1))[0]
        self.html.append("".join(f"<{t}{a}>" for t, a in shell))
        if r.random() < 0.85:
            inside = r.random() < 0.15
            self.html.append("<header>" if inside else "")
            self.block("h1", self.words(r.randint(2, 9)), 1)
            self.html.append("</header>" if inside else "")
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.72:
                self.block("p", self.words(r.choice((1, 2, 4, 8, 20, 40, 80))), 1, link=r.random() < 0.04)
            elif kind < 0.82:
                self.block(r.choice(("h2", "h3")), self.words(r.randint(1, 7)), 1)
            elif kind < 0.9:
                self.html.append("<ul>")
                for _ in range(r.randint(1, 4)):
                    self.block("li", self.words(r.randint(1, 15)), 1, link=r.random() < 0.1)
                self.html.append("</ul>")
            elif kind < 0.95:
                self.html.append("<blockquote>")
                self.block("p", self.words(r.randint(3, 20)), 1)
                self.html.append("</blockquote>")
            elif kind < 0.975:
                self.block("pre", self.words(r.randint(2, 12)), 1)
            else:
                self.small(r.choice(("ad", "side")))
        self.html.append("".join(f"</{t}>" for t, _ in reversed(shell)))


def labelled_page(seed: int) -> tuple[str, list[tuple[str, int]]]:
    """(html, [(block text, 1 for article)]) of a page of a random layout."""
    page = Page(seed)
    r = page.rng
    page.html.append("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>" + ("<script>var a='</p>';</script>" if r.random() < 0.5 else ""))
    if r.random() < 0.3:
        page.html.append('<div id="wrapper">')
    for kind, chance in (("header", 0.4), ("menu", 0.85), ("note", 0.3), ("ad", 0.5), ("form", 0.2), ("side", 0.25)):
        if r.random() < chance:
            getattr(page, kind)() if kind in ("header", "menu") else page.small(kind)
    if r.random() < 0.97:
        page.article()
    for kind, chance in (("say", 0.4), ("side", 0.35), ("ad", 0.25), ("form", 0.2), ("menu", 0.2), ("note", 0.15), ("foot", 0.85)):
        if r.random() < chance:
            page.menu() if kind == "menu" else page.small(kind)
    if r.random() < 0.85:
        page.html.append("</body></html>")
    return "".join(page.html), page.blocks
