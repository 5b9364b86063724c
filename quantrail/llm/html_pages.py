"""Generated web pages whose blocks are known to be main text or not: what the block labeller is trained on.

Pages vary in containers, class names, nesting, markup errors and in the parts around the article, so that the labeller learns
from tag paths, shape and context rather than from one template. Words are invented, except for a few of the kind that
stand in menus, notices, forms and footers.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Class or id words that sites use for each part of a page.
CLASSES = {
    "main": "content post entry entry-content article article-body story story-body post-content main-content text body-text page-content prose markdown rich-text".split(),
    "nav": "nav menu navbar navigation main-menu topnav breadcrumbs breadcrumb pager pagination toc tabs links site-nav".split(),
    "header": "header masthead top site-header banner branding logo topbar page-header".split(),
    "footer": "footer site-footer bottom colophon copyright legal foot page-footer".split(),
    "side": "sidebar aside side widget related recommended popular trending recent-posts rail secondary tags archive".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert newsletter subscribe popup modal overlay message paywall warning".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adbox ad-slot teaser".split(),
    "form": "form search search-form login signup contact-form subscribe-form newsletter-form".split(),
    "comments": "comments comment comment-list comment-body responses discussion replies reader-comments disqus thread".split(),
    "noise": "wrapper container row col inner clearfix block section box grid flex group layer page wrap u-mt x1 c7".split(),
}
#: Phrases of the parts around an article.
PHRASES = {
    "nav": "Home|About|Contact|News|Sports|Blog|Archive|Products|Next|Previous|Help|Login|Start|Inicio|Accueil|Kontakt|Mehr|Menu".split("|"),
    "header": "Welcome|Sign in|Register|Search|Follow us|The daily|Your trusted source|Skip to content".split("|"),
    "footer": "Copyright 2024|All rights reserved|Privacy policy|Terms of use|Imprint|Powered by|Contact us|Sitemap|© 2023".split("|"),
    "side": "Related|Most read|Popular posts|Tags|Categories|Recent|You may also like|Archives".split("|"),
    "notice": "We use cookies to improve your experience.|Accept all|Subscribe to our newsletter.|This site uses cookies.|Please enable JavaScript.|Manage consent|Log in to continue.".split("|"),
    "ad": "Advertisement|Sponsored|Buy now|Special offer|Limited time|Save 50%|Ad|Anzeige|Publicidad".split("|"),
    "form": "Name|Email|Password|Message|Send|Submit|Search|Your email|Remember me|Comment".split("|"),
    "comments": "Reply|Report|2 hours ago|yesterday|Great article!|Thanks for sharing.|I disagree.|Like|Comments|Leave a comment".split("|"),
}
TAGS = {"nav": ("nav", "div", "ul", "div"), "header": ("header", "div", "header"), "footer": ("footer", "div", "footer"), "side": ("aside", "div", "section"), "notice": ("div", "section", "aside", "div"), "ad": ("div", "aside", "section", "div"), "form": ("form",), "comments": ("section", "div", "ol", "div")}


class Page:
    """Writes one page and remembers which block texts are main."""

    def __init__(self, seed: int):
        r = self.r = random.Random(seed)
        letters = r.choice(["etaoinshrdlu", "enisratdhulcäöüß", "esaitnrulodéèêç", "eaosrnidlcñóí"])
        self.words = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(150)]
        self.label: dict[str, int] = {}

    def sentence(self, least: int = 4, most: int = 22) -> str:
        r = self.r
        return " ".join(r.choice(self.words) for _ in range(r.randint(least, most))).capitalize() + r.choice("...!?")

    def prose(self) -> str:
        r = self.r
        if r.random() < 0.15:  # a paragraph can be one short sentence
            return self.sentence(1, 3)
        return " ".join(self.sentence(1, 22) for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9])))

    def block(self, tag: str, text: str, main: int, attr: str = "", link: bool = False) -> str:
        r = self.r
        if main and r.random() < 0.05:
            text += " " + r.choice(["###", "%%%", "&&&", "***"]) * r.randint(1, 3)
        self.label[" ".join(text.split())] = main
        shown = text.replace("&", "&amp;").replace("<", "&lt;")
        if link:
            shown = f'<a href="/{r.choice(self.words)}">{shown}</a>'
        elif r.random() < 0.1:
            shown = f"<b>{shown}</b>" if r.random() < 0.5 else f"<b>{shown}<br>"
        end = "" if tag in ("p", "li") and r.random() < 0.12 else f"</{tag}>"
        return f"<{tag}{attr}>{shown}{end}"

    def attr(self, part: str, sure: float = 0.8) -> str:
        r = self.r
        names = ([r.choice(CLASSES[part])] if r.random() < sure else []) + ([r.choice(CLASSES["noise"])] if r.random() < 0.3 else [])
        return f' {r.choice(["class", "class", "id"])}="{" ".join(names)}"' if names else ""

    def phrase(self, part: str) -> str:
        r = self.r
        words = r.choice(PHRASES[part]) if r.random() < 0.5 else " ".join(r.choice(self.words) for _ in range(r.randint(1, 4))).capitalize()
        return words

    def part(self, kind: str) -> str:
        """A part of the page that is no main text."""
        r = self.r
        tag = r.choice(TAGS[kind])
        inner: list[str] = []
        if kind == "nav":
            inner = [self.block("li", self.phrase(kind), 0, link=r.random() < 0.9) for _ in range(r.randint(2, 9))]
            inner = inner if tag == "ul" else ["<ul>", *inner, "</ul>"] if r.random() < 0.7 else [f'<a href="/">{self.phrase(kind)}</a> ' for _ in inner]
        elif kind == "comments":
            inner = [self.block("h3", "Comments" if r.random() < 0.6 else self.phrase(kind), 0)] if r.random() < 0.6 else []
            for _ in range(r.randint(1, 5)):
                body = self.block("p", self.prose() if r.random() < 0.8 else self.phrase(kind), 0)
                who = self.block(r.choice(["div", "cite", "span"]), self.phrase(kind), 0)
                inner.append(f"<{'li' if tag == 'ol' else 'div'}{self.attr(kind)}>{who}{body}</{'li' if tag == 'ol' else 'div'}>")
        elif kind == "form":
            inner = [f'<label>{self.phrase(kind)}</label><input name="x">' for _ in range(r.randint(1, 4))] + [self.block("button", self.phrase(kind), 0)]
        elif kind == "side":
            inner = [self.block(r.choice(["h3", "h4", "div"]), self.phrase(kind), 0)]
            inner += ["<ul>", *[self.block("li", self.phrase(kind) if r.random() < 0.5 else self.sentence(3, 9), 0, link=r.random() < 0.8) for _ in range(r.randint(2, 6))], "</ul>"] if r.random() < 0.7 else [self.block("p", self.sentence(), 0)]
        else:
            plain = r.random() < 0.4
            for _ in range(1 if plain else r.randint(1, 3)):
                text = self.phrase(kind) if r.random() < 0.5 else " ".join(self.sentence(2, 12) for _ in range(r.choice([1, 1, 2, 3])))
                inner.append(self.text_only(text, kind) if plain else self.block(r.choice(["p", "div", "p", "h2" if kind == "header" else "p"]), text, 0, link=r.random() < 0.2))
        sure = 0.55 if tag in ("nav", "header", "footer", "aside", "form") else 1.0
        return f"<{tag}{self.attr(kind, sure)}>{''.join(inner)}{'' if r.random() < 0.02 else f'</{tag}>'}"

    def text_only(self, text: str, kind: str) -> str:
        text = f"© {text} · {self.sentence(2, 8)}" if kind == "footer" and self.r.random() < 0.5 else text
        self.label[" ".join(text.split())] = 0
        return text.replace("&", "&amp;")

    def article(self) -> str:
        r = self.r
        title = self.block("h1", self.sentence(3, 9).rstrip(".!?"), 1)
        if r.random() < 0.15:
            title = f"<header>{title}</header>"
        out = [title] if r.random() < 0.9 else []
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 7, 10, 16])):
            kind = r.random()
            if kind < 0.75:
                out.append(self.block("p" if r.random() < 0.9 else "div", self.prose(), 1))
            elif kind < 0.82:
                out.append(self.block(r.choice(["h2", "h3"]), self.sentence(2, 7), 1))
            elif kind < 0.88:
                out.append("<ul>" + "".join(self.block("li", self.sentence(), 1) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{self.block('p', self.prose(), 1)}</blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join("<tr>" + "".join(self.block("td", self.sentence(1, 4), 1) for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.97:
                out.append(self.block("pre", self.sentence(), 1))
            else:
                out.append(self.part(r.choice(["ad", "side", "notice", "form"])))
        if len(out) <= 1:
            out.append(self.block("p", self.prose(), 1))
        if r.random() < 0.1:
            out.append(self.part(r.choice(["footer", "nav", "ad"])))
        style = r.random()
        body = "".join(out)
        if style < 0.5:
            body = f"<article{self.attr('main', 0.4)}>{body}</article>"
        elif style < 0.7:
            body = f"<main{self.attr('main', 0.4)}>{body}</main>"
        elif style < 0.95:
            body = f"<div{self.attr('main', 0.9)}>{body}</div>"
        if r.random() < 0.3:
            body = f"<{r.choice(['div', 'section', 'main'])}{self.attr('noise')}>{body}</{r.choice(['div', 'section'])}>"
        return body

    def write(self) -> str:
        r = self.r
        some = lambda kinds: "".join(self.part(k) for k in kinds if r.random() < 0.45)
        head = some(["notice", "header", "nav", "ad", "form", "nav"])
        tail = some(["comments", "side", "ad", "form", "notice", "nav", "footer"])
        article = self.article()
        body = head + article + tail
        if r.random() < 0.3:
            body = f"<div{self.attr('noise')}>{body}</div>"
        script = f"<script>var t=\"<p>{self.sentence()}</p>\";</script>" if r.random() < 0.5 else ""
        comment = f"<!-- {self.phrase('ad')} <p>x</p> -->" if r.random() < 0.5 else ""
        end = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html><head><title>{self.sentence(2, 6)}</title><style>p{{margin:0}}</style>{script}</head><body>{comment}{body}{end}"


def training_pages(count: int, seed: int = 1) -> Iterator[tuple[str, dict[str, int]]]:
    """Pages, and for each the label of its blocks by text."""
    for i in range(count):
        page = Page(seed * 1_000_003 + i)
        yield page.write(), page.label
