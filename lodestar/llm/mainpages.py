"""Labelled pages to train the main-text model on.

A page is put together from parts in random order and random mark-up: page header, menu, adverts, notices, sidebar,
form, the article, reader comments and footer. Each text block is known to be part of the article or not. Words are
invented, so the model can only learn structure, tag and class names, and shapes of text.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo yu za thon ing er en ün éa ñor".split()

# Usual class and id words of page parts.
HEADER = "header masthead site-header top page-header branding banner logo topbar".split()
MENU = "menu nav navbar navigation breadcrumb breadcrumbs toc links tabs pagination pager skip site-nav main-menu".split()
ADVERT = "ad ads advert advertisement adbox ad-slot sponsor sponsored promo promotion commercial banner-ad adsense partner".split()
NOTICE = "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe paywall privacy warning message disclaimer announcement cookie-banner signup".split()
SIDEBAR = "sidebar side aside related widget recommended trending popular secondary rail more-stories see-also tags archive".split()
SHARE = "share social sharing follow toolbar meta byline tools actions print".split()
COMMENTS = "comments comment replies reply responses discussion disqus reader-comments comment-list commentlist feedback thread respond user-comments".split()
FOOTER = "footer site-footer copyright legal bottom colophon contentinfo page-footer imprint".split()
ARTICLE = "content article post entry story article-body post-content entry-content main main-content body-text text story-body page-content".split()
FORM = "form search login contact signup-form searchbox survey".split()
NEUTRAL = "wrapper container row col inner box block section group layout page clearfix".split()


class Page:
    """Builds one page; ``labels`` has (text, 1 or 0) of every block in page order."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.plain = self.r.random() < 0.15  # hardly any class names
        self.out: list[str] = []

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        words = ["".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 3))) for _ in range(n)]
        return " ".join(words)

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 16).capitalize() + self.r.choice("...!?") for _ in range(self.r.randint(low, high)))

    def attributes(self, names: list[str]) -> str:
        found = []
        if names and (not self.plain or self.r.random() < 0.2):
            name = self.r.choice(names)
            if self.r.random() < 0.3:
                name += self.r.choice([" ", "-", "_", "__"]) + self.r.choice(NEUTRAL)
            found.append(f'{self.r.choice(["class", "class", "id"])}="{name}"')
        return "".join(" " + f for f in found)

    def block(self, label: int, tag: str, text: str, names: list[str] | None = None, link: bool = False) -> str:
        """One text block, marked for the label reader by the attribute data-label."""
        inner = f'<a href="/x">{text}</a>' if link else text
        if not link and self.r.random() < 0.15:
            first, _, rest = inner.partition(" ")
            inner = f'{first} <{(t := self.r.choice(["b", "i", "a", "em", "span"]))}>{rest}</{t}>' if rest else inner
        end = "" if tag in ("p", "li") and self.r.random() < 0.1 else f"</{tag}>"
        return f'<{tag}{self.attributes(names or [])} data-label="{label}">{inner}{end}'

    def wrap(self, tags: list[str], names: list[str], inner: str, role: str = "") -> str:
        tag = self.r.choice(tags)
        if tag == "div" and not names and self.r.random() < 0.5:
            return inner
        return f"<{tag}{self.attributes(names)}{f' role={chr(34)}{role}{chr(34)}' if role and self.r.random() < 0.3 else ''}>{inner}</{tag}>"

    def links(self, names: list[str], label: int = 0) -> str:
        items = "".join(self.block(label, "li", self.words(1, 3), link=True) for _ in range(self.r.randint(3, 8)))
        return f"<ul{self.attributes(names if self.r.random() < 0.4 else [])}>{items}</ul>"

    def menu(self) -> str:
        return self.wrap(["nav", "nav", "div"], MENU, self.links(MENU), "navigation")

    def header(self) -> str:
        parts = [self.block(0, self.r.choice(["div", "p", "h1", "h2", "span"]), self.words(1, 4))]
        if self.r.random() < 0.5:
            parts.append(self.block(0, "p", self.sentences(1, 2)))
        if self.r.random() < 0.5:
            parts.append(self.menu())
        return self.wrap(["header", "header", "div"], HEADER, "".join(parts), "banner")

    def advert(self) -> str:
        body = self.sentences(1, 3) if self.r.random() < 0.8 else self.words(1, 5)
        inner = self.block(0, self.r.choice(["p", "div", "span"]), body) if self.r.random() < 0.5 else body
        if inner is body:
            return f'<{(t := self.r.choice(["div", "div", "aside", "section", "p"]))} class="{self.r.choice(ADVERT)}" data-label="0">{body}</{t}>'
        return f'<div class="{self.r.choice(ADVERT)}">{inner}</div>'

    def notice(self) -> str:
        inner = self.block(0, self.r.choice(["p", "div"]), self.sentences(1, 3)) + (self.block(0, "button", self.words(1, 2)) if self.r.random() < 0.5 else "")
        if self.r.random() < 0.4:
            return f'<{(t := self.r.choice(["div", "p", "section", "aside"]))} class="{self.r.choice(NOTICE)}" data-label="0">{self.sentences(1, 3)}</{t}>'
        return f'<{(t := self.r.choice(["div", "section", "aside", "dialog"]))} {self.r.choice(["class", "id"])}="{self.r.choice(NOTICE)}">{inner}</{t}>'

    def sidebar(self) -> str:
        parts = [self.block(0, self.r.choice(["h2", "h3", "h4"]), self.words(1, 3)), self.links(SIDEBAR)]
        parts += [self.block(0, "p", self.sentences(1, 4)) for _ in range(self.r.randint(0, 3))]
        return self.wrap(["aside", "aside", "div"], SIDEBAR, "".join(parts), "complementary")

    def form(self) -> str:
        inner = "".join(self.block(0, self.r.choice(["label", "p", "div", "legend"]), self.words(1, 6)) + '<input name="q">' for _ in range(self.r.randint(1, 4)))
        if self.r.random() < 0.4:
            inner += self.block(0, "p", self.sentences(1, 2))
        if self.r.random() < 0.3:
            inner += "<select>" + "".join(self.block(0, "option", self.words(1, 2)) for _ in range(3)) + "</select>"
        return f"<form{self.attributes(FORM)}>{inner}{self.block(0, 'button', self.words(1, 2))}</form>"

    def comments(self) -> str:
        items = ""
        for _ in range(self.r.randint(1, 6)):
            inner = self.block(0, self.r.choice(["p", "div"]), self.sentences(1, 6))
            if self.r.random() < 0.5:
                inner = self.block(0, self.r.choice(["cite", "h4", "div", "span"]), self.words(1, 3)) + inner
            items += self.wrap(["li", "div", "article"], COMMENTS, inner) if self.r.random() < 0.7 else inner
        title = self.block(0, self.r.choice(["h2", "h3"]), self.words(1, 3)) if self.r.random() < 0.7 else ""
        tag = self.r.choice(["section", "div", "div", "ol", "aside"])
        return f'<{tag} {self.r.choice(["class", "id"])}="{self.r.choice(COMMENTS)}">{title}{items}</{tag}>'

    def footer(self) -> str:
        text = self.r.choice(["&copy; ", "Copyright ", ""]) + self.words(1, 4) + self.r.choice([" &middot; ", ". ", " | "]) + self.sentences(1, 2)
        inner = self.block(0, self.r.choice(["p", "div", "span", "small"]), text) if self.r.random() < 0.6 else None
        if inner is None:
            return f'<footer data-label="0">{text}</footer>'
        return self.wrap(["footer", "footer", "div"], FOOTER, inner + (self.links(FOOTER) if self.r.random() < 0.4 else ""), "contentinfo")

    def article(self) -> str:
        title = self.block(1, "h1", self.words(2, 12)) if self.r.random() < 0.85 else ""
        if title and self.r.random() < 0.15:
            title = f"<header>{title}</header>"
        parts = [title]
        for _ in range(self.r.randint(1, 12)):
            x = self.r.random()
            if x < 0.72:
                parts.append(self.block(1, self.r.choice(["p", "p", "p", "p", "div"]), self.sentences(1, 9) if self.r.random() < 0.9 else self.words(1, 4)))
            elif x < 0.78:
                parts.append(self.block(1, self.r.choice(["h2", "h3"]), self.words(1, 8)))
            elif x < 0.82:
                parts.append("<ul>" + "".join(self.block(1, "li", self.words(2, 14)) for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif x < 0.85:
                parts.append("<blockquote>" + self.block(1, "p", self.sentences(1, 3)) + "</blockquote>")
            elif x < 0.87:
                parts.append("<table>" + "".join("<tr>" + "".join(self.block(1, "td", self.words(1, 4)) for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif x < 0.91:
                parts.append(self.advert())
            elif x < 0.94:
                parts.append(self.notice())
            elif x < 0.97:
                parts.append(f'<div class="{self.r.choice(SHARE)}">' + self.block(0, self.r.choice(["span", "div", "p"]), self.words(1, 4), link=self.r.random() < 0.5) + "</div>")
            else:
                parts.append(f'<div class="{self.r.choice(SIDEBAR)}">' + self.links(SIDEBAR) + "</div>")
        if self.r.random() < 0.15:
            parts.append(self.comments())
        inner = "".join(parts)
        if self.plain and self.r.random() < 0.6:
            return inner
        tag = self.r.choice(["article", "article", "article", "main", "div", "section"])
        out = f"<{tag}{self.attributes(ARTICLE) if tag == 'div' or self.r.random() < 0.4 else ''}>{inner}</{tag}>"
        return f"<main>{out}</main>" if self.r.random() < 0.2 and tag != "main" else out

    def html(self) -> str:
        before = [f() for f in (self.header, self.menu, self.advert, self.notice, self.form) if self.r.random() < 0.5]
        after = [f() for f in (self.comments, self.sidebar, self.advert, self.notice, self.form, self.footer) if self.r.random() < 0.5]
        if self.r.random() < 0.2:
            before.append(self.sidebar())
        self.r.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        if self.r.random() < 0.4:
            body = f'<div class="{self.r.choice(NEUTRAL)}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"
