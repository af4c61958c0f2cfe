"""Labelled pages that the extraction model is trained on.

Elements of the main text carry ``data-main``. Pages are put together from parts by a seeded
generator, so that layouts, nestings and lengths vary; the parts and their labels are written by hand.
"""

from __future__ import annotations

import random

PAGES = 480

_WORDS = (
    "river stone window letter garden market winter summer morning evening road bridge table paper music story doctor "
    "teacher village harbour signal engine measure report method result question answer number pattern history future "
    "light colour water forest mountain island weather season travel journey kitchen dinner bread apple silver copper"
).split()
#: Sentences of articles that use the words of notices.
_MENTIONS = (
    "Bake the cookies for ten minutes.", "The law on privacy was changed.", "Readers subscribe to the paper by post.", "He had no comment on the report.",
    "They share the harbour with the village.", "The copyright of the song ran out.", "Her reply came in winter.", "The advert hung on the bridge.",
)
_LABELS = "Home About News Sport Contact Archive Help Login Search Store Blog Team Jobs Privacy Terms Sitemap Press Media".split()


class _Maker:
    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.random.choice(_WORDS) for _ in range(self.random.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(3, 18).capitalize()
        if self.random.random() < 0.4:
            text = text.replace(" ", ", ", 1)
        style = self.random.random()
        if style < 0.05:
            return text.upper() + "!!"
        if style < 0.1:
            return " ".join(w + self.random.choice(("***", "$$$", "&amp;&amp;", "%%%")) for w in text.split())
        if style < 0.13:
            return " | ".join(text.split())
        return text + self.random.choice((".", ".", ".", "?", "!", ""))

    def text(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.random.randint(low, high)))

    def link(self) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.random.choice((self.random.choice(_LABELS), self.words(1, 3)))}</a>'

    def links(self) -> str:
        return "".join(f"<li>{self.link()}</li>" for _ in range(self.random.randint(2, 8)))

    def paragraph(self) -> str:
        kind = self.random.random()
        body = self.text(1, 6)
        if kind < 0.15:
            return f"<p data-main><b>{body}<br></b></p>"
        if kind < 0.25:
            return f"<p data-main>{self.text(1, 2)} {self.link()} {self.text(1, 2)}</p>"
        if kind < 0.35:
            return f"<p data-main>{self.words(1, 2).capitalize()}.</p>"
        if kind < 0.43:
            return f"<p data-main>{body} {self.random.choice(_MENTIONS)} {self.text(1, 3)} {self.random.choice(_MENTIONS)} {self.text(2, 5)}</p>"
        if kind < 0.48:
            return f"<p data-main>{body}<br><br>{self.text(1, 5)}</p>"
        return f"<p data-main>{body}</p>"

    def content(self) -> str:
        kind = self.random.random()
        if kind < 0.62:
            return "".join(self.paragraph() for _ in range(self.random.randint(1, 6)))
        if kind < 0.7:
            level = self.random.randint(2, 4)
            return f"<h{level} data-main>{self.words(1, 6).capitalize()}</h{level}>{self.paragraph()}"
        if kind < 0.78:
            return "<ul>" + "".join(f"<li data-main>{self.text(1, 2)}</li>" for _ in range(self.random.randint(2, 6))) + "</ul>"
        if kind < 0.84:
            return f"<blockquote><p data-main>{self.text(1, 3)}</p></blockquote>"
        if kind < 0.88:
            return f"<pre data-main>{self.words(3, 20)}</pre>"
        if kind < 0.92:
            return "<table>" + "".join(f"<tr><td data-main>{self.words(1, 3)}</td><td data-main>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.96:
            return f"<figure><img src=a.png><figcaption data-main>{self.sentence()}</figcaption></figure>"
        return f"<div data-main>{self.text(1, 4)}</div>"

    def advert(self) -> str:
        name = self.random.choice(("ad", "ads", "ad-slot", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor-box"))
        inner = self.random.choice((self.text(1, 2), f"<p>{self.text(1, 2)}</p>", f"{self.link()} {self.sentence()}"))
        return f'<{(tag := self.random.choice(("div", "div", "aside", "section")))} class="{name}">{inner}</{tag}>'

    def notice(self) -> str:
        name = self.random.choice(("cookie", "cookie-notice", "cookie-banner", "notice", "consent", "gdpr", "alert", "newsletter", "subscribe", "paywall", "popup", "modal", "disclaimer", "warning", "disclosure"))
        text = self.random.choice((
            "We use cookies to improve your visit. Accept all cookies?", "Subscribe to our newsletter for weekly updates.",
            "By continuing you agree to our privacy policy.", "Sign up now and never miss a story.", self.text(1, 2),
        ))
        return f'<div {self.random.choice(("class", "id"))}="{name}"><p>{text}</p>{self.random.choice(("", "<button>Accept</button>"))}</div>'

    def form(self) -> str:
        return (
            f'<form action="/{self.words(1, 1)}"><label>{self.words(1, 3)}</label><input name=q><select><option>{self.words(1, 2)}'
            f"<option>{self.words(1, 2)}</select><p>{self.sentence()}</p><button>{self.random.choice(('Send', 'Search', 'Subscribe'))}</button></form>"
        )

    def comments(self) -> str:
        name = self.random.choice(("comments", "comment-list", "responses", "disqus_thread", "replies", "reader-comments", "discussion", "talkback", "feedback", "reactions"))
        one = lambda: (
            f'<{(tag := self.random.choice(("div", "li", "article")))} class="{self.random.choice(("comment", "reply", "comment-body", "response"))}">'
            f'<span class="author">{self.words(1, 2)}</span><p>{self.text(1, 4)}</p></{tag}>'
        )
        return f'<{(tag := self.random.choice(("section", "div", "ul")))} {self.random.choice(("class", "id"))}="{name}"><h3>{self.random.choice(("Comments", "Leave a reply", "3 comments"))}</h3>{"".join(one() for _ in range(self.random.randint(1, 4)))}</{tag}>'

    def menu(self) -> str:
        name = self.random.choice(("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "tabs", "topbar"))
        return self.random.choice((f"<nav><ul>{self.links()}</ul></nav>", f'<div class="{name}"><ul>{self.links()}</ul></div>', f'<ul id="{name}">{self.links()}</ul>', f"<nav>{self.link()} {self.link()} {self.link()}</nav>"))

    def header(self) -> str:
        inner = self.random.choice((f"<h1>{self.words(1, 3).title()}</h1><p>{self.sentence()}</p>", f"<p>{self.words(1, 4)}</p>", self.menu(), f'<div class="logo">{self.words(1, 2)}</div>'))
        return self.random.choice((f"<header>{inner}</header>", f'<div {self.random.choice(("class", "id"))}="{self.random.choice(("header", "site-header", "masthead", "branding"))}">{inner}</div>'))

    def footer(self) -> str:
        inner = self.random.choice((f"&copy; {self.words(1, 2)} &middot; {self.text(1, 2)}", f"<p>Copyright 2020 {self.words(1, 2)}. All rights reserved.</p>", f"<ul>{self.links()}</ul><p>{self.text(1, 2)}</p>", f"<div><p>{self.text(1, 3)}</p></div>"))
        return self.random.choice((f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div {self.random.choice(("class", "id"))}="{self.random.choice(("footer", "site-footer", "bottom", "copyright", "legal"))}">{inner}</div>'))

    def sidebar(self) -> str:
        inner = self.random.choice((f"<h3>{self.words(1, 3)}</h3><ul>{self.links()}</ul>", f"<p>{self.text(1, 3)}</p>", f"<h4>Related</h4>{self.link()} {self.link()}<p>{self.sentence()}</p>"))
        return self.random.choice((f"<aside>{inner}</aside>", f'<div {self.random.choice(("class", "id"))}="{self.random.choice(("sidebar", "side", "related", "widget", "recommended", "most-read", "trending", "rail", "infobox", "promo-box"))}">{inner}</div>'))

    def extras(self) -> str:
        return self.random.choice((
            f'<div class="{self.random.choice(("share", "social", "share-buttons", "toolbar"))}">{self.link()} {self.link()} Share</div>',
            f'<div class="{self.random.choice(("tags", "pagination", "pager"))}">{self.link()} {self.link()}</div>', self.advert(), self.notice(), self.form(),
        ))

    def byline(self) -> str:
        tag, name = self.random.choice(("p", "div", "span")), self.random.choice(("byline", "author", "meta", "dateline", "timestamp", "post-meta"))
        return f'<div><{tag} class="{name}">{self.random.choice(("By ", "", "Posted by "))}{self.words(1, 3).title()}</{tag}></div>'

    def unseen(self) -> str:
        """Text that no reader is shown."""
        how = self.random.choice(('style="display:none"', 'style="color:red; display: none"', "hidden", 'aria-hidden="true"', 'style="visibility:hidden"'))
        return self.random.choice((f"<p {how}>{self.text(1, 4)}</p>", f"<div {how}><p>{self.text(1, 4)}</p></div>", f"<div {how}>{self.text(1, 3)}</div>"))

    def inner_head(self, title: str) -> str:
        """The head of an article: its title is main text, who wrote it and when is not."""
        if not title or self.random.random() < 0.65:
            return title
        return f"<header>{title}{self.byline() if self.random.random() < 0.7 else ''}</header>"

    def inner_extra(self) -> str:
        """What stands between an article's paragraphs without being of it."""
        return self.random.choice((self.notice, self.sidebar, self.unseen, self.byline, self.inner_foot))()

    def inner_foot(self) -> str:
        return f"<footer>{self.random.choice((self.text(1, 2), f'<p>{self.text(1, 2)}</p>', 'Posted by ' + self.words(1, 2).title()))}</footer>"

    def bare(self) -> str:
        """A page of text without any element for its article."""
        kind = self.random.random()
        if kind < 0.3:
            return f"<html><body data-main>{'<br><br>'.join(self.text(1, 5) for _ in range(self.random.randint(1, 4)))}</body></html>"
        title = f"<h1 data-main>{self.sentence()}</h1>" if self.random.random() < 0.8 else ""
        parts = [title, *(self.content() for _ in range(self.random.randint(1, 4)))]
        if self.random.random() < 0.3:
            parts.insert(self.random.randint(1, len(parts)), self.random.choice((self.extras, self.inner_extra))())
        before = [make() for make, chance in ((self.header, 0.3), (self.menu, 0.4), (self.advert, 0.15), (self.notice, 0.15)) if self.random.random() < chance]
        after = [make() for make, chance in ((self.comments, 0.2), (self.sidebar, 0.2), (self.footer, 0.5)) if self.random.random() < chance]
        text = "".join(parts)
        for _ in range(self.random.randint(0, 3)):
            text = f"<div>{text}</div>"
        return f"<html><body>{''.join([*before, text, *after])}</body></html>"

    def page(self) -> str:
        draw = self.random.random
        if draw() < 0.25:
            return self.bare()
        head = f'<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>' if draw() < 0.8 else ""
        title = f"<h1 data-main>{self.sentence()}</h1>" if draw() < 0.85 else ""
        parts = [self.inner_head(title)] + [self.content() for _ in range(self.random.randint(1, 6))]
        for make, chance in ((self.extras, 0.4), (self.advert, 0.4), (self.notice, 0.3), (self.sidebar, 0.3), (self.inner_extra, 0.4), (self.comments, 0.3)):
            if draw() < chance:
                at = len(parts) if make == self.comments else self.random.randint(1, len(parts))
                parts.insert(at, make())
        tag, name = self.random.choice((
            ("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="content"'),
            ("div", ' class="post-body entry-content"'), ("section", ' class="article-body"'), ("div", ' class="story text"'), ("div", ' id="main"'),
        ))
        around = [f"<{tag}{name}>{''.join(parts)}</{tag}>"]
        before = [make() for make, chance in ((self.header, 0.5), (self.menu, 0.75), (self.advert, 0.5), (self.notice, 0.35), (self.form, 0.2), (self.sidebar, 0.25)) if draw() < chance]
        after = [make() for make, chance in ((self.comments, 0.35), (self.sidebar, 0.35), (self.form, 0.15), (self.advert, 0.25), (self.notice, 0.2), (self.footer, 0.85)) if draw() < chance]
        body = "".join([*before, *around, *after])
        if draw() < 0.2:
            body = f'<div id="{self.random.choice(("page", "wrapper", "container"))}">{body}</div>'
        return f'<!DOCTYPE html><html lang="en">{head}<body>{body}</body></html>'


def labelled_pages(pages: int = PAGES, seed: int = 11) -> list[str]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(pages)]
