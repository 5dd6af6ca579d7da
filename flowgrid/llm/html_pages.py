"""Labelled pages to train the extractor on: varied layouts, each with its main text."""

from __future__ import annotations

import html
import random

# Names that sites commonly give to the parts of a page.
MAIN = ["article", "main", "content", "post", "entry-content", "article-body", "story", "post-content", "main-content", "text", "body-text", "page-content", "blog-post", "single"]
MENU = ["nav", "menu", "navbar", "navigation", "main-nav", "top-menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "skip-links", "toolbar"]
HEAD = ["header", "masthead", "site-header", "top-bar", "branding", "logo", "page-header", "site-title", "tagline"]
FOOT = ["footer", "site-footer", "copyright", "bottom", "legal", "colophon", "page-footer", "credits", "foot-links"]
SIDE = ["sidebar", "aside", "widget", "related", "recent-posts", "popular", "side-column", "rail", "tags", "archive", "trending", "recommended", "more-stories", "author-bio", "teaser"]
NOTICE = ["cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "banner", "disclaimer", "message", "popup", "modal", "overlay", "warning", "announcement", "paywall"]
ADVERT = ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad-slot", "adbox", "banner-ad", "affiliate", "offer"]
FORM = ["subscribe", "newsletter", "signup", "login", "search", "search-form", "contact-form", "register", "feedback", "poll"]
COMMENT = ["comments", "comment", "comment-list", "responses", "disqus", "reader-comments", "discussion", "replies", "comment-body", "reviews", "respond"]
SHARE = ["share", "social", "social-links", "share-buttons", "follow", "print-tools"]
SYLLABLES = "ka lo mi ren tas vel no du shi par gon eth wir bel cho nam qua ser ti ul".split()
PHRASES = {
    "notice": ["We use cookies to improve your visit.", "This site uses cookies. Accept all", "Please accept our privacy policy.", "Diese Seite verwendet Cookies.", "Ce site utilise des cookies.", "Este sitio usa cookies."],
    "foot": ["© 2024 {}. All rights reserved.", "Copyright {}", "© {} · {}", "Privacy policy", "Terms of use", "Impressum", "Mentions légales", "Aviso legal"],
    "form": ["Subscribe to our newsletter", "Enter your email", "Sign up", "Log in", "Search this site", "Send"],
    "comment": ["Reply", "Leave a comment", "3 comments", "Posted by {} on Monday", "{} says:"],
    "advert": ["Advertisement", "Sponsored", "Buy now and save", "Anzeige", "Publicité"],
}


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, sentences: int) -> str:
        out = []
        for _ in range(sentences):
            s = self.words(1, 24)
            if self.r.random() < 0.3:
                s = s.replace(" ", ", ", 1)
            if self.r.random() < 0.1:
                s = " ".join(w + self.r.choice(["###", "%%%", "&&&", "***"]) for w in s.split())
            if self.r.random() < 0.05:  # prose may speak of what marks other parts
                s += " " + self.r.choice(["cookie", "privacy", "consent", "copyright", "newsletter", "reply", "comments", "sponsored"]) + " " + self.words(1, 6)
            out.append(s.capitalize() + self.r.choice([".", ".", ".", "!", "?"]))
        return " ".join(out)

    def names(self, pool: list[str]) -> str:
        kind = self.r.choice(["class", "class", "id"])
        return f' {kind}="{self.r.choice(pool)}{self.r.choice(["", "", "", " " + self.word(), "-" + self.word()])}"'

    def box(self, tags: list[str], pool: list[str], inside: str) -> str:
        tag = self.r.choice(tags)
        bare = tag not in ("div", "section", "ul", "p") and self.r.random() < 0.4
        return f"<{tag}{'' if bare else self.names(pool)}>{inside}</{tag}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(n)]
        how = self.r.random()
        if how < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if how < 0.8 else "".join(f"<p>{x}</p>" if how < 0.9 else f"<div>{x}</div>" for x in items)

    def said(self, kind: str) -> str:
        return html.escape(self.r.choice(PHRASES[kind]).replace("{}", self.words(1, 3)))

    def long(self, kind: str) -> str:
        """A notice, legal text or form at length, in elements that say nothing of it."""
        parts = [self.said(kind) for _ in range(self.r.randint(4, 14))] + [html.escape(self.prose(1)) for _ in range(self.r.randint(0, 4))]
        self.r.shuffle(parts)
        text = " ".join(parts)
        return self.r.choice([f"<div><p>{text}</p></div>", f"<div>{text}</div>", f"<p>{text}</p>", f"<section><p>{text}</p></section>", self.box(["div", "section"], NOTICE + FOOT, f"<p>{text}</p>")])

    def junk(self, kind: str) -> str:
        r = self.r
        if kind in ("notice", "foot", "form") and r.random() < 0.15:
            return self.long(kind)
        text = lambda: html.escape(self.prose(r.randint(1, 3)))
        if kind == "menu":
            return self.box(["nav", "nav", "div", "ul", "header"], MENU, self.links(r.randint(3, 8)))
        if kind == "head":
            return self.box(["header", "header", "div"], HEAD, r.choice([f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{text()}</p>", f"<h2>{self.words(1, 3)}</h2><p>{self.words(2, 6)}</p>"]))
        if kind == "foot":
            return self.box(["footer", "footer", "div"], FOOT, r.choice([self.said("foot"), f"<p>{self.said('foot')}</p>{self.links(3)}", f"&copy; {self.word()}.example.com &middot; {text()}", f"<p>{text()}</p><p>{self.said('foot')}</p>"]))
        if kind == "side":
            return self.box(["aside", "aside", "div", "section"], SIDE, f"<h3>{self.words(1, 3)}</h3>" + r.choice([self.links(r.randint(2, 6)), f"<p>{text()}</p>", f"<ul><li>{self.words(2, 5)}</li><li>{self.words(2, 5)}</li></ul>", text()]))
        if kind == "notice":
            return self.box(["div", "div", "section", "p"], NOTICE, r.choice([self.said("notice"), f"<p>{self.said('notice')}</p><button>OK</button>", text()]))
        if kind == "advert":
            return self.box(["div", "div", "section", "aside", "p"], ADVERT, r.choice([text(), text(), f"<p>{text()}</p>", self.said("advert"), f'<a href="http://x">{self.words(3, 8)}</a>']))
        if kind == "form":
            inside = r.choice([f"<label>{self.said('form')}</label><input><button>Go</button>", f"<p>{self.said('form')}</p><input type=email>", f"{self.said('form')} <input> {self.words(1, 4)}", f"<h3>{self.words(2, 4)}</h3><p>{text()}</p><input>", f"<fieldset><legend>{self.words(1, 3)}</legend><p>{text()}</p></fieldset>"])
            return f"<form{self.names(FORM) if r.random() < 0.6 else ''}>{inside}</form>" if r.random() < 0.8 else self.box(["div", "section"], FORM, inside)
        if kind == "comment":
            one = lambda: r.choice([f"<p>{text()}</p>", f'<div class="comment-body"><p>{text()}</p></div>', f"<li>{text()}</li>", f'<div class="comment"><b>{self.word()}</b> {text()}</div>', f'<article class="comment"><h4>{self.word()}</h4><p>{text()}</p></article>'])
            return self.box(["section", "div", "div", "ol", "aside"], COMMENT, (f"<h3>{self.said('comment')}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 5))))
        return self.box(["div", "ul", "aside"], SHARE, self.links(r.randint(2, 5)))

    def main(self) -> tuple[list[str], list[str]]:
        """Pieces of markup and the lines of text that they show."""
        r = self.r
        title = self.words(3, 9).capitalize() if r.random() < 0.5 else self.prose(1)
        pieces, lines = [], []

        def put(tag: str, text: str, close: bool = True) -> None:
            shown = html.escape(text)
            if r.random() < 0.15 and " " in text:
                a, b = text.split(" ", 1)
                shown = f"<b>{html.escape(a)}</b> {html.escape(b)}" if r.random() < 0.5 else f'<a href="/x">{html.escape(a)}</a> {html.escape(b)}'
            pieces.append(f"<{tag}>{shown}" + (f"</{tag}>" if close else ""))
            lines.append(" ".join(text.split()))

        if r.random() < 0.85:
            put(r.choice(["h1", "h1", "h2"]), title)
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.72:
                put("p", self.prose(r.choice([1, 1, 2, 4, 8])), r.random() < 0.85)
            elif kind < 0.8:
                pieces.append("<p><b>" + html.escape(text := self.prose(r.randint(1, 3))) + "<br>")
                lines.append(text)
            elif kind < 0.86:
                put(r.choice(["h2", "h3"]), self.words(1, 6).capitalize())
            elif kind < 0.91:
                put("blockquote", self.prose(2))
            elif kind < 0.96:
                items = [self.words(2, 9) for _ in range(r.randint(2, 4))]
                pieces.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                lines += items
            else:
                put("pre", self.words(3, 12))
        return [title, *pieces], lines


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, str]]:
    """``n`` pairs of a page's html and its main text, lines joined by \\n."""
    out = []
    for k in range(n):
        m = _Maker(seed * 1_000_003 + k)
        r = m.r
        (title, *pieces), lines = m.main()
        # Other parts may stand inside the main element, too.
        for kind in r.sample(["advert", "share", "notice", "side", "form", "comment"], k=r.choice([0, 0, 1, 1, 2])):
            pieces.insert(len(pieces) if kind == "comment" else r.randint(1, len(pieces)), m.junk(kind))
        inside = "".join(pieces)
        how = r.random()
        body = f"<article>{inside}</article>" if how < 0.45 else f"<main>{inside}</main>" if how < 0.55 else m.box(["div", "section", "article", "main", "div"], MAIN, inside)
        if r.random() < 0.2:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "row", "site", "layout"])}">{body}</div>'
        if r.random() < 0.06:  # columns of a table
            cell = lambda inside, pool: f"<td{m.names(pool) if r.random() < 0.7 else ''}>{inside}</td>"
            beside = cell(m.junk(r.choice(["menu", "side", "advert"])) if r.random() < 0.6 else m.links(3), MENU + SIDE)
            cells = [cell(inside if r.random() < 0.6 else body, MAIN), beside]
            body = f"<table><tr>{''.join(cells if r.random() < 0.5 else cells[::-1])}</tr></table>"
        before = [m.junk(x) for x in r.sample(["menu", "menu", "head", "advert", "notice", "form", "side"], k=r.randint(0, 4))]
        after = [m.junk(x) for x in r.sample(["foot", "foot", "comment", "side", "advert", "form", "share", "notice", "menu"], k=r.randint(0, 5))]
        head = f"<head><title>{html.escape(title)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        out.append((f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- x -->{body}{''.join(after)}</body></html>", "\n".join(lines)))
    return out
