"""Invented web pages with known main text, to train the block labeller on.

Pages mix ways in which sites mark up articles and what surrounds them. Words
are invented, so that the labeller learns from tags, names and the neighbourhood.
Blocks of main text begin with :data:`MARK`.
"""

from __future__ import annotations

import random

MARK = ""

_ARTICLE = "article post entry content story body text main page-content post-content entry-content article-body story-body post-body main-content richtext blog-post news-item prose markdown".split()
_NAV = "nav menu navbar navigation main-menu top-nav site-nav breadcrumb breadcrumbs pagination pager tabs links toolbar submenu dropdown".split()
_HEADER = "header site-header masthead top topbar page-header branding logo banner hero tagline".split()
_SIDE = "sidebar side aside widget rail right-column left-column secondary related related-posts recommended more-stories trending popular read-more also-read tags tag-cloud categories archive author-box bio".split()
_NOTICE = "notice cookie cookie-banner cookie-consent consent gdpr alert warning message disclaimer privacy-notice info-bar announcement paywall modal popup overlay toast".split()
_AD = "ad ads advert advertisement ad-slot adbox banner-ad sponsor sponsored promo promotion promoted adsense google-ad dfp commercial affiliate".split()
_FORM = "form search search-form login signup subscribe newsletter contact register feedback poll survey comment-form".split()
_FOOTER = "footer site-footer bottom copyright legal colophon foot imprint credits".split()
_COMMENT = "comments comment comment-list commentlist responses discussion replies respond disqus reader-comments comment-section thread".split()
_SHARE = "share social share-bar sharing social-links follow buttons".split()
_PLAIN = "box inner wrapper container row col left center block section group item x1 c a main-wrap layout wrap".split()

_SAID = {
    "nav": "Home;About;Contact;News;Sports;Products;Next;Previous;Archive;Sitemap;Login;Help".split(";"),
    "notice": "We use cookies to improve this site.;Accept;By using this site you agree to our terms.;Subscribe to continue reading;This page was updated.".split(";"),
    "ad": "Advertisement;Sponsored;Buy now;Best price;Click here;Limited offer".split(";"),
    "form": "Search;Your name;E-mail;Password;Submit;Subscribe;Sign up;Log in;Send".split(";"),
    "footer": "© 2020;All rights reserved;Privacy policy;Terms of use;Powered by;Imprint;Copyright".split(";"),
    "comment": "Reply;Comments;Leave a comment;Report;says:;3 comments;Like".split(";"),
    "side": "Related;Popular;Recent posts;Tags;Categories;You may also like;About the author;Read more".split(";"),
    "share": "Share;Tweet;Like;Follow us;E-mail;Print".split(";"),
}


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        self.parts = ["".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") + r.choice(["", "n", "r", "s", "t", "l"]) for _ in range(1)) for _ in range(90)]

    # Text.

    def word(self) -> str:
        r = self.r
        if r.random() < 0.03:
            return r.choice(["2020", "14", "x|y", "50%", "A&amp;B", "***", "&quot;ja&quot;", "café", "über"])
        return "".join(r.choice(self.parts) for _ in range(r.choice([1, 1, 2, 2, 3])))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self) -> str:
        s = self.words(1, 3) if self.r.random() < 0.12 else self.words(4, 22)
        x = self.r.random()
        if x < 0.03:
            return " ".join([self.word()] * self.r.randint(5, 40))
        if x < 0.06:
            return " ".join(w.upper() + "!!" for w in s.split(" "))
        if x < 0.09:
            return s.replace(" ", self.r.choice([" | ", "*** ", "%%% ", "### "]))
        return s[0].upper() + s[1:] + self.r.choice([".", ".", ".", ".", "!", "?", ""])

    def text(self, a: int = 1, b: int = 5) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def inline(self, s: str) -> str:
        r = self.r
        if r.random() < 0.2:
            w = s.split(" ")
            i = r.randrange(len(w))
            w[i] = r.choice(['<b>{}</b>', '<em>{}</em>', '<a href="/x">{}</a>', '<span class="x">{}</span>', '<strong>{}</strong>', '<a class="ref" href="#1">{}</a>']).format(w[i])
            s = " ".join(w)
        return s

    # Markup.

    def names(self, of: list[str], much: float = 0.85) -> str:
        """Attributes; now and then names that say nothing."""
        r = self.r
        if r.random() > much:
            return "" if r.random() < 0.5 else f' class="{r.choice(_PLAIN)}"'
        name = r.choice(of)
        style = r.random()
        if style < 0.15:
            name = "".join(p.capitalize() if i else p for i, p in enumerate(name.split("-")))
        elif style < 0.3:
            name = f"{r.choice(['c', 'm', 'js', 'block', 'site', 'b'])}-{name}"
        elif style < 0.4:
            name = f"{name} {r.choice(_PLAIN)}"
        elif style < 0.5:
            name = name.replace("-", "_") + r.choice(["_1", "-2", "_wrap", "-inner", "-box", ""])
        return f' {r.choice(["class", "class", "class", "id"])}="{name}"'

    def said(self, kind: str) -> str:
        r = self.r
        x = r.random()
        return r.choice(_SAID[kind]) if x < 0.35 else self.words(1, 4) if x < 0.6 else self.text(1, 2)

    def links(self, kind: str, a: int = 2, b: int = 9) -> str:
        r = self.r
        n = r.randint(a, b)
        if r.random() < 0.7:
            tag = r.choice(["ul", "ul", "ol"])
            close = r.choice(["</li>", "</li>", ""])
            return f"<{tag}{self.names(_NAV, 0.3)}>" + "".join(f'<li><a href="/{i}">{self.said(kind)}</a>{close}' for i in range(n)) + f"</{tag}>"
        return r.choice([" ", " | ", "\n"]).join(f'<a href="/{i}">{self.said(kind)}</a>' for i in range(n))

    def lines(self, kind: str, tags: str = "p p div span h3 h4 li") -> str:
        r = self.r
        return "".join((lambda t: f"<{t}>{self.said(kind)}</{t}>")(r.choice(tags.split())) for _ in range(r.randint(1, 4)))

    def around(self, kind: str) -> str:
        """A piece that is no main text."""
        r = self.r
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div", "ul", "section"])
            body = self.links("nav")
            return f"<{tag}{self.names(_NAV, 0.9 if tag != 'nav' else 0.4)}>{body}</{tag}>"
        if kind == "header":
            tag = r.choice(["header", "header", "div"])
            body = f"<{r.choice(['h1', 'h2', 'div', 'a', 'p'])}>{self.words(1, 5)}" + (f"<p{self.names(_HEADER, 0.5)}>{self.said('nav')}</p>" if r.random() < 0.5 else "") + (self.around("nav") if r.random() < 0.4 else "")
            return f"<{tag}{self.names(_HEADER, 0.9 if tag != 'header' else 0.4)}>{body}</{tag}>"
        if kind == "side":
            tag = r.choice(["aside", "aside", "div", "section"])
            body = f"<{r.choice(['h2', 'h3', 'h4', 'p'])}>{self.said('side')}</h3>" + r.choice([lambda: self.links("side"), lambda: self.lines("side"), lambda: "".join(f"<p>{self.text(1, 3)}</p>" for _ in range(r.randint(1, 3)))])()
            return f"<{tag}{self.names(_SIDE, 0.95 if tag != 'aside' else 0.5)}>{body}</{tag}>"
        if kind == "notice":
            tag = r.choice(["div", "div", "section", "aside", "p", "dialog"])
            return f"<{tag}{self.names(_NOTICE, 1.0)}>{self.lines('notice', 'p div span button') if tag != 'p' else self.said('notice')}</{tag}>"
        if kind == "ad":
            tag = r.choice(["div", "div", "div", "aside", "section", "ins", "p"])
            return f"<{tag}{self.names(_AD, 1.0)}>{r.choice([lambda: self.said('ad'), lambda: self.text(1, 2), lambda: self.links('ad', 1, 2)])()}</{tag}>"
        if kind == "form":
            form = f"<form{self.names(_FORM, 0.5)}>{self.lines('form', 'label p button legend div')}<input name=q><button>{self.said('form')}</button></form>"
            return form if r.random() < 0.6 else f"<div{self.names(_FORM, 1.0)}><h3>{self.said('form')}</h3>{form}</div>"
        if kind == "comment":
            tag = r.choice(["div", "section", "ol", "ul"])
            inner = r.choice(["div", "article", "li", "div"])
            body = "".join(f"<{inner}{self.names(_COMMENT, 0.6)}>" + (f"<{r.choice(['cite', 'b', 'h4', 'span'])}>{self.words(1, 2)}</{'span'}>" if r.random() < 0.5 else "") + f"<p>{self.text(1, 3)}</p>" + (f"<a href=#>{self.said('comment')}</a>" if r.random() < 0.4 else "") + f"</{inner}>" for _ in range(r.randint(1, 5)))
            head = f"<h3>{self.said('comment')}</h3>" if r.random() < 0.6 else ""
            return f"<{tag}{self.names(_COMMENT, 1.0)}>{head}{body}</{tag}>"
        if kind == "share":
            return f"<div{self.names(_SHARE, 1.0)}>{self.links('share', 2, 5)}</div>"
        tag = r.choice(["footer", "footer", "footer", "div"])
        body = r.choice([lambda: f"&copy; {self.words(1, 2)} &middot; {self.text(1, 1)}", lambda: self.lines("footer"), lambda: self.links("footer") + f"<p>{self.said('footer')}</p>"])()
        return f"<{tag}{self.names(_FOOTER, 0.95 if tag != 'footer' else 0.4)}>{body}</{tag}>"

    def said_in(self) -> list[str]:
        """Blocks of main text in their markup."""
        r = self.r
        out = []
        if r.random() < 0.85:
            title = f"<h1>{MARK}{self.words(2, 10)}</h1>"
            out.append(f"<header>{title}</header>" if r.random() < 0.12 else title)
        if r.random() < 0.06:  # the same line over and over
            line = f"<p>{MARK}{r.choice([self.sentence, lambda: self.words(1, 3), lambda: ' '.join([self.word()] * r.randint(5, 60))])()}</p>"
            out += [line] * r.randint(2, 30)
        for _ in range(r.choice([1, 2, 3, 4, 6, 8, 12, 12, 25])):
            x = r.random()
            if x < 0.6:
                out.append(f"<p{self.names(_PLAIN, 0.1)}>{MARK}{self.inline(self.text(1, r.choice([1, 3, 6])))}</p>")
            elif x < 0.7:
                out.append(f"<p><b>{MARK}{self.sentence()}<br>" + (f"<p>{MARK}{self.text()}</p>" if r.random() < 0.8 else ""))
            elif x < 0.77:
                out.append(f"<{(t := r.choice(['h2', 'h3', 'h4']))}>{MARK}{self.words(1, 7)}</{t}>")
            elif x < 0.85:
                out.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{MARK}{self.inline(self.words(1, 12))}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif x < 0.89:
                out.append(f"<blockquote>{MARK}{self.text(1, 2)}</blockquote>")
            elif x < 0.92:
                out.append(f"<figure><img src=x><figcaption>{MARK}{self.sentence()}</figcaption></figure>")
            elif x < 0.95:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 3)}" for _ in range(3)) for _ in range(r.randint(1, 3))) + "</table>")
            elif x < 0.97:
                out.append(f"<pre>{MARK}{self.words(3, 20)}</pre>")
            else:
                out.append(f"<div>{MARK}{self.text(1, 3)}</div>")
        return out

    # Whole pages.

    def bare(self) -> str:
        """An article and nothing or little else: paragraphs without a frame, or text without a tag."""
        r, x = self.r, self.r.random()
        if x < 0.2:
            return f"{MARK}{self.text(1, 6)}"
        if x < 0.45:
            body = "".join(f"<p>{MARK}{self.inline(self.text(1, 6))}" + r.choice(["</p>", ""]) for _ in range(r.randint(1, 8)))
        elif x < 0.55:
            line = f"<p>{MARK}{self.text(1, 3)}</p>"
            body = line * r.randint(2, 5)
        else:
            body = "".join(self.said_in())
        body = r.choice([self.around("nav"), self.links("nav"), "", "", ""]) + body + r.choice([self.around("footer"), f"<hr>{self.said('footer')}", "", "", ""])
        return r.choice(["{}", "<html><body>{}</body></html>", "<body>{}"]).format(body)

    def plain_name(self) -> str:
        r = self.r
        return r.choice(["", f' class="{r.choice("abcdstx")}{r.randint(1, 30)}"', f" class={r.choice('cx')}{r.randint(1, 9)}", f' class="{r.choice(_PLAIN)}"', f' class="css-{r.randrange(16**6):06x}"'])

    def soup(self) -> str:
        """Divisions only, with names that say nothing."""
        r = self.r
        div = lambda x: f"<div{self.plain_name()}>{x}</div>"
        name = self.plain_name()
        inner = ([div(f"{MARK}{self.words(2, 10)}")] if r.random() < 0.8 else []) + [f"<div{name}>{MARK}{self.inline(self.text(1, 5))}</div>" for _ in range(r.randint(1, 10))]
        if r.random() < 0.1:
            inner = inner[:-1] + [inner[-1]] * r.randint(2, 4)
        body = div("".join(inner)) if r.random() < 0.9 else "".join(inner)
        links = lambda kind: div(r.choice([lambda: self.links(kind), lambda: " ".join(self.said(kind) for _ in range(r.randint(1, 4))), lambda: div(self.links(kind)) + div(self.links(kind))])())
        before = [links(k) for k, p in (("nav", 0.8), ("ad", 0.2), ("notice", 0.1)) if r.random() < p]
        after = [links(k) for k, p in (("side", 0.3), ("share", 0.2), ("ad", 0.2)) if r.random() < p] + ([div(r.choice(["Contact us", "Contact", "About us", "Help", self.said("footer"), self.said("footer")]))] if r.random() < 0.8 else [])
        whole = "".join(before) + body + "".join(after)
        return r.choice(["{}", "<html><head><title>t</title></head><body>{}</body></html>"]).format(div(whole) if r.random() < 0.4 else whole)

    def table(self) -> str:
        """A page laid out by a table: links on top or at a side, the text in a cell, a last line."""
        r = self.r
        a = lambda: r.choice(["", "", ' width="20%"', " bgcolor=#eee", ' valign="top"', " colspan=2", ' align="center"'])
        font = lambda x: r.choice(["{}", "{}", "<font size=2>{}</font>", "<center>{}</center>"]).format(x)
        text = r.choice([
            lambda: "".join(self.said_in()),
            lambda: f"<h1>{MARK}{self.words(2, 8)}</h1>" + "".join(f"<p>{MARK}{self.inline(self.text(1, 5))}" for _ in range(r.randint(1, 6))),
            lambda: f"<b>{MARK}{self.words(2, 8)}</b><p>" + "<p>".join(f"{MARK}{self.text(1, 5)}" for _ in range(r.randint(1, 6))),
            lambda: f"{MARK}{self.text(2, 6)}",
        ])()
        top = f"<tr><td{a()}>{font(r.choice([self.links('nav'), self.said('nav'), '<img src=x>' + self.words(1, 3)]))}</td></tr>" if r.random() < 0.7 else ""
        side = f"<td{a()}>{font(r.choice([self.links('nav'), self.links('side'), self.lines('side')]))}</td>" if r.random() < 0.7 else ""
        main = f"<td{a()}>{text}</td>"
        ends = ["Copyright 1999", f"Copyright {r.randint(1994, 2012)} {self.words(1, 2)}", f"&copy; {r.randint(1994, 2012)}", "Best viewed at 800x600", self.links("footer"), self.said("footer")]
        last = f"<tr><td{a()}>{font(r.choice(ends))}</td></tr>" if r.random() < 0.85 else ""
        whole = f"<table{a()}>{top}<tr>{r.choice([side + main, main + side])}</tr>{last}</table>" + (r.choice(ends) if r.random() < 0.15 else "")
        return r.choice(["{}", "<html><body bgcolor=white>{}</body></html>"]).format(whole)

    def page(self) -> str:
        """A page of any kind."""
        x = self.r.random()
        return self.bare() if x < 0.08 else self.soup() if x < 0.18 else self.table() if x < 0.26 else self.framed()

    def framed(self) -> str:
        """A page whose parts have names or elements of their own."""
        r = self.r
        parts = self.said_in()
        if r.random() < 0.3:
            parts.insert(r.randint(1, len(parts)), self.around(r.choice(["ad", "ad", "side", "notice", "form", "share"])))
        if r.random() < 0.15:
            parts.append(self.around(r.choice(["comment", "comment", "share", "side"])))
        x = r.random()
        body = "".join(parts)
        if x < 0.45:
            body = f"<article{self.names(_ARTICLE, 0.4)}>{body}</article>"
        elif x < 0.55:
            body = f"<main>{body}</main>"
        elif x < 0.85:
            body = f"<div{self.names(_ARTICLE, 1.0)}>{body}</div>"
        elif x < 0.92:
            body = f"<section{self.names(_ARTICLE, 0.8)}>{body}</section>"
        for _ in range(r.randint(0, 2)):
            tag = r.choice(["div", "div", "main", "section"])
            body = f"<{tag}{self.names(_PLAIN, 0.7)}>{body}</{tag}>"
        before = [self.around(k) for k, p in (("notice", 0.2), ("header", 0.4), ("nav", 0.75), ("form", 0.12), ("ad", 0.4), ("side", 0.15)) if r.random() < p]
        after = [self.around(k) for k, p in (("share", 0.12), ("comment", 0.35), ("side", 0.35), ("ad", 0.2), ("form", 0.2), ("notice", 0.15), ("nav", 0.15), ("footer", 0.85)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        comment = "<!-- x -->" if r.random() < 0.5 else ""
        end = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><script>x('</p>')</script></head><body>{''.join(before)}{comment}{body}{''.join(after)}{end}"
