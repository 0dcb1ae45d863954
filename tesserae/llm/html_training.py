"""Labelled pages for the extraction model: families of layouts, filled with invented words by a seeded generator.

A family is a way in which sites are built (blog, divisions with names, table grid, bare document, newspaper, manual,
encyclopaedia, shop notice). Each page comes with the blocks that a reader would mark as its main text, in page order.
Families can be left out, to judge the model on layouts it was never fitted to.
"""

from __future__ import annotations

import html
import random
from collections.abc import Callable

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo ran ter lin mos pel dar".split()


class Writer:
    """Writes parts of one page and notes the wanted blocks."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.wanted: list[str] = []

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if len(words) > 6 and self.chance(0.3):
            words[len(words) // 2] += ","
        return " ".join(words).capitalize() + (self.r.choice("....?!") if self.chance(0.9) else "")

    def text(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def title(self) -> str:
        return self.sentence(1, 9).rstrip(".?!")

    def label(self) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(1, 2))).capitalize()

    def shown(self, text: str) -> str:
        """Wanted text as markup: escaped, with inline elements about some of its words."""
        self.wanted.append(text)
        words = [html.escape(w, quote=False) for w in text.split(" ")]
        for _ in range(self.r.choice((0, 0, 1, 1, 2, 3))):
            k = self.r.randrange(len(words))
            if "<" not in words[k]:
                words[k] = self.r.choice(("<b>{}</b>", "<i>{}</i>", "<code>{}</code>", '<a href="/p">{}</a>', "<em>{}</em>", "<span>{}</span>", "<strong>{}</strong>")).format(words[k])
        return " ".join(words)

    def linked(self, text: str) -> str:
        self.wanted.append(text)
        return f'<a href="/{self.word()}">{html.escape(text)}</a>'

    # parts of the main text

    def paragraph(self, most: int = 6) -> str:
        named = ""
        if self.chance(0.12):  # a name that says little about a single paragraph
            named = f' class="{self.r.choice(("comment", "lead", "note", "more", "intro", "share-of-voice", "ad", "footer-free", "small", "first", "x1", "alert"))}"'
        return f"<p{named}>{self.shown(self.text(most))}" + ("</p>" if self.chance(0.85) else "\n")

    def items(self, tag: str = "li") -> str:
        kind = self.r.random()
        count = self.r.choice((1, 2, 3, 4, 6))
        if kind < 0.4:
            return "".join(f"<{tag}>{self.shown(self.sentence())}</{tag}>" for _ in range(count))
        if kind < 0.7:
            return "".join(f"<{tag}>{self.linked(self.sentence(2, 9))}</{tag}>" for _ in range(count))
        return "".join(f"<{tag}>{self.shown(self.label())}" for _ in range(count))

    def grid(self) -> str:
        columns = self.r.randint(2, 4)
        head = "<tr>" + "".join(f"<th>{self.shown(self.label())}</th>" for _ in range(columns)) + "</tr>" if self.chance(0.7) else ""
        cell = lambda: self.shown(self.label() if self.chance(0.7) else self.sentence()) if self.chance(0.85) else self.linked(self.label())
        rows = "".join("<tr>" + "".join(f"<td>{cell()}</td>" for _ in range(columns)) + "</tr>" for _ in range(self.r.randint(1, 4)))
        return f"<table>{head}{rows}</table>" if self.chance(0.6) else f"<table><thead>{head}</thead><tbody>{rows}</tbody></table>"

    def figure(self) -> str:
        caption = f"<figcaption>{self.shown(self.sentence(2, 12))}</figcaption>"
        return f'<figure><img src="/i.png" alt="{self.word()}">{caption}</figure>'

    def terms(self) -> str:
        return "<dl>" + "".join(f"<dt>{self.shown(self.label()) if self.chance(0.6) else self.linked(self.label())}</dt><dd>{self.shown(self.text(2))}</dd>" for _ in range(self.r.randint(1, 4))) + "</dl>"

    def block(self) -> str:
        """One piece of the main text."""
        kind = self.r.random()
        if kind < 0.48:
            return self.paragraph()
        if kind < 0.53:
            return f"<p>{self.shown(self.label() + '.')}</p>"
        if kind < 0.57:
            return f"<p>{self.linked(self.sentence(3, 14))}</p>"
        if kind < 0.66:
            tag = self.r.choice(("h2", "h2", "h3", "h4"))
            return f"<{tag}>{self.shown(self.title())}</{tag}>"
        if kind < 0.74:
            tag = self.r.choice(("ul", "ul", "ol"))
            return f"<{tag}>{self.items()}</{tag}>"
        if kind < 0.79:
            return self.grid()
        if kind < 0.84:
            return self.figure()
        if kind < 0.88:
            return self.terms()
        if kind < 0.92:
            return f"<pre>{self.shown(self.sentence(3, 12))}</pre>"
        if kind < 0.96:
            return f"<blockquote><p>{self.shown(self.text(2))}</p></blockquote>"
        return f"<div>{self.shown(self.text(3))}</div>"

    def blocks(self, low: int = 1, high: int = 10, within: tuple[Callable, ...] = ()) -> str:
        """Pieces of the main text, now and then with one of ``within`` between them."""
        out = []
        for _ in range(self.r.randint(low, high)):
            out.append(self.block())
            if within and self.chance(0.12):
                out.append(self.r.choice(within)())
        return "".join(out)

    # parts that are not the main text

    def anchors(self, low: int = 2, high: int = 8) -> list[str]:
        return [f'<a href="/{self.word()}">{self.label()}</a>' for _ in range(self.r.randint(low, high))]

    def links(self, low: int = 2, high: int = 8) -> str:
        found = self.anchors(low, high)
        kind = self.r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>"
        return (" ", " | ", " &raquo; ", "<br>")[int(kind * 1000) % 4].join(found)

    def menu(self) -> str:
        return self.r.choice(("<nav>{}</nav>", '<nav class="main-nav">{}</nav>', '<div class="menu">{}</div>', '<div id="navigation">{}</div>', '<ul class="nav">{}</ul>', '<div class="breadcrumb">{}</div>')).format(self.links())

    def top(self) -> str:
        inside = self.r.choice((f'<a href="/">{self.label()}</a>', f"<h2>{self.label()}</h2><p>{self.sentence(2, 7)}</p>", f'<a href="/"><img src=l.png></a>{self.links()}', f"<p>{self.label()}</p>{self.find()}"))
        return self.r.choice(("<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>', '<div id="top-banner">{}</div>')).format(inside)

    def find(self) -> str:
        return f'<form action="/find"><label>{self.word()}</label><input type=text name=q><button>{self.word()}</button></form>'

    def advert(self) -> str:
        inside = self.r.choice((self.sentence(), f"<p>{self.text(2)}</p>", f'<a href="/buy">{self.sentence(2, 6)}</a>', f"<h4>{self.label()}</h4><p>{self.sentence()}</p>"))
        return self.r.choice(('<div class="advert">{}</div>', '<div id="ad-top">{}</div>', '<div class="ad">{}</div>', '<section class="sponsored">{}</section>', '<aside class="promo">{}</aside>', '<div class="sponsor-box">{}</div>')).format(inside)

    def notice(self) -> str:
        inside = self.r.choice((f"<p>{self.text(2)}</p><button>{self.word()}</button>", self.sentence(), f"{self.sentence()} <a href='/c'>{self.word()}</a>"))
        return self.r.choice(('<div class="cookie-bar">{}</div>', '<div id="consent">{}</div>', '<div class="notice">{}</div>', '<div role="alert">{}</div>', '<section class="newsletter">{}</section>', '<div class="modal subscribe">{}</div>')).format(inside)

    def side(self) -> str:
        inside = self.r.choice((f"<h3>{self.label()}</h3>{self.links()}", f"<p>{self.text(2)}</p>", f"<h4>{self.label()}</h4><p>{self.sentence()}</p>", self.links(2, 4)))
        return self.r.choice(("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="side">{}</div>', '<div class="widget">{}</div>', '<section class="related">{}</section>', '<div class="popular">{}</div>')).format(inside)

    def share(self) -> str:
        return self.r.choice(('<div class="share">{}</div>', '<ul class="social">{}</ul>', '<div class="sharing">{}</div>')).format(self.links(2, 4))

    def replies(self) -> str:
        one = ('<div class="comment"><b>{n}</b><p>{t}</p></div>', "<li><p>{t}</p></li>", '<article class="comment"><p>{t}</p></article>', '<div class="reply">{t}</div>', "<p>{t}</p>")
        shape = self.r.choice(one)
        said = "".join(shape.format(n=self.label(), t=self.text(3)) for _ in range(self.r.randint(1, 5)))
        head = f"<h3>{self.label()}</h3>" if self.chance(0.5) else ""
        tail = f"<form><textarea>{self.word()}</textarea><button>{self.word()}</button></form>" if self.chance(0.3) else ""
        return self.r.choice(('<section class="comments">{}</section>', '<div id="comments">{}</div>', '<ol class="commentlist">{}</ol>', '<div class="discussion">{}</div>', '<section id="replies">{}</section>')).format(head + said + tail)

    def bottom(self) -> str:
        year = self.r.randint(1998, 2025)
        inside = self.r.choice((
            f"Copyright {year} {self.label()}. All rights reserved.", f"<p>{self.sentence()}</p>", self.links(2, 6), f"<p>© {year} {self.label()}</p>{self.links(2, 3)}",
            f"{self.label()}, {self.sentence(3, 9)}", f"<address>{self.sentence(3, 7)}</address>", f"© {self.label()} – {self.text(2)}",
        ))
        return self.r.choice(("<footer>{}</footer>", "<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="foot">{}</div>', '<div class="copyright">{}</div>')).format(inside)

    def some(self, p: float, make: Callable[[], str]) -> str:
        return make() if self.chance(p) else ""

    def heading(self) -> str:
        """Mostly a first heading; some pages have a lower one or none."""
        kind = self.r.random()
        return f"<h1>{self.shown(self.title())}</h1>" if kind < 0.8 else f"<h2>{self.shown(self.title())}</h2>" if kind < 0.9 else ""


def blog(w: Writer) -> str:
    before = w.some(0.7, w.menu) + w.some(0.4, w.top) + w.some(0.3, w.advert) + w.some(0.2, w.notice)
    inside = (f"<header>{w.heading()}</header>" if w.chance(0.25) else w.heading()) + w.blocks(1, 10, (w.advert, w.share, w.side))
    main = w.r.choice(("<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", '<article class="post">{}</article>')).format(inside)
    return before + main + w.some(0.4, w.side) + w.some(0.4, w.replies) + w.some(0.8, w.bottom)


def divisions(w: Writer) -> str:
    before = w.some(0.6, w.top) + w.some(0.8, w.menu) + w.some(0.3, w.notice)
    inside = w.heading() + w.blocks(2, 10, (w.advert, w.share))
    name = w.r.choice(('class="content"', 'id="main"', 'class="post-body"', 'id="article"', 'class="entry-text"'))
    main = f"<div {name}>{inside}</div>"
    if w.chance(0.4):
        main = f"<div><div>{main}</div></div>"
    body = before + main + w.some(0.5, w.side) + w.some(0.3, w.replies) + w.some(0.8, w.bottom)
    return f'<div id="{w.r.choice(("page", "wrapper", "site"))}">{body}</div>' if w.chance(0.6) else body


def table_layout(w: Writer) -> str:
    left = f"<td width=150>{w.links(3, 9)}</td>" if w.chance(0.8) else f'<td class="side">{w.links()}<p>{w.sentence()}</p></td>'
    top = f"<tr><td colspan=2>{w.label()} {w.links(2, 4)}</td></tr>" if w.chance(0.5) else ""
    main = f"<td valign=top>{w.heading()}{w.blocks(2, 9)}</td>"
    foot = f"<tr><td colspan=2><small>Copyright {w.r.randint(1998, 2025)} {w.label()}</small></td></tr>" if w.chance(0.6) else ""
    return f"<table border=0>{top}<tr>{left}{main}</tr>{foot}</table>"


def bare(w: Writer) -> str:
    before = f"<p>{' | '.join(w.anchors(2, 6))}</p>" if w.chance(0.5) else w.some(0.3, w.menu)
    main = w.heading() + w.blocks(1, 9)
    after = f"<hr><p><small>© {w.label()}</small></p>" if w.chance(0.25) else w.some(0.4, w.bottom)
    return before + main + after


def newspaper(w: Writer) -> str:
    before = w.top() + w.some(0.7, w.menu) + w.some(0.5, w.advert) + w.some(0.4, w.notice)
    inside = w.heading() + w.some(0.5, lambda: f'<p class="lead">{w.shown(w.sentence(6, 18))}</p>') + (w.figure() if w.chance(0.5) else "") + w.blocks(2, 10, (w.advert, w.side, w.share, w.notice))
    main = w.r.choice(('<main><section class="story">{}</section></main>', '<article class="story"><div class="body">{}</div></article>', '<div class="article-text">{}</div>')).format(inside)
    return before + main + w.some(0.6, w.side) + w.some(0.4, w.replies) + w.some(0.4, w.advert) + w.some(0.9, w.bottom)


def manual(w: Writer) -> str:
    toc = w.r.choice(('<nav class="toc">{}</nav>', '<div class="sidebar-toc">{}</div>', "<aside><nav>{}</nav></aside>")).format(w.links(4, 12))
    inside = w.heading() + "".join(w.r.choice((w.paragraph, w.terms, w.grid, w.block, w.block))() for _ in range(w.r.randint(2, 9)))
    pager = f'<div class="pager">{w.links(2, 2)}</div>' if w.chance(0.5) else ""
    main = w.r.choice(('<main role="main">{}</main>', '<div role="main">{}</div>', '<section id="content">{}</section>')).format(inside)
    return w.some(0.5, w.top) + toc + main + pager + w.some(0.7, w.bottom)


def encyclopaedia(w: Writer) -> str:
    inside = w.heading() + w.paragraph()
    if w.chance(0.5):
        inside += f'<div class="toc"><h2>{w.label()}</h2>{w.links(3, 7)}</div>'
    for _ in range(w.r.randint(1, 5)):
        inside += f"<h2>{w.shown(w.title())}</h2>" + w.blocks(1, 3)
    if w.chance(0.4):
        inside += f"<ol>{w.items()}</ol>"
    return f'<div id="content"><div id="body-text">{inside}</div></div>' + f'<div id="mw-nav">{w.links(4, 10)}</div>' + w.some(0.8, w.bottom)


def sections(w: Writer) -> str:
    parts = [f"<section>{w.heading() if k == 0 else f'<h2>{w.shown(w.title())}</h2>'}{w.blocks(1, 3)}</section>" for k in range(w.r.randint(1, 4))]
    body = w.some(0.6, w.top) + w.some(0.6, w.menu) + w.r.choice(("<main>{}</main>", '<div class="container">{}</div>', "{}")).format("".join(parts))
    return body + w.some(0.3, w.notice) + w.some(0.4, w.side) + w.some(0.8, w.bottom)


FAMILIES = {f.__name__: f for f in (blog, divisions, table_layout, bare, newspaper, manual, encyclopaedia, sections)}


def page(seed: int, family: str) -> tuple[str, list[str]]:
    """A page and its main text's blocks."""
    w = Writer(seed)
    body = FAMILIES[family](w)
    script = w.some(0.3, lambda: f"<script>var {w.word()} = {w.r.randint(0, 99)};</script>")
    style = w.some(0.3, lambda: f"<style>.{w.word()} {{ color: red }}</style>")
    end = "</body></html>" if w.chance(0.9) else ""
    return f"<!DOCTYPE html><html><head><title>{html.escape(w.title())}</title>{script}{style}</head><body>{body}{end}", w.wanted


def training_pages(n: int, seed: int, families: tuple[str, ...] | None = None) -> list[tuple[str, list[str]]]:
    """``n`` pages, dealt in turn over the families (all of them, if not told otherwise)."""
    names = families or tuple(FAMILIES)
    return [page(seed * 100_003 + k, names[k % len(names)]) for k in range(n)]
