"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded hierarchically.

No table labels page elements, so the trees are trained on pages composed here, of many layouts, with
and without telling element names and class names, whose elements know whether they are the article.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import dom, words
from lectern.llm.boosting import Boosted, boost

#: Composed pages to train on, their seed, and elements that are scored together.
TRAINING_PAGES, SEED, BATCH = 1200, 31, 40_000


class _Composer:
    """Composes one page from random parts; data-gold marks what is the article (1) and what is not (0)."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.script = rng.choices(["latin", "spaced", "dense"], [0.64, 0.18, 0.18])[0]
        if self.script == "latin":
            syllables = ["".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randrange(1, 3))) for _ in range(60)]
            self.lexicon = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(300)]
        else:  # alphabets beyond ASCII, and scripts without blanks between words
            alphabets, longest = (((0x430, 32), (0x3B1, 24), (0x627, 36), (0x905, 52), (0x5D0, 26)), 10) if self.script == "spaced" else (((0x4E00, 3000), (0x3042, 80), (0xAC00, 3000)), 3)
            first, n = rng.choice(alphabets)
            self.lexicon = ["".join(chr(first + rng.randrange(n)) for _ in range(rng.randrange(2 if longest > 3 else 1, longest + 1))) for _ in range(300)]
        self.named = rng.random() < 0.75
        self.semantic = rng.random() < 0.65

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, lo: int, hi: int) -> str:
        w = self.rng.choices(self.lexicon, k=self.rng.randrange(lo, hi + 1))
        for k in range(6, len(w), self.rng.randrange(5, 14)):
            w[k] += self.rng.choice(["\u3002", "\u3001", "\u3001", "\u3002"] if self.script == "dense" else [".", ",", ",", "."])
        return "".join(w) if self.script == "dense" else " ".join(w).capitalize()

    def sentence(self, lo: int = 4, hi: int = 18) -> str:
        return self.words(lo, hi) + ("\u3002" if self.script == "dense" else ".")

    def paragraph(self, lo: int = 5, hi: int = 140) -> str:
        text = self.sentence(lo, hi)
        if self.chance(0.2):
            text += f' <a href="/{self.words(1, 1)}">{self.words(1, 4)}</a> {self.words(2, 9)}.'
        if self.chance(0.1):
            text = f"<em>{self.words(1, 5)}</em> {text}"
        return text

    def name(self, *choices: str) -> str:
        """A class or id attribute: one of the choices, or an opaque one."""
        if self.named and self.chance(0.9):
            return f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(choices)}"'
        return f' class="c{self.rng.randrange(1000)}"' if self.chance(0.5) else ""

    def layout(self) -> str:
        """A class attribute that names other parts of the page without being one: what its layout has or lacks."""
        part = self.rng.choice(dom.TOKENS[self.rng.choice([g for g in dom.GROUPS if g != "good"])].split())
        before, after = self.rng.choice(["has", "no", "with", "layout", "is", "col"]), self.rng.choice(["content", "left", "right", "on", "fixed", "wrap", "main"])
        name = self.rng.choice([f"{before}-{part}", f"{part}-{after}", f"{before}-{part}-{after}", f"{self.words(1, 1).strip('.,').lower()}-{part}", f"{before}-{after} {part}"])
        return f' {self.rng.choice(["class", "class", "id"])}="{name}"'

    def tag(self, semantic: str, plain: str = "div") -> str:
        return semantic if self.semantic and self.chance(0.85) else plain

    def links(self, lo: int, hi: int) -> str:
        n, style = self.rng.randrange(lo, hi + 1), self.rng.randrange(3)
        items = [f'<a href="/{k}">{self.words(1, 4 if self.chance(0.6) else 9)}</a>' for k in range(n)]
        return ["<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>", " | ".join(items), "".join(f"<div>{a}</div>" for a in items)][style]

    def wrap(self, tag: str, attributes: str, inner: str, gold: int = 0) -> str:
        return f'<{tag}{attributes} data-gold="{gold}">{inner}</{tag}>'

    def menu(self) -> str:
        return self.wrap(self.tag("nav"), self.name("drawer", "hamburger", "nav", "menu", "main-menu", "navbar", "topnav", "breadcrumb"), self.links(2, 12))

    def header(self) -> str:
        inner = f'<a href="/">{self.words(1, 3)}</a>' + (f"<p>{self.words(3, 9)}</p>" if self.chance(0.5) else f"<h1>{self.words(1, 3)}</h1>" if self.chance(0.3) else "")
        return self.wrap(self.tag("header"), self.name("header", "site-header", "masthead", "topbar", "logo"), inner + (self.menu() if self.chance(0.5) else "") + (self.form() if self.chance(0.2) else ""))

    def footer(self) -> str:
        inner = "&copy; 2020 " + self.words(1, 4) + (f" &middot; {self.sentence()}" if self.chance(0.5) else "") + (f"<p>{self.paragraph(5, 40)}</p>" if self.chance(0.4) else "") + (self.links(2, 9) if self.chance(0.5) else "")
        return self.wrap(self.tag("footer"), self.name("colophon", "footer", "site-footer", "copyright", "bottom"), inner)

    def advert(self) -> str:
        inner = self.sentence(2, 20) if self.chance(0.6) else f"<p>{self.sentence(3, 25)}</p>" + (f'<a href="/x">{self.words(1, 3)}</a>' if self.chance(0.5) else "")
        return self.wrap(self.tag("aside") if self.chance(0.2) else "div", self.name("skyscraper", "leaderboard", "mpu", "ad", "ads", "advert", "banner-ad", "sponsored", "promo", "ad-slot"), inner)

    def notice(self) -> str:
        inner = f"<p>{self.sentence(5, 40)}</p>" + (f"<button>{self.words(1, 2)}</button>" if self.chance(0.6) else "") + (f'<a href="/p">{self.words(1, 3)}</a>' if self.chance(0.5) else "")
        role = ' role="alert"' if self.chance(0.2) else ' role="dialog"' if self.chance(0.2) else ""
        return self.wrap("div", self.name("cookie-notice", "cookie-banner", "notice", "consent", "alert", "gdpr", "popup", "disclaimer") + role, inner)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 5)}</label><input type=text><button>{self.words(1, 2)}</button>" + (f"<p>{self.sentence(3, 20)}</p>" if self.chance(0.5) else "") + (f"<h3>{self.words(1, 4)}</h3>" if self.chance(0.3) else "")
        return self.wrap("form", self.name("mailing", "paywall", "newsletter", "subscribe", "search-form", "login", "signup"), inner)

    def sidebar(self) -> str:
        parts = []
        for _ in range(self.rng.randrange(1, 5)):
            kind = self.rng.randrange(4)
            body = self.links(3, 8) if kind < 2 else f"<p>{self.paragraph(5, 50)}</p>" if kind == 2 else "".join(f"<div><h4><a href='/{k}'>{self.words(2, 8)}</a></h4><p>{self.sentence(4, 22)}</p></div>" for k in range(self.rng.randrange(2, 5)))
            parts.append(f"<div{self.name('widget', 'box', 'related', 'popular-posts')}><h3>{self.words(1, 4)}</h3>{body}</div>")
        return self.wrap(self.tag("aside"), self.name("sidebar", "side", "widget-area", "related-posts", "rail"), "".join(parts))

    def comments(self) -> str:
        one = lambda: f"<{item}{cls}><b>{self.words(1, 2)}</b> {'<span>' + self.words(2, 4) + '</span>' if self.chance(0.5) else ''}<p>{self.paragraph(3, 60)}</p>" + (f'<a href="#r">{self.words(1, 1)}</a>' if self.chance(0.5) else "") + f"</{item}>"
        item, cls = ("li" if self.chance(0.5) else "div"), self.name("shoutbox", "comment", "reply", "comment-body")
        body = "".join(one() for _ in range(self.rng.randrange(1, 8)))
        body = f"<ol>{body}</ol>" if item == "li" else body
        return self.wrap(self.tag("section"), self.name("comments", "comment-list", "disqus_thread", "responses", "discussion"), f"<h2>{self.words(1, 4)}</h2>{body}" + (self.form() if self.chance(0.5) else ""))

    def share(self) -> str:
        return self.wrap("div", self.name("share", "social", "share-buttons", "tags", "byline", "author-bio"), self.links(2, 6) if self.chance(0.6) else f"<p>{self.sentence(3, 20)}</p>")

    def article(self) -> str:
        gold = ' data-gold="1"'
        out = []
        title = f"<h1{gold}>{self.words(2, 12)}</h1>" if self.chance(0.9) else ""
        if title and self.semantic and self.chance(0.2):
            title = f"<header{gold}>{title}</header>"
        if self.chance(0.3):
            out.append(self.share())
        loose, broken = self.chance(0.12), self.chance(0.3)
        tiny = self.chance(0.3)
        n = self.rng.randrange(1, 4) if tiny or self.chance(0.25) else self.rng.randrange(3, 16)
        for _ in range(n):
            kind = self.rng.random()
            if kind < 0.78:
                text = self.paragraph() if not tiny and self.chance(0.8) else self.sentence(1, 16)
                if loose:
                    out.append(f"{text}<br><br>" if self.chance(0.5) else f"<div{gold}>{text}</div>")
                elif broken and self.chance(0.3):
                    out.append(f"<p{gold}><b>{text}<br>")
                else:
                    out.append(f"<p{gold}>{text}</p>")
            elif kind < 0.84:
                out.append(f"<h{self.rng.randrange(2, 5)}{gold}>{self.words(1, 8)}</h2>")
            elif kind < 0.89:
                out.append(f"<ul{gold}>" + "".join(f"<li>{self.sentence(2, 22)}</li>" for _ in range(self.rng.randrange(2, 6))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote{gold}><p>{self.paragraph(5, 50)}</p></blockquote>")
            elif kind < 0.94:
                out.append(f"<table{gold}>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.97:
                out.append(f"<figure{gold}><img src=a><figcaption>{self.sentence(2, 14)}</figcaption></figure>")
            else:
                out.append(self.advert() if self.chance(0.5) else self.form() if self.chance(0.3) else self.notice() if self.chance(0.3) else self.sidebar() if self.chance(0.2) else self.menu())
        out += [f() for f, p in ((self.share, 0.2), (self.sidebar, 0.08), (self.comments, 0.08)) if self.chance(p)]
        body = title + "".join(out)
        if self.chance(0.5):
            body = f"<div{self.layout() if self.chance(0.1) else self.name('content', 'entry-content', 'post-body', 'article-body', 'text')}{gold}>{body}</div>"
        names = self.layout() if self.chance(0.1) else self.name("article", "post", "entry", "story", "main-content", "content")
        return f"<{self.tag('article')}{names}{gold}>{body}</" + "div></article>"

    def bare(self) -> str:
        """An article alone or nearly so: paragraphs right in the body or in plain wrappers, a single one, or text without any element."""
        gold = ' data-gold="1"'
        if self.chance(0.1):
            return "<br>".join(self.paragraph(10, 140) for _ in range(self.rng.randrange(1, 4)))
        tag = "p" if self.chance(0.7) else "div"
        n = 1 if self.chance(0.5) else self.rng.randrange(2, 9)
        body = f"<{tag}{gold}>{self.paragraph(12, 140)}</{tag}>" + "".join(f"<{tag}{gold}>{self.paragraph(4, 120)}</{tag}>" for _ in range(n - 1))
        title = f"<h1{gold}>{self.words(2, 10)}</h1>" if self.chance(0.4) else ""
        for _ in range(self.rng.randrange(0, 3)):
            body = f"<{self.tag('article')}{self.layout() if self.chance(0.3) else ''}{gold}>{body}</div></article>"
        if self.chance(0.35):
            return title + body
        body = f"{self.menu() if self.chance(0.4) else ''}{title}{body}{self.footer() if self.chance(0.4) else ''}"
        return f"<html><body>{self.wrap('form', '', body) if self.chance(0.1) else body}"

    def page(self) -> str:
        if self.chance(0.2):
            return self.bare()
        some = lambda *parts: "".join(f() for f, p in parts if self.chance(p))
        above = some((self.notice, 0.25), (self.header, 0.6), (self.menu, 0.7), (self.advert, 0.4), (self.form, 0.1), (self.sidebar, 0.15))
        below = some((self.share, 0.2), (self.comments, 0.4), (self.sidebar, 0.4), (self.advert, 0.25), (self.form, 0.2), (self.footer, 0.85), (self.notice, 0.15))
        main = self.article()
        if self.chance(0.35):
            main = f"<{self.tag('main')}{self.name('main', 'container', 'wrapper', 'page')}>{some((self.menu, 0.15), (self.advert, 0.2))}{main}{some((self.sidebar, 0.2), (self.comments, 0.2))}</div></main>"
        if self.chance(0.08):  # what the layout has or lacks, said of the article's surroundings or of the whole page
            main = self.wrap("div", self.layout(), main)
        body = above + main + below
        if self.chance(0.1):
            body = self.wrap("div", self.layout(), body)
        if self.chance(0.07):  # servers that put every page into one form
            body = self.wrap("form", self.layout() if self.chance(0.2) else self.name("page", "main", "aspnet", "wrapper"), body)
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>"


def training_set(pages: int = TRAINING_PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements with text of composed pages; an element is main when it stands in the article and is not cut from it."""
    rng = random.Random(seed)
    blocks = dom.Blocks()
    for k in range(pages):
        page = _Composer(rng).page()
        dom.add_page(blocks, k, page, training=True, gold=int("<" not in page.replace("<br>", "").replace("<a ", "").replace("</a>", "").replace("<em>", "").replace("</em>", "")))
    total = np.concatenate(([0], np.cumsum(blocks.chars)))
    index = np.arange(len(blocks.chars))
    some = total[np.maximum(np.array(blocks.end), index + 1)] > total[index]
    return dom.features(blocks)[some], np.array(blocks.gold, float)[some]


@functools.cache
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Boosted:
    return boost(*training_set(pages, seed), trees=80)


def main_texts(sources: list[str | None], model: Boosted) -> list[str]:
    """Main text of each page, one line a block."""
    out: list[str] = []
    at = 0
    while at < len(sources):
        blocks, first = dom.Blocks(), at
        while at < len(sources) and (at == first or len(blocks.page) < BATCH):
            dom.add_page(blocks, at - first, sources[at] or "")
            at += 1
        keep = dom.decode(blocks, model.margin(dom.features(blocks)))
        out += ["\n".join([text for block, text in runs if keep[block]]) for runs in blocks.runs]
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points of text).

    The whole html is parsed, however broken: what is no tag is text, unclosed elements end with their
    parent. Character references are decoded, white space inside a block becomes one space, blocks follow
    each other in page order, joined by a newline.

    Defined cases: null or empty html, and a page on which nothing looks like an article, have empty text;
    rows are independent, so repeated ids, nulls in other columns and other columns do not matter; an
    empty table gives an empty result.
    """
    model = trained()
    words.bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                text = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
