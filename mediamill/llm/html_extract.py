"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

Every block element of a page gets features: its tag and its ancestors', words of its
attributes by meaning, text and link density of its subtree, depth, place among its
siblings and what they are like.  The trees give the log-odds that its subtree holds main
text.  Decoding then takes the most likely labelling in which no kept element stands below
a dropped one, by dynamic programming from the leaves up.

The trees are trained here on pages composed by :func:`compose` (layouts, element names
and attribute words drawn from lists, known labels), ``pages`` many of a fixed seed; the
training set is the classifier's bound and none of it comes from the data.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .dom import Page
from .textkit import slices

#: Words of attributes by what they tell of an element; the lists are features, the trees weigh them.
MEANINGS = {
    "main": "article content main post entry story body text copy prose page hentry blog news reading inner",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs crumbs tabs toc pager pagination sitemap links skip topbar toolbar",
    "head": "header head masthead banner hero logo brand site top",
    "foot": "footer foot copyright legal bottom colophon contentinfo credits imprint",
    "side": "sidebar side aside rail widget related recommended recommendations popular trending more secondary complementary teaser teasers archive tags",
    "advert": "ad ads adv advert advertisement advertising promo promotion sponsor sponsored adsense banner offer commercial dfp",
    "talk": "comment comments reply replies respond discussion disqus feedback thread responses guestbook reader readers",
    "form": "form search login signin signup subscribe subscription newsletter register contact survey poll input",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay dialog banner message privacy notification paywall",
    "share": "share sharing social follow twitter facebook buttons tools print email",
}
_GROUPS = list(MEANINGS)
_MEANING = {}
for _i, _k in enumerate(_GROUPS):
    for _w in MEANINGS[_k].split():
        _MEANING[_w] = _MEANING.get(_w, 0) | 1 << _i
_TAGS = {t: i for i, g in enumerate(("article", "main", "section", "div", "p", "h1 h2", "h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "header", "footer", "aside", "form fieldset", "blockquote pre figure figcaption", "table tbody thead tfoot tr td th")) for t in g.split()}
_HARD = ("nav", "footer", "aside", "form", "header", "article", "main")


def features(page: Page) -> np.ndarray:
    """A row for each node of a page but the root."""
    nodes = page.nodes
    n = len(nodes)
    text, link, links, commas, count, controls, items, paras, heads, mains = ([0.0] * n for _ in range(10))
    for i, x in enumerate(nodes):
        text[i], link[i], links[i], commas[i], controls[i] = x.text, x.link, x.links, x.commas, x.controls
        count[i] = 1
        t = x.tag
        items[i], paras[i], heads[i], mains[i] = t == "li", t == "p", t in ("h1", "h2", "h3"), t in ("article", "main", "h1")
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for a in (text, link, links, commas, count, controls, items, paras, heads, mains):
            a[p] += a[i]
    total = max(1.0, text[0])
    own = [0] * n
    above = [0] * n
    inside = [0] * n
    for i in range(1, n):
        x = nodes[i]
        bits = 0
        for w in x.words:
            bits |= _MEANING.get(w, 0)
        own[i] = bits
        above[i] = above[x.parent] | own[x.parent]
        up = nodes[x.parent].tag
        inside[i] = inside[x.parent] | (1 << _HARD.index(up) if up in _HARD else 0)
    out = np.zeros((n - 1, 17 + len(_GROUPS) * 2 + len(_HARD) + 20))
    seen = 0.0
    groups = len(_GROUPS)
    for i in range(1, n):
        x = nodes[i]
        row = out[i - 1]
        row[_TAGS.get(x.tag, 16)] = 1
        c = 17
        for k in range(groups):
            row[c + k] = own[i] >> k & 1
            row[c + groups + k] = above[i] >> k & 1
        c += 2 * groups
        for k in range(len(_HARD)):
            row[c + k] = inside[i] >> k & 1
        c += len(_HARD)
        p = x.parent
        siblings = nodes[p].children
        rest = max(1, siblings - 1)
        row[c : c + 20] = (
            math.log1p(text[i]),
            text[i] / total,
            link[i] / max(1.0, text[i]),
            text[i] / count[i],
            math.log1p(count[i]),
            commas[i] / max(1.0, text[i]) * 100,
            links[i] / count[i],
            controls[i] > 0,
            paras[i] / count[i],
            items[i] / count[i],
            heads[i],
            mains[i] > 0,
            x.depth,
            x.order / siblings,
            math.log1p(siblings),
            math.log1p((text[p] - text[i]) / rest),
            text[i] / max(1.0, text[p]),
            link[p] / max(1.0, text[p]),
            x.start / page.size,
            seen / total,
        )
        seen += x.text
    return out


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest labelling without a kept node below a dropped one."""
    nodes = page.nodes
    n = len(nodes)
    keep, drop = np.zeros(n), np.zeros(n)
    keep[1:], drop[1:] = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = np.zeros(n, dtype=bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and keep[i] >= drop[i]
    return kept


# --- training pages ---------------------------------------------------------------------------------------------------


class _Composer:
    def __init__(self, r: random.Random):
        self.r, self.out, self.labels = r, [], []

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        made = []
        for _ in range(r.randint(lo, hi)):
            w = "".join(r.choice(("an", "er", "on", "th", "re", "ou", "la", "est", "in", "do", "mi", "ka", "sch", "é")) for _ in range(r.randint(1, 4)))
            made.append(w + (r.choice((",", ".", "")) if r.random() < 0.2 else ""))
        return " ".join(made) + r.choice((".", ".", "", "!"))

    def attr(self, *groups: str) -> str:
        r = self.r
        if not groups or r.random() < 0.1:
            return ""
        w = r.choice(MEANINGS[r.choice(groups)].split())
        if r.random() < 0.4:
            w += r.choice(("-", "_")) + r.choice(("box", "wrap", "1", "container", "area", "item", "list", "block", "section"))
        return f' {r.choice(("class", "class", "id"))}="{w}"'

    def open(self, tag: str, label: int, attr: str = "") -> None:
        self.out.append(f"<{tag}{attr}>")
        self.labels.append(label)

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def leaf(self, tag: str, label: int, text: str, attr: str = "") -> None:
        self.open(tag, label, attr)
        self.out.append(text)
        if tag not in ("p", "li") or self.r.random() < 0.92:
            self.close(tag)

    def linked(self, text: str) -> str:
        return f'<a href="/x">{text}</a>'

    def menu(self, tag: str, attr: str) -> None:
        r = self.r
        self.open(tag, 0, attr)
        if r.random() < 0.75:
            self.open("ul", 0)
            for _ in range(r.randint(2, 12)):
                self.leaf("li", 0, self.linked(self.words(1, 3)))
            self.close("ul")
        else:
            self.out.append(" ".join(self.linked(self.words(1, 2)) for _ in range(r.randint(2, 10))))
        self.close(tag)

    def clutter(self, kind: str) -> None:
        """An element that isn't main text, with all that it holds."""
        r = self.r
        plain = r.choice(("div", "div", "section"))
        if kind == "menu":
            tag = r.choice(("nav", "nav", "div", "ul"))
            self.menu("nav" if tag == "ul" else tag, self.attr("menu") if tag == "div" else r.choice(("", self.attr("menu"))))
        elif kind == "advert":
            tag = r.choice(("div", "div", "aside", "p", "section", "ins"))
            attr = self.attr("advert") or ' class="ad"'
            if tag in ("p", "ins") or r.random() < 0.5:
                self.leaf("div" if tag == "ins" else tag, 0, r.choice((self.words(3, 40), self.linked(self.words(3, 9)))), attr)
            else:
                self.open(tag, 0, attr)
                for _ in range(r.randint(1, 3)):
                    self.leaf(r.choice(("p", "p", "h3", "div")), 0, self.words(3, 50))
                self.close(tag)
        elif kind == "side":
            tag = r.choice(("aside", "aside", "div", "section"))
            self.open(tag, 0, self.attr("side") if tag != "aside" else r.choice(("", self.attr("side"))))
            for _ in range(r.randint(1, 3)):
                self.leaf(r.choice(("h2", "h3", "h4", "p")), 0, self.words(1, 4))
                if r.random() < 0.6:
                    self.open("ul", 0)
                    for _ in range(r.randint(2, 8)):
                        self.leaf("li", 0, self.linked(self.words(2, 8)))
                    self.close("ul")
                else:
                    self.leaf("p", 0, self.words(5, 60))
            self.close(tag)
        elif kind == "talk":
            tag = r.choice((plain, "div", "section", "ol"))
            self.open(tag, 0, self.attr("talk") or ' id="comments"')
            if tag != "ol" and r.random() < 0.7:
                self.leaf(r.choice(("h2", "h3")), 0, self.words(1, 3))
            for _ in range(r.randint(1, 8)):
                inner = "li" if tag == "ol" else r.choice(("div", "article", "p", "div"))
                if inner == "p":
                    self.leaf("p", 0, self.words(4, 60), r.choice(("", self.attr("talk"))))
                    continue
                self.open(inner, 0, r.choice(("", self.attr("talk"), self.attr("talk"))))
                if r.random() < 0.5:
                    self.leaf(r.choice(("div", "h4", "p", "footer")), 0, self.words(1, 4))
                for _ in range(r.randint(1, 3)):
                    self.leaf("p", 0, self.words(4, 70))
                self.close(inner)
            self.close(tag)
        elif kind == "form":
            self.open("form", 0, r.choice(("", self.attr("form"))))
            for _ in range(r.randint(0, 2)):
                self.leaf(r.choice(("p", "div", "h3")), 0, f"<label>{self.words(1, 12)}</label><input name=q>")
            self.out.append(f"<label>{self.words(1, 4)}</label> <input type=text><button>{self.words(1, 2)}</button>")
            self.close("form")
        elif kind == "notice":
            tag = r.choice(("div", "div", "section", "aside", "p"))
            attr = self.attr("notice") or ' class="cookie-notice"'
            if tag == "p" or r.random() < 0.5:
                self.leaf(tag, 0, self.words(5, 45), attr)
            else:
                self.open(tag, 0, attr)
                for _ in range(r.randint(1, 2)):
                    self.leaf("p", 0, self.words(5, 45))
                self.close(tag)
        elif kind == "share":
            self.menu(r.choice(("div", "ul", "p", "div")) if r.random() < 0.5 else "div", self.attr("share") or ' class="share"')
        elif kind == "foot":
            tag = r.choice(("footer", "footer", "footer", "div"))
            self.open(tag, 0, self.attr("foot") if tag == "div" else r.choice(("", "", self.attr("foot"))))
            for _ in range(r.randint(0, 2)):
                self.leaf(r.choice(("p", "div", "p")), 0, r.choice((self.words(3, 40), " | ".join(self.linked(self.words(1, 2)) for _ in range(4)))))
            self.out.append("&copy; " + self.words(2, 16))
            self.close(tag)
        else:
            tag = r.choice(("header", "header", "div"))
            self.open(tag, 0, self.attr("head") if tag == "div" else r.choice(("", self.attr("head"))))
            if r.random() < 0.7:
                self.leaf(r.choice(("h1", "div", "p", "h2")), 0, r.choice((self.words(1, 4), self.linked(self.words(1, 3)))), r.choice(("", self.attr("head"))))
            if r.random() < 0.4:
                self.leaf("p", 0, self.words(3, 9))
            if r.random() < 0.4:
                self.menu("nav", "")
            self.close(tag)

    def body(self) -> None:
        """Main text, with clutter among it now and then."""
        r = self.r
        if r.random() < 0.85:
            if r.random() < 0.2:
                self.open("header", 1)
                self.leaf("h1", 1, self.words(2, 12))
                if r.random() < 0.3:
                    self.leaf("p", 1, self.words(4, 25))
                self.close("header")
            else:
                self.leaf(r.choice(("h1", "h1", "h1", "h2")), 1, self.words(2, 12))
        for _ in range(r.choice((0, 1, 1, 2, 3, 4, 5, 6, 8, 12, 20, 30))):
            k = r.random()
            if k < 0.68:
                text = self.words(1, r.choice((8, 40, 90, 160)))
                if r.random() < 0.25:
                    text = f"<b>{text}" + r.choice(("</b>", "<br>", "</b><br>" + self.words(2, 20)))
                elif r.random() < 0.2:
                    text += " " + self.linked(self.words(1, 4)) + " " + self.words(2, 20)
                self.leaf("p", 1, text)
            elif k < 0.78:
                self.leaf(r.choice(("h2", "h3", "h4")), 1, self.words(1, 9))
            elif k < 0.83:
                self.open("ul", 1)
                for _ in range(r.randint(2, 7)):
                    self.leaf("li", 1, self.words(1, 25))
                self.close("ul")
            elif k < 0.87:
                self.open("blockquote", 1)
                self.leaf("p", 1, self.words(5, 60))
                self.close("blockquote")
            elif k < 0.89:
                self.open("figure", 1)
                self.out.append("<img src=x>")
                self.leaf("figcaption", 1, self.words(3, 20))
                self.close("figure")
            elif k < 0.91:
                self.leaf("pre", 1, self.words(5, 40))
            elif k < 0.93:
                self.open("table", 1)
                for _ in range(r.randint(1, 4)):
                    self.open("tr", 1)
                    for _ in range(r.randint(1, 4)):
                        self.leaf("td", 1, self.words(1, 5))
                    self.close("tr")
                self.close("table")
            elif k < 0.95:
                self.open("div", 1)
                for _ in range(r.randint(1, 3)):
                    self.leaf("p", 1, self.words(5, 80))
                self.close("div")
            else:
                self.clutter(r.choice(("advert", "advert", "share", "side", "form", "notice")))
        if r.random() < 0.1:
            self.clutter(r.choice(("talk", "share", "side")))


def compose(seed: int) -> tuple[str, list[int]]:
    """A page and a label for each of its block elements in page order: 1 where its subtree holds main text."""
    r = random.Random(seed)
    c = _Composer(r)
    c.out.append("<!DOCTYPE html><html><head><title>t</title></head><body>")
    for kind, p in (("notice", 0.25), ("head", 0.45), ("menu", 0.6), ("advert", 0.4), ("form", 0.15)):
        if r.random() < p:
            c.clutter(kind)
    shells: list[str] = []
    for _ in range(r.choice((0, 0, 1, 1, 2))):
        tag = r.choice(("div", "div", "main", "section"))
        if tag == "main" and "main" in shells:
            tag = "div"
        c.open(tag, 1, r.choice(("", c.attr("main"), ' id="wrapper"', ' class="container"', ' class="row"')))
        shells.append(tag)
        if r.random() < 0.15:
            c.clutter(r.choice(("side", "menu", "advert", "notice")))
    kind = r.choice(("article", "article", "article", "main", "div", "div", "section", ""))
    if kind == "main" and "main" in shells:
        kind = "article"
    if kind:
        c.open(kind, 1, r.choice(("", "", c.attr("main"))) if kind in ("article", "main") else c.attr("main") or ' class="content"')
    c.body()
    if kind:
        c.close(kind)
    for kind, p in (("share", 0.15), ("talk", 0.3), ("side", 0.3), ("advert", 0.2)):
        if r.random() < p:
            c.clutter(kind)
    for tag in reversed(shells):
        c.close(tag)
    for kind, p in (("talk", 0.12), ("side", 0.25), ("form", 0.12), ("advert", 0.15), ("foot", 0.75), ("notice", 0.15)):
        if r.random() < p:
            c.clutter(kind)
    c.out.append("</body></html>")
    return "".join(c.out), c.labels


@lru_cache(maxsize=2)
def trained(pages: int = 1200, seed: int = 1) -> boosting.Trees:
    """The trees; the same every time."""
    xs, ys = [], []
    for i in range(pages):
        source, labels = compose(seed * 1_000_003 + i)
        page = Page(source)
        if len(page.nodes) - 1 == len(labels):
            # an element that holds no main text at all is no main text
            xs.append(features(page))
            ys.append(np.array(labels, dtype=float))
    y = np.concatenate(ys)
    return boosting.fit(np.concatenate(xs), y)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``id_col, url_col, text, n_chars``: main text of every page.

    Null or empty html, and a page without main text, give an empty text.  Rows are kept one
    for one, repeated and null identifiers included.
    """
    held = pages.sparkSession.sparkContext.broadcast(trained())
    frame = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for b in batches:
            for lo, hi, _, _ in slices(b.column(2)):
                texts = main_texts(b.column(2).slice(lo, hi - lo).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return frame.mapInArrow(run, "id long, url string, text string, n_chars long").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def main_texts(sources: list[str | None], trees: boosting.Trees | None = None) -> list[str]:
    trees = trees or trained()
    parsed = [Page(s or "") for s in sources]
    rows = [features(p) for p in parsed]
    odds = trees.margin(np.concatenate(rows)) if any(len(r) for r in rows) else np.zeros(0)
    out, at = [], 0
    for p, r in zip(parsed, rows, strict=True):
        out.append(p.content(decode(p, odds[at : at + len(r)])))
        at += len(r)
    return out
