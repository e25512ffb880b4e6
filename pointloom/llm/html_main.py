"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded hierarchically.

A tolerant parser turns a page into elements; those that are blocks, or carry a class or id, are
nodes. Trees give each node scores for three classes: CONTAINER (holds main text and other things),
MAIN and BOILERPLATE. Decoding takes the labelling of highest total score in which a child of MAIN is
MAIN or BOILERPLATE and a child of BOILERPLATE is BOILERPLATE, by dynamic programming from the leaves.

The trees are fitted, in each driver process once, to PAGES invented pages of many layouts, whose nodes' classes are
known as they are made; no row of the input is used.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .boosting import Boosted, fit

CONTAINER, MAIN, BOILERPLATE = range(3)
PAGES, SEED = 400, 5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<[a-zA-Z/!?][^>]*+\Z|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_PART = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre section select summary table caption colgroup tbody td tfoot th thead tr ul button noscript template svg canvas object video audio label".split())
#: An element that closes an open one of these before it opens, up to the nearest of the bounds.
_CLOSES = {t: ({"p"}, {"body", "div", "article", "section", "main", "td", "th", "li", "button"}) for t in "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
_CLOSES |= {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_DROPPED = frozenset("script style textarea title iframe noembed noframes xmp head select option button template svg canvas object video audio noscript".split())
#: Elements that leave an open head open; any other element, or text, ends it.
_IN_HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template".split())
#: Words in class, id and role by what they tell (fixed values).
_TELLS = [
    frozenset("article body content entry main post story text prose page copy paragraph hentry".split()),
    frozenset("nav navigation menu navbar breadcrumb breadcrumbs pagination pager tabs topbar toc".split()),
    frozenset("ad ads advert advertisement adverts banner promo promotion sponsor sponsored sponsors sponsorship partner adsense".split()),
    frozenset("comment comments commentlist reply replies respond discussion disqus feedback reviews".split()),
    frozenset("sidebar aside widget widgets related recommended recommendations popular trending rail more".split()),
    frozenset("footer header masthead copyright legal bottom top colophon site brand logo".split()),
    frozenset("cookie cookies consent notice notices alert popup modal overlay gdpr newsletter subscribe signup login search form share social sharing toolbar".split()),
]
_TAGS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "ul", "li", "table", "body", "html", "h1", "h2", "h3", "blockquote", "pre"]
_TAG = {t: i for i, t in enumerate(_TAGS)}


class Page:
    """tag, parent, tells, attributes of nodes; texts: (block, node, raw text) in page order.

    label, given for invented pages only, tells a node's class from its attributes; pages of a crawl
    are read without one, whatever attributes they have."""

    def __init__(self, source: str, label: Callable[[str], int | None] | None = None):
        self.tag, self.parent, self.tells, self.depth, self.labels = ["#"], [-1], [0], [0], [None]
        self.size, self.linked, self.commas = [0], [0], [0]
        self.texts: list[tuple[int, int, str]] = []
        stack: list[tuple[str, int]] = [("#", 0)]  # open elements and the node each text in it belongs to
        block = links = dropped = 0
        at, n = 0, len(source)
        match = _TOKEN.match

        def shut(k):
            nonlocal links, dropped
            for closed, _ in stack[k:]:
                links -= closed == "a"
                dropped -= closed in _DROPPED
            del stack[k:]

        while at < n:
            m = match(source, at)
            at = m.end()
            name = m[2]
            if name is None:
                text = m[0]
                if text[0] == "<" and len(text) > 1:
                    continue
                if stack[-1][0] == "head" and not text.isspace():
                    shut(len(stack) - 1)
                if dropped:
                    continue
                node = stack[-1][1]
                size = len(text.strip())
                if size:
                    self.size[node] += size
                    self.commas[node] += text.count(",")
                    if links:
                        self.linked[node] += size
                self.texts.append((block, node, text))
                continue
            name = name.lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        shut(k)
                        break
                block += name in _BLOCK
                continue
            if stack[-1][0] == "head" and name not in _IN_HEAD:
                shut(len(stack) - 1)
            if name == "br":
                if not dropped:
                    self.texts.append((block, stack[-1][1], " "))
                continue
            if name in _CLOSES:
                closes, bounds = _CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closes:
                        shut(k)
                        break
                    if stack[k][0] in bounds:
                        break
            is_block = name in _BLOCK
            block += is_block
            attributes = m[3]
            node = stack[-1][1]
            if not dropped and name not in _DROPPED and (is_block or "class" in attributes or "id=" in attributes):
                tells = 0
                if attributes.strip(" /"):
                    for key, a, b, c in _ATTRIBUTE.findall(attributes):
                        key = key.lower()
                        if key in ("class", "id", "role"):
                            for part in _PART.findall((a or b or c).lower()):
                                for i, known in enumerate(_TELLS):
                                    if part in known:
                                        tells |= 1 << i
                parent, node = node, len(self.tag)
                self.tag.append(name)
                self.parent.append(parent)
                self.tells.append(tells)
                self.depth.append(self.depth[parent] + 1)
                self.labels.append(label(attributes) if label else None)
                for x in (self.size, self.linked, self.commas):
                    x.append(0)
            if name in _VOID or attributes.endswith("/") and not is_block:
                continue
            if name in _RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                at = close.start() if close else n
                if not close:
                    break
                at = source.find(">", at) + 1 or n
                continue
            links += name == "a"
            dropped += name in _DROPPED
            stack.append((name, node))

    def features(self) -> np.ndarray:
        """A row for each node: depth, tag, tells of it and above it, text and link density of its subtree, siblings."""
        n = len(self.tag)
        size, linked, commas = list(self.size), list(self.linked), list(self.commas)
        children, under, deepest, paragraphs, index, same = [0] * n, [0] * n, list(self.depth), [0] * n, [0] * n, [0] * n
        above_tell, above_tag = [0] * n, [0] * n
        before, so_far = [0] * n, 0
        counts: dict[tuple[int, str], int] = {}
        for i in range(n):
            before[i] = so_far
            so_far += self.size[i]
            p = self.parent[i]
            if p >= 0:
                index[i] = children[p]
                children[p] += 1
                key = (p, self.tag[i])
                same[i] = counts[key] = counts.get(key, 0) + 1
                above_tell[i] = above_tell[p] | self.tells[p]
                above_tag[i] = above_tag[p] | 1 << _TAG.get(self.tag[p], len(_TAGS))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            size[p] += size[i]
            linked[p] += linked[i]
            commas[p] += commas[i]
            under[p] += under[i] + 1
            paragraphs[p] += paragraphs[i] + (self.tag[i] == "p")
            deepest[p] = max(deepest[p], deepest[i])
        whole = max(size[0], 1)
        rows = []
        for i in range(n):
            p = max(self.parent[i], 0)
            tag, tells, over, tags = _TAG.get(self.tag[i], -1), self.tells[i], above_tell[i], above_tag[i]
            rows.append((
                self.depth[i], tag, tells, math.log1p(size[i]), linked[i] / max(size[i], 1), size[i] / whole, size[i] / max(size[p], 1), commas[i] / max(size[i], 1),
                children[i], under[i], deepest[i] - self.depth[i], paragraphs[i], index[i], children[p], same[i], before[i] / whole, self.size[i] / max(size[i], 1), size[i] / (under[i] + 1),
                tags & 31 != 0, tags >> 5 & 3 != 0, tags >> 11 & 1, *(tag == k for k in range(10)), *(tells >> k & 1 for k in range(len(_TELLS))), *(over >> k & 1 for k in range(len(_TELLS))),
            ))
        return np.array(rows, np.float64)

    def decode(self, scores: np.ndarray) -> list[int]:
        """The allowed labelling of highest total score; ties go to BOILERPLATE, then MAIN."""
        n = len(self.tag)
        total = scores.tolist()
        for i in range(n - 1, 0, -1):
            c, m, b = total[i]
            up = total[self.parent[i]]
            up[CONTAINER] += max(c, m, b)
            up[MAIN] += max(m, b)
            up[BOILERPLATE] += b
        out = [0] * n
        for i in range(n):
            c, m, b = total[i]
            over = out[self.parent[i]] if i else CONTAINER
            if over == BOILERPLATE or b >= m and (b >= c or over == MAIN):
                out[i] = BOILERPLATE
            else:
                out[i] = MAIN if over == MAIN or m >= c else CONTAINER
        return out

    def text(self, labels: list[int]) -> str:
        lines, now, parts = [], -1, []
        for block, node, text in self.texts:
            if labels[node] != MAIN:
                continue
            if block != now:
                if parts:
                    lines.append("".join(parts))
                now, parts = block, []
            parts.append(text)
        lines.append("".join(parts))
        kept = (" ".join(html.unescape(x).split()) for x in lines)
        return "\n".join(x for x in kept if x)


def _invented(r: random.Random) -> str:
    """A page of a random layout; data-y holds the class of each node that needs one (else its parent's)."""
    vocabulary = ["".join(r.choice("aeiou" if k % 2 else "bcdlmnprst") for k in range(r.randint(2, 9))) for _ in range(300)]
    say = lambda a, b: " ".join(r.choice(vocabulary) + ("," if r.random() < 0.06 else "") for _ in range(r.randint(a, b))).capitalize() + "."
    some = lambda *x: r.choice(x)
    maybe = lambda p, x: x() if r.random() < p else ""
    y = lambda c: f' data-y="{c}"'
    link = lambda: f'<a href="/{r.choice(vocabulary)}">{say(1, 4)[:-1]}</a>'
    items = lambda a, b: "".join(f"<li>{link() if r.random() < 0.9 else say(2, 6)}</li>" for _ in range(r.randint(a, b)))

    def named(tag, kind, inner, c, p=0.8):
        attribute = some("class", "id") if r.random() < p else None
        kind = r.choice(kind) + (some("", " wide", f" x{r.randint(1, 9)}", " box") if r.random() < 0.5 else "")
        return f"<{tag}" + (f' {attribute}="{kind}"' if attribute else "") + f"{y(c)}>{inner}</{tag}>"

    def boiler():
        return some(
            lambda: named(some("nav", "div", "header"), ["nav", "main-menu", "navbar", "breadcrumbs"], f"<ul>{items(3, 12)}</ul>", 2, 1),
            lambda: f"<nav{y(2)}><ul>{items(2, 10)}</ul></nav>",
            lambda: named("div", ["ad", "advert", "ad-banner", "sponsored", "promo"], say(2, 40), 2, 1),
            lambda: named(some("aside", "div"), ["sidebar", "related", "widget", "popular"], f"<h3>{say(1, 3)}</h3><ul>{items(2, 8)}</ul>" + maybe(0.4, lambda: f"<p>{say(5, 40)}</p>"), 2, 1),
            lambda: f"<aside{y(2)}><p>{say(3, 60)}</p></aside>",
            lambda: named(some("form", "div"), ["search-form", "newsletter", "login", "subscribe"], f"<label>{say(1, 3)}</label><input name=q>", 2, 1),
            lambda: f"<form{y(2)}><p>{say(2, 20)}</p><input></form>",
            lambda: named("div", ["cookie-notice", "notice", "cookie-consent", "alert"], f"<p>{say(4, 40)}</p>", 2, 1),
            lambda: named("div", ["share", "social", "toolbar"], link() + link(), 2, 1),
        )()

    def header():
        return some(
            lambda: f"<header{y(2)}><h1>{say(1, 4)}</h1>" + maybe(0.5, lambda: f"<p>{say(2, 12)}</p>") + "</header>",
            lambda: named("div", ["header", "masthead", "site-header"], f"<p>{say(1, 8)}</p>", 2, 1),
            boiler,
        )()

    def footer():
        return some(
            lambda: f"<footer{y(2)}>&copy; {say(2, 20)}</footer>",
            lambda: f"<footer{y(2)}><p>{say(2, 30)}</p>{link()}</footer>",
            lambda: named("div", ["footer", "site-footer", "copyright"], say(2, 25), 2, 1),
        )()

    def comments():
        one = lambda: named("div", ["comment", "reply"], f"<p>{say(3, 60)}</p>", 2)
        return named(some("section", "div", "ol"), ["comments", "comment-list", "discussion", "comments-area"], f"<h3>{say(1, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))), 2, 1)

    def paragraph():
        return some(
            *[lambda: f"<p>{say(1, some(6, 30, 120, 300))}</p>"] * 8,
            lambda: f"<p><b>{say(1, 30)}<br>",
            lambda: f"<h2>{say(1, 8)}</h2><p>{say(4, 60)}</p>",
            lambda: f"<ul>{''.join(f'<li>{say(2, 15)}</li>' for _ in range(r.randint(2, 6)))}</ul>",
            lambda: f"<blockquote><p>{say(4, 40)}</p></blockquote>",
            lambda: f"<table><tr><td>{say(1, 5)}</td><td>{say(1, 5)}</td></tr></table>",
            lambda: f"<pre>{say(2, 20)}</pre>",
            lambda: f"<p>{say(2, 20)} {link()} {say(2, 20)}</p>",
            lambda: f"<figure><figcaption>{say(2, 10)}</figcaption></figure>",
        )()

    def article():
        body = "".join(paragraph() for _ in range(some(1, 1, 2, 3, 5, 9, 16)))
        inside = maybe(0.25, lambda: some(boiler, boiler, comments)())
        inner = maybe(0.8, lambda: f"<h1>{say(1, 14)}</h1>") + body + inside + (paragraph() if inside and r.random() < 0.5 else "")
        how = r.random()
        if how < 0.5:
            return f"<article{y(1)}>{inner}</article>"
        if how < 0.62:
            return f"<main{y(1)}>{inner}</main>"
        if how < 0.9:
            return named(some("div", "section"), ["content", "post", "entry-content", "article-body", "story", "main-text", "post-body"], inner, 1, 1)
        return f"<div{y(1)}>{inner}</div>"

    if r.random() < 0.06:  # no more than some paragraphs
        return maybe(0.5, lambda: "<html><body>") + "".join(f"<p{y(1)}>{say(1, some(3, 40))}</p>" for _ in range(r.randint(1, 4)))
    middle = article()
    if r.random() < 0.35:
        middle = some(f"<main{y(0)}>", f'<div class="wrapper"{y(0)}>', f"<div{y(0)}>", f'<div id="page"{y(0)}>') + maybe(0.5, boiler) + middle + maybe(0.4, boiler) + maybe(0.2, comments) + "</div>"
    parts = [maybe(0.7, header), maybe(0.6, boiler), maybe(0.4, boiler), middle, maybe(0.3, comments), maybe(0.5, boiler), maybe(0.8, footer)]
    tail = "" if r.random() < 0.1 else "</body></html>"
    return f"<!DOCTYPE html><html{y(0)}><head><title>{say(1, 8)}</title><style>p{{}}</style></head><body{y(0)}>" + "".join(parts) + tail


def invented(r: random.Random) -> Page:
    """An invented page, parsed, with its nodes' classes in labels."""
    page = Page(_invented(r), lambda attributes: int(m[1]) if (m := re.search(r'data-y="(\d)"', attributes)) else None)
    page.labels[0] = CONTAINER
    for i in range(1, len(page.tag)):
        if page.labels[i] is None:
            page.labels[i] = page.labels[page.parent[i]]
    return page


@functools.lru_cache(1)
def trained(pages: int = PAGES, seed: int = SEED) -> Boosted:
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page = invented(r)
        xs.append(page.features())
        ys += page.labels
    return fit(np.concatenate(xs), np.array(ys), 3)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of pages (page_id, url, html).

    Character references are decoded, white space (and `<br>`) inside a block is one space, blocks are trimmed
    and joined by a line feed; n_chars counts code points. Null or empty html, and pages without main
    text, give an empty text. Repeated rows stay, null ids and urls are carried; other columns are
    ignored; empty in, empty out."""
    model = trained()

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "html", 2 << 20):
                parsed = [Page(x or "") for x in part.column("html").to_pylist()]
                features = [p.features() for p in parsed]
                scores = model.scores(np.concatenate(features)) if features else np.zeros((0, 3))
                scores -= np.log(np.exp(scores).sum(1, keepdims=True))
                at, texts = 0, []
                for p, f in zip(parsed, features, strict=True):
                    texts.append(p.text(p.decode(scores[at : at + len(f)])))
                    at += len(f)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
