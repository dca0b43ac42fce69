"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every element, and every block of text in it, is a node with a hidden label, content or boilerplate.
A node's own potential comes from its own features: tag, hashed names of class, id and role, text and links,
place among its siblings. Nothing is inherited: what an element says about the text below it
passes along the edges. Parent-child potentials, one table for each kind of edge, say how labels
pass down the tree. Sum-product messages upward and downward give each node's exact content
marginal; blocks with a marginal of one half or more are the text.

Weights are fitted on labelled pages, a bounded, generated set in many layouts with common, rare and meaningless
class names, implied end tags and unclosed elements. They start from a logistic regression and from counts of
labels along edges; then all of them together climb the likelihood of the whole trees, whose exact gradient is what
was observed less what the messages expect.

Script, style, template, textarea and iframe are never text. Character references are decoded, white space in a
block becomes one blank, blocks are joined in page order by one blank. Nothing else is dropped.

Defined results: null and empty pages have empty text. Text outside any element is a block of the
root; a text without any markup is content. Markup that is cut off is read as far as it goes, and an
element that is never closed ends with its parent (script and style: with the page). Pages of any length and depth are
read whole, in linear time. Equal pages get equal texts; columns that are not named are dropped, and clash with nothing. An empty table
gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>=]+|=)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Fixed values of HTML: elements without content, raw text, blocks, and what a start tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template textarea iframe".split())
BLOCK = set("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"body", "canvas", "caption", "dd", "dt", "head", "html", "legend", "li", "noscript", "object", "option", "select", "tbody", "td", "tfoot", "th", "thead", "title", "tr"} | {"hr"}
IN_HEAD = set("title noscript object script style template link meta base".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: Elements that hold others; an edge to one, to another element and to text are the three kinds of edges.
CONTAINERS = set("article aside body details dialog div fieldset footer form head header html main menu nav noscript object ol search section select table ul".split())
CUE = re.compile(r"©|\(c\)|copyright|all rights reserved|cookies?\b|subscribe|sign up|log ?in|privacy policy|newsletter|advertisement|sponsored", re.I)
STOPS = re.compile(r"[.!?;:](?=\s|$)")

BITS = 13


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    hidden: bool = False
    text: str = ""
    links: int = 0  # characters inside links
    chars: int = 0  # of this node and all below
    children: list[int] = field(default_factory=list)
    mark: int = -1  # for fitting: 1 content, 0 boilerplate


def _attributes(raw: str) -> tuple[tuple[str, ...], bool]:
    names, hidden = [], False
    if not raw or "=" not in raw and "hidden" not in raw.lower():
        return (), False
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name in ("class", "id", "role"):
            names += [re.sub(r"(?<=[a-z])(?=[A-Z])", "-", w).lower() for w in value.split()]
    return tuple(names), hidden


def parse(page: str | None) -> list[Node]:
    """Nodes in page order, parents first. Blocks of text are nodes of tag ``#text``.

    Where each tag is open is kept beside the stack, so no step scans it.
    """
    nodes = [Node("#root", -1)]
    stack, held, linked = [0], [], 0
    depth_of: dict[str, list[int]] = {}  # positions in the stack by tag, and of all blocks
    blocks = [0]
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                top = stack[blocks[-1]]
                nodes[top].children.append(len(nodes))
                nodes.append(Node("#text", top, text=text, links=min(linked, len(text)), chars=len(text)))
            linked = 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            depth_of[nodes[stack.pop()].tag].pop()
            if blocks[-1] >= len(stack):
                blocks.pop()

    def last(tags) -> int:
        return max((depth_of[t][-1] for t in tags if depth_of.get(t)), default=-1)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        upto = m.start() if m else size
        if upto > at:
            piece = page[at:upto]
            held.append(piece)
            if depth_of.get("a"):
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            continue
        if m[1]:
            where = last((tag,))
            if where < 0:
                if tag == "p":
                    flush()
                continue
            if tag in BLOCK:
                flush()
            elif blocks[-1] > where:
                continue  # an inline end tag does not close blocks
            pop_to(where)
            continue
        if tag in RAW:
            end = None if m[3].endswith("/") else _raw_end(tag).search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style") and not m[3].endswith("/"):
                at = size
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                held.append(" ")
                if tag == "hr":
                    flush()
            continue
        if tag in BLOCK:
            flush()
            if tag not in IN_HEAD and depth_of.get("head"):
                pop_to(last(("head",)))
        if tag in CLOSES_P:
            where = last(("p",))
            if where > last(("td", "th", "button", "caption")):
                pop_to(where)
        if tag in SAME:
            while (where := last(SAME[tag])) > last(SCOPE.get(tag, ())):
                name = nodes[stack[where]].tag
                pop_to(where)
                if name == tag or tag in ("td", "th"):
                    break
        names, hidden = _attributes(m[3])
        parent = stack[-1]
        nodes[parent].children.append(len(nodes))
        depth_of.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append(len(nodes))
        nodes.append(Node(tag, parent, names, hidden))
        if "data-k=" in m[3]:
            nodes[-1].mark = int(m[3][m[3].index("data-k=") + 8])
        if m[3].endswith("/") and tag not in BLOCK and not m[3].endswith("=/"):
            pop_to(len(stack) - 1)  # foreign elements close themselves
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[nodes[i].parent]
        up.chars += nodes[i].chars
        up.links += nodes[i].links
    return nodes


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


_INDEX: dict[str, int] = {}


def _index(name: str) -> int:
    got = _INDEX.get(name)
    if got is None:
        if len(_INDEX) > 200_000:
            _INDEX.clear()
        got = _INDEX[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
    return got


def _bucket(x: float, *ends: float) -> int:
    return sum(x >= e for e in ends)


def features(nodes: list[Node]) -> list[list[int]]:
    """Rows of weights of each node's own features; all are yes or no."""
    total = max(1, nodes[0].chars)
    out = []
    alike: dict[int, Counter] = {}
    for n in nodes:
        found = [f"tag {n.tag}"]
        density = _bucket(n.links / n.chars, 0.05, 0.3, 0.6, 0.9) if n.chars else 9
        if n.tag == "#text":
            found += [f"text links {density}", f"text size {min(10, n.chars.bit_length())}", f"text stops {_bucket(len(STOPS.findall(n.text)), 1, 2, 4)}"]
            if CUE.search(n.text):
                found.append(f"text cue {_bucket(n.chars, 80, 300)}")
        else:
            group = "box" if n.tag in CONTAINERS else "part"
            found.append(f"{group} links {density}")
            if group == "box":
                found += [f"share {_bucket(n.chars / total, 0.05, 0.3, 0.6)}", f"size {min(10, n.chars.bit_length())}", f"children {_bucket(len(n.children), 1, 2, 5)}"]
            for name in n.names:
                parts = re.findall(r"[a-z]+", name)
                found.append(f"name {name}")
                if len(parts) > 1:
                    found += [f"first {parts[0]}", f"last {parts[-1]}"]
                else:
                    found += [f"only {p}" for p in parts]
            if n.hidden:
                found.append("hidden")
            if n.parent >= 0:
                same = alike.get(n.parent)
                if same is None:
                    same = alike[n.parent] = Counter((nodes[c].tag, nodes[c].names[:1]) for c in nodes[n.parent].children)
                if group == "box":
                    found.append(f"alike {_bucket(same[n.tag, n.names[:1]], 2, 3, 6)}")
                    mains = sum(k for (t, _), k in same.items() if t in ("article", "main"))
                    if mains and n.tag not in ("article", "main"):
                        found.append("beside an article")
        out.append([_index(f) for f in found])
    return out


def _edge(n: Node) -> int:
    return 0 if n.tag == "#text" else 1 if n.tag in CONTAINERS else 2


class Forest:
    """Trees side by side as arrays: messages go through all of them level by level."""

    def __init__(self, trees: list[list[Node]]):
        self.ends = np.cumsum([0, *map(len, trees)])
        self.parent = np.concatenate([np.array([n.parent for n in t]) + at for t, at in zip(trees, self.ends)])
        self.parent[self.ends[:-1]] = -1
        self.edge = np.concatenate([np.array([_edge(n) for n in t]) for t in trees])
        depth: list[int] = []
        for t in trees:
            own = [0] * len(t)
            for i, n in enumerate(t):
                if n.parent >= 0:
                    own[i] = own[n.parent] + 1
            depth += own
        order = np.argsort(np.array(depth), kind="stable")
        self.levels = np.split(order, np.nonzero(np.diff(np.array(depth)[order]))[0] + 1)[1:]
        rows = [f for t in trees for f in features(t)]
        self.node, self.column = np.repeat(np.arange(len(rows)), [len(f) for f in rows]), np.array([c for f in rows for c in f], dtype=np.int64)

    def scores(self, unary: np.ndarray) -> np.ndarray:
        return np.bincount(self.node, unary[self.column], len(self.parent))


@dataclass
class TreeModel:
    unary: np.ndarray  # weights of content against boilerplate, by hashed feature
    pair: np.ndarray  # log potentials: kind of edge x parent's label x child's label

    def beliefs(self, f: Forest, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of content of all nodes by sum-product, children to parents, then back; and log odds of parents without their child."""
        p = self.pair[f.edge]
        below, message, without = score.copy(), np.zeros(len(score)), np.zeros(len(score))
        for level in reversed(f.levels):
            u = below[level]
            message[level] = np.logaddexp(p[level, 1, 0], p[level, 1, 1] + u) - np.logaddexp(p[level, 0, 0], p[level, 0, 1] + u)
            np.add.at(below, f.parent[level], message[level])
        full = below.copy()
        for level in f.levels:
            c = without[level] = full[f.parent[level]] - message[level]
            full[level] = below[level] + np.logaddexp(p[level, 0, 1], p[level, 1, 1] + c) - np.logaddexp(p[level, 0, 0], p[level, 1, 0] + c)
        return full, np.stack([below, without])

    def edges(self, f: Forest, sides: np.ndarray) -> np.ndarray:
        """Marginals of each node's edge to its parent: n x 4, labels of parent and child."""
        p, (u, c) = self.pair[f.edge], sides
        z = np.stack([p[:, 0, 0], p[:, 0, 1] + u, p[:, 1, 0] + c, p[:, 1, 1] + c + u], axis=1)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[f.parent < 0] = 0
        return z

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        f = Forest([nodes])
        return _share(self.beliefs(f, f.scores(self.unary))[0])


def _share(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


# --- labelled pages -----------------------------------------------------------------------------

#: Names that pages give to their parts. Generated pages draw on them; their weights are learnt.
NAMES = {
    "main": "article post entry story content main body text prose hentry article-body post-content entry-content story-body main-content content-main articleBody single page-content read longform node-article blog-post",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc main-nav site-nav nav-menu topnav skip-links menu-bar nav-links",
    "edge": "header footer masthead banner top bottom site-header site-footer copyright legal logo branding colophon page-header page-footer topbar bottom-bar imprint",
    "side": "sidebar side aside widget related recommended rail secondary more popular trending right-rail side-column related-posts see-also most-read widget-area",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adbox ad-banner ad-slot ads-top sponsored-content dfp teaser-ad partner-offer",
    "notice": "notice cookie cookies consent gdpr alert modal popup overlay message toast disclaimer cookie-notice cookie-banner consent-box paywall-notice alert-box warning",
    "comment": "comment comments discussion reply replies respond disqus thread feedback responses comment-list comments-area reader-comments user-comments opinions reader-opinions views reader-views reactions talkback conversation reader-letters comment-body guestbook",
    "form": "form search newsletter subscribe signup login register search-form newsletter-box subscribe-form login-box contact-form",
    "social": "share sharing social follow like tweet author byline meta tags tag category date share-buttons social-links post-meta author-box tag-list",
}
STATES = "comment-open comments-open comments-closed comment-status-open has-sidebar no-sidebar with-ads no-ads has-comments type-post status-publish format-standard has-post-thumbnail is-sponsored-free allow-comments"


@cache
def _pool(n: int = 4_000) -> list[str]:
    """Meaningless words for generated pages."""
    rng = np.random.default_rng(1)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, k)) for k in rng.integers(1, 11, n)]


def _labelled_page(rng: np.random.Generator) -> str:
    """A page whose elements carry label marks: data-k="1" content, "0" boilerplate."""
    pick = lambda *a: a[rng.integers(len(a))]
    pool = _pool()
    word = lambda: pool[rng.integers(len(pool))]
    words = lambda n: " ".join([pool[i] for i in rng.integers(0, len(pool), n)])
    maybe = lambda p, s: s if rng.random() < p else ""
    every = [w for line in NAMES.values() for w in line.split()]

    style = pick("prose", "prose", "prose", "prose", "signs", "shout", "cells", "again")  # of the whole page
    glue = {"prose": " ", "signs": pick("%%% ", "*** ", "$$$ "), "shout": "!! ", "cells": " | ", "again": " "}[style]

    def sentence() -> str:
        w = words(int(rng.integers(1, 16)))
        if style != "prose":
            w = glue.join(w.upper().split() if style == "shout" else w.split()[:1] * int(rng.integers(1, 12)) if style == "again" else w.split())
        return w.capitalize() + pick(".", ".", ".", "!", "?", "!!", " ***", "%%%", "")

    text = lambda n: " ".join([sentence() for _ in range(n)])
    menu = lambda: "".join(f"<li><a href='/{words(1)}'>{words(int(rng.integers(1, 3)))}</a></li>" for _ in range(rng.integers(2, 9)))
    mark = lambda k: f' data-k="{k}"'

    def names(kind: str, sure: float = 0.75) -> str:
        """A class or id: a name of its kind, or one that says nothing."""
        own = pick(*NAMES[kind].split()) if rng.random() < sure else pick(word() + "-" + word(), word(), "block", "wrapper", "inner", "box", "section", "row")
        return f" {pick('class', 'class', 'id')}='{own}{maybe(0.15, ' ' + pick('clearfix', 'wide', 'col', 'js', word()))}'"

    def states() -> str:
        """Classes of an article that name other things without being them."""
        out = [pick(*NAMES["main"].split())]
        for _ in range(rng.integers(1, 5)):
            out.append(pick(*STATES.split(), f"tag-{pick(*every)}", f"category-{pick(*every)}", f"tag-{word()}", f"category-{word()}", f"post-{rng.integers(1, 999)}", f"author-{word()}"))
        return f" class='{' '.join(out)}'"

    def paragraph() -> str:
        if rng.random() < 0.08:
            return f"<p>{text(1)}</p>" * int(rng.integers(2, 7))
        kinds = (
            lambda: text(int(rng.integers(1, 7))),
            lambda: f"<b>{text(2)}<br>{text(1)}</b>",
            lambda: f"<b>{text(2)}<br>",
            lambda: f"{text(1)} <a href='#'>{words(2)}</a> {text(1)}",
            lambda: f"{text(1)} <em>{words(2)}</em> &amp; {words(3)}",
            lambda: words(int(rng.integers(1, 4))),
            lambda: f"{text(1)} {pick('Cookies', 'The newsletter', 'They subscribe', 'Copyright')} {text(2)}",
            lambda: f"<math><mi>{word()}</mi><mo>=</mo><mi>{word()}</mi></math> {words(3)}",
        )
        body = pick(*kinds)()
        return f"<p>{body}" + maybe(0.75, "</p>")

    def content() -> str:
        out = [maybe(0.8, f"<h1>{words(5)}</h1>"), maybe(0.15, f"<header><h1>{words(4)}</h1></header>")]
        kinds = (
            paragraph,
            paragraph,
            paragraph,
            paragraph,
            lambda: f"<h2>{words(3)}</h2>",
            lambda: f"<ul><li>{text(1)}</li><li>{text(1)}</li></ul>",
            lambda: f"<blockquote>{text(2)}</blockquote>",
            lambda: f"<table><tr><td>{words(2)}</td><td>{words(2)}</td></tr></table>",
            lambda: f"<pre>{words(8)}</pre>",
            lambda: f"<div>{text(3)}</div>",
            lambda: f"<div{names('main', 0.4)}>{paragraph()}{paragraph()}</div>",
            lambda: f"<figure><img src='x'><figcaption>{text(1)}</figcaption></figure>",
            lambda: f"<section><h2>{words(2)}</h2>{paragraph()}</section>",
            lambda: f"<noscript>{text(1)}</noscript>",
            lambda: f"<svg><text>{words(2)}</text></svg>",
            lambda: f"<object data='x'>{text(1)}</object>",
        )
        for _ in range(pick(1, 2, 3, 4, 6, 8, 8, 12, 20, 40)):
            out.append(pick(*kinds)())
            if rng.random() < 0.12:
                out.append(f"<div{names(pick('advert', 'advert', 'social', 'side', 'form'), 1)}{mark(0)}>{text(1)}</div>")
            if rng.random() < 0.04:
                out.append(f"<aside{mark(0)}>{text(1)}</aside>")
        return "".join(out)

    def comments() -> str:
        each = maybe(0.7, names("comment"))
        item = lambda: pick(f"<div{each}><p>{text(2)}</p></div>", f"<div{each}><b>{words(1)}</b> {text(1)}</div>", f"<p>{text(2)}</p>", f"<li{each}>{text(1)}</li>")
        kind = pick("section", "div", "div", "ol")
        return f"<{kind}{names('comment')}{mark(0)}>{maybe(0.6, '<h2>' + words(1) + '</h2>')}" + "".join(item() for _ in range(rng.integers(1, 6))) + f"</{kind}>"

    hide = lambda: maybe(0.1, pick(" hidden", " aria-hidden='true'", " style='display:none'"))
    boiler = {
        "nav": lambda: pick(f"<nav{maybe(0.5, names('nav'))}{mark(0)}><ul>{menu()}</ul></nav>", f"<div{names('nav')}{mark(0)}><ul>{menu()}</ul></div>", f"<nav{mark(0)}>{menu()}</nav>"),
        "head": lambda: pick(f"<header{maybe(0.5, names('edge'))}{mark(0)}>{pick('<h1>' + words(2) + '</h1>', '<div class=logo>' + words(2) + '</div>', text(1))}</header>", f"<div{names('edge', 0.9)}{mark(0)}>{words(3)}</div>"),
        "ad": lambda: f"<{(t := pick('div', 'div', 'aside', 'section'))}{names('advert', 0.9)}{hide()}{mark(0)}>{text(int(rng.integers(1, 3)))}</{t}>",
        "side": lambda: f"<{(t := pick('aside', 'aside', 'div'))}{names('side')}{mark(0)}>{pick(text(2), '<h3>' + words(2) + '</h3><ul>' + menu() + '</ul>', '<p>' + text(3) + '</p>')}</{t}>",
        "notice": lambda: f"<{(t := pick('div', 'div', 'dialog', 'section'))}{names('notice', 0.9)}{hide()}{mark(0)}><p>{pick(text(2), 'We use cookies. ' + text(1), text(1) + ' Accept all cookies', 'Subscribe to read on. ' + text(1))}</p>{maybe(0.5, '<button>' + words(1) + '</button>')}</{t}>",
        "comments": comments,
        "form": lambda: f"<form{maybe(0.4, names('form'))}{mark(0)}><label>{words(2)}</label><input><select><option>{words(1)}<option>{words(1)}</select><button>{words(1)}</button>{maybe(0.4, '<p>' + text(1) + '</p>')}</form>",
        "social": lambda: f"<div{names('social', 0.95)}{mark(0)}>{pick(text(1), '<ul>' + menu() + '</ul>', words(3))}</div>",
        "foot": lambda: pick(f"<footer{maybe(0.3, names('edge'))}{mark(0)}>", f"<footer{mark(0)}>") + pick("&copy; " + words(2) + " &middot; " + text(2), "<p>" + text(2) + "</p>", "<ul>" + menu() + "</ul>" + words(4)) + "</footer>",
    }
    some = lambda n, *which: "".join(boiler[pick(*which)]() for _ in range(n))
    tag = pick("article", "article", "article", "main", "div", "div", "section")
    holder = f"<{tag}{pick(states(), names('main'), '', names('main', 0.3) if tag in ('article', 'main') else states())}"
    inside, after = maybe(0.25, some(1, "comments", "social", "form", "comments")), some(int(rng.integers(0, 4)), "side", "form", "comments", "comments", "social", "ad", "notice")
    body = f"{holder}{mark(1)}>{content()}{inside}</{tag}>"
    if rng.random() < 0.15:
        body = f"<main>{body}</main>"
    page = some(int(rng.integers(1, 4)), "nav", "head", "ad", "notice") + body + after + maybe(0.85, boiler["foot"]())
    for _ in range(rng.integers(0, 3)):
        if rng.random() < 0.4:
            page = f"<div{pick('', ' class=' + pick('wrapper', 'container', 'page', 'site', 'inner', 'row'))}>{page}</div>"
    return f"<html><head><title{mark(0)}>{words(3)}</title></head><body>{page}</body></html>"


def labels(nodes: list[Node]) -> np.ndarray:
    """Marks pass down; an unmarked node above them has the label of most of its text."""
    y = np.full(len(nodes), -1)
    for i, n in enumerate(nodes):
        y[i] = n.mark if n.mark >= 0 else (y[n.parent] if n.parent >= 0 else -1)
    good = np.array([n.chars if n.tag == "#text" and y[i] == 1 else 0 for i, n in enumerate(nodes)])
    for i in range(len(nodes) - 1, 0, -1):
        good[nodes[i].parent] += good[i]
    return np.array([k if k >= 0 else int(2 * good[i] >= max(1, nodes[i].chars)) for i, k in enumerate(y)])


@cache
def trained(pages: int = 600, steps: int = 150, joint: int = 200, seed: int = 3) -> TreeModel:
    """Fitted on ``pages`` generated pages, once in a process."""
    rng = np.random.default_rng(seed)
    trees = [parse(_labelled_page(rng)) for _ in range(pages)]
    known, f = [labels(t) for t in trees], Forest(trees)
    y = np.concatenate(known).astype(np.float64)
    inner = f.parent >= 0
    seen = np.ones((3, 2, 2))
    np.add.at(seen, (f.edge[inner], y[f.parent[inner]].astype(int), y[inner].astype(int)), 1)
    share = seen / seen.sum(axis=(1, 2), keepdims=True)
    # conditional over prior: what the edge adds to the unary evidence
    model = TreeModel(np.zeros(1 << BITS), np.log(share / (share.sum(axis=2, keepdims=True) * share.sum(axis=1, keepdims=True))))
    w, m, v = model.unary, 0.0, 0.0
    for t in range(1, steps + 1):
        g = np.bincount(f.column, (_share(f.scores(w)) - y)[f.node], 1 << BITS) / len(y) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    p = [w, model.pair]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, joint + 1):
        full, sides = model.beliefs(f, f.scores(w))
        edges = model.edges(f, sides)
        pairs = np.stack([np.bincount(f.edge, edges[:, k], 3) for k in range(4)], axis=1).reshape(3, 2, 2)
        for k, g in enumerate([np.bincount(f.column, (_share(full) - y)[f.node], 1 << BITS) / len(y) + 1e-5 * w, (pairs - (seen - 1)) / len(y) + 1e-3 * model.pair]):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] -= 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def main_texts(pages: list[str | None], model: TreeModel) -> list[str]:
    """The text of each page; messages go through all pages at once."""
    trees = [parse(p) for p in pages]
    f = Forest(trees) if trees else None
    odds = model.beliefs(f, f.scores(model.unary))[0] if f else np.zeros(0)
    out = []
    for nodes, lo in zip(trees, f.ends if f else ()):
        plain = all(n.tag == "#text" for n in nodes[1:])  # no markup, nothing that could set text apart
        out.append(" ".join(n.text for i, n in enumerate(nodes) if n.text and (plain or odds[lo + i] >= 0)))
    return out


def main_text(page: str | None, model: TreeModel) -> str:
    return main_texts([page], model)[0]


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id_col, *keep, text) of every page."""
    shared = df.sparkSession.sparkContext.broadcast(trained())
    names = [id_col, *keep]
    schema = ", ".join(f"c{i} {df.schema[n].dataType.simpleString()}" for i, n in enumerate(names)) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = main_texts(part.column(len(names)).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*(f"c{i}" for i in range(len(names))), "text"])

    return df.select(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names)), F.col(html_col).alias("html")).mapInArrow(run, schema).toDF(*names, "text")
