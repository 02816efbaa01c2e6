"""Main text of web pages from a tree-structured graphical model over the DOM.

Every block element is a node that is content or not. Its own features (tag, words of its
class and id, length, links, punctuation) give its potential, a table per kind of child
ties it to its parent. Messages go up from the leaves and down from the root, all nodes
of one depth of many pages at a time, and give the exact marginal of every node; text
blocks of nodes that are more likely content than not are the result. Potentials are
learned by gradient ascent on the likelihood of labelled pages: pages of the table whose
own markup names the article (a bounded sample), and small labelled layouts for the parts
such pages may lack. The same model then reads pages with and without that markup.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.llm.sampling import sample_rows

SAMPLE_PAGES = 100  # labelled pages that training may take
SAMPLE_BYTES = 200_000  # longer pages aren't taken for training
# Element kinds of HTML.
BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr center menu "
    "dialog search hgroup legend".split()
)
UNSEEN = set("script style template noscript head title svg math iframe object textarea select button option".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe".split())  # hold text up to their own end tag
IN_HEAD = set("base link meta title style script noscript template".split())
OPTION_ENDS = set("select datalist optgroup".split())
#: Start tags that end SVG and MathML, and where these hold HTML.
BREAKOUT = set(
    "b big blockquote body center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li menu nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split()
)
HTML_INSIDE = {"foreignobject", "desc", "title", "annotation-xml"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, **dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot"), {"table"})}
#: Words of class and id names, by what they say.
NAMES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs topbar",
    "head": "header masthead head top logo branding hero",
    "foot": "footer foot bottom copyright colophon legal",
    "side": "sidebar side aside rail related recommended more widget popular trending tags",
    "note": "notice notices cookie cookies consent gdpr alert banner popup modal overlay newsletter subscribe signup paywall",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense",
    "form": "form search login contact input register",
    "comment": "comment comments reply replies respond discussion disqus responses",
    "share": "share sharing social follow meta byline author date tools",
    "main": "article content main post entry story text body maincontent articlebody postcontent entrycontent page",
}
_NAME_OF = {w: k for k, ws in NAMES.items() for w in ws.split()}
_KINDS = list(NAMES)
_TAGS = sorted(BLOCKS)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Za-z][a-z]*")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    names: Counter = field(default_factory=Counter)
    label: int | None = None
    chars: int = 0
    linked: int = 0
    stops: int = 0


class Page(HTMLParser):
    """Block elements of a page in order, and text blocks as (node, text).

    Unseen elements end by HTML's rules: an option at the next one or its parent's end, a
    head at the first body content, SVG at HTML that can't be in it, all but raw text where
    an enclosing block ends. One that holds blocks and is open at the end of the page has no
    end: the page is read again without it.
    """

    def __init__(self, html: str | None, endless: dict[str, int] | None = None):
        super().__init__(convert_charrefs=True)
        self.endless = endless or {}  # tag -> from which of its elements on it isn't unseen
        self.begun: Counter = Counter()
        self.holds_blocks = False
        self.nodes = [Node("html", -1, 0)]
        self.blocks: list[tuple[int, str]] = []
        self.open = [0]  # open block elements
        self.open_tags = Counter({"html": 1})
        self.unseen: list[str] = []
        self.links = 0
        self.text: list[str] = []
        try:
            self.feed(html or "")
            self.close()
        except AssertionError:  # a declaration the parser has no rule for: read again without them
            self.__init__(re.sub(r"<!\[[^>]*>?", "", html or ""), endless)
            return
        if self.unseen and self.holds_blocks and self.unseen[0] not in RAW:
            self.__init__(html, {**self.endless, self.unseen[0]: self.begun[self.unseen[0]]})
            return
        self._flush()

    def _flush(self) -> None:
        whole = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if whole:
            node = self.nodes[self.open[-1]]
            node.chars += len(whole)
            node.stops += sum(whole.count(c) for c in ".,;!?")
            self.blocks.append((self.open[-1], whole))

    def _pop(self) -> None:
        self.open_tags[self.nodes[self.open.pop()].tag] -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.unseen:
            within = self.unseen[0]
            if not self._left_by(tag):
                if tag not in VOID:
                    self.unseen.append(tag)
                self.holds_blocks |= tag in BLOCKS
                return
            if within == tag == "select":  # inside one it stands for the end tag
                return
        if tag == "head" and len(self.open) > 1:
            return
        if tag in UNSEEN:
            self.begun[tag] += 1
            if self.begun[tag] < self.endless.get(tag, self.begun[tag] + 1):
                self.unseen, self.holds_blocks = [tag], False
            return
        if tag == "a":
            self.links += 1
        if tag == "br":
            self.text.append(" ")
        if tag not in BLOCKS:
            return
        self._flush()
        if tag in ("html", "body") and self.open_tags[tag]:
            return
        if tag == "hr":
            return
        self.links = 0
        if self.open_tags["p"] and self.nodes[self.open[-1]].tag == "p":
            self._pop()
        if tag in CLOSES:
            at = len(self.open) - 1
            while at > 0 and self.nodes[self.open[at]].tag not in SCOPES[tag]:
                if self.nodes[self.open[at]].tag in CLOSES[tag]:
                    while len(self.open) > at:
                        self._pop()
                at -= 1
                if len(self.open) - at > 64:
                    break
        parent = self.open[-1]
        node = Node(tag, parent, self.nodes[parent].depth + 1)
        for key, value in attrs:
            if key in ("class", "id", "role", "itemprop") and value:
                for part in re.split(r"[\s_-]+", value):
                    found = {part.lower(), *(w.lower() for w in _WORD.findall(part))}
                    node.names.update({_NAME_OF[w] for w in found if w in _NAME_OF})
            elif key == "data-label" and value in ("0", "1"):
                node.label = int(value)
        self.open.append(len(self.nodes))
        self.open_tags[tag] += 1
        self.nodes.append(node)

    def _raw(self) -> bool:
        return self.unseen[-1] in RAW and self.unseen[0] not in ("svg", "math")

    def _left_by(self, tag: str) -> bool:
        """Whether a start tag ends the unseen element; inner ones it ends are taken off."""
        first, last = self.unseen[0], self.unseen[-1]
        if self._raw():
            return False
        if last == "head":
            left = tag not in IN_HEAD
        elif first in ("svg", "math"):
            left = tag in BREAKOUT and not HTML_INSIDE.intersection(self.unseen)
        elif tag in ("option", "optgroup") and last == "option":
            self.unseen.pop()
            left = not self.unseen
        else:
            left = (tag == first and tag in ("button", "select")) or (first == "head" and tag == "body")
        if left:
            self.unseen.clear()
        return left

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if self.unseen and (tag in UNSEEN or self.unseen[0] in ("svg", "math")) and tag not in BREAKOUT:
            return
        if tag == "br" or tag not in VOID | (UNSEEN - {"script", "style", "head"}):
            self.handle_starttag(tag, attrs)
        elif self.unseen:  # an empty element
            self._left_by(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag in self.unseen:
                while self.unseen.pop() != tag:
                    pass
                return
            if self._raw():
                return
            if self.unseen == ["option"] and tag in OPTION_ENDS:
                self.unseen.clear()
            elif tag in BLOCKS - {"html", "body"} and self.open_tags[tag]:
                self.unseen.clear()
            else:
                return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in BLOCKS or not self.open_tags[tag]:
            return
        self._flush()
        self.links = 0
        if tag in ("html", "body"):
            return
        while self.nodes[self.open[-1]].tag != tag:
            self._pop()
        if len(self.open) > 1:
            self._pop()

    def handle_data(self, data: str) -> None:
        if self.unseen == ["head"] and data.strip():
            self.unseen.clear()
        if not self.unseen:
            self.text.append(data)
            if self.links:
                self.nodes[self.open[-1]].linked += len(data.strip())


def _columns() -> dict[str, int]:
    names = [f"tag {t}" for t in _TAGS] + [f"name {k}" for k in _KINDS] + [f"chars {i}" for i in range(6)]
    names += [f"links {i}" for i in range(4)] + [f"stops {i}" for i in range(3)] + ["bias", "plain"]
    return {n: i for i, n in enumerate(names)}


_AT = _columns()


EDGE_KINDS = 11


def edge_kind(node: Node, parent: str) -> int:
    """Which table ties a node to its parent: one for each way in which it says what it is, apart
    for children of the page's root, which is content and the rest at once."""
    if node.tag == "body":
        return 10
    if node.tag in ("article", "main"):
        kind = 1
    elif node.tag in ("nav", "aside", "footer", "header", "form"):
        kind = 2
    elif node.names:
        kind = 3 if set(node.names) == {"main"} else 4
    else:
        kind = 0
    return kind + 5 * (parent in ("html", "body"))


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, parents, depths and edge kinds of all nodes of ``pages``."""
    total = sum(len(p.nodes) for p in pages)
    x = np.zeros((total, len(_AT)))
    parent, depth, kind = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
    i = 0
    for page in pages:
        base = i
        for node in page.nodes:
            row = x[i]
            row[_AT[f"tag {node.tag}"]] = 1
            for k in node.names:
                row[_AT[f"name {k}"]] = 1
            row[_AT[f"chars {min(5, len(str(node.chars)) if node.chars else 0)}"]] = 1
            share = node.linked / max(1, node.chars)
            row[_AT[f"links {0 if not node.linked else 1 if share < 0.3 else 2 if share < 0.8 else 3}"]] = 1
            row[_AT[f"stops {min(2, node.stops)}"]] = 1
            row[_AT["bias"]] = 1
            row[_AT["plain"]] = not node.names
            parent[i] = node.parent + base if node.parent >= 0 else -1
            depth[i] = node.depth
            # how strongly a node follows its parent depends on whether it says itself what it is
            kind[i] = edge_kind(node, page.nodes[max(node.parent, 0)].tag)
            i += 1
    return x, parent, depth, kind


def _sum2(v: np.ndarray, axis: int) -> np.ndarray:
    top = v.max(axis, keepdims=True)
    return (np.log(np.exp(v - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def marginals(
    unary: np.ndarray, edges: np.ndarray, parent: np.ndarray, depth: np.ndarray, kind: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals (n, 2) and edge marginals (n, parent, child) by messages up and down.

    ``edges[kind]`` are log potentials of (parent label, child label).
    """
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1))
    levels = np.split(order, cuts)
    inside = unary.copy()
    up = np.zeros_like(unary)
    for level in reversed(levels[1:]):
        up[level] = _sum2(edges[kind[level]] + inside[level][:, None, :], 2)
        np.add.at(inside, parent[level], up[level])
    outside = np.zeros_like(unary)  # all that reaches a node from beyond its subtree
    pair = np.zeros((len(unary), 2, 2))
    for level in levels[1:]:
        p = parent[level]
        rest = outside[p] + inside[p] - up[level]
        joint = rest[:, :, None] + edges[kind[level]]
        outside[level] = _sum2(joint, 1)
        outside[level] -= outside[level].max(1, keepdims=True)
        joint = joint + inside[level][:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        pair[level] = joint / joint.sum((1, 2), keepdims=True)
    belief = inside + outside
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True), pair


@dataclass
class Model:
    weights: np.ndarray
    edges: np.ndarray

    def content(self, pages: list[Page]) -> np.ndarray:
        """Probability of being content of all nodes of ``pages``."""
        x, parent, depth, kind = features(pages)
        unary = np.stack([np.zeros(len(x)), x @ self.weights], 1)
        return marginals(unary, self.edges, parent, depth, kind)[0][:, 1]


def _markup_labels(page: Page) -> list[int] | None:
    """Labels of a page whose markup names its article; None if it doesn't."""
    apart = {"nav", "footer", "aside", "form"}
    away = {"menu", "foot", "side", "note", "advert", "form", "comment"}
    label = []
    for node in page.nodes:
        inherited = label[node.parent] if node.parent >= 0 else 0
        if node.tag in ("article", "main"):
            inherited = 1
        if node.tag in apart or away & set(node.names):
            inherited = 0
        label.append(inherited)
    return label if 1 in label else None


def _given_labels(page: Page) -> list[int]:
    label: list[int] = []
    for node in page.nodes:
        label.append(node.label if node.label is not None else label[node.parent] if node.parent >= 0 else 0)
    return label


def layouts(copies: int = 24, seed: int = 5) -> list[str]:
    """Small labelled pages: the parts of a page that the article has to be told from."""
    rng = random.Random(seed)

    def say(least: int, most: int) -> str:
        n = rng.randint(least, most)
        out = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(n)]
        return " ".join(w + rng.choice(["", "", "", "", ",", "."]) for w in out).capitalize() + "."

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{say(1, 2)}</a></li>' for i in range(n))

    def body() -> str:
        parts = [f"<h1>{say(3, 9)}</h1>"] + [f"<p>{say(1, rng.choice([3, 8, 30, 90]))}</p>" for _ in range(rng.randint(2, 6))]
        extra = [
            f"<h2>{say(2, 5)}</h2>", f"<ul><li>{say(4, 20)}</li><li>{say(4, 20)}</li></ul>",
            f"<blockquote><p>{say(8, 30)}</p></blockquote>", f"<pre>{say(5, 12)}</pre>",
            f"<table><tr><td>{say(1, 3)}</td><td>{say(1, 3)}</td></tr></table>",
            f'<p>{say(5, 20)} <a href="/x">{say(1, 3)}</a> {say(5, 20)}</p>', f"<figure><figcaption>{say(3, 9)}</figcaption></figure>",
        ]
        parts.insert(rng.randint(1, len(parts)), rng.choice(extra))
        return "".join(parts)

    away = [
        lambda: f"<nav><ul>{links(5)}</ul></nav>",
        lambda: f'<div class="{rng.choice(["menu", "navbar", "breadcrumb", "nav-links"])}"><ul>{links(4)}</ul></div>',
        lambda: f'<header><p>{say(2, 6)}</p></header>',
        lambda: f'<div id="header"><div>{say(2, 6)}</div></div>',
        lambda: f"<footer><p>&copy; {say(3, 12)}</p></footer>",
        lambda: f'<div class="{rng.choice(["footer", "site-footer", "copyright"])}"><p>{say(3, 14)}</p></div>',
        lambda: f"<aside><h3>{say(1, 3)}</h3><p>{say(5, 40)}</p><ul>{links(3)}</ul></aside>",
        lambda: f'<div class="{rng.choice(["sidebar", "related-posts", "widget"])}"><h3>{say(1, 3)}</h3><p>{say(4, 40)}</p></div>',
        lambda: f'<div class="{rng.choice(["cookie-notice", "consent", "notice", "newsletter", "alert"])}"><p>{say(5, 40)}</p></div>',
        lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo"])}">{say(3, 40)}</div>',
        lambda: f'<form><label>{say(1, 3)}</label><p>{say(2, 12)}</p></form>',
        lambda: f'<div class="{rng.choice(["comments", "comment-list", "replies"])}"><h3>{say(1, 2)}</h3>'
        f'<div class="comment"><p>{say(5, 50)}</p></div><div><p>{say(5, 40)}</p></div></div>',
        lambda: f'<section id="comments"><ol><li><p>{say(5, 50)}</p></li><li><p>{say(5, 50)}</p></li></ol></section>',
        lambda: f'<div class="{rng.choice(["share", "social"])}"><ul>{links(3)}</ul></div>',
    ]
    shells = [
        lambda x: f'<article data-label="1">{x}</article>',
        lambda x: f'<main data-label="1">{x}</main>',
        lambda x: f'<main data-label="1"><article>{x}</article></main>',
        lambda x: f'<div class="{rng.choice(["content", "post", "entry-content", "article-body", "story"])}" data-label="1">{x}</div>',
        lambda x: f'<div id="main" data-label="1"><div class="text">{x}</div></div>',
        lambda x: f'<div data-label="1">{x}</div>',
        lambda x: f'<section data-label="1">{x}</section>',
        lambda x: re.sub(r"<(h1|h2|p|ul|blockquote|pre|table|figure)>", r'<\1 data-label="1">', x),
    ]
    pages = []
    for k in range(copies * len(shells)):
        before, after = ([rng.choice(away)() for _ in range(rng.randint(1, 4))] for _ in range(2))
        main = shells[k % len(shells)](body())
        for _ in range(rng.choice([0, 1, 2, 3])):  # parts inside the article
            name = rng.choice(["share", "comments", "related", "notice", "ad"])
            part = f'<div class="{name}">{say(3, 40)}</div>' if rng.random() < 0.4 else rng.choice(away)()
            part = re.sub(r"^<(\w+)", r'<\1 data-label="0"', part)
            ends = [m.end() for m in re.finditer("</p>|</h1>", main)]
            at = rng.choice(ends)
            main = main[:at] + part + main[at:]
        if rng.random() < 0.15:  # nothing but the article
            before, after = [], []
        wrap = rng.random() < 0.4
        inner = "".join(before) + main + "".join(after)
        body_tag = rng.choice(["<html><body>", "<body>", ""])
        pages.append(f"{body_tag}{'<div class=page-wrap>' if wrap else ''}{inner}{'</div>' if wrap else ''}")
    return pages


def train(html: list[str], rounds: int = 160) -> Model:
    """Fit to the pages of ``html`` that label themselves and to the layouts."""
    labelled = [(p, y) for p in map(Page, html) if (y := _markup_labels(p)) is not None]
    labelled += [(p, _given_labels(p)) for p in map(Page, layouts())]
    x, parent, depth, kind = features([p for p, _ in labelled])
    y = np.concatenate([np.array(v) for _, v in labelled])
    model = Model(np.zeros(x.shape[1]), np.zeros((EDGE_KINDS, 2, 2)))
    child = np.flatnonzero(parent >= 0)
    truth = np.zeros((len(y), 2, 2))
    truth[child, y[parent[child]], y[child]] = 1
    squares = [np.full_like(model.weights, 1e-6), np.full_like(model.edges, 1e-6)]
    for _ in range(rounds):
        unary = np.stack([np.zeros(len(x)), x @ model.weights], 1)
        node, pair = marginals(unary, model.edges, parent, depth, kind)
        gap = np.zeros_like(model.edges)
        np.add.at(gap, kind[child], (truth - pair)[child])
        for value, g, s in ((model.weights, x.T @ (y - node[:, 1]), squares[0]), (model.edges, gap, squares[1])):
            g = g - 0.01 * value
            s += g * g
            value += 0.5 * g / np.sqrt(s)
    return model


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Model:
    """The model of a table, from at most ``sample`` of its pages, chosen by hash."""
    rows = pages.select(F.xxhash64(F.col(id_col), F.col(html_col)).alias("h"), F.col(html_col).alias("t"))
    rows = rows.filter(F.octet_length("t") <= SAMPLE_BYTES)
    return train([r.t for r in sample_rows(rows, F.col("h"), sample)])


def extract(pages: list[Page], model: Model) -> list[str]:
    """The content blocks of each page, one to a line."""
    likely = model.content(pages) if pages else np.empty(0)
    out, base = [], 0
    for page in pages:
        out.append("\n".join(t for i, t in page.blocks if likely[base + i] > 0.5))
        base += len(page.nodes)
    return out


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None
) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    NULL and empty html give the empty text, as do pages without content. Pages are read
    whole; repeated rows are rows of their own and NULL ids and urls are handed on. Other
    columns are not read. Without pages that label themselves the layouts train the model.
    """
    model = fit(pages, id_col, html_col) if model is None else model
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    types = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            html = batch.column("html")
            text: list[str] = []
            for at in range(0, batch.num_rows, 200):
                text += extract([Page(h.as_py()) for h in html[at : at + 200]], model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())]
                + [pa.array([len(t) for t in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"page_id {types[0]}, url {types[1]}, text string, n_chars long")
