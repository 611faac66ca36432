"""Main text of web pages by a tree-structured graphical model over their elements.

Every block element and every block of text is a node that is either main text or not. A node's own
evidence (tag, words of class, id and role, text length, share of linked text) comes from a logistic
model; potentials between parent and child say how labels follow each other. Messages are passed up
and then down the tree, and blocks whose marginal is at least one half make up the text. All
parameters are learned from labelled pages, which a seeded generator writes.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import words
from parley.session import ship

#: Hashed features, labelled pages of a fit, and its penalty.
SLOTS, PAGES, RIDGE = 4096, 900, 0.5

#: Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp svg".split())
SKIPPED = frozenset("select button option datalist canvas".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol table dl html body td th".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")


@dataclass
class Node:
    """A block element, or a block of text (``tag`` is then ``#text``)."""

    tag: str
    parent: int
    tokens: tuple[str, ...] = ()
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    size: int = 0
    label: int | None = None

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def parse(page: str) -> list[Node]:
    """The nodes of a page, parents before children. Unclosed, stray and cut-off tags are borne.

    A head without its end tag ends at the body, at a block element or at text that is not blank.
    """
    nodes = [Node("html", -1)]
    stack: list[tuple[str, int]] = [("html", 0)]
    # how many open elements of each name there are besides the root
    opened: Counter[str] = Counter()
    skipping = links = 0
    open_text = -1
    in_head = False
    at = 0

    def add(text: str) -> None:
        nonlocal open_text
        if skipping or not text:
            return
        owner = stack[-1][1]
        if open_text < 0:
            if text.isspace():
                return
            leave_head()
            nodes.append(Node("#text", owner))
            open_text = len(nodes) - 1
        node = nodes[open_text]
        text = html.unescape(text)
        node.parts.append(text)
        if links:
            node.linked += len(text.strip())

    def leave_head() -> None:
        nonlocal in_head
        if in_head:
            stack[:] = [s for s in stack if s[0] != "head"]
            opened["head"] = 0
            in_head = False

    def pop() -> None:
        nonlocal skipping, links, open_text, in_head
        tag = stack.pop()[0]
        opened[tag] -= 1
        in_head = in_head and tag != "head"
        skipping -= tag in SKIPPED
        links -= tag == "a"
        if tag in BLOCK:
            open_text = -1

    while at < len(page):
        found = _TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if name is None:
            continue
        name = name.lower()
        if found[1] or found[4]:
            if name == "br":
                add(" ")
            if opened[name] > 0:
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name in BLOCK:
                open_text = -1
            continue
        attributes = found[3] if found[2] else found[6]
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if name == "svg":
                add(" ")
            continue
        if name in VOID:
            if name in ("br", "hr", "img", "wbr"):
                add(" " if name != "wbr" else "")
                if name == "hr":
                    open_text = -1
            continue
        if name == "body":
            while in_head:
                pop()
        elif name in BLOCK:
            leave_head()
        elif name == "head":
            if in_head:
                continue
            in_head = True
        if name in CLOSES_P and opened["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in SCOPE or stack[k][0] in BLOCK:
                    break
        if name in SAME and any(opened[t] > 0 for t in SAME[name]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SAME[name]:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in SCOPE:
                    break
        if name in ("html", "body") and opened[name] > 0:
            continue
        owner = stack[-1][1]
        if name in BLOCK:
            open_text = -1
            own: list[str] = []
            label = None
            for m in _NAMED.finditer(attributes):
                value = m[2] or m[3] or m[4] or ""
                if m[1].lower() == "data-main":
                    label = int(value == "1")
                else:
                    own += [f"{m[1].lower()[0]}:{t}" for t in _TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())]
            nodes.append(Node(name, owner, tuple(own), label=label))
            owner = len(nodes) - 1
        skipping += name in SKIPPED
        links += name == "a"
        stack.append((name, owner))
        opened[name] += 1
    return nodes


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SLOTS


_slots: dict[str, int] = {}


def _feature(name: str) -> int:
    found = _slots.get(name)
    if found is None:
        if len(_slots) > 50_000:
            _slots.clear()
        found = _slots[name] = _slot(name)
    return found


def features(nodes: list[Node]) -> list[list[int]]:
    """Slots that are on for each node; sizes of subtrees are summed up on the way."""
    sizes, linked, blocks = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.tag == "#text":
            node.size = sizes[i] = len(node.text)
            linked[i], blocks[i] = min(node.linked, node.size), 1
        if node.parent >= 0:
            sizes[node.parent] += sizes[i]
            linked[node.parent] += linked[i]
            blocks[node.parent] += blocks[i]
    out = []
    for i, node in enumerate(nodes):
        share = 4 * linked[i] // max(1, sizes[i])
        if node.tag == "#text":
            text = node.text
            names = [f"text in {nodes[node.parent].tag}", f"size {min(12, len(text).bit_length())}", f"linked {share}", f"end {text[-1:] in '.!?:;)”»…' and text != ''}", f"sign {text[:1] in '©®™'}"]
        else:
            kind = f"{node.tag} {'named' if node.tokens else 'bare'}"
            names = [f"tag {kind}", f"{kind} linked {share}", f"blocks {min(5, blocks[i].bit_length())}", f"mean {min(12, (sizes[i] // max(1, blocks[i])).bit_length())}"]
            names += [f"word {t}" for t in node.tokens] + [f"named {t[2:]}" for t in node.tokens]
        out.append([_feature(n) for n in names])
    return out


@dataclass
class Model:
    """Evidence weights, and log potentials [kind of child][parent label][child label]."""

    weights: np.ndarray
    bias: float
    pair: np.ndarray
    temper: float = 1.0

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of main text for each node, by sum-product messages up and down."""
        own = self.evidence(nodes)
        up = own[:]
        message = [0.0] * len(nodes)
        tables = [self.pair[_kind(n, nodes[max(0, n.parent)])] for n in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            t, odds = tables[i], up[i]
            message[i] = _log_sum(t[1][0], t[1][1] + odds) - _log_sum(t[0][0], t[0][1] + odds)
            up[nodes[i].parent] += message[i]
        belief = up[:]
        for i in range(1, len(nodes)):
            t = tables[i]
            rest = belief[nodes[i].parent] - message[i]
            belief[i] = up[i] + _log_sum(t[0][1], t[1][1] + rest) - _log_sum(t[0][0], t[1][0] + rest)
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, b)))) for b in belief]

    def evidence(self, nodes: list[Node]) -> list[float]:
        """Log-odds of each node by itself; what is neither named nor a container repeats what its
        neighbours say, so its share is tempered."""
        weights, scale = self.weights, (self.temper, 1.0, 1.0, self.temper)
        return [scale[_sort(n)] * (self.bias + sum(weights[s] for s in on)) for n, on in zip(nodes, features(nodes), strict=True)]

    def extract(self, page: str) -> str:
        """Blocks of main text in page order, joined by an empty line."""
        nodes = parse(page)
        return "\n\n".join(n.text for n, p in zip(nodes, self.marginals(nodes), strict=True) if n.tag == "#text" and p >= 0.5 and n.text)


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def _sort(node: Node) -> int:
    """0: text, 1: element with a name of its own, 2: bare container, 3: other element."""
    if node.tag == "#text":
        return 0
    if node.tokens or node.tag in ("article", "main", "nav", "aside", "header", "footer", "form"):
        return 1
    return 2 if node.tag in ("html", "body", "div", "section", "center") else 3


def _kind(node: Node, parent: Node) -> int:
    """Which table of potentials holds between a node and its parent."""
    return _sort(node) * 4 + _sort(parent)


def _labels(nodes: list[Node]) -> list[int]:
    """The label of the nearest labelled element; above those, whether any main text is inside."""
    given: list[int | None] = []
    for n in nodes:
        given.append(n.label if n.label is not None else given[n.parent] if n.parent >= 0 else None)
    inside = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        inside[i] |= int(nodes[i].tag == "#text" and given[i] == 1)
        if nodes[i].parent >= 0:
            inside[nodes[i].parent] |= inside[i]
    return [g if g is not None else x for g, x in zip(given, inside, strict=True)]


def labelled_pages(count: int = PAGES, seed: int = 41) -> Iterator[str]:
    """Pages in which ``data-main`` says what is main text and what is not (features skip it)."""
    rng = random.Random(seed)
    letters = "aeioustnrlmdchpéüñ"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    prose = lambda: " ".join(line(4, 14).capitalize() + rng.choice(("." * 6 + "!?")) for _ in range(rng.choice((1, 2, 3, 4, 5, 6, 6, 25))))
    link = lambda: f'<a href="/{word()}">{line(1, 3)}</a>'

    def paragraph() -> str:
        body = rng.choice((prose, prose, prose, prose, prose, lambda: line(1, 6), lambda: line(15, 60), lambda: line(60, 900)))()
        body = rng.choice((body, body, f"<b>{body}</b>", f"<b>{body}<br>", f"{body} {link()} {line(2, 9)}.", f"<em>{word()}</em> {body}"))
        return rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<h2>{}</h2>")).format(body)

    def boiler(inner: bool) -> str:
        many = " ".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))
        kind = rng.choice(("ad", "ad", "related", "share", "aside", "form", "notice", "comments", "comments") if inner else ("nav", "nav", "header", "footer", "footer", "ad", "ad", "sidebar", "aside", "form", "notice", "comments", "breadcrumb", "related"))
        said = lambda: f"<p>{prose()}</p>"
        return {
            "nav": lambda: rng.choice((f"<nav><ul>{many}</ul></nav>", f'<div class="{rng.choice(("menu", "nav", "navbar", "navigation main-nav", "site-menu"))}"><ul>{many}</ul></div>', f'<ul id="menu">{many}</ul>', f'<div role="navigation">{many}</div>')),
            "header": lambda: rng.choice((f"<header><h1>{line(1, 3)}</h1><p>{line(2, 7)}</p></header>", f'<header class="site-header">{link()} {line(1, 5)}</header>', f'<div id="header"><h2>{line(1, 3)}</h2>{link()}</div>', f'<div class="masthead banner">{line(1, 4)}</div>')),
            "footer": lambda: rng.choice((f"<footer>&copy; {word()}.example.com &middot; {prose()}</footer>", f"<footer><p>{prose()}</p>{link()}</footer>", f'<div class="{rng.choice(("footer", "site-footer", "copyright", "legal"))}">&copy; {line(2, 12)}</div>', f'<div id="footer">{said()}</div>')),
            "ad": lambda: rng.choice((f'<div class="{rng.choice(("ad", "ads", "advert", "ad-box", "advertisement", "sponsored", "promo"))}">{rng.choice((prose(), said(), link()))}</div>', f'<aside class="ad">{prose()}</aside>', f'<section class="promo sponsored"><h3>{line(1, 4)}</h3>{said()}</section>')),
            "sidebar": lambda: rng.choice((f'<div class="{rng.choice(("sidebar", "side", "right-column widget", "widget-area"))}"><h3>{line(1, 3)}</h3>{said()}<ul>{many}</ul></div>', f'<div id="sidebar">{said()}{link()}</div>')),
            "aside": lambda: f"<aside><h3>{line(1, 3)}</h3>{rng.choice((said(), f'<ul>{many}</ul>'))}</aside>",
            "form": lambda: rng.choice((f'<form action="/s"><label>{line(1, 4)}</label><input name="q"><p>{line(3, 12)}</p><button>{word()}</button></form>', f'<div class="{rng.choice(("newsletter", "subscribe", "signup", "search", "login"))}"><p>{prose()}</p><form><input><button>{word()}</button></form></div>')),
            "notice": lambda: f'<div {rng.choice(("class", "id"))}="{rng.choice(("cookie", "cookie-notice", "cookie-banner", "notice", "gdpr consent", "popup modal", "alert", "paywall"))}">{rng.choice((prose(), said()))}<button>OK</button></div>',
            "comments": lambda: rng.choice((f'<{{0}} {rng.choice(("class", "id"))}="{rng.choice(("comments", "comment-list", "comments-area", "disqus_thread", "responses", "replies"))}"><h3>{line(1, 3)}</h3>{"".join(rng.choice((said(), f"<div class=comment>{said()}</div>", f"<ul><li class=comment><b>{word()}</b>{said()}</li></ul>")) for _ in range(rng.randint(1, 4)))}</{{0}}>',)).format(rng.choice(("div", "section"))),
            "related": lambda: f'<{{0}} class="{rng.choice(("related", "related-posts", "more-stories", "recommended", "read-more"))}"><h3>{line(1, 4)}</h3><ul>{many}</ul></{{0}}>'.format(rng.choice(("div", "section", "aside"))),
            "share": lambda: f'<div class="{rng.choice(("share", "social", "share-buttons", "tags", "byline meta", "author-bio"))}">{link()} {line(1, 6)} {link()}</div>',
            "breadcrumb": lambda: f'<div class="{rng.choice(("breadcrumb", "breadcrumbs", "pager pagination"))}">{link()} &gt; {link()}</div>',
        }[kind]()

    outside = lambda part: re.sub(r"^<(\w+)", r"<\1 data-main=0", part)
    for _ in range(count):
        body = [f"<h1>{line(2, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8, 12))):
            body.append(paragraph())
            if rng.random() < 0.12:
                body.append(rng.choice((f"<ul>{''.join(f'<li>{line(3, 12)}</li>' for _ in range(rng.randint(2, 5)))}</ul>", f"<ol><li>{prose()}</ol>", f"<pre>{line(3, 12)}</pre>", f"<table><tr><td>{line(1, 4)}<td>{line(1, 5)}</table>", f"<figure><img src=x><figcaption>{line(3, 9)}</figcaption></figure>")))
            if rng.random() < 0.12:
                body.append(outside(boiler(True)))
        if rng.random() < 0.12:
            body += [f"<p>{line(1, 3)}{rng.choice(('.', ''))}</p>" for _ in range(rng.randint(4, 25))]
        inner = "".join(body)
        start = rng.choice(("<article{}>", "<article{}>", "<article{}>", "<main{}>", '<div class="{}"{{}}>'.format(rng.choice(("content", "article", "post", "entry-content", "post-body", "story", "article-body", "main-content"))), '<div id="{}"{{}}>'.format(rng.choice(("content", "main", "article", "story"))), "<div{}>"))
        main = start.format(" data-main=1") + inner + ("</" + start[1:].split("{")[0].split()[0].strip(">") + ">")
        if rng.random() < 0.3:
            main = f"<main>{main}{outside(boiler(True)) if rng.random() < 0.4 else ''}</main>"
        wrapped = lambda: outside(boiler(False))
        yield f'<!DOCTYPE html><html><head><title>{line(2, 8)}</title><script>var t="</p>";</script></head><body>{"".join(wrapped() for _ in range(rng.randint(1, 4)))}{main}{"".join(wrapped() for _ in range(rng.randint(0, 4)))}</body></html>'


def train(pages: Iterable[str] | None = None) -> Model:
    """Evidence by logistic regression, potentials by counts of label pairs beyond chance."""
    rows, cols, y = [], [], []
    pages = list(labelled_pages() if pages is None else pages)
    held = pages[len(pages) * 4 // 5 :]
    counts, base = np.tile(np.array([[4.0, 0.5], [0.5, 4.0]]), (16, 1, 1)), np.full(2, 0.5)
    for page in pages[: len(pages) * 4 // 5]:
        nodes = parse(page)
        labels = _labels(nodes)
        for i, on in enumerate(features(nodes)):
            rows += [len(y)] * len(on)
            cols += on
            y.append(labels[i])
            if i:
                kind = _kind(nodes[i], nodes[nodes[i].parent])
                counts[kind, labels[nodes[i].parent], labels[i]] += 1
                base[labels[i]] += 1
    rows, cols, y = np.array(rows), np.array(cols), np.array(y, float)
    w, m, v = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for t in range(1, 301):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], minlength=len(y)) + w[-1], -30, 30)))
        g = np.concatenate((np.bincount(cols, (p - y)[rows], minlength=SLOTS) + RIDGE * w[:-1], [(p - y).sum()])) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    given = np.log(counts / counts.sum(2, keepdims=True)) - np.log(base / base.sum())[None, None, :]
    model = Model(w[:-1], float(w[-1]), given)
    parsed = [parse(page) for page in held]
    right = {}
    for model.temper in (0.15, 0.25, 0.4, 0.6, 1.0):
        right[model.temper] = sum((p >= 0.5) == y for nodes in parsed for n, y, p in zip(nodes, _labels(nodes), model.marginals(nodes), strict=True) if n.tag == "#text")
    model.temper = max(right, key=right.get)
    return model


def extract(pages: DataFrame, model: Model, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each row; null html gives an empty text.

    The whole html is read, whatever its length. A column named ``text_col`` is replaced; all other
    columns and repeated rows stay. An empty table gives an empty result.
    """
    ship(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model)
    rest = pages.drop(text_col) if text_col != html_col else pages
    schema = T.StructType([*rest.schema.fields, T.StructField(text_col, T.StringType())])

    def run(rows: pa.RecordBatch, values: list[bytes]) -> Iterator[pa.RecordBatch]:
        out = [held.value.extract(v.decode("utf-8", "replace")) for v in values]
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.string())], schema.names)

    return rest.mapInArrow(lambda batches: words.by_batch(run, batches, html_col), schema)


def main_texts(pages: DataFrame, model: Model) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    out = extract(pages.select("page_id", "url", "html"), model)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
