"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every block element is a variable: content or not.  Its own evidence (tag, names in class and id,
text, links) gives unary potentials, and each parent and child share a potential that depends on
the child's kind.  Sum-product messages go up the tree and down again and give exact marginals; the
text of nodes more likely content than not, in page order, is the result.

The weights are fitted by maximum likelihood (the gradient is observed less expected features,
the expectations from the same message passing) on labelled pages.  There is no labelled corpus, so the labelled
pages are made by ``labelled_pages``: layouts of many kinds with invented words, whose blocks are
known.  Any other labelled pages can be given instead.

All pages of an Arrow batch are one forest, whose levels are passed over in numpy.  No shuffle.

Defined cases: null or empty html, or html without text, gives an empty text; a null id or url stays
null; repeated rows get equal results; unclosed or stray tags never fail; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .htmltree import Node, joined, parse

TAGS = ("html", "article", "main", "section", "div", "p", "h1", "h2", "li", "ul", "nav", "header", "footer", "aside", "form", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "dl", "address", "button", "label")
SAME_TAG = {"h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "ol": "ul", "menu": "ul", "th": "td", "tbody": "tr", "thead": "tr", "tfoot": "tr", "dt": "dl", "dd": "dl", "fieldset": "form", "dialog": "aside", "summary": "p", "details": "div", "center": "div", "caption": "figcaption"}
#: Words in class, id or role that tell what a block is for.
NAMES = {
    "content": "content|article|post|entry|story|main|text|prose|body",
    "menu": "nav|navbar|navigation|menu|breadcrumbs?|toc|pagination|pager|skip",
    "header": "header|masthead|banner|topbar|branding|logo|hero",
    "footer": "footer|bottom|copyright|colophon|legal|disclaimer|contentinfo",
    "side": "side|sidebar|aside|widgets?|related|recommended|recommendations|popular|trending|rail|complementary|more|teasers?",
    "advert": "ads?|adv|advert|adverts|advertisement|adsense|promo|promotion|sponsor|sponsored|banner-ad|outbrain|taboola",
    "notice": "notice|notices|cookies?|consent|gdpr|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|paywall|announcement|warning|toast",
    "comment": "comments?|commentlist|replies|reply|respond|discussion|disqus|reviews?|responses|feedback|guestbook",
    "form": "form|search|login|signin|contact|input",
    "share": "share|sharing|social|tags|meta|byline|author|follow|rating",
}
PATTERNS = [re.compile(rf"(?:^|[^a-z])(?:{x})(?:$|[^a-z])") for x in NAMES.values()]
TEXT_KIND, SPECIAL_KIND, HOLDER_KIND = 0, 1, 2
KINDS = {**dict.fromkeys(("p", "h1", "h2", "li", "ul", "blockquote", "pre", "figure", "figcaption", "tr", "td", "table", "dl"), TEXT_KIND), **dict.fromkeys(("nav", "header", "footer", "aside", "form", "article", "main", "button", "label", "address"), SPECIAL_KIND)}
WIDTH = len(TAGS) + 2 * len(PATTERNS) + 12
PAGES, STEPS, RATE, SHRINK, SEED = 240, 250, 0.5, 2e-3, 7


class Forest:
    """Arrays of all nodes of some pages."""

    def __init__(self, pages: list[list[Node]]):
        sizes = [len(x) for x in pages]
        shift = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes) if sizes else np.zeros(0, np.int64)
        flat = [x for nodes in pages for x in nodes]
        parent = np.array([x.parent for x in flat], np.int64)
        self.parent = np.where(parent < 0, -1, parent + shift)
        self.depth = np.array([x.depth for x in flat], np.int64)
        tags = [SAME_TAG.get(x.tag, x.tag) for x in flat]
        self.kind = np.array([KINDS.get(x, HOLDER_KIND) for x in tags], np.int64)
        self.levels = np.split(np.argsort(self.depth, kind="stable"), np.cumsum(np.bincount(self.depth))[:-1])
        self.x = self._features(flat, tags)

    def _features(self, flat: list[Node], tags: list[str]) -> np.ndarray:
        n = len(flat)
        x = np.zeros((n, WIDTH))
        place = {t: k for k, t in enumerate(TAGS)}
        own = np.zeros((n, 4))  # characters, linked characters, sentence marks, words
        for i, (node, tag) in enumerate(zip(flat, tags, strict=True)):
            if tag in place:
                x[i, place[tag]] = 1
            if node.names:
                for k, pattern in enumerate(PATTERNS):
                    if pattern.search(node.names):
                        x[i, len(TAGS) + k] = 1
            if node.pieces:
                text = "".join(p for _, p in node.pieces)
                solid = text.strip()
                own[i] = len(solid), min(node.linked, len(solid)), sum(map(solid.count, ".,;!?")), solid.count(" ") + bool(solid)
        under = own.copy()
        for level in self.levels[:0:-1]:
            np.add.at(under, self.parent[level], under[level])
        k = len(TAGS) + len(PATTERNS)
        inherited = x[:, len(TAGS) : k].copy()
        for level in self.levels[1:]:
            inherited[level] = np.maximum(inherited[level], inherited[self.parent[level]])
        x[:, k : k + len(PATTERNS)] = inherited
        k += len(PATTERNS)
        ratio = lambda a, b: a / np.maximum(b, 1)
        x[:, k] = 1
        x[:, k + 1] = own[:, 0] > 0
        x[:, k + 2] = np.log1p(own[:, 0]) / 5
        x[:, k + 3] = ratio(own[:, 1], own[:, 0])
        x[:, k + 4] = np.minimum(ratio(own[:, 2], own[:, 3]) * 4, 2)
        x[:, k + 5] = np.log1p(under[:, 0]) / 7
        x[:, k + 6] = ratio(under[:, 1], under[:, 0])
        x[:, k + 7] = np.minimum(ratio(under[:, 2], under[:, 3]) * 4, 2)
        x[:, k + 8] = own[:, 3] >= 8
        x[:, k + 9] = own[:, 3] >= 25
        x[:, k + 10] = np.minimum(self.depth, 10) / 10
        x[:, k + 11] = (own[:, 0] > 0) & (own[:, 3] <= 3)
        return x

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(node is content), and P(parent's state, node's state) of each node; unary: log-odds, pair: [kind, parent, child]."""
        n = len(unary)
        up, down = np.zeros((n, 2)), np.zeros((n, 2))
        up[:, 1] = unary
        sent = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            both = pair[self.kind[level]] + up[level][:, None, :]
            sent[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(up, self.parent[level], sent[level])
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            rest = up[p] + down[p] - sent[level]
            both = pair[self.kind[level]] + rest[:, :, None]
            down[level] = np.logaddexp(both[:, 0, :], both[:, 1, :])
            joint[level] = both + up[level][:, None, :]
        belief = up + down
        content = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        top = joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint - top)
        return content, joint / joint.sum(axis=(1, 2), keepdims=True)


class Model:
    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair

    def texts(self, pages: list[str | None]) -> list[str]:
        trees = [parse(x or "") for x in pages]
        forest = Forest(trees)
        content, _ = forest.marginals(forest.x @ self.weights, self.pair)
        out, k = [], 0
        for nodes in trees:
            out.append(joined(nodes, (content[k : k + len(nodes)] > 0.5).tolist()))
            k += len(nodes)
        return out


def fit(pages: list[tuple[str, list[bool]]]) -> Model:
    """From pages and a label for each of their nodes, in page order."""
    forest = Forest([parse(x) for x, _ in pages])
    y = np.array([v for _, labels in pages for v in labels], np.int64)
    if len(y) != len(forest.parent):
        raise ValueError("a label for each node is needed")
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    weights, pair, n = np.zeros(WIDTH), np.zeros((3, 2, 2)), len(pages)
    speed_w, speed_p = np.zeros(WIDTH), np.zeros((3, 2, 2))
    for _ in range(STEPS):
        content, joint = forest.marginals(forest.x @ weights, pair)
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, forest.kind[child], joint[child])
        step_w = forest.x.T @ (y - content) / n - SHRINK * weights * 10
        step_p = (seen - expected) / n - SHRINK * pair * 10
        speed_w, speed_p = speed_w + step_w**2, speed_p + step_p**2
        weights += RATE * step_w / np.sqrt(speed_w + 1e-9)
        pair += RATE * step_p / np.sqrt(speed_p + 1e-9)
    return Model(weights, pair)


class _Maker:
    """One labelled page: markup and, in the order of the nodes, whether each is content."""

    def __init__(self, rnd: random.Random):
        self.rnd, self.out, self.labels, self.content = rnd, [], [False], False

    def words(self, low: int, high: int) -> str:
        syllables = ("ka", "lo", "mi", "ter", "sun", "val", "or", "en", "pri", "du", "sha", "ne", "ro", "gi")
        words = ["".join(self.rnd.choices(syllables, k=self.rnd.randint(1, 4))) for _ in range(self.rnd.randint(low, high))]
        if self.rnd.random() < 0.15:  # some pages shout, or are strewn with marks
            words = [w.upper() + "!!" for w in words] if self.rnd.random() < 0.5 else [w + self.rnd.choice(("***", "%%%", "$$$")) for w in words]
        for k in range(0, len(words), self.rnd.randint(4, 12)):
            words[k] = words[k].capitalize()
            if k:
                words[k - 1] += self.rnd.choice((".", ".", ",", "?"))
        return " ".join(words) + self.rnd.choice((".", ".", ""))

    def block(self, tag: str, inner, names: str = "", content: bool | None = None) -> None:
        kept, self.content = self.content, self.content if content is None else content
        self.labels.append(self.content)
        named = f' {self.rnd.choice(("class", "class", "id"))}="{names}"' if names and self.rnd.random() < 0.85 else ""
        self.out.append(f"<{tag}{named}>")
        inner() if callable(inner) else self.out.append(inner)
        if not (tag in ("p", "li") and self.rnd.random() < 0.15):
            self.out.append(f"</{tag}>")
        self.content = kept

    def links(self, names: str) -> None:
        n = self.rnd.randint(2, 9)
        if self.rnd.random() < 0.7:
            self.block("ul", lambda: [self.block("li", f'<a href="/{i}">{self.words(1, 3)}</a>') for i in range(n)], names)
        else:
            self.block("div", " ".join(f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)), names)

    def paragraphs(self, n: int) -> None:
        for _ in range(n):
            kind = self.rnd.random()
            if kind < 0.75:
                lead = self.rnd.choice(("", "", "", "<b>"))
                self.block("p", lead + self.words(1, 8) if self.rnd.random() < 0.2 else lead + self.words(8, 90))
            elif kind < 0.82:
                self.block("h2", self.words(2, 6))
            elif kind < 0.88:
                self.block("ul", lambda: [self.block("li", self.words(2, 15)) for _ in range(self.rnd.randint(2, 5))])
            elif kind < 0.92:
                self.block("blockquote", lambda: self.block("p", self.words(5, 30)))
            elif kind < 0.95:
                self.block("table", lambda: [self.block("tr", lambda: [self.block("td", self.words(1, 4)) for _ in range(2)]) for _ in range(3)])
            else:
                self.block(self.rnd.choice(("div", "aside", "p")), self.words(3, 30), self.rnd.choice(("ad", "advert", "promo", "newsletter", "related", "share", "notice")), False)

    def comments(self) -> None:
        def each():
            self.block("h2", self.words(1, 3))
            for _ in range(self.rnd.randint(1, 6)):
                self.block(self.rnd.choice(("div", "article", "li")), lambda: [self.block("p", self.words(2, 40)) for _ in range(self.rnd.randint(1, 2))], self.rnd.choice(("comment", "reply", "comment-body", "review")), False)

        self.block(self.rnd.choice(("section", "div", "ul")), each, self.rnd.choice(("comments", "comment-list", "replies", "respond", "discussion")), False)

    def article(self) -> None:
        tag, name = self.rnd.choice((("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post entry"), ("section", "story"), ("div", "main-text"), ("div", "")))

        def inner():
            if self.rnd.random() < 0.75:
                self.block("h1", self.words(2, 12))
            if self.rnd.random() < 0.15:
                self.block("div", self.words(2, 5), self.rnd.choice(("byline", "meta", "share")), False)
            self.paragraphs(self.rnd.randint(1, 9))
            if self.rnd.random() < 0.2:
                self.comments()

        if tag == "article" and self.rnd.random() < 0.3:
            self.block("main", lambda: self.block(tag, inner, name, True), "", True)
        else:
            self.block(tag, inner, name, True)

    def around(self) -> None:
        r = self.rnd.random()
        if r < 0.2:
            self.block("aside", lambda: (self.block("h2", self.words(1, 3)), self.links("")), "sidebar")
        elif r < 0.4:
            self.block("div", self.words(2, 25), self.rnd.choice(("ad", "ads", "advertisement", "banner ad", "promo", "sponsored")))
        elif r < 0.6:
            self.block("div", lambda: self.block("p", self.words(4, 30)), self.rnd.choice(("cookie-notice", "notice", "consent", "newsletter", "alert", "popup")))
        elif r < 0.75:
            self.block("form", lambda: (self.block("label", self.words(1, 2)), self.block("button", self.words(1, 2))), self.rnd.choice(("search", "login", "")))
        else:
            self.block("div", lambda: (self.block("h2", self.words(1, 4)), self.links("")), self.rnd.choice(("sidebar", "related", "widget", "popular")))

    def bare(self) -> tuple[str, list[bool]]:
        """A page that is its text, with little or no markup."""
        self.labels[0] = self.content = True
        if self.rnd.random() < 0.5:
            self.out.append(self.words(4, 40))
        if self.rnd.random() < 0.7:
            self.paragraphs(self.rnd.randint(1, 5))
        if self.rnd.random() < 0.4:
            self.block("footer", self.words(3, 12), "", False)
        return "".join(self.out), self.labels

    def page(self) -> tuple[str, list[bool]]:
        if self.rnd.random() < 0.1:
            return self.bare()
        if self.rnd.random() < 0.85:
            self.block(*self.rnd.choice((("nav", lambda: self.links("")), ("header", lambda: (self.block("h1" if self.rnd.random() < 0.2 else "div", self.words(1, 4)), self.block("nav", lambda: self.links("")))), ("div", lambda: self.links("menu"), "header"), ("div", lambda: self.links(""), "nav"), ("header", self.words(1, 6)))))
        for _ in range(self.rnd.choice((0, 1, 1, 2))):
            self.around()
        wrapped = self.rnd.random() < 0.35
        if wrapped:
            self.block("div", lambda: (self.article(), [self.around() for _ in range(self.rnd.randint(0, 2))]), self.rnd.choice(("wrapper", "container", "page", "row", "")))
        else:
            self.article()
        if self.rnd.random() < 0.3:
            self.comments()
        for _ in range(self.rnd.choice((0, 0, 1, 2))):
            self.around()
        if self.rnd.random() < 0.9:
            foot = lambda: (self.block("p", "&copy; " + self.words(2, 25)), self.links("") if self.rnd.random() < 0.5 else None)
            self.block(*self.rnd.choice((("footer", "&copy; " + self.words(3, 25)), ("footer", foot), ("div", foot, "footer"))))
        return "<!DOCTYPE html><html><body>" + "".join(self.out) + "</body></html>", self.labels


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[bool]]]:
    rnd = random.Random(seed)
    return [_Maker(rnd).page() for _ in range(n)]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = model or fit(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = model.texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = T.StructType([*(T.StructField(x, pages.schema[x].dataType) for x in ("page_id", "url")), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select("page_id", "url", "html").mapInArrow(run, own)
