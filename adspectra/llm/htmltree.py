"""HTML to a tree of block elements with their own text; tolerant of unclosed and stray tags.

An element without text of the page (``SILENT``) hides what lies between its tag and its own end tag: the one that follows in the same
block, ends of further elements of its kind set aside.  One without such an end tag hides nothing, so it never takes text of the page with it.
Only scripts and styles, whose content isn't markup, run to the next end tag of their kind, or to the page's end.  A quote opens an
attribute's value only after an equals sign, and a slash at a tag's end counts only in ``svg``.  Blocks may be nested to any depth.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Elements whose content is no text of the page.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "title", "textarea", "select", "audio", "video"}
#: Where one of these begins, an open one of the set below has ended: they can't stand in it.
BREAKS = {"svg": {"p", "div", "ul", "ol", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dl"}, "select": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section"}}
#: Of these the content isn't even markup, so the next tag is looked for after their end.
RAW = {"script", "style"}
RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
#: A slash at the end that belongs to a value without quotes.
VALUE_SLASH = re.compile(r"=\s*[^\s\"'>]*/\Z")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"html", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "p", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "dl", "dt", "dd", "address", "fieldset", "details", "summary", "center", "menu", "dialog", "button", "label", "caption"}
#: An opening tag ends these open elements, up to the nearest of the second set.
ENDS = {"li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"})}
SCOPE = {"html", "body", "td", "th", "table"}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    names: str = ""
    #: Own text pieces as (order in the page, text).
    pieces: list[tuple[int, str]] = field(default_factory=list)
    linked: int = 0


def tokens(page: str) -> tuple[list[tuple[int, int, str, bool, str]], dict[int, int]]:
    """Tags (start, stop, name, closing, attributes; no name: nothing but what is no text) and, of silent elements by number of their tag, the place after their end tag."""
    found: list[tuple[int, int, str, bool, str]] = []
    ends: dict[int, int] = {}
    open_: list[tuple[str, int]] = []  # silent elements and blocks, by number of their tag
    places: dict[str, list[int]] = defaultdict(list)  # of each name among the open ones

    def drop(k: int) -> None:
        for name, _ in open_[k:]:
            places[name].pop()
        del open_[k:]

    at = 0
    while m := TOKEN.search(page, at):
        at = m.end()
        tag, closing, attributes = (m[2] or "").lower(), bool(m[1]), m[3] or ""
        if tag in RAW:
            if not closing:
                end = RAW_ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
            tag = ""
        found.append((m.start(), at, tag, closing, attributes))
        if tag not in SILENT and tag not in BLOCKS:
            continue
        if closing:
            # The end of a block drops the silent elements in it that weren't closed; that of a silent element, the blocks in it.
            if places[tag]:
                if tag in SILENT:
                    ends[open_[places[tag][-1]][1]] = at
                drop(places[tag][-1])
            continue
        if open_ and tag in BREAKS.get(open_[-1][0], ()):
            drop(len(open_) - 1)
        if tag == "svg" and attributes.endswith("/") and not VALUE_SLASH.search(attributes):
            continue
        places[tag].append(len(open_))
        open_.append((tag, len(found) - 1))
    return found, ends


def parse(page: str) -> list[Node]:
    """Nodes in page order; node 0 is the root, and a node's parent comes before it."""
    nodes = [Node("html", -1, 0)]
    stack = [0]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag in the stack
    open_links = order = 0
    at = 0

    def text(raw: str) -> None:
        nonlocal order
        if raw:
            own = html.unescape(raw) if "&" in raw else raw
            node = nodes[stack[-1]]
            node.pieces.append((order, own))
            if open_links:
                node.linked += len(own.strip())
            order += 1

    def top(tags: set[str]) -> int:
        """The innermost open element of some tags, 0 if there is none."""
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def close(k: int) -> None:
        for n in stack[k:]:
            places[nodes[n].tag].pop()
        del stack[k:]

    found, after = tokens(page)
    for number, (begin, stop, tag, closing, attributes) in enumerate(found):
        if begin < at:
            continue
        text(page[at:begin])
        at = after.get(number, stop)
        if not tag or tag in SILENT:
            continue
        if tag == "br" or tag == "hr":
            text(" ")
        elif tag == "a":
            open_links = 0 if closing else 1
        elif tag == "body" or tag == "html":
            if not closing:
                nodes[0].names += " " + names(attributes)
        elif tag not in BLOCKS:
            continue
        elif closing:
            k = top({tag})
            if k and (tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot") or k > top(SCOPE)):
                close(k)
            open_links = 0
        else:
            ends, scope = ENDS.get(tag, ({"p"}, SCOPE | {"button"}))
            least = top(scope)
            while (k := top(ends)) > least:
                own = nodes[stack[k]].tag
                close(k)
                if own != "p":
                    break
            nodes.append(Node(tag, stack[-1], len(stack), names(attributes)))
            places[tag].append(len(stack))
            stack.append(len(nodes) - 1)
            open_links = 0
    text(page[at:])
    return nodes


def names(attributes: str) -> str:
    """Class, id and role, in lower case."""
    return " ".join(v.strip("\"'") for _, v in ATTRIBUTE.findall(attributes)).lower() if attributes else ""


def joined(nodes: list[Node], wanted: list[bool]) -> str:
    """The wanted nodes' text in page order: white space collapsed, blocks apart by one space."""
    runs: list[list] = []
    for order, k, piece in sorted((order, k, piece) for k, node in enumerate(nodes) if wanted[k] for order, piece in node.pieces):
        if runs and runs[-1][0] == k and runs[-1][1] == order - 1:
            runs[-1][1] = order
            runs[-1][2].append(piece)
        else:
            runs.append([k, order, [piece]])
    return " ".join(" ".join("".join(x[2]) for x in runs).split())
