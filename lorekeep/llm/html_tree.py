"""A small tree of a page's block elements with the features of every node."""

from __future__ import annotations

import html
import re

import numpy as np

#: Start tags, end tags, comments and declarations; an unfinished tag at the end of the page is markup too.
_MARKUP = re.compile(r"<!--(.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of the HTML standard: elements without text of their own to show, elements in a line, and implied ends.
HIDDEN = set("head title script style noscript template svg math iframe object canvas audio video select textarea datalist button option".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
LINE_ENDS = {"br", "hr"}
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

#: Words in class, id and role that tell what an element is for, by group; a node has a bit for each group.
WORDS = (
    "nav navigation menu menubar breadcrumb breadcrumbs pager pagination toolbar tabs skip",
    "header masthead top logo brand banner tagline",
    "footer foot bottom copyright legal contentinfo colophon",
    "sidebar side aside widget widgets related recommended recommendations popular trending complementary rail links tags",
    "cookie cookies consent notice alert warning gdpr popup modal overlay subscribe newsletter signup message dialog paywall",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion dfp",
    "comment comments reply replies respond discussion disqus thread feedback review reviews responses",
    "share sharing social follow login search form print byline meta",
    "article content main post entry story body text single blog prose",
)
TAGS = ("article main", "nav menu", "header", "footer", "aside", "form fieldset", "h1 h2 h3 h4 h5 h6", "p pre blockquote", "li ul ol dl dt dd", "table tr td th tbody thead", "div section")
_GROUP = {w: 1 << i for i, words in enumerate(WORDS) for w in words.split()}
_TAG = {t: 1 << i for i, tags in enumerate(TAGS) for t in tags.split()}
_MEASURES = 13
N_FEATURES = _MEASURES + 2 * (len(WORDS) + len(TAGS))


class Page:
    """Nodes in page order. ``texts`` holds (node, text, whether a block begins before it)."""

    __slots__ = ("parent", "depth", "tags", "words", "own", "links", "marks", "label", "texts", "order", "children")

    def __init__(self):
        self.parent, self.depth, self.tags, self.words = [-1], [0], [0], [0]
        self.own, self.links, self.marks = [0], [0], [0]
        self.label, self.order, self.children = [0], [0], [0]
        self.texts: list[tuple[int, str, bool]] = []

    def add(self, parent: int, tag: str, attributes: str, labelled: bool) -> int:
        words = 0
        label = self.label[parent]
        if "=" in attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                value = a or b or c
                if name.lower() == "data-y":
                    if labelled:
                        label = int(value)
                    continue
                for token in _TOKEN.findall(value):
                    words |= _GROUP.get(token.lower(), 0)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tags.append(_TAG.get(tag, 0))
        self.words.append(words)
        self.own.append(0)
        self.links.append(0)
        self.marks.append(0)
        self.label.append(label)
        self.order.append(self.children[parent])
        self.children[parent] += 1
        self.children.append(0)
        return len(self.parent) - 1


def read_page(source: str, labelled: bool = True) -> Page:
    """The tree of a page; text in hidden elements is left out. Only composed pages are ``labelled``; in others ``data-y`` means nothing."""
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    at, fresh, link, hidden = 0, True, 0, 0

    def text(piece: str) -> None:
        nonlocal fresh
        if hidden or not piece:
            return
        if "&" in piece:
            piece = html.unescape(piece)
        node = stack[-1][1]
        n = len(piece) if not piece.isspace() else 0
        page.own[node] += n
        page.marks[node] += sum(map(piece.count, ".,;:!?"))
        if link:
            page.links[node] += n
        page.texts.append((node, piece, fresh))
        fresh = False

    for m in iter(lambda: _MARKUP.search(source, at), None):
        text(source[at : m.start()])
        at = m.end()
        if (name := m.group(3)) is None:
            continue
        tag = name.lower()
        if m.group(2):
            if tag == "a":
                link = 0
            if tag in INLINE:
                continue
            fresh = True
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    hidden -= sum(t in HIDDEN for t, _ in stack[k:])
                    del stack[k:]
                    break
            continue
        if tag in INLINE:
            link = 1 if tag == "a" else link
            continue
        fresh = True
        if tag in VOID:
            continue
        if tag in ENDS_P and any(t == "p" for t, _ in stack[-3:]):
            while stack.pop()[0] != "p":
                pass
        if tag in SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in HOLDS[tag]:
                    break
                if stack[k][0] in SAME[tag]:
                    del stack[k:]
                    break
        if tag == "body":
            hidden -= sum(t in HIDDEN for t, _ in stack)
            stack = [x for x in stack if x[0] not in HIDDEN]
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        link = 0
        stack.append((tag, page.add(stack[-1][1], tag, m.group(4), labelled)))
        hidden += tag in HIDDEN
    text(source[at:])
    return page


def features(pages: list[Page]) -> np.ndarray:
    """A row of features for every node of all pages; places and counts saturate, so long pages look like others."""
    out = []
    for page in pages:
        n = len(page.parent)
        parent = page.parent
        chars, links, marks, blocks, nodes = list(page.own), list(page.links), list(page.marks), [0] * n, [1] * n
        words_above, tags_above, before, seen = [0] * n, [0] * n, [0] * n, 0
        for v in range(n):
            before[v] = seen
            seen += page.own[v]
            if v:
                p = parent[v]
                words_above[v] = words_above[p] | page.words[p]
                tags_above[v] = tags_above[p] | page.tags[p]
        for v in range(n - 1, 0, -1):
            p = parent[v]
            chars[p] += chars[v]
            links[p] += links[v]
            marks[p] += marks[v]
            nodes[p] += nodes[v]
            blocks[p] += blocks[v] + (page.own[v] > 80)
        total = chars[0] + 1
        for v in range(n):
            p = max(parent[v], 0)
            out.append((
                min(page.depth[v], 12), min(page.order[v], 9), min(page.children[p], 10), page.own[v], chars[v], links[v] / (chars[v] + 1), nodes[v] / (chars[v] + 1),
                blocks[v], chars[v] / total, chars[v] / (chars[p] + 1), marks[v] / (chars[v] + 1), before[v] / total, blocks[p],
                page.words[v], words_above[v], page.tags[v], tags_above[v],
            ))
    raw = np.array(out, np.float64)
    for k in (3, 4, 7, 12):
        raw[:, k] = np.log1p(raw[:, k])
    bits = [(raw[:, _MEASURES + k].astype(np.int64)[:, None] >> np.arange(len(g)) & 1) for k, g in enumerate((WORDS, WORDS, TAGS, TAGS))]
    return np.hstack([raw[:, :_MEASURES], *bits])
