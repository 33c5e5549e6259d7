"""Main-text extraction from HTML by gradient-boosted trees over DOM-node features.

A lenient one-pass parser turns a page into nodes (block elements, and any element whose
id, class or role says something) in page order, with their own text. It reads each
character once and holds at most MAX_DEPTH open elements, as browsers do, so that broken
markup costs no more than other text. Features of a node: its tag, its attribute tokens,
depth, density of text, links and form controls in its subtree, shares of the parent's and
page's text, and statistics of its siblings. Attribute tokens are hashed into SLOTS; what a
slot tells, as log odds of main text, is learned, from pages other than those that the trees
are fitted on, and a node has its own slots' values and those of the elements around it (a
body's names tell nothing). Subtrees are contiguous in page order, so most sums are
differences of running sums over a whole batch of pages.

The trees are fitted on the driver, by a fixed seed and once a session, on TRAIN_PAGES
generated pages whose layout and labels are known; real pages have no labels. Half of the
generated names say nothing, and bodies, wrappers and articles carry words of other parts as
well, so that the trees must go by form, too. Decoding is the best labelling of the whole
tree under a grammar: a node is outside, inside, or cut out; inside starts once on a path,
what is cut out of it stays out, so no choice contradicts an ancestor's. Menu and footer
elements of the page (by tag; not those within an article element) are never inside. A
paragraph, heading, item or cell without a name of its own is never cut out of its article
by itself, and one between two chosen siblings is chosen. A page may have no main text.

Text: character references decoded, white space inside a block made one space, blocks in
page order joined by a newline. Never text: scripts, styles, templates, frames, drawings,
form controls, and what stands for them where they are off.

Edge cases: null or empty html gives an empty text; a page without any tag is one block
of text; unclosed and stray tags are closed as far as nesting allows; what follows a tag
that never ends is part of that tag; elements nested deeper than MAX_DEPTH are siblings;
repeated rows give equal rows; an empty table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

import html as html_lib
import math
import random
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

from .common import lean

TRAIN_PAGES, NAME_PAGES = 4000, 1600
#: Slots of hashed attribute tokens.
SLOTS = 1 << 17
#: Occurrences by which a slot is held near what is common.
PRIOR = 1.0
#: Pages that a slot must be on to tell anything.
SUPPORT = 4
#: Elements open at once.
MAX_DEPTH = 512
TREES, DEPTH, RATE, BINS = 120, 5, 0.2, 32
#: Share of the training nodes that each tree sees.
SHARE = 0.25
#: Log-odds that a part of the main text must have against it to be cut out.
CUT_COST = 2.0
#: Log-odds added for the main text: to lose some of it is worse than to keep too much.
LEAN = 1.0

# Element names by how HTML treats them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg textarea title select noembed noframes".split())
CONTROLS = set("input select textarea button option".split())
MATH = set("math mi mn mo mrow ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object canvas".split()) | MATH
# A start tag of the key closes an open element of the value, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "tbody", "thead"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"", *"ul ol dl table article section main div nav aside footer header form body html blockquote".split()}

_TAG_KINDS = ["p", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd menu", "table tr td th tbody thead caption", "article main", "div section", "nav", "header", "footer", "aside", "form button fieldset input option", "blockquote pre figure figcaption", "body html"]
_KIND = {tag: k for k, tags in enumerate(_TAG_KINDS) for tag in tags.split()}
_TAG_FLAG = {"nav": 1, "footer": 2, "header": 4, "aside": 8, "form": 16, "button": 16, "fieldset": 16, "article": 32, "main": 32}
TAG_FLAGS = 6
#: Flags of menu and footer elements: outside of articles they are parts of the page.
PAGE_PARTS, ARTICLE = 3, 32
#: Flags of tags that hold no main text.
ASIDE = 31
OTHER = len(_TAG_KINDS)
ITEM, BODY = 2, OTHER - 1
#: Kinds that hold text: paragraphs, headings, items, cells, quotations.
SOLID = np.array([0, 1, 11])
_ITEMS = {"li", "dt", "dd", "td", "th", "tr", "tbody", "caption"}

#: A comment, a declaration, or a tag. An end that is missing is the page's end; nothing is
#: given back once read, so the pattern takes time in proportion to what it reads.
_TOKEN = re.compile(r"""<!--(?:.*?-->|.*+\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
_ATTRS = re.compile(r"""(?:^|\s)(?:id|class|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_LABEL = re.compile(r"data-y=(\d)")


@dataclass
class Page:
    """Nodes in page order (node 0 is the page) and segments of text."""

    kind: list[int] = field(default_factory=lambda: [OTHER])
    parent: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    flags: list[int] = field(default_factory=lambda: [0])  # what its tag says
    around: list[int] = field(default_factory=lambda: [0])  # flags of the node and its ancestors
    solid: list[bool] = field(default_factory=lambda: [False])  # text that is not cut out by itself
    token_node: list[int] = field(default_factory=list)  # of each attribute token
    token: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=lambda: [1])
    label: list[int] = field(default_factory=lambda: [0])
    controls: list[int] = field(default_factory=lambda: [0])  # form controls right in the node
    name: list[int] = field(default_factory=lambda: [0])  # a code of its tag and attributes
    node: list[int] = field(default_factory=list)  # of each segment
    block: list[int] = field(default_factory=list)
    link: list[bool] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


def attribute_tokens(values: list[str]) -> list[int]:
    """Slots of the words of id, class and role, and of each whole name: what `ad` tells by
    itself is more than in `ad-free`."""
    found = set()
    for value in values:
        for name in value.strip("\"'").split():
            words = _WORD.findall(_CAMEL.sub(r"\1 \2", name).lower())
            found.update(words)
            found.add("=" + "-".join(words))
    return [zlib.crc32(word.encode()) % SLOTS for word in found]


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)


def parse(source: str) -> Page:
    page = Page(label=[int(source.startswith("<!--data-y=1-->"))])
    stack: list[tuple[str, int]] = [("", 0)]  # (tag, node); inline elements keep the node around
    open_: Counter[str] = Counter()
    endless: set[str] = set()  # raw elements that end nowhere from here on
    links, block, at = 0, 0, 0
    node, hidden = 0, 0

    def pop(k: int) -> None:
        """Closes the elements from place k of the stack on."""
        nonlocal links, block, node, hidden
        while len(stack) > k:
            tag, own = stack.pop()
            open_[tag] -= 1
            links -= tag == "a"
            hidden -= tag == "head"
            block += tag not in INLINE
            node = stack[-1][1]
            if own != node:
                page.end[own] = len(page.kind)

    def text(value: str) -> None:
        if hidden or not value:
            return
        if not value.isspace():
            page.node.append(node)
            page.block.append(block)
            page.link.append(links > 0)
            page.text.append(value)
        elif page.block and page.block[-1] == block and not page.text[-1].endswith(" "):
            page.text[-1] += " "

    def end(tag: str) -> None:
        nonlocal block
        for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
            if stack[k][0] == tag:
                pop(k)
                return
            if tag in INLINE and stack[k][0] not in INLINE:
                return  # an inline end tag reaches no further than its block
        block += tag not in INLINE

    def shut(tags: set[str], whole: bool) -> None:
        """Closes open elements of `tags`, the nearest or all of them, up to a container."""
        if not any(open_[t] for t in tags):
            return
        k = len(stack) - 1
        while stack[k][0] not in SCOPE and stack[k][0] not in tags:
            k -= 1
        while k > 0 and stack[k][0] in tags:
            pop(k)
            k -= 1
            if not whole:
                return

    size = len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            end(tag)
            continue
        if tag in CONTROLS:
            page.controls[node] += 1
        if tag in RAW:
            close = _raw_end(tag).search(source, at) if tag not in endless and not attrs.endswith("/") else None
            if close:
                at = close.end()
            elif not attrs.endswith("/"):
                endless.add(tag)
                at = size if tag in ("script", "style") else at
            block += tag != "svg"
            continue
        if tag == "xmp":  # its text is no markup
            close = _raw_end(tag).search(source, at) if tag not in endless else None
            if close is None:
                endless.add(tag)
            block += 1
            text(source[at : close.start() if close else size].replace("&", "&amp;"))
            block += 1
            at = close.end() if close else size
            continue
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif tag not in INLINE:
                block += 1
            continue
        if tag not in INLINE:
            block += 1
            shut({"p"}, False)
            shut(CLOSES.get(tag, set()), True)
        flags = _TAG_FLAG.get(tag, 0)
        names = _ATTRS.findall(attrs) if "=" in attrs else []
        own = node
        if tag not in INLINE or names:
            own = len(page.kind)
            page.kind.append(_KIND.get(tag, OTHER))
            page.parent.append(node)
            page.depth.append(page.depth[node] + 1)
            page.flags.append(flags)
            page.around.append(page.around[node] | flags)
            page.end.append(own + 1)
            marked = _LABEL.search(attrs)
            page.label.append(int(marked[1]) if marked else page.label[node])
            page.controls.append(0)
            page.solid.append(not names and (tag in _ITEMS or _KIND.get(tag) in SOLID))
            slots = attribute_tokens(names) if names and page.kind[own] != BODY else []
            page.token_node.extend([own] * len(slots))
            page.token.extend(slots)
            page.name.append(zlib.crc32(" ".join([tag, *names]).encode()) if names else 0)
        if (not attrs.endswith("/") or tag in INLINE) and len(stack) < MAX_DEPTH:
            stack.append((tag, own))
            open_[tag] += 1
            node = own
            links += tag == "a"
            hidden += tag == "head"
    pop(1)
    page.end[0] = len(page.kind)
    return page


_SENTENCE = re.compile(r"[.,;:!?。，；！？](?=\s|$)")


#: A name with lower log odds than this marks its element as something else than main text.
TELLING = -1.5


def features(pages: list[Page], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, feature) over all nodes of the pages, and n+1 offsets of pages. `odds`: what
    each slot of attribute tokens tells."""
    sizes = [len(p.kind) for p in pages]
    offs = np.append(0, np.cumsum(sizes)).astype(np.int64)
    base = np.repeat(offs[:-1], sizes)
    cat = lambda name: np.concatenate([np.asarray(getattr(p, name), np.int64) for p in pages]) if pages else np.zeros(0, np.int64)
    n = int(offs[-1])
    kind, flags, around, depth = cat("kind"), cat("flags"), cat("around"), cat("depth")
    parent, end = cat("parent") + base, cat("end") + base
    at = np.concatenate([np.asarray(p.node, np.int64) + o for p, o in zip(pages, offs, strict=False)]) if pages else np.zeros(0, np.int64)
    texts = [t for p in pages for t in p.text]
    length = np.array([len(t) for t in texts], np.float64)
    words = np.array([t.count(" ") + 1 for t in texts], np.float64)
    marks = np.array([len(_SENTENCE.findall(t)) for t in texts], np.float64)
    rights = np.array(["©" in t or "&copy;" in t for t in texts], float)
    linked = np.array([x for p in pages for x in p.link], bool)

    def own(values: np.ndarray) -> np.ndarray:
        return np.bincount(at, values, n) if len(at) else np.zeros(n)

    def below(values: np.ndarray) -> np.ndarray:
        total = np.append(0.0, np.cumsum(values))
        return total[end] - total[np.arange(n)]

    chars, nodes = own(length), np.ones(n)
    in_links = own(length * linked)
    told_at = np.concatenate([np.asarray(p.token_node, np.int64) + o for p, o in zip(pages, offs, strict=False)]) if pages else np.zeros(0, np.int64)
    told = odds[np.concatenate([np.asarray(p.token, np.int64) for p in pages])] if pages else np.zeros(0)
    told_sum, told_low, told_high = np.bincount(told_at, told, n) if n else np.zeros(0), np.zeros(n), np.zeros(n)
    np.minimum.at(told_low, told_at, told)
    np.maximum.at(told_high, told_at, told)
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if n else []
    low_path, sum_path = told_low.copy(), told_sum.copy()
    for level in levels[1:]:
        low_path[level] = np.minimum(low_path[level], low_path[parent[level]])
        sum_path[level] += sum_path[parent[level]]
    low_above, sum_above = low_path[parent], sum_path[parent]
    s_chars, s_words, s_marks, s_links = below(chars), below(own(words)), below(own(marks)), below(in_links)
    s_nodes, s_bad, s_p, s_heads = below(nodes), np.zeros(n), below((kind == 0).astype(float)), below((kind == 1).astype(float))
    s_main = below((kind == 4).astype(float)) - (kind == 4)
    aside = ((flags & ASIDE) > 0) | (told_sum < TELLING)
    for level in levels[:0:-1]:  # text of other elements within a node, not what is said of itself
        np.add.at(s_bad, parent[level], np.where(aside[level], s_chars[level], s_bad[level]))
    in_p = own(length * ~linked) * np.isin(kind, SOLID)
    kin = np.bincount(parent, np.where(np.arange(n) == base, 0.0, in_p), n)[parent] if n else in_p  # of the siblings that hold text
    s_plain = below(in_p)
    s_controls = below(cat("controls").astype(float))
    page_chars, before = np.maximum(s_chars[base], 1.0), np.append(0.0, np.cumsum(chars))[np.arange(n)]
    before = before - before[base]
    root = np.arange(n) == base
    kids = np.bincount(parent[~root], minlength=n)
    order = np.arange(n)
    # place among the parent's children, and neighbours' text
    by = np.lexsort((order, parent))
    by = by[~root[by]]
    first = np.append(True, parent[by][1:] != parent[by][:-1]) if len(by) else np.zeros(0, bool)
    rank = np.zeros(n)
    start = np.flatnonzero(first)
    rank[by] = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    left, right = np.zeros(n), np.zeros(n)
    left[by[1:]] = np.where(first[1:], 0.0, s_chars[by[:-1]]) if len(by) else 0
    right[by[:-1]] = np.where(first[1:], 0.0, s_chars[by[1:]]) if len(by) else 0
    alike = np.bincount(parent * (OTHER + 1) + kind, minlength=n * (OTHER + 1))[parent * (OTHER + 1) + kind]
    name = cat("name")
    _, group, much = np.unique(np.stack([parent, name]), axis=1, return_inverse=True, return_counts=True) if n else (None, kind, kind)
    twins = np.where(name > 0, much[group.reshape(-1)] - 1, 0)  # siblings of the same tag and names
    below_twins = below((twins > 0).astype(float))
    ratio = lambda a, b: a / np.maximum(b, 1.0)
    columns = [(kind == k).astype(float) for k in range(OTHER + 1)]
    columns += [((around >> b) & 1).astype(float) for b in range(TAG_FLAGS)]
    columns += [
        depth.astype(float), np.log1p(chars), np.log1p(s_chars), ratio(in_links, chars), ratio(s_links, s_chars), ratio(s_chars, s_nodes), ratio(s_chars, s_words),
        ratio(s_marks, s_words), kids.astype(float), s_p, s_heads, s_main, ratio(s_bad, s_chars), s_chars / page_chars, ratio(s_chars, s_chars[parent]),
        rank, ratio(rank, kids[parent]), alike / np.maximum(kids[parent], 1), before / page_chars, np.log1p(left), np.log1p(right), ratio(s_words, s_p + s_heads + 1),
        s_controls, ratio(s_controls, s_nodes), (name > 0).astype(float), np.log1p(twins), ratio(below_twins, s_nodes), np.log1p(page_chars), ratio(s_words, s_nodes),
        told_sum, told_low, told_high, low_above, sum_above, np.log1p(kin), ratio(kin, s_chars[parent]), np.log1p(s_plain), ratio(s_plain, s_chars), np.log1p(s_chars[parent]), s_p[parent], below(own(rights)),
    ]
    return np.stack(columns, 1).astype(np.float32) if n else np.zeros((0, 1), np.float32), offs


# --------------------------------------------------------------- boosted trees

@dataclass
class Trees:
    """Boosted trees; `odds` is what attribute tokens tell, which features() takes."""

    feature: np.ndarray  # (tree, inner node)
    cut: np.ndarray
    leaf: np.ndarray  # (tree, leaf)
    base: float
    odds: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._block(x[lo : lo + 4096]) for lo in range(0, len(x), 4096)]) if len(x) else np.zeros(0)

    def _block(self, x: np.ndarray) -> np.ndarray:
        """A block of rows that stays in the processor's cache from tree to tree."""
        out, flat, rows = np.full(len(x), self.base), x.ravel(), np.arange(len(x)) * x.shape[1]
        inner = self.feature.shape[1]
        levels = inner.bit_length()
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(levels):
                node = 2 * node + 1 + (flat.take(rows + f.take(node)) > c.take(node))
            out += leaf.take(node - inner)
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees of fixed depth for the logistic loss, split on histograms."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    flat, rng = binned + np.arange(k) * BINS, np.random.default_rng(1)
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = float(np.log(mean / (1 - mean)))
    score = np.full(n, base)
    inner = 2**depth - 1
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node, seen = np.zeros(n, np.int64), np.sort(rng.choice(n, max(1, int(n * SHARE)), replace=False))
        own_flat, weights = flat[seen], [np.repeat(v[seen], k) for v in (g, h)]
        for d in range(depth):
            first, count = 2**d - 1, 2**d
            cell = ((node[seen] - first)[:, None] * (k * BINS) + own_flat).reshape(-1)
            sums = [np.bincount(cell, v, count * k * BINS).reshape(count, k, BINS) for v in weights]
            (gl, hl), (ga, ha) = [s.cumsum(2) for s in sums], [s.sum(2)[:, :, None] for s in sums]
            gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
            gain[(hl < 1) | (ha - hl < 1)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for q in range(count):
                j, b = divmod(int(best[q]), BINS)
                if gain[q, j, b] > 1e-6 and b < len(edges[j]):
                    out.feature[t, first + q], out.cut[t, first + q] = j, edges[j][b]
            own = out.feature[t, node]
            node = 2 * node + 1 + (x[np.arange(n), own] > out.cut[t, node])
        leaf = node - inner
        out.leaf[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        score += out.leaf[t, leaf]
    return out


# -------------------------------------------------------------------- decoding

def decode(logit: np.ndarray, parent: list[int], weight: np.ndarray, solid: list[bool] | None = None, barred: list[bool] | None = None) -> np.ndarray:
    """Which nodes are inside, by the best labelling of the tree: outside may turn inside,
    inside may turn cut out at a cost (but not at a solid node), cut out stays. Barred nodes
    are never inside."""
    n = len(parent)
    bar = barred or [False] * n
    cost = [math.inf if x else CUT_COST for x in solid] if solid else [CUT_COST] * n
    yes, no = (-np.logaddexp(0, -logit) * weight).tolist(), (-np.logaddexp(0, logit) * weight).tolist()
    best = [[o, i, o] for i, o in zip(yes, no, strict=True)]  # outside, inside, cut out
    for k in range(n - 1, 0, -1):
        out, inside, cut = best[k]
        up = best[parent[k]]
        up[0] += out if bar[k] else max(out, inside)
        up[1] += cut if bar[k] else max(inside, cut - cost[k])
        up[2] += cut
    state = [0] * n
    state[0] = 1 if best[0][1] > best[0][0] else 0
    for k in range(1, n):
        above, (out, inside, cut) = state[parent[k]], best[k]
        state[k] = 2 if above == 2 or (above and bar[k]) else (1 if inside >= cut - cost[k] else 2) if above == 1 else (1 if inside > out and not bar[k] else 0)
    return np.array(state) == 1


def close_runs(inside: np.ndarray, page: Page) -> np.ndarray:
    """Solid nodes between two siblings that are inside are inside, with all below them."""
    inside = inside.copy()
    waiting: dict[int, list[int]] = {}  # solid nodes since the last child that is inside
    for k in range(1, len(inside)):
        up = page.parent[k]
        if inside[up]:
            continue
        if inside[k]:
            for q in waiting.get(up, ()):
                inside[q : page.end[q]] = True
            waiting[up] = []
        elif not page.solid[k]:
            waiting.pop(up, None)
        elif up in waiting:
            waiting[up].append(k)
    return inside


def render(page: Page, inside: np.ndarray) -> str:
    blocks: list[str] = []
    last, parts = -1, []
    for node, block, text in zip(page.node, page.block, page.text, strict=True):
        if not inside[node]:
            continue
        if block != last and parts:
            blocks.append("".join(parts))
            parts = []
        last = block
        parts.append(text)
    blocks.append("".join(parts))
    clean = [" ".join((html_lib.unescape(b) if "&" in b else b).split()) for b in blocks]
    return "\n".join(b for b in clean if b)


def chosen(page: Page, logit: np.ndarray) -> np.ndarray:
    """The nodes of the main text."""
    chars = np.bincount(page.node, [len(t) for t in page.text], len(page.kind)) if page.node else np.zeros(len(page.kind))
    return close_runs(decode(logit + LEAN, page.parent, 0.3 + np.log1p(chars), page.solid, [(a & PAGE_PARTS) > 0 and not a & ARTICLE for a in page.around]), page)


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    pages = [parse(s) for s in sources]
    x, offs = features(pages, trees.odds)
    logit = trees.logit(x)
    return [render(page, chosen(page, logit[lo:hi])) for page, lo, hi in zip(pages, offs[:-1], offs[1:], strict=True)]


# -------------------------------------------------------------- training pages

# Words in names that generated pages give to their parts.
PART_NAMES = {
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager tabs toolbar sitemap menue navegacion",
    "foot": "footer foot bottom copyright colophon legal contentinfo fusszeile pied rodape impressum",
    "head": "header masthead topbar banner logo branding kopfzeile entete cabecera",
    "side": "sidebar aside side rail widget widgets complementary column right left seitenleiste lateral",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion werbung anzeige publicite publicidad anuncio",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message disclaimer hinweis avis aviso",
    "form": "form search login signup subscribe subscription newsletter register formular formulaire formulario suche recherche",
    "comment": "comment comments commentlist reply replies respond discussion disqus feedback kommentar kommentare commentaire commentaires comentario comentarios",
    "more": "share sharing social related recommended recommendations trending popular tags tag author meta byline teilen partager compartir",
    "main": "article content main post entry story text body page prose maincontent artikel inhalt beitrag contenu contenido articulo",
}
# Names that blog software and frameworks write on bodies, wrappers and articles, whatever those hold.
HABITS = "home blog single single-post page-template page-template-default menu-open nav-open no-sidebar has-sidebar sidebar-right header-fixed sticky-header footer-dark logged-in search-enabled comments-open no-comments has-ads ad-free cookie-accepted modal-open with-banner wp-singular tag-archive social-enabled".split()
ARTICLE_HABITS = "post type-post status-publish format-standard has-post-thumbnail hentry h-entry category-news category-social tag-politics tag-menu tag-video author-post author-admin author-comment comment-status-open col-right col-left column-main right-rail-open has-related share-enabled entry node-article node-promoted form-page widget-area-none".split()


def training_page(rng: random.Random, named_only: bool = False) -> str:
    """A generated page whose elements carry data-y=1 inside the main text, else 0."""
    pool = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(60)]

    def words(n: int) -> str:
        out = [rng.choice(pool) for _ in range(max(1, n))]
        for k in range(rng.randint(5, 14), len(out), rng.randint(6, 16)):
            out[k] += rng.choice([".", ",", ".", ";", "?"])
        return " ".join(out).capitalize() + rng.choice([".", ".", "", "!"])

    def rich(n: int) -> str:
        text = words(n).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(text))
            text[k] = rng.choice(["<a href='/x'>{}</a>", "<b>{}</b>", "<em>{}</em>", "<span>{}</span>"]).format(text[k])
        return " ".join(text)

    plain = rng.random() < 0.5 and not named_only  # a page whose names say nothing

    def named(part: str, tags: list[str], y: int = 0) -> tuple[str, str]:
        """A start tag with a name that tells the part, a name that tells nothing, or none."""
        tag = rng.choice(tags)
        how = rng.random()
        name = rng.choice(PART_NAMES[part].split()) if part in PART_NAMES and not plain else rng.choice(pool)
        name = f"{rng.choice(pool)}-{name}" if rng.random() < 0.2 else name
        attr = f' class="{name}"' if how < 0.55 else f' id="{name}"' if how < 0.75 else f' class="{rng.choice(pool)} c{rng.randrange(99)}"' if how < 0.85 else ""
        return f"<{tag}{attr} data-y={y}>", f"</{tag}>"

    def habits(names: list[str], chance: float) -> list[str]:
        """Names that are there by habit, and names of other parts."""
        return rng.sample(names, rng.randint(1, 5)) + [rng.choice(PART_NAMES[rng.choice(list(PART_NAMES))].split()) for _ in range(rng.randint(0, 1))] if rng.random() < chance else []

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(rng.randint(1, 4))}</a></li>' for k in range(n)) + "</ul>"

    def loose(n: int) -> str:
        return "".join(f"<p>{rich(rng.randint(3, 50))}</p>" if rng.random() < 0.6 else f"<div>{words(rng.randint(2, 30))}</div>" if rng.random() < 0.5 else words(rng.randint(2, 25)) for _ in range(n))

    def boiler(part: str) -> str:
        tags = {"nav": ["nav", "nav", "div", "ul"], "foot": ["footer", "footer", "div"], "head": ["header", "header", "div"], "side": ["aside", "aside", "div"], "ad": ["div", "div", "aside", "section"], "notice": ["div", "section", "p"], "form": ["form", "form", "div"], "comment": ["section", "div", "ol"], "more": ["div", "section", "ul", "aside"]}[part]
        a, b = named(part, tags)
        if part == "nav":
            body = links(rng.randint(2, 12)) if rng.random() < 0.8 else " ".join(f"<a href='/{k}'>{words(1)}</a>" for k in range(rng.randint(1, 6)))
        elif part == "form":
            body = "".join(f"<label>{words(2)}</label><input name=q>" for _ in range(rng.randint(1, 4))) + f"<button>{words(1)}</button>"
            body = (f"<p>{words(rng.randint(3, 20))}</p>" if rng.random() < 0.5 else "") + (f"<form>{body}</form>" if rng.random() < 0.5 else body)
        elif part == "comment":
            item = rng.choice(pool) if plain else rng.choice(["reply", "item", "c", "comment"])
            who, date, text, answer = rng.choice(["b", "i", "span", "h4", "cite"]), rng.random() < 0.5, rng.choice(["p", "p", "div"]), rng.random() < 0.4
            turn = lambda: f"<{who}>{words(rng.randint(1, 2))}</{who}> " + (f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{rng.randint(10, 26)} " if date else "") + f"<{text}>{rich(rng.randint(3, 60))}</{text}>" + (f"<a href='#r'>{words(1)}</a>" if answer else "")
            body = "".join(f"<p>{words(rng.randint(1, 20))}</p>" for _ in range(rng.randint(1, 4))) if rng.random() < (0.05 if plain else 0.3) else (f"<h3>{words(2)}</h3>" if rng.random() < 0.7 else "") + "".join(f"<div class='{item}'>{turn()}</div>" if rng.random() < 0.9 else f"<div>{turn()}</div>" for _ in range(rng.randint(1, 8)))
        elif part == "foot":
            body = rng.choice(["&copy; ", "© ", "&copy; ", "", "<p>"]) + words(rng.randint(1, 20)) + (links(rng.randint(2, 8)) if rng.random() < 0.5 else "") + (loose(1) if rng.random() < 0.3 else "")
        elif part == "head":
            body = (f"<h1>{words(3)}</h1>" if rng.random() < 0.3 else f"<div>{words(2)}</div>") + (links(rng.randint(3, 8)) if rng.random() < 0.5 else "")
        elif part == "more":
            body = f"<h3>{words(2)}</h3>" + links(rng.randint(2, 6))
        elif part in ("ad", "notice") and rng.random() < 0.4:
            body = words(rng.randint(1, 8)).rstrip("." if rng.random() < 0.5 else " ")
        else:
            body = loose(rng.randint(1, 3)) + (links(rng.randint(2, 6)) if rng.random() < (0.5 if part == "side" else 0.1) else "")
        return a + body + b

    def article() -> str:
        bare = rng.random()
        habit = f" class='{' '.join(rng.sample(ARTICLE_HABITS, rng.randint(1, 6)) + habits(HABITS, 0.2))}'" if not plain and rng.random() < 0.5 else ""
        a, b = (f"<article{habit} data-y=1>", "</article>") if bare < 0.3 else (f"<div{habit} data-y=1>", "</div>") if habit and bare < 0.5 else ("<main data-y=1>", "</main>") if bare < 0.4 else named("main", ["div", "div", "section", "article", "td"], 1)
        out = [f"<h1>{words(rng.randint(1, 9))}</h1>"] if rng.random() < 0.8 else []
        if out and rng.random() < 0.15:
            out = [f"<header{f' class={chr(34)}{rng.choice(pool)}-header{chr(34)}' if rng.random() < 0.5 else ''}>{out[0]}</header>"]
        brief = rng.random() < 0.15
        linked, short, same = rng.random() < 0.06, rng.random() * 0.4, rng.random() < 0.05
        inner = rng.choice(["p", "p", "p", "p", "div", "mixed"])  # how paragraphs are marked up
        for _ in range(rng.choice([1, 1, 2, 3]) if brief else rng.choice([1, 1, 2, 3, 4, 5, 6, 8, 10, 14, 25])):
            kind = rng.random()
            if kind < 0.7:
                tag = inner if inner != "mixed" else rng.choice(["p", "div"])
                name = f' class="{rng.choice(pool)}"' if rng.random() < 0.1 else ""
                value = rng.choice(["* * *", words(1), words(2), words(3)]) if rng.random() < short else out[-1].split(">", 1)[-1].split("</")[0] if same and len(out) > 1 else rich(rng.randint(2, 12 if brief else 110))
                value = f"<a href='/{rng.choice(pool)}'>{value}</a>" if linked and "<a" not in value else value
                out.append(f"<{tag}{name}>{value}" + (f"</{tag}>" if tag == "div" or rng.random() < 0.9 else ""))
            elif kind < 0.78:
                out.append(f"<h2>{words(rng.randint(1, 6))}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{rich(rng.randint(1, 25))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote>{rich(rng.randint(5, 40))}</blockquote>")
            elif kind < 0.90:
                out.append("<table>" + "".join(f"<tr><td>{words(2)}</td><td>{words(2)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>")
            elif kind < 0.93:
                out.append(f"<figure><img src=x.png><figcaption>{words(rng.randint(2, 15))}</figcaption></figure>")
            elif kind < 0.96:
                out.append(words(rng.randint(3, 40)) + rng.choice([" ", "<br><br>"]))
            else:
                out.append(f"<pre>{words(rng.randint(4, 30))}</pre>")
        if rng.random() < 0.25:  # sections, or a wrapper, within the article
            cut = rng.randint(0, len(out))
            out = [*out[:cut], f"<{(w := rng.choice(['div', 'section']))} class='{rng.choice(pool)}'>", *out[cut:], f"</{w}>"]
        for part in ("ad", "more", "notice", "form", "comment", "side", "nav"):
            if rng.random() < (0.2 if part in ("ad", "more") else 0.08) * (0.5 if plain else 2):  # without a name, hard to tell
                out.insert(rng.randint(0, len(out)) if part in ("ad", "notice") else len(out), boiler(part))
        return a + "".join(out) + b

    make = rng.random()
    if make < 0.1:  # no page, but a piece of text
        few = rng.random() < 0.5
        return "<!--data-y=1-->" + "".join(rng.choice([f"<p>{rich(rng.randint(1, 3 if few else 60))}</p>", f"<div>{words(rng.randint(1, 3 if few else 40))}</div>", f"<p>{words(rng.randint(1, 4))}", words(rng.randint(1, 3 if few else 20)) + rng.choice(["", "<br>"])]) for _ in range(rng.randint(1, 6))) + "".join(boiler(p) for p in ("comment", "ad", "foot") if rng.random() < 0.15)
    names = habits(HABITS, 0.6)
    body = f" class='{' '.join(names)}'" if names else ""

    def whole(inner: str, y: int) -> str:
        """A page, at times without the outer tags."""
        if rng.random() < (0.1 if make >= 0.2 else 0.35):
            return ("<!--data-y=1-->" if y else "") + inner
        return f"<html><head><title>{words(4)}</title></head><body{body} data-y={y}>{inner}</body></html>"

    if make < 0.2:  # a page without main text
        bare = lambda x: x if rng.random() < 0.6 else f"<div data-y=0>{x}</div>"
        bits = [boiler(p) for p in ("head", "nav", "notice", "form", "side", "more", "foot") if rng.random() < 0.3]
        bits += [bare(links(rng.randint(3, 15)))] if rng.random() < 0.4 else []
        bits += [bare("".join(f"<a href='/{k}'>{words(rng.randint(1, 4))}</a> " for k in range(rng.randint(4, 15))))] if rng.random() < 0.3 else []
        bits += [bare(f"<p>{rich(rng.randint(5, 40))}</p><button>{words(1)}</button>" + (f"<button>{words(2)}</button>" if rng.random() < 0.5 else ""))] if rng.random() < 0.4 or not bits else []
        return whole("".join(bits), 0)
    core = article()
    flat = rng.random() < 0.12  # the body itself holds the paragraphs
    if flat:
        core = core[core.index(">") + 1 : core.rindex("<")]
    before = [boiler(p) for p in ("ad", "side") if rng.random() < 0.2]
    after = [boiler(p) for p in ("ad", "side", "comment", "more", "form") if rng.random() < 0.25]
    core = "".join(before) + core + "".join(after)
    for _ in range(0 if flat else rng.choice([0, 0, 1, 1, 2, 3])):
        own = [rng.choice(pool) if plain else rng.choice(["wrap", "container", "row", "layout", "x1", "page", "content"]), *habits(HABITS, 0.3)]
        core = f"<div class='{' '.join(own)}' data-y=0>{core}</div>"
    much = rng.choice([0.3, 1, 1])
    top = [boiler(p) for p in ("head", "nav", "notice", "ad", "form") if rng.random() < 0.55 * much]
    tail = [boiler(p) for p in ("side", "more", "comment", "form", "notice", "ad", "foot") if rng.random() < 0.4 * much]
    rng.shuffle(top)
    return whole("".join([*top, core, *tail]), int(flat))


def learned_odds(pages: list[Page]) -> np.ndarray:
    """For each slot, the shrunk log odds that an element with such a token is main text."""
    at = np.concatenate([np.asarray(p.token, np.int64) for p in pages])
    y = np.concatenate([np.asarray(p.label)[p.token_node] for p in pages])
    yes, no = np.bincount(at[y == 1], minlength=SLOTS), np.bincount(at[y == 0], minlength=SLOTS)
    spread = np.bincount(np.concatenate([np.unique(p.token) for p in pages]).astype(np.int64), minlength=SLOTS)
    rate = yes.sum() / max(len(y), 1)
    return (spread >= SUPPORT) * (np.log((yes + PRIOR * rate) / (no + PRIOR * (1 - rate))) - np.log(rate / (1 - rate)))


@cache
def trained(pages: int = TRAIN_PAGES, seed: int = 5, name_pages: int = NAME_PAGES) -> Trees:
    rng = random.Random(seed)
    odds = learned_odds([parse(training_page(rng, named_only=True)) for _ in range(name_pages)])
    parsed = [parse(training_page(rng)) for _ in range(pages)]
    x, _ = features(parsed, odds)
    y, kind = (np.concatenate([getattr(p, name) for p in parsed]) for name in ("label", "kind"))
    used = (kind != ITEM) | (np.random.default_rng(seed).random(len(kind)) < 0.2)  # a page has more items than all else
    trees = fit_trees(x[used], y[used].astype(np.float64))
    trees.odds = odds
    return trees


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    held = pages.sparkSession.sparkContext.broadcast(trees or trained())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                out = main_texts(part.column("html").to_pylist(), held.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(lean(texts), "page_id long, url string, text string, n_chars long")
