"""HTML extraction by a tree-structured graphical model over the DOM.

A page is parsed into a tree: block elements, and runs of inline text as leaves. Every node is content or not. A node has
a potential from its features, every parent-child pair one from the kinds of the two, and sum-product messages, once up
and once down the tree, give each node's exact marginal of being content. Both kinds of weights are trained by the
likelihood gradient (observed minus expected features under the marginals) on labelled pages (``training_pages``). Runs
with a marginal of ``threshold`` or more are the text.

Never text: script, style, template, head, title and form controls, comments and markup. Formulas, text in drawings and
what stands in noscript, iframe, object, canvas and players are inline text, which the model judges. Character references are decoded, white
space inside a block becomes one space, blocks are trimmed and joined by one newline in page order.

Defined cases: null html counts as empty; an empty or textless page gives an empty text; unclosed and stray tags are
repaired as browsers do for paragraphs, list items and table parts; a tag with a value that is never closed ends at its
first ">"; very long, deep and broken pages are parsed without recursion, in time proportional to them; repeated rows give repeated rows; extra columns are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.common import slices, small_batches
from tesserae.llm.html_training import training_pages

SCHEMA = "page_id long, url string, text string, n_chars long"
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
VALUE_OR_END = re.compile(r"[>=]")
QUOTE = re.compile(r"[ \t\n\r\f]*+([\"'])")
UNQUOTED = re.compile(r"[ \t\n\r\f]*+[^\s>]*+")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/>])([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
#: Values of one tag that are looked at to find its end; a tag with more of them ends at its first ">".
MOST_VALUES = 256
#: References to numbers that no character has.
HUGE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
NAME = re.compile(r"[a-z]+")
#: Element kinds (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title".split())
SKIP = RAW | frozenset("head select option button datalist".split())
#: Elements of formulas and drawings, and those with text for readers that cannot show them.
FOREIGN = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts"
    " mtable mtr mtd semantics annotation annotation-xml svg g text textpath defs symbol use path rect circle ellipse line polyline polygon desc".split()
)
FALLBACK = frozenset("noscript iframe noembed noframes object audio video canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SAME_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"},
}
SCOPE = frozenset("ul ol dl table div article section aside nav main body html form blockquote header footer td th".split())
#: Names in class, id and role that say what a part is, by group (fixed values).
HINTS = {
    "content": "article content post entry story main body text prose".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc toolbar skip".split(),
    "edge": "header masthead banner topbar footer foot bottom copyright colophon logo".split(),
    "side": "sidebar side aside rail widget related recommended recommendations popular trending more".split(),
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted adsense".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall banner".split(),
    "reply": "comment comments reply replies respond discussion disqus".split(),
    "form": "form search login share social sharing feedback".split(),
}
HINT_OF: dict[str, list[str]] = {}
for _group, _names in HINTS.items():
    for _name in _names:
        HINT_OF.setdefault(_name, []).append(_group)


class Node:
    __slots__ = ("tag", "parent", "attrs", "text", "links", "depth")

    def __init__(self, tag: str, parent: int, attrs: str, text: str | None = None, links: int = 0, depth: int = 0) -> None:
        self.tag, self.parent, self.attrs, self.text, self.links, self.depth = tag, parent, attrs, text, links, depth


def tag_end(source: str, at: int) -> tuple[int, bool]:
    """Where the tag whose name ends at ``at`` ends, and whether its values are closed. Some ">" must follow.

    A ">" within a quoted value does not end a tag. If a quoted value is never closed the tag ends at its first ">".
    """
    i = at
    for _ in range(MOST_VALUES):
        found = VALUE_OR_END.search(source, i)
        if not found:
            break
        i = found.end()
        if found.group() == ">":
            return i, True
        quote = QUOTE.match(source, i)
        if quote:
            close = source.find(quote[1], quote.end())
            if close < 0:
                break
            i = close + 1
        else:
            i = UNQUOTED.match(source, i).end()
    return source.index(">", at) + 1, False


class Parser:
    """Builds the nodes of a page. The work is in proportion to the page: open elements are found by name, not searched."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.nodes = [Node("#root", -1, "")]
        self.stack = [0]  # open block elements
        self.opened: dict[str, list[int]] = {}  # places in the stack, by name
        self.inline: dict[str, int] = {}  # open inline elements since the last block
        self.run: list[str] = []
        self.links = self.anchors = self.tokens = 0

    def flush(self) -> None:
        if self.run:
            text = " ".join(html.unescape(HUGE.sub("\ufffd", "".join(self.run))).split())
            if text:
                top = self.stack[-1]
                self.nodes.append(Node("#", top, "", text, min(self.links, len(text)), self.nodes[top].depth + 1))
            self.run.clear()
        self.links = 0

    def text(self, text: str) -> None:
        self.run.append(text)
        self.tokens += not text.isspace()
        if self.anchors:
            self.links += len(text.strip())

    def close(self, names: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of ``names`` with all inside it, unless one of ``stop`` is open inside it."""
        opened = self.opened
        k = max((opened[x][-1] for x in names if opened.get(x)), default=-1)
        if k < 0 or max((opened[x][-1] for x in stop if opened.get(x)), default=-1) > k:
            return
        self.flush()
        for i in self.stack[k:]:
            opened[self.nodes[i].tag].pop()
        del self.stack[k:]
        self.inline.clear()
        self.anchors = 0

    def open(self, name: str, attrs: str) -> None:
        self.flush()
        self.nodes.append(Node(name, self.stack[-1], attrs, depth=self.nodes[self.stack[-1]].depth + 1))
        self.opened.setdefault(name, []).append(len(self.stack))
        self.stack.append(len(self.nodes) - 1)

    def parse(self) -> list[Node]:
        source, n = self.source, len(self.source)
        last = source.rfind(">")
        at = 0
        while at < n:
            mark = source.find("<", at)
            if mark < 0 or mark > last:  # no tag ends from here on
                self.text(source[at:])
                break
            if mark > at:
                self.text(source[at:mark])
            if source.startswith("<!--", mark):
                end = source.find("-->", mark + 2)
                at = end + 3 if end >= 0 else n
                continue
            if source.startswith(("<!", "<?"), mark):
                at = source.index(">", mark) + 1
                continue
            found = TAG.match(source, mark + 1)
            if not found:
                self.text("<")
                at = mark + 1
                continue
            at, closed = tag_end(source, found.end())
            name = found[2].lower()
            if found[1]:
                self.end_tag(name)
            else:
                at = self.start_tag(name, source[found.end() : at - 1] if closed else "", at)
        self.flush()
        return self.nodes

    def raw_end(self, name: str, at: int) -> re.Match | None:
        return re.compile(rf"</{re.escape(name)}\s*+>", re.IGNORECASE).search(self.source, at)

    def between(self, name: str, end: bool) -> bool:
        """Tags that stand in a run of text and leave at most a space there."""
        if name in ("br", "wbr"):
            self.run.append(" " if name == "br" else "")
        elif name in FOREIGN:
            if name in ("math", "svg"):
                self.tokens = 0
            elif not end and self.tokens:  # between the parts of a formula or drawing
                self.run.append(" ")
        elif name in FALLBACK:
            self.run.append(" ")
        else:
            return False
        return True

    def end_tag(self, name: str) -> None:
        if self.between(name, True):
            return
        if name in INLINE:
            if self.inline.get(name):
                self.inline[name] -= 1
                self.anchors -= name == "a"
        elif name not in VOID:
            self.close({name})

    def start_tag(self, name: str, attrs: str, at: int) -> int:
        """Opens an element; returns where the page goes on."""
        if name in RAW:
            done = self.raw_end(name, at)
            return done.end() if done else len(self.source)
        if self.between(name, False):
            return at
        if name == "xmp":  # its text is no markup
            self.flush()
            done = self.raw_end(name, at)
            self.run.append(html.escape(self.source[at : done.start() if done else len(self.source)]))
            self.flush()
            return done.end() if done else len(self.source)
        if name in INLINE:
            self.inline[name] = self.inline.get(name, 0) + 1
            self.anchors += name == "a"
            return at
        if name in VOID:
            if name == "hr":
                self.flush()
            else:
                self.run.append(" ")
            return at
        if name == "body":
            self.close({"head"})
        if name in CLOSES_P:
            self.close({"p"}, SCOPE)
        if name in SAME_END:
            self.close(SAME_END[name], SCOPE - SAME_END[name])
        self.open(name, attrs)
        return at


def parse(source: str) -> list[Node]:
    """The nodes in page order, parents first: block elements, and runs of inline text (tag '#')."""
    return Parser(source).parse()


def hints(attrs: str) -> set[str]:
    found: set[str] = set()
    if "=" in attrs:
        for name, *values in ATTRIBUTE.findall(attrs):
            if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                for word in NAME.findall("".join(values).lower()):
                    found.update(HINT_OF.get(word, ()))
    return found


KINDS = {t: k for k, group in enumerate((("#",), ("#root", "html", "body"), ("article", "main"), ("div", "section", "td", "center"), ("p", "pre", "blockquote"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "li", "dt", "dd"), ("nav", "menu"), ("header", "footer"), ("aside",), ("form", "fieldset"), ("table", "tbody", "thead", "tr"), ("figure", "figcaption"))) for t in group}
N_KINDS = 14


#: Elements that say which part of a page they hold, and single blocks, whose names in class and id say little.
REGIONS = {"article": "main", "main": "main", "nav": "menu", "menu": "menu", "header": "top", "footer": "foot", "aside": "side", "form": "form"}
LINES = frozenset("p li dt dd td th tr tbody thead h1 h2 h3 h4 h5 h6 figcaption caption figure blockquote pre address summary table".split())


def features_of(nodes: list[Node]) -> Iterator[list[str]]:
    """The names of each node's features, node by node; a leaf has those of its run of text, an element those of its tag and names.

    Both have the region of the page that they stand in (the nearest element that names one, and whether it lies within
    the main part) and their place: before or after the first main heading, and after the last longer sentence.
    """
    n = len(nodes)
    length, linked = [0] * n, [0] * n
    heading = tail = -1
    for i in range(n - 1, 0, -1):
        node = nodes[i]
        if node.text is not None:
            length[i], linked[i] = len(node.text), node.links
            if tail < 0 and length[i] > 90 and 2 * linked[i] < length[i]:
                tail = i
        elif node.tag == "h1":
            heading = i
        length[node.parent] += length[i]
        linked[node.parent] += linked[i]
    regions = ["none"] * n
    for i, node in enumerate(nodes):
        density = min(3, int(linked[i] / length[i] * 4)) if length[i] else 0
        region = regions[node.parent] if i else "none"
        found: set[str] = set()
        if node.text is None:
            found = hints(node.attrs)
            own = REGIONS.get(node.tag)
            if own is None and node.tag not in LINES and found:
                own = "main" if found == {"content"} else "named"
            if own:
                region = own if own == "main" or not region.startswith(("main", "in ")) else f"in main {own}"
        regions[i] = region
        names = ["bias", f"density {density}", f"density {density} in {region}", f"length {min(9, length[i].bit_length())}", f"region {region}"]
        place = "no heading" if heading < 0 else "before" if i < heading else "tail" if i > tail else "after"
        names += [f"place {place}", f"place {place} in {region}"]
        if node.text is None:
            kind = "line" if node.tag in LINES else "box"
            names += [f"tag {node.tag}", *(f"{kind} {h}" for h in sorted(found))]
        else:
            t = node.text
            words = min(6, (t.count(" ") + 1).bit_length())
            stop = "stop" if t[-1] in ".!?…。" else "open"
            names += ["leaf", f"words {words}", f"words {words} {stop} in {region}", f"under {nodes[node.parent].tag}", stop]
            if "©" in t or "copyright" in t.lower() or "all rights reserved" in t.lower():
                names.append(f"copyright in {region}")
        yield names


def pair_kind(nodes: list[Node], i: int) -> int:
    return KINDS.get(nodes[nodes[i].parent].tag, N_KINDS - 1) * N_KINDS + KINDS.get(nodes[i].tag, N_KINDS - 1)


def content_marginals(nodes: list[Node], score: list[float], pairs: list[tuple[float, float, float, float]], joint: list[tuple] | None = None) -> list[float]:
    """Marginals of content; score: log odds, pairs: log potentials (00, 01, 10, 11).

    ``joint``, if given, gets the marginals of each (parent, child) state pair.
    """
    n = len(nodes)
    up0, up1 = [0.0] * n, list(score)  # log of node potential times messages from the children
    msg0, msg1 = [0.0] * n, [0.0] * n
    add = lambda a, b: (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))
    for i in range(n - 1, 0, -1):
        q = pairs[i]
        m0, m1 = add(q[0] + up0[i], q[1] + up1[i]), add(q[2] + up0[i], q[3] + up1[i])
        shift = m0 if m0 > m1 else m1
        msg0[i], msg1[i] = m0 - shift, m1 - shift
        p = nodes[i].parent
        up0[p] += msg0[i]
        up1[p] += msg1[i]
    down0, down1 = [0.0] * n, [0.0] * n
    marginal = [0.0] * n
    for i in range(n):
        if i:
            p, q = nodes[i].parent, pairs[i]
            r0, r1 = up0[p] - msg0[i] + down0[p], up1[p] - msg1[i] + down1[p]
            d0, d1 = add(r0 + q[0], r1 + q[2]), add(r0 + q[1], r1 + q[3])
            shift = d0 if d0 > d1 else d1
            down0[i], down1[i] = d0 - shift, d1 - shift
            if joint is not None:
                cells = (r0 + q[0] + up0[i], r0 + q[1] + up1[i], r1 + q[2] + up0[i], r1 + q[3] + up1[i])
                top = max(cells)
                weights = [math.exp(c - top) for c in cells]
                total = sum(weights)
                joint.append(tuple(w / total for w in weights))
        odds = up1[i] + down1[i] - up0[i] - down0[i]
        marginal[i] = 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0
    return marginal


def truth(nodes: list[Node], wanted: list[str]) -> list[int]:
    """Node labels of a labelled page: leaves by their text, elements content if most of their text is."""
    rest = set(wanted)
    n = len(nodes)
    good, total = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        node = nodes[i]
        if node.text is not None:
            total[i] = len(node.text)
            good[i] = total[i] if node.text in rest else 0
        total[node.parent] += total[i]
        good[node.parent] += good[i]
    return [int(2 * g > t > 0) for g, t in zip(good, total, strict=True)]


@lru_cache(maxsize=16)
def trained(n_pages: int = 320, epochs: int = 10, rate: float = 0.3, seed: int = 5, families: tuple[str, ...] | None = None) -> tuple[dict, list]:
    """Feature weights and pair potentials, by AdaGrad on the log likelihood of labelled pages (of some families of layouts)."""
    number: dict[str, int] = {}
    pages = []
    for source, wanted in training_pages(n_pages, seed, families):
        nodes = parse(source)
        names = list(features_of(nodes))
        counts = np.array([len(fs) for fs in names])
        index = np.array([number.setdefault(f, len(number)) for fs in names for f in fs])
        y = np.array(truth(nodes, wanted))
        kinds = np.array([pair_kind(nodes, i) if i else 0 for i in range(len(nodes))])
        parents = np.array([node.parent for node in nodes])
        pages.append((nodes, index, counts, np.cumsum(counts) - counts, y, kinds, 2 * y[parents] + y))
    weights, grown = np.zeros(len(number)), np.full(len(number), 1e-4)
    pairs, pairs_grown = np.zeros((N_KINDS * N_KINDS, 4)), np.full((N_KINDS * N_KINDS, 4), 1e-2)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(pages)):
            nodes, index, counts, first, y, kinds, states = pages[k]
            score = np.add.reduceat(weights[index], first)
            joint: list[tuple] = []  # of all nodes but the first
            marginal = content_marginals(nodes, score.tolist(), list(map(tuple, pairs[kinds].tolist())), joint)
            g = np.bincount(index, np.repeat(y - np.array(marginal), counts), len(weights)) / len(nodes) - 1e-4 * weights
            grown += g * g
            weights += rate * g / np.sqrt(grown)
            if len(nodes) > 1:
                gp = np.zeros_like(pairs)
                np.add.at(gp, kinds[1:], -np.array(joint))
                np.add.at(gp, (kinds[1:], states[1:]), 1)
                gp = gp / len(nodes) - 1e-4 * pairs
                pairs_grown += gp * gp
                pairs += 0.3 * rate * gp / np.sqrt(pairs_grown)
    return dict(zip(number, weights.tolist(), strict=True)), [tuple(row) for row in pairs.tolist()]


def skipped(nodes: list[Node]) -> list[bool]:
    """Whether a node is inside an element whose text is never read."""
    out = [False] * len(nodes)
    for i in range(1, len(nodes)):
        out[i] = out[nodes[i].parent] or nodes[i].tag in SKIP
    return out


def blocks(source: str, model: tuple[dict, list], threshold: float = 0.5) -> list[str]:
    """The content blocks of a page, in page order."""
    nodes = parse(source)
    never = skipped(nodes)
    weights, pairs = model
    get = weights.get
    score = [sum(get(f, 0.0) for f in fs) for fs in features_of(nodes)]
    marginal = content_marginals(nodes, score, [pairs[pair_kind(nodes, i)] if i else (0.0, 0.0, 0.0, 0.0) for i in range(len(nodes))])
    return [n.text for n, m, no in zip(nodes, marginal, never, strict=True) if n.text is not None and m >= threshold and not no]


def extract(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars of every page. The model is trained once, on the driver, and sent as a few kilobytes."""
    model = trained()
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in slices(batches, "html"):
            texts = ["\n".join(blocks(s.as_py(), model, threshold)) for s in sources]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, SCHEMA)
