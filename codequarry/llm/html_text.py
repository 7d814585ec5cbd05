"""Main text of web pages by boosted trees over DOM nodes.

Each page becomes a tree of its block elements. A node's features: tag, attribute words
(its own, and those of what it lies in), depth, place and size among its siblings, and
length, text and link density of its subtree, of its parent and beside the page. Boosted
trees give each node log odds of being main text. Decoding is hierarchical: under a node
that is left out everything is left out, and the best consistent choice is found from the
leaves up, so an ancestor and a descendant can't contradict each other.

There are no labelled pages, so labels are carried over: in a bounded sample of pages the
elements that fixed lists of tags and words mark as boilerplate or content are labelled.
Most of what the trees learn from is copies of these trees in which containers lose their
names, get others or are dissolved, boilerplate loses its tags and words, and boilerplate
of known shape is planted, with and without telling names. The article's own content varies
too: its paragraphs hold links, become other elements, are wrapped or split, and lists of
linked sources come between them. The labels stay those of the original, so the lists can't
explain them: shape, density and siblings have to.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.boosting import Trees, fit
from codequarry.llm.common import bounded_sample, gives_back, small_batches, table

SAMPLE_PAGES, VARIED = 250, 7  # pages to learn from, and copies of each
LONGEST_SAMPLED, LONG_PAGES = 200_000, 20  # characters of a sampled page; pages to take if all are longer
# Elements by role.
BLOCKS = set("html body article main section div header footer nav aside form fieldset ul ol li dl dt dd table tbody thead tfoot tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary hr center".split())
VOID = set("br hr img input meta link area base col embed source track wbr param".split())
SILENT = set("script style noscript template head title iframe svg object canvas select option button textarea".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "dt", "dd", "li"} | {"li"}
BOILER_TAGS = {"nav", "header", "footer", "aside", "form"}
BOILER_WORDS = set("ad ads adv advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget footer header masthead comment comments reply replies respond disqus cookie cookies consent notice alert popup modal newsletter subscribe signup login share sharing social related recommended search form toolbar pagination pager copyright legal".split())
CONTENT_WORDS = set("article content main story post entry body text page maincontent".split())
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
HOLDS_P, LISTS = {"p", "td", "th", "div", "article", "section", "body"}, {"ul", "ol", "dl", "table"}


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """start, end, name, whether it closes, and the rest of each tag; a comment has no name.

    One pass: every step goes past what it has read. A quote that isn't closed counts as
    an ordinary character, and a tag without an end as text.
    """
    last = {c: source.rfind(c) for c in ">\"'"}
    at = source.find("<")
    while 0 <= at < last[">"] or at >= 0 and source.startswith("<!--", at):
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = len(source) if end < 0 else end + 3
            yield at, end, "", False, ""
        elif m := _NAME.match(source, at):
            end = m.end()
            while (stop := _STOP.search(source, end)) and stop[0] != ">":
                end = source.find(stop[0], stop.end()) + 1 if last[stop[0]] > stop.start() else stop.end()
            if stop is None:
                end = source.find(">", m.end())
                stop_at = end if end >= 0 else len(source)
            else:
                stop_at = stop.start()
            end = stop_at + 1
            yield at, end, m[1].lower(), source[at + 1] == "/", source[m.end() : stop_at]
        elif source.startswith(("<!", "<?"), at):
            end = source.find(">", at) + 1
            yield at, end, "", False, ""
        else:
            end = at + 1
        if m_raw := _RAW_END.get(m[1].lower()) if (m := _NAME.match(source, at)) and source[at + 1] != "/" else None:
            found = m_raw.search(source, end)  # what a script and its like hold is no markup
            end = found.start() if found else len(source)
        at = source.find("<", end)


class Node:
    __slots__ = ("tag", "words", "parent", "children", "texts", "depth", "index", "links", "own")

    def __init__(self, tag: str, words: frozenset, parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.children: list[Node] = []
        self.depth, self.index = (parent.depth + 1, len(parent.children)) if parent else (0, 0)
        self.links = self.own = 0
        if parent:
            parent.children.append(self)


class Page:
    """The block elements of a page, and its text blocks as (node, text) in page order."""

    def __init__(self, source: str):
        self.root = Node("html", frozenset(), None)
        self.nodes, self.blocks = [self.root], []
        stack: list[tuple[str, Node | None]] = [("html", self.root)]
        open_: Counter = Counter()  # how many elements of a name are open
        holders: list[int] = []  # places in the stack of elements that hold paragraphs
        items: list[int] = []  # and of lists, tables and their parts
        at, node, silent, link = 0, self.root, 0, 0
        held: list[str] = []

        def close() -> None:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip() if held else ""
            if text:
                self.blocks.append((node, text))
                node.own += len(text)
            held.clear()

        def pop_to(k: int) -> None:
            nonlocal node, silent, link
            while len(stack) > k:
                tag, block = stack.pop()
                open_[tag] -= 1
                for marks in (holders, items):
                    if marks and marks[-1] == len(stack):
                        marks.pop()
                if block is not None:
                    close()
                    node = block.parent or self.root
                silent -= tag in SILENT
                link -= tag == "a"

        for start, end, tag, closes, rest in tags(source):
            if start > at and not silent:
                piece = source[at:start]
                held.append(piece)
                if link:
                    node.links += len(piece)
            at = end
            if not tag:
                continue
            if closes:
                if open_[tag]:
                    pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                continue
            if tag in VOID:
                if not silent:
                    held.append(" ")
                if tag == "hr":
                    close()
                continue
            if tag in ("html", "body") and any(t == tag for t, _ in stack[:3]):
                continue
            if tag in ENDS_P and holders and stack[holders[-1]][0] == "p":
                pop_to(holders[-1])
            if tag in CLOSES:
                k = next((k for k in reversed(items) if stack[k][0] in CLOSES[tag] or stack[k][0] in LISTS), 0)
                if k and stack[k][0] in CLOSES[tag]:
                    pop_to(k)
            block = None
            if tag in BLOCKS:
                close()
                marks = " ".join(x or y or z for x, y, z in _MARK.findall(rest)) if rest else ""
                node = block = Node(tag, frozenset(re.split(r"[^a-z]+", marks.lower())) if marks else frozenset(), node)
                self.nodes.append(node)
            if rest.endswith("/") and tag not in BLOCKS:
                continue
            if tag in HOLDS_P:
                holders.append(len(stack))
            if tag in CLOSES or tag in LISTS:
                items.append(len(stack))
            stack.append((tag, block))
            open_[tag] += 1
            silent += tag in SILENT
            link += tag == "a"
        if at < len(source) and not silent:
            held.append(source[at:])
        close()


def subtree(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """For each node, its parent's place (the root's is its own), and text, link text,
    elements, paragraphs and headings of its subtree, itself included."""
    index = {id(n): i for i, n in enumerate(nodes)}
    up = np.array([index[id(n.parent)] if n.parent else 0 for n in nodes])
    out = np.array([[n.own, min(n.links, n.own), 1, n.tag == "p", n.tag in TAG_GROUPS[1]] for n in nodes], float)
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        out[up[i]] += out[i]
    return up, out


TAG_GROUPS = [{"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"div", "section"}, {"article", "main"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "tr", "td", "th", "tbody"}, {"blockquote", "pre", "figure", "figcaption"}]


def _marks(n: Node) -> tuple[bool, bool]:
    return n.tag in BOILER_TAGS or not BOILER_WORDS.isdisjoint(n.words), n.tag in ("article", "main") or not CONTENT_WORDS.isdisjoint(n.words)


def features(nodes: list[Node]) -> np.ndarray:
    """A row of numbers for each node; nodes: a tree, parents first."""
    up, sub = subtree(nodes)
    share = sub[:, 0] / max(1.0, sub[0, 0])
    links = sub[:, 1] / np.maximum(1.0, sub[:, 0])
    marks = np.array([_marks(n) for n in nodes], float)
    beside = np.array([len(n.parent.children) if n.parent else 1 for n in nodes], float)
    place = np.array([n.index for n in nodes], float)
    telling = np.array([1.0 if n.tag in BOILER_TAGS else len(n.words & BOILER_WORDS) / max(1, len(n.words)) for n in nodes])
    wraps = (share >= 0.9) & (sub[:, 4] == sub[0, 4])  # nearly all text, and all headings
    # what a node lies in tells the less, the more of the page's text lies in it too
    above = np.column_stack([marks[:, 0] * (1 - share), marks[:, 1], links * (share < 0.5), marks[:, 0], telling * ~wraps])
    same: dict[tuple, int] = {}  # elements of one tag and parent
    kin = np.zeros(len(nodes), int)
    for i, n in enumerate(nodes):
        if i:
            above[i] = np.maximum(above[i], above[up[i]])
        kin[i] = same.setdefault((up[i], n.tag), len(same))
    sizes, totals = np.bincount(kin), np.bincount(kin, sub[:, 0])
    alike = np.column_stack([sizes[kin], totals[kin] / sizes[kin]])
    of_parent = sub[:, 0] / np.maximum(1.0, sub[up, 0])
    groups = np.array([[n.tag in g for g in TAG_GROUPS] for n in nodes], float)
    own = np.array([n.own for n in nodes], float)
    depth = np.array([n.depth for n in nodes], float)
    return np.column_stack([marks, above, depth, place, beside, (place + 1) / beside, sub, share, links, sub[:, 0] / sub[:, 2], own, of_parent, alike, share[up], links[up], sub[up, 3], sub[up, 0] / sub[up, 2], groups])


WIDTH = 28 + len(TAG_GROUPS)


def listed_labels(nodes: list[Node]) -> np.ndarray:
    """1: holds text that lies in a listed content element and in no listed boilerplate."""
    up, _ = subtree(nodes)
    out, inside, outside = (np.zeros(len(nodes), bool) for _ in range(3))
    for i, n in enumerate(nodes):
        bad, good = _marks(n)
        outside[i], inside[i] = outside[up[i]] or bad, inside[up[i]] or good
        out[i] = inside[i] and not outside[i]
    return _held(up, out)


def _held(up: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels in which also what holds main text is 1."""
    out = labels.astype(float)
    for i in range(len(up) - 1, 0, -1):
        out[up[i]] = max(out[up[i]], out[i])
    return out


# What copies of a page are made with. Names of no meaning, so that they tell nothing.
PLAIN_NAMES = [(), (), ("c",), ("row",), ("wrap", "inner"), ("box",), ("primary",), ("col", "left"), ("page", "with", "sidebar"), ("has", "header"), ("x",), ("block",)]
BOILER_NAMES = [("sidebar",), ("ad",), ("comments",), ("footer",), ("menu",), ("cookie", "notice"), ("related",), ("newsletter",), ("share",), ("widget",)]


class Copy:
    """A tree that is like a page's, built node by node, with labels."""

    def __init__(self):
        self.root = Node("html", frozenset(), None)
        self.nodes, self.labels = [self.root], [0.0]

    def add(self, parent: Node, tag: str, words: tuple, own: float, links: float, label: float) -> Node:
        n = Node(tag, frozenset(words), parent)
        n.own, n.links = own, links
        self.nodes.append(n)
        self.labels.append(label)
        return n

    def plant(self, parent: Node, rng: np.random.Generator, size: float, within: bool) -> None:
        """Boilerplate: links, a cloud of links, a notice, a foot, a form or comments.

        Within main text it has telling names, since a list of links there may be sources.
        """
        named = within or rng.random() < 0.5
        words = BOILER_NAMES[rng.integers(len(BOILER_NAMES))] if named else PLAIN_NAMES[rng.integers(8)]
        tag = str(rng.choice(["div", "section", "nav", "aside", "header", "footer"] if named else ["div", "div", "ul", "section"]))
        kind = rng.integers(6)
        few = lambda a, z: int(rng.integers(a, z))
        if kind == 0:
            top = self.add(parent, tag, words, 0, 0, 0)
            top = top if tag == "ul" else self.add(top, "ul", (), 0, 0, 0)
            for _ in range(few(2, 15)):
                n = few(2, 40)
                self.add(top, "li", (), n, n, 0)
        elif kind == 1:
            n = few(20, 400)
            self.add(parent, tag, words, n, n * rng.uniform(0.7, 1), 0)
        elif kind == 2 and named:
            tag = "aside" if within and tag in ("div", "section") and rng.random() < 0.3 else tag
            top = self.add(parent, tag, words, 0, 0, 0)
            for _ in range(few(1, 4)):
                n = few(10, 500)
                self.add(top, str(rng.choice(["p", "div"])), (), n, n * rng.uniform(0, 0.3), 0)
        elif kind == 3:
            n = few(10, 90)
            self.add(parent, "footer" if named else "div", () if named else words, n, n * rng.uniform(0.3, 1), 0)
        elif kind == 4:
            top = self.add(parent, "form", (), few(0, 60), 0, 0)
            self.add(top, "p", (), few(2, 60), 0, 0)
        else:
            total, top = size * rng.uniform(0.1, 2), self.add(parent, tag, ("comments",), 0, 0, 0)
            for k in range(few(1, 12)):
                n = max(5, int(total / 6 * rng.uniform(0.2, 2)))
                one = self.add(top, "div", ("comment",) if k % 2 else (), 0, 0, 0)
                self.add(one, "p", (), n, n * 0.02, 0)


    def prose(self, parent: Node, n: Node, tag: str, words: tuple, links: float, rng: np.random.Generator) -> Node:
        """A paragraph of main text as another element, perhaps wrapped or in two parts."""
        if rng.random() < 0.1:
            parent = self.add(parent, str(rng.choice(["div", "div", "section"])), PLAIN_NAMES[rng.integers(8)], 0, 0, 1)
        if tag == "li":
            parent = self.add(parent, str(rng.choice(["ul", "ol"])), (), 0, 0, 1)
        elif tag == "td":
            parent = self.add(self.add(parent, "table", (), 0, 0, 1), "tr", (), 0, 0, 1)
        first = n.own if rng.random() < 0.85 else int(n.own * rng.uniform(0.1, 0.9))
        if n.own > first:
            self.add(parent, tag, words, n.own - first, 0, 1)
        return self.add(parent, tag, words, first, links * first, 1)

    def sources(self, parent: Node, rng: np.random.Generator) -> None:
        """A list within main text whose items are links, or hold them."""
        share, longest = rng.uniform(0.3, 1), int(rng.integers(12, 160))
        top = self.add(parent, str(rng.choice(["ul", "ol"])), (), 0, 0, 1)
        for _ in range(int(rng.integers(1, 9))):
            own = int(rng.integers(8, longest + 1))
            held = self.add(top, "li", (), 0, 0, 1) if rng.random() < 0.1 else None
            self.add(held or top, "p" if held else "li", (), own, own * min(1.0, share * rng.uniform(0.8, 1.2)), 1)


def vary(nodes: list[Node], labels: np.ndarray, seed: int) -> tuple[list[Node], np.ndarray]:
    """A copy of a page's tree with other names, planted boilerplate and its own labels."""
    rng = np.random.default_rng(seed)
    out = Copy()
    new: dict[int, Node] = {id(nodes[0]): out.root}
    out.root.own, out.root.links = nodes[0].own, nodes[0].links
    size = sum(n.own for n, y in zip(nodes, labels, strict=True) if y)
    label_of = {id(out.root): 0.0}
    # a copy has no telling names, or those it had, or a mixture of both
    bare, dissolve = float(rng.choice([0.0, 0.5, 1.0])), rng.random() < 0.25
    # and its main text is of paragraphs, of other elements, or of both, with few or many links
    other, linked, listed = float(rng.choice([0.0, 0.1, 0.1, 1.0])), float(rng.choice([0.0, 0.1, 0.5])), float(rng.choice([0.0, 0.0, 0.1]))
    usual = "div" if other == 1 else None
    for n, y in list(zip(nodes, labels, strict=True))[1:]:
        parent = new[id(n.parent)]
        bad, good = _marks(n)
        if parent.tag in ("body", "div", "section", "article", "main") and parent is not out.root and rng.random() < 0.12:
            out.plant(parent, rng, size, within=parent.tag != "body" and label_of[id(parent)] > 0)
        tag, words = n.tag, tuple(n.words)
        if (bad or good) and rng.random() < bare:
            if good and dissolve and y and not n.own:
                new[id(n)] = parent
                continue
            tag = "div" if tag in BOILER_TAGS | {"article", "main"} and tag != "form" else tag
            words = PLAIN_NAMES[rng.integers(len(PLAIN_NAMES) if y else 8)]
        elif rng.random() < 0.1:
            words = PLAIN_NAMES[rng.integers(8)]
        if y and n.own and n.tag == "p":
            links = rng.uniform(0.01, 0.6) if rng.random() < linked else n.links / n.own
            tag = usual or (str(rng.choice(["div", "div", "blockquote", "li", "td"])) if rng.random() < other else "p")
            copy = out.prose(parent, n, tag, words, links, rng)
            if rng.random() < 0.1:
                short = int(rng.integers(5, 200))
                out.prose(parent, _Part(short), str(rng.choice(["p", "div", "h2", "h3"])), (), float(rng.choice([0, 0, rng.uniform(0, 0.6)])), rng)
            if rng.random() < listed:
                out.sources(parent, rng)
        else:
            copy = out.add(parent, tag, words, n.own, n.links, y)
            if tag in ("div", "section") and y and rng.random() < 0.1:
                copy = out.add(copy, "div", PLAIN_NAMES[rng.integers(8)], 0, 0, y)
        new[id(n)] = copy
        label_of[id(copy)] = y
    for n in [x for x in out.nodes if x.tag == "body"][:1]:
        for _ in range(int(rng.integers(0, 3))):
            out.plant(n, rng, size, within=False)
    out.nodes = _in_order(out)
    up, _ = subtree(out.nodes)
    return out.nodes, _held(up, np.array(out.labels))


class _Part:
    """So much text of a paragraph."""

    def __init__(self, own: int):
        self.own = own


def _in_order(copy: Copy) -> list[Node]:
    """The copy's nodes in page order, its labels with them."""
    label = {id(n): y for n, y in zip(copy.nodes, copy.labels, strict=True)}
    out, stack = [], [copy.root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += reversed(n.children)
    copy.labels = [label[id(n)] for n in out]
    return out


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """The likeliest choice in which nothing under a node left out is kept."""
    index = {id(n): i for i, n in enumerate(page.nodes)}
    n = len(page.nodes)
    kept, without = odds.copy(), -odds  # best sums with the node kept, and with all of it left out
    for i in range(n - 1, 0, -1):
        p = index[id(page.nodes[i].parent)]
        kept[p] += max(kept[i], without[i])
        without[p] += without[i]
    out = np.zeros(n, bool)
    for i, node in enumerate(page.nodes):
        out[i] = (i == 0 or out[index[id(node.parent)]]) and kept[i] > without[i]
    return out


def text_of(page: Page, keep: np.ndarray) -> str:
    index = {id(n): i for i, n in enumerate(page.nodes)}
    return "\n\n".join(t for n, t in page.blocks if keep[index[id(n)]])


def learn(pages: DataFrame, html_col: str = "html", bound: int = SAMPLE_PAGES) -> Trees:
    """Trees from a sample of about ``bound`` pages and VARIED copies of each.

    Pages of over LONGEST_SAMPLED characters are left out of the sample, if there are
    others: the sample is held by the driver. Null and empty pages teach nothing.
    """
    rows = pages.where(F.length(html_col) > 0).select(F.col(html_col).alias("html"))
    short = rows.where(F.length("html") <= LONGEST_SAMPLED)
    sample = sorted(r["html"] for r in bounded_sample(short, F.col("html"), bound).collect())
    if not sample:
        sample = sorted(r["html"] for r in bounded_sample(rows, F.col("html"), LONG_PAGES).collect())
    x, y = [], []
    for source in sample:
        seed, nodes = zlib.crc32(source.encode()), Page(source).nodes
        labels = listed_labels(nodes)
        for some, own in ((nodes, labels), *(vary(nodes, labels, seed + j) for j in range(VARIED))):
            x.append(features(some))
            y.append(own)
    if not x:
        return fit(np.zeros((0, WIDTH)), np.zeros(0))
    return fit(np.concatenate(x), np.concatenate(y), rounds=80, depth=6)


def extract(pages: DataFrame, trees: Trees, keep: list[str], html_col: str = "html") -> DataFrame:
    """keep, text and n_chars for each page; a null or empty page has an empty text."""

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            sources = b.column(b.num_columns - 1).to_pylist()
            for k in range(0, len(sources), 200):
                parsed = [Page(s or "") for s in sources[k : k + 200]]
                rows = [features(p.nodes) for p in parsed]
                odds = np.split(trees.margin(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                out += [text_of(p, decode(p, o)) for p, o in zip(parsed, odds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    small_batches(pages.sparkSession)
    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    return rows.mapInArrow(gives_back(texts), rows.drop("_html").schema.add("text", "string").add("n_chars", "long"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages), ["page_id", "url"])
