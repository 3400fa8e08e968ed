"""HTML extraction by wrapper induction.

Pages of a host share a template. Each page's DOM tree is aligned with a reference page of its host by simple tree matching; a text that most of a host's pages have at
the same aligned node is template, a node whose text varies is a content slot. A page's blocks that the reference has no node for grow it: their node is the nearest aligned
ancestor and the elements below it. Texts are counted over all of a host's pages and over those of one layout, told by the elements around the article. Menus, adverts, forms, notices and the like are known by their elements
and names; what is left of the page's article is its main text.

Every page of a host takes part in telling constants from slots. Only counts of (node, text) pairs meet, pre-aggregated, and pages of a hot host are aligned wherever
they lie.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce
from html import unescape
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .urls import host_of

#: A text is template if at least this share of the different pages of a host or of one of its layouts, and this many, have it at the same node. Where a host or layout
#: has fewer pages, but two at least, a text that all of them have is template, unless such texts are more than half of the page's article: those are copies.
CONSTANT_SHARE, CONSTANT_PAGES = 0.5, 5
#: Children's lists shorter than this are aligned in plain Python, longer ones row by row with numpy: the same match.
SHORT = 24

# A quote opens a quoted value only right after the equals sign, as in HTML; anywhere else it is a character of a name or value.
_VALUE = r"(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+"
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+" + _VALUE + r")*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?+)?+", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of HTML: elements without content, with raw text, that end others, that break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp".split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul").split())
ENDS_PARAGRAPH = BLOCK - {"html", "body", "td", "th", "tr", "li", "dd", "dt", "option", "optgroup", "legend", "summary", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")),
            "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select", "optgroup")),
            "tbody": ("thead tbody tfoot tr td th", ("table",)), "thead": ("thead tbody tfoot", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",))}

# What is no article: elements, roles, and words in names of classes and ids.
DROPPED = frozenset("nav footer aside form button select input textarea label script style noscript iframe template svg math title head dialog menu object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status note".split())
NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored sponsors promo promos promotion promoted banner banners cookie cookies consent gdpr "
    "notice notices notification alert alerts popup modal overlay interstitial paywall nav navbar navigation navi menu menus breadcrumb breadcrumbs sidebar sidebars rail widget widgets "
    "footer foot masthead topbar comment comments commentlist disqus respond reply replies discussion feedback responses share sharing social follow related recommended recommendations "
    "recommendation newsletter subscribe subscription signup login signin search pagination pager toolbar skip copyright legal disclaimer teaser teasers trending popular outbrain taboola").split())
#: Words that say nothing on their own beside one of those names: a class or id is such a name only if all of its words are among both.
NEUTRAL = frozenset((
    "box slot list area block section container wrapper wrap inner outer top bottom left right center bar link links button buttons item items unit panel group holder zone space "
    "module post posts page pages site user users reader readers form article articles story stories news global primary secondary sticky inline mobile desktop small large row col "
    "column columns header heading title head icon icons js id main content entry a the on for to us your my by and more").split())
#: Names that a part of the article may have as well; in an article they count only if the element is no plain prose.
AMBIGUOUS = frozenset("discussion responses feedback legal promotion search follow respond".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure br hr b strong i em u s sub sup code q cite span a img small mark abbr time".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion responses".split())
MAIN_NAMES = frozenset("article content post entry story main body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "names", "tokens", "attributes", "children", "parent", "number", "shape", "dropped", "kind")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        named = attributes.get("class", "") + " " + attributes.get("id", "") if attributes else ""
        #: Words of each class and of the id, without numbers; and all of them.
        self.tokens = [t for token in named.split() if (t := frozenset(w.lower() for w in _WORD.findall(token) if not w.isdigit()))]
        self.names = frozenset().union(*self.tokens)
        self.shape = (tag, attributes.get("class", ""))
        self.number = self.kind = -1
        self.dropped = False

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    @property
    def placed(self) -> list[Node]:
        """Elements that are nodes of their page; a line break is none."""
        return [c for c in self.elements if c.number >= 0]


def parse(source: str) -> Node:
    """A tree of elements and decoded texts; unclosed and misnested elements are closed as browsers mostly do."""
    root = Node("#root", {}, None)
    top, at = root, 0
    match = _TAG.search(source)
    while match:
        if match.start() > at:
            top.children.append(unescape(source[at:match.start()]))
        at = match.end()
        if not match[2]:
            if match[0].startswith("<![CDATA["):
                top.children.append(match[0][9:].removesuffix("]]>"))
            match = _TAG.search(source, at)
            continue
        tag = match[2].lower()
        if match[1]:
            node = top
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root and not (tag not in BLOCK and _crosses(top, node)):
                top = node.parent
        else:
            top = _closed(top, tag)
            attributes = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(match[3])} if match[3] else {}
            node = Node(tag, attributes, top)
            top.children.append(node)
            if tag in RAW and not match[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif tag not in VOID and not (match[3].rstrip().endswith("/") and tag not in BLOCK):
                top = node
        match = _TAG.search(source, at)
    if at < len(source):
        top.children.append(unescape(source[at:]))
    return root


def _crosses(top: Node, node: Node) -> bool:
    """Whether closing ``node``, an inline element, would close a block."""
    while top is not node:
        if top.tag in BLOCK:
            return True
        top = top.parent
    return False


def _closed(top: Node, tag: str) -> Node:
    """Close what a new element ends: an open paragraph, or the last item of a list or table."""
    if tag in ENDS_PARAGRAPH:
        node = top
        while node.tag not in ("#root", "p", "td", "th", "li", "article", "section", "div", "main", "aside", "nav", "header", "footer", "blockquote", "form"):
            node = node.parent
        if node.tag == "p":
            return node.parent
        while top.tag in HEADINGS and tag in HEADINGS:
            top = top.parent
    if tag in SIBLINGS:
        ended, scope = SIBLINGS[tag]
        node, last = top, None
        while node.tag != "#root" and node.tag not in scope:
            last = node if node.tag in ended.split() else last
            node = node.parent
        if last is not None:
            return last.parent
    return top


def is_dropped(node: Node) -> bool:
    """Whether an element by its kind, role, name or state is no part of an article."""
    a = node.attributes
    if node.tag in DROPPED or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if node.tag in ("html", "body", "main"):
        return False
    if node.tag == "article":
        return bool(node.names & COMMENTS)
    if node.tag == "header" or "header" in node.names:
        return not _inside(node, "article")
    said = [t & NAMES for t in node.tokens if t & NAMES and t <= NAMES | NEUTRAL]
    if not said or node.tag in ("section", "div") and frozenset(["article"]) in node.tokens and len(said) == 1:
        return False
    if all(t <= AMBIGUOUS for t in said) and _inside(node, "article"):
        return not is_prose(node)
    return True


def is_prose(node: Node) -> bool:
    """Whether an element's children are paragraphs, headings and the like, with a paragraph among them."""
    return all(c.tag in PROSE for c in node.elements) and any(c.tag == "p" for c in node.elements)


def _inside(node: Node, tag: str) -> bool:
    while node := node.parent:
        if node.tag == tag:
            return True
    return False


class Page:
    """A page's elements in order, and its text blocks: (owner's number, text, share of it in links)."""

    def __init__(self, source: str) -> None:
        self.root = parse(source)
        self.nodes: list[Node] = []
        self.blocks: list[tuple[int, str, float]] = []
        self._walk()

    def _walk(self) -> None:
        parts: list[str] = []
        linked: list[int] = [0]
        seen = [False]  # something but white space in the parts
        owner: list[Node] = [self.root]

        def flush() -> None:
            text = " ".join("".join(parts).split()) if seen[0] else ""
            if text:
                self.blocks.append((owner[0].number, text, min(1.0, linked[0] / len(text))))
            parts.clear()
            linked[0], seen[0] = 0, False

        def enter(node: Node, dropped: bool, link: bool, block: Node) -> None:
            node.number = len(self.nodes)
            self.nodes.append(node)
            node.dropped = dropped or is_dropped(node)
            if node.tag in BLOCK:
                flush()
                block = node
            open_.append((node, iter(() if node.tag in RAW else node.children), link or node.tag == "a", block))

        # Open elements in a list, so that pages may nest as deep as they like.
        open_: list[tuple[Node, Iterator[Node | str], bool, Node]] = []
        enter(self.root, False, False, self.root)
        while open_:
            node, children, link, block = open_[-1]
            for child in children:
                if isinstance(child, str):
                    if not seen[0]:
                        owner[0] = block if not node.dropped or block.dropped else node
                    if node.dropped and not block.dropped:  # an inline advert
                        continue
                    parts.append(child)
                    seen[0] = seen[0] or not child.isspace()
                    linked[0] += len(child) * link
                elif child.tag == "br":
                    parts.append(" ")
                else:
                    enter(child, node.dropped, link, block)
                    break
            else:
                if node.tag in BLOCK and node.tag not in RAW:
                    flush()
                open_.pop()
        flush()

    def main(self) -> list[Node]:
        """The elements that hold the article: the article, main part or well named box with the most text, or the whole page; an article may go on in those beside it."""
        sizes = [0] * len(self.nodes)
        for number, text, share in self.blocks:
            node = self.nodes[number]
            if not node.dropped:
                sizes[number] += len(text) * (share < 0.5)
        for node in reversed(self.nodes[1:]):
            sizes[node.parent.number] += sizes[node.number]
        for fits in (lambda n: n.tag == "article" or n.attributes.get("itemprop") == "articleBody", lambda n: n.tag == "main" or n.attributes.get("role") == "main",
                     lambda n: n.tag in ("div", "section", "td") and n.names & MAIN_NAMES):
            found = [n for n in self.nodes if not n.dropped and fits(n) and sizes[n.number]]
            if found:
                best = max(found, key=lambda n: (sizes[n.number], n.number))
                return [n for n in found if n is best or n.tag == best.tag == "article" and n.parent is best.parent]
        return [self.root]

    def kept(self) -> list[tuple[int, str]]:
        """(owner's number, text) of the article's blocks, in page order."""
        main = self.main()
        bare = main[0] is self.root
        tops = {node.number for node in main}
        inside, head, heading = ([False] * len(self.nodes) for _ in range(3))
        for k, node in enumerate(self.nodes):  # parents come before their children
            up = node.parent.number if node.parent else 0
            inside[k] = k in tops or inside[up]
            head[k] = k not in tops and (head[up] or node.tag == "header" or "header" in node.names) and inside[up]
            heading[k] = heading[up] or node.tag in HEADINGS
        return [(number, text) for number, text, share in self.blocks
                if not self.nodes[number].dropped and not (bare and share > 0.5) and inside[number] and not (head[number] and not heading[number])]


    def layout(self) -> int:
        """The elements around the article: those from the root to it, and their children's kinds."""
        node, around = self.main()[0], []
        while node.parent is not None:
            node = node.parent
            around.append([node.shape, sorted({c.shape for c in node.elements})])
        return _hash(repr(around))


class Matcher:
    """Simple tree matching: the largest order-keeping match of equal roots and children, level by level.

    What two subtrees weigh depends on their kinds only, so equal subtrees are weighed once however often they stand on a page, and a list of
    children is aligned by dynamic programming over kinds. Only pairs that belong to the match are traced, in linear memory.
    """

    def __init__(self) -> None:
        self.kinds: dict[tuple, int] = {}
        self.parts: list[tuple] = []  # of each kind: its shape's number and its children's kinds
        self.shapes: dict[tuple, int] = {}
        self.weights: dict[tuple[int, int], int] = {}

    def name(self, page: Page) -> None:
        """Give every element its kind: elements with equal shapes and equal children have the same."""
        for node in reversed(page.nodes):  # children come after their parents
            key = (self.shapes.setdefault(node.shape, len(self.shapes)), tuple(c.kind for c in node.placed))
            if key not in self.kinds:
                self.kinds[key] = len(self.parts)
                self.parts.append(key)
            node.kind = self.kinds[key]

    def weigh(self, x: int, y: int) -> int:
        """Pairs in the match of two kinds, the roots' own included; 0 if their shapes differ. Pairs are weighed before their parents, from a list of what is to do."""
        if self.parts[x][0] != self.parts[y][0]:
            return 0
        todo: list[tuple[int, int, bool]] = [(x, y, False)]
        while todo:
            a, b, ready = todo.pop()
            if (a, b) in self.weights:
                continue
            if a == b:
                self.weights[a, b] = self.size(a)
                continue
            xs, ys = self.parts[a][1], self.parts[b][1]
            if not ready:
                by_shape: dict[int, list[int]] = {}
                for v in set(ys):
                    by_shape.setdefault(self.parts[v][0], []).append(v)
                needed = [(u, v, False) for u in set(xs) for v in by_shape.get(self.parts[u][0], ()) if (u, v) not in self.weights]
                if needed:
                    todo += [(a, b, True), *needed]
                    continue
            self.weights[a, b] = 1 + self.best(xs, ys)
        return self.weights[x, y]

    def size(self, kind: int) -> int:
        """Elements of a kind: what it weighs with itself."""
        todo = [kind]
        while todo:
            k = todo[-1]
            missing = [c for c in self.parts[k][1] if (c, c) not in self.weights]
            if missing:
                todo += missing
            else:
                self.weights[k, k] = 1 + sum(self.weights[c, c] for c in self.parts[k][1])
                todo.pop()
        return self.weights[kind, kind]

    def row(self, x: int, ys: tuple[int, ...]) -> list[int]:
        """Weights of one child against all; those of other shapes weigh nothing."""
        shape, known = self.parts[x][0], self.weights
        return [known[x, y] if self.parts[y][0] == shape else 0 for y in ys]

    def best(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> int:
        if not xs or not ys:
            return 0
        return int(self.last_row(xs, ys)[-1])

    def last_row(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[int] | np.ndarray:
        """Weights of the best matches of all of ``xs`` with each beginning of ``ys``."""
        if len(ys) < SHORT:
            above = [0] * (len(ys) + 1)
            for x in xs:
                left, out = 0, [0]
                for j, w in enumerate(self.row(x, ys)):
                    left = max(above[j + 1], left, above[j] + w)
                    out.append(left)
                above = out
            return above
        rows: dict[int, np.ndarray] = {}
        line = np.zeros(len(ys) + 1, np.int64)
        for x in xs:
            if x not in rows:
                rows[x] = np.array(self.row(x, ys), np.int64)
            # The best of above, above and left with this pair, and, by the running maximum, left.
            line[1:] = np.maximum.accumulate(np.maximum(line[1:], line[:-1] + rows[x]))
        return line

    def pairs(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of the children that a best match pairs, in order. Long lists are halved where the best matches of both halves meet."""
        out: list[tuple[int, int]] = []
        todo = [(0, len(xs), 0, len(ys))]
        while todo:
            a, b, c, d = todo.pop()
            if a == b or c == d:
                continue
            if b - a == 1 or (b - a) * (d - c) <= SHORT * SHORT:
                out += [(a + i, c + j) for i, j in self.traced(xs[a:b], ys[c:d])]
                continue
            half = (a + b) // 2
            fore, back = np.asarray(self.last_row(xs[a:half], ys[c:d])), np.asarray(self.last_row(xs[half:b][::-1], ys[c:d][::-1]))[::-1]
            cut = c + int(np.argmax(fore + back))
            todo += [(a, half, c, cut), (half, b, cut, d)]
        return sorted(out)

    def traced(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        table = [[0] * (len(ys) + 1)]
        for x in xs:
            above, line = table[-1], [0]
            for j, w in enumerate(self.row(x, ys)):
                line.append(max(above[j + 1], line[j], above[j] + w))
            table.append(line)
        i, j, out = len(xs), len(ys), []
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out


def match_trees(a: Page, b: Page, matcher: Matcher | None = None) -> dict[int, int]:
    """Numbers of ``b``'s elements to those of ``a``'s that a simple tree matching pairs; ``a`` is known to ``matcher`` if one is given."""
    if matcher is None:
        matcher = Matcher()
        matcher.name(a)
    matcher.name(b)
    out: dict[int, int] = {}
    todo = [(a.root, b.root)] if matcher.weigh(a.root.kind, b.root.kind) else []
    while todo:
        x, y = todo.pop()
        out[y.number] = x.number
        xs, ys = x.placed, y.placed
        if x.kind == y.kind:
            todo += zip(xs, ys)
        elif xs and ys:
            todo += [(xs[i], ys[j]) for i, j in matcher.pairs(matcher.parts[x.kind][1], matcher.parts[y.kind][1])]
    return out


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def slot_of(node: Node, matched: dict[int, int]) -> str:
    """The reference's node, or what grows from the nearest one."""
    below = []
    while node.number not in matched and node.parent is not None:
        below.append(node.shape)
        node = node.parent
    return repr((matched.get(node.number, -1), below))


_BLOCKS = pa.list_(pa.struct([("slot", pa.int64()), ("hash", pa.int64()), ("text", pa.string())]))
_BLOCKS_DDL = "blocks array<struct<slot:bigint,hash:bigint,text:string>>"


def aligned(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, host, html, reference) to (page_id, url, host, layout, content, blocks): the article's blocks, with the node's and the text's hash.

    ``content`` is the hash of all blocks: pages with the same texts count as one.
    """
    names = ["page_id", "url", "host", "layout", "content", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[str, tuple[Page, Matcher]] = OrderedDict()
        for batch in batches:
            layouts, contents, blocks = [], [], []
            for source, reference in zip(batch.column("html").to_pylist(), batch.column("reference").to_pylist(), strict=True):
                page, own = Page(source or ""), []
                kept = page.kept()
                matched: dict[int, int] = {}
                if kept and reference:
                    if reference not in known or max(map(len, (known[reference][1].weights, known[reference][1].parts))) > 1 << 18:
                        first = Page(reference)
                        known[reference] = first, Matcher()
                        known[reference][1].name(first)
                        if len(known) > 8:
                            known.popitem(last=False)
                    matched = match_trees(known[reference][0], page, known[reference][1])
                seen: dict[str, int] = {}
                for number, text in kept:
                    slot = slot_of(page.nodes[number], matched)
                    k = seen[slot] = seen.get(slot, -1) + 1
                    # Blocks of an aligned node are told apart by their order, grown ones by their text alone.
                    own.append({"slot": _hash(f"{slot} {k}" if number in matched else slot), "hash": _hash(text), "text": text})
                layouts.append(page.layout())
                contents.append(_hash(repr([t for _, t in kept])))
                blocks.append(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array(layouts, pa.int64()), pa.array(contents, pa.int64()), pa.array(blocks, _BLOCKS)],
                                             names=names)

    return pages.select("page_id", "url", "host", "html", "reference").mapInArrow(
        run, f"page_id bigint, url string, host string, layout bigint, content bigint, {_BLOCKS_DDL}")


def extracted(pages: DataFrame, share: float = CONSTANT_SHARE, least: int = CONSTANT_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null, empty or text-free pages give an empty text. Pages without a host form one host of their own that has no template. Repeated rows are extracted alike
    and count once in the template, as do pages of one address. Markup cut off at the end closes there. Extra columns are not read; an empty table gives no rows.
    """
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"),
                          F.col("html").cast("string").alias("html"))
    # One page per host, picked by a hash, so the choice doesn't depend on the order of rows.
    chosen = source.where((F.col("host") != "") & (F.trim("html") != "")).groupBy("host").agg(F.min_by("html", F.xxhash64("html")).alias("reference"))
    pages_by_host = source.join(stored(chosen, "references"), "host", "left")
    found = stored(aligned(pages_by_host), "aligned")
    of_host = found.where((F.size("blocks") > 0) & (F.col("host") != "")).withColumn("address", F.xxhash64("url"))
    by_page = of_host.select("host", "layout", "content", "address", F.explode("blocks").alias("b")).select("host", "layout", "content", "address", "b.slot", "b.hash")

    def counted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Different pages: by what they say, and by their address."""
        once = rows.groupBy(*keys, "content").agg(F.min("address").alias("address"))
        return once.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.count_distinct("address")).alias(name))

    def template(keys: list[str], name: str) -> DataFrame:
        # A text passes on half of the pages at least, so a list has at most twice as many as a page has blocks on average.
        both = counted(by_page, [*keys, "slot", "hash"], "n").where("n > 1").join(counted(of_host, keys, "total"), keys)
        few = (F.col("total") < least) & (F.col("total") > 1) & (F.col("n") == F.col("total"))
        some = both.withColumn("few", few).where(few | ((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))))
        pair = F.struct("slot", "hash")
        return stored(some.groupBy(*keys).agg(F.collect_set(F.when(~F.col("few"), pair)).alias(name), F.collect_set(F.when(F.col("few"), pair)).alias(f"{name}_few")), name)

    joined = found.join(template(["host"], "on_host"), "host", "left").join(template(["host", "layout"], "on_layout"), ["host", "layout"], "left")

    def without(blocks: Column, *names: str) -> Column:
        has = lambda b: reduce(or_, [F.coalesce(F.array_contains(n, F.struct(b["slot"], b["hash"])), F.lit(False)) for n in names])
        return F.filter(blocks, lambda b: ~has(b))

    text = lambda name: F.array_join(F.transform(name, lambda b: b["text"]), " ")
    rest = joined.withColumn("rest", without(F.col("blocks"), "on_host", "on_layout")).withColumn("less", without(F.col("rest"), "on_host_few", "on_layout_few"))
    rest = rest.select("page_id", "url", text("rest").alias("rest"), text("less").alias("less"))
    return rest.select("page_id", "url", F.when(2 * F.length("less") >= F.length("rest"), F.col("less")).otherwise(F.col("rest")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint"))
