"""HTML extraction by site style trees.

The DOMs of a host's pages are merged: nodes with the same path of styles (tag and classes from the root) are
one node of the host's tree. A page shows features there: its presentation (the sequence of child styles), the
texts that lie in the node itself, and the targets of its links and pictures. Of m pages that have the node, n
show a feature f, so f says 1 - log(n) / log(m) of the most that it could say about a page: 0 where all show it, 1
where one does. Weighed by how often it is shown this is the entropy of the feature to the base m; the importance
of a node is the mean over all features of its branch, weighed by length:

    sum of w(f) n(f) (1 - log n(f) / log m) / sum of w(f) n(f)

with the length of a text as its weight, ``TARGET`` for links and pictures, and ``SHAPE`` for presentations of nodes
that have any. A menu with one item that differs is thus still mostly alike. Branches are summed by pointer doubling: log2(depth) rounds over the merged
tree, whatever its depth. Pages with the same bytes count once. The topmost branches under ``LEAST_IMPORTANCE`` on
at least ``LEAST_PAGES`` pages are removed from each page, but for paragraphs and headings of the main container (a
sentence that many articles share is part of each), and branches that hold half of its text or more.

The main container goes by mass of text: the page's articles where they hold at least half of the text of <main>
(else of the body) that is no noise, else <main>, else the body. What never belongs to an article (menus, footers,
asides, scripts, comments) goes on every page by its tag or role. Hosts with few pages tell little, so class names
are a prior: those that stand for adverts, notices, comments, menus and the like remove a branch; weaker ones
("share", "widget", "form-group") do inside the main container only where links make up most of the text; and a
section of the main container that is called as an article's own sections may be ("related", "menu", "discussion")
stays where it has a heading, is told in paragraphs, and holds no articles, forms or authors of others. A class
or id counts with all its words: "ad-box" is noise, "has-sidebar" and "content-sidebar-wrap" are not. Neither names
nor a <form> remove the main container, what holds it, or the richest prose of a page without one.

Rows: null html counts as empty and gives an empty text; a null or hostless url has no style tree; repeated rows
are answered each; an empty table gives an empty result; other input columns are ignored. Markup may be broken:
open elements end where their parent does, unknown end tags and an unfinished last tag are skipped. Time and memory
are linear in the page's length, however deep its elements nest.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, stage, unstage

LEAST_IMPORTANCE = 0.5
LEAST_PAGES = 5
SHAPE, TARGET = 1, 10  # a presentation, and the target of a link or picture, weigh as much as so many characters
BROADCAST_PATHS = 100_000  # unimportant paths, of 16 bytes each, that may be broadcast; beyond, each page is joined with its own

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER_TAGS = frozenset("script style noscript template iframe svg canvas object embed button select textarea dialog menu head audio video map".split())
ASIDE_TAGS = frozenset("nav footer aside".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Class names of what is not the article, wherever it stands.
NOISE_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored "
    "cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup pagination pager outbrain taboola masthead copyright".split()
)
#: Class names that may as well stand for a part of the article.
WEAK_NAMES = frozenset("side promo promotion banner alert popup modal overlay login share sharing social disclaimer toolbar widget skip search form topbar trending hidden".split())
#: Of branches that hold articles which are not the page's own.
OTHERS_NAMES = frozenset("comment comments disqus respond reply replies discussion related recommended recommendations".split())
#: Of these, what an article's own sections may be called: in the main container they stay where they are told in prose.
SECTION_NAMES = frozenset("menu navigation copyright subscription advertising sponsor notification notifications discussion related recommended recommendations".split())
#: Names of what says that a branch holds articles of others.
AUTHOR_NAMES = frozenset("author avatar byline username commenter".split())
#: Words that may stand beside a noise name in one class or id.
PLAIN_NAMES = frozenset(
    "box wrap wrapper container area list bar block section inner outer panel link links item items button btn icon text title group row col column unit slot zone "
    "site main primary secondary global top bottom left right page pages post posts article articles entry user wp js header".split()
)
KEPT_IN_MAIN = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dd dt td th tr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
HEADINGS = PROSE - {"p"}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
            "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("table td th button object caption html body template ul ol dl select".split())
_SCOPES_BUT = {tag: SCOPES - ends for tag, ends in SIBLINGS.items()}

#: Why a node is noise. What is WEAK or NAMED can hold the article after all, what is ASIDE can hold <main>, what is GONE holds nothing.
CLEAN, WEAK, NAMED, ASIDE, GONE = range(5)

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_RAW_ENDS = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE) for x in RAW}


def hash_of(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=seed)


class Node:
    """``own`` is why the node itself is noise, ``worst`` the same of all that it lies in."""

    __slots__ = ("authors", "block", "children", "heads", "holds_main", "in_article", "in_link", "in_main", "links", "mass", "named_section", "noise", "others", "own", "parent", "path", "prose", "style", "tag", "target", "worst")

    def __init__(self, tag: str, style: str, parent: Node | None, own: int, target: str = ""):
        self.tag, self.style, self.parent, self.own, self.target = tag, style, parent, own, target
        self.path = hash_of(style, parent.path if parent else 0)
        self.block = self if tag not in INLINE or parent is None else parent.block
        self.children: list[str] = []
        self.worst = max(own, parent.worst) if parent else own
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.in_link = tag == "a" or parent is not None and parent.in_link
        self.mass = self.links = self.prose = self.heads = self.others = self.authors = 0
        self.noise = self.holds_main = self.in_main = self.named_section = False

    def is_told(self) -> bool:
        """A section of the article, whatever it is called: headed, most of it in paragraphs and outside of links, and of no other authors."""
        return self.named_section and bool(self.heads) and 2 * self.prose >= self.mass and 2 * self.links < self.mass and not self.others and self.authors < 2


class Page:
    """Nodes in page order, and the pieces of text as (node, text or None for the edge of a block)."""

    def __init__(self, source: str):
        self.root = Node("#", "#", None, CLEAN)
        self.nodes: list[Node] = [self.root]
        self.pieces: list[tuple[Node, str | None]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, at = [self.root], 0
        opened: dict[str, list[int]] = {}  # places in the stack by tag
        pieces = self.pieces

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                gone = stack.pop()
                opened[gone.tag].pop()
                if gone.tag not in INLINE:
                    pieces.append((stack[-1], None))

        def last(tags) -> int:
            return max((opened[x][-1] for x in tags if opened.get(x)), default=0)

        # Up to the last '>' every tag ends; what begins as one behind it never does, and goes with all that follows.
        whole = source.rfind(">") + 1
        while True:
            m = _TAG.search(source, at, whole) if at < whole else None
            unfinished = None if m else _OPEN.search(source, max(at, whole))
            end = m.start() if m else unfinished.start() if unfinished else len(source)
            if end > at:
                pieces.append((stack[-1], entities.unescape(source[at:end])))
            if not m:
                return
            at = m.end() if not m[0].startswith("<!--") or m[0].endswith("-->") else len(source)
            close, tag = m[1], m[2] or m[4]
            if close:
                if places := opened.get(close.lower()):
                    pop_to(places[-1])
            elif tag:
                tag, attrs = tag.lower(), m[3] if m[2] else m[5]
                # A start tag ends an open paragraph, or the sibling before; of row parts, the outermost one.
                ends = ("p",) if tag in CLOSES_P else SIBLINGS.get(tag, ())
                if ends and (k := last(ends)) and k > last(_SCOPES_BUT.get(tag, SCOPES)):
                    while k > 1 and stack[k - 1].tag in ends:
                        k -= 1
                    pop_to(k)
                if tag == "br":
                    pieces.append((stack[-1], " "))
                    continue
                node = self._node(tag, attrs, stack[-1])
                if tag not in INLINE:
                    pieces.append((node, None))
                if tag in RAW:
                    shut = _RAW_ENDS[tag].search(source, at)
                    at = shut.end() if shut else len(source)
                elif tag not in VOID and not (attrs.endswith("/") and tag in ("path", "circle", "rect", "use")):
                    opened.setdefault(tag, []).append(len(stack))
                    stack.append(node)

    def _node(self, tag: str, attrs: str, parent: Node) -> Node:
        classes = role = target = ""
        hidden = False
        if attrs and not attrs.isspace():
            for name, value in _ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    classes += " " + value
                elif name == "role":
                    role = value.lower()
                elif name in ("href", "src"):
                    target = value
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                    hidden = True
        own, header, section, authors = CLEAN, tag == "header", False, False
        if hidden or tag in NEVER_TAGS:
            own = GONE
        elif tag in ASIDE_TAGS or role in ASIDE_ROLES:
            own = ASIDE
        elif tag not in ("body", "html", "main"):
            own = NAMED if tag == "form" or role == "form" else CLEAN
            for token in classes.split():
                words = {x.lower() for x in _NAME.findall(token)}
                header = header or "header" in words
                authors = authors or bool(words & AUTHOR_NAMES)
                if all(x in NOISE_NAMES or x in WEAK_NAMES or x in OTHERS_NAMES or x in PLAIN_NAMES or x.isdigit() for x in words):
                    why = ASIDE if words & OTHERS_NAMES else NAMED if words & NOISE_NAMES else WEAK if words & WEAK_NAMES else CLEAN
                    # A class that is noise beyond doubt outweighs one that may be a section's.
                    section = why > WEAK and (section or own <= WEAK) and (words & (NOISE_NAMES | OTHERS_NAMES)) <= SECTION_NAMES or section and why <= WEAK
                    own = max(own, why)
        style = f"{tag}.{_DIGITS.sub('0', classes).strip()}" if classes else tag
        if role == "main":
            tag = "main"
        node = Node(tag, style, parent, own, target)
        node.named_section = section and tag in ("section", "div")
        node.authors = int(authors)
        if header and own < NAMED and not node.in_article:  # a header outside of the article is the site's
            node.own = NAMED
            node.worst = max(node.worst, NAMED)
        if tag not in INLINE:
            parent.block.children.append(style)
        self.nodes.append(node)
        return node

    # The main container.

    def _weigh(self) -> None:
        """mass, links and prose of each branch: its characters, those in links, and those of paragraphs and headings."""
        for node, text in self.pieces:
            if text and node.worst < GONE and not text.isspace():
                n = len(text)
                node.mass += n
                node.links += n if node.in_link else 0
                node.prose += n if node.block.tag in PROSE else 0
        for x in reversed(self.nodes[1:]):
            up = x.parent
            up.mass, up.links, up.prose = up.mass + x.mass, up.links + x.links, up.prose + x.prose
            up.heads += x.heads + (x.tag in HEADINGS)
            up.authors += x.authors
            up.others += x.others + (x.tag in ("article", "form") or x.own == ASIDE)

    def _clear(self, holders: list[Node]) -> None:
        """Lift the noise of ``holders`` and of what they lie in."""
        for x in holders:
            while x is not None and not x.holds_main:
                x.holds_main, x.own, x = True, CLEAN if x.own < GONE else GONE, x.parent

    def _spread(self) -> None:
        for x in self.nodes[1:]:
            x.worst = max(x.own, x.parent.worst)

    def _outermost(self, tag: str, below: int) -> list[Node]:
        """Nodes of ``tag``, outside of each other, that are clean; where there are none, those in noise less than ``below``."""
        inside: set[int] = set()
        out: dict[bool, list[Node]] = {True: [], False: []}
        for x in self.nodes[1:]:
            if id(x.parent) in inside:
                inside.add(id(x))
            elif x.tag == tag and x.worst < below:
                inside.add(id(x))
                out[x.worst == CLEAN].append(x)
        return out[True] or out[False]

    def _clean_mass(self, tops: list[Node]) -> int:
        """Characters below ``tops`` that are neither noise nor links."""
        wanted, total = {id(x) for x in tops}, 0
        for x in self.nodes:
            if x.parent is not None and id(x.parent) in wanted:
                wanted.add(id(x))
        for node, text in self.pieces:
            if text and id(node) in wanted and node.worst == CLEAN and not node.in_link and not text.isspace():
                total += len(text)
        return total

    def _choose_main(self) -> list[Node]:
        mains = self._outermost("main", GONE)
        self._clear(mains)
        self._spread()
        scope = mains or [x for x in self.nodes if x.tag == "body"][:1] or [self.root]
        articles = self._outermost("article", ASIDE)
        if mains:  # an article that noise holds, and <main> does not, is another's
            within = {id(x) for x in mains}
            for x in self.nodes[1:]:
                if id(x.parent) in within:
                    within.add(id(x))
            articles = [x for x in articles if x.worst == CLEAN or id(x) in within]
        if articles:
            dirty = [x for x in articles if x.worst]
            before = [x.own for x in self.nodes]
            self._clear(dirty)
            self._spread()
            if 2 * self._clean_mass(articles) >= self._clean_mass(scope):
                return articles
            for x, own in zip(self.nodes, before, strict=True):
                x.own = own
            self._spread()
        if not mains:
            self._clear_richest()
        return scope

    def _clear_richest(self) -> None:
        """Of a page without a container: forms and weak names around most of the prose, and other names where no other prose is."""
        total = self.root.prose
        clean = any(text and node.worst < NAMED and not text.isspace() for node, text in self.pieces)
        rich = [x for x in self.nodes if CLEAN < x.own < ASIDE and 2 * x.prose > total and (x.own == WEAK or x.tag == "form" or not clean)]
        for x in rich:
            x.own = CLEAN
        self._spread()

    def mark(self, low: frozenset[int]) -> None:
        """Set ``in_main`` and ``noise`` of all nodes; ``low`` are the site's unimportant paths."""
        self._weigh()
        tops = self._choose_main()
        whole = all(x.tag in ("body", "#") for x in tops)
        held: set[int] = set()
        for x in tops:
            x.in_main = True
            while x is not None and id(x) not in held:
                held.add(id(x))
                x = x.parent
        mass = sum(x.mass for x in tops)
        for x in self.nodes:
            up = x.parent
            if up is None:
                continue
            x.in_main = x.in_main or up.in_main
            x.noise = up.noise
            if x.noise or id(x) in held:
                x.noise = x.noise or x.own == GONE
                continue
            most = x.in_main and 2 * x.mass >= mass
            if x.in_main and not whole and x.is_told():
                continue
            if x.own >= ASIDE or x.own == NAMED and not (most and x.prose and not whole):
                x.noise = True
            elif x.own == WEAK and (whole or not x.in_main or 2 * x.links >= x.mass and not (most and x.prose)):
                x.noise = True
            elif x.path in low and x.tag not in INLINE and not most and not (x.in_main and x.tag in KEPT_IN_MAIN and not whole):
                x.noise = True

    def text(self, low: frozenset[int] = frozenset()) -> str:
        """The blocks of the main container, without noise and without branches in ``low``."""
        self.mark(low)
        blocks, held = [], []
        for node, text in [*self.pieces, (self.root, None)]:
            if text is not None:
                if node.in_main and not node.noise:
                    held.append(text)
            elif held:
                if joined := " ".join("".join(held).split()):
                    blocks.append(joined)
                held.clear()
        return "\n".join(blocks)

    # The site's style tree.

    def features(self) -> list[tuple[int, int | None, int, int]]:
        """(path, parent path, feature, weight): of each block's path its presentation, with the parent, and its contents, without."""
        looks: dict[int, list[str]] = {}
        parents: dict[int, int] = {}
        shown: dict[tuple[int, int], int] = {}
        for x in self.nodes:
            at = x.block.path
            if x.target:
                shown[at, hash_of(x.target, 2)] = TARGET
            if x.block is x and x.tag not in RAW:
                looks.setdefault(at, []).append(",".join(x.children))
                parents[at] = x.parent.block.path if x.parent else 0
        for node, text in self.pieces:
            if text and not text.isspace():
                plain = " ".join(text.split())
                shown[node.block.path, hash_of(plain, 1)] = len(plain)
        rows = [(p, parents[p], hash_of("|".join(x)), SHAPE if any(x) else 0) for p, x in looks.items()]
        return rows + [(p, None, f, w) for (p, f), w in shown.items() if p in looks]

    def paths(self) -> list[int]:
        return list({x.path for x in self.nodes if x.block is x})


HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _signed(x: int | None) -> int | None:
    return x if x is None or x < 1 << 63 else x - (1 << 64)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance, parent) of ``pages`` (host, html). Counts are summed before each shuffle, so a host may have any number of pages."""
    names = ("host", "page", "path", "parent", "feature", "weight")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 128):
                rows = []
                for host, page, source in zip(*(c.slice(start, 128).to_pylist() for c in b.columns), strict=True):
                    rows += [(host, page, _signed(p), _signed(up), _signed(f), w) for p, up, f, w in Page(source).features()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    seen = arrow_map(pages.select("host", F.xxhash64("html").alias("page"), "html"), run, ", ".join(f"{n} bigint" for n in names)).distinct()
    counts = seen.groupBy("host", "path", "feature", "weight", F.col("parent").isNotNull().alias("look")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"))
    shown = F.col("weight") * F.col("n")
    own = counts.groupBy("host", "path").agg(
        F.sum(F.when(F.col("look"), F.col("n"))).alias("pages"), F.min("parent").alias("parent"), F.sum(shown).cast("double").alias("all"), F.sum(shown * F.log("n")).alias("alike"),
    )
    says = F.when(F.col("pages") > 1, F.col("all") - F.col("alike") / F.log("pages")).otherwise(F.col("all"))
    tree = stage(own.select("host", "path", "pages", "parent", F.col("parent").alias("up"), "all", says.alias("says")), "style-tree")
    # Sums over branches: after k rounds a node holds those of the nodes less than 2^k below, and ``up`` is 2^k above it.
    while not tree.where("up <> 0").isEmpty():
        given = tree.where("up <> 0").groupBy("host", F.col("up").alias("path")).agg(F.sum("all").alias("more_all"), F.sum("says").alias("more_says"))
        above = tree.select("host", F.col("path").alias("up"), F.col("up").alias("next"))
        grown = tree.join(given, ["host", "path"], "left").join(above, ["host", "up"], "left").select(
            "host", "path", "pages", "parent", F.coalesce("next", F.lit(0).cast("bigint")).alias("up"),
            (F.col("all") + F.coalesce("more_all", F.lit(0.0))).alias("all"), (F.col("says") + F.coalesce("more_says", F.lit(0.0))).alias("says"),
        )
        grown = stage(grown, "style-tree")
        unstage(tree)
        tree = grown
    return tree.select("host", "path", "pages", F.when(F.col("all") > 0, F.col("says") / F.col("all")).otherwise(1.0).alias("importance"), "parent")


def unimportant(tree: DataFrame) -> DataFrame:
    """(host, path) of the topmost branches that pages lose."""
    low = tree.where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE)).select("host", "path", "parent")
    return low.join(low.select("host", F.col("path").alias("parent")), ["host", "parent"], "left_anti").select("host", "path")


def _own_paths(rows: DataFrame, low: DataFrame) -> DataFrame:
    """(host, page, low): of each page the unimportant paths that it has."""
    schema = pa.schema([("host", pa.int64()), ("page", pa.int64()), ("path", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 128):
                found = [(host, page, _signed(p)) for host, page, source in zip(*(c.slice(start, 128).to_pylist() for c in b.columns), strict=True) for p in Page(source).paths()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

    paths = arrow_map(rows.where("host IS NOT NULL").select("host", "page", "html"), run, "host bigint, page bigint, path bigint").distinct()
    return paths.join(low, ["host", "path"]).groupBy("host", "page").agg(F.collect_list("path").alias("low"))


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    url = F.coalesce("url", F.lit(""))
    host = F.regexp_extract(F.lower(url), HOST, 1)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.when(host != "", F.xxhash64(host)).alias("host"))
    low = stage(unimportant(style_tree(rows.where("host IS NOT NULL"))), "unimportant-paths")
    if low.count() <= BROADCAST_PATHS:
        rows = rows.join(F.broadcast(low.groupBy("host").agg(F.collect_list("path").alias("low"))), "host", "left")
    else:
        rows = rows.withColumn("page", F.xxhash64("html"))
        rows = rows.join(_own_paths(rows, low), ["host", "page"], "left")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 128):
                part = b.slice(start, 128)
                texts = []
                for low, source in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    texts.append(Page(source).text(frozenset(x & 0xFFFFFFFFFFFFFFFF for x in low or ())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=schema)

    return arrow_map(rows.select("page_id", "url", "low", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
