"""Main text of web pages by wrapper induction.

Pages are parsed into DOM trees and folded (siblings of one kind become one
node). A host's wrapper is one tree, merged from all its pages: the nodes that
stand on a part of them, in their mean order. Each page is aligned with that
tree by simple tree matching, so a node whose kind differs from page to page
(a class with a number in it) finds its place; what matches nothing hangs below
the place of its parent. The place of a node is its slot.

Over all pages of a host, a text that most different pages have in one slot is
template; slots that vary are content, unless most of their text is links. What
mark-up itself says (menus, forms, adverts and so on) is left out as well.

Merging, counting and extraction each read every page once. Nodes, slots and
texts are counted with pre-aggregation, so nothing depends on the order of rows.
A host gets one wrapper, of bounded size. Wrappers are written and counted: up to
BROADCAST_CHARS they are broadcast, so pages stay where they are; beyond that
pages are dealt by host, those of large hosts by salt as well.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_batches

SUPPORT = 0.1  # part of a host's pages that have a node of its wrapper; so a wrapper has ten pages' nodes at most
CONSTANT = 0.8  # part of a host's different pages that makes a text template
PAGES_LEAST = 4  # different pages that must have a text before it is called constant
LINKED = 0.6  # part of a slot's characters inside links that makes it a menu
BROADCAST_CHARS = 8_000_000  # characters of all wrappers that may be broadcast
HOST_PAGES = 20_000  # pages of a host for one salt
MATCH_CELLS = 1 << 16  # pairs of unlike nodes of a page that are weighed one by one; further ones are matched in order, by tag

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe textarea title xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Opening the key closes an open element of the value, up to a container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("tr", "thead", "tbody"), "tfoot": ("tr", "tbody")}
CONTAINERS = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "main", "body"}
INSIDE_P = BLOCK - {"option", "optgroup", "legend", "summary", "html", "body", "head"}

# Elements, roles, and words of class or id that mark what isn't main text.
DROP_TAGS = set("nav footer aside button select menu dialog head search fieldset input label svg math object template".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROP_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner sidebar nav navbar navigation breadcrumb breadcrumbs"
    " cookie cookies consent gdpr newsletter subscribe subscription popup modal comment comments disqus login signup widget masthead toolbar"
    " pagination pager footer notice notices".split()
)
#: Words that also name what a text is about: they drop boxes, but no paragraph or heading.
BOX_WORDS = set("menu overlay promotion respond reply replies related recommended share sharing social search skip".split())
#: Words that drop an element whatever else its class says, unless the class says that it has none or some (`no-comments`, `has-ads`).
PART_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle googleads adslot adunit adbox adbanner sponsored"
    " comment comments commentlist commentform commentbox commentarea usercomments disqus cookie cookies cookiebar cookiebanner cookienotice cookieconsent"
    " notice notices consent gdpr".split()
)
ABOUT_PAGE = set("no not has have with without open opened closed enabled disabled hide hidden free off on is".split())
#: What a class may be joined with and still mean the same.
PLAIN_WORDS = set(
    "site page main top bottom left right box container wrapper wrap list area section block bar inner outer global primary secondary unit slot"
    " links buttons icons posts articles stories thread form text message".split()
)
TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption li dd dt td th em strong b i u a code mark q cite".split())
HEADS = {"header", "masthead"}
#: Words that an article may not lie in or bear itself; the other words may name a page's layout around it.
FOREIGN = set("comment comments commentlist commentbox commentarea usercomments disqus respond reply replies related recommended".split())

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: The rest of a tag. Nothing is given back, so a tag that doesn't end is found out in one go.
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
RAW_END = {t: re.compile(rf"</{t}\s*+>", re.IGNORECASE) for t in RAW}


def hashed(text: str, seed: int = 0) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed & (1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def marks(token: str) -> set[str]:
    """The marking words of a class or id, if it says nothing else: `left-sidebar` does, `no-sidebar` doesn't. Words for adverts,
    comments and notices mark beside others as well: `user-comments` does, `has-comments` doesn't."""
    words = set(re.findall(r"(?<![a-z0-9])[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()))
    found = words & (DROP_WORDS | BOX_WORDS | HEADS | PART_WORDS)
    if words <= found | PLAIN_WORDS:
        return found
    return set() if words & ABOUT_PAGE else found & PART_WORDS


def kind(token: str) -> str:
    """A class as a kind of element: parts with a digit in them are one."""
    return re.sub(r"(?<![^\W_])[^\W_]*\d[^\W_]*", "#", re.sub(r"[\x00-\x1f]", "", token)) if len(token) <= 200 else "#"


class Node:
    """An open element. id: hash of the path of kinds from the root; block: the nearest block it is or lies in; form: in a form."""

    __slots__ = ("tag", "sig", "id", "parent", "block", "drop", "foreign", "main", "link", "form")

    def __init__(self, tag: str, sig: str, id_: int, parent: Node | None = None):
        self.tag, self.sig, self.id, self.parent, self.block = tag, sig, id_, parent, self
        self.drop = self.foreign = self.main = self.link = self.form = False


def _open(parent: Node, tag: str, attributes: str) -> Node:
    """drop: what the element and those around it say is not main text; foreign: and no article inside can change that."""
    words: set[str] = set()
    sig, role, hidden = tag, "", False
    if "=" in attributes or "hidden" in attributes:
        found = {a.lower(): b or c or d or "" for a, b, c, d in ATTRIBUTE.findall(attributes)}
        tokens = (found.get("class", "") + " " + found.get("id", "")).split()
        if tokens:
            sig += "." + ".".join(sorted(set(map(kind, tokens))))
            words = set().union(*map(marks, tokens))
        role = found.get("role", "").lower()
        hidden = found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or re.search(r"\shidden(?=[\s/=]|$)", attributes)
    node = Node(tag, sig, hashed(sig, parent.id), parent)
    if tag not in BLOCK:
        node.block = parent.block
    node.foreign = parent.foreign or role in DROP_ROLES or bool(hidden)
    node.main = parent.main or tag in ("article", "main") or role in ("main", "article")
    node.link = parent.link or tag == "a"
    node.form = (parent.form or tag == "form") and tag not in ("article", "main")
    if tag in ("html", "body"):
        node.drop = node.foreign
    elif tag in ("article", "main"):
        node.drop = node.foreign = node.foreign or bool(words & FOREIGN)
    else:
        if tag in TEXT_TAGS:
            words -= BOX_WORDS
        node.foreign = node.foreign or tag in DROP_TAGS or bool(words & FOREIGN)
        node.drop = parent.drop or node.foreign or bool(words - HEADS) or (not node.main and (tag == "header" or bool(words & HEADS)))
    return node


class Page:
    """What a page holds beside what its mark-up drops. A form is dropped like the rest, but for an article inside it and unless
    it holds more of the page's text than all else does: then the page lies in it.

    blocks: (id of the node, text, characters in links, in a main element) in page order. nodes: id -> (parent's id, kind)
    of these nodes and those around them, in page order; siblings of one kind have one id.
    """

    def __init__(self, page: str | None):
        self.blocks: list[tuple[int, str, int, bool]] = []
        self.nodes: dict[int, tuple[int, str]] = {}
        self.stack = [Node("", "", 0)]
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked, self.owner = 0, self.stack[0]
        self.in_form: list[bool] = []
        self.read(page or "")
        self.flush()
        if any(self.in_form):
            inside = sum(len(t) for f, (_, t, *_) in zip(self.in_form, self.blocks) if f)
            if 2 * inside <= sum(len(t) for _, t, *_ in self.blocks):
                self.without_forms()

    def without_forms(self) -> None:
        self.blocks = [b for f, b in zip(self.in_form, self.blocks) if not f]
        held: set[int] = set()
        for id_, *_ in self.blocks:
            while id_ in self.nodes and id_ not in held:
                held.add(id_)
                id_ = self.nodes[id_][0]
        self.nodes = {k: v for k, v in self.nodes.items() if k in held}

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                own, n = [], self.owner
                self.blocks.append((n.id, text, min(self.linked, len(text)), n.main))
                self.in_form.append(n.form)
                while n.parent is not None and n.id not in self.nodes:
                    own.append(n)
                    n = n.parent
                for n in reversed(own):
                    self.nodes[n.id] = (n.parent.id, n.sig)
            self.parts.clear()
        self.linked = 0

    def add(self, text: str) -> None:
        top = self.stack[-1]
        if top.drop:  # what is dropped inside a line doesn't part it
            return
        if not self.parts:
            if not text.strip():
                return
            self.owner = top.block
        self.parts.append(text)
        if top.link:
            self.linked += len(text)

    def cut(self, i: int) -> None:
        """Close the element at i of the stack and all in it. Blocks end a text; dropped parts of a line don't."""
        if any(n.tag in BLOCK and not n.parent.drop for n in self.stack[i:]):
            self.flush()
        for n in self.stack[i:]:
            self.open[n.tag] -= 1
        del self.stack[i:]

    def close(self, tags: tuple[str, ...]) -> None:
        if any(self.open[t] for t in tags):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in tags:
                    self.cut(i)
                    return
                if self.stack[i].tag in CONTAINERS:
                    return

    def end(self, tag: str) -> None:
        if self.open[tag]:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:
                    self.cut(i)
                    return
                if tag not in BLOCK and tag not in DROP_TAGS and self.stack[i].tag in BLOCK:  # the end of a mark of text doesn't close blocks
                    return

    def read(self, page: str) -> None:
        i, broken = 0, False
        while (j := page.find("<", i)) >= 0:
            if j > i:
                self.add(page[i:j])
            m = TAG.match(page, j)
            if m is None:
                if page.startswith("<!--", j):
                    close, size = page.find("-->", j + 2), 3
                elif page.startswith("<![CDATA[", j):
                    close, size = page.find("]]>", j), 3
                elif page.startswith(("<!", "<?", "</"), j):
                    close, size = page.find(">", j), 1
                else:
                    self.add("<")
                    i = j + 1
                    continue
                if close < 0:
                    return
                i = close + size
                continue
            # once a quote or tag runs on to the end, quotes aren't trusted any more
            rest = None if broken else REST.match(page, m.end())
            broken = rest is None
            i = rest.end() if rest else page.find(">", m.end()) + 1
            if not i:
                return
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
            elif tag == "br":
                self.add(" ")
            else:
                i = self.start(tag, page[m.end() : i - 1], page, i)
                if i < 0:
                    return
        self.add(page[i:])

    def start(self, tag: str, attributes: str, page: str, i: int) -> int:
        if tag in INSIDE_P:
            self.close(("p",))
        if tag in CLOSES:
            self.close(CLOSES[tag])
        top = self.stack[-1]
        if tag in BLOCK and not top.drop:
            self.flush()
        if tag in RAW:
            end = RAW_END[tag].search(page, i)
            return end.end() if end else -1
        if tag not in VOID and not attributes.endswith("/"):
            self.stack.append(_open(top, tag, attributes))
            self.open[tag] += 1
        return i


def pairs_in_order(a: list, b: list, weight) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest set of pairs of two lists that keeps their order: its weight, and the pairs. A weight of 0 doesn't pair."""
    best = [[0] * (len(b) + 1)]
    weights = [[weight(x, y) for y in b] for x in a]
    for row in weights:
        above, here = best[-1], [0]
        for j, w in enumerate(row):
            here.append(max(above[j + 1], here[j], above[j] + w))
        best.append(here)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[-1][-1], pairs[::-1]


def by_tag(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal tags, the first with the first and so on."""
    places: dict[str, list[int]] = {}
    for i, t in enumerate(a):
        places.setdefault(t, []).append(i)
    used: Counter[str] = Counter()
    out = []
    for j, t in enumerate(b):
        if used[t] < len(places.get(t, ())):
            out.append((places[t][used[t]], j))
            used[t] += 1
    return out


def tag_of(sig: str) -> str:
    return sig.split(".", 1)[0]


class Tree:
    """Children of every node, (kind, id) in order; of each subtree how many nodes it has and a hash of its tags.

    cells: pairs of children that may still be weighed one by one; beyond that, children are paired by tag alone.
    """

    def __init__(self, nodes: dict[int, tuple[int, str]], cells: int = MATCH_CELLS):
        self.below: dict[int, list[tuple[str, int]]] = {}
        self.size: dict[int, int] = {}
        self.shape: dict[int, int] = {}
        self.cells = cells
        for id_, (parent, sig) in nodes.items():
            self.below.setdefault(parent, []).append((sig, id_))

    def measure(self) -> None:
        """Sizes and shapes of subtrees, once they are asked for."""
        order = [0]
        for id_ in order:  # grows: parents come before their children
            order += [c for _, c in self.below.get(id_, ())]
        for id_ in reversed(order):
            own = self.below.get(id_, ())
            self.size[id_] = sum(1 + self.size[c] for _, c in own)
            self.shape[id_] = hash(tuple((tag_of(s), self.shape[c]) for s, c in own))


def tree_match(a: Tree, b: Tree, x: int, y: int, memo: dict[tuple[int, int], int]) -> int:
    """Simple tree matching of what lies below x of a and y of b: how many nodes, alike by tag, can be paired in order.

    Subtrees of equal tags match whole, at once. No recursion, so depth doesn't matter; pairs are weighed once (memo), and b's
    cells bound the work for a page.
    """
    for t in (a, b):
        if not t.shape:
            t.measure()
    stack = [(x, y)]
    while stack:
        x, y = stack[-1]
        if a.shape.get(x) == b.shape.get(y) and a.size.get(x) == b.size.get(y):
            memo[x, y] = a.size.get(x, 0)
            stack.pop()
            continue
        left, right = a.below.get(x, []), b.below.get(y, [])
        n = len(left) * len(right)
        alike = [(u, v) for s, u in left for t, v in right if tag_of(s) == tag_of(t)] if n <= b.cells else None
        if alike is None:
            memo[x, y] = len(by_tag([tag_of(s) for s, _ in left], [tag_of(s) for s, _ in right]))
            stack.pop()
            continue
        waiting = [p for p in alike if p not in memo]
        if waiting:
            b.cells -= n
            stack += waiting
            continue
        stack.pop()
        allowed = set(alike)
        memo[x, y] = pairs_in_order([u for _, u in left], [v for _, v in right], lambda u, v: 1 + memo[u, v] if (u, v) in allowed else 0)[0] if allowed else 0
    return memo[x, y]


ANY = ".*"  # in place of classes: a wrapper's node for the kinds that few pages share


class Wrapper:
    """A host's tree, the slots that are menus, and the texts (hashed with their slots) that are template."""

    def __init__(self, tree: str | None = None, menus: str | None = None, constants: str | None = None):
        numbers = lambda t: {int(x) for x in t.split(",")} if t else set()
        self.menus, self.constants = numbers(menus), numbers(constants)
        self.nodes: dict[int, tuple[int, str]] = {}
        for row in tree.split("\n") if tree else ():
            id_, parent, sig = row.split("\t")
            self.nodes[int(id_)] = (int(parent), sig)
        self.tree = Tree(self.nodes)

    def align(self, page: Page) -> dict[int, int]:
        """The slot of every node of a page: the wrapper's node that it is matched with, else a place below its parent's slot."""
        tree, slots, memo = Tree(page.nodes), {0: 0}, {}
        queue = [0]
        while queue:
            at = queue.pop()
            slot, below = slots[at], tree.below.get(at, [])
            known = {sig: id_ for sig, id_ in self.tree.below.get(slot, [])}
            odd = []
            for sig, id_ in below:
                if sig in known:
                    slots[id_] = known[sig]
                else:
                    odd.append((sig, id_))
            if odd and known:
                mine = {sig for sig, _ in below}
                free = [(sig, id_) for sig, id_ in self.tree.below[slot] if sig not in mine and not sig.endswith(ANY)]
                for (_, w), (_, p) in self.matched(free, odd, tree, memo):
                    slots[p] = w
            for sig, id_ in odd:
                if id_ not in slots:
                    slots[id_] = known.get(tag_of(sig) + ANY) or hashed(sig, slot)
            queue += [id_ for _, id_ in below]
        return slots

    def matched(self, free: list, odd: list, tree: Tree, memo: dict) -> list[tuple]:
        if len(free) * len(odd) > tree.cells:
            pairs = by_tag([tag_of(s) for s, _ in free], [tag_of(s) for s, _ in odd])
        else:
            tree.cells -= len(free) * len(odd)

            def weight(w, p):
                if tag_of(w[0]) != tag_of(p[0]):
                    return 0
                inside = tree_match(self.tree, tree, w[1], p[1], memo)
                # the larger part of what lies below the smaller of the two must match
                small = min(len(self.tree.below.get(w[1], ())), len(tree.below.get(p[1], ())))
                return 1 + inside if 2 * inside >= small else 0

            pairs = pairs_in_order(free, odd, weight)[1]
        return [(free[i], odd[j]) for i, j in pairs]


def identity(page: Page) -> int:
    """Pages that agree in their three longest texts are copies of each other."""
    return hashed("\n".join(sorted(sorted({t for _, t, *_ in page.blocks}, key=lambda t: (-len(t), t))[:3])))


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of pages; the root has the id 0."""
    for b in batches:
        rows: list[tuple] = []
        for host, page in zip(b["host"], b["html"]):
            rows.append((host, 0, 0, "", 0))
            places: Counter[int] = Counter()
            for id_, (parent, sig) in Page(page).nodes.items():
                rows.append((host, id_, parent, sig, places[parent]))
                places[parent] += 1
        yield pd.DataFrame(rows, columns=["host", "id", "parent", "sig", "place"])


def trees(pages: DataFrame) -> DataFrame:
    """host, n_pages, tree of every host with two pages or more. pages has host and html."""
    nodes = materialize(
        pages.mapInPandas(_nodes, "host string, id long, parent long, sig string, place long")
        .groupBy("host", "id").agg(F.min("parent").alias("parent"), F.min("sig").alias("sig"), F.count("*").alias("n"), F.sum("place").alias("place")),
        "html-nodes",
    )
    hosts = nodes.where("id = 0").select(F.col("host").alias("s_host"), F.col("n").alias("n_pages"))
    enough = F.greatest(F.lit(2.0), SUPPORT * F.col("n_pages"))
    counted = nodes.where("id <> 0").join(hosts, F.col("host") == F.col("s_host")).where("n_pages > 1")
    shared = counted.where(F.col("n") >= enough)
    inner = shared.select(F.col("host").alias("i_host"), F.col("id").alias("i_id"))
    inner = inner.unionByName(hosts.select(F.col("s_host").alias("i_host"), F.lit(0).cast("long").alias("i_id")))
    any_kind = (
        counted.where(F.col("n") < enough)
        .groupBy("host", "n_pages", "parent", F.concat(F.substring_index("sig", ".", 1), F.lit(ANY)).alias("sig"))
        .agg(F.sum("n").alias("n"), F.sum("place").alias("place")).where(F.col("n") >= enough)
        .join(inner, (F.col("host") == F.col("i_host")) & (F.col("parent") == F.col("i_id")), "left_semi")
        .withColumn("id", F.xxhash64("parent", "sig"))
    )
    columns = ["host", "n_pages", "id", "parent", "sig", (F.col("place") / F.col("n")).alias("place")]
    row = lambda x: F.concat_ws("\t", x["id"].cast("string"), x["parent"].cast("string"), x["sig"])
    return (
        shared.select(*columns).unionByName(any_kind.select(*columns))
        .groupBy(F.col("host").alias("w_host"), "n_pages").agg(F.array_sort(F.collect_list(F.struct("place", "sig", "id", "parent"))).alias("t"))
        .select("w_host", "n_pages", F.array_join(F.transform("t", row), "\n").alias("tree"))
    )


class Wrappers:
    """Wrappers by their rows; a worker reads each once. shipped: rows of all hosts, where they are few enough to be broadcast."""

    def __init__(self, shipped=None):
        self.known: dict[tuple, Wrapper] = {}
        self.shipped = shipped.value if shipped is not None else None

    def each(self, b: pd.DataFrame, *columns: str) -> Iterator[Wrapper]:
        """The wrapper of each row of a batch, from its host or from the columns it came with."""
        if self.shipped is not None:
            return (self.of(*self.shipped.get(host, ())) for host in b["host"])
        return (self.of(*row) for row in zip(*(b[c] for c in columns)))

    def of(self, *row) -> Wrapper:
        row = tuple(None if pd.isna(x) else x for x in row)
        if row not in self.known:
            if len(self.known) >= 256:
                self.known.clear()
            self.known[row] = Wrapper(*row)
        return self.known[row]


def _slots(shipped):
    """Slots and texts of pages; key is the text's hash with its slot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Wrappers(shipped)
        for b in batches:
            rows = []
            for host, page, wrapper in zip(b["host"], b["html"], known.each(b, "tree")):
                page = Page(page)
                slots, own = wrapper.align(page), identity(page)
                rows += [(host, own, slots[n], hashed(t, slots[n]), slots[n] in wrapper.nodes, len(t), linked) for n, t, linked, _ in page.blocks]
            yield pd.DataFrame(rows, columns=["host", "page", "slot", "key", "inside", "chars", "linked"])

    return run


def wrappers(pages: DataFrame, most: int = BROADCAST_CHARS) -> DataFrame:
    """w_host, n_pages, tree, menus, constants of every host with two pages or more. pages has page_id, url, host and html."""
    grown = materialize(trees(pages.select("host", "html")), "html-trees")
    joined, shipped = with_wrappers(pages, grown, ["tree"], most)
    seen = materialize(
        joined.select("host", "html", *([] if shipped else ["tree"]))
        .mapInPandas(_slots(shipped), "host string, page long, slot long, key long, inside boolean, chars long, linked long")
        .groupBy("host", "page", "slot", "key", "inside").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked")),
        "html-slots",
    )
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.col(c).cast("string"))), ",")
    size = seen.groupBy(F.col("host").alias("s_host")).agg(F.count_distinct("page").alias("n_different")).where(F.col("n_different") >= PAGES_LEAST)
    constants = (
        seen.groupBy("host", "slot", "key").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES_LEAST)
        .join(size, F.col("host") == F.col("s_host"))
        .where(F.col("n") >= CONSTANT * F.col("n_different"))
        .groupBy(F.col("host").alias("c_host")).agg(listed("key").alias("constants"))
    )
    menus = (
        seen.where("inside").groupBy("host", "slot").agg(F.sum("chars").alias("c"), F.sum("linked").alias("l"))
        .where(F.col("l") >= LINKED * F.col("c"))
        .groupBy(F.col("host").alias("m_host")).agg(listed("slot").alias("menus"))
    )
    return (
        grown.join(constants, F.col("w_host") == F.col("c_host"), "left").join(menus, F.col("w_host") == F.col("m_host"), "left")
        .select("w_host", "n_pages", "tree", "menus", "constants")
    )


def main_text(html_: str | None, wrapper: Wrapper | None = None) -> str:
    """The page's content blocks, joined by an empty line.

    Menus of links count only outside main elements. Where a page has main elements, they are its content, unless twice as
    much varying text stands beside them. A page all of whose text is template keeps it.
    """
    page, wrapper = Page(html_), wrapper or Wrapper()
    slots = wrapper.align(page) if wrapper.menus or wrapper.constants else {}
    found = []  # text, in a main element, template
    for n, text, linked, main in page.blocks:
        slot = slots.get(n)
        if main or not (slot in wrapper.menus or linked >= LINKED * len(text)):
            found.append((text, main, bool(wrapper.constants) and hashed(text, slot) in wrapper.constants))
    if not all(constant for *_, constant in found):
        found = [f for f in found if not f[2]]
    inside = sum(len(t) for t, main, _ in found if main)
    beside = sum(len(t) for t, main, _ in found if not main)
    if any(main for _, main, _ in found) and beside <= 2 * inside:
        found = [f for f in found if f[1]]
    return "\n\n".join(t for t, *_ in found)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def with_wrappers(pages: DataFrame, found: DataFrame, columns: list[str], most: int = BROADCAST_CHARS, host_pages: int = HOST_PAGES):
    """(pages, shipped): columns of all wrappers by host as a broadcast, where they have `most` characters at most; else (pages
    joined with the wrappers of their hosts, null where a host has none; None)."""
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.length("w_host") + 8)
    if (found.agg(F.sum(size)).first()[0] or 0) <= most:
        rows = {r.w_host: tuple(r[c] for c in columns) for r in found.select("w_host", *columns).collect()}
        return pages, pages.sparkSession.sparkContext.broadcast(rows)
    salts = F.ceil(F.col("n_pages") / host_pages).cast("int")
    large = found.where(F.col("n_pages") > host_pages).select(F.col("w_host").alias("l_host"), salts.alias("salts"))  # at most a host for host_pages pages
    dealt = pages.join(F.broadcast(large), F.col("host") == F.col("l_host"), "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("salts", F.lit(1))).cast("int"))
    salted = found.withColumn("w_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(salted, (F.col("host") == F.col("w_host")) & (F.col("salt") == F.col("w_salt")), "left"), None


def extract(pages: DataFrame, most: int = BROADCAST_CHARS) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Defined cases: a null or empty page, and one without content, has the empty
    text; unclosed and stray tags are repaired as browsers do, a tag without an
    end takes the rest of the page with it; elements may nest to any depth; pages
    without a host share a wrapper; a host of one page has none; a text is called
    constant where PAGES_LEAST different pages at least have it; pages that
    agree in their three longest texts count as one; repeated rows each get their
    row; an empty table gives no rows; columns beyond page_id, url and html are
    not read. The order of rows and files doesn't matter.
    """

    text_batches(pages.sparkSession)
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    columns = ["tree", "menus", "constants"]
    found = materialize(wrappers(own, most), "html-wrappers")
    joined, shipped = with_wrappers(own, found, columns, most)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Wrappers(shipped)
        for b in batches:
            text = [main_text(page, wrapper) for page, wrapper in zip(b["html"], known.each(b, *columns))]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": pd.Series(text, dtype=object)})

    kinds = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    read = joined.select("page_id", "url", "html", *(["host"] if shipped else columns)).mapInPandas(texts, kinds)
    return read.withColumn("n_chars", F.length("text").cast("long"))
