"""Main text of web pages, with templates found by counting element subtrees per host.

1. Each page is parsed; the hash of every element's subtree (tags and texts) is emitted once a page with the hash of
   the page's body (the text it has before templates go), together with one mark for the page itself. Outside of the
   core, the hash of every block's shape is emitted too: tags and class names without texts, for menus and adverts whose
   words change with the page. Spark counts the bodies of both per host, so a host with a third of all pages is a sum
   like any, and copies count as one page.
2. A subtree in at least MIN_PAGES bodies and MIN_SHARE of a host's bodies is a template of this host, a shape in
   MIN_PAGES bodies and SHAPE_SHARE of them. At most 1 / share times the subtrees of an average page reach a share, so
   a host's list doesn't grow with its pages.
3. Each page is parsed again and the templates of its host are deleted. Within the main part (article, main, role=main)
   copies of an article must not pass for a template: there, elements that are, hold or lie in a paragraph, heading,
   list, table or figure go only if they recur in EDGE_PAGES bodies and EDGE_SHARE of them (or are templates outside of
   it), lie at the very start or end of the main part, and make up EDGE_TEXT of its text at most.
4. The core of a page is its main part, or without one the innermost block that holds CORE_SHARE of its text. Neither
   the core nor what holds it is ever deleted by a name or a shape (but for a named box around one of several articles,
   of which the others have OTHERS times its text). Outside of it an element goes by its score: 2 for a
   name of a box (NAMES, as whole class names or compounds like "share-links"), or 1 for a mere word of its names, 1 for
   a shape that its host repeats, 1 for a text that is mostly links, 1 for one that is SHORT of the page's; 3 are needed.
   On hosts with fewer than MIN_PAGES bodies, where nothing can be counted, the name of a box is enough.
   Within the core only whole names count, and only on what holds no more than NAMED_TEXT of its text (reader comments:
   COMMENT_TEXT). Tags and roles delete menus, footers, forms, scripts and the like.

If what is left of the main part is less than half of what is left around it, the main part was a teaser and all that
is left is returned; else the main part is. Text is cut into blocks at block elements; white space inside a block
becomes one space, blocks are joined by \n.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm._tables import cut
from postlode.llm._text import pieces

MIN_PAGES, MIN_SHARE, BROADCAST_HASHES = 5, 0.2, 100_000
EDGE_PAGES, EDGE_SHARE, EDGE_TEXT = 10, 0.5, 0.3
SHAPE_SHARE, CORE_SHARE, SHORT, NAMED_TEXT, COMMENT_TEXT, ENOUGH, OTHERS = 0.5, 0.6, 0.1, 0.5, 0.9, 3, 0.25

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: What no usual template count deletes in the main part, with all around and within it.
KEPT = TEXT | frozenset("ul ol dl table figure".split())
NEVER = frozenset("script style noscript template nav footer aside form button select textarea iframe svg canvas head title object dialog menu".split())
#: Words of class names and ids that name something other than the article.
NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored banner promo cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup sidebar widget widgets related share sharing social breadcrumb breadcrumbs menu nav navbar navigation toolbar comment comments reply replies disqus respond pagination pager hidden".split())
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
#: With these behind such a word, a compound still names it.
BOXES = frozenset("area bar bars block blocks box boxes button buttons container form icons inner item items link links list lists outer panel post posts row section sections slot unit wrap wrapper".split())
OUTSIDE_NAMES = frozenset("header masthead footer".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar".split())
#: An element on the left is closed by the start of one of those on the right.
CLOSED_BY = {"p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}), "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"})}
#: The search for an element to close ends at one of these.
SCOPE = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "p": frozenset({"table", "button", "object"}), "option": frozenset({"select"})}
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")


def _box(name: str) -> bool:
    """Whether a class name as a whole names a box other than the article: a word of NAMES, or these and BOXES only."""
    first, *rest = [w for w in _SPLIT.split(name) if w] or [""]
    return first in NAMES and all(w in NAMES or w in BOXES for w in rest)


class Node:
    __slots__ = ("tag", "up", "never", "named", "hinted", "comment", "main", "root", "around", "kept", "holds", "hash", "size", "digest", "links", "left", "names", "inner", "shape", "core", "held", "dead")

    def __init__(self, tag: str, up: Node | None):
        self.tag, self.up, self.never, self.named, self.hinted, self.comment = tag, up, False, False, False, False
        self.main, self.root, self.around, self.kept, self.holds, self.core, self.dead = False, False, False, False, False, False, False
        #: Characters of text, of text in links, and of text outside of what tags and roles delete.
        self.size, self.links, self.left, self.digest, self.shape = 0, 0, 0, 0, 0
        self.names, self.inner = "", []
        self.held = 0  # characters of the core within
        self.hash = hashlib.blake2b(tag.encode(), digest_size=8)


class Page(HTMLParser):
    """Blocks of a page as lists of (node, text), and all nodes with the digests of their subtrees."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", None)
        self.stack, self.open = [self.root], {}
        self.nodes: list[Node] = []
        self.blocks: list[list[tuple[Node, str]]] = [[]]
        self.feed(html)
        self.close()
        while len(self.stack) > 1:
            self._pop()
        self._find_core()

    def _find_core(self) -> None:
        """Marks the core with what it holds (core), and what holds it (around)."""
        self.total, self.core_text = self.root.left, 0
        for n in self.nodes:  # what holds a node comes before it
            n.dead = n.never or n.up.dead
        if not any(n.root and n.left and not n.dead for n in self.nodes):
            least = CORE_SHARE * max(self.total, 1)
            most = [n for n in self.nodes if n.left >= least and n.tag in BLOCK and n.tag not in KEPT and not n.dead]
            if most:
                most[-1].core = True  # such nodes hold each other, the innermost comes last
                up = most[-1].up
                while up is not None:
                    up.around, up = True, up.up
        for n in self.nodes:
            inside = n.up.core
            n.core = inside or n.core or n.main
            if n.core and not inside and not n.dead:
                self.core_text += n.left
                up = n.up
                while up is not None:
                    up.held, up = up.held + n.left, up.up

    def _pop(self) -> None:
        node = self.stack.pop()
        self.open[node.tag] -= 1
        raw = node.hash.digest()
        node.digest = int.from_bytes(raw, "little", signed=True)
        node.hash = None
        up = self.stack[-1]
        if up.hash is not None:
            up.hash.update(raw)
        up.size += node.size
        up.links += node.size if node.tag == "a" else node.links
        up.left += 0 if node.never else node.left
        # Shapes are told of what lies outside of the main part only.
        if node.size and not node.main:
            if node.tag in BLOCK:
                inner = " ".join(map(str, node.inner))
                node.shape = xxhash.xxh64_intdigest(f"{node.tag} {node.names} {inner}".encode("utf-8", "replace")) - (1 << 63)
                if up.inner[-1:] != [node.shape]:
                    up.inner.append(node.shape)
            else:
                up.inner += node.inner
        if node.main and not node.never and node.size and (node.tag in KEPT or node.holds):
            up.holds = True
        if node.tag in BLOCK:
            self._cut()

    def _cut(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _close(self, tag: str, scope: frozenset = frozenset()) -> None:
        if not self.open.get(tag):
            return
        for node in reversed(self.stack):
            if node.tag == tag:
                break
            if node.tag in scope:
                return
        while self.stack[-1] is not node:
            self._pop()
        self._pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for open_tag, by in CLOSED_BY.items():
            if tag in by and self.open.get(open_tag):
                self._close(open_tag, SCOPE[open_tag])
        if tag in BLOCK:
            self._cut()
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        node = Node(tag, self.stack[-1])
        values = {k: (v or "").lower() for k, v in attrs}
        inside, role = node.up.main, values.get("role", "")
        node.root = tag in ("article", "main") or role == "main"
        node.main = inside or node.root
        if node.root:
            up = node.up
            while up is not None and not up.around:
                # A form or dialog around the whole page is none of what it is usually.
                up.around, up.never, up = True, up.never and up.tag not in ("form", "dialog", "button"), up.up
        if not node.root and tag not in ("html", "body"):
            node.never = tag in NEVER or role in ROLES or tag == "header" and not inside
            if attrs:
                self._name(node, values, inside)
            if node.never and tag == "button" and self._in_sentence(tag):
                node.never = False
        node.kept = node.main and (tag in KEPT or node.up.kept)
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.nodes.append(node)

    def _in_sentence(self, tag: str) -> bool:
        return tag not in BLOCK and any(self.open.get(t) for t in TEXT)

    def _name(self, node: Node, values: dict[str, str], inside: bool) -> None:
        """What an element's names and attributes say of it."""
        # What only screen readers skip is a part of the sentence around it.
        silent = values.get("aria-hidden") == "true" and not self._in_sentence(node.tag)
        node.never = node.never or "hidden" in values or silent or "display:none" in values.get("style", "").replace(" ", "")
        whole = [n for n in (*values.get("class", "").split(), values.get("id", "")) if n]
        if whole:
            node.named = any(map(_box, whole))
            node.comment = node.named and any(_SPLIT.split(n)[0] in COMMENTS for n in whole)
            node.hinted = not inside and not (NAMES | OUTSIDE_NAMES).isdisjoint(_SPLIT.split(" ".join(whole)))
            node.names = " ".join(sorted({_DIGITS.sub("#", n) for n in whole}))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_data(" ")
        elif tag not in VOID:
            self._close(tag, frozenset({"table"}) if tag in ("p", "li", "span", "b", "i", "a") else frozenset())

    def handle_data(self, data: str) -> None:
        node = self.stack[-1]
        self.blocks[-1].append((node, data))
        if not data.isspace():
            if node.hash is not None:
                node.hash.update(b"\x00" + data.strip().encode("utf-8", "replace"))
            node.size += len(data)
            node.left += len(data)

    def subtrees(self) -> set[int]:
        """Digests of the subtrees that may be templates."""
        return {n.digest for n in self.nodes if n.size and may_be_template(n)}

    def edges(self) -> set[int]:
        """Digests of those that may be templates at an edge of the main part only."""
        return {n.digest for n in self.nodes if n.size and n.main and not n.root and not may_be_template(n)}

    def shapes(self) -> set[int]:
        """Shapes of the blocks outside of the core, which may recur on the host."""
        return {n.shape for n in self.nodes if n.shape and n.size and not n.core and not n.around and n.tag not in TEXT and n.tag not in ("html", "body")}

    def ruled_out(self, n: Node, shapes: frozenset[int], counted: bool) -> bool:
        if n.never:
            return True
        if n.around or n.root:
            # A sidebar with a teaser that is an article itself: the page's other articles are no less.
            return n.named and not n.core and not n.root and self.core_text - n.held >= OTHERS * n.held > 0
        if n.core:
            return n.named and n.up.core and n.left <= (COMMENT_TEXT if n.comment else NAMED_TEXT) * self.core_text
        short = n.left <= SHORT * self.total
        score = ((2 if counted else ENOUGH) if n.named else 1 if n.hinted else 0) + (n.shape in shapes) + (2 * n.links >= n.size > 0) + short
        return score >= ENOUGH and n.tag not in ("html", "body")

    def text(self, templates: frozenset[int], edges: frozenset[int] = frozenset(), shapes: frozenset[int] = frozenset(), counted: bool = False) -> str:
        """counted: whether the page's host has bodies enough to count shapes."""
        state: dict[int, bool] = {}

        def dropped(node: Node) -> bool:
            chain = []
            while node.up is not None and id(node) not in state:
                chain.append(node)
                node = node.up
            gone = state.get(id(node), False)
            for n in reversed(chain):
                gone = gone or self.ruled_out(n, shapes, counted) or n.digest in templates and may_be_template(n)
                state[id(n)] = gone
            return gone

        lines: list[tuple[bool, Node, str]] = []
        for block in self.blocks:
            left = [(n, t) for n, t in block if not dropped(n)]
            for main in (True, False):
                line = " ".join("".join(t for n, t in left if n.main == main).split())
                if line:
                    lines.append((main, next(n for n, t in left if n.main == main and t.strip()), line))
        main = [(n, x) for m, n, x in lines if m]
        inner, outer = sum(len(x) for _, x in main), sum(len(x) for m, _, x in lines if not m)
        if 2 * inner < outer:
            return "\n".join(x for _, _, x in lines)
        return "\n".join(_without_edges(main, edges | templates))


def _without_edges(lines: list[tuple[Node, str]], edges: frozenset[int]) -> list[str]:
    """The lines of the main part without those at its start and end that its host repeats, if these are few."""

    def repeated(node: Node) -> bool:
        while node is not None and not node.root:
            if node.digest in edges:
                return True
            node = node.up
        return False

    first, last = 0, len(lines)
    if edges:
        while first < last and repeated(lines[first][0]):
            first += 1
        while last > first and repeated(lines[last - 1][0]):
            last -= 1
    texts = [x for _, x in lines]
    gone = sum(map(len, texts[:first])) + sum(map(len, texts[last:]))
    return texts[first:last] if gone <= EDGE_TEXT * sum(map(len, texts)) else texts


def may_be_template(node: Node) -> bool:
    """Not the main part itself, and in it nothing that is, holds or lies in a paragraph, list, table or figure."""
    return node.tag not in ("html", "body") and not node.root and not (node.main and (node.kept or node.holds))


#: What a hash is of.
EXACT, EDGE, SHAPE = 0, 1, 2
LISTS = {EXACT: "templates", EDGE: "edges", SHAPE: "shapes"}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        hosts, bodies, found, kinds = [], [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html)
            own = page.subtrees() - {0}
            each = {EXACT: {0} | own, EDGE: page.edges() - own - {0}, SHAPE: page.shapes() - {0}}
            body = hashlib.blake2b(page.text(frozenset()).encode("utf-8", "replace"), digest_size=8).digest()
            for kind, hashes in each.items():
                found += hashes
                kinds += [kind] * len(hashes)
            n = sum(map(len, each.values()))
            hosts += [host] * n
            bodies += [int.from_bytes(body, "little", signed=True)] * n
        yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "body": pa.array(bodies, pa.int64()), "subtree": pa.array(found, pa.int64()), "kind": pa.array(kinds, pa.int32())})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        lists = (batch.column(name).to_pylist() for name in LISTS.values())
        rows = zip(batch.column("html").to_pylist(), batch.column("counted").to_pylist(), *lists, strict=True)
        texts = [Page(html).text(*(frozenset(x or ()) for x in found), counted=counted) for html, counted, *found in rows]
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, edge_pages: int = EDGE_PAGES, edge_share: float = EDGE_SHARE, shape_share: float = SHAPE_SHARE) -> DataFrame:
    """host, templates, edges, shapes (hashes, null for none) of hosts with min_pages bodies. pages: host, html."""
    counts = cut(pages.select("host", "html").mapInArrow(_count, "host string, body long, subtree long, kind int").groupBy("host", "subtree", "kind").agg(F.count_distinct("body").alias("count")), "subtrees")
    # A written table, so that a host with a large part of all subtrees can be split where it is joined.
    sums = cut(counts.where(f"subtree = 0 and kind = {EXACT}").select("host", F.col("count").alias("pages")), "hosts")
    least, share = F.lit(min_pages), F.lit(min_share)
    for kind, n, part in ((EDGE, edge_pages, edge_share), (SHAPE, min_pages, shape_share)):
        least, share = F.when(F.col("kind") == kind, n).otherwise(least), F.when(F.col("kind") == kind, part).otherwise(share)
    enough = (F.col("count") >= least) & (F.col("count") >= share * F.col("pages"))
    often = counts.where((F.col("subtree") != 0) & (F.col("count") >= min(min_pages, edge_pages))).join(sums, "host").where(enough)
    lists = often.groupBy("host").agg(*(F.collect_list(F.when(F.col("kind") == kind, F.col("subtree"))).alias(name) for kind, name in LISTS.items()))
    return sums.where(F.col("pages") >= min_pages).join(lists, "host", "left").select("host", *LISTS.values())


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars: one row a row of pages.

    A null html is empty; a null or odd url has the empty host. Rows of one body count as one page, so copies and
    repeated rows make no template, and each row has its own result. A page of any length is read whole. Other columns
    take no part. The hosts' lists are broadcast if they hold BROADCAST_HASHES hashes at most in all, else joined.
    """
    pages = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = cut(templates(pages, min_pages, min_share), "templates")
    size = found.agg(F.coalesce(F.sum(sum((F.coalesce(F.size(x), F.lit(0)) for x in LISTS.values()), F.lit(4))), F.lit(0))).first()[0]
    side = F.broadcast(found) if size <= BROADCAST_HASHES else found
    joined = pages.join(side.withColumn("counted", F.lit(True)), "host", "left").select("page_id", "url", "html", F.coalesce("counted", F.lit(False)).alias("counted"), *LISTS.values())
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
