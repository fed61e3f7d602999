"""HTML extraction by consensus host paths.

A page becomes blocks of text in page order, each under its chain of containers. Containers are named
by their generalised path: tags and classes from the body down, digits removed. Every page scores its
containers (text of paragraphs that is not link text, in full for the nearest container and by half for
the one around it) and votes for its best path. Spark counts the votes per host, and every page is
extracted again from the containers on its host's winning path; a page without that path falls back to
its own best. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are told by tag and class and left out anywhere, as are inner containers that are
nearly all links.

The winning container may be the largest part of an article only, so what is taken is widened to the
outermost article or main around it, or to a container with a content name that does not frame the page
(one with a menu or sidebar inside does). Other articles beside the one around the winner stay out, and
so do articles inside it that are named like comments.

Ids of headings, blocks and sections are often slugs of their titles, and classes may hold such a word in a
name of another kind (side-effects). Inside an article or main, and of sections and text blocks anywhere,
an id or class tells a part to leave out only if it has no other words than the names of such parts. A
class with other words only raises a doubt: the part counts for no score, and stays if it is inside the winner.

Defined results: null and empty html, and pages without text outside such parts, give an empty text.
Plain text without tags is one block. White space is what Unicode calls so; a ``br`` is white space.
Unclosed and stray tags are tolerated; a tag without an end is text. Time and memory are in proportion to a
page, however long or deep it is. Repeated pages vote each. Hosts follow the first ``://`` up to
``/``, ``?`` or ``#``, lower case, null counted as empty. An empty table gives no rows. Columns of the
input other than those kept and html are not looked at.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_PLAIN = re.compile(r"[^'\"<>]*")
_CLASS = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is no text of the page; of those in _TO_THE_END an unclosed one takes the rest of it.
_RAW = frozenset("script style noscript template svg math iframe object textarea select title".split())
_TO_THE_END = frozenset("script style iframe textarea title".split())
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}

_CONTAINERS = frozenset("body main article section div nav aside header footer form ul ol table tbody tr td dl figure fieldset dialog".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre address hr figcaption caption th thead tfoot center option legend details summary".split())
_CLOSES_ITSELF = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "td": "td", "th": "th", "tr": "tr", "option": "option"}
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Outside article and main, ids of these are doubtful; of headings they never count.
_TITLED = frozenset("section p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figure".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td".split())

_SKIPPED_TAGS = frozenset("nav aside footer form dialog fieldset head menu button".split())
#: Words of a class, id or role that tell parts which are not the article.
_SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social comment comments commentlist disqus reply replies respond related recommended recommendations "
    "widget pagination pager tags form search skip hidden complementary contentinfo dialog".split()
)
#: Words of a class, id or role of a container that holds a whole article, unless it frames the page: with layout parts inside.
_CONTENT_WORDS = frozenset("article main content post entry story".split())
_LAYOUT_TAGS = frozenset("nav aside footer menu".split())
_LAYOUT_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer masthead topbar".split())
#: Words beside them in an id or class that is still a name of such a part, as in comment-list.
_PART_WORDS = frozenset(
    "section area box block list container wrapper wrap bar button buttons link links post posts article articles item items thread page site main content top bottom left right "
    "inner outer primary secondary global inline text title icon icons panel module row column js".split()
)
_PAGE_HEADERS = frozenset(("header", "head", "sitehead", "pagehead"))


#: Paths and labels are kept readable up to here; beyond, a digest stands for what is above.
_READABLE_DEPTH, _READABLE_LABEL = 24, 120


def _short(text: str) -> str:
    return "#" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


class _Node:
    """A container. What depends on those around it is taken over from the parent, so no chain is walked."""

    __slots__ = ("parent", "path", "depth", "skipped", "text", "links", "tag", "score", "anchors", "marked", "content", "frame", "doubt", "inside", "in_article", "owner", "whole", "inked", "around", "state")

    def __init__(self, parent: _Node | None, tag: str, attributes: str):
        self.parent, self.tag = parent, tag
        skipped = parent is not None and parent.skipped
        # inside: below an article or main. in_article: below an article, or one itself.
        inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.inside, self.in_article = inside, tag == "article" or parent is not None and parent.in_article
        names = _SKIPPED_WORDS | _PAGE_HEADERS
        words: set[str] = set()
        slugs: set[str] = set()
        doubtful, classes = False, []
        for name, a, b, c in _CLASS.findall(attributes):
            value = entities.unescape(a or b or c).lower()
            for token in value.split():
                own = {w for w in re.split(r"[^a-z]+", token) if len(w) > 1}
                sure = own <= names | _PART_WORDS
                if name.lower() == "id" and (tag in _HEADINGS or not sure):
                    slugs |= own
                elif sure or not (inside or tag in _TITLED):
                    words |= own
                else:
                    # A name with other words in it, as side-effects: no more than a doubt.
                    doubtful |= bool(own & names)
            if name.lower() == "class":
                classes += [re.sub(r"\d+", "", x) for x in value.split()]
        slug = not inside and bool(slugs & names) and tag not in ("body", "article", "main")
        if slug and tag not in _TITLED:
            words |= slugs
        #: The outermost part around the text that only a slug or a part of a class speaks against: kept inside the winner only.
        self.doubt: _Node | None = (parent.doubt if parent is not None else None) or (self if slug and tag in _TITLED or doubtful and tag not in ("body", "article", "main") else None)
        # An article with such a name is not skipped, but no part of another one either.
        self.marked = bool(words & _SKIPPED_WORDS)
        self.skipped = skipped or tag in _SKIPPED_TAGS or self.marked and tag not in ("body", "article", "main") or (tag == "header" or bool(words & _PAGE_HEADERS)) and not (inside or tag in ("article", "main"))
        self.content = tag in ("article", "main") or tag in ("div", "section") and bool((words | slugs) & _CONTENT_WORDS)
        self.frame = False
        if self.skipped and not skipped and (tag in _LAYOUT_TAGS or bool(words & _LAYOUT_WORDS) or tag == "header" or bool(words & _PAGE_HEADERS)):
            node = parent
            while node is not None and not node.frame:
                node.frame, node = True, node.parent
        label = tag + "".join("." + x for x in sorted(filter(None, set(classes))))
        label = label if len(label) <= _READABLE_LABEL else tag + _short(label)
        self.depth = parent.depth + 1 if parent is not None else 0
        above = "" if parent is None else parent.path if self.depth < _READABLE_DEPTH else _short(parent.path)
        self.path = f"{above}/{label}" if parent is not None else label
        #: The nearest container that may hold an article: lists, cells and single blocks count for what is around them.
        self.owner: _Node = self if parent is None or tag in ("body", "main", "article", "section", "div") else parent.owner
        self.text = self.links = self.anchors = 0
        self.score, self.whole, self.inked, self.around, self.state = 0.0, None, False, False, None

    @property
    def linky(self) -> bool:
        return self.anchors > 2 and self.links > 0.8 * self.text


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """Text and tags in page order, as (text, "", False, "") and ("", tag, closing, attributes).

    Comments, declarations and the content of _RAW elements are left out; a tag without an end before the next
    one begins is text. The scan only moves forward, so it takes time in proportion to the page.
    """
    find, n, at, i = page.find, len(page), 0, page.find("<")
    missing: set[str] = set()

    def first(what: str, start: int) -> int:
        """As find, but what is once not found is not looked for again."""
        if what in missing:
            return -1
        where = find(what, start)
        if where < 0:
            missing.add(what)
        return where

    def tag_end(k: int) -> tuple[int, bool]:
        """Where a tag ends, or else where the next one may begin."""
        while True:
            k = _PLAIN.match(page, k).end()
            if k >= n or page[k] in "<>":
                return k, k < n and page[k] == ">"
            close = first(page[k], k + 1) if page[max(k - 8, 0) : k].rstrip().endswith("=") else -1
            k = max(close, k) + 1

    while i >= 0:
        j, resume = i + 1, i + 1
        if page.startswith("!--", j):
            end = first("-->", j + 1)
            yield page[at:i], "", False, ""
            at = resume = n if end < 0 else end + 3
        elif page[j : j + 1] in ("!", "?"):
            end = first(">", j)
            if end >= 0:
                yield page[at:i], "", False, ""
                at = resume = end + 1
        else:
            closing = page[j : j + 1] == "/"
            name = _NAME.match(page, j + closing)
            if name is not None:
                end, closed = tag_end(name.end())
                resume = end
                if closed:
                    tag, attributes = name[0].lower(), page[name.end() : end]
                    yield page[at:i], "", False, ""
                    at = resume = end + 1
                    if tag not in _RAW:
                        yield "", tag, closing, attributes
                    elif not closing and not attributes.endswith("/") and f"</{tag}" not in missing:
                        ends = _ENDS[tag].search(page, at)
                        if ends is not None:
                            end = first(">", ends.end())
                            at = resume = n if end < 0 else end + 1
                        elif tag in _TO_THE_END:
                            at = resume = n
                        else:
                            missing.add(f"</{tag}")
        i = find("<", resume)
    yield page[at:], "", False, ""


def blocks(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int, str]]]:
    """The containers, parents first, and container, text, characters of link text, and tag of each block that is not left out, in page order."""
    root = _Node(None, "body", "")
    nodes = [root]
    stack: list[tuple[str, _Node]] = [("body", root)]
    open_tags: Counter[str] = Counter()
    out: list[tuple[_Node, str, int, str]] = []
    pieces: list[str] = []
    links = anchors = 0
    block, in_link = "", False

    def flush() -> None:
        nonlocal links, anchors
        if pieces:
            text = " ".join("".join(pieces).split())
            node = stack[-1][1]
            if text and not node.skipped:
                out.append((node, text, links, block))
                node.text += len(text)
                node.links += links
                node.anchors += anchors
            pieces.clear()
        links = anchors = 0

    def pop(k: int) -> None:
        for name, _ in stack[k:]:
            open_tags[name] -= 1
        del stack[k:]

    def close(tag: str, within: bool) -> None:
        """Ends the innermost open tag, if one is open (within: only up to the container around)."""
        if not open_tags[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                pop(k)
                return
            if within and stack[k][0] in _CONTAINERS and not (tag in ("td", "th") and stack[k][0] == "td"):
                return

    for raw, tag, closing, attributes in tokens(page):
        if not tag:
            if raw:
                text = entities.unescape(raw) if "&" in raw else raw
                pieces.append(text)
                if in_link:
                    links += len(text.strip())
        elif tag == "a":
            in_link = not closing
            anchors += not closing
        elif tag == "br":
            pieces.append(" ")
        elif tag in _BLOCKS:
            flush()
            if tag == "body" or tag in _VOID:
                block = ""
                continue
            if closing:
                close(tag, False)
                block = stack[-1][0]
                continue
            if tag not in ("li", "td", "th", "tr", "dt", "dd") and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if tag in _CLOSES_ITSELF:
                close(_CLOSES_ITSELF[tag], True)
            node = stack[-1][1]
            if tag in _CONTAINERS or _CLASS.search(attributes):
                node = _Node(node, tag, attributes)
                nodes.append(node)
            stack.append((tag, node))
            open_tags[tag] += 1
            block = tag
    flush()
    # Sums of what is below, children before parents; what is in doubt does not count for those above it.
    for node in reversed(nodes):
        if node.parent is not None and node.doubt is not node:
            node.parent.text += node.text
            node.parent.links += node.links
            node.parent.anchors += node.anchors
    return nodes, out


def best_node(nodes: list[_Node], found: list[tuple[_Node, str, int, str]]) -> _Node | None:
    """The container of the best score; parts in doubt only count on a page that has nothing else."""
    sure = [x for x in found if x[0].doubt is None]
    for node, text, links, tag in sure or found:
        worth = max(len(text) - 2 * links, 0) * (1.0 if tag in _PARAGRAPHS else 0.7)
        owner = node.owner
        owner.score += worth
        if owner.parent is not None:
            owner.parent.owner.score += 0.5 * worth
    good = [n for n in nodes if n.score > 0 and not n.linky]
    return max(good, key=lambda n: (n.score, n.depth, n.path)) if good else None


def _foreign(node: _Node, in_article: bool) -> bool:
    """Whether node is an article of its own beside the winner."""
    return node.tag == "article" and not node.around and (node.marked or in_article and not node.parent.in_article)


def article(page: str | None, path: str | None) -> str:
    """Main text from the whole articles around the containers on path, or around the page's own best container where none is there."""
    nodes, found = blocks(page or "")
    for node, *_ in found:
        while node is not None and not node.inked:
            node.inked, node = True, node.parent
    chosen = [n for n in nodes if n.path == path and n.doubt is None and n.inked] if path else []
    if not chosen:
        best = best_node(nodes, found)
        chosen = [best] if best is not None else []
    # The outermost container around each that holds a whole article.
    for n in nodes:
        n.whole = (n.parent.whole if n.parent is not None else None) or (n if n.content and (n.tag in ("article", "main") or not n.frame) else None)
    for n in chosen:
        up = n
        while up is not None and not up.around:
            up.around, up = True, up.parent
    picked, whole = {id(n) for n in chosen}, {id(n.whole or n) for n in chosen}
    in_article = any(n.in_article for n in chosen)
    # state: whether blocks right in a node are kept, by the nearest chosen container or else the nearest whole one; None outside both.
    for n in nodes:
        above = n.parent.state if n.parent is not None else None
        if id(n) in picked:
            n.state = "chosen", True
        elif id(n) in whole and (above is None or above[0] != "chosen"):
            n.state = "whole", True
        elif above is not None:
            n.state = above[0], above[1] and not n.linky and not (above[0] == "whole" and _foreign(n, in_article))
    return " ".join(text for node, text, _, _ in found if node.state is not None and node.state[1])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, sizes = [], []
        for page in batch.column("html").to_pylist():
            node = best_node(*blocks(page or ""))
            paths.append(node.path if node is not None else None)
            sizes.append(int(node.score) if node is not None else 0)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["host", "path", "score"])


def _hosted(pages: DataFrame, url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"://([^/?#]*)", 1))


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and path: the path with the most votes of the host's pages, then the highest score, then the first in order."""
    cast = pages.select(_hosted(pages, url).alias("host"), F.col(html).cast("string").alias("html"))
    votes = cast.mapInArrow(_votes, "host string, path string, score bigint").where("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    order = W.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path")
    return counted.withColumn("place", F.row_number().over(order)).where("place = 1").select("host", "path")


#: Bytes of hosts and winning paths up to which they are broadcast.
BROADCAST_BYTES = 16 << 20


def _extracted(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [article(page, path) for page, path in zip(batch.column("__html").to_pylist(), batch.column("__path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """keep, text, n_chars of each page.

    The winning paths are written first and measured. Up to broadcast_bytes of them are broadcast, so that no
    page is shuffled; more are joined by host, as two plain exchanges, which Spark splits where a host is very common.
    """
    names = list(keep)
    rows = pages.select(*names, _hosted(pages, url).alias("__host"), F.col(html).cast("string").alias("__html"))
    won = stored(winning_paths(pages, url, html).select(F.col("host").alias("__host"), F.col("path").alias("__path")), "winning-paths")
    size = won.agg(F.sum(F.octet_length("__host") + F.octet_length("__path") + 16)).first()[0] or 0
    both = rows.join(F.broadcast(won) if size <= broadcast_bytes else won.hint("merge"), "__host", "left").select(*names, "__html", "__path")
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names), "text string"])
    return both.mapInArrow(lambda it: _extracted(it, names), schema).withColumn("n_chars", F.char_length("text").cast("bigint"))
