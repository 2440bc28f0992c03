"""HTML extraction with site template removal.

A page is parsed to a tree and every block-level subtree outside running prose gets a hash of its tags, classes and
text. Spark counts, per host, on how many different pages each hash occurs. Subtrees that occur on many pages of
a host, and on a share of them, are its template and are deleted; so are elements that say what they are (menus,
footers, forms, ...).
What is left gives the text blocks. The template hashes are broadcast in blocks of bounded size, so pages are
never shuffled and no host is a group of one task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.text import map_batches, raw_texts, slices
from casekit.sources.files import stage

MANY_PAGES = 8
PAGE_SHARE = 0.25
SALTS = 32
HASH_BLOCK = 2_000_000

# Fixed values of HTML: elements without content, elements whose content is text, elements that end others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table"
    " tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"body", "caption", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
ENDED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("td", "th", "tr", "tbody", "thead"),
}
HOLDS = frozenset("ul ol dl table menu select".split())

# Elements that are never main text, and what their class, id or role says when they are not.
NEVER = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video map nav footer aside form button"
    " select textarea input label fieldset dialog menu title xmp noembed noframes".split()
)
# Of these, the ones that a whole page may be wrapped in, and the ones that never hold a page.
WRAPPERS = frozenset("form fieldset label".split())
DROPPED = NEVER - WRAPPERS - {"nav", "footer", "aside", "menu"}
HINT_WORDS = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|nav\w*|menus?|breadcrumbs?|pagination|pager|sidebars?|side|widget\w*|aside|footer|footnav|comments?"
    r"|disqus|replies|respond|share|sharing|social|follow|related|recommend\w*|newsletter|subscribe|signup|login|search"
    r"|toolbar|skip\w*|tags|complementary|contentinfo|navigation)"
)
HINT = re.compile(rf"(?:^|[\s_-]){HINT_WORDS}(?:$|[\s_-])")
TOP = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])")  # within an article it holds the headline
NAME_WORD = re.compile(rf"{HINT_WORDS}|header|masthead|reply|teaser|\d+")
SMALL_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|related|teaser|promo\w*|ads?|sponsor\w*)(?:$|[\s_-])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote td th dd dt figcaption".split())
RUNNING = PROSE | {"li", "summary", "address", "caption"}

MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


class Node:
    __slots__ = ("tag", "hints", "children", "digest", "main", "plain", "linked", "candidate", "holds")

    def __init__(self, tag: str, hints: str = ""):
        self.tag, self.hints, self.children = tag, hints, []
        self.digest, self.main = 0, False
        self.plain = self.linked = 0  # characters of text outside and inside links
        self.candidate = False
        self.holds = 0  # articles, and main elements without one, in it


def _hints(attributes: str) -> str:
    if not attributes or attributes.isspace():
        return ""
    found = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        found.append("hidden" if name == "hidden" or name == "aria-hidden" and value == "true" else value)
    return " ".join(found)


def parse(page: str) -> Node:
    """Tree of elements and texts. Never fails: stray end tags are passed over, open elements end with the page."""
    root = Node("#page")
    stack = [root]
    at = 0
    while True:
        m = MARKUP.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].children.append(text)
        if not m:
            return root
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("td", "th", "article", "main") and tag not in BLOCK:
                    break  # an inline end tag does not close these
            continue
        if tag in ENDS_P or tag in ENDED_BY:
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = stack[depth].tag
                if open_tag == "p" and tag in ENDS_P or open_tag in ENDED_BY.get(tag, ()):
                    del stack[depth:]
                elif open_tag in BLOCK or open_tag in HOLDS:
                    break
        node = Node(tag, _hints(m[3]))
        stack[-1].children.append(node)
        if tag in RAW_END:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)


def _digest(root: Node) -> None:
    """Sets each node's hash of tag, hints and content, and its text lengths; iterative, as trees may be deep."""
    order, within = [root], [False]  # within: in an article, or in what is dropped with all it holds
    for node, inner in zip(order, within):
        node.main = node.main or node.tag in ("article", "main")
        for child in node.children:
            if isinstance(child, Node):
                child.main = node.main
                order.append(child)
                within.append(inner or _dropped(node) or node.tag == "article" and not _says_so(node))
    for node, inner in zip(reversed(order), reversed(within)):
        parts = [node.tag, node.hints]
        parts += [str(c.digest) if isinstance(c, Node) else " ".join(c.split()) for c in node.children]
        node.digest = xxhash.xxh64_intdigest("\0".join(parts).encode(), 7)
        for c in node.children:
            if isinstance(c, Node):
                node.plain += 0 if _dropped(c) else c.plain
                node.linked += c.linked
                node.holds += c.holds
            else:
                node.plain += len(c.strip())
        if node.tag == "a":
            node.plain, node.linked = 0, node.plain + node.linked
        if node.tag in ("article", "main") and not (inner or node.holds or _dropped(node) or _says_so(node) or _chrome(node)):
            node.holds = int(node.plain > 0)


def _candidates(root: Node) -> Iterator[Node]:
    """Subtrees that may be template: block-level elements that are not prose themselves nor lie in prose.

    Inline elements and headings are none, and a paragraph, list item or cell is one only if all its text is in
    links. Within an article so are only elements with most of their text in links.
    """
    stack = [root]
    while stack:
        node = stack.pop()
        for child in node.children:
            if isinstance(child, Node) and child.tag not in RAW and child.tag not in VOID:
                if child.tag not in RUNNING or not _own_text(child):
                    stack.append(child)
                if child.tag in BLOCK and child.tag not in ("html", "body", "head", "article", "main") and child.children:
                    if child.tag in RUNNING and (child.plain or child.tag in HEADINGS) or child.main and not _chrome(child):
                        continue
                    yield child


def _own_text(node: Node) -> bool:
    """Whether an element has text outside links and outside block-level elements within it."""
    stack = [node]
    while stack:
        for child in stack.pop().children:
            if not isinstance(child, Node):
                if not child.isspace():
                    return True
            elif child.tag not in BLOCK and child.tag != "a":
                stack.append(child)
    return False


def _chrome(node: Node) -> bool:
    """Whether most of a subtree's text is in links: what repeats in an article is template only then."""
    return node.linked > node.plain


def _says_so(node: Node) -> bool:
    """Whether an element is by its name, or by its class, id or role, something else than main text."""
    if node.tag in NEVER or node.tag == "header" and not node.main or node.hints == "hidden":
        return True
    if not node.hints or node.tag in ("html", "body", "main"):
        return False
    if node.tag == "article":
        return bool(SMALL_ARTICLE.search(node.hints))
    return "hidden" in node.hints.split() or bool(HINT.search(node.hints)) or not node.main and bool(TOP.search(node.hints))


def _dropped(node: Node) -> bool:
    """Whether an element goes whatever it holds."""
    return node.tag in DROPPED or "hidden" in node.hints.split()


def _names_itself(node: Node) -> bool:
    """Whether a class, id or role is nothing but such a name (`sidebar`), not one that mentions it (`has-sidebar`)."""
    return any(all(NAME_WORD.fullmatch(w) for w in re.split("[_-]+", token)) for token in node.hints.split())


def _goes(node: Node, root: Node) -> bool:
    """Whether an element is deleted for what it says it is: not if it holds the main text.

    An element that only mentions a name, or is of a kind that pages are wrapped in, holds it if it has an article
    (or main element) or most of the page's text outside links; one that has the name itself must have most of that
    text with all articles, or nearly all of it.
    """
    if not _says_so(node):
        return False
    if _dropped(node):
        return True
    most = node.plain > 0.5 * root.plain
    if node.tag in ("nav", "footer", "aside", "menu"):
        return not (0 < root.holds == node.holds and most)
    if node.tag not in WRAPPERS and _names_itself(node):
        return not (0 < root.holds == node.holds and most or node.plain > 0.9 * root.plain)
    return not (node.holds or most)


def blocks(root: Node, host: int, template: set[int]) -> list[str]:
    """Text blocks in page order, without template subtrees and elements that say they are none of the text.

    If the page has articles or main elements that stay, only text in them counts.
    """
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(text)

    def goes(node: Node) -> bool:
        return _goes(node, root) or node.candidate and key(host, node.digest) in template

    scoped = any(n.tag in ("article", "main") and n.plain + n.linked for n in _walk(root, goes))
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            parts.append(node)
            continue
        if node is None:
            close()
            continue
        if goes(node):
            if node.tag in BLOCK:
                close()
            continue
        if node.tag in ("br", "wbr", "hr", "img"):
            if node.tag != "wbr":
                parts.append(" ")
            continue
        keeps = not scoped or node.main
        children = [c for c in node.children if isinstance(c, Node) or keeps]
        if node.tag in BLOCK or node.tag == "#page":
            close()
            stack.append(None)
        stack += reversed(children)
    close()
    return out


def _walk(root: Node, past: Callable[[Node], bool] | None = None) -> Iterator[Node]:
    """All nodes, without the subtrees of those to go past."""
    stack = [root]
    while stack:
        node = stack.pop()
        if not (past and past(node)):
            yield node
            stack += [c for c in node.children if isinstance(c, Node)]


def host_of(url: str | None) -> int:
    """Hash of a URL's host without user, port and capitals; pages without a URL share one host."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", (url or "").strip())
    return xxhash.xxh64_intdigest((m[1] if m else "").lower(), 11)


def key(host: int, digest: int) -> int:
    return (host * 0x9E3779B97F4A7C15 + digest) & (2**64 - 1)


def template_hashes(pages: DataFrame, many: int = MANY_PAGES, share: float = PAGE_SHARE) -> DataFrame:
    """Hashes of (host, subtree) that occur on at least `many` different pages of the host and this share of them.

    Pages of a host with the same content count once: copies of an article are no template. Counts are over all
    pages; each page sends a hash at most once, and counts are summed before the shuffle. A host's own pages are
    counted under its own hash; its number is dealt to several keys, as a host may have many subtrees.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            keys, hosts, contents = [], [], []
            for url, page in zip(batch.column("url").to_pylist(), raw_texts(batch, "html")):
                root, host = parse(page.decode()), host_of(url)
                own = _keys(root, host) | {host}
                keys += own
                hosts += [host] * len(own)
                contents += [_content(root, page)] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, hosts, contents)], ["hash", "host", "content"]
            )

    rows = map_batches(pages.select("url", "html"), hashed, "hash long, host long, content long")
    counts = rows.distinct().groupBy("hash", "host").agg(F.count("*").alias("pages")).where(F.col("pages") >= many)
    counts = stage(counts.withColumn("salt", F.pmod("hash", F.lit(SALTS))), "template-counts")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    hosts = counts.where("hash = host").select("host", F.col("pages").alias("of"), salts)
    return counts.where("hash <> host").join(hosts, ["host", "salt"]).where(F.col("pages") >= share * F.col("of")).select("hash")


def _content(root: Node, page: bytes) -> int:
    """Hash of a page's prose, by which copies of a page are known; of the page if it has none."""
    prose = [c for n in _walk(root) if n.tag in PROSE for c in n.children if isinstance(c, str)]
    return xxhash.xxh64_intdigest("\0".join(prose).encode() or page, 13)


def extract(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    many: int = MANY_PAGES, block: int = HASH_BLOCK, share: float = PAGE_SHARE,
) -> DataFrame:
    """page_id, url and the main text of every page: blocks joined by line breaks, '' if there is none.

    Null and empty pages give ''. Null urls share a host. Ids may be null or repeat; each row gives one row. Only
    the named columns are read. Broken markup is read as far as it goes. Counting templates is a job that runs
    while the plan is built; the hashes come to the driver in blocks of about `block`.
    """
    spark = pages.sparkSession
    named = pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"),
        F.col(html_column).cast("string").alias("html"), F.expr("CAST(array() AS array<long>)").alias("known"),
    )
    kind = named.schema["page_id"].dataType.simpleString()
    hashes = stage(template_hashes(named, many, share), "template-hashes")
    parts = max(1, -(-hashes.count() // block))

    def part(k: int) -> np.ndarray:
        rows = hashes.where(F.pmod("hash", F.lit(parts)) == k).toPandas()["hash"].to_numpy(np.int64)
        return np.sort(rows.view(np.uint64))

    def marked(pages: DataFrame, own: np.ndarray) -> DataFrame:
        """Adds to `known` the hashes of this block that a page has."""
        shared = spark.sparkContext.broadcast(own)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "html"):
                known = batch.column("known").to_pylist()
                for d, (url, page) in enumerate(zip(batch.column("url").to_pylist(), raw_texts(batch, "html"))):
                    root = parse(page.decode())
                    known[d] += list(_found(shared.value, _keys(root, host_of(url))))
                yield batch.set_column(3, "known", pa.array(known, pa.list_(pa.uint64())).cast(pa.list_(pa.int64()), safe=False))

        return map_batches(pages, mark, f"page_id {kind}, url string, html string, known array<long>")

    for k in range(parts - 1):
        named = stage(marked(named, part(k)), "template-pages")
    last = spark.sparkContext.broadcast(part(parts - 1))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = []
            rows = zip(batch.column("url").to_pylist(), raw_texts(batch, "html"), batch.column("known").to_pylist())
            for url, page, known in rows:
                root, host = parse(page.decode()), host_of(url)
                template = _found(last.value, _keys(root, host)) | {x & (2**64 - 1) for x in known}
                texts.append("\n".join(blocks(root, host, template)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    return map_batches(named, extracted, f"page_id {kind}, url string, text string")


def _keys(root: Node, host: int) -> set[int]:
    """Sets the digests of a tree, marks its candidates and returns their keys."""
    _digest(root)
    keys = set()
    for node in _candidates(root):
        node.candidate = True
        keys.add(key(host, node.digest))
    return keys


def _found(table: np.ndarray, keys: set[int]) -> set[int]:
    """Those of the keys that are in a sorted table."""
    own = np.fromiter(keys, np.uint64, len(keys))
    if not len(table) or not len(own):
        return set()
    place = np.minimum(np.searchsorted(table, own), len(table) - 1)
    return set(own[table[place] == own].tolist())
