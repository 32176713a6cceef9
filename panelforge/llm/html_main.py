"""Main text of web pages, with site templates removed.

Every page is read into a tree, and every subtree gets a hash of its tags and texts; attributes and link targets play no part, so a menu is
the same on each page whatever it marks as current.  Spark counts the different pages of a host that hold a subtree, and those on many
of them are deleted with all that is in them.  Article and main elements, and the plain paragraphs inside them, are never
taken for template: a passage that many articles quote stays.  What is left then goes by its tag, role or class where these say
that it is no article text, so pages of small hosts lose their menus and comments too.

What moves of a page for the counts is its hash and those of its subtrees; pages are grouped by host and page hash, so copies of a page
are one and a host with a third of all pages is many groups.  Pages themselves are joined to their host's template hashes and do not move while those fit a broadcast.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import filled, slices
from panelforge.llm.urls import host
from panelforge.session import cut_lineage

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot"
    " thead tr ul caption".split()
)
CLOSES_P = BLOCKS - {"body", "html", "tbody", "tfoot", "thead", "tr", "caption", "legend"}
#: Start tag -> tags it closes, and the elements that shield them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
NO_TEXT = frozenset(
    "head nav footer aside form button select dialog menu svg canvas object audio video math search label input"
    " map datalist fieldset".split()
) | RAW
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_KEYS = (
    "ads?|advert\\w*|adsense|banners?|sponsor\\w*|promo\\w*|cookies?|consent|gdpr|notices?|popups?|modal|overlay|newsletter|subscribe"
    "|subscription|side-?bars?|menus?|nav|navbar|navigation|breadcrumbs?|masthead|site-?header|page-?header|topbar|footers?|comments?"
    "|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommend\\w*|widgets?|toolbar|skip-?links?|login|signup|searchbox|pagination|pager"
)
_BEFORE = (
    "site|page|main|post|entry|article|content|top|bottom|left|right|header|footer|global|primary|secondary|sticky|fixed|mobile|desktop"
    "|wp|blog|user|reader|email|google|js|inline"
)
_AFTER = (
    "list|box|container|wrapper|wrap|area|sections?|bar|block|panel|links?|buttons?|btn|icons?|form|items?|body|content|inner|outer|title"
    "|header|heading|holder|unit|slot|message|text|top|bottom|left|right|main|primary|secondary|posts|articles|stories|tools?|count|thread"
    "|feed|stream|[a-z]*\\d+"
)
#: A class or id made of nothing but such words; "related-work" or "share-price" is none.
NO_TEXT_CLASS = re.compile(rf"^(?:(?:{_BEFORE})[-_])*(?:{_KEYS})(?:[-_](?:{_AFTER}|{_KEYS}))*$|^header$", re.I)
#: The classes of an article element that make it a reader's comment.
COMMENT_CLASS = re.compile(r"^(?:(?:wp|user|reader|blog)[-_])*(?:comments?|repl(?:y|ies)|disqus)(?:[-_](?:body|item|content|text|thread|list|\d+))*$", re.I)
ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
NEVER_TEMPLATE = frozenset("html body article main".split())
PROSE = frozenset("p blockquote pre li dd dt figcaption td th tr tbody".split()) | HEADINGS


class Node:
    __slots__ = ("tag", "attributes", "children", "start", "end", "digest")

    def __init__(self, tag: str, attributes: str, start: int):
        self.tag, self.attributes, self.start, self.end, self.digest = tag, attributes, start, start, 0
        self.children: list = []


def parse(page: str) -> Node:
    """The tree of a page: text strings and nodes, with missing end tags supplied where a browser would."""
    root = Node("#root", "", 0)
    stack, at, n = [root], 0, len(page)

    def close(index: int, where: int) -> None:
        for node in stack[index:]:
            node.end = where
        del stack[index:]

    def close_open(tags: set, shields: set, where: int) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                close(i, where)
            elif stack[i].tag in shields:
                return

    while at < n:
        found = TOKEN.search(page, at)
        if not found:
            stack[-1].children.append(page[at:])
            break
        begin, after = found.span()
        if begin > at:
            stack[-1].children.append(page[at:begin])
        at = after
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i, after)
                    break
                if stack[i].tag in BLOCKS and tag not in BLOCKS:
                    break
            continue
        if tag in CLOSES_P:
            close_open({"p"}, {"table", "td", "th", "button", "object", "article", "section", "div", "li", "blockquote"}, begin)
        if tag in CLOSES:
            close_open(*CLOSES[tag], begin)
        node = Node(tag, found[3] or found[6] or "", begin)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, after)
            at = page.find(">", end.start()) + 1 or n if end else n
            node.end = at
        elif tag in VOID:
            node.end = after
        else:
            stack.append(node)
    close(0, n)
    return root


def holds_no_text(node: Node, inside: bool) -> bool:
    """Whether tag, role, class or style say that a node is not article text; ``inside`` an article element or not."""
    if node.tag in NO_TEXT or node.tag == "header" and not inside:
        return True
    if not node.attributes or node.tag in NEVER_TEMPLATE and node.tag != "article":
        return False
    for name, *values in ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if node.tag == "article":
            if name == "class" and any(map(COMMENT_CLASS.match, value.split())):
                return True
            continue
        if name in ("class", "id"):
            if node.tag not in HEADINGS and any(map(NO_TEXT_CLASS.match, value.split())):
                return True
        elif name == "role":
            if value.strip().lower() in NO_TEXT_ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def nodes(root: Node) -> Iterator[tuple[Node, bool]]:
    """All nodes below ``root`` with whether they are in an article or main element."""
    todo = [(c, False) for c in reversed(root.children) if isinstance(c, Node)]
    while todo:
        node, inside = todo.pop()
        yield node, inside
        inside = inside or node.tag in ("article", "main")
        todo += [(c, inside) for c in reversed(node.children) if isinstance(c, Node)]


def hash_subtrees(root: Node) -> None:
    """Give every node below ``root`` its ``digest``: a signed 64-bit hash of its tag, its texts and its children's digests.

    White space is made alike, attributes are left out.  One pass from the leaves up, so the work is that of reading the page.
    """
    from xxhash import xxh64_intdigest

    for node, _ in reversed(list(nodes(root))):
        parts = [node.tag]
        for child in node.children:
            if isinstance(child, Node):
                parts.append(f"<{child.digest}>")
            elif words := child.split():
                parts.append(f" {' '.join(words)} ")
        value = xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
        node.digest = value - (1 << 64) if value >> 63 else value


def may_be_template(node: Node, inside: bool) -> bool:
    if node.tag in NEVER_TEMPLATE or node.tag in VOID:
        return False
    return not inside or node.tag in BLOCKS and node.tag not in PROSE


def page_key(page: str) -> bytes:
    """128-bit hash of the page, white space made alike."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(" ".join(page.split()).encode("utf-8", "surrogatepass"))


def subtree_hashes(page: str) -> set[int]:
    """Hashes of all subtrees of a page that may be template."""
    root = parse(page)
    hash_subtrees(root)
    return {node.digest for node, inside in nodes(root) if may_be_template(node, inside)}


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The blocks of the main text, joined by two line ends: of the article elements if there are any, else main, else all.

    Subtrees in ``template`` go first, then those that tag, role or class rule out, with all articles in them.
    """
    root = parse(page)
    if template:
        hash_subtrees(root)

    def goes(node: Node, inside: bool) -> bool:
        return may_be_template(node, inside) and node.digest in template or holds_no_text(node, inside)

    tops: list[Node] = []
    for wanted in ("article", "main"):
        last = -1
        for node, inside in nodes(root):
            if node.start < last:
                continue
            if goes(node, inside):
                last = node.end
            elif node.tag == wanted:
                tops.append(node)
                last = node.end
        if tops:
            break
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        block = " ".join(entities.unescape("".join(held)).split())
        if block:
            blocks.append(block)
        held.clear()

    for top in tops or [root]:
        inside = bool(tops)
        todo: list = [top]
        while todo:
            node = todo.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                held.append(node)
            elif node is not top and goes(node, inside):
                continue
            elif node.tag in ("br", "td", "th"):
                held.append(" ")
                todo += reversed(node.children)
            elif node.tag == "header":
                flush()
                todo += [x for c, _ in reversed(list(nodes(node))) if c.tag in HEADINGS for x in (None, *reversed(c.children), None)]
            elif node.tag in BLOCKS or node is top:
                flush()
                todo += [None, *reversed(node.children)]
            else:
                todo += reversed(node.children)
        flush()
    return "\n\n".join(blocks)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different page of a host in a part of a batch, with its subtrees."""
    for part in slices(batches, "_html"):
        found: dict = {}
        for name, page in zip(part.column("_host").to_pylist(), part.column("_html").to_pylist()):
            key = name, page_key(page)
            if key not in found:
                found[key] = list(subtree_hashes(page))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in found], pa.string()),
                pa.array([k[1] for k in found], pa.binary()),
                pa.array(list(found.values()), pa.list_(pa.int64())),
            ],
            ["host", "page", "subtrees"],
        )


def site_templates(pages: DataFrame, min_pages: int = 5, min_share: float = 0.3, per_root: float = 10.0) -> DataFrame:
    """``host`` and ``hashes``: subtrees that recur on many different pages of their host.

    Many are ``min_pages`` at least, and ``min_share`` of the host's ``n`` different pages or ``per_root`` times the root of ``n``, whichever is
    less: a block that one part of a large host repeats is found without being on a third of all its pages.  Copies of a page
    are one page.  A host of ``n`` pages has at most root of ``n`` over ``per_root`` times as many template hashes as a page has elements.
    """
    rows = pages.select(host(F.col("url")).alias("_host"), filled("html").alias("_html"))
    found = rows.mapInArrow(_subtrees, "host string, page binary, subtrees array<long>")
    different = cut_lineage(found.groupBy("host", "page").agg(F.first("subtrees").alias("subtrees")))
    total = different.groupBy("host").agg(F.count(F.lit(1)).alias("all_pages"))
    counts = different.select("host", F.explode("subtrees").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages"))
    often = counts.filter(F.col("pages") >= min_pages).join(total, "host")
    enough = F.least(min_share * F.col("all_pages"), per_root * F.sqrt("all_pages"))
    often = often.filter(F.col("pages") >= enough)
    return often.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_html"):
        texts = [
            main_text(page, frozenset(hashes or ()))
            for page, hashes in zip(part.column("_html").to_pylist(), part.column("hashes").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, min_pages: int = 5, min_share: float = 0.3) -> DataFrame:
    """``page_id``, ``url``, ``text`` of every page; null or empty html gives an empty text, a null url is the host ''.

    Copies of a page count once for the templates of its host; an empty table gives no rows; other columns are not read.  Pages of any
    length and depth are read as a whole, in time that grows with the page.
    """
    templates = cut_lineage(site_templates(pages, min_pages, min_share))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", filled("html").alias("_html"), host(F.col("url")).alias("host")
    )
    return rows.join(templates, "host", "left").select("page_id", "url", "_html", "hashes").mapInArrow(
        _extract, "page_id long, url string, text string"
    )
