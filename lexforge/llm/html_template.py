"""Text of web pages without the templates of their sites."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import checkpointed, small
from .url_filter import host_of

#: A subtree is a template if pages of so many different contents of its host have it, and so large a share of them.
MIN_PAGES, SHARE = 5, 0.1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: What an opening tag closes, and up to where that is looked for.
_CLOSES = {tag: (frozenset(same), frozenset(within)) for tag, same, within in (
    *((t, ("p",), ("table", "td", "th", "button", "object")) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    ("li", ("li",), ("ul", "ol")), ("dt", ("dt", "dd"), ("dl",)), ("dd", ("dt", "dd"), ("dl",)), ("option", ("option",), ("select",)),
    ("tr", ("tr",), ("table",)), ("td", ("td", "th"), ("tr", "table")), ("th", ("td", "th"), ("tr", "table")), ("tbody", ("thead", "tbody"), ("table",)), ("tfoot", ("tbody",), ("table",)), ("body", ("head",), ("html",)),
)}
#: Elements that stay even if whole pages recur.
_KEPT = frozenset(("html", "body", "head"))


class Node:
    __slots__ = ("tag", "parts", "children", "words", "hash")

    def __init__(self, tag: str, attributes: str) -> None:
        self.tag, self.parts, self.children, self.words, self.hash = tag, [tag, attributes], [], False, 0


def parse(text: str) -> Node:
    """The tree of a page; comments, scripts and styles are left out, open elements end with what holds them, stray end tags are passed over."""
    root = Node("", "")
    stack = [root]
    at = 0

    def close() -> None:
        node = stack.pop()
        node.hash = xxhash.xxh3_64_intdigest("\0".join(node.parts)) - (1 << 63)
        above = stack[-1]
        above.parts.append(str(node.hash))
        above.words |= node.words

    def say(chunk: str) -> None:
        chunk = html.unescape(chunk) if "&" in chunk else chunk
        plain = " ".join(chunk.split())
        if plain:
            stack[-1].parts.append("\1" + plain)
            stack[-1].words = True
        if chunk:
            stack[-1].children.append(chunk)

    for m in _TOKEN.finditer(text):
        if m.start() > at:
            say(text[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        close()
                    break
            continue
        if tag in _CLOSES:
            same, within = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in same:
                    while len(stack) > k:
                        close()
                    break
                if stack[k].tag in within:
                    break
        attributes = m["attributes"].strip()
        node = Node(tag, attributes.rstrip("/").rstrip())
        stack[-1].children.append(node)
        stack.append(node)
        if tag in _VOID or attributes.endswith("/"):
            close()
    if at < len(text):
        say(text[at:])
    while len(stack) > 1:
        close()
    return root


def subtrees(root: Node) -> set[int]:
    """Hashes of all elements that hold text; of tag, attributes, text and subtrees in their order."""
    out: set[int] = set()
    todo = [root]
    while todo:
        node = todo.pop()
        for child in node.children:
            if isinstance(child, Node) and child.words:
                if child.tag not in _KEPT:
                    out.add(child.hash)
                todo.append(child)
    return out


def bare(root: Node) -> int:
    """Hash of the text outside of all elements that can be deleted; of a page without any, that of nothing."""
    out: list[str] = []
    todo = [root]
    while todo:
        node = todo.pop()
        out.extend(" ".join(x.split()) for x in node.children if isinstance(x, str))
        todo.extend(x for x in node.children if isinstance(x, Node) and x.tag in _KEPT)
    return xxhash.xxh3_64_intdigest("\1" + "\0".join(x for x in out if x)) - (1 << 63)


def extract(root: Node, template: frozenset[int] | set[int]) -> tuple[str, int]:
    """Text of a page without these subtrees, and how many were deleted; block elements are lines, white space is single blanks."""
    parts: list[str] = []
    removed = 0
    todo: list = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            parts.append(node)
            continue
        for child in reversed(node.children):
            if isinstance(child, str):
                todo.append(" ".join(child.split("\n")) if "\n" in child else child)
            elif child.words and child.tag not in _KEPT and child.hash in template:
                removed += 1
                todo.append("\n" if child.tag in _BLOCK else " ")
            elif child.tag in _BLOCK:
                todo.extend(("\n", child, "\n"))
            else:
                todo.append(child)
    lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line), removed


TEXTS = "page_id long, host string, text string, removed int"


def _texts(piece: pa.RecordBatch, pages: list[tuple[str | None, set[int]]]) -> pa.RecordBatch:
    """Rows of :data:`TEXTS` of a batch, whose pages are given with their templates."""
    found = [(None, 0) if t is None else extract(parse(t), template) for t, template in pages]
    return pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("host"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32())], ["page_id", "host", "text", "removed"])


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """Text of every page without the subtrees that recur on its host.

    Returns page_id, host, text and removed, the number of deleted subtrees.
    An element that holds text is deleted if pages of at least ``min_pages``
    different contents of the host have the same, and ``share`` of them. A
    page's content is what it has besides the elements that so many pages
    share, so copies of an article count once, whatever their scripts, and
    however often an element occurs on a page.

    A null ``html`` gives a null text and 0, an empty one an empty text. Pages
    without a host (or a null URL) lose nothing; repeated rows and null
    ``page_id`` are kept. An empty table gives an empty result; other columns
    are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("site", F.xxhash64("host")).withColumn("page", F.xxhash64("html"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                site, node, page = [], [], []
                for s, p, text in zip(*(piece.column(c).to_pylist() for c in ("site", "page", "html"))):
                    root = parse(text)
                    found = subtrees(root)
                    found.add(bare(root))
                    node.extend(found)
                    site.extend([s] * len(found))
                    page.extend([p] * len(found))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (site, node, page)], ["site", "node", "page"])

    hosted = pages.where("host <> '' and html is not null")
    nodes = checkpointed(hosted.select("site", "page", "html").mapInArrow(hashed, "site long, node long, page long").distinct())
    common = checkpointed(nodes.groupBy("site", "node").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("site", "node"))
    near = F.broadcast(common) if small(common, 32) else common
    own = nodes.join(near, ["site", "node"], "left_anti").groupBy("site", "page").agg(F.bit_xor(F.xxhash64("node")).alias("content"))
    contents = checkpointed(nodes.select("site", "page").distinct().join(own, ["site", "page"], "left").select("site", "page", F.coalesce("content", F.lit(0)).alias("content")))
    sizes = contents.groupBy("site").agg(F.countDistinct("content").alias("pages"))
    counted = nodes.join(near, ["site", "node"]).join(contents, ["site", "page"]).groupBy("site", "node").agg(F.countDistinct("content").alias("n")).where(F.col("n") >= min_pages)
    template = checkpointed(counted.join(sizes, "site").where(F.col("n") >= share * F.col("pages")).select("site", "node"))
    if small(template, 128):  # of a number in a set of Python's
        # the pages stay where they are; a page's own subtrees among its site's are the same as in the join below
        sites: dict[int, set[int]] = {}
        for site, node in template.toLocalIterator():
            sites.setdefault(site, set()).add(node)
        shared = pages.sparkSession.sparkContext.broadcast(sites)

        def text_of_site(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none: set[int] = set()
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    piece = batch.slice(k, 256)
                    hosts, htmls = piece.column("host").to_pylist(), piece.column("html").to_pylist()
                    yield _texts(piece, [(t, shared.value.get(s, none) if h else none) for s, h, t in zip(piece.column("site").to_pylist(), hosts, htmls)])

        return pages.select("page_id", "host", "html", "site").mapInArrow(text_of_site, TEXTS)
    gone = nodes.join(template, ["site", "node"]).groupBy("site", "page").agg(F.collect_list("node").alias("gone"))

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                yield _texts(piece, [(t, set(g or ())) for t, g in zip(piece.column("html").to_pylist(), piece.column("gone").to_pylist())])

    return pages.join(gone, ["site", "page"], "left").select("page_id", "host", "html", "gone").mapInArrow(text, TEXTS)
