"""Main text of web pages through a site style tree.

All pages of a host are merged into one tree: a node is a path of tags with
their classes, and it keeps how its children were arranged (presentation) and
what it said (content) on each page.  The importance of a node is the larger of
the two normalised entropies; that of a branch is the largest in it.  Branches of
low importance, the same on page after page, are removed from each page, together
with the elements whose role is never article text (menus, forms, adverts, ...).
On a page with an ``article`` or ``main`` element only its text is main text; no
branch is removed there, but every line is judged by its own share of the entropy,
ln(pages / pages with the line) / ln(pages), within the article texts of the host
(elsewhere, within its other text).  So a notice repeated on page after page goes
wherever it stands, and a line seen on few pages always stays.  An article in an
element with a hinted class counts, unless the class names comments, adverts or
related pages; one in an element of another role doesn't.

Counting is by (host, path, feature) with partial aggregates, so a host that
holds a third of all pages isn't gathered anywhere.  Null or empty html gives an
empty text, a null url the host ''.  Repeated rows give a row each.  If removal
would leave nothing of a page, that page keeps its branches and lines, and if it
still has nothing, the articles in hinted elements.  Columns other than the three
named ones are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sized, stored

#: A branch with less importance on at least so many pages of a host is removed.
LOW_IMPORTANCE, MIN_PAGES = 0.1, 5
#: A path holds at most so many tags; deeper ones start another segment, named by the hash of the path it hangs on.
SEGMENT = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Elements that never hold article text.
ROLES = frozenset(
    "head script style noscript template iframe object svg canvas nav aside footer form button select textarea dialog menu audio video".split()
)
#: Words in class, id or role that mark such elements.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related reply respond "
    "share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Those that mark what isn't by the page's author or is about other pages: an article in them is none of the page's own.
FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertising comment comments disqus promo related reply respond sponsor sponsored".split()
)
#: First pieces of a class that make an article itself a comment or a teaser.
NOT_OWN = frozenset("comment reply teaser related promo sponsored ad advert".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An opening tag closes an open element of these kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
STOPS = frozenset("ul ol dl table article section div body html main nav aside footer header form blockquote".split())
P_CLOSERS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECES = re.compile(r"[^a-z0-9]+")
UNFINISHED = re.compile(r"<(?:[a-zA-Z!?]|/[a-zA-Z])")


#: Why an element's text is skipped: words that an article in it overrules, words that it doesn't, or its role.
HINTED, NAMED, ROLE = 1, 2, 3
#: Paths that stand for the text of all articles of a page, and for its other text.
ARTICLES, OUTSIDE = "articles", ""


class Node:
    """An open element; ``hangs`` are the paths on which its segment and those above it hang."""

    __slots__ = ("tag", "path", "skip", "main", "depth", "hangs")

    def __init__(self, tag: str, path: str, skip: int, main: bool, depth: int, hangs: tuple[str, ...] = ()):
        self.tag, self.path, self.skip, self.main, self.depth, self.hangs = tag, path, skip, main, depth, hangs


ROOT = Node("", "", 0, False, 0)


def opened(tag: str, attributes: str, over: Node, lift: int = HINTED) -> Node:
    """The node of an opening tag under an open element; an article is not skipped for reasons up to ``lift``."""
    label, skip, article = tag, over.skip, tag in ("article", "main")
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            if name.lower() == "class" or name.lower() == "id":
                label += "." + (value if len(value) <= 40 and "/" not in value else f"{hashed(value):x}")
            if article:
                if any(PIECES.split(c, maxsplit=1)[0] in NOT_OWN for c in value.split()):
                    skip = max(skip, NAMED)
            elif tag not in ("html", "body"):
                # In an article a word marks an element only if it stands alone: ``share``, not ``share-price``.
                pieces = value.split() if over.main else PIECES.split(value)
                if not HINTS.isdisjoint(pieces):
                    skip = max(skip, HINTED if FOREIGN.isdisjoint(pieces) else NAMED)
    if tag in ROLES or (tag == "header" and not over.main):
        skip = ROLE
    # Inside an article what is hinted stays out, whatever it holds.
    if article and not over.main and skip <= lift:
        skip = 0
    main = over.main or (article and not skip)
    if over.depth < SEGMENT:
        return Node(tag, f"{over.path}/{label}", skip, main, over.depth + 1, over.hangs)
    return Node(tag, f"#{hashed(over.path)}/{label}", skip, main, 1, (*over.hangs, over.path))


def walk(page: str, lift: int = HINTED) -> Iterator[tuple[str, Node, str]]:
    """('text', open element, raw text), ('open', node, parent's path) and ('close', node, '') in page order."""
    stack = [ROOT]
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            if (cut := UNFINISHED.search(rest)) is not None:  # a tag that the end of the page cuts off
                rest = rest[: cut.start()]
            if rest:
                yield "text", stack[-1], rest
            break
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    for n in reversed(stack[k:]):
                        yield "close", n, ""
                    del stack[k:]
                    break
            continue
        closes = CLOSES.get(tag)
        if closes or tag in P_CLOSERS:
            kinds = closes or {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in kinds:
                    for n in reversed(stack[k:]):
                        yield "close", n, ""
                    del stack[k:]
                    break
                if stack[k].tag in STOPS:
                    break
        node = opened(tag, m[3], stack[-1], lift)
        yield "open", node, stack[-1].path
        if tag in VOID or m[3].endswith("/"):
            yield "close", node, ""
        elif tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.I).search(page, at)
            at = end if stop is None else stop.start()
            stack.append(node)
        else:
            stack.append(node)


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def lines(events: list[tuple[str, Node, str]], low: frozenset[str] = frozenset()) -> list[tuple[str, bool]]:
    """(text, inside an article) of the blocks outside low branches, in page order; of a page with articles, of these only."""
    out: list[tuple[str, bool]] = []
    kept: list[str] = []
    inside = False
    whole = any(what == "text" and node.main and not node.skip and not more.isspace() for what, node, more in events)

    def flush() -> None:
        text = " ".join(entities.unescape("".join(kept)).split())
        if text:
            out.append((text, inside))
        kept.clear()

    cut: list[Node] = []
    for what, node, more in events:
        if what == "text":
            if not node.skip and not cut and (node.main or not whole):
                kept.append(more)
                inside = node.main
            continue
        if node.tag not in INLINE:
            flush()
        elif node.tag in ("br", "img", "wbr"):
            kept.append(" ")
        if what == "open" and node.path in low and not node.main and not cut:
            cut.append(node)
        elif what == "close" and cut and cut[-1] is node:
            cut.pop()
    flush()
    return out


#: What is counted of a path: its children's tags, its own text, a line of its text, or a segment below it.
SHAPE, SAID, LINE, BELOW = 0, 1, 2, 3


def features(page: str) -> list[tuple[str, int, int, bool]]:
    """(path, kind, hash, inside an article): each distinct path's children and text, each distinct line and deeper segment."""
    events = list(walk(page))
    shape: dict[str, list[str]] = {}
    said: dict[str, list[str]] = {}
    inside: dict[str, bool] = {}
    deep: dict[str, tuple[str, ...]] = {}
    for what, node, more in events:
        if what == "open":
            if not node.skip:
                inside.setdefault(node.path, node.main)
                if node.hangs:
                    deep.setdefault(node.hangs[-1], node.hangs)
            tags = shape.setdefault(more, [])
            if not tags or tags[-1] != node.tag:
                tags.append(node.tag)
        elif what == "text" and not node.skip:
            said.setdefault(node.path, []).append(" ".join(more.split()))
    out = []
    for p, m in inside.items():
        out.append((p, SHAPE, hashed(">".join(shape.get(p, []))), m))
        out.append((p, SAID, hashed("\n".join(said.get(p, []))), m))
    for below, hangs in deep.items():
        out += [(p, BELOW, hashed(below), False) for p in hangs]
    found = {(m, hashed(text)) for text, m in lines(events)}
    for m in {m for m, _ in found}:
        out.append((ARTICLES if m else OUTSIDE, SHAPE, 0, m))
    return out + [(ARTICLES if m else OUTSIDE, LINE, h, m) for m, h in found]


def blocks(page: str, low: frozenset[str], common: frozenset[int] = frozenset(), lift: int = HINTED) -> list[str]:
    """Text of the blocks that stay, in page order; ``common`` are hashes of lines, with those of articles inverted."""
    return [text for text, m in lines(list(walk(page, lift)), low) if not common or (~hashed(text) if m else hashed(text)) not in common]


def counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, kind int, value, n long, main boolean): on how many pages each feature of a path is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (host, *f)
                for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for f in features(page)
            ]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "path", "kind", "value", "main"])

    nodes = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInArrow(
        run, "host string, path string, kind int, value long, main boolean"
    )
    return nodes.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"), F.min("main").alias("main"))


def style_tree(seen: DataFrame) -> DataFrame:
    """The merged trees from ``counts``: (host, path, pages long, presentation, content, importance double, main boolean)."""
    log = F.col("n") * F.ln("n")
    spread = seen.where(F.col("kind") < LINE).groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(log).alias("weight"), F.min("main").alias("main"))
    entropy = F.when(F.col("pages") < 2, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), (F.ln("pages") - F.col("weight") / F.col("pages")) / F.ln("pages"))
    )
    return (
        spread.withColumn("h", entropy)
        .groupBy("host", "path")
        .agg(
            F.max("pages").alias("pages"),
            F.max(F.when(F.col("kind") == SHAPE, F.col("h"))).alias("presentation"),
            F.max(F.when(F.col("kind") == SAID, F.col("h"))).alias("content"),
            F.min("main").alias("main"),
        )
        .withColumn("importance", F.greatest("presentation", "content"))
    )


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def low_branches(tree: DataFrame, seen: DataFrame, low: float = LOW_IMPORTANCE, pages: int = MIN_PAGES) -> DataFrame:
    """(host, paths array): branches in which no node is important, by host, from the trees and their ``counts``.

    What a deeper segment holds counts for each path that it or a segment above it hangs on.
    """
    parts = F.split("path", "/")
    facts = ["importance", "pages", "main"]
    deep = tree.where(F.col("path").startswith("#")).withColumn("value", F.substring_index(F.substr("path", F.lit(2)), "/", 1).cast("long"))
    deep = deep.groupBy("host", "value").agg(*[F.max(c).alias(c) for c in facts])
    hung = seen.where(F.col("kind") == BELOW).select("host", "path", "value").join(deep, ["host", "value"])
    tree = tree.select("host", "path", *facts).union(hung.select("host", "path", *facts))
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return (
        tree.where(F.size(parts) >= 2)
        .select("host", F.explode(above).alias("branch"), "path", "importance", "pages", "main")
        .groupBy("host", "branch")
        .agg(F.max("importance").alias("importance"), F.max("pages").alias("pages"), F.max("main").alias("main"))
        .where((F.col("importance") < low) & (F.col("pages") >= pages) & ~F.col("main"))
        .where(~F.col("branch").isin("/html", "/html/body"))
        .groupBy("host")
        .agg(F.collect_list("branch").alias("paths"))
    )


def common_lines(seen: DataFrame, low: float = LOW_IMPORTANCE, pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines array): hashes of the lines that are the same on page after page, by host; those of articles inverted."""
    of = seen.where((F.col("kind") == SHAPE) & F.col("path").isin(ARTICLES, OUTSIDE)).groupBy("host", "path").agg(F.sum("n").alias("pages"))
    return (
        seen.where((F.col("kind") == LINE) & (F.col("n") >= pages))
        .join(of, ["host", "path"])
        .where(F.ln("pages") - F.ln("n") < low * F.ln("pages"))
        .groupBy("host")
        .agg(F.collect_list(F.when(F.col("path") == ARTICLES, F.bitwise_not("value")).otherwise(F.col("value"))).alias("lines"))
    )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: (id_col, url_col, text string, n_chars long)."""
    seen = stored(counts(pages, url_col, html_col), "page-features")
    low = stored(low_branches(style_tree(seen), seen).join(common_lines(seen), "host", "full"), "style-tree")
    rows = pages.select(
        F.col(id_col), F.col(url_col), F.coalesce(F.col(html_col), F.lit("")).alias("_html"), host_of(F.col(url_col)).alias("_host")
    )
    rows = rows.join(sized(low.withColumnsRenamed({"host": "_host", "paths": "_low", "lines": "_common"}), low.count(), 20_000), "_host", "left").select(
        id_col, url_col, "_html", "_low", "_common"
    )
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, paths, same in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                found = blocks(page, frozenset(paths or ()), frozenset(same or ()))
                if not found and (paths or same):
                    found = blocks(page, frozenset())
                if not found and page:
                    found = blocks(page, frozenset(), lift=NAMED)
                texts.append("\n".join(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_col, url_col, "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
