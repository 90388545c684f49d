"""Main text of web pages with a site style tree.

The pages of a host are merged into one style tree: a node is an element path (tags with classes, as
seen from the body), its styles are the child sequences and its contents the text blocks found there.
Over the m pages that have a node, a content found on c of them has entropy log_m(c); a node whose
contents return on page after page has importance near 0, one with contents of their own near 1. The
entropy of its parent's child sequences (presentation) counts with weight ``GAMMA``. A content on all
pages of its node, or on 3 or more and a share of ``SHARE``, has importance 0 whatever the presentation.
A node on a single page has importance 1; pages of a host with the same text outside furniture count once. Menus,
headers, footers, sidebars, notices, adverts, forms, comments (by element, ARIA role or class) have a
fixed importance of 0. A class or id counts if one of its tokens consists of words for furniture and
its owner only, and neither for a main part, nor for an element of the layout that holds the page's
only one; inside a main part only words for what is not the article's own. A page with a main part (``article``, ``main`` or an article body) consists of it.
Of what is left the branches with an importance below ``THRESHOLD`` are removed, in a main part only if
they return on ``MAIN_PAGES`` pages or more; table cells, definitions and code of a main part stay.

Character references are decoded, white space inside a block becomes one space, blocks are joined by
line feeds in page order. A null or empty page, or one without text, gives an empty string. Broken
markup is read as browsers do: open elements end with the page, unfinished tags are dropped. Repeated
rows and pages without url (one common host "") are pages of their own. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restock.llm.common import batch
from restock.session import cut_lineage

GAMMA = 0.1
THRESHOLD = 0.1
SHARE = 0.5
SALTS = 32
MAIN_PAGES = 3

# fixed values: element roles
DROPPED = frozenset("head script style noscript template svg math iframe object select textarea button form".split())
NOISE = frozenset("nav footer aside dialog menu".split()) | DROPPED
MAIN = frozenset("article main".split())
VALUES = frozenset("td th dt dd pre".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "tr ul title head".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table body article main section div nav aside footer header form blockquote td th".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense alert alerts announcement announcements banner banners breadcrumb "
    "breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer gdpr header masthead "
    "menu menubar modal nav navbar navigation newsletter notice notices notification notifications pager pagination paywall popup promo "
    "promotion recommended related replies reply respond responses share sharing sidebar sidebars sidenav signup skip social sponsor "
    "sponsored submenu subnav subscribe subscription toolbar topbar widget widgets".split()
)
# words that tell whose or which furniture it is: a class token of a noise word and these is noise
OWNERS = frozenset(
    "area article bar blog body bottom box button buttons container content desktop entry form global group icon icons inner item items left "
    "link links list main mobile outer page post posts primary right row secondary section site slot sub text title top user wp wrap wrapper".split()
)
# in a main part these words name the article's own header, boxes and subjects
OWN_WORDS = frozenset(
    "alert alerts announcement announcements banner banners copyright disclaimer discussion header masthead menu menubar modal notice notices "
    "notification notifications popup promo promotion recommended response responses toolbar topbar widget widgets".split()
)
# what has articles of its own: a main part inside it is none of the page
ARTICLES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense comment comments commentlist discussion disqus promo promotion recommended "
    "related replies reply respond response responses sponsor sponsored".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


class Node:
    __slots__ = ("tag", "name", "noise", "layout", "main", "children", "path")

    def __init__(self, tag: str, name: str, noise: bool, main: bool, path: str, layout: bool = False):
        self.tag, self.name, self.noise, self.main, self.path, self.layout = tag, name, noise, main, path, layout
        self.children: list[str] = []


class Block:
    """A text block: where it stands, its text, the node around it.

    ``layout``: it is noise only by a class word for a part of the layout, such as sidebar.
    """

    __slots__ = ("path", "text", "noise", "main", "parent", "layout")

    def __init__(self, path: str, text: str, noise: bool, main: bool, parent: Node, layout: bool = False):
        self.path, self.text, self.noise, self.main, self.parent, self.layout = path, text, noise, main, parent, layout


def noise_words(value: str) -> set[str]:
    """The noise words of class tokens that consist of such words and owners' words."""
    found = set()
    for token in value.split():
        words = {w.lower() for w in _WORDS.findall(token) if len(w) > 1}
        if words <= NOISE_WORDS | OWNERS:
            found |= words & NOISE_WORDS
    return found


def _roles(tag: str, attrs: str) -> tuple[str, bool, bool, set[str]]:
    """Name with classes, noise by role, main part by attributes, noise words of class and id."""
    name, noise, main, words = tag, False, False, set()
    if "=" not in attrs:
        return name, noise, main, words
    for kind, a, b, c in _ATTR.findall(attrs):
        value = a or b or c
        kind = kind.lower()
        if kind == "role":
            noise |= value.lower() in NOISE_ROLES
            main |= value.lower() == "main"
        elif kind == "itemprop":
            main |= value.lower() == "articlebody"
        else:
            if kind == "class":
                name = f"{tag}.{'.'.join(sorted(value.split()))}"
            words |= noise_words(value)
    if tag in ("body", "html"):
        return name, False, main, set()
    return name, noise, main, set() if main or tag == "main" else words


def parse(page: str) -> list[Block]:
    """The text blocks of a page in page order."""
    root = Node("", "", False, False, "")
    stack = [root]
    blocks: list[Block] = []
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(top.path, text, top.noise, top.main, stack[-2] if len(stack) > 1 else root, top.layout))

    def close(tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    flush()
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        name, noise, main, words = _roles(tag, m["attrs"])
        if stack[-1].main or tag == "article":
            words = words - OWN_WORDS if block else set()
            if tag == "article":
                words &= ARTICLES
        if not block and not (noise or words or main or tag in NOISE):
            continue  # an inline element belongs to the block around it
        flush()
        if block:
            close({"p"}, HOLDERS)
            if tag in CLOSED_BY:
                close(CLOSED_BY[tag], HOLDERS - {"td", "th"} if tag == "tr" else HOLDERS)
        top = stack[-1]
        header = tag == "header" and not top.main
        top.children.append(name)
        # an advert's or a comment's own article is no main part
        hard = top.noise and not top.layout or noise or tag in NOISE or header or bool(words & ARTICLES)
        noise = hard or top.noise or bool(words)
        own = main or tag in MAIN
        if words and (top.main or own):
            hard = True
        layout = noise and not hard
        stack.append(Node(tag, name, noise, top.main or own, f"{top.path}>{name}", layout))
        if m["attrs"].endswith("/") and not block:
            stack.pop()
    if at < len(page):
        pieces.append(html.unescape(page[at:]))
    flush()
    if not any(b.main and not b.noise for b in blocks):
        for b in blocks:  # an element that holds the page's main part is no furniture
            if b.main and b.layout:
                b.noise = False
    return blocks


def open_blocks(blocks: list[Block]) -> tuple[list[int], list[int]]:
    """The blocks whose importance the style tree decides: of a page without a main part, and of a main part."""
    inner = [k for k, b in enumerate(blocks) if b.main and not b.noise]
    if not inner:
        return [k for k, b in enumerate(blocks) if not b.noise], []
    return [], [k for k in inner if not VALUES & {n.partition(".")[0] for n in blocks[k].path.split(">")}]


def main_text(blocks: list[Block], removed: set[int]) -> str:
    kept = [k for k, b in enumerate(blocks) if b.main and not b.noise] or open_blocks(blocks)[0]
    return "\n".join(blocks[k].text for k in kept if k not in removed)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


_NODES = pa.schema(
    [(n, pa.int64()) for n in ("page", "print", "path", "content", "parent", "style")]
    + [("first", pa.int32()), ("place", pa.list_(pa.int32())), ("inner", pa.list_(pa.int32()))]
)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per page, path and distinct content; ``place`` and ``inner`` list the blocks that the tree decides.

    ``print`` is the page's text outside furniture: pages with the same one are one page of the tree.
    """
    schema = pa.schema([("host", pa.string()), *_NODES])
    for b in batches:
        rows = []
        for page, host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            blocks = parse(source.as_py() or "")
            outer, inner = map(set, open_blocks(blocks))
            print_ = _hash("\n".join(f"{block.path} {block.text}" for block in blocks if not block.noise))
            found: dict[tuple[str, str], list[int]] = {}
            for k, block in enumerate(blocks):
                found.setdefault((block.path, block.text), []).append(k)
            seen = set()
            for (path, text), places in found.items():
                parent = blocks[places[0]].parent
                first = path not in seen
                seen.add(path)
                hashes = (_hash(path), _hash(text), _hash(parent.path), _hash(" ".join(parent.children)))
                open_ = [[k for k in places if k in decided] for decided in (outer, inner)]
                rows.append((host, page, print_, *hashes, int(first), *open_))
        yield batch(schema, zip(*rows)) if rows else batch(schema, [[]] * len(schema))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _entropy(count: Column, pages: Column) -> Column:
    return F.when(pages > 1, F.log(count.cast("double")) / F.log(pages.cast("double"))).otherwise(0.0)


def style_tree(nodes: DataFrame) -> DataFrame:
    """(host, path, content, importance, c) of every content node of every host; ``c`` counts its pages.

    Counts are added up per task before they are shuffled; joins on a node are salted, since one host
    may have most of the pages.
    """
    salt = lambda c: F.pmod(c, F.lit(SALTS)).alias("salt")
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    contents = nodes.groupBy("host", "path", "content").agg(F.count("*").alias("c"), F.min("parent").alias("parent"))
    pages = nodes.groupBy("host", "path").agg(F.sum("first").alias("m"))
    styles = nodes.select("host", "parent", "style", "page").distinct().groupBy("host", "parent", "style").agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("total")
    totals = styles.groupBy("host", "parent").agg(F.sum("n").alias("total"))
    presentation = (
        styles.join(totals, ["host", "parent"])
        .groupBy("host", "parent")
        .agg((F.sum(-share * F.log(share)) / F.log(F.greatest(F.max("total"), F.lit(2)).cast("double"))).alias("presentation"))
    )
    recurs = (F.col("c") == F.col("m")) | (F.col("c") >= F.greatest(F.lit(3), SHARE * F.col("m")))
    return (
        contents.withColumn("salt", F.pmod("content", F.lit(SALTS)))
        .join(pages.select("*", spread), ["host", "path", "salt"])
        .join(presentation.select("*", spread), ["host", "parent", "salt"])
        .select(
            "host", "path", "content",
            F.when(F.col("m") <= 1, F.lit(1.0)).when(recurs, F.lit(0.0)).otherwise(
                (1 - GAMMA) * (1 - _entropy(F.col("c"), F.col("m"))) + GAMMA * F.col("presentation")
            ).alias("importance"),
            "c",
        )
    )


def extract(
    df: DataFrame, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    source = df.select(
        F.monotonically_increasing_id().alias("page"),
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
    )
    ddl = "host string, page long, print long, path long, content long, parent long, style long, first int, place array<int>, inner array<int>"
    nodes = cut_lineage(source.select("page", host_of(F.col("url")).alias("host"), "html").mapInArrow(_nodes, ddl))
    # copies of a page are one page of the tree
    tree = style_tree(cut_lineage(nodes.drop("page", "place", "inner").withColumnRenamed("print", "page").distinct()))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    weak = tree.where(F.col("importance") < threshold).select("host", "path", "content", "c", spread)
    removed = cut_lineage(
        nodes.where((F.size("place") > 0) | (F.size("inner") > 0))
        .withColumn("salt", F.pmod("page", F.lit(SALTS)))
        .join(weak, ["host", "path", "content", "salt"])
        .withColumn("place", F.when(F.col("c") >= MAIN_PAGES, F.concat("place", "inner")).otherwise(F.col("place")))
        .groupBy("page")
        .agg(F.flatten(F.collect_list("place")).alias("removed"))
    )
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b.column(3).to_pylist()
            texts = [main_text(parse(h.as_py() or ""), set(g or ())) for h, g in zip(b.column(2), gone)]
            yield batch(out, (b.column(0), b.column(1).cast(pa.string()), texts, [len(t) for t in texts]))

    return (
        source.join(removed, "page", "left")
        .select(F.col("page_id").cast("long"), "url", "html", "removed")
        .mapInArrow(work, "page_id long, url string, text string, n_chars long")
    )
