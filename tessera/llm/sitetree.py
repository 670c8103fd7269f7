"""Main-text extraction from web pages with a site style tree.

Every page becomes a tree of elements (a forgiving parser, linear in the page's length, closes what HTML leaves open). The
trees of one host are merged: an element node is known by its path, where each step names the style (the sequence of child
labels) that its parent had and its place in it. A label is the tag and the kind that the element's tag, role, class or id
give it: marked (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts), article (`article`,
`main`, role=main, itemprop=articleBody), bearing an article, or plain. Where a page marks an article, what doesn't bear it
counts as marked. For each element node of a host, over the m pages that have it and OWN imagined pages that share nothing
(so that few pages prove little, and a single page nothing):

- presentation importance: the entropy of its styles over all m + OWN pages, to the base of their number;
- content importance of its own text: 1 less the mean, over its distinct features (text pieces by hash), of log(pages that
  have the feature) / log(m + OWN). Pieces over LONG characters count once for each page: templates are short, and copies
  of an article on a host aren't templates;
- composite importance: 0 if marked; of others without elements the content importance; else GAMMA of the way between the
  presentation importance (if it has text, the content importance) and the mean of its unmarked children's, by pages.

Branches of a composite importance below LOW are removed from each page, inside articles too; page, body, article and what
bears one are never removed as such. What remains is cut into blocks: character references decoded, white space turned
into one space, trimmed, joined by line feeds. A page of which nothing would be left keeps all that is unmarked.

The counts are sums by (host, node) and (host, node, feature). Importance is known within GAMMA ** rounds after so many
rounds up the tree, and rounds go on until every node is known to be above or below LOW. The topmost low nodes are sent to
all tasks if they are FEW at most (counted before); else each page's nodes are joined with them by (host, node) under SALTS
keys, since one host may hold a third of all pages.

Null html counts as empty and gives an empty text; rows with a null url share the host ''; repeated rows are each
returned; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, slices

GAMMA, LOW, OWN, LONG, SALTS, FEW = 0.5, 0.3, 20, 200, 16, 50_000
#: Rounds after which what is still undecided, within 2 ** -ROUNDS of LOW, counts as high.
ROUNDS = 30

#: Elements of the HTML standard by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea iframe noembed noframes object embed svg canvas math audio video map dialog menu input label fieldset legend datalist".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the first kind ends an open element of the second.
CLOSES_P = BLOCKS - frozenset("html body caption tbody td tfoot th thead tr".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
ENDED = frozenset({"p"}.union(*ENDS.values()))
BARRIERS = frozenset("table ul ol dl div article section main nav aside body html select".split())
#: Names that mark what isn't the article, whole words of class and id.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login footer header masthead menu nav navbar navigation sidebar sidebars aside widget widgets "
    "related recommended recommendations share sharing social toolbar pagination pager paging search searchbox skip skiplink hidden copyright legal disclaimer taboola outbrain".split()
)
NOT_ARTICLES = frozenset("ad ads advert advertisement comment comments disqus reply replies promo sponsored related recommended widget teaser".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar form".split())

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z0-9]+")


class Node:
    """scope: the open elements that a later start tag may end, up to the next barrier."""

    __slots__ = ("attributes", "children", "key", "kind", "parent", "scope", "tag")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.parent, self.key, self.kind = tag, attributes, parent, 0, ""
        self.children: list[Node | str] = []
        self.scope: dict[str, Node] = parent.scope if parent else {}
        if tag in ENDED:
            self.scope = {**self.scope, tag: self}
        elif tag in BARRIERS:
            self.scope = {}


def _tag_end(text: str, at: int, failed: set[int]) -> int:
    """Where the tag's > stands outside quotes, or -1. failed: places outside quotes from which none is found."""
    passed = []
    while at not in failed:
        passed.append(at)
        stop = _STOP.search(text, at)
        if stop is None:
            break
        if stop[0] == ">":
            return stop.start()
        close = text.find(stop[0], stop.end())
        if close < 0:
            break
        at = close + 1
    failed.update(passed)
    return -1


def parse(text: str) -> Node:
    """The page's tree; text pieces are raw strings (references not yet decoded) between nodes. Linear in the text."""
    root = at = Node("#root")
    lowered = None
    opened: Counter = Counter()  # open elements by tag
    failed: set[int] = set()
    position, done, end, last = 0, 0, len(text), text.rfind(">")

    def close(to: Node) -> None:
        """Ends all open elements up to `to`, which included."""
        nonlocal at
        while at is not to:
            opened[at.tag] -= 1
            at = at.parent
        opened[to.tag] -= 1
        at = to.parent

    while True:
        lt = text.find("<", position)
        if lt < 0:
            break
        first = text[lt + 1 : lt + 2]
        if first and first in "!?":
            stop, to = ("-->", 3) if text.startswith("<!--", lt) else ("]]>", 3) if text.startswith("<![CDATA[", lt) else (">", 1)
            name, gt = None, text.find(stop, lt + 4 if to == 3 else lt)
            gt = end if gt < 0 else gt + to
        else:
            name = _NAME.match(text, lt + 1) if lt < last else None
            if name is None:  # a plain sign
                position = lt + 1
                continue
            gt = _tag_end(text, name.end(), failed)
            if gt < 0:  # quotes without an end: up to the next >
                name, gt = None, text.find(">", lt)
            gt += 1
        if lt > done:
            at.children.append(text[done:lt])
        position = done = gt
        if name is None:
            continue
        own, tag = text[name.end() : gt - 1], name[0].lower()
        if tag[0] == "/":
            tag = tag[1:]
            if opened[tag] > 0:
                node = at
                while node.tag != tag:
                    node = node.parent
                close(node)
            elif tag == "br":
                at.children.append(Node("br", "", at))
            continue
        for ended in (("p",) if tag in CLOSES_P else ()) + ENDS.get(tag, ()):
            if ended in at.scope:
                close(at.scope[ended])
        node = Node(tag, own, at)
        at.children.append(node)
        if tag in VOID or own.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            if lowered is None:
                lowered = text.lower() if len(text.lower()) == len(text) else re.sub("[A-Z]", lambda x: x[0].lower(), text)
            over = lowered.find(f"</{tag}", position)
            over = end if over < 0 else over
            node.children.append(text[position:over])
            gt = text.find(">", over)
            position = done = end if gt < 0 else gt + 1
            continue
        opened[tag] += 1
        at = node
    if done < end:
        at.children.append(text[done:])
    return root


def attributes(node: Node) -> dict[str, str]:
    if not node.attributes.strip():
        return {}
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(node.attributes)}


def marked(node: Node, inside: bool) -> bool:
    """Whether the element's tag, role, class or id says that it isn't article text."""
    if node.tag in DROPPED:
        return True
    if node.tag == "header":  # an article's own header holds its headline
        return not inside
    own = attributes(node)
    if not own:
        return False
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or _SPACE.sub("", own.get("style", "").lower()).find("display:none") >= 0:
        return True
    if own.get("role", "").lower() in ROLES:
        return True
    if node.tag in ("body", "html", "main"):
        return False
    names = NOT_ARTICLES if node.tag == "article" else NAMES  # an article may be a comment or an advert
    return any(p in names for p in _PART.findall(f"{own.get('class', '')} {own.get('id', '')}".lower()))


def is_article(node: Node) -> bool:
    if node.tag in ("article", "main"):
        return True
    own = attributes(node)
    return own.get("role", "").lower() == "main" or own.get("itemprop", "").lower() == "articlebody"


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def label(root: Node) -> None:
    """Sets the kind of each element that isn't below a marked one: m, a, b or none."""
    articles, outside, todo = [], [], [(c, False) for c in root.children if isinstance(c, Node)]
    while todo:
        node, inside = todo.pop()
        if marked(node, inside):
            node.kind = "m"
            continue
        if not inside:
            outside.append(node)
            if is_article(node):
                node.kind, inside = "a", True
                articles.append(node)
        todo += [(c, inside) for c in node.children if isinstance(c, Node)]
    for node in articles:
        up = node.parent
        while up is not root and up.kind != "b":
            up.kind = "b"
            up = up.parent
    if articles:
        root.kind = "b"
        for node in outside:
            if not node.kind:
                node.kind = "m"


def number(root: Node) -> list[tuple[Node, int, int, list[int]]]:
    """(node, parent's key, style, features) of each element that isn't below a marked one, keys and kinds set. Iterative:
    pages nest deeply."""
    label(root)
    out, todo = [], [(root, 0)]
    root.key = _hash("root")
    while todo:
        node, up = todo.pop()
        if node.kind == "m":
            out.append((node, up, 0, []))
            continue
        elements = [c for c in node.children if isinstance(c, Node)]
        style = _hash(*(f"{c.tag}:{c.kind}" for c in elements))
        pieces = [_SPACE.sub(" ", c.lower()).strip() for c in node.children if isinstance(c, str) and not c.isspace()]
        out.append((node, up, style, [_hash(x) if len(x) <= LONG else 0 for x in pieces]))
        for i, c in enumerate(elements):
            c.key = _hash(node.key, style, i)
            todo.append((c, node.key))
    return out


def removable(node: Node) -> bool:
    return node.kind not in ("a", "b") and node.tag not in ("#root", "html", "body")


def blocks(root: Node, low: Callable[[Node], bool]) -> list[str]:
    """The blocks of what is left without low branches."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(text)

    stack: list = [root]
    while stack:
        node = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            parts.append(node)
        elif low(node):
            if node.tag in BLOCKS:
                flush()
        elif node.tag == "br":
            parts.append(" ")
        else:
            if node.tag in BLOCKS or node.kind in ("a", "b"):
                flush()
                stack.append(None)
            stack.extend(c for c in reversed(node.children) if node.kind != "b" or isinstance(c, Node))
    flush()
    return out


def main_text(page: str | None, noise: set[int] | None = None) -> str:
    """The page's text without the nodes of noise; without a tree (None), without what is marked."""
    root = parse(page or "")
    number(root)
    unmarked = lambda: blocks(root, lambda x: x.kind == "m")
    return "\n".join(unmarked() if noise is None else blocks(root, lambda x: x.key in noise) or unmarked())


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: What a row counts: a marked node, one that may go or one that may not, or a feature.
MARKED, PLAIN, FIRM, FEATURE = range(4)


def counted(pages: DataFrame) -> DataFrame:
    """(host, node, up, what, of, n): pages by node and style, and by node and feature. pages: columns host, html."""
    schema = "host string, node long, up long, what byte, of long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 8 << 20):
                counts: Counter = Counter()
                for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for node, up, style, features in number(parse(page or "")):
                        counts[host, node.key, up, MARKED if node.kind == "m" else PLAIN if removable(node) else FIRM, style] += 1
                        for f in set(features):
                            counts[host, node.key, up, FEATURE, f] += 1
                columns = list(zip(*counts, strict=True)) or [[]] * 5
                types = (pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(counts.values(), pa.int64())], names=[x.split()[0] for x in schema.split(", ")])

    return pages.select("host", "html").mapInArrow(run, schema).groupBy("host", "node", "up", "what", "of").agg(F.sum("n").alias("n"))


def noise(pages: DataFrame) -> DataFrame:
    """(host, node): the topmost branches of low composite importance. pages: columns host, html."""
    x, styled = F.col("n").cast("double"), F.col("what") < FEATURE
    # The feature 0 stands for long pieces, each unlike any other.
    each = counted(pages).groupBy("host", "node").agg(
        F.first("up").alias("up"),
        F.min("what").alias("what"),
        F.sum(F.when(styled, F.col("n"))).alias("m"),
        F.sum(F.when(styled, x * F.log(x))).alias("mlogm"),
        F.sum(F.when(~styled, F.when(F.col("of") == 0, F.col("n")).otherwise(1))).alias("features"),
        F.sum(F.when(~styled & (F.col("of") != 0), F.log(x))).alias("logs"),
    )
    total = (F.col("m") + OWN).cast("double")
    presentation = 1 - F.col("mlogm") / total / F.log(total)
    content = 1 - F.coalesce("logs", F.lit(0.0)) / F.col("features") / F.log(total)
    state = cut(each.select("host", "node", "up", "what", "m", presentation.alias("presentation"), content.alias("content")))
    # Bounds of the composite importance, from the leaves up. A round halves what is unknown of a node with children.
    open_ = state.where(F.col("what") != MARKED)
    parents = open_.select("host", F.col("up").alias("node")).distinct().withColumn("inner", F.lit(True))
    leaf = F.coalesce("content", F.lit(0.0))
    known = cut(open_.join(parents, ["host", "node"], "left").withColumn("inner", F.coalesce("inner", F.lit(False))).select("*", F.when(F.col("inner"), 0.0).otherwise(leaf).alias("least"), F.when(F.col("inner"), 1.0).otherwise(leaf).alias("most")))
    for _ in range(ROUNDS):
        if known.where((F.col("least") < LOW) & (F.col("most") >= LOW) & (F.col("what") == PLAIN)).isEmpty():
            break
        mean = lambda c: F.sum(F.col("m") * F.col(c)) / F.sum("m")
        below = known.groupBy("host", "up").agg(mean("least").alias("a"), mean("most").alias("b")).withColumnRenamed("up", "node")
        mixed = lambda c: (1 - GAMMA) * F.coalesce("content", "presentation") + GAMMA * F.col(c)
        known = cut(
            known.join(below, ["host", "node"], "left").select(
                "host", "node", "up", "what", "m", "presentation", "content", "inner", F.when(F.col("inner"), mixed("a")).otherwise(F.col("least")).alias("least"), F.when(F.col("inner"), mixed("b")).otherwise(F.col("most")).alias("most")
            )
        )
    low = known.where((F.col("most") < LOW) & (F.col("what") == PLAIN)).select("host", "node", "up")
    low = cut(low.unionByName(state.where(F.col("what") == MARKED).select("host", "node", "up")))
    return low.join(low.select("host", F.col("node").alias("up")), ["host", "up"], "left_anti").select("host", "node")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """(page_id, url, text) for every row of pages."""
    body = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), _host(F.col(f"`{url}`")).alias("host"))
    low = cut(noise(body))
    schema = T.StructType([T.StructField(page_id, pages.schema[page_id].dataType), T.StructField(url, T.StringType()), T.StructField(text, T.StringType(), False)])

    def texts(batch: pa.RecordBatch, noises: Iterable[set[int]]) -> pa.RecordBatch:
        out = [main_text(p, x) for p, x in zip(batch.column(2).to_pylist(), noises, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[page_id, url, text])

    if low.count() <= FEW:  # then no page moves
        of_host: dict[str, set[int]] = {}
        for r in low.collect():
            of_host.setdefault(r.host, set()).add(r.node)
        sent = pages.sparkSession.sparkContext.broadcast(of_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "html", 8 << 20):
                    yield texts(batch, [sent.value.get(h, set()) for h in batch.column(3).to_pylist()])

        return body.select("id", "url", "html", "host").mapInArrow(run, schema)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 8 << 20):
                found = [(h, r, n.key) for h, r, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for n, *_ in number(parse(page or ""))]
                columns = list(zip(*found, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "row", "node"])

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 8 << 20):
                yield texts(batch, [set(x or ()) for x in batch.column(3).to_pylist()])

    row = F.xxhash64("id", "url", "html")  # equal rows share their nodes
    asked = body.select("host", row.alias("row"), "html").mapInArrow(keys, "host string, row long, node long").distinct()
    asked = asked.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    spread = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = asked.join(spread, ["host", "node", "salt"]).groupBy("row").agg(F.collect_set("node").alias("nodes"))
    return body.withColumn("row", row).join(found, "row", "left").select("id", "url", "html", "nodes").mapInArrow(run_joined, schema)
