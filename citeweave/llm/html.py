"""Main text of web pages by consensus paths of a host.

Every container of a page is scored by the text it holds outside links and furniture. Each page gives its score shares
to the generalised paths (tags and classes, digits as `0`) of its containers; the paths of a host are summed over its
pages, and each page is extracted again from the path with most support that it has. A path is known by a 64-bit hash of
its last step and of the path before, so a deeply nested page costs no more than a flat one.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import materialize

# Kinds of elements in HTML, and names that furniture goes by.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe object title head".split())
RAW_TO_THE_END = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
FURNITURE = frozenset("nav footer aside button select menu label option canvas audio video".split())
CONTAINER = frozenset("article body div main section td blockquote".split())
_NAMED = (
    r"ad|ads|advert\w*|banner|breadcrumbs?|comments?|comment-?list|consent|cookies?\w*|disqus|footer|gdpr|masthead|menu|modal|"
    r"nav|navbar|navigation|newsletter|notice|notices|notification|pagination|popup|promo\w*|recommend\w*|related|replies|responses|respond|share|sharing|"
    r"sidebar|side-?bar|site-?header|skip|social|sponsor\w*|subscribe|toolbar|widgets?"
)
NAMES = re.compile(rf"(?:^|[-_\s])(?:{_NAMED})(?:$|[-_\s\d])", re.I)
#: A class that says nothing but that: a name, and what kind of box it is.
PURE = re.compile(rf"(?:{_NAMED})(?:[-_](?:area|bar|box|container|inner|left|list|notice|posts|right|section|thread|wrap|wrapper|[0-9]+))*", re.I)
ROLES = frozenset("alert banner complementary contentinfo menu menubar navigation search".split())

#: Elements that end where the next of their kind begins, and the element that this reaches up to.
KINDS = {"li": "li", "dt": "term", "dd": "term", "tr": "row", "td": "cell", "th": "cell", "option": "option"}
REACH = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("term",), "table": ("row", "cell"), "tr": ("cell",), "select": ("option",)}
FORMS, MAIN = frozenset(("form", "dialog")), frozenset(("article", "main"))

_NAME = re.compile(r"</?[a-zA-Z]")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']++))")
_SENTENCES = re.compile(r"[.!?…,;](?:\s|$)")


class Node:
    __slots__ = ("tag", "path", "parent", "furniture", "named", "label", "parts", "score", "headline", "mass", "main")

    def __init__(self, tag: str, path: int, parent: Node | None, furniture: bool = False, named: bool = False, label: str = ""):
        self.tag, self.path, self.parent, self.furniture, self.named, self.label = tag, path, parent, furniture, named, label
        self.parts: list[str | Node] = []
        self.score, self.headline = 0.0, False
        self.mass, self.main = 0, tag in MAIN or tag == "h1"


def tokens(page: str) -> Iterator[tuple[str, str | None, str]]:
    """(text, None, "") and (tag or /tag, attributes, name) of a page, comments and raw elements left out.

    The cursor goes forward only: what is looked for to the end of the page in vain is not looked for again, so time is in
    proportion to the page. A quote that hides every later `>` is no quote.
    """
    at, quotes, unclosed = 0, True, set()
    while at < len(page):
        start = page.find("<", at)
        if start != at:
            yield page[at : start if start >= 0 else len(page)], None, ""
            if start < 0:
                return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            if end < 0:
                return
            at = end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            if end < 0:
                yield page[start:], None, ""
                return
            at = end + 1
            continue
        if not _NAME.match(page, start):
            yield "<", None, ""
            at = start + 1
            continue
        m = (_TAG if quotes else _PLAIN_TAG).match(page, start)
        if m is None:
            if page.find(">", start) < 0:
                yield page[start:], None, ""
                return
            quotes = False
            m = _PLAIN_TAG.match(page, start)
        at, tag = m.end(), m[2].lower()
        if tag in RAW:
            if m[1]:
                continue
            end = None if tag in unclosed else _RAW_END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in RAW_TO_THE_END:
                return
            else:
                unclosed.add(tag)  # its content is taken for the page's
            continue
        yield m[1] + tag, m[3], tag


def _open(tag: str, raw: str, parent: Node) -> Node:
    names = {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(raw)} if "=" in raw else {}
    label = f"{names.get('class', '')} {names.get('id', '')}".strip()
    role = names.get("role", "").lower()
    furniture = tag in FURNITURE or role in ROLES or "hidden" in raw.split()
    named = tag in FORMS or role in FORMS or bool(label and tag not in ("body", "html") and NAMES.search(label))
    classes = ".".join(sorted(re.sub(r"\d+", "0", names.get("class", "")).split()))
    return Node(tag, xxhash.xxh64_intdigest(f"{tag}.{classes}", parent.path), parent, furniture, named, label)


def parse(page: str) -> Node:
    """A tree of the page's elements and texts; unclosed paragraphs, list items, rows and cells end where HTML ends them."""
    root = node = Node("", 0, None)
    nodes, n_open, paragraph = [root], {}, None
    last: dict[str, list[Node | None]] = {k: [] for k in set(KINDS.values())}  # open elements of a kind, None where one reaches no further

    def end(at: Node) -> Node:
        """Ends all open elements up to `at`, which is one of them."""
        nonlocal paragraph
        here = node
        while True:
            n_open[here.tag] -= 1
            for kind in REACH.get(here.tag, ()):
                last[kind].pop()
            if here.tag in KINDS:
                last[KINDS[here.tag]].pop()
            if here is paragraph:
                paragraph = None
            if here is at:
                return here.parent
            here = here.parent

    for text, attributes, tag in tokens(page):
        if attributes is None:
            node.parts.append(html.unescape(text))
            continue
        if text[0] == "/":
            if n_open.get(tag):  # an element that is open ends, and all inside it
                while node.tag != tag:
                    node = end(node)
                node = end(node)
            continue
        if tag in VOID:
            if tag in BLOCK:
                node.parts.append("\n")
            continue
        if paragraph is not None and tag in BLOCK:
            node = end(paragraph)
        kind = KINDS.get(tag)
        if kind and last[kind] and last[kind][-1] is not None:
            node = end(last[kind][-1])
        child = _open(tag, attributes, node)
        nodes.append(child)
        node.parts.append(child)
        if not (attributes.rstrip().endswith("/") and tag not in BLOCK):
            node = child
            n_open[tag] = n_open.get(tag, 0) + 1
            if kind:
                last[kind].append(child)
            for reached in REACH.get(tag, ()):
                last[reached].append(None)
            if tag == "p":
                paragraph = child
    _settle(root, nodes)
    return root


def _settle(root: Node, nodes: list[Node]) -> None:
    """Decides which named elements are furniture: all but those that hold the page's text.

    What stands outside links and furniture is weighed. As long as next to nothing stands outside the named elements and
    one of them holds most of the page, that one is no furniture, and what is named inside it is judged in turn. Elements
    that hold a headline or are an article themselves are believed sooner, those whose classes are all names of furniture later.
    """
    linked = {}
    for x in nodes:  # parents first
        linked[x] = x.parent is not None and (x.tag == "a" or linked[x.parent])
    for x in reversed(nodes):
        if not linked[x]:
            x.mass += sum(len(t) - t.count(" ") - t.count("\n") for t in x.parts if isinstance(t, str))
        if x.parent is not None and not x.furniture:
            x.parent.mass += x.mass
            x.parent.main |= x.main
    total = root.mass

    def outermost(top: Node) -> list[Node]:
        found, stack = [], [top]
        while stack:
            for x in stack.pop().parts:
                if isinstance(x, Node) and not x.furniture:
                    (found if x.named else stack).append(x)
        return found

    heap, order = [], 0
    left = total

    def add(top: Node) -> None:
        nonlocal left, order
        for x in outermost(top):
            left -= x.mass
            order += 1
            heapq.heappush(heap, (-x.mass, order, x))

    add(root)
    kept = set()
    while heap and total:
        mass, _, x = heapq.heappop(heap)
        pure = bool(x.label) and all(map(PURE.fullmatch, x.label.split()))
        share = 0.3 if x.main else 0.05 if pure else 0.1
        if left >= share * total or (pure and not x.main and left >= 16) or -mass < 0.5 * total:
            break
        kept.add(x)
        left -= mass
        add(x)
    for x in nodes:
        x.furniture = x.furniture or (x.named and x not in kept)


def _texts(node: Node, inside: bool = False) -> Iterator[str]:
    """Text pieces outside furniture, with a space at each end of a block. A header stays if the container's headline is in it."""
    stack = [iter(node.parts)]
    ends = [""]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            yield ends.pop()
        elif isinstance(part, str):
            yield part
        elif not part.furniture and not (part.tag == "header" and not part.headline):
            gap = " " if part.tag in BLOCK else ""
            yield gap
            stack.append(iter(part.parts))
            ends.append(gap)


def text_of(node: Node) -> str:
    return " ".join("".join(_texts(node)).split())


def score(root: Node) -> list[Node]:
    """Containers with a score, in page order. A piece of text counts for its nearest container and half for the next."""
    found: dict[int, Node] = {}

    def walk(top: Node) -> None:
        stack = [(top, None, None, False)]
        while stack:
            node, near, next_, link = stack.pop()
            if node.furniture:
                continue
            link = link or node.tag == "a"
            if node.tag in CONTAINER:
                near, next_ = node, near
                found[id(node)] = node
            elif node.tag == "h1":
                at = node
                while at is not None and not at.headline:
                    at.headline, at = True, at.parent
            for part in reversed(node.parts):
                if isinstance(part, Node):
                    stack.append((part, near, next_, link))
                    continue
                n = len(part) - part.count(" ")
                if n and near is not None and not part.isspace():
                    value = (-0.5 if link else 1.0) * n + (0 if link else 3 * len(_SENTENCES.findall(part)))
                    near.score += value
                    if next_ is not None:
                        next_.score += value / 2

    walk(root)
    return [x for x in found.values() if x.score > 0]


def votes(page: str | None) -> list[tuple[int, float]]:
    """(path, share of the page's score) for each path of its containers."""
    shares: dict[int, float] = {}
    own = score(parse(page or ""))
    total = sum(x.score for x in own)
    for x in own:
        shares[x.path] = shares.get(x.path, 0.0) + x.score / total
    return list(shares.items())


def _whole(node: Node, own: list[Node]) -> Node:
    """The container itself, or the one around it if it is one of several parts with one path."""
    parts = Counter((id(x.parent), x.path) for x in own)
    while node.parent.parent is not None and parts[id(node.parent), node.path] - (node.score > 0) > 0:
        node = node.parent
    return node


def extract(page: str | None, paths: list[int] | None) -> str:
    """Text of the page's best container on the first of `paths` that it has, else of its best container, else of the page."""
    root = parse(page or "")
    own = score(root)
    for path in paths or []:
        here = [x for x in own if x.path == path]
        if here:
            return text_of(_whole(max(here, key=lambda x: x.score), own))
    return text_of(_whole(max(own, key=lambda x: x.score), own)) if own else text_of(root)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", best: int = 3, broadcast_rows: int = 500_000) -> DataFrame:
    """Row per input row: page_id, url, `text` of the article and `n_chars`.

    A host's `best` paths are tried in order of support; a page that has none of them, or whose host is unknown, falls
    back on its own best container. Null and empty pages give an empty text; repeated rows vote and are extracted each;
    an empty table gives an empty table; other columns are not read. Of tied containers of a page the first counts, of
    tied paths of a host the least hash. Very deep or unclosed nesting, tags and quotes that never close and very long
    pages take time and memory in proportion to the page. A page is parsed for its votes and again, once these are
    counted, for its text: trees are not kept between. Each task sends on a host's `best` paths alone, so that a host with
    very many paths is no large group. The paths of up to `broadcast_rows` hosts are
    broadcast (about 100 MB), and joined by a shuffle beyond.
    """
    @F.pandas_udf("array<struct<path:long,share:double>>")
    def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"path": p - (1 << 64) if p >> 63 else p, "share": s} for p, s in votes(x)] for x in batch])

    @F.pandas_udf("string")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, paths in batches:
            yield pd.Series([extract(x, [int(y) % (1 << 64) for y in p] if p is not None else None) for x, p in zip(texts, paths)], dtype=object)

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html")).withColumn("host", host(F.col("url")))
    support = rows.select("host", F.explode(voted("html")).alias("v")).groupBy("host", F.col("v.path").alias("path")).agg(F.sum("v.share").alias("support"))
    order = Window.partitionBy("host").orderBy(F.desc(F.round("support", 6)), "path")
    top = support.withColumn("k", F.row_number().over(order)).where(F.col("k") <= best)
    top = materialize(top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("paths")))
    if top.count() <= broadcast_rows:
        top = F.broadcast(top)
    df = rows.join(top, "host", "left").select("page_id", "url", extracted("html", "paths").alias("text"))
    return df.withColumn("n_chars", F.length("text").cast("long"))
