"""Main text of web pages: site templates found by counting element subtrees for each host.

Every page is parsed once, to elements. Subtrees are hashed by tags and text; Spark counts, for each
host, in how many different main texts' pages a subtree occurs. Subtrees that recur across many
pages of a host are deleted there, and so is what its element, role or class names as a menu,
header, footer, sidebar, notice, advert, form or comments, which hosts with few pages need. A class
or id deletes nothing that holds an article, a main part or a heading of first level, nor most of a
page without any. What is left of the article, or of the body where no article is marked, is the text;
marked articles that only tease others are told from it by headings and by how much text lies around them.

The parse leaves a table of each page's blocks, with the subtrees around them, and of the hashes to
count; pages are not parsed again to delete what recurs.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, on_workers, slices, written

TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">]+)*)>?|[!?/][^>]*>?)""", re.S)
#: A name is tried from its start only and given up as a whole, so that a long one without a value costs its length.
ATTR = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Words of a class or id: at hyphens, underscores, digits, and capitals after small letters.
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre dl dt dd li td th tr caption figcaption summary".split())
CONTAINERS = frozenset("div section ul ol menu table figure aside nav header footer form details center".split())
BLOCKS = PROSE | CONTAINERS | frozenset("address article body dialog fieldset hr hgroup html legend main optgroup option tbody thead tfoot search".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot option optgroup caption".split())
#: An opening element ends an open one of these, up to one of those around it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# What is never part of an article: elements, roles, and words of class and id.
DROPPED = frozenset("head script style noscript template nav footer aside form iframe object svg canvas button select textarea input datalist dialog menu audio video map title xmp noembed noframes search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
LABELS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "masthead topbar footer sidebar aside widget cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe signup "
    "share sharing social comment comments disqus respond replies feedback talkback reactions teaser teasers related recommended login search toolbar skip".split()
)
COMMENTS = frozenset("comment comments disqus respond replies feedback talkback reactions".split())
#: Words that name comments where a reader stands before them.
TALK = frozenset("discussion discussions opinions responses reviews letters voices forum talk thoughts".split())
READERS = frozenset("reader readers user users visitor visitors guest guests community".split())
#: Of an article's own classes only these tell that it is not the page's.
ASIDE = COMMENTS | frozenset("related sponsored recommended promo teaser teasers".split())
#: Characters from which an article beside the text under the page's heading can be the page's.
CARD = 200
#: Words beside a label that leave it one (ad-box, footer-links), and words that turn it (no-sidebar).
BESIDE = frozenset("box boxes wrap wrapper container block blocks area section slot unit list items item links link panel module group holder inner outer top bottom left right main site global small large posts articles stories form button buttons icon icons text content".split())
TURNED = frozenset("no non not without has have with hide hidden is enable enabled disable disabled".split())
#: Boilerplate that is left out, by the least level that is looked at: by element and role always.
LEFT_OUT = {1: (1, 2), 2: (1,)}
COUNTED = CONTAINERS | PROSE
RAW_ENDS = {name: re.compile(f"</{name}", re.I) for name in RAW}
#: Keys that a host's subtrees are dealt to.
SALTS = 16
#: A subtree is a template from so many different main texts of a host on, and from such a share of them on.
LEAST_PAGES, LEAST_SHARE = 4, 0.01
#: Inside an article the share must be this, as copied passages recur there too.
LEAST_SHARE_INSIDE = 0.2


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "hash", "size", "inside", "holds", "headed", "gone")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.items, self.hash, self.size = tag, attrs, parent, [], 0, 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.holds = self.headed = False
        self.gone = 0


def parse(page: str) -> Node:
    """The page's elements as a tree; items are nodes and decoded texts. Unclosed and stray tags are mended."""
    root = here = Node("", "", None)
    opened: Counter[str] = Counter()  # by name, so that what is not open is not looked for

    def leave(node: Node) -> Node:
        """The node around `node`, which ends with all that is open in it."""
        inner = here
        while inner is not node.parent:
            opened[inner.tag] -= 1
            inner = inner.parent
        return node.parent

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            here.items.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            text = page[at : m.start()]
            here.items.append(html.unescape(text) if "&" in text else text)
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            if opened[name]:
                node = here
                while node.tag != name:
                    node = node.parent
                here = leave(node)
            continue
        if name in CLOSES_P and opened["p"]:
            node = here
            while node.parent and node.tag != "p" and node.tag not in BLOCKS:
                node = node.parent
            if node.tag == "p":
                here = leave(node)
        if name in ENDS:
            ended, around = ENDS[name]
            if any(opened[x] for x in ended):
                node, last = here, None
                while node.parent and node.tag not in around:
                    if node.tag in ended:
                        last = node
                        if name != "tr" or node.tag == "tr":  # a row ends its cells too
                            break
                    node = node.parent
                if last:
                    here = leave(last)
        node = Node(name, m["attrs"] or "", here)
        here.items.append(node)
        if name in RAW:
            end = RAW_ENDS[name].search(page, at)
            node.items.append(page[at : end.start() if end else n])
            at = end.start() if end else n
        if name not in VOID and not (m["attrs"] or "").rstrip().endswith("/") or name in RAW:
            here = node
            opened[name] += 1
    return root


def walk(root: Node):
    """All nodes, parents first."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(x for x in node.items if isinstance(x, Node))


def measure(root: Node) -> None:
    """Fill in what nodes are told by what they hold, and which of them are boilerplate by name.

    Of a node: the hash of its tags and its text with single spaces; its size, the characters of
    its text outside elements that are never part of an article; whether it holds an article, a main
    part or a heading of first level; whether it holds any heading.
    """
    nodes = list(walk(root))
    for node in reversed(nodes):
        h, size = xxhash.xxh64(node.tag.encode()), 0
        for x in node.items:
            if isinstance(x, Node):
                h.update(x.hash.to_bytes(8, "little"))
                size += x.size if x.tag not in DROPPED else 0
                node.holds |= x.holds or x.tag in ("article", "main", "h1")
                node.headed |= x.headed or x.tag in HEADINGS
            else:
                text = " ".join(x.split())
                h.update(text.encode("utf-8", "surrogatepass") + b"\0")
                size += len(text)
        node.hash, node.size = h.intdigest(), size
    for node in nodes:
        node.gone = boilerplate(node, root)


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(node.attrs)} if node.attrs else {}


def labels(names: str) -> set[str]:
    """The labels among the names of a class or id: a name that ends with one, or starts with one and goes on with words that change nothing."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in NAMES.findall(name)]
        if not words or TURNED.intersection(words):
            continue
        if words[-1] in LABELS:
            found.add(words[-1])
        elif words[-1] in TALK and READERS.intersection(words):
            found.add("comments")
        elif words[0] in LABELS and all(w in BESIDE or w in LABELS for w in words):
            found.add(words[0])
    return found


def boilerplate(node: Node, root: Node) -> int:
    """1 if an element or role names it as no part of an article, 2 if only a class or id does, else 0."""
    if node.tag in DROPPED:
        return int(not (node.tag == "form" and node.holds))
    if node.tag == "header":  # an article's own header with its heading is part of it
        return int(not (node.inside and node.headed))
    if not node.attrs or node.tag in ("html", "body", "main"):
        return 0
    attrs = attributes(node)
    if attrs.get("role", "").lower() in ROLES and not node.holds:
        return 1
    found = labels(f"{attrs.get('class', '')} {attrs.get('id', '')}")
    if node.tag == "article":
        return 2 * bool(found & ASIDE)
    if not found or node.holds or not root.holds and not found & COMMENTS and 2 * node.size >= root.size:
        return 0
    return 2


def main_nodes(root: Node, least: int = 1) -> list[Node]:
    """The elements that the page's article is in; none of them in boilerplate. Articles that only tease others are marked as gone.

    Where no article is marked it is the main element, else the body, else all. Of outermost articles the one with
    the first heading of first level is the page's, if it has no less text than what lies around
    articles. If that heading is around them, or in several, or there is none, they are teasers where
    more text lies around them than in the largest, or any and the heading, while the largest is shorter than CARD; else that heading comes first, and they follow: only
    the largest if it has most of their text, else all.
    """
    kept, found, order = {}, {"main": [], "body": []}, []  # kept: characters outside boilerplate
    stack: list = [(root, None)]
    while stack:
        node, article = stack.pop()
        if node is not root and node.gone in LEFT_OUT[least]:
            continue
        order.append((node, article))
        kind = "main" if node.tag == "main" or "main" in node.attrs and attributes(node).get("role") == "main" else node.tag
        if kind in found and not found[kind]:
            found[kind].append(node)
        inner = node if node.tag == "article" and article is None else article
        stack.extend((x, inner) for x in reversed(node.items) if isinstance(x, Node))
    for node, _ in reversed(order):
        kept[node] = sum(kept.get(x, 0) if isinstance(x, Node) else len(" ".join(x.split())) for x in node.items)
    articles = [(n, kept[n]) for n, article in order if n.tag == "article" and article is None and kept[n]]
    if not articles:
        return (found["main"] or found["body"] or [root])[:1]
    main = found["main"][0] if found["main"] else None
    if main is not None:  # articles beside the main element are none of the page's, unless it is empty of text
        inside = set(map(id, walk(main)))
        own = [x for x in articles if id(x[0]) in inside]
        if own or kept[main]:
            articles = own
    top = main if main is not None and (articles or kept[main]) and all(id(n) in inside for n, _ in articles) else found["body"][0] if found["body"] else root
    if not articles:
        return [top]
    total, (largest, most) = sum(n for _, n in articles), max(articles, key=lambda x: x[1])
    around = kept[top] - total
    headings = [(node, article) for node, article in order if node.tag == "h1" and kept[node]]
    headed = {id(article) for _, article in headings if article is not None}
    headed = [x for x in articles if id(x[0]) in headed]
    title = next((node for node, article in headings if article is None), None)
    if title is not None:
        around -= kept[title]
    if len(headed) == 1 and headed[0][1] >= around and (title is None or not around):
        return [headed[0][0]]
    if around > most or around and title is not None and most < CARD:
        for node, _ in articles:
            node.gone = 1
        return [top]
    chosen = [largest] if 2 * most > total and (title is not None or len(headed) == 1) else [n for n, _ in articles]
    return [*([title] if title is not None else []), *chosen]


def blocks(nodes: list[Node], counted=frozenset(), least: int = 1) -> tuple[list[tuple[str, int]], list[tuple[int, int]]]:
    """The blocks (text, place) in page order, white space single, and the counted subtrees around them.

    A subtree is (hash, place of the subtree around it); a block's place is that of the innermost
    subtree around it; -1 is none.
    """
    out: list[tuple[str, int]] = []
    around: list[tuple[int, int]] = []
    run: list[str] = []
    place = -1

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append((text, place))
        run.clear()

    for top in nodes:
        stack: list = [(top, -1)]
        while stack:
            x, at = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                if not run:
                    place = at
                run.append(x)
            elif x is not top and x.gone in LEFT_OUT[least]:
                flush() if x.tag in BLOCKS else run.append(" ") if run else None
            elif x.tag == "br":
                run.append(" ") if run else None
            else:
                if x is not top and x.hash in counted and x.tag in COUNTED:
                    around.append((x.hash, at))
                    at = len(around) - 1
                if x.tag in BLOCKS or x is top:
                    flush()
                    stack.append((None, at))
                stack.extend((y, at) for y in reversed(x.items))
        flush()
    return out, around


def candidates(root: Node, nodes: list[Node]) -> dict[int, bool]:
    """Hash of each subtree that can be a template, and whether it is inside the article.

    Inside, that is containers of less than half of the article; outside also prose. What holds an
    article or a heading of first level is none.
    """
    found: dict[int, bool] = {}
    marked = nodes[0].tag in ("article", "main")
    tops = set(map(id, nodes))
    inner = set(tops)
    for top in nodes:
        inner.update(map(id, walk(top)))
    whole = max(1, sum(x.size for x in nodes))
    for node in walk(root):
        inside = id(node) in inner
        if not node.size or id(node) in tops or node.tag not in CONTAINERS and (node.tag not in PROSE or inside and marked):
            continue
        if inside and 2 * node.size >= whole or node.holds or node.tag in ("article", "main", "h1"):
            continue
        found[node.hash] = found.get(node.hash, False) or inside
    return found


def page_parts(page: str) -> tuple[list[tuple[str, int]], list[tuple[int, int]], dict[int, bool]]:
    """A page's blocks, the subtrees around them, and the subtrees to count.

    Where nothing is left of a page, classes and ids delete nothing.
    """
    root = parse(page)
    measure(root)
    for least in (1, 2):
        nodes = main_nodes(root, least)
        found = candidates(root, nodes)
        parts, around = blocks(nodes, found, least)
        if parts:
            break
    return parts, around, found


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


PARTS = "main long, found array<struct<subtree:bigint,inside:boolean>>, around array<struct<subtree:bigint,up:int>>, blocks array<struct<text:string,at:int>>"


def _parts(batches):
    signed = lambda h: h - (1 << 63)
    found_type = pa.list_(pa.struct([("subtree", pa.int64()), ("inside", pa.bool_())]))
    around_type = pa.list_(pa.struct([("subtree", pa.int64()), ("up", pa.int32())]))
    blocks_type = pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32())]))
    for batch in batches:
        for part in slices(batch, "html"):
            rows: list[list] = [[], [], [], []]
            for page in columns(part, "html")[0].to_pylist():
                parts, around, found = page_parts(page)
                parts = [(t.encode("utf-8", "replace").decode(), at) for t, at in parts]
                rows[0].append(signed(xxhash.xxh64_intdigest("\n".join(t for t, _ in parts))))
                rows[1].append([{"subtree": signed(h), "inside": x} for h, x in found.items()])
                rows[2].append([{"subtree": signed(h), "up": up} for h, up in around])
                rows[3].append([{"text": t, "at": at} for t, at in parts])
            arrays = [pa.array(x, kind) for x, kind in zip(rows, (pa.int64(), found_type, around_type, blocks_type))]
            yield pa.RecordBatch.from_arrays([*columns(part, "page_id", "url", "host"), *arrays], ["page_id", "url", "host", "main", "found", "around", "blocks"])


def templates(parts: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, least_inside: float = LEAST_SHARE_INSIDE) -> DataFrame:
    """(host, subtree) of the subtrees that recur across many pages of a host, from rows (host, main, found).

    Pages with the same main text count once, so that copies of an article are no template.
    """
    once = parts.select("host", "main", F.explode("found").alias("x")).groupBy("host", "x.subtree", "main").agg(F.max("x.inside").alias("inside"))
    counts = once.groupBy("host", "subtree").agg(F.count("*").alias("n"), F.max("inside").alias("inside")).where(F.col("n") >= least_pages)
    pages = parts.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    # a host with most of the pages is SALTS keys, not one
    salted = pages.select("host", "pages", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    share = F.when(F.col("inside"), F.lit(least_inside)).otherwise(F.lit(least_share))
    many = counts.withColumn("salt", F.pmod("subtree", F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"])
    return many.where(F.col("n") >= share * F.col("pages")).select("host", "subtree")


def _kept(batches):
    for batch in batches:
        out = []
        for found, around, gone in zip(*(c.to_pylist() for c in columns(batch, "blocks", "around", "deleted"))):
            gone = set(gone or ())
            dead: list[bool] = []  # a subtree comes after the one around it
            for x in around:
                dead.append(x["subtree"] in gone or x["up"] >= 0 and dead[x["up"]])
            out.append("\n".join(x["text"] for x in found if x["at"] < 0 or not dead[x["at"]]))
        yield pa.RecordBatch.from_arrays([*columns(batch, "page_id", "url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url and text of every row of pages(page_id, url, html).

    Blocks are joined by one line feed, white space within them is one space. A null or empty
    page has an empty text; pages without a host are one host. Only pages with counted subtrees around
    their blocks meet the templates again; the others' texts are what the parse left.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    kinds = dict(pages.dtypes)
    keys = f"page_id {kinds['page_id']}, url {kinds['url']}"
    parts = rows.mapInArrow(on_workers(_parts), f"{keys}, host string, {PARTS}").withColumn("row", F.monotonically_increasing_id())
    parts = written(parts, "parts")
    some = parts.where(F.size("around") > 0)
    asked = some.select("row", "host", F.explode(F.array_distinct("around.subtree")).alias("subtree"))
    deleted = asked.join(templates(parts, least_pages, least_share), ["host", "subtree"]).groupBy("row").agg(F.collect_set("subtree").alias("deleted"))
    left = some.select("row", "page_id", "url", "around", "blocks").join(deleted, "row", "left").select("page_id", "url", "around", "blocks", "deleted")
    plain = parts.where(F.size("around") == 0).select("page_id", "url", F.array_join("blocks.text", "\n").alias("text"))
    return plain.unionByName(left.mapInArrow(on_workers(_kept), f"{keys}, text string"))
