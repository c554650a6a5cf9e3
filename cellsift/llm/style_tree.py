"""Main text of web pages by a site style tree.

1. A page is read into a tree of its block elements. What stands between the tags of a block without block children is
   a leaf.
2. The trees of one host are merged: an element's place is that of its parent, the parent's style (the row of its
   children's names) and its number therein. For each place is counted how many pages have it, with which style or, at
   a leaf, with which content.
3. An inner element's importance is the entropy of its styles over the pages, to the base of their number; that of a
   leaf is one minus the same entropy of its content's spread over pages: text that all pages share counts nothing. An
   element's whole importance joins its own with the mean of its children's, the less its own the fewer styles it has
   (``(1 - DECAY^l) own + DECAY^l children``).
4. Branches of low importance leave each page. So do branches whose name, role or class says what they are: menus,
   forms, adverts, notices, comments and the like. A class says so by a whole word (``ad``), or by one with companions
   that only say where or what shape it is (``ad-box``); what it merely hints at (``no-sidebar``, ``tag-advertising``)
   is left to the tree, and so is, inside an article, a word that passages of the text may bear too (``notice``, ``share``), if there
   are paragraphs in the branch. If a page has an article or a main element, what stands outside leaves too.

A class, an id or a form never takes the bulk of a page: of such branches those stay that hold most of the page's
text, unless they are comments, lie in an article, or have none while one stands outside. Main elements stay anyway,
so do forms with most of the text or with the article in them, and an article, if it is no comment, beside which there
is no other. If nothing else has text, all of them stay.

A place that fewer than ``LEAST_PAGES`` different pages have counts as important, and so do paragraphs and headings
inside an article, but for branches with such a word: sites repeat passages in articles that are text nonetheless. If
the tree would leave a page nothing, the page keeps what its names let stand. Equal pages of a host count once. Blocks are joined in page order by
one space, white space inside them becomes one space, and character references are decoded. Null or empty html gives
an empty text; a null url is a host of its own. Repeated rows and ids stay as they are.
"""

from __future__ import annotations

import hashlib
import html as html_module
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellsift.llm.common import ship, staged

ship(__name__)

DECAY = 0.9
LOW = 0.15
LEAST_PAGES = 4

# Names of HTML and of its customs.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "script style noscript template head title nav footer aside button select option textarea iframe object svg math "
    "canvas audio video dialog menu noembed noframes xmp".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
DROPPED_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription "
    "signup popup modal overlay share sharing social related recommended comment comments commentlist respond disqus replies "
    "footer pagination pager widget toolbar masthead skip login search searchform".split()
)
COMMENTS = frozenset("comment comments commentlist respond disqus replies".split())
# Of these, words that a passage of an article may bear as well: there the tree decides.
UNSURE = frozenset(
    "promo promotion banner notice notices notification alert popup modal overlay share sharing social related recommended widget "
    "toolbar skip login search".split()
)
# What a dropped class may be joined with, besides another one and numbers.
COMPANIONS = frozenset(
    "area bar block bottom box btn button buttons col column container desktop dfp form google gpt group header heading holder icon "
    "icons inline inner item items left link links list main mobile module outer page panel placement post posts primary right row "
    "secondary section site slot sticky strip text title top unit widgets wp wrap wrapper zone".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BARRIERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote #text li dd dt td figcaption".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_TOKENS = re.compile(r"[a-z0-9]+")


@dataclass
class Element:
    name: str
    dropped: bool = False
    named: str = ""  # what its class or id says it is, or a form
    main: bool = False
    inside: bool = False  # an article or main element, or in one
    children: list = field(default_factory=list)
    text: list = field(default_factory=list)  # of leaves
    unsure: bool = False  # so named, but the tree is to decide


def _dropped(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    for key, value in _NAMED.findall(attributes) if attributes.strip() else ():
        key, words = key.lower(), value.strip("\"'").lower()
        if key == "hidden" and (not words or words in ("hidden", "true")):
            return True
        if key == "role" and words in DROPPED_ROLES:
            return True
    return False


def _named(name: str, attributes: str) -> str:
    """The word by which class or id say that a branch is no text; ``form`` for forms, empty if nothing says so."""
    found = ""
    for key, value in _NAMED.findall(attributes) if attributes.strip() else ():
        key, words = key.lower(), value.strip("\"'").lower()
        if key == "role" and words == "form":
            found = found or "form"
        if key in ("class", "id"):
            for word in words.split():
                parts = _TOKENS.findall(word)
                own = [part for part in parts if part in DROPPED_CLASSES]
                if own and all(x in DROPPED_CLASSES or x in COMPANIONS or x[0].isdigit() for x in parts):
                    comments = [part for part in own if part in COMMENTS]
                    return (comments or own)[0]
    return found or ("form" if name == "form" else "")


def parse(page: str) -> Element:
    """The tree of block elements; runs of text between them are leaves named ``#text``."""
    root = Element("#root")
    stack = [root]
    at, n = 0, len(page)

    def put(text: str) -> None:
        if text:
            top = stack[-1]
            if not top.children or top.children[-1].name != "#text":
                if not text.strip():
                    return
                top.children.append(Element("#text"))
            top.children[-1].text.append(text)

    def split() -> None:
        """A line break: text that follows is another leaf."""
        if stack[-1].children and stack[-1].children[-1].name == "#text":
            stack[-1].children.append(Element("#break"))

    open_names = Counter()

    def close(names: tuple[str, ...], barriers: tuple[str, ...] = ()) -> None:
        if not any(open_names[name] for name in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                open_names.subtract(e.name for e in stack[i:])
                del stack[i:]
                return
            if stack[i].name in barriers:
                return

    while at < n:
        tag = _TAG.search(page, at)
        if tag is None:
            put(html_module.unescape(page[at:]))
            break
        if tag.start() > at:
            put(html_module.unescape(page[at : tag.start()]))
        at = tag.end()
        shut, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            if tag[0].startswith("<![CDATA["):
                put(tag[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if shut:
            if name not in INLINE and name not in VOID:
                close((name,), ("table",) if name not in ("table", "body", "html") else ())
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else n
            continue
        if name == "br" or name == "hr":
            split()
            continue
        if name in INLINE or name in VOID:
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_PARAGRAPH:
            close(("p",), ("table", "td", "th", "button", "li") if name != "p" else ("table", "td", "th", "button"))
        if name in SIBLINGS:
            while True:
                before = len(stack)
                close(SIBLINGS[name], ("table", *BARRIERS.get(name, ())))
                if len(stack) == before or name in ("li", "dt", "dd", "option"):
                    break
        main = name in ("article", "main") or 'role="main"' in attributes
        element = Element(name, _dropped(name, attributes, stack[-1].inside), _named(name, attributes), main, main or stack[-1].inside)
        stack[-1].children.append(element)
        if not attributes.endswith("/") or name not in ("div", "p", "section"):
            stack.append(element)
            open_names[name] += 1
    _judge(root)
    return root


def _judge(root: Element) -> None:
    """Drops the named branches, except those that hold the bulk of the page."""
    order = list(_walk(root))
    if not any(e.named for e in order):
        return
    place = {id(e): i for i, e in enumerate(order)}
    # By element: letters of its text, and articles and main elements with text in it, itself included, but no comments;
    # whether there are paragraphs in it.
    letters, mains, paragraphs = [0] * len(order), [0] * len(order), [False] * len(order)
    for i in range(len(order) - 1, -1, -1):
        e = order[i]
        letters[i] = len("".join("".join(e.text).split()))
        for c in e.children:
            if id(c) in place and not c.dropped:
                letters[i] += letters[place[id(c)]]
                mains[i] += mains[place[id(c)]]
                paragraphs[i] |= paragraphs[place[id(c)]] or (c.name in PROSE and c.name != "#text")
        mains[i] += e.main and letters[i] > 0 and e.named not in COMMENTS
    named = []
    for i, e in enumerate(order):
        if not e.named or e.dropped:
            continue
        bulk = 2 * letters[i] > letters[0]
        inside = e.inside and not e.main  # in an article
        if e.named == "form":
            stays = bulk or (mains[i] > 0 and not inside)
        elif e.main:
            stays = e.name != "article" or (e.named not in COMMENTS and (bulk or mains[i] == mains[0]))
        elif inside and e.name != "form" and e.named in UNSURE and paragraphs[i]:
            stays = e.unsure = True
        else:
            stays = bulk and e.named not in COMMENTS and not inside and (mains[i] > 0 or not mains[0])
        if not stays:
            named.append(e)
    for e in named:
        e.dropped = True
    if letters[0] and not _has_text(root):
        for e in named:
            e.dropped = False


def nodes_of(page: str | None) -> list[tuple]:
    """``(place, parent, content, leaf, prose, text, solid)`` of every element that its names let stand, in page order.

    ``place`` and ``content`` are 64-bit hashes; ``parent`` is the number of the parent in the list, -1 for none; ``solid`` counts
    the children that are prose.
    """
    root = parse(page or "")
    mains = [e for e in _walk(root) if e.main and not e.dropped and _has_text(e)]
    out: list[tuple] = []
    _collect(root, b"", -1, not mains, out)
    solid = [0] * len(out)
    for _, parent, _, _, prose, _ in out:
        if prose and parent >= 0:
            solid[parent] += 1
    return [(*node, n) for node, n in zip(out, solid, strict=True)]


def _walk(e: Element) -> Iterator[Element]:
    stack = [e]
    while stack:
        e = stack.pop()
        yield e
        if not e.dropped:
            stack += reversed(e.children)


def _has_text(e: Element) -> bool:
    return any(x.name == "#text" and "".join(x.text).strip() for x in _walk(e))


def _hash(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\0".join(parts), digest_size=8).digest()


def _number(h: bytes) -> int:
    return int.from_bytes(h, "little", signed=True)


def _collect(root: Element, place: bytes, parent: int, open_: bool, out: list[tuple]) -> None:
    todo = [(root, place, parent, open_, False, False)]
    while todo:
        e, place, parent, open_, inside, prose = todo.pop()
        if e.dropped or e.name == "#break":
            continue
        if e.name == "#text":
            text = " ".join("".join(e.text).split())
            if open_ and text:
                out.append((_number(place), parent, _number(_hash(text.encode("utf-8", "replace"))), True, prose, text))
            continue
        open_, inside = open_ or e.main, inside or e.main
        style = ",".join(c.name for c in e.children if c.name != "#break").encode()
        number = parent
        if open_:
            number = len(out)
            out.append((_number(place), parent, _number(_hash(style)), False, prose, None))
        for i, c in reversed(list(enumerate(e.children))):
            own = inside and c.name in PROSE and (c.name != "#text" or e.main)
            # In a branch of an unsure name nothing counts as prose, so that the tree has its say.
            todo.append((c, _hash(place, style, str(i).encode(), c.name.encode()), number, open_, inside and not c.unsure, prose or own))


def low_branches(nodes: list[dict]) -> list[int]:
    """The numbers ``at`` of a page's elements whose whole importance is low.

    ``nodes`` are those outside of prose: ``at, parent, leaf, solid, own, styles``, where ``solid`` counts children that are prose
    and so count as important.
    """
    nodes = sorted(nodes, key=lambda n: n["at"])
    sums = {n["at"]: float(n["solid"]) for n in nodes}
    counts = {n["at"]: n["solid"] for n in nodes}
    low = []
    for n in reversed(nodes):
        at, whole = n["at"], n["own"]
        if not n["leaf"]:
            share = DECAY ** n["styles"]
            whole = (1 - share) * whole + share * sums[at] / counts[at] if counts[at] else 1.0
        if n["parent"] in sums:
            sums[n["parent"]] += whole
            counts[n["parent"]] += 1
        if whole <= LOW:
            low.append(at)
    return low


def kept_text(nodes: list[dict], low: Iterable[int] = ()) -> str:
    """The text of the page without the branches at ``low``."""
    gone, out = set(low), []
    for i, node in enumerate(nodes):
        if node["parent"] in gone:
            gone.add(i)
        if node["leaf"] and i not in gone:
            out.append(node["text"])
    return " ".join(out or [x["text"] for x in nodes if x["leaf"]])


_NODE = "struct<place:long,parent:int,content:long,leaf:boolean,prose:boolean,text:string,solid:int>"
_NODE_TYPE = pa.struct([("place", pa.int64()), ("parent", pa.int32()), ("content", pa.int64()), ("leaf", pa.bool_()),
                        ("prose", pa.bool_()), ("text", pa.string()), ("solid", pa.int32())])
_KEYS = [f.name for f in _NODE_TYPE]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [f.name for f in batch.schema][:-1]
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            pages = part.column(len(names)).to_pylist()
            nodes = [[dict(zip(_KEYS, x, strict=True)) for x in nodes_of(page)] for page in pages]
            columns = [part.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(nodes, pa.list_(_NODE_TYPE))], [*names, "nodes"])


def _rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = [low_branches(nodes) for nodes in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.list_(pa.int32()))], ["row", "low"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            for nodes, low in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                texts.append(kept_text(nodes, low or ()))
        arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "url", "text"])


def importances(nodes: DataFrame) -> DataFrame:
    """``host, place, content, own, styles`` for places that enough pages have."""
    seen = nodes.groupBy("host", "place", "content", "leaf").agg(F.count("*").alias("c"))
    log = F.log(F.col("c").cast("double"))
    places = seen.groupBy("host", "place").agg(
        F.sum("c").alias("m"), F.sum(F.col("c") * log).alias("s"), F.count("*").cast("int").alias("styles")
    ).where(F.col("m") >= LEAST_PAGES)
    base = F.log(F.col("m").cast("double"))
    own = F.when(F.col("leaf"), 1 - log / base).otherwise(1 - F.col("s") / F.col("m") / base)
    return seen.join(places, ["host", "place"]).select("host", "place", "content", own.alias("own"), "styles")


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``id_column, url_column`` and ``text`` for every row."""
    url = F.col(f"`{url_column}`").cast("string")
    page = F.coalesce(F.col(f"`{html_column}`").cast("string"), F.lit(""))
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    marked = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_column}`").alias("id"),
        url.alias("url"),
        F.lower(host).alias("host"),
        F.unhex(F.sha2(page, 256)).alias("mark"),
        page.alias("html"),
    )
    kind = pages.schema[id_column].dataType.simpleString()
    schema = f"row long, id {kind}, url string, host string, mark binary, nodes array<{_NODE}>"
    trees = staged(marked.mapInArrow(_read, schema), "style-trees")
    nodes = trees.select("row", "host", F.posexplode("nodes").alias("at", "n")).where("not n.prose")
    nodes = nodes.select("row", "host", "at", "n.place", "n.content", "n.leaf", "n.parent", "n.solid")
    # Equal pages of a host count once.
    counted = trees.groupBy("host", "mark").agg(F.min("row").alias("row")).select("row")
    rated = nodes.join(importances(nodes.join(counted, "row", "left_semi")), ["host", "place", "content"], "left")
    own, styles = F.coalesce("own", F.lit(1.0)), F.coalesce("styles", F.lit(1))
    node = F.struct("at", "parent", "leaf", "solid", own.alias("own"), styles.alias("styles"))
    # A page without a place of low importance of its own has no low branch: the whole is a mean of its parts.
    pages_rated = rated.groupBy("row").agg(F.min("own").alias("least"), F.collect_list(node).alias("nodes"))
    pages_rated = pages_rated.where(F.col("least") <= LOW)
    low = pages_rated.select("row", "nodes").mapInArrow(_rate, "row long, low array<int>").where(F.size("low") > 0)
    pruned = trees.join(staged(low, "style-low"), "row", "left").select("id", "url", "nodes", "low")
    return pruned.mapInArrow(_prune, f"id {kind}, url string, text string").toDF(id_column, url_column, "text")
