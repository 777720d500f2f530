"""HTML main text by consensus host paths.

Each page's containers are scored by the prose that lies in them.  The best
container's path of generalised tags and classes (digits as ``#``) is the
page's vote; Spark counts the votes of every host.  Each page is then read
again and the host's winning path is extracted; a page without it falls back
to its own best container.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import vectext as V
from quillspan.llm.tables import cut

#: Hosts whose paths are broadcast (under 1 kB each); beyond it they are joined.
BROADCAST_HOSTS = 20_000
#: A longer path is replaced by its hash.
PATH_CHARS = 500
#: Elements nested deeper are taken as part of the one at this depth.
MAX_DEPTH = 300

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"body", "caption", "dd", "dt", "head", "html", "legend", "li", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "summary"}
#: Elements that an opening tag of the same family ends, up to the element in which the family lives.
FAMILY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: Elements whose content is no page text: those that only their own end tag ends, and those of which a start tag without an end counts for nothing.
RAW = "script style noscript textarea iframe"
SOFT = frozenset("title template select svg math object canvas audio video button".split())
DROP_TAGS = frozenset("nav footer aside menu dialog head search fieldset".split())
#: Elements of running text: inside an article only a class that is one of DROP_NAMES as a whole drops them, and an id never does, as it is an anchor.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li blockquote pre dd dt td th tr caption figcaption figure summary".split())
#: Prose of a sibling, as a share of the best container's, from which it is another part of the same article.
FELLOW = 0.3
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments consent cookie cookies dialog disclaimer discussion "
    "disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related replies "
    "reply respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
OWN_NAMES = frozenset("article content entry main post story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + RAW.replace(" ", "|") + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S | re.I,
)
_SOFT = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW.replace(" ", "|") + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>" + "|".join(sorted(SOFT)) + r")(?=[\s/>])(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+|\d+")
_DIGITS = re.compile(r"\d+")


class Element:
    """An open or closed block element: generalised name, path, whether it is to be dropped, and its score."""

    __slots__ = ("tag", "parent", "path", "named", "hinted", "barred", "drop", "inside", "held", "mains", "score", "order", "chars", "linked", "fields")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        classes = _DIGITS.sub("#", ".".join(sorted(attributes.get("class", "").lower().split())))
        own = f"{tag}.{classes}" if classes else tag
        path = own if parent is None else f"{parent.path}/{own}"
        self.path = path if len(path) <= PATH_CHARS else "~" + hashlib.md5(path.encode("utf-8", "replace")).hexdigest()
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.named = self.hinted = self.barred = self.drop = False
        self._boilerplate(attributes)
        self.barred = self.barred or bool(parent and parent.barred)
        self.held = self.mains = self.score = 0.0
        self.chars = self.linked = 0
        self.fields = tag == "form"

    def _boilerplate(self, attributes: dict[str, str]) -> None:
        """Sets ``barred`` by tag, role or being hidden, ``named`` by a class or id, and ``hinted`` where in an article a part of one says so."""
        if self.tag in ("html", "body", "article", "main") and "comment" not in attributes.get("class", "").lower():
            return
        if self.tag in DROP_TAGS or attributes.get("role", "").lower() in DROP_ROLES:
            self.barred = True
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
            self.barred = True
        own = set(attributes.get("class", "").lower().split())
        anchor = attributes.get("id", "").lower()
        names = set(_NAME.findall(" ".join([*own, anchor])))
        whole = own if self.tag in TEXTUAL else own | {anchor}
        if self.tag == "form" or {_DIGITS.sub("", w).strip("-_") for w in whole} & DROP_NAMES:
            self.named = True
        elif names & DROP_NAMES and not (self.tag in TEXTUAL or self.tag == "section"):
            # Part of a longer name: within an article that alone says nothing.
            self.hinted, self.named = self.inside, not self.inside
        if not self.inside and not names & OWN_NAMES:
            self.barred = self.barred or self.tag == "header"
            self.named = self.named or "header" in names

    def is_main(self) -> bool:
        """An article or main outside any other, and no comment."""
        return self.tag in ("article", "main") and not self.named and not self.barred and not (self.parent and self.parent.inside)


def prose(text: str, linked: int) -> float:
    return max(0.0, len(text) - 2.0 * linked)


def settle(elements: list[Element], blocks: list[tuple[Element, str, int]]) -> None:
    """Sets ``drop``: what is barred or named, and all in it.

    A name drops no article or main further in, and not the element that holds
    most of the page's prose, unless an article or main lies elsewhere; so a
    form around the whole page is a wrapper.  What is hinted at goes if at least
    half of its text is links or if it holds a form.
    """
    total = 0.0
    for e, text, linked in blocks:
        e.chars += len(text)
        e.linked += linked
        if not e.barred:
            e.held += prose(text, linked)
            total += prose(text, linked)
    mains = 0.0
    for e in reversed(elements):
        if e.is_main():
            e.mains = e.held
            mains += e.held
        if e.parent:
            e.parent.held += e.held
            e.parent.mains += e.mains
            e.parent.chars += e.chars
            e.parent.linked += e.linked
            e.parent.fields |= e.fields
    for e in elements:
        most = 2 * e.held > total and e.mains == mains and not e.inside
        above = bool(e.parent and e.parent.drop) and not e.is_main()
        busy = e.hinted and (e.fields or 2 * e.linked >= e.chars)
        e.drop = e.barred or above or busy or e.named and not most


def soft_ends(page: str) -> dict[int, int]:
    """Of the elements in SOFT that have an end tag: where each starts and ends."""
    open_: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for m in _SOFT.finditer(page):
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if open_.get(tag):
                ends[open_[tag].pop()] = m.end()
        elif tag in ("svg", "math") and m["attrs"].endswith("/"):
            ends[m.start()] = m.end()
        else:
            open_.setdefault(tag, []).append(m.start())
    return ends


def parse(page: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """The page's elements and its text blocks in order: (element, text, characters in links)."""
    elements: list[Element] = []
    blocks: list[tuple[Element, str, int]] = []
    stack: list[Element] = []
    buffer: list[str] = []
    linked = in_link = too_deep = 0
    root = Element("body", {}, None, 0)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(_html.unescape("".join(buffer)).split())
            if text:
                blocks.append((stack[-1] if stack else root, text, linked))
            buffer.clear()
        linked = 0

    def pop(upto: int) -> None:
        flush()
        del stack[upto:]

    last = 0
    ends = soft_ends(page)
    for m in _TOKEN.finditer(page):
        if m.start() < last:
            continue
        if m.start() > last:
            piece = page[last : m.start()]
            buffer.append(piece)
            if in_link:
                linked += len(piece)
        last = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                buffer.append(_html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if tag in SOFT:
            last = ends.get(m.start(), last)
            continue
        if tag == "a":
            in_link = 0 if (m["end"] or m["end2"]) else 1
        if tag == "br":
            buffer.append("\n")
        if tag not in BLOCK:
            if tag in ("hr", "img"):
                buffer.append(" ")
            continue
        if m["end"] or m["end2"]:
            if too_deep:
                too_deep -= 1
                flush()
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
            else:
                flush()
            continue
        flush()
        if len(stack) >= MAX_DEPTH and tag not in ("p", "li"):
            too_deep += 1
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    pop(i)
                    break
        if tag in FAMILY:
            mates, home = FAMILY[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in home:
                    break
                if stack[i].tag in mates:
                    pop(i)
                    break
        attributes = {}
        raw = m["attrs"] or m["attrs2"]
        if raw:
            attributes = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(raw)}
        stack.append(Element(tag, attributes, stack[-1] if stack else None, len(elements)))
        elements.append(stack[-1])
    if last < len(page):
        buffer.append(page[last:])
    flush()
    settle(elements, blocks)
    return elements, blocks


#: Blocks that hold prose; what they lie in is a container.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption summary tr tbody ul ol dl table figure hgroup".split())


def best_container(elements: list[Element], blocks: list[tuple[Element, str, int]]) -> Element | None:
    """Scores containers, prose in full for the container around it and half for the next, and takes the best; None without text."""
    for e, text, linked in blocks:
        if e.drop:
            continue
        weight = prose(text, linked)
        while e.tag in _LEAVES and e.parent:
            e = e.parent
        e.score += weight
        if e.parent:
            e.parent.score += weight / 2
    scored = [e for e in elements if e.score > 0 and not e.drop]
    if not scored:
        return None
    best = max(scored, key=lambda e: (e.score, -e.order))
    # The heading of an article may lie beside the container of its paragraphs.
    outer = best
    while outer and outer.tag not in ("article", "main"):
        outer = outer.parent
    return outer or best


def parts(container: Element, elements: list[Element]) -> list[Element]:
    """The container and, unless it is an article, its siblings of the same generalised path that hold nearly as much prose: an article in several pieces."""
    if container.tag in ("article", "main") or container.parent is None:
        return [container]
    return [e for e in elements if e is container or e.parent is container.parent and e.path == container.path and not e.drop and e.held >= FELLOW * container.held > 0]


def extract(page: str | None, path: str | None) -> str:
    """The main text: blocks of the element at ``path`` or, without it or its text, of the page's own best container."""
    if not page:
        return ""
    elements, blocks = parse(page)
    own = best_container(elements, blocks)
    chosen = max((e for e in elements if path and e.path == path and not e.drop), key=lambda e: (e.score, -e.order), default=None)
    for container in (chosen, own):
        if container is not None:
            pieces = parts(container, elements)
            texts = [t for e, t, _ in blocks if not e.drop and any(_within(e, p) for p in pieces)]
            if texts:
                return "\n\n".join(texts)
    # A page without any block element is one block.
    return "\n\n".join(t for e, t, _ in blocks if not e.drop) if own is None else ""


def _within(e: Element | None, container: Element) -> bool:
    while e is not None and e is not container:
        e = e.parent
    return e is container


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in V.slices(batches, "html", 8 << 20):
        paths, scores = [], []
        for page in batch.column("html").to_pylist():
            best = best_container(*parse(page)) if page else None
            paths.append(best.path if best else None)
            scores.append(best.score if best else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in V.slices(batches, "html", 8 << 20):
        texts = [extract(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("path")],
            names=["page_id", "url", "text", "n_chars", "host_path"],
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """One row a host: its winning path, by votes, then score, then the path itself."""
    votes = pages.select(host(F.col("url")).alias("host"), "html").where("host is not null and html is not null").mapInArrow(_votes, "host string, path string, score double")
    counted = votes.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("score").cast("long")).alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars (code points), host_path.

    Reads only ``page_id``, ``url`` and ``html``.  A null or empty html gives
    an empty text; a url without a host takes no part in the vote and its page
    uses its own best container.  Repeated rows are extracted each.
    """
    paths = cut(host_paths(pages), "paths")
    small = paths.count() <= BROADCAST_HOSTS
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host(F.col("url")))
    joined = base.join(F.broadcast(paths) if small else paths, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, host_path string")
