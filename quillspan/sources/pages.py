"""HTML pages as structural blocks: kind, section trail and text, in document order."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element roles, the joiner of a section trail and the name before the first heading.
SKIPPED = frozenset("head script style template noscript".split())
BLOCKS = frozenset("address article aside blockquote body dd div dl dt figcaption figure footer form header hr html li main nav ol p pre section table td th tr ul".split())
#: Blocks that authors often leave open; they do not count towards the depth.
LOOSE = frozenset("dd dt li p td th tr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
TRAIL, BEFORE = " > ", "(preamble)"
MAX_DEPTH = 256


class _Blocks(HTMLParser):
    """Collects blocks: headings keep a trail in which a heading closes its own level and deeper; a table is rows of cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str]] = []
        self.trail: list[tuple[int, str]] = []
        self.buffer: list[str] = []
        self.skip = self.depth = self.preformatted = 0
        self.heading: int | None = None
        self.cells: list[str] | None = None
        self.rows: list[str] = []

    def flush(self) -> None:
        raw = "".join(self.buffer)
        self.buffer.clear()
        text = raw.strip("\n") if self.preformatted else "\n".join(filter(None, (" ".join(x.split()) for x in raw.split("\n"))))
        if not text.strip():
            return
        if self.cells is not None:
            self.cells.append(" ".join(text.split()))
        elif self.heading:
            self.trail = [t for t in self.trail if t[0] < self.heading] + [(self.heading, " ".join(text.split()))]
            self.out.append(("heading", self.path(), " ".join(text.split())))
        else:
            self.out.append(("paragraph", self.path(), text))

    def path(self) -> str:
        return TRAIL.join(t for _, t in self.trail) or BEFORE

    def handle_starttag(self, tag, attrs):
        hidden = any(k == "hidden" for k, _ in attrs)
        if tag not in VOID:
            self.depth += tag in BLOCKS and tag not in LOOSE
            if self.skip or tag in SKIPPED or hidden:
                self.skip += 1
                return
        if self.skip:
            return
        if self.depth > MAX_DEPTH:
            raise RecursionError
        if tag == "br":
            self.buffer.append("\n")
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.flush()
            self.heading = int(tag[1])
        elif tag in BLOCKS:
            self.flush()
            if tag == "table":
                self.rows, self.cells = [], []
            self.preformatted += tag == "pre"

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        self.depth = max(0, self.depth - (tag in BLOCKS and tag not in LOOSE))
        if self.skip:
            self.skip -= 1
            return
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.flush()
            self.heading = None
        elif tag in BLOCKS:
            self.flush()
            if tag == "tr" and self.cells is not None:
                self.rows.append(" | ".join(self.cells))
                self.cells = []
            elif tag == "table" and self.cells is not None:
                if self.cells:
                    self.rows.append(" | ".join(self.cells))
                text, self.cells = "\n".join(filter(None, self.rows)), None
                if text:
                    self.out.append(("table", self.path(), text))
            self.preformatted -= tag == "pre" and self.preformatted > 0

    def handle_data(self, data):
        if not self.skip:
            self.buffer.append(data if self.preformatted else data.replace("\n", " "))


def blocks(page: str) -> tuple[list[tuple[str, str, str]], str | None]:
    """Blocks (kind, section, text) and an error category: too_deep, empty or none."""
    parser = _Blocks()
    try:
        parser.feed(page)
        parser.close()
        parser.flush()
    except RecursionError:
        return [], "too_deep"
    return parser.out, None if parser.out else "empty"


def html_blocks(pages: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, ordinal, kind, section, text, error); a page that fails or is empty is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, page in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist()):
                found, error = blocks(page or "")
                rows += [(name, i, *b, None) for i, b in enumerate(found)] or [(name, None, None, None, None, error)]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[key, "ordinal", "kind", "section", "text", "error"])

    return pages.select(key, column).mapInArrow(run, f"{key} long, ordinal int, kind string, section string, text string, error string")


# Encodings that a page may declare, by Python's names; what browsers read as another.
ENCODINGS = (
    "utf-8 utf-16-le utf-16-be cp866 koi8-r koi8-u mac-roman iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 iso8859-8 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 "
    "cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 gbk gb18030 big5 euc_jp iso2022_jp shift_jis euc_kr"
).split()
READ_AS = {"iso8859-1": "cp1252", "ascii": "cp1252"}
#: Bytes in which a declaration is looked for.
DECLARED_WITHIN = 2048
_DECLARATIONS = (re.compile(rb"^\s*<\?xml[^>]*?\bencoding\s*=\s*[\"']([\w.:-]+)", re.I), re.compile(rb"<\s*meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([\w.:-]+)", re.I))
CORRUPT = "corrupt_file"


def decoded(content: bytes | None) -> tuple[str | None, str | None, str | None]:
    """A page's text, the encoding that it was read by, and an error.

    UTF-8, with or without its mark, comes first; else what the page declares,
    if it is an encoding of the web and fits every byte.  Null bytes are an
    empty page.
    """
    try:
        return (content or b"").decode("utf-8-sig"), "utf-8", None
    except UnicodeDecodeError:
        pass
    found = next((m for p in _DECLARATIONS if (m := p.search(content[:DECLARED_WITHIN]))), None)
    if found:
        try:
            name = codecs.lookup(found[1].decode("ascii")).name
            name = READ_AS.get(name, name)
            if name in ENCODINGS:
                return content.decode(name), name, None
        except (LookupError, UnicodeDecodeError):
            pass
    return None, None, CORRUPT


def decode_pages(pages: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, text, encoding, error) of pages as bytes, see ``decoded``."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(decoded, batch.column(1).to_pylist()))) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], names=[key, "text", "encoding", "error"])

    return pages.select(key, F.col(column).cast("binary").alias("_content")).mapInArrow(run, f"{key} {kind}, text string, encoding string, error string")
