"""Office files: guards before parsing, and word-processing and slide documents as structural blocks.

Guards look at size, extension and the package (encryption, macros, member
count, unpacked size and ratio) and name the first that fails.  Parsers read
the package's XML with the standard library.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as E

import pyarrow as pa
from pyspark.sql import DataFrame

#: Limits of the guards.
MAX_BYTES, MAX_MEMBERS, MAX_UNPACKED, MAX_RATIO = 50 << 20, 5_000, 500 << 20, 200
# Names of the package formats.
KINDS = {".docx": "word/document.xml", ".pptx": "ppt/presentation.xml", ".html": "", ".htm": "", ".pdf": ""}
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def extension(name: str) -> str:
    found = re.search(r"\.[^./\\]+$", name.lower())
    return found[0] if found else ""


def guard(name: str, data: bytes) -> str | None:
    """The first guard that refuses the file, or None."""
    kind = extension(name)
    if not data:
        return "empty"
    if len(data) > MAX_BYTES:
        return "too_large"
    if kind not in KINDS:
        return "extension"
    if not KINDS[kind]:
        return None
    if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return "encrypted"
    try:
        members = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except zipfile.BadZipFile:
        return "corrupt"
    names = {m.filename for m in members}
    if any(n.lower().endswith("vbaproject.bin") for n in names):
        return "macros"
    if len(members) > MAX_MEMBERS:
        return "too_many_members"
    unpacked = sum(m.file_size for m in members)
    if unpacked > MAX_UNPACKED or unpacked > MAX_RATIO * max(len(data), 1 << 16):
        return "unpacks_too_large"
    return None if KINDS[kind] in names else "not_the_format"


def _text(node: E.Element) -> str:
    """Visible text of a paragraph: tracked deletions and text boxes are left out."""
    out = []

    def walk(e: E.Element) -> None:
        if e.tag in (W + "del", W + "moveFrom", W + "txbxContent", W + "instrText", W + "delText"):
            return
        if e.tag in (W + "t", A + "t"):
            out.append(e.text or "")
        elif e.tag in (W + "tab",):
            out.append("\t")
        elif e.tag in (W + "br", W + "cr", A + "br"):
            out.append("\n")
        for child in e:
            walk(child)

    walk(node)
    return "".join(out).strip()


def _cells(row: E.Element) -> list[str]:
    cells = []
    for cell in row.findall(W + "tc"):
        merged = cell.find(f"{W}tcPr/{W}vMerge")
        if merged is not None and merged.get(W + "val", "continue") == "continue":
            continue
        cells.append(" ".join(" ".join(_text(p) for p in cell.iter(W + "p")).split()))
    return cells


def docx_blocks(data: bytes) -> list[tuple[str, int | None, str | None, str]]:
    """(kind, slide, section, text) of body paragraphs and tables in order; headings open sections."""
    body = E.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(W + "body")
    trail: list[tuple[int, str]] = []
    out = []
    for node in body if body is not None else ():
        path = " > ".join(t for _, t in trail) or "(preamble)"
        if node.tag == W + "p":
            text = _text(node)
            style = node.find(f"{W}pPr/{W}pStyle")
            level = re.fullmatch(r"(?:Title|Heading ?([1-9]))", style.get(W + "val", "")) if style is not None else None
            if text and level:
                depth = int(level[1] or 0)
                trail = [t for t in trail if t[0] < depth] + [(depth, text)]
                out.append(("heading", None, " > ".join(t for _, t in trail), text))
            elif text:
                out.append(("paragraph", None, path, text))
        elif node.tag == W + "tbl":
            rows = [" | ".join(c) for c in map(_cells, node.findall(W + "tr")) if any(c)]
            if rows:
                out.append(("table", None, path, "\n".join(rows)))
    return out


def pptx_blocks(data: bytes) -> list[tuple[str, int | None, str | None, str]]:
    """(kind, slide, section, text): each slide's shapes in order, then its notes; slides count from 1, hidden ones too."""
    package = zipfile.ZipFile(io.BytesIO(data))
    names = set(package.namelist())
    r = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

    def relations(part: str) -> dict[str, str]:
        folder, _, name = part.rpartition("/")
        path = f"{folder}/_rels/{name}.rels"
        if path not in names:
            return {}
        found = {}
        for x in E.fromstring(package.read(path)):
            target = x.get("Target", "")
            parts: list[str] = [] if target.startswith("/") else folder.split("/")
            for step in target.strip("/").split("/"):
                parts = parts[:-1] if step == ".." else [*parts, step]
            found[x.get("Id")] = "/".join(parts)
        return found

    def shapes(part: str, notes: bool) -> str:
        texts = []
        for shape in E.fromstring(package.read(part)).iter(P + "sp"):
            holder = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            if notes and (holder is None or holder.get("type") != "body"):
                continue
            lines = [_text(p) for p in shape.iter(A + "p")]
            if any(lines):
                texts.append("\n".join(filter(None, lines)))
        return "\n".join(texts)

    main = relations("ppt/presentation.xml")
    out = []
    listed = E.fromstring(package.read("ppt/presentation.xml")).iter(P + "sldId")
    for number, slide in enumerate(listed, 1):
        part = main.get(slide.get(r + "id"))
        if part not in names:
            continue
        text = shapes(part, False)
        if text:
            out.append(("slide_text", number, None, text))
        for target in relations(part).values():
            if "notesSlide" in target and target in names and (note := shapes(target, True)):
                out.append(("slide_notes", number, None, note))
    return out


def parse(name: str, data: bytes) -> tuple[list[tuple], str | None]:
    """Blocks and the error that stopped the parse: a guard's, unsupported, corrupt or no_text."""
    refused = guard(name, data)
    if refused:
        return [], refused
    parser = {".docx": docx_blocks, ".pptx": pptx_blocks}.get(extension(name))
    if parser is None:
        return [], "unsupported"
    try:
        found = parser(data)
    except (E.ParseError, KeyError, zipfile.BadZipFile, ValueError):
        return [], "corrupt"
    return found, None if found else "no_text"


def parse_files(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """Rows (name, ordinal, kind, slide, section, text, error) of files such as the binaryFile source gives; failures stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for who, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, error = parse(who or "", data or b"")
                rows += [(who, i, *b, None) for i, b in enumerate(found)] or [(who, None, None, None, None, None, error)]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["name", "ordinal", "kind", "slide", "section", "text", "error"])

    return files.select(name, content).mapInArrow(run, "name string, ordinal int, kind string, slide int, section string, text string, error string")


def make_docx(blocks: list[tuple[str, str]]) -> bytes:
    """A small word-processing file of (style or "", text) paragraphs, with pinned times."""
    from xml.sax.saxutils import escape

    def para(style: str, text: str) -> str:
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{mark}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(para(*b) for b in blocks)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("word/document.xml", (1980, 1, 1, 0, 0, 0)), xml)
    return out.getvalue()
