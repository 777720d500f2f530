"""Lines, sentences, list items, quotes and injected instructions in a text, by code-point offsets from 0; Arrow-batched pandas UDFs.

A line opens a block if it begins with a list marker or with anything but a
small letter; other lines continue the block above.  A sentence never leaves its
block, so a wrapped sentence is whole and a heading is never glued to what
follows.  A block that a marker opens is a list item.  Items right below each
other are introduced by the block above them, if that is one line of text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.batched import per_distinct

#: Bullets, and how numbers or letters mark a list item.
MARKER = re.compile(r"\s*(?:[-•*]|\(?(?:[0-9]{1,2}|[a-z])[.)])\s+")
_STOP = re.compile(r"[.!?](?=\s|$)")

# Wording that addresses a model and not a reader.
ORDERS = "ignore disregard forget override".split()
EARLIER = "previous prior above earlier your".split()
RULES = "instructions prompt prompts rules".split()
SHOWING = "reveal print show output leak".split()
SECRETS = ["api key", "system prompt", "password", "secret", "secrets", "credentials"]
SPEAKERS = "system assistant developer".split()


def _either(words: Iterable[str]) -> str:
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


TRIGGERS = [
    rf"\b{_either(ORDERS)}\s+(?:{_either(['all', 'any', 'the'])}\s+)?{_either(EARLIER)}\s+{_either(RULES)}\b",
    r"\byou\s+are\s+now\b",
    rf"\b{_either(SHOWING)}\s+(?:{_either(['the', 'your'])}\s+)?{_either(SECRETS)}\b",
    rf"^\s*{_either(SPEAKERS)}\s*:",
]
INJECTION = re.compile("|".join(TRIGGERS), re.I | re.M)
#: What an assessed piece of work is called; what it has to do; what it does with content.
WORKS = "specification specifications report reports submission submissions essay essays dissertation dissertations thesis theses proposal proposals portfolio portfolios assignment assignments coursework answer answers appendix abstract abstracts".split()
DUTIES = ["must", "should", "shall", "need to", "needs to", "is required to", "are required to"]
CONTENT = "include contain address discuss cover describe present demonstrate justify explain reflect compare state cite do".split()
#: Fixed value: characters between the work and its duty, within one clause.
REACH = 40
ARTEFACT = re.compile(rf"\b{_either(WORKS)}\b[^.;:\n]{{0,{REACH}}}?\b{_either(DUTIES)}\s+(?:not\s+)?{_either(CONTENT)}\b", re.I)


@dataclass(frozen=True, slots=True)
class Block:
    """A line that opens something and the lines that continue it; ``body`` is behind a list marker."""

    start: int
    end: int
    body: int
    lines: int
    item: bool
    opened: bool


def blocks(text: str) -> list[Block]:
    """The blocks of a text, in order; of the first only is it possible that no line opens it."""
    out: list[Block] = []
    at = 0
    for line in text.split("\n"):
        marker = MARKER.match(line)
        small = line.lstrip()[:1].islower()
        if out and small and not marker:
            last = out[-1]
            out[-1] = Block(last.start, at + len(line), last.body, last.lines + 1, last.item, last.opened)
        else:
            out.append(Block(at, at + len(line), at + (marker.end() if marker else 0), 1, marker is not None, not small or marker is not None))
        at += len(line) + 1
    return out


def block_at(found: list[Block], offset: int) -> int:
    """The number of the block that ``offset`` lies in."""
    return max(i for i, b in enumerate(found) if b.start <= offset or not i)


def _cuts(text: str, block: Block) -> list[int]:
    return [block.start, *(m.end() for m in _STOP.finditer(text, block.body, block.end)), block.end]


def sentence_at(text: str, offset: int) -> tuple[int, int]:
    """The sentence that ``offset`` lies in; what stands between two belongs to the second. A marker's own stop ends none."""
    found = blocks(text)
    block = found[block_at(found, offset)]
    return next(((a, b) for a, b in pairwise(_cuts(text, block)) if offset < b), (_cuts(text, block)[-2], block.end))


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    return start + len(part) - len(part.lstrip()), start + len(part.rstrip())


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """All sentences, bare of white space at their ends, with their list markers."""
    spans = (_trimmed(text, a, b) for block in blocks(text or "") for a, b in pairwise(_cuts(text or "", block)))
    return [(a, b) for a, b in spans if a < b]


def _lead(text: str, found: list[Block], i: int) -> tuple[int, int] | None:
    """The line that introduces the item ``i``."""
    while i and found[i].item:
        i -= 1
    lead = found[i]
    if lead.item or lead.lines > 1 or not lead.opened:
        return None
    start, end = _trimmed(text, lead.start, lead.end)
    return (start, end) if start < end else None


def item_spans(text: str | None) -> list[tuple[int, int, tuple[int, int] | None]]:
    """Every list item with its wrapped lines, white space behind left out, and the line that introduces it."""
    found = blocks(text or "")
    return [(b.start, b.start + len(text[b.start : b.end].rstrip()), _lead(text, found, i)) for i, b in enumerate(found) if b.item]


def items_touched(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The items that a quote touches: the one it begins in, and those whose first line it reaches."""
    found = blocks(text)
    first = block_at(found, start)
    own = [b for i, b in enumerate(found) if b.item and (i == first or i > first and b.start < end)]
    return [(b.start, b.start + len(text[b.start : b.end].rstrip())) for b in own]


def lead_in(text: str, offset: int) -> tuple[int, int] | None:
    """The line that introduces the item at ``offset``; none outside an item."""
    found = blocks(text)
    i = block_at(found, offset)
    return _lead(text, found, i) if found[i].item else None


def artefact_content(text: str, offset: int) -> bool:
    """Whether the sentence at ``offset``, or the line that introduces its list item, says what a piece of work must contain."""
    a, b = sentence_at(text, offset)
    lead = lead_in(text, offset)
    return bool(ARTEFACT.search(text[a:b]) or lead and ARTEFACT.search(text[lead[0] : lead[1]]))


def bare(text: str) -> str:
    """White space collapsed, without a list marker in front."""
    plain = " ".join(text.split())
    marker = MARKER.match(plain)
    return plain[marker.end() :] if marker else plain


# What can close a sentence behind its stop, what can open the next, and words whose stop ends none.
CLOSERS, OPENERS = "\"'”’)]", "\"“‘("
ABBREVIATIONS = ("e.g.", "i.e.", "Dr.", "Prof.", "Mr.", "Mrs.", "Ms.", "cf.", "vs.")
#: Characters up to which a line without a stop, between sentences, is a label of its own.
LABEL_CHARS = 60
_ENDED = re.compile(rf"[.!?][{re.escape(CLOSERS)}]*$")
_PARTED = re.compile(rf"[.!?][{re.escape(CLOSERS)}]*(?=\s+[{re.escape(OPENERS)}]?[A-Z0-9])")


_LINE = re.compile(r"[^\n]+")
#: Lines on end of which none is blank.
_PARAGRAPH = re.compile(r"\S[^\n]*(?:\n[^\S\n]*\S[^\n]*)*")


def _labels(bodies: list[str]) -> list[bool]:
    """Which lines of a paragraph are labels: short, without a stop, before what can begin a sentence, and behind a stop, a label or nothing."""
    ended = [_ENDED.search(body) is not None for body in bodies]
    begins = [body[0].isupper() or body[0].isdigit() for body in bodies[1:]] + [True]
    fit = [not e and n and len(body) <= LABEL_CHARS for e, n, body in zip(ended, begins, bodies)]
    free = [True, *ended[:-1]]
    return list(accumulate(zip(fit, free), lambda before, line: line[0] and (line[1] or before), initial=True))[1:]


def numbered_spans(text: str | None) -> list[tuple[int, int]]:
    """Sentences as a reader would number them: wrapped lines are one run, a short label is a sentence of its own, a blank line ends any."""
    out: list[tuple[int, int]] = []
    for paragraph in _PARAGRAPH.finditer(text or ""):
        lines = [_trimmed(text, *m.span()) for m in _LINE.finditer(text, *paragraph.span())]
        labels = _labels([text[a:b] for a, b in lines])
        # Lines of one run share the number of labels up to them; a label is alone.
        numbers = accumulate(labels)
        for _, group in groupby(zip(lines, labels, numbers), key=lambda x: (x[2], x[1])):
            run = list(group)
            start, end = run[0][0][0], run[-1][0][1]
            stops = [] if run[0][1] else [m.end() for m in _PARTED.finditer(text, start, end) if not text[start : m.end()].endswith(ABBREVIATIONS)]
            out += [spot for spot in (_trimmed(text, a, b) for a, b in pairwise([start, *stops, end])) if spot[0] < spot[1]]
    return out


def quote_spans(text: str | None, quote: str | None) -> list[tuple[int, int]]:
    """Every place of the quote, overlapping ones too; a run of white space matches any run."""
    parts = (quote or "").split()
    if not text or not parts:
        return []
    pattern, out, start = re.compile(r"\s+".join(map(re.escape, parts))), [], 0
    while m := pattern.search(text, start):
        out.append(m.span())
        start = m.start() + 1
    return out


def _suspect(text: str) -> bool:
    """Whether a text has words without which there is no such wording; cheaper than the search itself. Beyond ASCII letters fold in ways that only the search knows."""
    low = text.lower()
    has = lambda words: any(w in low for w in words)
    return not text.isascii() or has(ORDERS) and has(RULES) or "you" in low and "now" in low or has(SHOWING) or ":" in low and has(SPEAKERS)


def injected_spans(text: str | None) -> list[tuple[int, int]]:
    """From the start of the sentence or line with such wording to the end of its line, so that what follows it there is inside."""
    out = []
    for m in INJECTION.finditer(text) if text and _suspect(text) else ():
        stops = [s.end() for s in re.finditer(r"[.!?](?=\s)|\n", text[: m.start() + 1]) if s.end() <= m.start()]
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        start = stops[-1] if stops else 0
        out.append((_trimmed(text, start, end)[0], end))
    return out


_INT = T.IntegerType()
_SPAN = T.ArrayType(T.StructType([T.StructField("start", _INT), T.StructField("end", _INT)]))


def _as_structs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def _quotes(text: str | None, quote: str | None) -> list[dict]:
    return _as_structs(quote_spans(text, quote))


def _injections(text: str | None) -> list[dict]:
    return _as_structs(injected_spans(text))


quotes, injections = per_distinct(_quotes, _SPAN), per_distinct(_injections, _SPAN)
#: The same where a filter on them follows.
quotes_once, injections_once = per_distinct(_quotes, _SPAN, once=True), per_distinct(_injections, _SPAN, once=True)


@F.pandas_udf(_SPAN)
def sentences(text: pd.Series) -> pd.Series:
    return pd.Series([_as_structs(sentence_spans(t)) for t in text])


def list_items(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, item from 0, start, end, lead_start, lead_end) a list item; one Arrow pass without a shuffle. Null texts have none."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, a, b, *(lead or (None, None))) for i, t in enumerate(batch.column(1).to_pylist()) for n, (a, b, lead) in enumerate(item_spans(t))]
            numbers = [pa.array(c, pa.int32()) for c in zip(*rows)] if rows else [pa.array([], pa.int32())] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(numbers[0]), *numbers[1:]], [key, "item", "start", "end", "lead_start", "lead_end"])

    return texts.select(key, F.col(text).alias("_text")).mapInArrow(run, f"{key} {kind}, item int, start int, end int, lead_start int, lead_end int")


def numbered_sentences(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, sentence, start, end, said) a sentence, S001 on in order, white space collapsed in ``said``; an Arrow pass without a shuffle. Null texts have none."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, f"S{n:03}", a, b, " ".join(t[a:b].split())) for i, t in enumerate(batch.column(1).to_pylist()) for n, (a, b) in enumerate(numbered_spans(t), 1)]
            which, names, starts, ends, said = zip(*rows) if rows else ((),) * 5
            columns = [pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(said, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *columns], [key, "sentence", "start", "end", "said"])

    return texts.select(key, F.col(text).alias("_text")).mapInArrow(run, f"{key} {kind}, sentence string, start int, end int, said string")
