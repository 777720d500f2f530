"""Provenance-preserving chunks: offsets into a version's text that follow its spans.

The packing is a greedy fold over one version's units, so each version is one
Arrow row: its text and its spans.  Sizes are estimated tokens (characters / 4,
rounded up).  All boundaries of a text come from one pass over its white space.
"""

from __future__ import annotations

import bisect
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.intervals import containment_join, merged, uncovered
from quillspan.tables import settled

_SPACES = re.compile(r"\s+")
#: Boundary ranks, best first: a span's start, a blank line, a line, a sentence, a space.
SPAN, PARAGRAPH, LINE, SENTENCE, SPACE = range(5)
#: Characters of a bucket in joins of ranges of one text.
GAP_WIDTH = 4096
SLIDE_KINDS = ("slide_text", "slide_notes")


@dataclass(frozen=True)
class Sizes:
    """Bounds in estimated tokens. Fixed values of the published chunker versions are the instances below."""

    target: int = 800
    hard: int = 1000
    overlap: int = 120
    split_above: int = 880
    least: int = 200
    piece_least: int = 400
    chars: int = 4

    def tokens(self, length: int) -> int:
        return -(-length // self.chars)


SPAN_PACK = Sizes()
SPAN_PACK_SMALL = Sizes(600, 800, 100, 680, 160, 400)


@dataclass(frozen=True)
class Unit:
    start: int
    end: int
    span: int
    heading: bool
    slide: int | None


class Breaks:
    """Where a text can be parted: its white space, listed apart by kind, best kind first; each list ascends."""

    KINDS = (PARAGRAPH, LINE, SENTENCE, SPACE)

    def __init__(self, text: str):
        self.begins: dict[int, list[int]] = {kind: [] for kind in self.KINDS}
        self.ends: dict[int, list[int]] = {kind: [] for kind in self.KINDS}
        for space in _SPACES.finditer(text):
            inside = space[0]
            if "\n" in inside:
                kind = PARAGRAPH if "\n\n" in inside else LINE
            else:
                kind = SENTENCE if text[max(space.start() - 1, 0)] in ".!?" else SPACE
            self.begins[kind].append(space.start())
            self.ends[kind].append(space.end())

    def last(self, kind: int, low: int, high: int) -> tuple[int, int] | None:
        """The last white space of a kind that begins from low to high."""
        i = bisect.bisect_right(self.begins[kind], high) - 1
        return (self.begins[kind][i], self.ends[kind][i]) if i >= 0 and self.begins[kind][i] >= low else None

    def part(self, begin: int, low: int, high: int) -> tuple[int, int]:
        """Where a piece from ``begin`` ends and the next begins: the best kind between low and high, of it the last; else the last before; else high itself."""
        fit = next((spot for kind in self.KINDS if (spot := self.last(kind, low, high))), None)
        before = [spot for kind in self.KINDS if (spot := self.last(kind, begin + 1, low - 1))]
        return fit or max(before, default=(high, high))

    def ranked_ends(self) -> list[tuple[int, int]]:
        return [(end, kind) for kind in self.KINDS for end in self.ends[kind]]


def units(text: str, spans: list[tuple[str, int | None, int, int]], sizes: Sizes, breaks: Breaks | None = None) -> list[Unit]:
    """Visible parts of the spans (kind, slide, start, end); those above the bound are dealt into pieces."""
    breaks = breaks or Breaks(text)
    least, target = sizes.piece_least * sizes.chars, sizes.target * sizes.chars
    out = []
    for number, (kind, slide, start, end) in enumerate(spans):
        visible = text[start:end].strip()
        if not visible:
            continue
        begin = text.index(visible, start)
        end = begin + len(visible)
        edges = [begin]
        while sizes.tokens(end - edges[-1]) > sizes.split_above:
            edges += breaks.part(edges[-1], edges[-1] + least, edges[-1] + target)
        edges.append(end)
        own = slide if kind in SLIDE_KINDS else None
        out += [Unit(a, b, number, kind == "heading", own) for a, b in zip(edges[::2], edges[1::2])]
    return out


def groups(parts: list[Unit]) -> list[list[Unit]]:
    """Units that stay together: neighbours on one slide; headings with what follows them."""
    out: list[list[Unit]] = []
    for u in parts:
        last = out[-1][-1] if out else None
        same_slide = last is not None and u.slide is not None and last.slide == u.slide
        after_heading = out and all(x.heading for x in out[-1])
        if same_slide or after_heading:
            out[-1].append(u)
        else:
            out.append([u])
    return out


def _places(breaks: Breaks, parts: list[Unit]) -> list[tuple[int, int]]:
    """Where a chunk may begin anew, ascending, with ranks: the first unit of each span, and the ends of white space."""
    spans: dict[int, int] = {}
    for u in parts:
        spans.setdefault(u.span, u.start)
    return sorted([(at, SPAN) for at in spans.values()] + breaks.ranked_ends())


def _shared_from(places: list[tuple[int, int]], closed: tuple[int, int], upto: int, sizes: Sizes) -> int:
    """Where the next chunk, which reaches ``upto``, begins within the tail of the closed one; its end if there is no place."""
    room = sizes.chars * sizes.overlap, sizes.chars * sizes.hard
    earliest = max(closed[0] + 1, closed[1] - room[0], upto - room[1])
    tail = places[bisect.bisect_left(places, (earliest, SPAN)) : bisect.bisect_left(places, (closed[1], SPAN))]
    return min(tail, key=lambda place: (place[1], place[0]))[0] if tail else closed[1]


def _with_tail(chunks: list[tuple[int, int]], sizes: Sizes) -> list[tuple[int, int]]:
    """A last chunk below the least size joins the one before it, where both stay within the bound."""
    if len(chunks) < 2:
        return chunks
    *head, (begin, _), (tail_begin, end) = chunks
    small, whole = sizes.tokens(end - tail_begin) < sizes.least, sizes.tokens(end - begin) <= sizes.hard
    return [*head, (begin, end)] if small and whole else chunks


def pack(text: str, spans: list[tuple[str, int | None, int, int]], sizes: Sizes = SPAN_PACK) -> list[tuple[int, int]]:
    """Chunk ranges of one version, in order; empty if nothing is visible.

    Groups of units are taken while they keep the chunk within the target; a
    chunk below the least size may grow to the bound.  A new chunk begins in the
    tail of the last one, but a heading or a new slide begins bare.  A group
    beyond the bound is dealt out unit by unit.
    """
    breaks = Breaks(text)
    parts = units(text, spans, sizes, breaks)
    places = _places(breaks, parts)
    queue = deque(groups(parts))
    chunks: list[tuple[int, int]] = []
    before: Unit | None = None  # the last unit taken; the last chunk ends with it
    while queue:
        group = queue.popleft()
        if before is not None:
            start, end = chunks[-1]
            most = sizes.hard if sizes.tokens(end - start) < sizes.least else sizes.target
            if sizes.tokens(group[-1].end - start) <= most:
                chunks[-1], before = (start, group[-1].end), group[-1]
                continue
        if sizes.tokens(group[-1].end - group[0].start) > sizes.hard:
            queue.extendleft([u] for u in reversed(group[1:]))
            group = group[:1]
        lead, last = group[0], group[-1]
        bare = before is None or lead.heading or lead.slide is not None and lead.slide != before.slide
        start = lead.start
        if not bare:
            shared = _shared_from(places, chunks[-1], last.end, sizes)
            start = shared if shared < chunks[-1][1] else start
        chunks.append((start, last.end))
        before = last
    return _with_tail(chunks, sizes)


_CHUNKS = "{key} long, chunk_ordinal int, start_offset long, end_offset long, first_span int, last_span int, estimated_tokens long, text_hash string"


def chunk_documents(versions: DataFrame, key: str, sizes: Sizes = SPAN_PACK) -> DataFrame:
    """Chunks of every version: rows (key, text, spans array of struct(kind, slide, start, end)) to one row a chunk."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text, spans in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                marks = [(s["kind"], s["slide"], s["start"], s["end"]) for s in spans or ()]
                begins = [m[2] for m in marks]
                for n, (a, b) in enumerate(pack(text or "", marks, sizes)):
                    first, final = bisect.bisect_right(begins, a) - 1, bisect.bisect_right(begins, b - 1) - 1
                    rows.append((name, n, a, b, first, final, sizes.tokens(b - a), hashlib.sha256(text[a:b].encode()).hexdigest()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            columns = list(zip(*rows)) if rows else [[]] * 8
            names = [key, "chunk_ordinal", "start_offset", "end_offset", "first_span", "last_span", "estimated_tokens", "text_hash"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return versions.select(key, "text", "spans").mapInArrow(run, _CHUNKS.format(key=key))


def violations(chunks: DataFrame, versions: DataFrame, key: str, sizes: Sizes = SPAN_PACK) -> DataFrame:
    """Chunks that break the contract, with the first problem: (key, chunk_ordinal, problem); none may be left.

    not_numbered, not_increasing, not_its_text, too_large, white_edges,
    wrong_spans (the first or last span is not the one that it begins or ends
    in); with no chunk number uncovered_text, for visible text in no chunk.
    """
    w = Window.partitionBy(key).orderBy("chunk_ordinal")
    start, end = F.col("start_offset"), F.col("end_offset")
    piece = F.substring(F.col("text"), start.cast("int") + 1, (end - start).cast("int"))
    placed = chunks.withColumns({"_a": F.lag("start_offset").over(w), "_b": F.lag("end_offset").over(w), "_n": F.row_number().over(w) - 1})
    joined = placed.join(versions.select(key, "text", "spans"), key).withColumn("piece", piece)
    first, last = F.get("spans", F.col("first_span")), F.get("spans", F.col("last_span"))
    inside = (first["start"] <= start) & (start < first["end"]) & (last["start"] < end) & (end <= last["end"])
    problems = {
        "not_numbered": F.col("chunk_ordinal") != F.col("_n"),
        "not_increasing": (start <= F.col("_a")) | (end <= F.col("_b")),
        "not_its_text": F.sha2("piece", 256) != F.col("text_hash"),
        "too_large": (F.col("estimated_tokens") > sizes.hard) | (F.col("estimated_tokens") != F.ceil(F.length("piece") / sizes.chars)),
        "white_edges": F.col("piece").rlike("(?U)^\\s|\\s$"),
        "wrong_spans": ~F.coalesce(inside, F.lit(False)),
    }
    problem = F.coalesce(*[F.when(test, F.lit(name)) for name, test in problems.items()])
    wrong = joined.select(key, "chunk_ordinal", problem.alias("problem")).where("problem is not null")
    missed = uncovered_text(chunks.select(key, start.alias("start"), end.alias("end")), versions, key)
    return wrong.unionByName(missed.select(key, F.lit("uncovered_text").alias("problem")), allowMissingColumns=True)


def uncovered_text(ranges: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, start, end) of visible text that no range (key, start, end) covers, from the first to the last visible character."""
    whole = texts.select(key, F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"))
    gaps = uncovered(whole, ranges, [key], GAP_WIDTH).join(texts.select(key, "text"), key)
    part = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    edge = [F.length(F.regexp_extract(part, pattern, 0)) for pattern in ("(?U)^\\s*", "(?U)\\s*$")]
    visible = gaps.where(part.rlike("(?U)\\S"))
    return visible.select(key, (F.col("start") + edge[0]).alias("start"), (F.col("end") - edge[1]).alias("end"))


def chunk_measures(chunks: DataFrame, spans: DataFrame, texts: DataFrame, key: str, sizes: Sizes = SPAN_PACK) -> DataFrame:
    """Eighteen measures of the chunks of every version and, with a null key, of all: figures of the rows, not of the versions' figures.

    ``chunks``: key, start, end, first_span, last_span; ``spans``: key, ordinal,
    start, end; ``texts``: key, text.  A version without chunks counts with its
    spans and text.  Ratios are null where nothing divides them.
    """
    size = F.col("end") - F.col("start")
    visible = lambda t: F.length(F.regexp_replace(t, "(?U)\\s", "")).cast("long")
    part = lambda t, s, e: F.substring(t, s.cast("int") + 1, (e - s).cast("int"))
    bare = spans.join(texts.select(key, "text"), key).withColumn("_p", part(F.col("text"), F.col("start"), F.col("end")))
    lead, tail = (F.length(F.regexp_extract("_p", pattern, 0)) for pattern in ("(?U)^\\s*", "(?U)\\s*$"))
    seen = F.col("_p").rlike("(?U)\\S")
    # Read four times below, so cut out of the texts once.
    bare = settled(bare.select(key, "ordinal", seen.alias("_seen"), F.when(seen, F.col("start") + lead).alias("start"), F.when(seen, F.col("end") - tail).alias("end")))
    inner = bare.where("_seen").select(key, "ordinal", "start", "end")
    held = containment_join(inner, chunks.select(key, "start", "end"), [key], GAP_WIDTH).select(key, F.col("a_ordinal").alias("ordinal")).distinct().withColumn("_held", F.lit(True))
    per_span = bare.join(held, [key, "ordinal"], "left").groupBy(key).agg(F.count("*").alias("spans"), F.count_if("_seen").alias("visible_spans"), F.count_if(F.col("_seen") & F.col("_held").isNull()).alias("split_spans"))
    first = inner.select(key, F.col("ordinal").alias("first_span"), F.col("start").alias("_from"))
    last = inner.select(key, F.col("ordinal").alias("last_span"), F.col("end").alias("_to"))
    edged = chunks.join(first, [key, "first_span"], "left").join(last, [key, "last_span"], "left")
    edges = F.coalesce((F.col("start") > F.col("_from")).cast("int"), F.lit(0)) + F.coalesce((F.col("end") < F.col("_to")).cast("int"), F.lit(0))
    rows = edged.select(key, size.alias("_size"), F.ceil(size / sizes.chars).alias("_tokens"), (F.col("last_span") - F.col("first_span") + 1).alias("_spans"), edges.alias("_edges"))
    per_chunk = rows.rollup(key).agg(
        F.grouping(key).alias("_all"),
        F.count("*").alias("chunks"),
        F.min("_tokens").alias("tokens_min"),
        F.expr("percentile_disc(0.5) within group (order by _tokens)").cast("long").alias("tokens_p50"),
        F.expr("percentile_disc(0.95) within group (order by _tokens)").cast("long").alias("tokens_p95"),
        F.max("_tokens").alias("tokens_max"),
        F.count_if(F.col("_tokens") >= sizes.target).alias("at_target"),
        F.count_if(F.col("_tokens") == sizes.hard).alias("at_hard"),
        F.round(F.avg("_spans"), 6).alias("spans_per_chunk"),
        F.max("_spans").alias("spans_per_chunk_max"),
        F.sum("_edges").alias("edges_inside"),
        F.sum("_size").alias("chunk_chars"),
    )
    islands = merged(chunks.select(key, "start", "end"), [key]).groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("_i"))
    long_ = F.lit(0).cast("long")
    texted = texts.select(key, "text").join(islands, key, "left").select(
        key,
        visible(F.col("text")).alias("visible_chars"),
        F.coalesce(F.aggregate("_i", long_, lambda n, i: n + i["end"] - i["start"]), long_).alias("covered_chars"),
        F.coalesce(F.aggregate("_i", long_, lambda n, i: n + visible(part(F.col("text"), i["start"], i["end"]))), long_).alias("covered_visible_chars"),
        F.length("text").cast("long").alias("_length"),
    )
    counts = ["spans", "visible_spans", "split_spans", "visible_chars", "covered_chars", "covered_visible_chars", "_length"]
    totals = texted.join(per_span, key, "left").na.fill(0, counts).rollup(key).agg(F.grouping(key).alias("_all"), *[F.sum(c).alias(c) for c in counts])
    both = totals.alias("t").join(per_chunk.alias("c"), F.col(f"t.{key}").eqNullSafe(F.col(f"c.{key}")) & (F.col("t._all") == F.col("c._all")), "left").drop(F.col(f"c.{key}"), F.col("c._all"))
    zero = ["chunks", "at_target", "at_hard", "edges_inside", "chunk_chars"]
    both = both.na.fill(0, zero)
    unique, seen_chars = F.nullif("covered_chars", F.lit(0)), F.nullif("visible_chars", F.lit(0))
    return both.select(
        key, "chunks", "spans", "visible_spans", "tokens_min", "tokens_p50", "tokens_p95", "tokens_max", "at_target", "at_hard", "spans_per_chunk", "spans_per_chunk_max", "split_spans", "edges_inside", "chunk_chars", "covered_chars",
        F.round(F.col("chunk_chars") / unique, 6).alias("duplication"),
        F.round((F.col("chunk_chars") - F.col("covered_chars")) / unique, 6).alias("overlap_extra"),
        "visible_chars", "covered_visible_chars",
        F.round(F.col("covered_visible_chars") / seen_chars, 6).alias("visible_coverage"),
        (F.col("_length") - F.col("covered_chars") - (F.col("visible_chars") - F.col("covered_visible_chars"))).alias("uncovered_white"),
    )
