"""Fuzzy line dedup by MinHash: one line of each group of near-equal lines stays.

Lines are compared with A-Z lower-cased, as sets of eight-character shingles (UTF-16 units).
One-permutation hashing with optimal densification (Shrivastava, 2017) gives 64
minhashes for one hash a character; 16 bands of four propose lines of
similarity 0.75 with probability 0.998.  Candidates are confirmed by exact
Jaccard similarity, and of each connected component the first line (smallest
doc_id, then line number) stays.  Equal lines are one node throughout; a line
is known by a 64-bit hash of its units.

One changed character costs eight shingles on each side, too much for lines
under 63 units.  Lines of 16 to 64 units are therefore also linked where they
are equal once at most one unit of each is left out; hashes of the line and of
all that is left of it without one unit find these links, each and no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import vectext as V
from quillspan.llm.keys import bucket_count, shared_keys
from quillspan.llm.linking import contracted, linked, placed_links, set_sizes
from quillspan.llm.substring_dedup import _probes, bloom
from quillspan.llm.tables import cut, versioned

#: Units of a shingle: two 64-bit words, which hash without a loop over the units.
SHINGLE = 8
BINS, BANDS = 64, 16
#: Similarity: 100 * intersection >= PERCENT * union.
PERCENT = 75
BLOOM_BITS = 26
#: Units of the lines that one edit links, least and most; from 63 on the shingles allow for one.
EDIT_LEAST, EDIT_MOST = 16, 64
_PIECE = 1 << 14


def _since(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def line_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between newlines, and the index of each text's first line."""
    newline = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([offsets[:-1], newline + 1]), kind="stable")
    ends = np.sort(np.concatenate([newline, offsets[1:]]), kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(offsets, newline, side="right") - 1, minlength=len(offsets) - 1) + 1)])
    return starts, ends, first


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts as UTF-16 units on end, and where each begins; bytes that are not UTF-8 count as ``?``."""
    buf, offsets = V.raw(column, lower=True)
    if len(buf) and buf.max() >= 0x80:
        try:
            text = buf.tobytes().decode("utf-8")
            # Only bytes that are not ASCII tell units from bytes: a later byte has none, the first of four two.
            wide = np.flatnonzero(buf >= 0x80)
            more = np.where((buf[wide] & 0xC0) == 0x80, -1, np.where(buf[wide] >= 0xF0, 1, 0))
            return np.frombuffer(text.encode("utf-16-le"), dtype="<u2"), offsets + _since(more)[np.searchsorted(wide, offsets)]
        except UnicodeDecodeError:
            buf = np.where(buf < 0x80, buf, 63)
    return buf.astype("<u2"), offsets


def _unit_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the SHINGLE units from each place on."""
    n = len(text) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low = np.ndarray((n,), "<u8", text.data, 0, (2,))
    high = np.ndarray((n,), "<u8", text.data, 8, (2,))
    out = np.empty(n, np.uint64)
    # In pieces that stay in a core's cache.
    for a in range(0, n, _PIECE):
        h = low[a : a + _PIECE] * np.uint64(0x9E3779B97F4A7C15)
        h += high[a : a + _PIECE] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        np.bitwise_xor(h, h >> np.uint64(29), out=out[a : a + _PIECE])
    return out


def shingles(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every shingle within each span of units, and the span of each; shorter spans have none. Spans ascend and do not overlap."""
    counts = np.maximum(ends - starts - SHINGLE + 1, 0)
    some = counts > 0
    edge = np.zeros(max(len(text) - SHINGLE + 2, 1), dtype=np.int8)
    edge[starts[some]] = 1
    edge[(starts + counts)[some]] -= 1
    inside = np.cumsum(edge, dtype=np.int8)[:-1].view(bool)
    return _unit_hashes(text)[inside], np.repeat(np.arange(len(starts)), counts)


def shingle_sets(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every shingle of lines, given as UTF-16 units, and the line of each."""
    ends = np.cumsum([len(x) // 2 for x in lines], dtype=np.int64)
    return shingles(np.frombuffer(b"".join(lines), dtype="<u2"), np.concatenate([[0], ends])[:-1], ends)


def _densifier(bins: int) -> np.ndarray:
    """For each try, the bin that an empty bin copies; fixed for all lines."""
    tries = np.arange(1, 4 * bins + 1, dtype=np.uint64)[:, None] * np.uint64(bins) + np.arange(bins, dtype=np.uint64)
    return (V.mix64(tries) % np.uint64(bins)).astype(np.int64)


def bands(hashes: np.ndarray, owner: np.ndarray, n: int, bins: int, n_bands: int) -> np.ndarray:
    """Band keys of n sets, one row a set, from the sets' hashes; every set has at least one."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * bins, empty, dtype=np.uint64)
    np.minimum.at(sig, owner * bins + (hashes & np.uint64(bins - 1)).view(np.int64), hashes >> np.uint64(6))
    sig = sig.reshape(n, bins)
    real = sig != empty
    row, col = np.nonzero(~real)
    for probe in _densifier(bins):
        if not len(row):
            break
        source = probe[col]
        hit = real[row, source]
        sig[row[hit], col[hit]] = sig[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    if len(row):
        # Not met in practice: what 256 tries missed takes the first filled bin.
        sig[row, col] = sig[row, real[row].argmax(axis=1)]
    sig = sig.reshape(n, n_bands, bins // n_bands)
    key = V.mix64(np.arange(n_bands, dtype=np.uint64) + np.zeros((n, 1), np.uint64))
    for i in range(sig.shape[2]):
        key = V.mix64(key * np.uint64(0x100000001B3) ^ sig[:, :, i])
    return key


def _lines(wanted, bits: int):
    """Every line that is not blank: doc, version, line number, hash, of lines that one edit links the units (``short``), and of lines that the filter lets through too, once a batch (``words``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, "text"):
            buf, offsets = units(batch.column("text"))
            starts, ends, first = line_bounds(buf, offsets)
            solid = _since((buf != 32) & ((buf < 9) | (buf > 13)))
            at = np.flatnonzero(solid[ends] > solid[starts])
            owner = np.searchsorted(first, at, side="right") - 1
            starts, ends = starts[at], ends[at]
            hashes = V.span_hashes(buf, starts, ends)
            data = buf.tobytes()

            def cut_out(these: np.ndarray) -> pa.Array:
                texts = np.full(len(these), None, dtype=object)
                texts[these] = [data[2 * a : 2 * b] for a, b in zip(starts[these].tolist(), ends[these].tolist())]
                return pa.array(texts, pa.binary())

            keep = ends - starts >= SHINGLE
            for p in _probes(hashes, bits):
                keep &= (wanted.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
            keep = np.flatnonzero(keep)
            once = np.zeros(len(at), dtype=bool)
            once[keep[np.unique(hashes[keep], return_index=True)[1]]] = True
            short = (ends - starts >= EDIT_LEAST) & (ends - starts <= EDIT_MOST)
            which = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(which), batch.column("version").take(which), pa.array((at - first[owner]).astype(np.int32)), pa.array(hashes.view(np.int64)), cut_out(short), cut_out(once)],
                names=["doc", "version", "line", "hash", "short", "words"],
            )

    return run


def _band_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Band keys of each batch's distinct lines."""
    for batch in V.slices(batches, "text"):
        buf, offsets = units(batch.column("text"))
        starts, ends, _ = line_bounds(buf, offsets)
        long_ = ends - starts >= SHINGLE
        starts, ends = starts[long_], ends[long_]
        hashes = V.span_hashes(buf, starts, ends)
        one = np.sort(np.unique(hashes, return_index=True)[1])
        hashes = hashes[one]
        keys = bands(*shingles(buf, starts[one], ends[one]), len(one), BINS, BANDS)
        yield keys.reshape(-1), np.repeat(hashes, BANDS)


def edit_keys(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each span of units, and of each span without one of its units; and the span of each hash."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(starts)), sizes)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(owner)) - begin[owner]
    unit = V.mix64(text[starts[owner] + place].astype(np.uint64))
    weight = V.mix64(np.arange(sizes.max(initial=0) + 1, dtype=np.uint64) + np.uint64(1 << 32))
    # Sums before each place, of units where they stand and of units moved one place to the front.
    here = np.concatenate([np.zeros(1, np.uint64), np.cumsum(unit * weight[place + 1])])
    moved = np.concatenate([np.zeros(1, np.uint64), np.cumsum(unit * weight[place])])
    last = begin + sizes
    at = begin[owner] + place
    without = here[at] - here[begin[owner]] + moved[last[owner]] - moved[at + 1]
    whole = here[last] - here[begin]
    length = np.concatenate([sizes, sizes[owner] - 1]).astype(np.uint64)
    return V.mix64(np.concatenate([whole, without]) ^ V.mix64(length)), np.concatenate([np.arange(len(starts)), owner])


def _edit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edit keys of short lines, given as UTF-16 units."""
    for batch in V.slices(batches, "short", V.SLICE_BYTES // 16):
        lines = batch.column("short").to_pylist()
        ends = np.cumsum([len(x) // 2 for x in lines])
        keys, owner = edit_keys(np.frombuffer(b"".join(lines), "<u2"), np.concatenate([[0], ends[:-1]]), ends)
        yield keys, batch.column("hash").to_numpy().view(np.uint64)[owner]


def _edit_links(lines: DataFrame, buckets: int) -> DataFrame:
    """Links (a, b) of short lines one edit apart: the lines of a key to its least."""
    short = lines.where("short is not null").groupBy("hash").agg(F.first("short").alias("short"))
    # About as many keys as a line has units, instead of one for each band.
    keys = cut(shared_keys(short, _edit_pairs, buckets), "edits")
    least = keys.groupBy("key").agg(F.min("hash").alias("lo"))
    links = keys.join(least, "key").where("hash <> lo")
    return cut(links.select(F.col("lo").alias("a"), F.col("hash").alias("b")).distinct(), "edit_links")


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in V.slices(batches, "shingles"):
        sizes = set_sizes(*shingle_sets(batch.column("shingles").to_pylist()), batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), batch.column("shingles")], names=["doc_id", "n", "shingles"])


def removed_lines(docs: DataFrame, percent: int = PERCENT, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """Per document with any: doc, version (the text's hash) and ``lines``, the numbers from 0 of the lines to remove."""
    texts = versioned(docs.select("doc_id", "text")).select("doc", "text", "version")
    buckets = bucket_count(texts, "text")
    members = cut(shared_keys(texts.select("text"), _band_pairs, buckets).select("key", F.col("hash").alias("doc_id")), "members")
    # Of the lines that share a key, a few more by the filter, the units are kept.
    wanted = bloom(members.select(F.col("doc_id").alias("core")).distinct(), bloom_bits)
    lines = cut(texts.mapInArrow(_lines(wanted, bloom_bits), "doc long, version long, line int, hash long, short binary, words binary"), "lines")
    sets = lines.where("words is not null").groupBy(F.col("hash").alias("doc_id")).agg(F.first("words").alias("shingles"))
    sets = cut(sets.mapInArrow(_sized, "doc_id long, n long, shingles binary"), "sets")
    parts = linked(members, sets, percent, shingle_sets)
    edits = _edit_links(lines, buckets)
    if not edits.isEmpty():
        parts = contracted(parts, placed_links(edits, parts))
    grouped = lines.join(parts.withColumnRenamed("node", "hash"), "hash", "left").withColumn("group", F.coalesce("component", "hash"))
    grouped = grouped.select("doc", "version", "line", "group")
    # A null id comes after the largest one.
    place = F.struct("doc", F.col("version").bitwiseAND(F.lit(1)).alias("unnamed"), "line")
    first = grouped.groupBy("group").agg(F.min(place).alias("first"), F.count("*").alias("k")).where("k > 1")
    later = grouped.join(first, "group").where(place > F.col("first"))
    return later.groupBy("doc", "version").agg(F.collect_set("line").alias("lines"))


def _without(text: Column, lines: Column) -> Column:
    """The text without the lines of the given numbers; unchanged where there are none."""
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(lines, i)), "\n")
    return F.when(lines.isNull(), text).otherwise(kept)


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, text without the removed lines.

    Reads only ``doc_id`` and ``text``.  Blank lines stay and count for
    nothing; lines shorter than a shingle match only equal lines, lines from
    EDIT_LEAST units on also those one edit away.  A null text
    has no lines and stays null.  Rows without ``doc_id`` come after all
    others.  Rows that repeat a ``doc_id`` stand at the same place.
    """
    gone = cut(removed_lines(docs, **options), "removed")
    texts = versioned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    joined = texts.join(gone, ["doc", "version"], "left")
    n_lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(F.split("text", "\n", -1)))
    return joined.select(
        "doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), _without(F.col("text"), F.col("lines")).alias("text")
    )


def strip_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns, texts without their removed lines; documents left without any line but blank ones go."""
    gone = cut(removed_lines(docs, **options), "removed")
    names = docs.columns
    keyed = versioned(docs, "__doc", "__version")
    gone = gone.select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("lines").alias("__lines"))
    joined = keyed.join(gone, ["__doc", "__version"], "left")
    out = joined.withColumn("text", _without(F.col("text"), F.col("__lines")))
    return out.where(F.col("__lines").isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(names)
