"""Substring dedup by repeated-phrase automata.

A word is removed when some window of 20 consecutive words that covers it also
starts earlier in the corpus (smaller doc_id, or earlier in the same document).

1. *Phrases.*  Of the ten-word phrases inside a window the one with the least
   hash is its core; equal windows have equal cores, and about one word in six
   starts one.  Cores are counted over the whole corpus.
2. *Neighbourhoods.*  Every document is read again, and the words of all windows
   around each recurring core are written.  A Bloom filter sized by the number
   of such cores spares most others; it only ever lets too much through.
3. *Automata.*  The neighbourhoods of a core go to one shard, where equal ones
   count once; all but the first of them are repeats as a whole.  A shard
   compiles the phrases that stand in different neighbourhoods into an
   Aho-Corasick automaton over words, streams the neighbourhoods through it,
   and compares windows by the first occurrence that it locates in each.
4. The neighbourhoods of a core that has more than a shard's rows are salted
   over several shards; what is first in each of them meets in an aggregation.

Streaming every whole document through every shard would cost documents times
shards, so only neighbourhoods of recurring cores are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import vectext as V
from quillspan.llm.tables import cut

WINDOW = 20
CORE = 10
#: Neighbourhoods that a shard holds on average; the cores with more are salted.
SHARD_ROWS = 10_000
#: Bits of the Bloom filter for each recurring core, and of the whole filter at most (64 MB) and at least, as powers of two.
CORE_BITS, MOST_BITS, LEAST_BITS = 16, 29, 20

_LAST = (1 << 63) - 1


def _slide(a: np.ndarray, size: int, best) -> np.ndarray:
    """best() over each run of ``size`` entries, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        a = best(a[: len(a) - step], a[step:])
        have += step
    return a


def cores(hashes: np.ndarray, first: np.ndarray, window: int, core: int):
    """Core phrases of every window: their hash, first word, and first and last window start; all as word indexes."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return np.zeros(0, np.uint64), none, none, none
    span = window - core + 1
    grams = V.window_hashes(hashes, core)
    least = _slide(grams, span, np.minimum)
    valid = np.zeros(len(least), dtype=bool)
    valid[V.windows(first, window)[0]] = True
    padded = np.zeros(len(grams) + span - 1, dtype=np.uint64)
    padded[span - 1 : span - 1 + len(least)] = np.where(valid, least, 0)
    at = np.flatnonzero(_slide(padded, span, np.maximum) == grams)
    at = at[grams[at] > 0]
    near = at[:, None] + np.arange(-span + 1, 1)
    mine = (near >= 0) & (near < len(least))
    near = np.clip(near, 0, len(least) - 1)
    mine &= valid[near] & (least[near] == grams[at][:, None])
    lo, hi = mine.argmax(axis=1), span - 1 - mine[:, ::-1].argmax(axis=1)
    rows = np.arange(len(at))
    return grams[at], at, near[rows, lo], near[rows, hi]


def _words(column: pa.Array):
    buf, offsets = V.raw(column)
    starts, ends, first = V.word_bounds(buf, offsets)
    return buf, starts, ends, first, V.span_hashes(buf, starts, ends)


def _core_counts(window: int, core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, "text"):
            _, _, _, first, hashes = _words(batch.column("text"))
            seeds, counts = np.unique(cores(hashes, first, window, core)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(counts, pa.int64())], names=["core", "n"])

    return run


def _probes(values: np.ndarray, bits: int) -> list[np.ndarray]:
    a, b = V.mix64(values), V.mix64(values ^ np.uint64(0x5851F42D4C957F2D))
    return [(x >> np.uint64(64 - bits)).astype(np.int64) for x in (a, b)]


def _bloom_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 6), dtype=np.uint64)
        for batch in batches:
            values = batch.column("core").to_numpy().view(np.uint64)
            for p in _probes(values, bits):
                np.bitwise_or.at(table, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
        at = np.flatnonzero(table)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part].view(np.int64))], names=["word", "bits"])

    return run


def bloom(values: DataFrame, bits: int):
    """A broadcast Bloom filter over the column ``core``, of fixed size."""
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    rows = values.mapInArrow(_bloom_words(bits), "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return values.sparkSession.sparkContext.broadcast(table)


def _neighbourhoods(window: int, core: int, shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, "text"):
            buf, starts, ends, first, hashes = _words(batch.column("text"))
            seeds, at, lo, hi = cores(hashes, first, window, core)
            keep = np.ones(len(seeds), dtype=bool)
            for p in _probes(seeds, bits):
                keep &= (shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
            seeds, at, lo, hi = seeds[keep], at[keep], lo[keep], hi[keep]
            owner = np.searchsorted(first, at, side="right") - 1
            data = buf.tobytes()
            texts = [data[a:b] for a, b in zip(starts[lo].tolist(), ends[hi + window - 1].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(seeds.view(np.int64)),
                    batch.column("doc").take(pa.array(owner)),
                    batch.column("version").take(pa.array(owner)),
                    pa.array((lo - first[owner]).astype(np.int32)),
                    pa.array((at - lo).astype(np.int32)),
                    pa.array(texts, pa.binary()),
                ],
                names=["core", "doc", "version", "start", "inside", "words"],
            )

    return run


def _spans(covered: list[int], window: int) -> Iterator[tuple[int, int]]:
    """Ascending window starts as merged [from, to) word ranges."""
    begin = end = None
    for s in covered:
        if end is None or s > end:
            if end is not None:
                yield begin, end
            begin = s
        end = s + window
    if end is not None:
        yield begin, end


def _lettered(texts: list[bytes]) -> list[str]:
    """The texts with one letter a word, surrogates left out."""
    letters: dict[bytes, str] = {}
    return ["".join([letters.get(w) or letters.setdefault(w, chr(len(letters) + (0x10000 if len(letters) > 0xD000 else 1))) for w in t.split()]) for t in texts]


def anchored(line: str, hits: list[tuple[int, int]], window: int, core: int) -> Iterator[tuple[int, tuple[int, int, str]]]:
    """Each window of a line that holds a located phrase: its start and its identity, the first such phrase, where it lies, and the words around it."""
    k = 0
    for s in range(len(line) - window + 1):
        while k < len(hits) and hits[k][0] < s:
            k += 1
        if k < len(hits) and hits[k][0] + core <= s + window:
            at, phrase = hits[k]
            yield s, (phrase, at - s, line[s:at] + line[at + core : s + window])


def _shard(window: int, core: int):
    def run(table: pa.Table) -> pa.Table:
        """Compiles the shard's phrases, streams its neighbourhoods, and gives the words that occur earlier in it.

        Of salted cores it also gives each window at its first place in the
        shard (``words``), to be compared with the other shards.
        """
        docs, versions, starts, salted = (table.column(c).to_pylist() for c in ("doc", "version", "start", "salted"))
        alike: dict[tuple[bytes, int], list[int]] = {}
        for row, key in enumerate(zip(table.column("words").to_pylist(), table.column("inside").to_pylist())):
            alike.setdefault(key, []).append(row)
        lines = _lettered([text for text, _ in alike])
        phrases: dict[str, list[int]] = {}
        for k, ((_, inside), line) in enumerate(zip(alike, lines)):
            phrases.setdefault(line[inside : inside + core], []).append(k)
        firsts = [min((docs[r], starts[r], r) for r in rows) for rows in alike.values()]
        out: list[tuple] = []
        for line, rows, (doc, start, _) in zip(lines, alike.values(), firsts):
            out += [(docs[r], versions[r], starts[r], starts[r] + len(line), None) for r in rows if (docs[r], starts[r]) > (doc, start)]
        automaton = ahocorasick.Automaton()
        streamed: list[int] = []
        for number, (phrase, members) in enumerate(phrases.items()):
            # A phrase of one neighbourhood has no window elsewhere.
            if len(members) > 1 or salted[firsts[members[0]][2]]:
                automaton.add_word(phrase, number)
                streamed += members
        if len(automaton):
            automaton.make_automaton()
            texts = list(alike)
            earliest: dict[tuple, tuple[int, int]] = {}
            found = []
            for k in streamed:
                doc, start, _ = firsts[k]
                windows = list(anchored(lines[k], [(end - core + 1, n) for end, n in automaton.iter(lines[k])], window, core))
                found.append(windows)
                for s, identity in windows:
                    place = earliest.get(identity)
                    if place is None or (doc, start + s) < place:
                        earliest[identity] = (doc, start + s)
            for k, windows in zip(streamed, found):
                doc, start, first = firsts[k]
                covered = [start + s for s, identity in windows if earliest[identity] < (doc, start + s)]
                spans = list(_spans(covered, window))
                words = texts[k][0].split() if salted[first] else []
                # The first, and what the same document given twice has there.
                for version in {versions[r] for r in alike[texts[k]] if (docs[r], starts[r]) == (doc, start)}:
                    out += [(doc, version, a, b, None) for a, b in spans]
                    if words:
                        out += [(doc, version, start + s, start + s + window, b" ".join(words[s : s + window])) for s, identity in windows if earliest[identity] == (doc, start + s)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc", "version", "a", "b", "words"])

    return run


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in V.slices(batches, "text"):
        buf, offsets = V.raw(batch.column("text"))
        starts, ends, first = V.word_bounds(buf, offsets)
        spans = batch.column("spans")
        flat = spans.flatten()
        owner = np.repeat(np.arange(len(spans)), np.asarray(pc.fill_null(pc.list_value_length(spans), 0)))
        depth = np.zeros(len(starts) + 1, dtype=np.int64)
        np.add.at(depth, first[owner] + np.asarray(flat.field("a")), 1)
        np.add.at(depth, first[owner] + np.asarray(flat.field("b")), -1)
        keep = np.cumsum(depth[:-1]) == 0
        data, rows = buf.tobytes(), []
        for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
            at = np.flatnonzero(keep[low:high]) + low
            kept = b" ".join([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            rows.append((high - low, high - low - len(at), hashlib.sha256(kept).hexdigest(), kept))
        n, gone, digest, kept = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _strip(batches):
        yield batch.select(["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, core: int = CORE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Word ranges [a, b) that earlier text repeats: doc, version (the text's hash), a, b; ranges may overlap."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text").withColumn("version", F.xxhash64("text"))
    counted = texts.select("text").mapInArrow(_core_counts(window, core), "core long, n long")
    recurring = cut(counted.groupBy("core").agg(F.sum("n").alias("n")).where("n > 1"), "cores")
    bits = min(MOST_BITS, max(LEAST_BITS, (CORE_BITS * recurring.count()).bit_length()))
    shape = "core long, doc long, version long, start int, inside int, words binary"
    near = texts.mapInArrow(_neighbourhoods(window, core, bloom(recurring, bits), bits), shape)
    # Few cores are salted, so Catalyst broadcasts them or, beyond its threshold, joins.
    hot = cut(recurring.where(F.col("n") > shard_rows).select("core", F.ceil(F.col("n") / shard_rows).alias("salts")), "hot")
    near = cut(near.join(hot, "core", "left"), "neighbourhoods")
    shards = max(64, near.count() // shard_rows)
    whole, part = F.pmod(F.xxhash64("core"), F.lit(shards)), F.pmod(F.xxhash64("doc", "start"), F.col("salts"))
    streamed = near.withColumn("salted", F.col("salts").isNotNull()).withColumn("shard", F.when(F.col("salted"), F.xxhash64("core", part)).otherwise(whole))
    streamed = streamed.select("shard", "doc", "version", "start", "inside", "salted", "words")
    found = cut(streamed.groupBy("shard").applyInArrow(_shard(window, core), "doc long, version long, a long, b long, words binary"), "found")
    apart = found.where("words is not null")
    earliest = apart.groupBy("words").agg(F.min(F.struct("doc", "a")).alias("first"), F.count("*").alias("k")).where("k > 1")
    later = apart.join(earliest, "words").where(F.struct("doc", "a") > F.col("first"))
    return found.where("words is null").drop("words").union(later.select("doc", "version", "a", "b"))


def _with_spans(docs: DataFrame, **options) -> DataFrame:
    spans = cut(repeated_spans(docs, **options), "spans")
    per = spans.groupBy("doc", "version").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = texts.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST))).withColumn("version", F.xxhash64("text"))
    return keyed.join(per, ["doc", "version"], "left").select("doc_id", "text", "spans")


def substring_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256.

    Reads only ``doc_id`` and ``text``.  A null text has no words.  Rows
    without ``doc_id`` come after all others and are one document's texts.
    Rows that repeat a ``doc_id`` stand at the same place: neither is earlier.
    """
    return _with_spans(docs, **options).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def kept_texts(docs: DataFrame, **options) -> DataFrame:
    """The same rows with ``kept_text``, the words that stay joined by one space."""
    return _with_spans(docs, **options).mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
