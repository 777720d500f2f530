"""Benchmark decontamination by greedy string tiling.

Seeds are runs of five words (A-Z lower-cased) that a document and a test item
share, found by running Karp-Rabin hashes; seeds on end are joined to runs
before they are shuffled.  The longest match that no earlier tile touches is
marked again and again; the marked share of the item's words is its coverage,
whatever the order of the passages in the document.  The words of the tiles of
every pair that reaches the coverage are then compared themselves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import vectext as V
from quillspan.llm.substring_dedup import _probes, bloom
from quillspan.llm.tables import cut, named, versioned

#: Words of a seed, which is also the shortest tile; items with fewer words match nothing.
SEED = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Words of all items together up to which their seeds are broadcast (24 bytes each); beyond it they are joined.
BROADCAST_WORDS = 1_000_000
BLOOM_BITS = 26

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Seed pairs that are expanded at once.
_CHUNK = 1 << 21
_RUNS = "doc long, version long, item long, size int, at int, p int, n int"


def runs_of(at: np.ndarray, p: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of seeds (place in document, place in item, seeds) joined where one goes on or overlaps another."""
    order = np.lexsort((at, at - p))
    at, p, end = at[order], p[order], (at + n)[order]
    out: list[tuple[int, int, int]] = []
    for a, q, e in zip(at.tolist(), p.tolist(), end.tolist()):
        if out and out[-1][0] - out[-1][1] == a - q and a <= out[-1][0] + out[-1][2]:
            out[-1] = (*out[-1][:2], max(out[-1][2], e - out[-1][0]))
        else:
            out.append((a, q, e - a))
    return out


def tiles(runs: list[tuple[int, int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Tiles (place in document, place in item, words) from all maximal runs of seeds.

    A match of n words is n - seed + 1 seeds on end; the longest is marked
    first, ties at the smallest places.  What a marked tile cuts goes back on
    the heap as the parts that are left.
    """
    heap = [(-(n + seed - 1), x, y) for x, y, n in runs]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    out: list[tuple[int, int, int]] = []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        free = [x + i not in in_doc and y + i not in in_item for i in range(n)]
        if all(free):
            in_doc.update(range(x, x + n))
            in_item.update(range(y, y + n))
            out.append((x, y, n))
            continue
        begin = None
        for i, ok in enumerate([*free, False]):
            if ok and begin is None:
                begin = i
            elif not ok and begin is not None:
                if i - begin >= seed:
                    heapq.heappush(heap, (begin - i, x + begin, y + begin))
                begin = None
    return out


def _grams(batch: pa.RecordBatch, seed: int):
    buf, offsets = V.raw(batch.column("text"), lower=True)
    starts, ends, first = V.word_bounds(buf, offsets)
    at, owner = V.windows(first, seed)
    return V.window_hashes(V.span_hashes(buf, starts, ends), seed)[at], at - first[owner], owner, np.diff(first)


def _item_seeds(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, "text"):
            grams, place, owner, sizes = _grams(batch, seed)
            which = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.view(np.int64)), batch.column("item").take(which), pa.array(place.astype(np.int32)), pa.array(sizes[owner].astype(np.int32))],
                names=["core", "item", "p", "size"],
            )

    return run


def _joined(owner: np.ndarray, item: np.ndarray, at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first pair of each run of seed pairs on one diagonal of one document and item, in order, and the runs' seeds."""
    order = np.lexsort((at, at - p, item, owner))
    o, i, a, d = owner[order], item[order], at[order], (at - p)[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (o[1:] != o[:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)
    first = np.flatnonzero(fresh)
    return order[first], np.diff(np.append(first, len(order)))


def _pairs_by_index(shared, seed: int):
    """Runs of seeds of each document against the broadcast items: a bitmap, then a sorted index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, item, p, size, bitmap = shared.value
        for batch in V.slices(batches, "text"):
            own, place, owner, _ = _grams(batch, seed)
            maybe = np.flatnonzero(bitmap[(own >> np.uint64(40)).astype(np.int64)])
            low = np.searchsorted(grams, own[maybe], "left")
            many = np.searchsorted(grams, own[maybe], "right") - low
            done = np.concatenate([[0], np.cumsum(many)])
            a = 0
            while a < len(maybe):
                # Runs that such a cut parts are joined again before tiling.
                b = max(a + 1, int(np.searchsorted(done, done[a] + _CHUNK, "right")) - 1)
                hit = np.repeat(low[a:b] - (done[a:b] - done[a]), many[a:b]) + np.arange(done[b] - done[a])
                mine = np.repeat(maybe[a:b], many[a:b])
                first, seeds = _joined(owner[mine], item[hit], place[mine], p[hit])
                mine, hit, a = mine[first], hit[first], b
                which = pa.array(owner[mine])
                columns = [pa.array(item[hit]), pa.array(size[hit]), pa.array(place[mine].astype(np.int32)), pa.array(p[hit]), pa.array(seeds.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(which), batch.column("version").take(which), *columns], names=["doc", "version", "item", "size", "at", "p", "n"])

    return run


def _pairs_by_join(shared, bits: int, seed: int):
    """Document seeds that the Bloom filter of the items' seeds lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, "text"):
            own, place, owner, _ = _grams(batch, seed)
            keep = np.ones(len(own), dtype=bool)
            for q in _probes(own, bits):
                keep &= (shared.value[q >> 6] >> (q & 63).astype(np.uint64)) & np.uint64(1) == 1
            which = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[keep].view(np.int64)), batch.column("doc").take(which), batch.column("version").take(which), pa.array(place[keep].astype(np.int32))],
                names=["core", "doc", "version", "at"],
            )

    return run


_TILED = "doc long, version long, item long, size int, tiles array<struct<at:int,p:int,n:int>>"
_TILES = pa.list_(pa.struct([("at", pa.int32()), ("p", pa.int32()), ("n", pa.int32())]))


def _tile_groups(seed: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column("runs").to_pylist():
                at, p, n = (np.array([x[c] for x in found], dtype=np.int64) for c in ("at", "p", "n"))
                out.append([{"at": x, "p": y, "n": k} for x, y, k in tiles(runs_of(at, p, n), seed)])
            enough = [sum(t["n"] for t in ts) >= coverage * size for ts, size in zip(out, batch.column("size").to_pylist())]
            columns = [batch.column(c) for c in ("doc", "version", "item", "size")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _TILES)], names=["doc", "version", "item", "size", "tiles"]).filter(pa.array(enough, pa.bool_()))

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tiles' words compared themselves: words marked, tiles and the longest of those that are equal."""

    def split(text: str) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()

    for batch in batches:
        rows = []
        for text, own, found in zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist(), batch.column("tiles").to_pylist()):
            a, b = split(text), split(own)
            good = [t["n"] for t in found if a[t["at"] : t["at"] + t["n"]] == b[t["p"] : t["p"] + t["n"]]]
            rows.append((sum(good), len(good), max(good, default=0)))
        marked, count, longest = zip(*rows) if rows else ((), (), ())
        columns = [pa.array(c, pa.int32()) for c in (marked, count, longest)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc", "version", "name", "size")], *columns], names=["doc", "version", "name", "size", "marked", "n_tiles", "longest"])


def _keyed(docs: DataFrame) -> DataFrame:
    return versioned(docs.select("doc_id", "text")).select("doc", "text", "version")


def matches(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Pairs at or over the coverage: doc and version (see ``tables.versioned``), item, coverage, n_tiles, longest."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").alias("name"), "text").distinct()
    seeds = cut(items.mapInArrow(_item_seeds(seed), "core long, item long, p int, size int"), "seeds")
    if seeds.count() <= broadcast_words:
        rows = seeds.toArrow()
        grams = rows.column("core").to_numpy().view(np.uint64)
        order = np.argsort(grams, kind="stable")
        bitmap = np.zeros(1 << 24, dtype=bool)
        bitmap[(grams >> np.uint64(40)).astype(np.int64)] = True
        shared = spark.sparkContext.broadcast((grams[order], *[rows.column(c).to_numpy()[order] for c in ("item", "p", "size")], bitmap))
        pairs = _keyed(docs).mapInArrow(_pairs_by_index(shared, seed), _RUNS)
    else:
        shared = bloom(seeds.select("core").distinct(), BLOOM_BITS)
        found = _keyed(docs).mapInArrow(_pairs_by_join(shared, BLOOM_BITS, seed), "core long, doc long, version long, at int")
        met = found.join(seeds, "core").select("doc", "version", "item", "size", "at", "p").distinct()
        # Seeds on end of one diagonal have one difference of place and number among them.
        diagonal = Window.partitionBy("doc", "version", "item", F.col("at") - F.col("p")).orderBy("at")
        pairs = met.withColumn("run", F.col("at") - F.row_number().over(diagonal)).groupBy("doc", "version", "item", "size", F.col("at") - F.col("p"), "run")
        pairs = pairs.agg(F.min("at").alias("at"), F.min("p").alias("p"), F.count("*").cast("int").alias("n")).select("doc", "version", "item", "size", "at", "p", "n")
    # A document's runs against one item; the same row given twice counts once.
    groups = pairs.groupBy("doc", "version", "item", "size").agg(F.collect_set(F.struct("at", "p", "n")).alias("runs"))
    # Too few words to reach the coverage even if none overlap.
    most = F.aggregate("runs", F.lit(0), lambda total, r: total + r["n"] + F.lit(seed - 1))
    groups = groups.where(most >= coverage * F.col("size"))
    tiled = cut(groups.mapInArrow(_tile_groups(seed, coverage), _TILED), "tiled")
    texts = _keyed(docs).where("text is not null").join(tiled, ["doc", "version"]).join(items.select("item", "name", F.col("text").alias("item_text")), "item")
    texts = texts.select("doc", "version", "name", "size", "tiles", "text", "item_text")
    name = items.schema["name"].dataType.simpleString()
    checked = texts.mapInArrow(_verified, f"doc long, version long, name {name}, size int, marked int, n_tiles int, longest int").distinct()
    checked = checked.withColumn("coverage", F.col("marked") / F.col("size")).where(F.col("coverage") >= coverage)
    return checked.select("doc", "version", F.col("name").alias("item_id"), "coverage", "n_tiles", "longest")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Contaminated pairs: doc_id, item_id, coverage, n_tiles, longest (tile, in words).

    Reads ``doc_id``, ``text`` and the benchmark's ``item_id``, ``text``.  Null
    or empty texts and items of fewer words than a seed match nothing; rows
    without ``doc_id`` come out with a null one.  Rows repeated exactly count
    once.  With no documents or items the result is empty.
    """
    return matches(docs, benchmark, **options).select(named().alias("doc_id"), "item_id", "coverage", "n_tiles", "longest")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns, without the contaminated documents."""
    bad = cut(matches(docs, benchmark, **options).select(F.col("doc").alias("__doc"), F.col("version").alias("__version")).distinct(), "contaminated")
    keyed = versioned(docs, "__doc", "__version")
    return keyed.join(bad, ["__doc", "__version"], "left_anti").select(docs.columns)
