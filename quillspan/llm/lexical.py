"""Ranked lexical search over posting lists in geometric blocks; exact.

Documents are turned once into a forward table of the terms that some item asks
for (terms of the stated query set; no other posting can count).  A task takes
its documents in shards of bounded size.  In a shard the posting list of each
term is clustered by the similarity of its documents (random projections of
their weighted terms, documents of the list as centres) and cut into blocks;
each block stores the coordinatewise maximum of its documents' impacts.

An item visits its lists from the rarest on.  A document that it has not met in
an earlier list holds none of the earlier terms, so a block's bound sums only
the terms from its own list on: weight times stored maximum, in integers.  A
block is skipped only when that bound is below the fiftieth best score so far,
and what is left of the lists only when even their maxima are.  Best scores are
carried from shard to shard; each task hands on at most ``limit`` rows an item.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import vectext
from quillspan.llm.tables import cut

#: A term: what lies between these characters, A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LIMIT = 50
#: Documents of a block, and dimensions in which a list's documents are compared.
BLOCK, DIMENSIONS = 64, 16
#: Cells (documents times terms) of a shard, and terms that are searched at once.
CELLS, GROUP_TERMS = 1 << 24, 8192
#: Documents of a shard at most.
SHARD_ROWS = 1 << 14
#: Item terms that the driver sends to tasks at once; further items are asked in further passes.
QUERY_TERMS = 500_000
#: Blocks that are scored before the bounds are compared anew.
STEP = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class Vocabulary:
    """Terms with numbers; finds them among spans of bytes by hash, then by their bytes."""

    def __init__(self, terms: list[str]):
        data = [t.encode() for t in terms]
        self.size = len(data)
        self.buf = np.frombuffer(b"".join(data), dtype=np.uint8)
        self.ends = np.cumsum([len(d) for d in data], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        hashes = vectext.span_hashes(self.buf, self.starts, self.ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.near = np.zeros(1 << 20, dtype=bool)
        self.near[hashes & np.uint64((1 << 20) - 1)] = True

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans are terms, and the numbers of those."""
        hashes = vectext.span_hashes(buf, starts, ends)
        which = np.flatnonzero(self.near[hashes & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[which]), self.size - 1)
        same = self.hashes[at] == hashes[which]
        which, term = which[same], self.order[at[same]]
        size = ends[which] - starts[which]
        same = size == self.ends[term] - self.starts[term]
        which, term, size = which[same], term[same], size[same]
        owner = np.repeat(np.arange(len(which)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = buf[starts[which][owner] + place] != self.buf[self.starts[term][owner] + place]
        same = np.bincount(owner[differ], minlength=len(which)) == 0
        return which[same], term[same]


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term); texts that share an ``item_id`` count as one."""
    lowered = F.translate("text", UPPER, LOWER)
    found = F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({TERM})"), 1))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


def forward_table(docs: DataFrame, terms: list[str]) -> DataFrame:
    """One row (doc_id, n, terms, counts) a document with terms: how many it has, and the numbers and counts of those in ``terms``."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(Vocabulary(terms))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = known.value
        for batch in vectext.slices(batches, "text"):
            buf, offsets = vectext.raw(batch.column("text"), lower=True)
            starts, ends, first = vectext.word_bounds(buf, offsets, _GAP)
            n = np.diff(first)
            which, term = vocabulary.find(buf, starts, ends)
            key = np.repeat(np.arange(len(n)), n)[which] * vocabulary.size + term
            key, counts = np.unique(key, return_counts=True)
            bounds = np.searchsorted(key, np.arange(len(n) + 1) * vocabulary.size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in ((key % vocabulary.size).astype(np.int32), counts.astype(np.int64))]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>"), "forward")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """``100 - 50 + (50 * n * N) div L`` of each document, beyond 64 bits where needed."""
    if 50 * int(n.max(initial=0)) * documents < 1 << 63:
        return 50 + (50 * documents * n) // max(total, 1)
    return np.array([50 + (50 * documents * int(x)) // max(total, 1) for x in n], dtype=np.int64)


class Best:
    """The best rows of an item so far: scores, document numbers (absent ones last); ``least`` is what a further row must reach."""

    def __init__(self, limit: int):
        self.limit, self.least = limit, 1
        self.scores, self.absent, self.docs = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, absent: np.ndarray, docs: np.ndarray) -> None:
        fit = scores >= self.least
        if not fit.any():
            return
        scores, absent, docs = (np.concatenate([a, b[fit]]) for a, b in ((self.scores, scores), (self.absent, absent), (self.docs, docs)))
        order = np.lexsort((docs, absent, -scores))[: self.limit]
        self.scores, self.absent, self.docs = scores[order], absent[order], docs[order]
        if len(order) == self.limit:
            self.least = int(self.scores[-1])


class Shard:
    """Impacts of some documents (rows) for a group's terms (columns), and blocks of each posting list."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, documents: int, weights: np.ndarray):
        self.impacts = np.zeros((documents, len(weights)), dtype=np.int32)
        self.impacts[rows, columns] = impacts
        self.top = self.impacts.max(axis=0, initial=0).astype(np.int64) * weights
        signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (len(weights), DIMENSIONS))
        sketch = np.zeros((documents, DIMENSIONS), np.float32)
        mass = (impacts * weights[columns]).astype(np.float32)
        for k in range(DIMENSIONS):
            sketch[:, k] = np.bincount(rows, mass * signs[columns, k], documents)
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        order = np.argsort(columns, kind="stable")
        self.postings, self.first = rows[order], np.searchsorted(columns[order], np.arange(len(weights) + 1))
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def length(self, columns: np.ndarray) -> np.ndarray:
        return self.first[columns + 1] - self.first[columns]

    def list_blocks(self, column: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A list's documents in block order, where blocks begin, and each block's maxima in the columns ``asked``."""
        if column not in self.blocks:
            docs = self.postings[self.first[column] : self.first[column + 1]]
            starts = np.zeros(1, np.int64)
            if len(docs) > BLOCK:
                centres = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // BLOCK)).astype(np.int64)]
                cluster = np.argmax(self.sketch[docs] @ self.sketch[centres].T, axis=1)
                order = np.argsort(cluster, kind="stable")
                docs, cluster = docs[order], cluster[order]
                begin = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
                within = np.arange(len(docs)) - np.repeat(begin, np.diff(np.append(begin, len(docs))))
                starts = np.flatnonzero(within % BLOCK == 0)
            most = np.maximum.reduceat(self.impacts[np.ix_(docs, asked)], starts, axis=0)
            self.blocks[column] = docs, starts, most
        return self.blocks[column]


def search_shard(shard: Shard, item: np.ndarray, weights: np.ndarray, asked: dict[int, np.ndarray], best: Best, absent: np.ndarray, ids: np.ndarray, told: dict | None = None) -> None:
    """Adds the shard's documents that belong among the item's best; ``told`` counts blocks met and scored."""
    sizes = shard.length(item)
    item = item[(sizes > 0) & (weights[item] > 0)]
    item = item[np.lexsort((item, shard.length(item)))]
    own = weights[item]
    rest = np.cumsum(shard.top[item][::-1])[::-1]
    seen = np.zeros(len(absent), dtype=bool)
    for j, column in enumerate(item.tolist()):
        if rest[j] < best.least:
            break
        docs, starts, most = shard.list_blocks(column, asked[column])
        bounds = most[:, np.searchsorted(asked[column], item[j:])].astype(np.int64) @ own[j:]
        order = np.argsort(-bounds, kind="stable")
        ends = np.append(starts[1:], len(docs))
        if told is not None:
            told["met"] = told.get("met", 0) + len(starts)
        for i in range(0, len(order), STEP):
            some = [b for b in order[i : i + STEP].tolist() if bounds[b] >= best.least]
            if not some:
                break
            fresh = np.concatenate([docs[starts[b] : ends[b]] for b in some])
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            best.add(shard.impacts[np.ix_(fresh, item)].astype(np.int64) @ own, absent[fresh], ids[fresh])
            if told is not None:
                told["scored"] = told.get("scored", 0) + len(some)


def item_groups(items: list[np.ndarray]) -> list[tuple[np.ndarray, list[int]]]:
    """Items dealt into groups of at most GROUP_TERMS terms (a longer item is alone): the group's terms, the items' places."""
    groups: list[tuple[set[int], list[int]]] = []
    for place in sorted(range(len(items)), key=lambda i: (items[i][0] if len(items[i]) else -1, i)):
        own = set(items[place].tolist())
        if not groups or len(groups[-1][0] | own) > GROUP_TERMS:
            groups.append((set(), []))
        groups[-1][0].update(own)
        groups[-1][1].append(place)
    return [(np.array(sorted(terms), dtype=np.int64), places) for terms, places in groups]


def _shards(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    lists = table.column(column).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    return np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py(), np.asarray(lists.flatten())


def rank_forward(table: DataFrame, items: list[tuple[int | None, list[int]]], weights: list[int], documents: int, total: int, limit: int, cells: int = CELLS) -> DataFrame:
    """Rows (item_id, doc_id, score): each task's best ``limit`` for each item; a shard has at most ``cells`` cells, one document at least."""
    spark = table.sparkSession
    asked = [np.array(sorted(terms), dtype=np.int64) for _, terms in items]
    sent = spark.sparkContext.broadcast((asked, item_groups(asked), np.array(weights, dtype=np.int64), [i for i, _ in items]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_, groups, weights_, names = sent.value
        best = [Best(limit) for _ in items_]
        plans = []
        for terms, places in groups:
            local = np.full(len(weights_), -1, dtype=np.int64)
            local[terms] = np.arange(len(terms))
            own = {p: local[items_[p]] for p in places}
            with_term: dict[int, set[int]] = {}
            for columns in own.values():
                for c in columns.tolist():
                    with_term.setdefault(c, set()).update(columns.tolist())
            plans.append((terms, local, own, {c: np.array(sorted(x), dtype=np.int64) for c, x in with_term.items()}))
        widest = max((len(terms) for terms, _ in groups), default=1)
        for shard in _shards(batches, max(1, min(SHARD_ROWS, cells // max(widest, 1)))):
            offsets, term = _lists(shard, "terms")
            tf = _lists(shard, "counts")[1].astype(np.int64)
            row = np.repeat(np.arange(shard.num_rows), np.diff(offsets))
            ids_ = shard.column("doc_id")
            absent = np.asarray(ids_.is_null())
            ids = np.asarray(ids_.fill_null(0)).astype(np.int64)
            m = lengths(np.asarray(shard.column("n")).astype(np.int64), documents, total)
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
            for terms, local, own, with_term in plans:
                inside = local[term] >= 0
                index = Shard(row[inside], local[term][inside], impact[inside], shard.num_rows, weights_[terms])
                for place, columns in own.items():
                    search_shard(index, columns, weights_[terms], with_term, best[place], absent, ids)
        for name, found in zip(names, best, strict=True):
            if len(found.docs):
                docs = pa.array(found.docs, mask=found.absent)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(docs), pa.int64()), docs, pa.array(found.scores)], ["item_id", "doc_id", "score"])

    return table.where("size(terms) > 0").mapInArrow(run, "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, limit: int = LIMIT, query_terms: int = QUERY_TERMS, cells: int = CELLS) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's ``limit`` best documents with a score above 0.

    Every row of ``docs`` is a document of its own, also where it repeats
    another; a null or empty text has no terms and is none of the ``N``
    documents.  Equal scores rank by ascending ``doc_id``, null last; rows that
    repeat score and ``doc_id`` follow each other.  Items that share an
    ``item_id`` (null too) are one item of all their terms; an item without
    terms, or without documents that hold one, has no rows.  Other columns are
    ignored.  Items are asked in passes of about ``query_terms``
    terms, and documents searched in shards of ``cells`` cells; neither changes a row.
    """
    spark = docs.sparkSession
    terms = cut(item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))), "item-terms")
    passes = max(1, -(-terms.count() // query_terms))
    out = None
    for p in range(passes):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()
        words = sorted({r.term for r in own})
        if not words:
            continue
        number = {t: i for i, t in enumerate(words)}
        by_item: dict[int | None, list[int]] = {}
        for r in own:
            by_item.setdefault(r.item_id, []).append(number[r.term])
        table = forward_table(docs, words)
        documents, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = dict(table.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = [weight(documents, holding.get(i, 0)) for i in range(len(words))]
        found = rank_forward(table, sorted(by_item.items(), key=lambda x: (x[0] is None, x[0] or 0)), weights, documents, total, limit, cells)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("item_id", "rank", "doc_id", "score")
