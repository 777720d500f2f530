"""MinHash near-dedup with tensored banding, exact verification and connected components.

A text's set holds its distinct five-word shingles (A-Z lower-cased).  A few
small *collections* of two minhashes each are computed; a table key is a pair
of collections, so 14 collections (28 minhashes) give 91 keys of four
minhashes.  A pair of texts with similarity 0.75 shares a key with probability
0.9998.  Candidates are confirmed on the full sets.

Buckets are never expanded into all pairs: ``linking`` links texts to leaders
round by round, compares the rest in blocks, and lets out only links that merge
two components.  A word, a shingle and a whole text are known by non-linear
64-bit hashes of their bytes; texts count as equal by two such hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import vectext as V
from quillspan.llm.linking import BLOCK, linked
from quillspan.llm.substring_dedup import _probes, bloom
from quillspan.llm.tables import cut

WORDS = 5
#: Similarity: 100 * intersection >= PERCENT * union.
PERCENT = 75
COLLECTIONS = 14
PER_COLLECTION = 2
BLOOM_BITS = 26

_SKETCH = "doc_id long, n_words long, n_shingles long, fp_a long, fp_b long, sig binary"


def _seeds(n: int) -> np.ndarray:
    return V.mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes on end with bounds, words a text, and two hashes of its whole sequence."""
    buf, offsets = V.raw(column, lower=True)
    starts, ends, first = V.word_bounds(buf, offsets)
    hashes = V.span_hashes(buf, starts, ends)
    at, owner = V.windows(first, words)
    flat, bounds = V.distinct_within(owner, V.window_hashes(hashes, words)[at], len(column))
    return flat, bounds, np.diff(first), V.totals(hashes, first, 1), V.totals(hashes, first, 2)


def _sketch(words: int, n_hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(n_hashes)
        odd = seeds | np.uint64(1)
        for batch in V.slices(batches, "text"):
            flat, bounds, n_words, fp_a, fp_b = _sets(batch.column("text"), words)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            sig = np.zeros((batch.num_rows, n_hashes), dtype=np.uint64)
            if len(full):
                for i in range(n_hashes):
                    sig[full, i] = np.minimum.reduceat((flat ^ seeds[i]) * odd[i], bounds[full])
            rows = [sig[i].tobytes() if sizes[i] else None for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(n_words, pa.int64()),
                    pa.array(np.where(sizes > 0, sizes, (n_words > 0).astype(np.int64)), pa.int64()),
                    pa.array(fp_a),
                    pa.array(fp_b),
                    pa.array(rows, pa.binary()),
                ],
                names=["doc_id", "n_words", "n_shingles", "fp_a", "fp_b", "sig"],
            )

    return run


def _collections(collections: int, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint64)
            sig = sig.reshape(batch.num_rows, collections, per)
            value = V.mix64(np.full(sig.shape[:2], 7, np.uint64) + np.arange(collections, dtype=np.uint64))
            for j in range(per):
                value = V.mix64(value * np.uint64(0x100000001B3) ^ sig[:, :, j])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column("doc_id").to_numpy(), collections)),
                    pa.array(np.tile(np.arange(collections, dtype=np.int32), batch.num_rows)),
                    pa.array(value.reshape(-1).view(np.int64)),
                ],
                names=["doc_id", "i", "value"],
            )

    return run


def _pack_sets(words: int, wanted, bits: int):
    """The sets of the texts whose ``doc_id`` the filter lets through: all wanted ones, and a few more."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for p in _probes(batch.column("doc_id").to_numpy().view(np.uint64), bits):
                keep &= (wanted.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(asked(batches), "text"):
            flat, bounds, *_ = _sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                ],
                names=["doc_id", "n", "shingles"],
            )

    return run


def near_dedup(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    collections: int = COLLECTIONS,
    per_collection: int = PER_COLLECTION,
    block: int = BLOCK,
) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Reads only ``doc_id`` and ``text``; other columns are ignored.  Null or
    wordless texts have an empty set and link with nothing.  Texts of fewer
    than five words are one shingle.  A row without ``doc_id`` is only ever
    joined to its exact copies.  Rows that repeat a ``doc_id`` are judged each
    by its own text.  An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(texts.mapInArrow(_sketch(words, collections * per_collection), _SKETCH), "sketch")
    classes = (
        rows.where("n_words > 0")
        .groupBy("fp_a", "fp_b")
        .agg(F.min("doc_id").alias("rep"), F.first("n_words").alias("n_words"), F.first("sig", ignorenulls=True).alias("sig"))
    )
    classes = cut(classes, "classes")
    reps = classes.where(f"n_words >= {words} and rep is not null").select(F.col("rep").alias("doc_id"), "sig")
    # Collections that two texts share; a text needs two of them to form a key at all.
    coll = cut(reps.mapInArrow(_collections(collections, per_collection), "doc_id long, i int, value long"), "collections")
    again = coll.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    own = coll.join(again, "value").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("c")).where("size(c) > 1")
    pairs = F.expr("flatten(transform(c, (x, p) -> transform(slice(c, p + 2, size(c)), y -> xxhash64(x.value, y.value))))")
    keys = cut(own.select("doc_id", F.explode(pairs).alias("key")), "keys")
    often = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = cut(keys.join(often, "key").select("key", "doc_id"), "members")
    # A filter of fixed size and not a join, which would shuffle all texts for the few wanted.
    wanted = bloom(members.select(F.col("doc_id").alias("core")).distinct(), BLOOM_BITS)
    sets = cut(texts.where("doc_id is not null").mapInArrow(_pack_sets(words, wanted, BLOOM_BITS), "doc_id long, n long, shingles binary"), "sets")

    parts = linked(members, sets, percent, block=block)
    out = rows.join(classes.select("fp_a", "fp_b", "rep"), ["fp_a", "fp_b"], "left")
    out = out.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    whole = F.when(F.col("n_words") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
