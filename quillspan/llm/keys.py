"""Keys that two or more hashes share, without a row for each pair of a key and a hash.

Tasks pack their pairs as binary arrays, a row for each bucket of keys; Spark
shuffles the rows and each bucket is sorted in one pass.  A key with many
hashes in one flush is shared for certain: two of its pairs stay in its
bucket, all are dealt to further buckets by their hash, so no bucket grows with
a key's group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that a task packs at once: 16 MB.
FLUSH = 1 << 20
#: Hashes of a key in one flush beyond which they are dealt by hash.
OFTEN = 32
#: Bytes of text whose keys share a bucket.
BUCKET_BYTES = 1 << 22

#: What turns batches into arrays of keys and of their hashes.
Pairs = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]


def _distinct(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, keys))
    keys, hashes = keys[order], hashes[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (hashes[1:] != hashes[:-1])
    return keys[new], hashes[new]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and its length."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(keys)))


def _rows(bucket: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket; ``bucket`` ascends."""
    begin, n = _runs(bucket)
    cuts = list(zip(begin.tolist(), (begin + n).tolist()))
    packed = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (keys, hashes)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), *packed], names=["bucket", "keys", "hashes"])


def _packed(pairs: Pairs, buckets: int, flush: int, often: int):
    def rows(keys: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys)
        keys, hashes = keys[order], hashes[order]
        begin, n = _runs(keys)
        long_ = np.repeat(n > often, n)
        if long_.any():
            k, h = _distinct(keys[long_], hashes[long_])
            begin, n = _runs(k)
            turn = np.arange(len(k)) - np.repeat(begin, n)
            many = np.repeat(n > often, n)
            own = ~many | (turn < 2)
            keys, hashes = np.concatenate([keys[~long_], k[own]]), np.concatenate([hashes[~long_], h[own]])
            order = np.argsort(keys)
            keys, hashes = keys[order], hashes[order]
            k, h = k[many], h[many]
            dealt = -1 - (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(dealt)
            if len(k):
                yield _rows(dealt[order], k[order], h[order])
        yield _rows(((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), keys, hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in pairs(batches):
            held.append(part)
            n += len(part[0])
            if n >= flush:
                yield from rows(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield from rows(*map(np.concatenate, zip(*held)))

    return run


def _shared(table: pa.Table) -> pa.Table:
    """The pairs of a bucket whose key has two hashes or more; all pairs of a bucket dealt by hash."""
    keys, hashes = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("keys", "hashes"))
    if table.column("bucket")[0].as_py() >= 0:
        order = np.argsort(keys)
        keys, hashes = keys[order], hashes[order]
        _, n = _runs(keys)
        again = np.repeat(n > 1, n)
        keys, hashes = _distinct(keys[again], hashes[again])
        _, n = _runs(keys)
        again = np.repeat(n > 1, n)
        keys, hashes = keys[again], hashes[again]
    else:
        keys, hashes = _distinct(keys, hashes)
    return pa.table([pa.array(keys.view(np.int64)), pa.array(hashes.view(np.int64))], names=["key", "hash"])


def bucket_count(texts: DataFrame, column: str) -> int:
    """Buckets for keys of so many bytes of text."""
    return max(16, (texts.agg(F.sum(F.octet_length(column))).first()[0] or 0) // BUCKET_BYTES)


def shared_keys(df: DataFrame, pairs: Pairs, buckets: int, flush: int = FLUSH, often: int = OFTEN) -> DataFrame:
    """Rows (key, hash) of the keys that two or more different hashes share; those of a frequent key may come twice."""
    packed = df.mapInArrow(_packed(pairs, buckets, flush, often), "bucket long, keys binary, hashes binary")
    return packed.groupBy("bucket").applyInArrow(_shared, "key long, hash long")
