"""Connected components as Spark joins: alternating large-star and small-star steps (Kiveris et al., 2014).

Before the first step every task contracts the links it holds, a bounded
number at a time, to stars; links that fit one such chunk are then done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.tables import cut

#: Links that a task contracts at once: 4 MB of node pairs.
CHUNK = 1 << 18


def stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links (x, y) but the smallest of its component, and that smallest node."""
    names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    up = np.arange(len(names))
    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        # Roots hang on smaller roots, so there are no cycles.
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    below = np.flatnonzero(up != np.arange(len(names)))
    return names[below], names[up[below]]


def _contract(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            a, b = stars(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                part = batch.slice(i, chunk)
                if n + part.num_rows > chunk:
                    yield out()
                    held, n = [], 0
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
                n += part.num_rows
        if held:
            yield out()

    return run


def _stars(links: DataFrame) -> bool:
    """Whether every node either has one link, to a node that has none itself, or has none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", roots: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Rows (node, component) for every node of ``edges``; the component is its smallest node, left out as a node if not ``roots``.

    Null ends and self-links are ignored; repeated links count once.  A node
    with very many links is only ever met in an aggregation that combines
    before its shuffle and in a join that Spark splits when skewed.
    """
    links = cut(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b"), "links")
    tasks = -(-links.count() // chunk)
    links = links.coalesce(max(tasks, 1)).mapInArrow(_contract(chunk), "a long, b long")
    links = cut(links.distinct() if tasks > 1 else links, "links")
    while tasks > 1 and not _stars(links):
        # Small star: smaller neighbours and the node itself move to the smallest.  It comes first, as it thins out dense groups.
        lowest = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = cut(moved.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "links")
        # Large star: greater neighbours move to the smallest of the neighbourhood.
        both = small.union(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = cut(large.distinct(), "links")
    below = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if not roots:
        return below
    return below.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
