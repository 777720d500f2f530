"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors are one node that remembers the few smallest ids that a result
can hold.  Nodes are dealt to shards of bounded size by hash.  A shard's graph
is stored as flat neighbour arrays, one a level, padded with -1: links are
chosen from exact candidates in the shard by the usual diversity rule, which
gives the graph that insertion one by one approximates.  Each shard's arrays are
written as one row, then searched by slices of the queries of bounded size.
Every query descends every shard's levels with a beam, then searches the lowest
level with a wider one; the shards' best are merged and scored in double precision
on the original vectors.  In a shard vectors are moved about their mean and scaled
before they are rounded to single precision, so neither a common offset nor very
large or small components cost recall.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.tables import cut

K = 10
QUERY_EVERY = 100
#: Nodes a shard holds on average.
SHARD = 8192
#: Links a node on upper levels (twice as many on the lowest), candidates a link is chosen from, width of the beam.
LINKS, CANDIDATES, BEAM = 16, 64, 128
#: Width of the beam on upper levels.
UPPER = 64
#: Queries that one row of the search carries to a shard, and rows that one task searches a shard with on average.
QUERY_BLOCK, SLICE_BLOCKS = 256, 16
#: Parts that rows of one vector are dealt to before they meet.
SALTS = 64
#: Nodes whose distances to a whole shard are computed at once.
_ROWS = 512


def _diverse(near: np.ndarray, distance: np.ndarray, data: np.ndarray, most: int) -> list[int]:
    """Of candidates by ascending distance, those nearer to the node than to any one already chosen, then the nearest of the rest."""
    chosen: list[int] = []
    rest: list[int] = []
    for c, d in zip(near.tolist(), distance.tolist()):
        if len(chosen) == most:
            break
        if chosen and ((data[chosen] - data[c]) ** 2).sum(axis=1).min() < d:
            rest.append(c)
        else:
            chosen.append(c)
    return chosen + rest[: most - len(chosen)]


class Graph:
    """Levels of one shard: ``nodes[l]`` are the positions on level l, ``links[l]`` their neighbours, padded with -1."""

    def __init__(self, data: np.ndarray, links: list[np.ndarray], entry: int):
        self.data, self.links, self.entry = data, links, entry

    @classmethod
    def build(cls, data: np.ndarray, seed: int = 1, links: int = LINKS, candidates: int = CANDIDATES) -> Graph:
        height = np.floor(-np.log(np.random.default_rng(seed).random(len(data))) / math.log(links)).astype(int)
        graph = cls(data, [], int(np.argmax(height)) if len(data) else -1)
        for level in range(height.max(initial=0) + 1):
            graph.links.append(graph._level(np.flatnonzero(height >= level), 2 * links if level == 0 else links, candidates))
        return graph

    def _level(self, nodes: np.ndarray, most: int, candidates: int) -> np.ndarray:
        table = np.full((len(self.data), most), -1, dtype=np.int32)
        part = self.data[nodes]
        norms = (part**2).sum(axis=1)
        k = min(candidates, len(nodes) - 1)
        back: list[list[tuple[float, int]]] = [[] for _ in nodes]
        if k <= 0:
            return table
        for begin in range(0, len(nodes), _ROWS):
            rows = part[begin : begin + _ROWS]
            d = norms[begin : begin + _ROWS, None] + norms - 2 * rows @ part.T
            d[np.arange(len(rows)), np.arange(begin, begin + len(rows))] = np.inf
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            dist = np.take_along_axis(d, near, axis=1)
            order = np.argsort(dist, axis=1, kind="stable")
            near, dist = np.take_along_axis(near, order, axis=1), np.maximum(np.take_along_axis(dist, order, axis=1), 0)
            for i in range(len(rows)):
                own = _diverse(near[i], dist[i], part, most // 2)
                table[nodes[begin + i], : len(own)] = nodes[own]
                for j in own:
                    back[j].append((float(d[i, j]), begin + i))
        # Links go both ways; a node with too many keeps the nearest.
        for i, incoming in enumerate(back):
            row = table[nodes[i]]
            held = set(row[row >= 0].tolist())
            new = [int(nodes[j]) for _, j in sorted(incoming) if int(nodes[j]) not in held]
            free = most - len(held)
            row[len(held) : len(held) + min(free, len(new))] = new[:free]
        return table

    def _nearest(self, query: np.ndarray, level: int, starts: list[tuple[float, int]], beam: int) -> list[tuple[float, int]]:
        """Beam search on one level from (squared distance, position) pairs; the nearest found, at most ``beam``, ascending."""
        data, links = self.data, self.links[level]
        seen = np.zeros(len(data), dtype=bool)
        seen[[n for _, n in starts]] = True
        open_ = list(starts)
        heapq.heapify(open_)
        best = [(-d, n) for d, n in sorted(starts)[:beam]]
        heapq.heapify(best)
        while open_:
            d, at = heapq.heappop(open_)
            if d > -best[0][0] and len(best) >= beam:
                break
            near = links[at]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            dist = ((data[near] - query) ** 2).sum(axis=1)
            for x, n in zip(dist.tolist(), near.tolist()):
                if len(best) < beam:
                    heapq.heappush(best, (-x, n))
                    heapq.heappush(open_, (x, n))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, n))
                    heapq.heappush(open_, (x, n))
        return sorted((-x, n) for x, n in best)

    def search(self, query: np.ndarray, k: int, beam: int = BEAM, upper: int = UPPER) -> list[tuple[float, int]]:
        """The k nearest found, as (squared distance, position).

        Upper levels keep a beam too, and all that they end with begins the next
        level: links on the lowest level do not leave a group that is larger than
        the candidates, so each group near the query has to be entered from above.
        """
        if self.entry < 0:
            return []
        found = [(float(((self.data[self.entry] - query) ** 2).sum()), self.entry)]
        for level in range(len(self.links) - 1, 0, -1):
            found = self._nearest(query, level, found, upper)
        return self._nearest(query, 0, found, max(beam, k))[:k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _scaled(exact: np.ndarray) -> tuple[np.ndarray, tuple[float, np.ndarray, float]]:
    """A shard's vectors about their mean and within a ball of radius one, and how a query is moved there; in double, rounded last."""
    big = float(np.abs(exact).max(initial=0)) or 1.0
    shrunk = exact / big
    centre = shrunk.mean(axis=0) if len(exact) else np.zeros(exact.shape[1])
    moved = shrunk - centre
    radius = math.sqrt(float((moved**2).sum(axis=1).max(initial=0))) or 1.0
    return (moved / radius).astype(np.float32), (big, centre, radius)


_GRAPH = "size int, shard long, vectors binary, ids array<array<long>>, links array<binary>, entry int"


def _build_shard(key: tuple, nodes: pa.Table) -> pa.Table:
    """The shard's graph as one row: vectors, ids of each node, flat neighbour arrays by level, entry."""
    table = nodes.sort_by("node")
    exact = _matrix(table.column("vector"))
    graph = Graph.build(_scaled(exact)[0])
    row = {"size": key[0].as_py(), "shard": key[1].as_py(), "vectors": exact.tobytes(), "ids": table.column("ids").to_pylist(), "links": [x.tobytes() for x in graph.links], "entry": graph.entry}
    kinds = pa.schema([("size", pa.int32()), ("shard", pa.int64()), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))), ("links", pa.list_(pa.binary())), ("entry", pa.int32())])
    return pa.Table.from_pylist([row], schema=kinds)


def _search_shard(k: int, beam: int):
    def run(key: tuple, graphs: pa.Table, blocks: pa.Table) -> pa.Table:
        """Searches one shard's graph with one slice of the queries; rows (query_id, ids, distances of the nodes found)."""
        out: list[tuple[int, int, float]] = []
        if graphs.num_rows and blocks.num_rows:
            row = graphs.slice(0, 1).to_pylist()[0]
            ids = row["ids"]
            exact = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
            data, (big, centre, radius) = _scaled(exact)
            graph = Graph(data, [np.frombuffer(x, np.int32).reshape(len(ids), -1) for x in row["links"]], row["entry"])
            for block in blocks.column("queries").to_pylist():
                for q in block:
                    point = np.asarray(q["vector"], dtype=np.float64)
                    # One node more: the query's own may hold nothing but itself.
                    found = [n for _, n in graph.search((point / big - centre) / radius, k + 1, beam)]
                    for n in found:
                        score = math.sqrt(float(((exact[n] - point) ** 2).sum()))
                        out += [(q["vec_id"], i, score) for i in ids[n] if i != q["vec_id"]]
        query, ids, score = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector in double precision; null, empty, zero and non-finite ones are left out, as are rows without id."""
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(fine)


def nearest(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, shard: int = SHARD, beam: int = BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank from 1, vec_id, score (Euclidean distance).

    Reads ``vec_id`` and ``embedding``; vectors of another length than the
    query's are in another space and no candidates.  Ties go to the smaller
    vec_id.  A vec_id given twice counts once, with its least vector.  An
    empty table gives an empty result.
    """
    rows = usable(vectors).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = cut(rows.withColumn("node", F.xxhash64("vector")).withColumn("size", F.size("vector")), "vectors")
    # Of equal vectors only the k + 1 smallest ids can be among a query's k others.
    # Found in two steps, so that a vector that very many rows share is no single task's.
    kept = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for key in (["vector", "salt"], ["vector"]):
        first = Window.partitionBy(*key).orderBy("vec_id")
        kept = kept.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    nodes = kept.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("node").alias("node"), F.first("size").alias("size"))
    nodes = cut(nodes, "nodes")
    sizes = nodes.groupBy("size").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = nodes.join(F.broadcast(sizes), "size").withColumn("shard", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("shards")))
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, queries.count() // query_block))))
    blocks = blocks.groupBy("size", "block").agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
    graphs = cut(dealt.select("size", "shard", "node", "vector", "ids").groupBy("size", "shard").applyInArrow(_build_shard, _GRAPH), "graphs")
    n_slices = max(1, queries.count() // (query_block * SLICE_BLOCKS))
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slices - 1).cast("long")))
    sent = blocks.withColumn("slice", F.pmod("block", F.lit(n_slices))).join(F.broadcast(sizes), "size")
    sent = sent.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    left = graphs.withColumn("slice", slices).groupBy("size", "shard", "slice")
    right = sent.select("size", "shard", "slice", "queries").groupBy("size", "shard", "slice")
    found = left.cogroup(right).applyInArrow(_search_shard(k, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
