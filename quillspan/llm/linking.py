"""Links between similar sets that share a bucket, as components, without expanding a bucket into pairs.

Rounds link each set to one leader that it meets most often, contract what is
linked, and drop candidates that are already in one component; they end when a
round links few.  Sets that still meet others of a different component are
compared exactly in blocks of bounded size, by a prefix index of their rarest
shingles.  A link only ever comes out where it merges two components, so there
are fewer links than components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import vectext as V
from quillspan.llm.graph import components
from quillspan.llm.tables import cut

#: Shingles of a block of the exact comparison: 16 MB of hashes.
BLOCK = 2_000_000
#: A round of leaders is the last if it links fewer than one in so many sets.
SETTLED = 50
#: A round is a bucket's last if it moves fewer than one in so many of the texts it was handed to another component.
MOVED = 16
#: Pairs of places in the index that are expanded at once.
_CHUNK = 1 << 20

#: Texts of a bucket up to which all of them are kept for the next round of leaders; of more, all that are
#: outside its main component, and of those in it one in so many.
FEW, ONE_IN = 32, 16

#: What turns stored sets into their 64-bit shingle hashes, on end, and the set of each; a set's may repeat.
Unpack = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def stored(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(sets), np.uint64), np.repeat(np.arange(len(sets)), [len(s) // 8 for s in sets])


def _numbered(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct (owner, number of the hash) as one sorted array, the owner in its upper half; and how many hashes there are."""
    order = np.argsort(hashes)
    new = np.ones(len(order), dtype=bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    every = np.sort((owner[order] << 32) | (np.cumsum(new) - 1))
    return every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every, int(new.sum())


def set_sizes(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each of n owners."""
    return np.bincount(_numbered(hashes, owner)[0] >> 32, minlength=n)


def _overlaps(percent: int, unpack: Unpack):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(V.slices(batches, "sa"), "sb"):
            (x, of_x), (y, of_y) = unpack(batch.column("sa").to_pylist()), unpack(batch.column("sb").to_pylist())
            union = set_sizes(np.concatenate([x, y]), np.concatenate([of_x, of_y]), batch.num_rows)
            same = batch.column("na").to_numpy() + batch.column("nb").to_numpy() - union
            yield batch.select(["ca", "cb"]).filter(pa.array(100 * same >= percent * union))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, unpack: Unpack) -> DataFrame:
    """The components (ca, cb) of those pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(left, "a").join(right, "b").where(fits).select("ca", "cb", "na", "nb", "sa", "sb").mapInArrow(_overlaps(percent, unpack), "ca long, cb long")


def _leader_edges(members: DataFrame, turn: int) -> DataFrame:
    """For each text in a bucket with texts of another component, the leader it shares most such buckets with; both with their components."""
    # Longs throughout, so that the aggregations hash and do not sort.
    order = F.xxhash64(F.lit(turn), "doc_id")
    leaders = (
        members.groupBy("key")
        .agg(F.min_by("doc_id", order).alias("leader"), F.min_by("component", order).alias("its"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo < hi")
        .select("key", "leader", "its")
    )
    met = members.join(leaders, "key").where("component <> its").groupBy("doc_id", "component", "leader", "its").count()
    most = F.col("count") * (1 << 32) + F.shiftrightunsigned(F.xxhash64("leader"), 32)
    best = met.groupBy("doc_id", "component").agg(F.max_by("leader", most).alias("leader"), F.max_by("its", most).alias("its"))
    return best.select(F.col("leader").alias("a"), F.col("doc_id").alias("b"), F.col("its").alias("ca"), F.col("component").alias("cb"))


class _Roots:
    """Union-find over the components of one group."""

    def __init__(self, names: np.ndarray):
        self.names, self.at = np.unique(names, return_inverse=True)
        self.up = np.arange(len(self.names))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((int(self.names[a]), int(self.names[b])))

    def now(self) -> np.ndarray:
        """The root of every row."""
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return self.up[self.at]
            self.up = up


def _merge(hashes: np.ndarray, owner: np.ndarray, roots: _Roots, held: np.ndarray, asks: np.ndarray, percent: int) -> None:
    """Joins the components of all similar pairs of one that asks and one that is held.

    With a set's shingles by how many sets hold them, rarest first, two similar
    sets share one among their first n - ceil(percent * n / 100) + 1.
    """
    numbered, n = _numbered(hashes, owner)
    owner, tokens = numbered >> 32, numbered & 0xFFFFFFFF
    sizes, often = np.bincount(owner, minlength=len(held)), np.bincount(tokens, minlength=n)
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(n)
    # Each set's shingles by rank, on end: one sorted array of (set, rank).
    every = np.sort((owner << 32) | rank[tokens])
    begin = np.cumsum(sizes) - sizes
    first = np.arange(len(every)) - begin[owner] < (sizes + (-percent * sizes) // 100 + 1)[owner]
    lone = np.sort(often) == 1
    first &= ~lone[every & 0xFFFFFFFF]
    at, who = every[first] & 0xFFFFFFFF, owner[first]
    order = np.argsort(at[held[who]], kind="stable")
    posting, holder = at[held[who]][order], who[held[who]][order]
    ask = asks[who]
    low = np.searchsorted(posting, at[ask], "left")
    many = np.searchsorted(posting, at[ask], "right") - low
    asker = who[ask]
    done = np.concatenate([[0], np.cumsum(many)])
    a = 0
    while a < len(many):
        # Whole askers, as many as fit; one asker alone if it does not.
        b = max(a + 1, int(np.searchsorted(done, done[a] + _CHUNK, "right")) - 1)
        while b < len(many) and asker[b] == asker[b - 1]:
            b += 1
        hit = np.repeat(low[a:b] - (done[a:b] - done[a]), many[a:b]) + np.arange(done[b] - done[a])
        x, y = np.repeat(asker[a:b], many[a:b]), holder[hit]
        _compare(x, y, sizes, begin, every, roots, percent)
        a = b


def _compare(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, begin: np.ndarray, every: np.ndarray, roots: _Roots, percent: int) -> None:
    """Exact comparison of the pairs, in waves: of each pair of components one pair first, then ever more."""
    now = roots.now()
    fit = (now[x] != now[y]) & (100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y]))
    pairs = np.unique(x[fit] * len(sizes) + y[fit])
    x, y = pairs // len(sizes), pairs % len(sizes)
    wave = 1
    while len(x):
        lo, hi = np.minimum(now[x], now[y]), np.maximum(now[x], now[y])
        kind = lo * len(roots.up) + hi
        order = np.argsort(kind, kind="stable")
        _, start, count = np.unique(kind[order], return_index=True, return_counts=True)
        turn = np.empty(len(x), dtype=np.int64)
        turn[order] = np.arange(len(x)) - np.repeat(start, count)
        mine = np.flatnonzero(turn < wave)
        for part in np.array_split(mine, 1 + int(sizes[x[mine]].sum() >> 21)):
            p, q = x[part], y[part]
            n = sizes[p]
            where = np.repeat(begin[p] - np.cumsum(n) + n, n) + np.arange(n.sum())
            want = (np.repeat(q, n) << 32) | (every[where] & 0xFFFFFFFF)
            found = np.minimum(np.searchsorted(every, want), len(every) - 1)
            same = np.add.reduceat((every[found] == want).astype(np.int64), np.cumsum(n) - n)
            for i, j in zip(*(v[100 * same >= percent * (n + sizes[q] - same)].tolist() for v in (p, q))):
                roots.join(roots.at[i], roots.at[j])
        now = roots.now()
        left = (turn >= wave) & (now[x] != now[y])
        x, y = x[left], y[left]
        wave *= 4


def _against_block(percent: int, unpack: Unpack):
    def run(table: pa.Table) -> pa.Table:
        """Links between components of a group that similar pairs of those that ask and those that are held merge."""
        held, asks = table.column("held").to_numpy(), table.column("asks").to_numpy()
        roots = _Roots(table.column("component").to_numpy())
        if held.any() and asks.any():
            _merge(*unpack(table.column("shingles").to_pylist()), roots, held, asks, percent)
        a, b = zip(*roots.links) if roots.links else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["ca", "cb"])

    return run


def _rest(members: DataFrame, sets: DataFrame, percent: int, block: int, unpack: Unpack) -> DataFrame | None:
    """Links (ca, cb) for all that is left between components whose texts meet in a bucket; None if no bucket has two.

    Texts that meet in such buckets form clusters.  Texts outside their
    cluster's main component ask, and are compared with all of the cluster.
    Clusters of up to ``block`` shingles share groups.  The larger a corpus, the
    more clusters chance meetings join, up to one of nearly all texts, most of
    which never meet: a larger cluster is taken apart into the texts that meet
    each component that is the least of a bucket.  All that share a bucket stay
    together.  If that is still too large, it is dealt to blocks of it and
    slices of those that ask, a group for each of both.
    """
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    met = cut(members.join(mixed.select("key", "lo"), "key").select("doc_id", "component", "lo").distinct(), "met")
    if met.isEmpty():
        return None
    # Clusters are found over components, of which there are far fewer than texts in a large group.
    clusters = components(met.select("component", "lo").distinct(), "component", "lo", roots=False)
    clusters = clusters.select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    docs = met.join(clusters, "component", "left").join(sets.select("doc_id", "n"), "doc_id")
    docs = cut(docs.withColumn("cluster", F.coalesce("cluster", "component")), "clusters")
    # At most one in ``block`` shingles.
    large = docs.select("doc_id", "cluster", "n").distinct().groupBy("cluster").agg(F.sum("n").alias("k")).where(F.col("k") > block)
    docs = docs.join(F.broadcast(large.select("cluster", F.lit(True).alias("large"))), "cluster", "left")
    docs = cut(docs.select("doc_id", "component", "n", F.when(F.col("large"), F.col("lo")).otherwise(F.col("cluster")).alias("cluster")).distinct(), "clusters")
    per = docs.groupBy("cluster", "component").agg(F.sum("n").alias("k"))
    main = per.groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"))
    main = main.select("cluster", "main", F.ceil(F.col("all") / block).alias("blocks"), F.greatest(F.ceil((F.col("all") - F.col("most")) / block), F.lit(1)).alias("slices"))
    placed = docs.join(main, "cluster").join(sets.select("doc_id", "shingles"), "doc_id").withColumn("asks", F.col("component") != F.col("main"))
    groups = max(1, (docs.agg(F.sum("n")).first()[0] or 0) // block)
    row = ["component", "shingles", "held", "asks", "group"]
    whole = placed.where("blocks = 1").withColumn("held", F.lit(True)).withColumn("group", F.pmod(F.xxhash64("cluster"), F.lit(groups)))
    parted = placed.where("blocks > 1")

    def dealt(kind: str, others: str, own: str) -> DataFrame:
        """One row for each of the other dimension's parts; which part of its own a text is in is a hash of it."""
        rows = parted if kind == "held" else parted.where("asks")
        rows = rows.withColumns({"held": F.lit(kind == "held"), "asks": F.lit(kind == "asks"), "own": F.pmod(F.xxhash64(F.lit(kind), "doc_id"), F.col(own))})
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)))
        at = (F.col("own"), F.col("other")) if kind == "held" else (F.col("other"), F.col("own"))
        return rows.withColumn("group", F.xxhash64("cluster", *at))

    every = whole.select(row).union(dealt("held", "slices", "blocks").select(row)).union(dealt("asks", "blocks", "slices").select(row))
    return every.groupBy("group").applyInArrow(_against_block(percent, unpack), "ca long, cb long")


def contracted(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """``parts`` with the components that ``links`` merge; only components that change take part in the search."""
    merged = components(links, "ca", "cb", roots=False)
    if parts is None:
        return merged
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    moved = parts.join(to, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return cut(moved.union(merged), "parts")


def placed_links(links: DataFrame, parts: DataFrame) -> DataFrame:
    """Links (a, b) between nodes as links (ca, cb) between their components in ``parts``."""
    for end in ("a", "b"):
        to = parts.select(F.col("node").alias(end), F.col("component").alias("c"))
        links = links.join(to, end, "left").withColumn("c" + end, F.coalesce("c", end)).drop("c")
    return links.select("ca", "cb")


def _placed(members: DataFrame, parts: DataFrame, *more: str) -> DataFrame:
    """The members with their components in ``parts``, and how many nodes each has."""
    sizes = parts.groupBy("component").agg((F.count("*") + 1).alias("size"))
    now = members.select("key", "doc_id", *more).join(parts.join(sizes, "component").withColumnRenamed("node", "doc_id"), "doc_id", "left")
    # A component's smallest node is its name, and no node of ``parts``.
    return now.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"), F.coalesce("size", F.lit(1)).alias("size"), *more)


def _mixed(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """The members that the next round of leaders needs, by their components in ``parts``.

    A bucket that lies in one component stays so, and goes.  So does one in
    which the last round moved few texts, so that rounds do not hand on again
    and again what no leader links.  In a large bucket most texts lie in its
    main component and ask nothing; a share of them stays for leaders.  All
    texts of a bucket are compared in the end, by ``_rest``.
    """
    now = _placed(placed.withColumnRenamed("component", "was"), parts, "was")
    weight = F.col("size") * (1 << 32) + F.shiftrightunsigned(F.xxhash64("component"), 32)
    mixed = now.groupBy("key").agg(
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
        F.max_by("component", weight).alias("main"),
        F.count("*").alias("k"),
        F.count_if(F.col("was") != F.col("component")).alias("moved"),
    )
    mixed = mixed.where(f"lo < hi and moved * {MOVED} >= k")
    leads = F.pmod(F.xxhash64("doc_id", "key"), F.lit(ONE_IN)) == 0
    kept = now.join(mixed.select("key", "main", "k"), "key").where((F.col("component") != F.col("main")) | (F.col("k") <= FEW) | leads)
    return cut(kept.select("key", "doc_id", "component"), "placed")


def linked(members: DataFrame, sets: DataFrame, percent: int, unpack: Unpack = stored, block: int = BLOCK) -> DataFrame:
    """Components (node, component) of the links 100 * intersection >= percent * union; a component's smallest node is left out.

    ``members``: (key, doc_id) of keys that two or more share; pairs that come
    twice change no result.  ``sets``: (doc_id, n, shingles), n the set's size
    and shingles what ``unpack`` reads, for every doc_id in ``members``.
    """
    parts, placed = None, members.withColumn("component", F.col("doc_id"))
    enough, turn, settled = sets.count() / SETTLED, 0, False
    while not settled:
        links = cut(_verify(_leader_edges(placed, turn), sets, percent, unpack).distinct(), "found")
        parts = contracted(parts, links)
        settled, turn = links.count() <= enough, turn + 1
        if not settled:
            placed = _mixed(placed, parts)
    links = _rest(_placed(members, parts).drop("size"), sets, percent, block, unpack)
    return parts if links is None else contracted(parts, cut(links, "found"))
