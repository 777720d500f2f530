"""Null ids beside the largest one, and neighbours of clustered, offset and very large vectors."""

import numpy as np
import pytest

from quillspan.llm import ann
from quillspan.llm.decontaminate import contaminated, drop_contaminated
from quillspan.llm.line_dedup import line_dedup, strip_lines

LARGEST = (1 << 63) - 1


def test_the_largest_id_and_none_are_two_documents(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(LARGEST, passage), (None, passage), (3, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = contaminated(docs, items).collect()
    assert sorted((r.doc_id for r in got), key=repr) == [LARGEST, None]
    assert [r.doc_id for r in drop_contaminated(docs, items).collect()] == [3]
    lines = spark.createDataFrame([(LARGEST, "a line that is long enough to count\nkeep me"), (None, "a line that is long enough to count\nme too")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup(lines).collect()} == {LARGEST: 0, None: 1}
    assert {r.doc_id: r.text for r in strip_lines(lines).collect()}[None] == "me too"


def clustered(n, clusters, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(clusters, 64))[rng.integers(0, clusters, n)] * 10 + rng.normal(size=(n, 64))


@pytest.mark.parametrize(("n", "clusters", "offset", "scale"), [(4000, 16, 0, 1), (4000, 80, 0, 1), (4000, 40, 0, 1), (3000, 16, 1e4, 1), (3000, 40, 1e4, 1e20), (3000, 1, 0, 1e-30), (3000, 2, 0, 1)])
def test_recall_in_one_shard(n, clusters, offset, scale):
    exact = (clustered(n, clusters) + offset) * scale
    data, (big, centre, radius) = ann._scaled(exact)
    assert np.isfinite(data).all()
    graph = ann.Graph.build(data)
    hits = 0
    queries = range(0, n, n // 40)
    for q in queries:
        distance = ((exact / scale - exact[q] / scale) ** 2).sum(axis=1)
        distance[q] = np.inf
        found = {i for _, i in graph.search((exact[q] / big - centre) / radius, 11)} - {q}
        hits += len(found & set(np.argsort(distance, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 10 * len(queries)


def test_neighbours_of_large_clustered_vectors(spark):
    data = (clustered(1500, 30, 3) + 1e4) * 1e20
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=500).collect()
    assert len(got) == 15 * 10
    hits = 0
    for q in range(0, 1500, 100):
        distance = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        distance[q] = np.inf
        best = np.lexsort((np.arange(1500), distance))[:10]
        own = {r.vec_id: r.score for r in got if r.query_id == q}
        hits += len(set(best.tolist()) & own.keys())
        assert all(abs(own[i] - distance[i]) <= 1e-9 * distance[i] for i in own)
    assert hits >= 0.95 * 150


def test_single_and_equal_vectors():
    for exact in (np.ones((1, 3)), np.ones((5, 3)), np.zeros((0, 3))):
        data, _ = ann._scaled(exact)
        assert np.isfinite(data).all() and len(ann.Graph.build(data).search(np.zeros(3), 3)) == min(3, len(exact))
