"""Ranked search against a plain loop over all documents, in any number of shards and passes."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import lexical
from quillspan.llm.lexical import Best, Shard, ranked_search, search_shard

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOW))


def expected(docs, items, limit=50):
    counted = [(d, Counter(words(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        rows = []
        for d, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows, key=lambda x: x[:3])[:limit], 1)]
    return sorted(out, key=repr)


def awkward(spark):
    items = [(1, "one two W3 é w5"), (2, None), (3, ""), (4, "..."), (None, "t1 T2 t3"), (5, "a"), (6, "a b"), (6, "second line"), (7, "nowhere-to-be-found zzqx"), (8, "x" * 30_000 + " t5")]
    return spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "rank", "score", "term", "n")})


@pytest.mark.parametrize(("limit", "terms", "cells"), [(50, 500_000, 1 << 24), (3, 5, 1 << 24), (50, 500_000, 700)])
def test_against_a_loop(spark, docs, rows, limit, terms, cells):
    items = awkward(spark)
    got = [tuple(r) for r in ranked_search(docs, items, limit, terms, cells).collect()]
    assert sorted(got, key=repr) == expected(rows, [(r.item_id, r.text) for r in items.select("item_id", "text").collect()], limit)


def test_ties_and_repeated_rows(spark):
    rows = [(i % 70, "same words here") for i in range(140)] + [(None, "same words here"), (200, "others entirely")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "SAME here")], "item_id long, text string")
    got = sorted(tuple(r) for r in ranked_search(docs, items).collect())
    assert got == sorted(expected(rows, [(1, "SAME here")])) and [r[2] for r in got[:4]] == [0, 0, 1, 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search(none, items).collect() == []
    assert ranked_search(items.select(F.col("item_id").alias("doc_id"), "text"), items.where("false")).collect() == []


def test_long_texts_and_beyond_64_bits(spark):
    assert lexical.lengths(np.array([10**7]), 10**11, 10**14)[0] == 50 + 50 * 10**7 * 10**11 // 10**14
    rows = [(1, "rare " + "word " * 200_000), (2, "rare other"), (3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "rare word")], "item_id long, text string")
    assert sorted(tuple(r) for r in ranked_search(docs, items).collect()) == expected(rows, [(1, "rare word")])


def test_blocks_are_skipped_and_nothing_is_lost():
    """Two kinds of documents share a frequent term; an item of one kind scores few blocks of the other, and the best are those of a full scan."""
    rng = np.random.default_rng(3)
    n, terms = 4000, 400
    hits = [np.unique(np.concatenate([[0], rng.integers(1, 200, 12) + 199 * (d % 2)])) for d in range(n)]
    rows, columns = np.repeat(np.arange(n), [len(h) for h in hits]), np.concatenate(hits)
    impacts, weights = rng.integers(1, 1_000_000, len(rows)), np.concatenate([[3000], rng.integers(1000, 3000, terms - 1)])
    shard = Shard(rows, columns, impacts, n, weights)
    met = {}
    for item in (np.array([0, 5, 17, 33]), np.array([0, 250, 260]), np.array([0])):
        best, told = Best(50), {}
        search_shard(shard, item, weights, {c: np.arange(terms) for c in range(terms)}, best, np.zeros(n, bool), np.arange(n), told)
        scores = shard.impacts[:, item].astype(np.int64) @ weights[item]
        order = np.lexsort((np.arange(n), -scores))[:50]
        assert best.docs.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()
        met = {k: met.get(k, 0) + v for k, v in told.items()}
    assert met["scored"] < 0.8 * met["met"]
