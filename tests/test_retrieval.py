"""Stems, cover density, rankings and fusion on small made rankings, against plain loops."""

import random
from fractions import Fraction
from itertools import product

from pyspark.sql import functions as F

from quillspan.functions import stem
from quillspan.operators import retrieval as R


def test_positions_count_every_word():
    assert stem.positions("The cats, and the running CATS") == {"cat": [2, 6], "run": [5]}
    assert stem.positions("cats and dogs", {"dog"}) == {"dog": [3]} and stem.positions(None) == {}


def density(events, parts):
    """All extents tried; a cover is one that holds every part and no smaller one."""
    n = len(events)
    whole = [(i, j) for i, j in product(range(n), range(n)) if i <= j and {p for _, p in events[i : j + 1]} == set(range(parts))]
    covers = [(i, j) for i, j in whole if not any((a, b) != (i, j) and i <= a and b <= j for a, b in whole)]
    return sum(Fraction(1, 10) / (1 + events[j][0] - events[i][0] + 1 - (j - i + 1)) for i, j in covers)


def test_cover_density_of_every_extent(spark):
    rng, rows = random.Random(4), []
    for k in range(60):
        parts = rng.randrange(1, 4)
        places = sorted(rng.sample(range(1, 40), rng.randrange(1, 10)))
        rows.append((k, parts, [(p, rng.randrange(parts)) for p in places]))
    df = spark.createDataFrame(rows, "k int, parts int, events array<struct<position:int,part:int>>")
    got = {r.k: float(r.s) for r in df.where(F.size(F.array_distinct(F.col("events.part"))) == F.col("parts")).select("k", R.cover_density(F.col("events"), F.col("parts")).alias("s")).collect()}
    want = {k: float(density(e, parts)) for k, parts, e in rows if len({p for _, p in e}) == parts}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_matches_of_any_and_of_every(spark):
    docs = spark.createDataFrame([(1, "Running dogs run."), (2, "a dog and some other words run"), (3, None), (4, "")], "doc_id long, text string")
    asks = spark.createDataFrame([(7, "the dogs ran, the dog runs"), (8, None), (9, "of the")], "item_id long, text string")
    any_ = R.cover_matches(asks, "item_id", "text", docs, "doc_id", "text").collect()
    assert sorted((r.item_id, r.doc_id, float(r.score)) for r in any_) == [(7, 1, 0.3), (7, 2, 0.2)]
    every = R.cover_matches(asks, "item_id", "text", docs, "doc_id", "text", 3).collect()
    assert every == []  # "ran" stands in no text
    pair = spark.createDataFrame([(1, "dog run")], "item_id long, text string")
    both = R.cover_matches(pair, "item_id", "text", docs, "doc_id", "text", 2).collect()
    assert sorted((r.doc_id, round(float(r.score), 9)) for r in both) == [(1, 0.2), (2, 0.02)]  # three of the words between count no matter: a stop word too


def test_fewer_results_are_a_prefix_of_more(spark):
    rng = random.Random(8)
    rows = [(q, d, rng.randrange(5)) for q in range(4) for d in range(60)]
    scored = spark.createDataFrame(rows, "q int, d int, score int")
    order = [F.desc("score"), F.col("d")]
    ten = {(r.q, r.rank): r.d for r in R.ranked(scored, "q", order, 10).collect()}
    more = {(r.q, r.rank): r.d for r in R.ranked(scored, "q", order, 40).collect()}
    assert len(ten) == 40 and all(more[k] == d for k, d in ten.items())


def test_fusion_adds_both_ranks_and_breaks_ties(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3)], "q int, d string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "w", 2), (1, "x", 3)], "q int, d string, rank int")
    got = [(r.d, r.rank) for r in R.fuse(a, b, "q", "d").orderBy("rank").collect()]
    assert got == [("x", 1), ("z", 2), ("y", 3), ("w", 4)]


def test_malformed_rankings(spark):
    rows = [(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "a", 2), (3, "a", 1), (3, "b", 1), (4, "a", 2), (5, "a", 1), (5, "b", 3), (6, "a", None)] + [(7, f"d{i}", i) for i in range(1, 52)]
    df = spark.createDataFrame(rows, "q int, d string, rank int")
    got = sorted((r.q, r.problem) for r in R.ranking_problems(df, "q", "d").collect())
    assert got == [(2, "item_twice"), (3, "rank_twice"), (4, "not_dense"), (5, "not_dense"), (6, "not_dense"), (6, "rank_twice"), (6, "too_deep"), (7, "too_deep")]
