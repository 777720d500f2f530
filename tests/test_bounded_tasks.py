"""What one task holds does not grow with the tables."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import index as I
from quillspan.operators import retrieval as R
from quillspan.plans import registry

SF = "/root/testdata/sf0.001"


def pairs(spark):
    texts = spark.createDataFrame([(i, f"the red fox {i % 7} saw the {'blue ' * (i % 3)}hen") for i in range(60)], "id long, t string")
    asks = spark.createDataFrame([(1, "the blue fox"), (2, "hen 3 3"), (3, "nothing here but The")], "q long, t string")
    return R.lexical_matches(asks, "q", "t", texts, "id", "t")


def test_lexical_pairs_are_counted_where_their_text_is(spark, monkeypatch):
    whole = {tuple(r) for r in pairs(spark).collect()}
    assert (1, 2, 5, 3) in whole and (3, 2, 2, 1) in whole
    monkeypatch.setattr(R, "PAIRS", 15)
    dealt = pairs(spark)
    assert dealt.rdd.getNumPartitions() == 12  # 60 texts, 3 queries, 15 pairs a task
    assert {tuple(r) for r in dealt.collect()} == whole
    placed = {(r.id, r.p) for r in dealt.withColumn("p", F.spark_partition_id()).collect()}
    assert len(placed) == 60 and len({p for _, p in placed}) > 6


def test_two_rankings_keep_a_tasks_best_before_the_shuffle(spark):
    both = R.ranked_twice(pairs(spark), "q", "id", [F.desc("shared"), F.col("score"), F.col("id")], [F.desc("score"), F.col("id")], 4)
    assert both._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    rows = both.collect()
    assert sorted(r.rank_a for r in rows if r.q == 1 and r.rank_a) == sorted(r.rank_b for r in rows if r.q == 1 and r.rank_b) == [1, 2, 3, 4]


def passes(df):
    """Python passes that a table still has to make, in its physical plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum(text.count(name) for name in ("MapInArrow", "ArrowEvalPython"))


def test_an_index_run_packs_once(spark):
    kind = "id long, text string, spans array<struct<kind:string,slide:int,start:bigint,end:bigint>>"
    versions = spark.createDataFrame([(1, "abcd", [("paragraph", None, 0, 4)]), (2, None, []), (3, "  ", [])], kind)
    _, outcomes = I.index_run(versions, None, "id")
    assert passes(outcomes) == 0
    assert {(r.id, r.outcome) for r in outcomes.collect()} == {(1, "indexed"), (2, "failed"), (3, "no_visible_text")}


@pytest.mark.parametrize("name", ["chunk_stats", "chunk_check", "injection_control"])
def test_python_passes_are_made_once(spark, name):
    """What several steps read is written once, so no pass is left that is made again for each."""
    assert passes(registry.queries()[name](spark, SF)) <= 1


@pytest.mark.parametrize("name", ["claim_validation", "requirement_gate"])
def test_lines_are_grouped_once(spark, name):
    assert "lineitem.parquet" not in registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_vectors_give_the_best_of_all(spark, monkeypatch):
    """The same ranks and scores as of all pairs, whatever the blocks, with copies that tie; few rows leave a block."""
    rng = random.Random(9)
    rows = [(i, i % 2, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    rows += [(200 + i, 0, rows[4][2]) for i in range(60)] + [(300, None, rows[1][2]), (301, 7, rows[1][2])]
    df = spark.createDataFrame(rows, "id long, label int, embedding array<float>")
    asks = df.where("id % 20 = 4 or id = 301").withColumnRenamed("id", "q")
    every = {tuple(r) for r in R.ranked(R.vector_scores(asks, "q", df, "id", "label"), "q", [F.desc("score"), F.col("id")], 5).select("q", "id", "score", "rank").collect()}
    for block in (1024, 16):
        monkeypatch.setattr(R, "BLOCK", block)
        near = R.nearest(asks, "q", df, "id", "label", 5)
        assert {tuple(r) for r in R.ranked(near, "q", [F.desc("score"), F.col("id")], 5).select("q", "id", "score", "rank").collect()} == every
        assert block < 1024 or near.count() < 100
