"""Exact dedup against a plain dictionary of texts, whatever the number of runs."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillspan.llm.exact_dedup import drop_copies, entries, exact_dedup, merge_runs


def plain(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def expected(rows):
    """doc_id, keep_id, group_size and digest of each row, and how many rows of each group stay."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(plain(text), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for doc, text in rows:
        own = groups[plain(text)]
        out.append((doc, min(own)[3], len(own), hashlib.sha256(plain(text).encode()).hexdigest()))
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("partitions", [1, 4, 100])
def test_every_number_of_runs_gives_the_same_groups(spark, docs, rows, partitions):
    got = exact_dedup(docs.repartition(5), partitions).collect()
    want, groups = expected(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == want
    assert len({r.text_sha256 for r in got if r.kept}) == sum(r.kept for r in got) == groups


def test_rules(spark):
    rows = [(5, "a b"), (3, "ab"), (9, "a  b"), (7, "a\t\nb"), (1, "ab"), (None, "a  b"), (2, ""), (4, None), (6, " \x0b\x0c"), (8, "a b"), (10, "é😀"), (11, "é 😀")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "digest", "best", "n", "run", "size", "check", "chars")})
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect()}
    assert got[9] == (7, 6, False) and got[7] == (7, 6, True) and got[None] == (7, 6, False)
    assert got[2] == (6, 3, False) and got[6] == (6, 3, True) and got[8] == (8, 1, True)
    assert got[10] == (11, 2, False)
    assert sorted(r.doc_id for r in drop_copies(df).collect()) == [6, 7, 8, 11]
    assert drop_copies(df).columns == df.columns


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "same text")] * 40 + [(2, "same  text"), (2, "same  text")], "doc_id long, text string").repartition(7)
    got = exact_dedup(df, 8).collect()
    assert [r.kept for r in got].count(True) == 1 and {r.keep_id for r in got} == {2} and {r.group_size for r in got} == {42}


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_hot_text_is_one_entry_a_run(spark):
    """The digests that meet in a round are distinct within each run, however often a text repeats."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text")).repartition(6)
    merged = merge_runs(entries(df), 8)
    assert {(r.n, r.best.doc_id) for r in merged.where("n > 1").collect()} == {(2000, 0)} and merged.count() == 4001
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 1 and "Python" not in plan and "Arrow" not in plan
