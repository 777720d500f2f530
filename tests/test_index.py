"""The commit log, index runs, and search on a pinned and verified version."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillspan.operators import chunking as C
from quillspan.operators import index as I

SPANS = "array<struct<kind:string,slide:int,start:int,end:int>>"


def test_versions_are_numbered_and_stay(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert I.latest(spark, root) == 0
    assert I.commit(spark.range(3), root, 0) == 1 and I.commit(spark.range(5), root, 1) == 2
    assert I.pinned(spark, root).count() == 5 and I.pinned(spark, root, 1).count() == 3
    # A writer that starts from an old version is told, and leaves nothing behind that a reader sees.
    with pytest.raises(I.Conflict):
        I.commit(spark.range(9), root, 1)
    with pytest.raises(FileNotFoundError):
        I.pinned(spark, root, 3)
    assert I.append(spark.range(9), root) == 3 and I.pinned(spark, root).count() == 9
    assert I.pinned(spark, root).dtypes == spark.range(1).dtypes


def test_of_two_writers_one_wins(spark, tmp_path):
    root = f"{tmp_path}/t"
    I.commit(spark.range(1), root, 0)

    def write(n):
        try:
            return I.commit(spark.range(n), root, 1)
        except I.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(write, [10, 20, 30, 40]))
    assert sorted(x for x in got if x) == [2] and I.latest(spark, root) == 2
    assert I.pinned(spark, root, 2).count() == [10, 20, 30, 40][got.index(2)]
    with pytest.raises(I.Conflict):
        I._put_if_absent(spark, I._entry(root, 2), "{}")
    names = sorted(p.name for p in (tmp_path / "t" / "log").iterdir() if not p.name.startswith("."))
    assert names == [f"{n:020}.json" for n in (1, 2)]


def versions(spark, rows):
    return spark.createDataFrame(rows, f"course int, v int, text string, spans {SPANS}")


def line(text):
    return [("paragraph", None, 0, len(text))]


def test_runs_isolate_versions(spark):
    text = "The cats sat. " * 40
    rows = [(1, 1, text, line(text)), (1, 2, None, []), (1, 3, " \n", line(" \n")), (1, 4, text, [("p", None, 5, 9), ("p", None, 2, 4)]), (1, 5, text, [("p", None, 0, 10**6)]), (1, 6, text, line(text)), (1, 7, text, line(text[:100]))]
    table = versions(spark, rows)
    before = C.chunk_documents(versions(spark, rows[:1] + [(1, 6, "old", line("old"))]), "v")
    chunks, outcomes = I.index_run(table, before, "v")
    got = {r.v: (r.outcome, r.stage, r.error) for r in outcomes.collect()}
    assert got == {1: ("unchanged", None, None), 2: ("failed", "load", "invalid_source"), 3: ("no_visible_text", None, None), 4: ("failed", "load", "invalid_source"), 5: ("failed", "load", "invalid_source"), 6: ("indexed", None, None), 7: ("failed", "check", "uncovered_text")}
    assert {r.v for r in chunks.collect()} == {1, 6}
    assert {r.v: r.outcome for r in I.index_run(table, None, "v")[1].collect()}[1] == "indexed"


def test_search_is_pinned_and_verified_twice(spark, tmp_path):
    root = f"{tmp_path}/i"
    one, two, three = "Cats and dogs run.\n\nA dog.", "Cats only.", "Dogs of another course."
    table = versions(spark, [(1, 1, one, [("p", None, 0, 18), ("p", None, 20, 26)]), (1, 2, two, line(two)), (2, 3, three, line(three)), (1, 4, "No dogs here yet.", line("x"))])
    chunks, _ = I.index_run(table.where("v < 4"), None, "v")
    I.commit(chunks, root, 0)
    asks = spark.createDataFrame([(7, 1, "the dogs"), (8, 1, "cat"), (9, 1, "of the"), (10, 2, "dog")], "request int, course int, text string")
    called = []
    hits, states = I.search(spark, root, table, asks, "course", "v", 5, between=lambda: called.append(1))
    assert called == [1]
    assert sorted((r.request, r.rank, r.v, float(r.score)) for r in hits.collect()) == [(7, 1, 1, 0.2), (8, 1, 1, 0.1), (8, 2, 2, 0.1), (10, 1, 3, 0.1)]
    assert {r.v: r.state for r in states.collect()} == {1: "searchable", 2: "searchable", 3: "searchable", 4: "unindexed"}
    # A later version of the index changes nothing for who has pinned the first.
    I.commit(chunks.where("v = 2"), root, 1)
    again, _ = I.search(spark, root, table, asks, "course", "v", 5, version=1)
    assert again.count() == 4 and I.search(spark, root, table, asks, "course", "v", 5)[0].count() == 1
    for k in (0, 51):
        with pytest.raises(ValueError):
            I.search(spark, root, table, asks, "course", "v", k)


def test_a_corrupt_scope_is_refused(spark, tmp_path):
    root = f"{tmp_path}/i"
    text = "Cats and dogs."
    table = versions(spark, [(1, 1, text, line(text)), (2, 2, text, line(text))])
    chunks, _ = I.index_run(table, None, "v")
    bad = chunks.withColumn("text_hash", F.when(F.col("v") == 1, "x").otherwise(F.col("text_hash")))
    I.commit(bad, root, 0)
    asks = spark.createDataFrame([(7, 1, "dogs"), (8, 2, "dogs")], "request int, course int, text string")
    called = []
    with pytest.raises(I.CorruptIndex, match=r"\[1\]"):
        I.search(spark, root, table, asks, "course", "v", between=lambda: called.append(1))
    assert not called
    # Who does not ask the corrupt scope is served.
    assert I.search(spark, root, table, asks.where("course = 2"), "course", "v")[0].count() == 1
    for broken in (chunks.withColumn("chunk_ordinal", F.col("chunk_ordinal") + 1), chunks.withColumn("end_offset", F.lit(4).cast("long")).withColumn("text_hash", F.sha2(F.lit("Cats"), 256))):
        number = I.append(broken, root)
        with pytest.raises(I.CorruptIndex):
            I.search(spark, root, table, asks, "course", "v", version=number)
