"""Inputs of model calls and retries on awkward rows; gates and scores on empty and null ones."""

from pyspark.sql import functions as F

from quillspan.functions import calls as C
from quillspan.operators import mapping as M


def test_calls(spark):
    rows = [("1500", "9", 3), ("soon", " 2.5 ", 1), ("-1", "10d", 4), (None, "Wed, 21 Oct 2026 07:28:00 GMT", 10), ("60000", None, 1)]
    df = spark.createDataFrame(rows, "ms string, s string, retry int")
    asked = C.retry_after(F.col("ms"), F.col("s"))
    out = df.select(asked.alias("asked"), C.retry_delay(F.col("retry"), asked, F.lit(0.5), 0.5, 8.0).alias("delay")).collect()
    assert [tuple(r) for r in out] == [(1.5, 1.5), (2.5, 2.5), (None, 2.0), (None, 4.0), (60.0, None)]
    texts = spark.createDataFrame([(None,), ("",), ("  \n",), (" why? ",), ("x" * 2001,)], "t string")
    out = [tuple(r) for r in texts.select(C.query_input(F.col("t"), "find"), C.document_input(F.col("t"))).collect()]
    assert out == [(None, None), (None, None), (None, None), ("Instruct: find\nQuery:why?", " why? "), (None, "x" * 2001)]
    place = spark.createDataFrame([(2, True, None, None), (2, None, 5, "a"), (None, None, 5, "a"), (None, None, None, "a / b"), (None, None, None, "")], "s int, n boolean, p int, t string")
    out = [r[0] for r in place.select(C.locator(F.col("s"), F.col("n"), F.col("p"), F.col("t"))).collect()]
    assert out == ["slide 2 notes", "slide 2", "page 5", "a / b", "section"]


def test_selections(spark):
    chosen = spark.createDataFrame([(1, "b", 1), (1, "x", 2), (1, "b", 3), (1, "a", 4), (2, "a", 1)], "c int, i string, p int")
    issued = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "c int, i string, o int")
    out = {(r.c, r.i, r.p): r.reason for r in M.selection_gate(chosen, issued, "c", "i", "p", "o").collect()}
    assert out == {(1, "b", 1): None, (1, "x", 2): M.UNKNOWN, (1, "b", 3): M.REPEATED, (1, "a", 4): None, (2, "a", 1): M.UNKNOWN}
    items = spark.createDataFrame([("q", "r", None, True), ("p", "r", None, False), ("s", "r", 2, True), ("t", "other", 9, True)], "case string, resource string, version int, stale boolean")
    versions = spark.createDataFrame([("r", 1), ("r", 2)], "resource string, version int")
    out = {tuple(r) for r in M.forbidden_versions(items, versions).collect()}
    assert out == {("q", "r", 1), ("p", "r", 1), ("p", "r", 2), ("t", "other", 9)}
    cases = spark.createDataFrame([(1, "materials"), (2, "no_material"), (3, "unlabelled")], "case int, expect string")
    none = spark.createDataFrame([], "case int, item int, selected boolean, bad boolean")
    gold = spark.createDataFrame([(1, 7)], "case int, item int")
    out = {r.case: (r.retrieval_hit, r.mapping_hit, r.category) for r in M.mapping_scores(cases, none, gold).collect()}
    assert out == {1: (False, False, "retrieval_miss"), 2: (None, None, "correct"), 3: (None, None, "unlabelled_for_review")}
