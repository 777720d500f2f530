"""SQL that must not depend on chance or on what the small tables hold."""

import duckdb
import pytest

from quillspan.functions import stem
from quillspan.operators import intervals
from quillspan.plans import registry

SF = "/root/testdata/sf0.001"


def test_union_length_of_equal_lines():
    """Every line forty times: equal intervals change no union, in whatever order a window meets them."""
    con = duckdb.connect()
    sql = registry.oracle_sql()["interval_union_length"]
    con.execute(f"create view once as select distinct l_orderkey, l_shipdate, l_quantity from '{SF}/lineitem.parquet'")
    con.execute("create table lineitem as select once.* from once, range(40)")
    many, one = con.sql(sql).fetchall(), con.sql(sql.replace("FROM lineitem", "FROM once")).fetchall()
    assert sorted(many) == sorted(one)


def test_union_length_of_equal_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 9, 12), (1, 20, 21)] * 30, "k long, start long, end long")
    assert [tuple(r) for r in intervals.union_length(rows, ["k"]).collect()] == [(1, 9, 3)]


@pytest.mark.parametrize("word", ["ygaue", "yll", "ylle", "yjarrll", "ydoueue", "yed", "yying", "xyying", "yyying", "ayyying", "yield", "yay", "syzygy", "by", "yellowed"])
def test_stem_of_a_word_that_begins_with_y(word):
    """A y that begins a word is a consonant, in the SQL as in the stemmer."""
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.execute("insert into documents values (1, ?)", [word])
    got = [r[0] for r in con.sql(registry.oracle_sql()["stemmed_lexemes"]).fetchall()]
    assert got == stem.lexemes(word)
