import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents and awkward rows: nulls, blanks, copies, near copies, repeated rows, clashing extra columns."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    long_ = " ".join(f"w{i % 997}x{i}" for i in range(9000))
    near = [f"t{i}" for i in range(60)]
    other = [*near[:30], "changed", *near[31:]]
    rows = [
        (10_001, None),
        (10_002, ""),
        (10_003, " \n\t "),
        (10_004, "one two"),
        (10_005, "One  two"),
        (10_006, long_),
        (10_007, long_ + " end"),
        (10_008, " ".join(near)),
        (10_009, " ".join(other)),
        (10_009, " ".join(other)),
        (None, " ".join(near)),
        (10_010, "é😀 ñ\r\nsecond line here and more words follow now\nsecond line here and more words follow now"),
        (10_011, "x" * 30_000),
        (10_012, "a b c d e " * 400),
    ]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    both = base.union(extra)
    # Columns that operators use inside must not clash.
    return both.withColumns({c: F.lit(None).cast("string") for c in ("doc", "version", "component", "node", "n", "key", "spans", "a", "b", "lang", "line")})


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
