"""Empty tables, and the pipeline's stages over nulls, repeated rows, copies and clashing columns."""

import corpus_pipeline
from quillspan.llm import ann, pii, warc

LARGEST = (1 << 63) - 1
CLASHING = "doc version n key spans line component node lang source n_chars".split()


def prose(topic, n=60):
    return " ".join(f"{topic}{i % 17}x{i}" for i in range(n))


def awkward(spark):
    near = prose("near", 80).split()
    rows = [
        (1, prose("a")),
        (2, prose("a")),
        (3, " ".join(near)),
        (4, " ".join([*near[:40], "changed", *near[41:]])),
        (5, None),
        (6, ""),
        (6, ""),
        (7, " \n\t\n"),
        (8, prose("b")),
        (8, prose("b")),
        (None, prose("c")),
        (None, None),
        (LARGEST, prose("d")),
        (9, "x" * 30_000),
        (10, prose("long", 9_000)),
    ]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumns({c: F.length("text").cast("long") if c == "n_chars" else F.lit("x") for c in CLASHING})


def test_stages_over_awkward_rows(spark, sf):
    docs = awkward(spark).repartition(3)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns, name
            out = spark.createDataFrame(out.collect(), docs.schema)
        seen.append((name, out))
        docs = out
    kept = {name: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr) for name, df in seen[:-1]}
    before = sorted(((r.doc_id, r.text) for r in awkward(spark).collect()), key=repr)
    assert kept["toxicity"] == before
    # Lines that stand earlier go; a text left without lines goes, blank and null texts stay.
    lines = [d for d, _ in kept["line_dedup"]]
    assert 2 not in lines and 1 in lines and 5 in lines and 7 in lines and lines.count(6) == 2 and lines.count(None) == 2
    near = [d for d, _ in kept["near_duplicates"]]
    assert 3 in near and 4 not in near and 10 in near
    assert kept["decontamination"] == kept["near_duplicates"]
    # Every row that is left has its pieces, gapless, in sequences of at most 4096.
    pieces = seen[-1][1].collect()
    filled = {}
    for p in pieces:
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert {p.doc_id for p in pieces} == {d for d, _ in kept["decontamination"]}
    assert sum(p.piece == 0 for p in pieces) == len(kept["decontamination"])


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pii_report(none).collect() == []
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert ann.nearest(spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (100, [1.0, float("nan")])], "vec_id long, embedding array<float>")).collect() == []
    path = f"{tmp_path}/warc"
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path, compression="gzip")
    assert warc.page_records(warc.read_warc(spark, path)).collect() == []
