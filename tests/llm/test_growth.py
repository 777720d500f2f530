"""What steps hand on and leave on disk follows the input."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspan.llm import linking, tables


def test_a_chain_of_buckets_is_not_compared_as_a_whole(spark, monkeypatch):
    """Texts that only a chain of others joins never meet: what is handed to the exact step follows the texts and not the chain's square, and each pair of a bucket is there."""
    n, of = 400, 50
    members = spark.createDataFrame([(k, d, d) for k in range(n - 1) for d in (k, k + 1)], "key long, doc_id long, component long")
    sets = spark.createDataFrame([(d, of, np.arange(d * of, (d + 1) * of, dtype=np.uint64).tobytes()) for d in range(n)], "doc_id long, n long, shingles binary")

    def met(percent, unpack):
        def run(table):
            own = sorted(set(table.column("component").to_pylist()))
            rows = [(table.num_rows, -1)] + [(a, a + 1) for a in own if a + 1 in own]
            return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=["ca", "cb"])

        return run

    monkeypatch.setattr(linking, "_against_block", met)
    rows = linking._rest(members, sets, 75, 8 * of, linking.stored).collect()
    assert {(r.ca, r.cb) for r in rows if r.cb >= 0} == {(d, d + 1) for d in range(n - 1)}
    assert sum(r.ca for r in rows if r.cb < 0) <= 3 * n


def test_a_written_table_leaves_no_shuffle_files(spark):
    """What a step shuffled goes when it is written, so disk follows the largest step and not their sum."""
    files = lambda: sum("shuffle_" in b.name() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()))
    before = files()
    for i in range(3):
        table = tables.cut(spark.range(5000).withColumn("k", F.col("id") % 97).groupBy("k").agg(F.sum("id").alias("s")), "summed")
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before
    assert table.count() == 97 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
