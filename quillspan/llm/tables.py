"""Written intermediate tables: lineage is cut by Parquet files in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, as in tests, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quillspan-{name}-{uuid.uuid4().hex}"


#: Has Spark remove a query's shuffle files at its end, on all executors, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again; survives the loss of any executor. What it shuffled goes."""
    path = new_folder(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Stands for a null ``doc_id`` where rows are ordered: after all others.
LAST = (1 << 63) - 1


def versioned(docs: DataFrame, doc: str = "doc", version: str = "version") -> DataFrame:
    """``docs`` with a non-null ``doc`` and a hash of the text that tells rows of one id apart; it is odd where the id is null, so that one is never taken for the largest id."""
    known = F.col("doc_id").isNull().cast("long")
    return docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), version: F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(known)})


def named(doc: str = "doc", version: str = "version") -> Column:
    """The ``doc_id`` of a row that ``versioned`` marked."""
    return F.when(F.col(version).bitwiseAND(F.lit(1)) == 0, F.col(doc))
