"""Tables written in the folder that the whole cluster shares, and read again: what is used several times is computed once and survives a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, as in tests, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillspan-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int, dealt: bool = False) -> DataFrame:
    """The rows of ``df``, written once in buckets of ``column``.

    Joins and groups by keys that hold ``column`` then need no shuffle, if the
    other side is bucketed or repartitioned alike.  ``dealt``: ``df`` is.
    Joins by further keys as well need a setting of the session for that, which
    changes no result.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    path = shared_folder(spark)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    rows = df if dealt else df.repartition(buckets, column)
    rows.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    return spark.table(name)
