"""A stream of arrivals into versioned rows: the batch rule of ``version_history`` applied micro-batch by micro-batch.

Every batch is joined with the last version of its resources and appended
under its batch id; a batch that Spark replays after a failure overwrites its
own folder, so each arrival counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sync_stream(arrivals: DataFrame, target: str, checkpoint: str, resource: str, order: list[str], content: str):
    """Starts the stream until its present input is used up; versions land in ``target``/batch=N."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        w = Window.partitionBy(resource).orderBy(*order)
        marked = batch.withColumn("_before", F.lag(content).over(w)).withColumn("_n", F.row_number().over(w))
        if batch_id:
            stored = published_versions(spark, target).where(F.col("batch") < batch_id)
            last = stored.groupBy(resource).agg(F.max(F.struct("version_number", F.col(content).alias("_c"))).alias("_l"))
            marked = marked.join(last.select(resource, F.col("_l.version_number").alias("_v"), F.col("_l._c").alias("_c")), resource, "left")
        else:
            marked = marked.withColumn("_v", F.lit(None).cast("int")).withColumn("_c", F.lit(None).cast("string"))
        known = F.when(F.col("_n") > 1, F.col("_before")).otherwise(F.col("_c"))
        first = (F.col("_n") == 1) & F.col("_v").isNull()
        kept = marked.where(first | ~F.col(content).eqNullSafe(known))
        numbered = kept.withColumn("version_number", (F.coalesce("_v", F.lit(0)) + F.row_number().over(w)).cast("int"))
        numbered.drop("_before", "_n", "_v", "_c").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published_versions(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("basePath", target).parquet(f"{target}/batch=*")
