"""Half-open intervals: overlap and containment joins on bucketed keys, union length, run-length ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(start: Column, end: Column, width: int) -> Column:
    last = F.greatest(start, end - 1)
    return F.explode(F.sequence(F.floor(start / width), F.floor(last / width)))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], width: int) -> DataFrame:
    """Pairs with ``a.start < b.end and b.start < a.end`` within equal ``on``; columns of the sides are prefixed a_ and b_.

    Both sides are dealt to time buckets of ``width``, so that the join is an
    equi-join; a pair counts in the bucket where its overlap begins.
    """
    a = left.select(*on, *[F.col(c).alias(f"a_{c}") for c in left.columns if c not in on]).withColumn("_b", _buckets(F.col("a_start"), F.col("a_end"), width))
    b = right.select(*on, *[F.col(c).alias(f"b_{c}") for c in right.columns if c not in on]).withColumn("_b", _buckets(F.col("b_start"), F.col("b_end"), width))
    begins = F.greatest("a_start", "b_start")
    joined = a.join(b, [*on, "_b"]).where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    return joined.where(F.floor(begins / width) == F.col("_b")).withColumn("overlap", F.least("a_end", "b_end") - begins).drop("_b")


def containment_join(inner: DataFrame, outer: DataFrame, on: list[str], width: int) -> DataFrame:
    """Overlapping pairs whose first interval lies wholly within the second."""
    return overlap_join(inner, outer, on, width).where((F.col("a_start") >= F.col("b_start")) & (F.col("a_end") <= F.col("b_end")))


def merged(rows: DataFrame, on: list[str]) -> DataFrame:
    """The union of each key's intervals as (on, start, end); touching ones merge."""
    w = Window.partitionBy(*on).orderBy("start", "end")
    ahead = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(ahead.isNull() | (F.col("start") > ahead), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(w)).groupBy(*on, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return islands.drop("_island")


def union_length(rows: DataFrame, on: list[str]) -> DataFrame:
    """Total length of the union of each key's intervals; touching ones merge."""
    return merged(rows, on).groupBy(*on).agg(F.sum(F.col("end") - F.col("start")).alias("union_length"), F.count("*").alias("n_ranges"))


def uncovered(base: DataFrame, covers: DataFrame, on: list[str], width: int) -> DataFrame:
    """What the covers of a key leave of each base interval, as (on, start, end); empty intervals cover nothing.

    The gaps between merged covers, and those before and behind them, are met
    with the base by ``overlap_join``.
    """
    reach = base.groupBy(*on).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    ends = reach.select(*on, F.explode(F.array("_lo", "_hi")).alias("start")).withColumn("end", F.col("start"))
    solid = merged(covers.where(F.col("start") < F.col("end")).select(*on, "start", "end"), on)
    w = Window.partitionBy(*on).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = solid.unionByName(ends).withColumn("_before", before).where(F.col("_before") < F.col("start")).select(*on, F.col("_before").alias("start"), F.col("start").alias("end"))
    met = overlap_join(base.select(*on, "start", "end"), gaps, on, width)
    return met.select(*on, F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"))


def run_ranges(rows: DataFrame, on: list[str], number: str) -> DataFrame:
    """Distinct numbers of each key as text such as ``1-3, 7``."""
    w = Window.partitionBy(*on).orderBy(number)
    runs = rows.select(*on, number).distinct().withColumn("_run", F.col(number) - F.row_number().over(w))
    ends = runs.groupBy(*on, "_run").agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    lists = ends.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))).alias("_l"))
    return lists.select(*on, F.array_join(F.transform("_l", lambda x: x["t"]), ", ").alias("ranges"))


def ranges_text(numbers: Column) -> Column:
    """A sorted array of distinct numbers as text such as ``1-3, 7``."""
    starts = F.filter(numbers, lambda x, i: (i == 0) | (F.get(numbers, i - 1) != x - 1))
    ends = F.filter(numbers, lambda x, i: (i == F.size(numbers) - 1) | (F.get(numbers, i + 1) != x + 1))
    text = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b)))
    return F.array_join(text, ", ")
