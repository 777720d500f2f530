"""Aggregations with exact null and tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_or_null(value: Column) -> Column:
    """The sum, or null as soon as one value is null."""
    return F.when(F.count("*") == F.count(value), F.sum(value))


def distribution(value: str) -> list[Column]:
    """Least, nearest-rank p50 and p95, greatest."""
    rank = "percentile_disc({p}) within group (order by {v})"
    return [
        F.min(value).alias("least"),
        F.expr(rank.format(p=0.5, v=value)).alias("p50"),
        F.expr(rank.format(p=0.95, v=value)).alias("p95"),
        F.max(value).alias("most"),
    ]


def best_title(title: str) -> Column:
    """The longest title, then the smallest."""
    return F.min_by(title, F.struct(-F.length(title), F.col(title)))


def zero_filled(rows: DataFrame, code: str, codes: DataFrame) -> DataFrame:
    """Counts over the full list of codes, 0 where none occurs."""
    return codes.join(rows.groupBy(code).agg(F.count("*").alias("n")), code, "left").select(code, F.coalesce("n", F.lit(0)).alias("n"))


def bool_states(value: Column, all_true: str, any_true: str, none: str) -> Column:
    """One of three names by whether all, some or none of a group's values hold."""
    return F.when(F.bool_and(value), all_true).when(F.bool_or(value), any_true).otherwise(none)
