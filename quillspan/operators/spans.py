"""Structural spans with exact code-point offsets into their version's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def line_spans(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Non-blank lines: key, ordinal from 0, start_offset, end_offset (half-open), excerpt; ``text[start:end] = excerpt``."""
    parts = texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("_line", "excerpt"))
    w = Window.partitionBy(key).orderBy("_line")
    before = F.coalesce(F.sum(F.length("excerpt") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("start_offset", before).where("excerpt rlike '\\\\S'")
    return placed.select(
        key,
        (F.row_number().over(w) - 1).alias("ordinal"),
        "start_offset",
        (F.col("start_offset") + F.length("excerpt")).alias("end_offset"),
        "excerpt",
    )


def layout(blocks: DataFrame, key: str, order: str, text: str, separator: int = 2) -> DataFrame:
    """Ordinals and offsets of blocks joined by a separator of so many characters."""
    w = Window.partitionBy(key).orderBy(order)
    start = F.coalesce(F.sum(F.length(text) + separator).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("start_offset", start)
    return placed.withColumn("end_offset", F.col("start_offset") + F.length(text))


def together(blocks: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Consecutive blocks of one kind share a group number, from 1."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return blocks.withColumn("_c", change).withColumn("group_number", F.sum("_c").over(w)).drop("_c")


def spans_of_ranges(ranges: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Each range's spans: rows of ``spans`` whose ordinal lies in [first_span, last_span]; an equi-join on exploded ordinals."""
    wide = ranges.withColumn("ordinal", F.explode(F.sequence("first_span", "last_span")))
    return wide.join(spans, [key, "ordinal"])


def span_problems(spans: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, problem) of spans that cannot be chunked: none may be left.

    ``spans``: key, ordinal, start_offset, end_offset; ``texts``: key, text.
    not_numbered (ordinals are not 0 to n - 1), outside_text (empty, or beyond
    the text), not_in_order (begins before the one before it ends), the first
    of these a span; no_spans, with no ordinal, for a text without any.
    """
    w = Window.partitionBy(key).orderBy("ordinal", "start_offset")
    rows = spans.join(texts.select(key, F.length("text").alias("_length")), key)
    rows = rows.withColumns({"_n": F.row_number().over(w) - 1, "_end": F.lag("end_offset").over(w)})
    inside = (F.col("start_offset") >= 0) & (F.col("start_offset") < F.col("end_offset")) & (F.col("end_offset") <= F.col("_length"))
    problem = F.when(F.col("ordinal") != F.col("_n"), "not_numbered").when(~F.coalesce(inside, F.lit(False)), "outside_text").when(F.col("start_offset") < F.col("_end"), "not_in_order")
    wrong = rows.select(key, "ordinal", problem.alias("problem")).where("problem is not null")
    bare = texts.select(key).join(spans.select(key), key, "left_anti").select(key, F.lit("no_spans").alias("problem"))
    return wrong.unionByName(bare, allowMissingColumns=True)
