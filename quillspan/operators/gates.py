"""Evidence gates: a proposed fact stands only on a quote that its source contains and that supports its value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import statements as S


def gate(proposals: DataFrame, units: DataFrame, on: str, supported: Column) -> DataFrame:
    """Proposals with start, end and the first reason that refuses them, or null.

    ``proposals``: on, quote and what ``supported`` reads; ``units``: on, text.
    Reasons in order: unknown_unit, empty_quote, quote_not_found, injected
    (every place lies in an injected passage) and value_unsupported.
    """
    joined = proposals.join(units.select(on, "text"), on, "left")
    placed = joined.withColumns({"_q": S.quotes_once("text", "quote"), "_i": S.injections_once("text")})
    clean = F.filter("_q", lambda q: ~F.exists("_i", lambda i: (q["start"] < i["end"]) & (i["start"] < q["end"])))
    placed = placed.withColumn("_c", clean)
    reason = (
        F.when(F.col("text").isNull(), "unknown_unit")
        .when(F.trim(F.coalesce("quote", F.lit(""))) == "", "empty_quote")
        .when(F.size("_q") == 0, "quote_not_found")
        .when(F.size("_c") == 0, "injected")
        .when(~F.coalesce(supported, F.lit(False)), "value_unsupported")
    )
    first = F.get("_c", F.lit(0))
    return placed.select(*[proposals[c] for c in proposals.columns], first["start"].alias("start"), first["end"].alias("end"), reason.alias("reason"))
