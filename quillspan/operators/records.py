"""Records of an evidence base: tagged subjects, edges, pooled totals, run summaries, and the states of what an index holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZERO, COMPLETE, INCONSISTENT = "zero", "complete", "inconsistent"
SEARCHABLE, UNINDEXED, CORRUPT = "searchable", "unindexed", "corrupt"


def _named(named: dict[str, DataFrame]) -> DataFrame:
    """All subjects as (type, key as text, label)."""
    parts = [rows.select(F.lit(name).alias("_type"), F.col("key").cast("string").alias("_key"), "label") for name, rows in named.items()]
    return reduce(DataFrame.union, parts)


def subjects(links: DataFrame, kind: str, ref: str, named: dict[str, DataFrame]) -> DataFrame:
    """Each link with the label of the one subject that its type names; null where there is none.

    ``named``: for each type its subjects as (key, label).  The links are read
    once and joined once, on type and key together.
    """
    every = _named(named)
    met = links.join(every, (F.col(kind) == F.col("_type")) & (F.col(ref).cast("string") == F.col("_key")), "left")
    return met.select(*links.columns, "label")


def edge_ends(edges: DataFrame, named: dict[str, DataFrame]) -> DataFrame:
    """Edges (from_kind, from_id, to_kind, to_id) with the labels of both ends: two joins, whatever the number of types."""
    first = subjects(edges, "from_kind", "from_id", named).withColumnRenamed("label", "from_label")
    return subjects(first, "to_kind", "to_id", named).withColumnRenamed("label", "to_label")


def pooled(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """Counts, sums and extremes of each group and, with a null group, of all rows: from the rows, not from the groups' figures."""
    measured = rows.select(F.col(group).alias(group), value.alias("_v"))
    return measured.rollup(group).agg(F.count("_v").alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.grouping(group).cast("int").alias("pooled"))


def run_summary(rows: DataFrame, run: str, outcome: str, reason: str) -> DataFrame:
    """How many rows of each run had each outcome and, for those with one, each reason."""
    return rows.groupBy(run, outcome, reason).agg(F.count("*").alias("n"))


def listed(rows: DataFrame, manifest: DataFrame, key: str, order: str) -> DataFrame:
    """The rows whose key the manifest lists, with the manifest's order; a key listed twice counts at its first place."""
    places = manifest.groupBy(key).agg(F.min(order).alias("place"))
    return rows.join(places, key)


def worded(rows: DataFrame, text: str, like: str, pattern: str) -> DataFrame:
    """Rows whose text matches the pattern; a case-insensitive LIKE narrows them first."""
    return rows.where(F.col(text).ilike(like)).where(F.col(text).rlike(pattern))


def content_class(text: Column, spans_in_order: Column) -> Column:
    """What a version can give an index: invalid without a text or with spans out of order, no_visible_text, or chunkable."""
    return F.when(text.isNull() | ~F.coalesce(spans_in_order, F.lit(False)), "invalid").when(~text.rlike("(?U)\\S"), "no_visible_text").otherwise("chunkable")


def link_state(expected: DataFrame, stored: DataFrame, owner: str, item: str) -> DataFrame:
    """Whether an owner's stored links are none, exactly the expected ones, or neither."""
    both = expected.select(owner, item, F.lit(True).alias("_e")).join(stored.select(owner, item).distinct().withColumn("_s", F.lit(True)), [owner, item], "full")
    counts = both.groupBy(owner).agg(F.count_if(F.col("_e")).alias("e"), F.count_if(F.col("_s")).alias("s"), F.count_if(F.col("_e") & F.col("_s")).alias("b"))
    return counts.select(owner, F.when(F.col("s") == 0, ZERO).when((F.col("e") == F.col("b")) & (F.col("s") == F.col("b")), COMPLETE).otherwise(INCONSISTENT).alias("state"))


def search_state(versions: DataFrame, scope: str, state: str) -> DataFrame:
    """One state a scope: corrupt if any version is inconsistent, unindexed if any has none, else searchable."""
    worst = versions.groupBy(scope).agg(F.bool_or(F.col(state) == INCONSISTENT).alias("_c"), F.bool_or(F.col(state) == ZERO).alias("_u"))
    return worst.select(scope, F.when(F.col("_c"), CORRUPT).when(F.col("_u"), UNINDEXED).otherwise(SEARCHABLE).alias("state"))


def refuse_corrupt(states: DataFrame, scope: str) -> DataFrame:
    """The states, which fail when read if a scope is corrupt."""
    said = F.concat(F.lit("corrupt index of "), F.col(scope).cast("string"))
    return states.withColumn("state", F.when(F.col("state") == CORRUPT, F.raise_error(said)).otherwise(F.col("state")))


def locator_violations(blocks: DataFrame, kind: str, needed: dict[str, list[str]]) -> DataFrame:
    """Blocks without a locator that their kind requires."""
    tests = [(F.col(kind) == name) & reduce(Column.__or__, [F.col(c).isNull() for c in columns]) for name, columns in needed.items()]
    return blocks.where(reduce(Column.__or__, tests))


def bounded_listing(rows: DataFrame, requests: DataFrame, key: str, order: list[Column], most: int = 50) -> DataFrame:
    """For each request (key, asked) its key's first rows in ``order``: as many as asked, but at least one and at most ``most``; with their rank.

    A null number asks for ``most``.  A key asked several times is listed once,
    for the largest number.
    """
    asked = requests.groupBy(key).agg(F.max(F.greatest(F.lit(1), F.least(F.coalesce("asked", F.lit(most)), F.lit(most)))).alias("_most"))
    ranked = rows.join(asked, key).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank") <= F.col("_most")).drop("_most")
