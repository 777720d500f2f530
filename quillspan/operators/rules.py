"""Rules over evidence rows: merges, conflicts, supersession, dependencies, planning and diffs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERIFIED, REVIEW, DISPUTED = "verified", "needs_review", "disputed"


def merge_deadlines(rows: DataFrame, subject: str) -> DataFrame:
    """One row a (subject, due, time, zone), nulls equal: verified if any is, the strongest zone source, how many state it."""
    return rows.groupBy(subject, "due", "time", "zone").agg(
        F.bool_or("verified").alias("verified"), F.max_by("zone_source", F.struct("strength", "zone_source")).alias("zone_source"), F.count("*").alias("statements")
    )


def merge_values(rows: DataFrame, subject: str, value: str) -> DataFrame:
    """The value if all verified rows agree; null and disputed if they differ; null without any."""
    kinds = F.count_distinct(F.when(F.col("verified"), F.col(value)))
    merged = rows.groupBy(subject).agg(kinds.alias("_k"), F.max(F.when(F.col("verified"), F.col(value))).alias("_v"))
    state = F.when(F.col("_k") == 1, VERIFIED).when(F.col("_k") > 1, DISPUTED).otherwise(REVIEW)
    return merged.select(subject, F.when(F.col("_k") == 1, F.col("_v")).alias(value), state.alias("status"))


def merge_reasons(rows: DataFrame, subject: str, reason: str, priority: str) -> DataFrame:
    """Verified if any row is; else the reason of least priority number."""
    merged = rows.groupBy(subject).agg(F.bool_or("verified").alias("_v"), F.min_by(reason, F.struct(priority, reason)).alias("_r"))
    return merged.select(subject, F.when(F.col("_v"), VERIFIED).otherwise(REVIEW).alias("status"), F.when(~F.col("_v"), F.col("_r")).alias("reason"))


def adopt_in_order(rows: DataFrame, subject: str, order: list[str], value: str) -> DataFrame:
    """An ordered fold: the first value is adopted, a later differing one makes a conflict that stays."""
    listed = rows.groupBy(subject).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v")))).alias("_l"))
    kind = dict(rows.dtypes)[value]
    start = F.struct(F.lit(None).cast(kind).alias("value"), F.lit(False).alias("conflict"))

    def step(acc: Column, x: Column) -> Column:
        differs = acc["value"].isNotNull() & x["v"].isNotNull() & (acc["value"] != x["v"])
        return F.struct(F.coalesce(acc["value"], x["v"]).alias("value"), (acc["conflict"] | differs).alias("conflict"))

    return listed.select(subject, F.aggregate("_l", start, step).alias("_a")).select(subject, F.col("_a.value").alias(value), F.col("_a.conflict").alias("conflict"))


def disagreement(rows: DataFrame, subject: str, fields: list[str]) -> DataFrame:
    """Subjects with more than one distinct side; a null field is a value of its own."""
    sides = rows.groupBy(subject).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("\u0000")) for f in fields])).alias("sides"))
    return sides.where("sides > 1")


def conflict_lifecycle(old: DataFrame, detected: DataFrame, subject: str) -> DataFrame:
    """Old states (open, acknowledged, resolved) against what is detected now: created, reopened, kept or resolved_by_source."""
    now = detected.select(subject).distinct().withColumn("_now", F.lit(True))
    joined = old.select(subject, F.col("state").alias("_old")).join(now, subject, "full")
    state = (
        F.when(F.col("_old").isNull(), "created")
        .when(F.col("_now") & (F.col("_old") == "resolved"), "reopened")
        .when(F.col("_now"), F.concat(F.lit("kept_"), F.col("_old")))
        .when(F.col("_old") == "resolved", "kept_resolved")
        .otherwise("resolved_by_source")
    )
    return joined.select(subject, state.alias("transition"))


def superseded(statements: DataFrame, dates: DataFrame, on: list[str]) -> DataFrame:
    """Dates that a statement in the same place (null-safe) replaces, with the first statement that does."""
    s = statements.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("statement_order"), F.col("statement_id"))
    same = None
    for c in on:
        test = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = test if same is None else same & test
    met = dates.join(s, same).where(F.col("statement_order") > F.col("date_order"))
    return met.groupBy("date_id").agg(F.min_by("statement_id", F.struct("statement_order", "statement_id")).alias("superseded_by"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each key as added, removed, changed (with the changed fields' names) or unchanged; nulls compare equal."""
    old = before.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_had"))
    new = after.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(True).alias("_has"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"_b_{f}").eqNullSafe(F.col(f"_a_{f}")), F.lit(f)) for f in fields]))
    state = F.when(F.col("_had").isNull(), "added").when(F.col("_has").isNull(), "removed").when(F.size(names) > 0, "changed").otherwise("unchanged")
    out = old.join(new, key, "full").withColumn("change", state)
    return out.select(key, "change", F.when(F.col("change") == "changed", F.array_join(names, ",")).alias("fields"))


def order_tasks(tasks: DataFrame, prerequisites: DataFrame, owner: str) -> DataFrame:
    """Each owner's plan: owner, key, position from 1 and status (done, ready, blocked).

    ``tasks``: owner, key, anchor, optional and, if there are such columns,
    ``studying`` and ``done``; ``prerequisites``: owner, key, needs.  Of the
    tasks whose needs are placed or done, the one of least (anchor, optional,
    not studying, key) comes next; where a cycle leaves none, the rest follow in
    that order.  Done tasks come last.  One owner's plan is one group, which is
    inherently sequential.
    """
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in tasks.columns else F.lit(False).alias(c) for c in ("studying", "done")]
    needed = prerequisites.groupBy(owner, "key").agg(F.collect_set("needs").alias("needs"))
    rows = tasks.select(owner, "key", "anchor", "optional", *flags).join(needed, [owner, "key"], "left")

    def placed(plan: list[dict]) -> list[tuple[int, str]]:
        """``plan`` by preference to (key, status) in order."""
        known = {t["key"] for t in plan if not t["done"]}
        unmet = {t["key"]: known.intersection(t["needs"] if t["needs"] is not None else ()) for t in plan if not t["done"]}
        status = {k: "blocked" if n else "ready" for k, n in unmet.items()}
        order: list[int] = []
        while unmet:
            following = next((k for k, n in unmet.items() if n.isdisjoint(unmet)), None)
            taken = list(unmet) if following is None else [following]
            order += taken
            for k in taken:
                del unmet[k]
        return [(k, status[k]) for k in order] + [(t["key"], "done") for t in plan if t["done"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            plans = zip(pdf[owner], pdf["tasks"])
            yield pd.DataFrame([(who, k, i, state) for who, own in plans for i, (k, state) in enumerate(placed(own), 1)], columns=[owner, "key", "position", "status"])

    # Sorted by preference: the fields of a struct compare in turn.
    preferred = F.sort_array(F.collect_list(F.struct("anchor", "optional", (~F.col("studying")).alias("later"), "key", "done", "needs")))
    lists = rows.groupBy(owner).agg(preferred.alias("tasks"))
    kinds = [tasks.schema[c].dataType.simpleString() for c in (owner, "key")]
    return lists.mapInPandas(run, f"{owner} {kinds[0]}, key {kinds[1]}, position int, status string")
