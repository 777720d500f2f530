"""Versioned resources: arrivals to versions, snapshots, change feeds and idempotent writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_versions(rows: DataFrame, resource: str, version: str) -> DataFrame:
    """The row of the greatest version of each resource; one hash aggregation, no window."""
    whole = F.struct(F.col(version).alias("_v"), *[F.col(c) for c in rows.columns])
    return rows.groupBy(resource).agg(F.max(whole).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in rows.columns])


def version_history(arrivals: DataFrame, resource: str, order: list[str], content: str) -> DataFrame:
    """Arrivals whose content differs from the resource's previous arrival, numbered from 1; a revert is a new version."""
    w = Window.partitionBy(resource).orderBy(*order)
    changed = arrivals.withColumn("_before", F.lag(content).over(w)).withColumn("_n", F.row_number().over(w))
    kept = changed.where((F.col("_n") == 1) | ~F.col(content).eqNullSafe(F.col("_before")))
    return kept.withColumn("version_number", F.row_number().over(w)).drop("_before", "_n")


def changes_since(versions: DataFrame, published: str, version: str, cursor: Column) -> DataFrame:
    """Versions strictly after the cursor, marked added or updated."""
    return versions.where(F.col(published) > cursor).withColumn("kind", F.when(F.col(version) == 1, "added").otherwise("updated"))


def snapshot_at(versions: DataFrame, resource: str, published: str, version: str, moment: Column) -> DataFrame:
    """The latest version of each resource that was published by a moment."""
    return current_versions(versions.where(F.col(published) <= moment), resource, version)


def classify_sync(incoming: DataFrame, stored: DataFrame, key: list[str], content: str, latest: DataFrame, resource: str, version: str) -> DataFrame:
    """Each incoming version as skipped (stored, equal), conflict (stored, differing), gap (not the next one) or created."""
    old = stored.select(*key, F.col(content).alias("_stored"), F.lit(True).alias("_known"))
    joined = incoming.join(old, key, "left").join(latest.select(resource, F.col(version).alias("_last")), resource, "left")
    state = (
        F.when(F.col("_known") & F.col(content).eqNullSafe(F.col("_stored")), "skipped")
        .when(F.col("_known"), "conflict")
        .when(F.col(version) > F.coalesce("_last", F.lit(0)) + 1, "gap")
        .otherwise("created")
    )
    return joined.withColumn("outcome", state).drop("_stored", "_known", "_last")


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The stored rows and those incoming rows, one a key, whose key is new."""
    fresh = incoming.join(stored, key, "left_anti").dropDuplicates(key)
    return stored.unionByName(fresh)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """Key, value after the upsert, and ``changed``: whether the stored value is new or another (nulls compare equal)."""
    new = incoming.select(F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_sent"))
    old = stored.select(F.col(key), F.col(value).alias("_old"), F.lit(True).alias("_had"))
    joined = old.join(new, key, "full")
    sent = F.coalesce("_sent", F.lit(False))
    return joined.select(
        key,
        F.when(sent, F.col("_new")).otherwise(F.col("_old")).alias(value),
        (sent & (F.col("_had").isNull() | ~F.col("_new").eqNullSafe(F.col("_old")))).alias("changed"),
    )


def replace_set(stored: DataFrame, selected: DataFrame, key: list[str]) -> DataFrame:
    """Each key as created, kept or removed when the stored rows become exactly the selected ones."""
    old = stored.select(*key).distinct().withColumn("_old", F.lit(True))
    new = selected.select(*key).distinct().withColumn("_new", F.lit(True))
    state = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "removed").otherwise("kept")
    return old.join(new, key, "full").select(*key, state.alias("change"))


def change_events(versions: DataFrame, resource: str, version: str, content: str) -> DataFrame:
    """One event a version: kind added or updated, with the previous version and whether the content differs."""
    w = Window.partitionBy(resource).orderBy(version)
    before = versions.withColumn("old_version", F.lag(version).over(w)).withColumn("_c", F.lag(content).over(w))
    return before.select(
        resource,
        "old_version",
        F.col(version).alias("new_version"),
        F.when(F.col("old_version").isNull(), "added").otherwise("updated").alias("kind"),
        (~F.col(content).eqNullSafe(F.col("_c"))).alias("differs"),
    )
