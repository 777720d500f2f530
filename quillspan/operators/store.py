"""Content-addressed objects, index states and the vector cache; versions are published by ``operators.index``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_store(rows: DataFrame, content: str) -> DataFrame:
    """One row a distinct content: address ``sha256:<hex>``, size in bytes, content."""
    address = F.concat(F.lit("sha256:"), F.sha2(content, 256))
    return rows.select(address.alias("address"), F.octet_length(content).alias("size"), F.col(content).alias("content")).where(F.col("address").isNotNull()).dropDuplicates(["address"])


def corrupt_objects(store: DataFrame) -> DataFrame:
    """Objects whose content no longer has its address."""
    return store.where(F.concat(F.lit("sha256:"), F.sha2("content", 256)) != F.col("address"))


def chunk_state(expected: DataFrame, stored: DataFrame, key: str, ordinal: str, content: str) -> DataFrame:
    """Per version: none (nothing stored), exact (the stored chunks are the expected ones) or mismatch."""
    e = expected.select(key, ordinal, F.col(content).alias("_e"), F.lit(True).alias("_want"))
    s = stored.select(key, ordinal, F.col(content).alias("_s"), F.lit(True).alias("_have"))
    same = F.col("_want").isNotNull() & F.col("_have").isNotNull() & F.col("_e").eqNullSafe(F.col("_s"))
    per = e.join(s, [key, ordinal], "full").groupBy(key).agg(F.bool_and(same).alias("_all"), F.count("_have").alias("_n"))
    return per.select(key, F.when(F.col("_n") == 0, "none").when(F.col("_all"), "exact").otherwise("mismatch").alias("state"))


def resolve_vectors(inputs: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Each distinct input as reused (in the cache) or created, with how many inputs it serves beyond the first."""
    per = inputs.groupBy(key).agg((F.count("*") - 1).alias("deduplicated"))
    known = cache.select(key).distinct().withColumn("_known", F.lit(True))
    return per.join(known, key, "left").select(key, F.when(F.col("_known"), "reused").otherwise("created").alias("source"), "deduplicated")


def fingerprint(*parts: Column) -> Column:
    """A digest of an ordered identity; a null part is a JSON null and so differs from an empty string."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
