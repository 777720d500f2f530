"""Recorded vectors and cases: base64 of little-endian float32, and strict JSON lines."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(vector) -> str | None:
    return None if vector is None else base64.b64encode(np.asarray(vector, dtype="<f4").tobytes()).decode()


def decode(text: str | None) -> list[float] | None:
    """The vector, or None unless the text is its canonical encoding."""
    try:
        raw = base64.b64decode(text or "", validate=True)
    except ValueError:
        return None
    if not raw or len(raw) % 4 or base64.b64encode(raw).decode() != text:
        return None
    return np.frombuffer(raw, dtype="<f4").tolist()


@F.pandas_udf(T.StringType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    return vectors.map(encode)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(texts: pd.Series) -> pd.Series:
    return texts.map(decode)


def read_cases(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines under a stated schema, and the violations: unreadable lines and keys that occur twice or not at all."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).select(parsed.alias("r")).select("r.*")
    bad = rows.where("_bad is not null").select(F.lit("unreadable").alias("issue"), F.col("_bad").alias("value"))
    good = rows.where("_bad is null").drop("_bad")
    twice = good.groupBy(key).agg(F.count("*").alias("n")).where(f"n > 1 or {key} is null").select(F.lit("key").alias("issue"), F.col(key).cast("string").alias("value"))
    return good, bad.union(twice)


def visible_length(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.regexp_replace(text, "(?U)\\s", ""))
