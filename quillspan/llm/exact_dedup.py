"""Exact duplicates by a tree merge of sorted digest runs; DataFrame functions only.

Every partition of the input is a run: its texts' digests, each with the best
row and the number of rows behind it.  Runs meet in binomial rounds: in a round
of ``k`` bits, partitions whose numbers differ in those bits only exchange runs,
each keeping the digests whose own bits name it, so that after ``log2`` of the
partitions' number every digest lies in one partition.  What has arrived is
sorted by digest and merged many ways at once (a sort-based aggregation), and
the best row is kept at every level, so a text that fills a third of the input
is one entry a run from the first level on, and no task ever holds more than its
share of distinct digests.

Entries merge only where a SHA-256, the length and a second, independent hash of
the normalised text all agree.  Of these entries only the digests, lengths and
identifiers move; texts are read once and never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.tables import cut

#: Bits of a partition's number that one round settles: up to 16 runs meet in one merge.
FAN_BITS = 4
#: What two equal texts may differ in.
SPACE = r"[\x20\x09-\x0D]"
KEYS = ["digest", "check", "size"]


def entries(docs: DataFrame) -> DataFrame:
    """One row (row, doc_id, chars, digest, check, size) a document, written once; ``row`` tells rows with one ``doc_id`` apart."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    plain = texts.select("doc_id", F.length("text").alias("chars"), F.regexp_replace("text", SPACE, "").alias("plain"))
    hashed = plain.select("doc_id", "chars", F.unhex(F.sha2("plain", 256)).alias("digest"), F.xxhash64("plain").alias("check"), F.octet_length("plain").alias("size"))
    return cut(hashed.withColumn("row", F.monotonically_increasing_id()), "digests")


def merge_runs(rows: DataFrame, partitions: int) -> DataFrame:
    """One row (digest, check, size, best, n) a distinct text: ``best`` is the row that stays, ``n`` counts its copies.

    ``best`` orders by most code points, smallest ``doc_id`` (null last), first row.
    """
    bits = max(1, math.ceil(math.log2(max(2, partitions))))
    rounds = math.ceil(bits / FAN_BITS)
    best = F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    runs = rows.select(*KEYS, best.alias("best"), F.lit(1).cast("long").alias("n"), (F.spark_partition_id() % (1 << bits)).alias("run"))
    runs = _merged(runs.groupBy("run", *KEYS))
    for r in range(1, rounds + 1):
        left = bits - bits * r // rounds
        own = F.shiftrightunsigned("check", 64 - bits + left).cast("int")
        cell = F.shiftleft(own, left).bitwiseOR(F.col("run").bitwiseAND((1 << left) - 1))
        dealt = runs.withColumn("run", cell).repartitionById(1 << bits, "run")
        runs = _merged(dealt.groupBy("run", *KEYS))
    return runs.drop("run")


def _merged(grouped) -> DataFrame:
    return grouped.agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def _width(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def exact_dedup(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256) a document.

    Texts are equal when they are after deleting every character of
    ``[\\x20\\x09-\\x0D]``; a null text counts as empty, and all empty ones are
    equal.  Of equal texts the row with the most code points stays, then the one
    with the smallest ``doc_id``, a null one last; of rows that repeat both, the
    first read.  So one row of each group has ``kept``.  Other columns are
    ignored; an empty table gives no row.  ``partitions`` is the number of runs
    that meet, rounded up to a power of two.
    """
    rows = entries(docs)
    copies = merge_runs(rows, partitions or _width(docs)).where("n > 1")
    out = rows.join(copies, KEYS, "left")
    alone: Column = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; rows that share a ``doc_id`` stay if one of them does."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")
