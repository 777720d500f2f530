"""Published tables with a numbered commit log, and an index that is run, pinned, verified and searched on one version of it.

A version of a table is a folder of its own; what makes it visible is the next
entry of a log, put only if no entry has that number.  So of two writers that
start from one version one wins and the other is told, readers see whole
versions only, and whoever pins a number reads the same rows for good.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspan.operators import chunking as C
from quillspan.operators import records as R
from quillspan.operators import retrieval as Q
from quillspan.tables import settled

#: Stages of an index run at which a version can fail.
LOAD, CHUNK, CHECK = "load", "chunk", "check"
#: What a run makes of a version.
INDEXED, UNCHANGED, NOTHING, FAILED = "indexed", "unchanged", "no_visible_text", "failed"


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class CorruptIndex(RuntimeError):
    """The pinned index does not hold what its versions say; nothing is searched."""


def _files(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path, whatever store it names."""
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _put_if_absent(spark: SparkSession, path: str, content: str) -> None:
    """Writes a file under its name only if there is none, or raises Conflict.

    It is written under another name first and then linked or renamed without
    overwriting, which is one step on local disks and on HDFS; a store whose
    rename is not one step needs one writer at a time.
    """
    target, fs = _files(spark, path)
    draft, _ = _files(spark, f"{path}.{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(urlparse(draft.toString()).path, urlparse(target.toString()).path)
        else:
            options = spark._jvm.org.apache.hadoop.fs.Options.Rename
            plain = spark.sparkContext._gateway.new_array(options, 1)
            plain[0] = options.NONE
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, plain)
    except FileExistsError as taken:
        raise Conflict(path) from taken
    except Exception as failed:
        if fs.exists(target) and fs.exists(draft):
            raise Conflict(path) from failed
        raise
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)


def _entry(root: str, version: int) -> str:
    return f"{root}/log/{version:020}.json"


def latest(spark: SparkSession, root: str) -> int:
    """The number of the version committed last, 0 if there is none."""
    log, fs = _files(spark, f"{root}/log")
    if not fs.exists(log):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(log)]
    return max((int(n[:20]) for n in names if n[20:] == ".json" and n[:20].isdigit()), default=0)


def commit(df: DataFrame, root: str, based_on: int) -> int:
    """Publishes ``df`` as the version after ``based_on``, or raises Conflict if that one exists; its number."""
    spark = df.sparkSession
    if latest(spark, root) > based_on:
        raise Conflict(f"{root} has moved on from version {based_on}")
    folder = uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{folder}")
    _put_if_absent(spark, _entry(root, based_on + 1), json.dumps({"folder": folder, "schema": df.schema.json()}))
    return based_on + 1


def append(df: DataFrame, root: str) -> int:
    """Publishes ``df`` as the next version, whichever that is by then; for writers that do not build on a version."""
    while True:
        try:
            return commit(df, root, latest(df.sparkSession, root))
        except Conflict:
            continue


def pinned(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, of the last one unless a number is given."""
    version = latest(spark, root) if version is None else version
    path, fs = _files(spark, _entry(root, version))
    if version < 1 or not fs.exists(path):
        raise FileNotFoundError(f"{root} has no version {version}")
    entry = json.loads(spark.read.text(path.toString(), wholetext=True).first()[0])
    return spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{root}/versions/{entry['folder']}")


def index_run(versions: DataFrame, before: DataFrame | None, key: str, sizes: C.Sizes = C.SPAN_PACK) -> tuple[DataFrame, DataFrame]:
    """Chunks of all versions, and what became of each: (chunks, outcomes), from one job without a failure of one version touching another.

    ``versions``: key, text, spans; ``before``: the chunks indexed so far.
    Outcomes: (key, outcome, stage, error, chunks).  A version without text or
    with spans out of order fails at ``load``, one whose chunks break the
    contract at ``check``; ``unchanged`` ones have the very chunks they had.
    Failed versions keep no chunks.
    """
    back = F.filter("spans", lambda s, i: (s["start"] > s["end"]) | (s["start"] < 0) | (s["end"] > F.length("text")) | F.coalesce(s["start"] < F.get("spans", i - 1)["end"], F.lit(False)))
    classed = versions.withColumn("_class", R.content_class(F.col("text"), F.size(back) == 0))
    sound = classed.where("_class = 'chunkable'").select(key, "text", "spans")
    chunks = settled(C.chunk_documents(sound, key, sizes))
    # Chunks are packed once and read again by every check.
    broken = C.violations(chunks, sound, key, sizes).groupBy(key).agg(F.min("problem").alias("_problem"))
    counts = chunks.groupBy(key).agg(F.count("*").alias("chunks"))
    if before is None:
        same = counts.select(key).where("false")
    else:
        had = before.select(key, "chunk_ordinal", "start_offset", "end_offset", "text_hash", F.lit(1).alias("_had"))
        now = chunks.select(key, "chunk_ordinal", "start_offset", "end_offset", "text_hash", F.lit(1).alias("_now"))
        both = had.join(now, [key, "chunk_ordinal", "start_offset", "end_offset", "text_hash"], "full")
        same = both.groupBy(key).agg(F.bool_and(F.col("_had").isNotNull() & F.col("_now").isNotNull()).alias("_same")).where("_same").select(key)
    joined = classed.select(key, "_class").join(broken, key, "left").join(counts, key, "left").join(same.withColumn("_same", F.lit(True)), key, "left")
    stage = F.when(F.col("_class") == "invalid", LOAD).when(F.col("_problem").isNotNull(), CHECK).when((F.col("_class") == "chunkable") & F.col("chunks").isNull(), CHUNK)
    error = F.when(F.col("_class") == "invalid", "invalid_source").when(F.col("_problem").isNotNull(), F.col("_problem")).when((F.col("_class") == "chunkable") & F.col("chunks").isNull(), "no_chunks")
    outcome = F.when(stage.isNotNull(), FAILED).when(F.col("_class") == "no_visible_text", NOTHING).when(F.col("_same"), UNCHANGED).otherwise(INDEXED)
    outcomes = joined.select(key, outcome.alias("outcome"), stage.alias("stage"), error.alias("error"), F.when(outcome != FAILED, F.coalesce("chunks", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("chunks"))
    good = outcomes.where(F.col("outcome").isin(INDEXED, UNCHANGED)).select(key)
    return chunks.join(good, key, "left_semi"), outcomes


def corpus_states(versions: DataFrame, index: DataFrame, scope: str, key: str) -> DataFrame:
    """(scope, key, state) of every version: searchable, unindexed (no chunk), or corrupt.

    A version is corrupt if a stored chunk is not its text at that place, chunks
    are not numbered from 0, or visible text is in none.
    """
    piece = F.substring(F.col("text"), F.col("start_offset").cast("int") + 1, (F.col("end_offset") - F.col("start_offset")).cast("int"))
    met = index.join(versions.select(key, "text"), key)
    per = met.groupBy(key).agg(F.count("*").alias("_n"), F.bool_or(F.sha2(piece, 256) != F.col("text_hash")).alias("_other"), F.max("chunk_ordinal").alias("_high"), F.count_distinct("chunk_ordinal").alias("_numbers"))
    held = versions.join(per.select(key), key, "left_semi")
    missed = C.uncovered_text(index.select(key, F.col("start_offset").alias("start"), F.col("end_offset").alias("end")), held.select(key, "text"), key).select(key).distinct().withColumn("_missed", F.lit(True))
    wrong = F.col("_other") | (F.col("_high") + 1 != F.col("_n")) | (F.col("_numbers") != F.col("_n")) | F.col("_missed").isNotNull()
    joined = versions.select(scope, key, F.col("text").rlike("(?U)\\S").alias("_seen")).join(per, key, "left").join(missed, key, "left")
    state = F.when(F.col("_n").isNull(), F.when(F.coalesce("_seen", F.lit(False)), R.UNINDEXED).otherwise(R.SEARCHABLE)).when(F.coalesce(wrong, F.lit(True)), R.CORRUPT).otherwise(R.SEARCHABLE)
    return joined.select(scope, key, state.alias("state"))


def search(
    spark: SparkSession, root: str, versions: DataFrame, requests: DataFrame, scope: str, key: str, k: int = 10, between: Callable[[], None] | None = None, version: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Hits and states of requests (request, scope, text) on one pinned version of an index: (hits, states).

    The index is pinned.  ``between`` is where a model is called; so that nothing
    is asked of it in vain, the index is verified before such a call too.  Then it
    is verified with the versions as they are then, and ranking and evidence take
    only what that last look found searchable; a corrupt version in a scope that
    is asked raises CorruptIndex, each time.  Hits: (request, rank, key,
    chunk_ordinal, start_offset, end_offset, score); k lies in 1 to DEPTH.
    """
    if not 1 <= k <= Q.DEPTH:
        raise ValueError(f"k must be from 1 to {Q.DEPTH}")
    number = latest(spark, root) if version is None else version
    index = pinned(spark, root, number)
    asked = requests.select(scope).distinct()

    def verified() -> DataFrame:
        states = settled(corpus_states(versions.join(asked, scope, "left_semi"), index, scope, key))
        wrong = [r[0] for r in states.where(F.col("state") == R.CORRUPT).select(key).orderBy(key).limit(20).collect()]
        if wrong:
            raise CorruptIndex(f"version {number} of the index is corrupt for {wrong}")
        return states

    if between is not None:
        verified()
        between()
    states = verified()
    fit = versions.join(states.where(F.col("state") == R.SEARCHABLE).select(key), key, "left_semi")
    piece = F.substring(F.col("text"), F.col("start_offset").cast("int") + 1, (F.col("end_offset") - F.col("start_offset")).cast("int"))
    rows = index.join(fit.select(scope, key, "text"), key).select(scope, key, "chunk_ordinal", "start_offset", "end_offset", piece.alias("_piece"))
    rows = rows.withColumn("_chunk", F.struct(key, "chunk_ordinal", "start_offset", "end_offset", scope))
    scored = Q.cover_matches(requests, "request", "text", rows, "_chunk", "_piece", within=scope)
    order = [F.desc("score"), F.col(f"_chunk.{key}"), F.col("_chunk.chunk_ordinal")]
    best = Q.ranked(scored, "request", order, k)
    return best.select("request", "rank", F.col(f"_chunk.{key}").alias(key), *[F.col(f"_chunk.{c}").alias(c) for c in ("chunk_ordinal", "start_offset", "end_offset")], "score"), states
