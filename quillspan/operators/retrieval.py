"""Ranking: exact cosine, lexical matches over an inverted table, reciprocal rank fusion, recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import stem

#: Fixed value: the constant of reciprocal rank fusion, and the depth of each ranking.
RRF_K = 60
DEPTH = 50
#: Distinct lexemes of all queries up to which they are broadcast; beyond it they are joined.
QUERY_TERMS = 500_000
#: Pairs of query and text that one task scores at most, unless a single text has more.
PAIRS = 500_000
#: Vectors of a block, and queries of one: their products are 2 MB.
BLOCK, ASKS = 1024, 256
#: Query vectors up to which they are broadcast (64 doubles each: 10 MB).
QUERY_VECTORS = 20_000


def lexemes(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def unit(v: Column) -> Column:
    """The vector over its length, in double precision; null for the zero vector."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm))


def vector_scores(queries: DataFrame, query_key: str, vectors: DataFrame, key: str, scope: str) -> DataFrame:
    """Cosines, to six decimals, of each query with all vectors of its scope; (query, key, score).

    Both have ``scope`` and ``embedding``.  Lengths are taken out once a vector;
    the queries, a stated set, are broadcast while they are few.
    """
    asks = queries.select(scope, query_key, unit(F.col("embedding")).alias("_q"))
    rows = vectors.select(scope, key, unit(F.col("embedding")).alias("_v"))
    small = queries.limit(QUERY_VECTORS + 1).count() <= QUERY_VECTORS
    dot = F.aggregate(F.zip_with("_q", "_v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rows.join(F.broadcast(asks) if small else asks, scope).select(query_key, key, F.round(dot, 6).alias("score"))


def _packed(table: pa.Table) -> pa.Table:
    """The vectors of one block as two binaries, ids and components."""
    vectors = table.column("_v").combine_chunks().flatten().to_numpy()
    ids = table.column("_id").to_numpy()
    return pa.table([table.column("_scope").slice(0, 1), pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])], names=["_scope", "ids", "vectors"])


def _blocks(rows: DataFrame, key: str, scope: str, size: int) -> DataFrame:
    """Unit vectors in blocks of about ``size`` of one scope."""
    rows = rows.select(F.col(scope).alias("_scope"), F.col(key).cast("long").alias("_id"), unit(F.col("embedding")).alias("_v"))
    most = rows.groupBy("_scope").count().agg(F.max("count")).first()[0] or 0
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(-(-most // size) or 1)))
    kind = rows.schema["_scope"].dataType.simpleString()
    return rows.groupBy("_scope", "_block").applyInArrow(_packed, f"_scope {kind}, ids binary, vectors binary")


def _best(depth: int):
    def block(q: np.ndarray, asks: np.ndarray, v: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        q, v = q.reshape(len(asks), -1), v.reshape(len(rows), -1)
        near = q @ v.T
        # All that may be among the best to six decimals, ties and the order of the sum included.
        least = np.partition(near, -depth, axis=1)[:, -depth] - 1.1e-6 if len(rows) > depth else np.full(len(asks), -2.0)
        for i in range(len(asks)):
            at = np.flatnonzero(near[i] >= least[i])
            dot = np.zeros(len(at))
            for x, y in zip(q[i], v[at].T):
                dot = dot + x * y
            # Of equal products those of the smallest ids are enough.
            order = np.lexsort((rows[at], -dot))
            new = np.concatenate([[True], dot[order][1:] != dot[order][:-1]])
            turn = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            order = order[turn < depth]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), asks[i])), pa.array(rows[at][order]), pa.array(dot[order])], names=["q", "k", "dot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("qv", "qi", "vectors", "ids"))):
                out = list(block(*(np.frombuffer(x.as_py(), kind) for x, kind in zip(row, (np.float64, np.int64) * 2))))
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return run


def nearest(queries: DataFrame, query_key: str, vectors: DataFrame, key: str, scope: str, depth: int) -> DataFrame:
    """What ``vector_scores`` gives, of each block of vectors only rows that may be among a query's ``depth`` best.

    Every pair is scored, in products of blocks; the rows that come out have
    the sum in the order of the components.  Keys are longs.
    """
    asks = _blocks(queries, query_key, scope, ASKS).select("_scope", F.col("ids").alias("qi"), F.col("vectors").alias("qv"))
    pairs = _blocks(vectors, key, scope, BLOCK).join(asks, "_scope")
    # Rows of a pair of blocks hold some 0.7 MB, so a batch is bounded by its bytes.
    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    best = pairs.select("qi", "qv", "ids", "vectors").mapInArrow(_best(depth), "q long, k long, dot double")
    return best.select(F.col("q").alias(query_key), F.col("k").alias(key), F.round("dot", 6).alias("score"))


def valid_vector(v: Column, dimensions: int) -> Column:
    """Right length, all components finite, not the zero vector; null is not valid."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimensions) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def term_table(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The inverted table: (lexeme, key), one row an occurrence."""
    return texts.select(key, F.explode(lexemes(F.col(text))).alias("lexeme"))


def lexical_matches(queries: DataFrame, query_key: str, query_text: str, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(query, key): score, the occurrences of the query's distinct lexemes, and ``shared``, how many of them occur.

    Occurrences are narrowed to the queries' lexemes before they are shuffled, as
    long as the queries have few enough, and once: by text.
    """
    wanted = term_table(queries, query_key, query_text).distinct()
    asked = wanted.select("lexeme").distinct()
    small = asked.limit(QUERY_TERMS + 1).count() <= QUERY_TERMS
    terms = term_table(texts, key, text).join(F.broadcast(asked) if small else asked, "lexeme", "left_semi")
    counted = dealt(terms, texts, queries, key).groupBy(key, "lexeme").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(wanted) if small else wanted, "lexeme").groupBy(query_key, key).agg(F.sum("n").alias("score"), F.count("*").alias("shared"))


def dealt(rows: DataFrame, texts: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """``rows`` of texts, all of a text together, in as many partitions as keep a task's pairs of query and text bounded.

    What follows counts a text's pairs where they are, so they are never shuffled.
    """
    pairs = texts.count() * queries.count()
    return rows.repartition(max(1, -(-pairs // PAIRS)), key)


def stem_postings(texts: DataFrame, key: str, text: str, asked: set[str] | None = None) -> DataFrame:
    """The positional inverted table (key, lexeme, positions): where each stem stands among a text's words, from 1.

    ``asked`` narrows it to those stems before anything leaves the Arrow pass.
    A null text has no row.
    """
    kind = texts.schema[key].dataType.simpleString()
    wanted = None if asked is None else texts.sparkSession.sparkContext.broadcast(frozenset(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lexemes_, places = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for lexeme, found in stem.positions(t, wanted and wanted.value).items():
                    keys.append(i)
                    lexemes_.append(lexeme)
                    places.append(found)
            columns = [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(lexemes_, pa.string()), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [key, "lexeme", "positions"])

    return texts.select(key, F.col(text).alias("_text")).mapInArrow(run, f"{key} {kind}, lexeme string, positions array<int>")


def query_parts(queries: DataFrame, query_key: str, query_text: str, every: int | None = None) -> DataFrame:
    """(query, lexeme, part): what a cover must hold one of.

    All stems of a query are one part, so that any of them is a cover; with
    ``every``, each of its first so many distinct stems is a part of its own.
    """
    stems = stem_postings(queries, query_key, query_text)
    if every is None:
        return stems.select(query_key, "lexeme", F.lit(0).alias("part"))
    first = Window.partitionBy(query_key).orderBy(F.col("positions")[0])
    return stems.withColumn("part", F.row_number().over(first) - 1).where(F.col("part") < every).select(query_key, "lexeme", "part")


#: Fixed value: what a cover without other words between its own is worth.
COVER = "0.1"


def cover_density(events: Column, parts: Column) -> Column:
    """The sum, to nine decimals, over minimal covers of COVER / (1 + words of a cover that match nothing).

    ``events``: distinct (position, part), ascending.  A cover is an extent that
    holds all of ``parts`` parts and within which no other one lies: for each
    event, the least of the parts' latest places begins one if it lies further
    on than the last cover's.  One pass; nothing is gathered.
    """
    state = "named_struct('latest', cast(array() as array<int>), 'begun', 0, 'at', 0, 'sum', cast(0 as decimal(38,18)))"

    def step(acc: Column, event: Column) -> Column:
        at = acc["at"] + 1
        latest = F.transform(acc["latest"], lambda x, i: F.when(i == event["part"], at).otherwise(x))
        begins = F.array_min(latest)
        matched = at - begins + 1
        length = event["position"] - F.element_at(events, F.greatest(begins, F.lit(1)))["position"] + 1
        worth = (F.lit(COVER).cast("decimal(19,18)") / (1 + length - matched).cast("decimal(12,0)")).cast("decimal(38,18)")
        fresh = begins > acc["begun"]
        total = (acc["sum"] + F.when(fresh, worth).otherwise(F.lit(0).cast("decimal(38,18)"))).cast("decimal(38,18)")
        return F.struct(latest.alias("latest"), F.when(fresh, begins).otherwise(acc["begun"]).alias("begun"), at.alias("at"), total.alias("sum"))

    begun = F.expr(state).withField("latest", F.array_repeat(F.lit(0), parts))
    return F.aggregate(events, begun, step, lambda acc: F.round(acc["sum"], 9))


def cover_matches(queries: DataFrame, query_key: str, query_text: str, texts: DataFrame, key: str, text: str, every: int | None = None, within: str | None = None) -> DataFrame:
    """(query, key, score) of the texts that hold a cover of the query; English stems, stop words left out, scores decimals.

    Stems of the queries are sent to the pass over the texts while they are few;
    beyond that the whole positional table is narrowed by a join.  Where any stem
    is a cover every place is one, so places are counted before anything is
    shuffled; otherwise a query's places in a text are folded once.  ``within`` names a column of the
    queries and a field of the key, a struct, that have to be equal.
    """
    parts = query_parts(queries, query_key, query_text, every)
    asked = parts.select("lexeme").distinct()
    few = asked.limit(QUERY_TERMS + 1).collect()
    small = len(few) <= QUERY_TERMS
    postings = stem_postings(texts, key, text, {r.lexeme for r in few} if small else None)
    on = ["lexeme"]
    if within:
        on.append("_within")
        parts = parts.join(queries.select(query_key, F.col(within).alias("_within")), query_key)
        postings = postings.withColumn("_within", F.col(f"{key}.{within}"))
    if every is None:
        counted = postings.select(key, *on, F.size("positions").cast("long").alias("n"))
        if not within:
            counted = dealt(counted, texts, queries, key)
        summed = counted.join(F.broadcast(parts) if small else parts, on).groupBy(query_key, key).agg(F.sum("n").alias("n"))
        return summed.select(query_key, key, (F.col("n") * F.lit(COVER).cast("decimal(2,1)")).cast("decimal(38,18)").alias("score"))
    # Of a text that holds only some parts nothing is gathered: parts are counted first.
    met = postings.join(F.broadcast(parts) if small else parts, on)
    sizes = parts.groupBy(query_key).agg(F.count_distinct("part").cast("int").alias("_parts"))
    event = F.transform("positions", lambda p: F.struct(p.alias("position"), F.col("part").alias("part")))
    per = met.groupBy(query_key, key).agg(F.count_distinct("part").alias("_met"), F.array_sort(F.flatten(F.collect_list(event))).alias("_events"))
    whole = per.join(sizes, query_key).where(F.col("_met") == F.col("_parts"))
    return whole.select(query_key, key, cover_density(F.col("_events"), F.col("_parts")).alias("score"))


def ranked(scored: DataFrame, query_key: str, order: list, depth: int) -> DataFrame:
    """Rank 1..depth of each query in a total order."""
    w = Window.partitionBy(query_key).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def ranked_twice(scored: DataFrame, query_key: str, key: str, first: list, second: list, depth: int) -> DataFrame:
    """Two rankings of one scored table, joined: rank_a and rank_b, null beyond the depth; rows in neither are left out.

    Each keeps its best of a task before the shuffle; rows of all scores are not sorted twice in one task.
    """
    a, b = (ranked(scored, query_key, order, depth).select(query_key, key, F.col("rank").alias(name)) for name, order in (("rank_a", first), ("rank_b", second)))
    return a.join(b, [query_key, key], "full")


def ranking_problems(ranking: DataFrame, query_key: str, key: str, depth: int = DEPTH) -> DataFrame:
    """(query, problem): what makes a query's ranking unfit for fusion: item_twice, rank_twice, or ranks that are not 1 to their number (not_dense), or too_deep."""
    per = ranking.groupBy(query_key).agg(
        F.count("*").alias("_n"), F.count_distinct(key).alias("_items"), F.count_distinct("rank").alias("_ranks"), F.min("rank").alias("_low"), F.max("rank").alias("_high")
    )
    tests = {"item_twice": F.col("_items") < F.col("_n"), "rank_twice": F.col("_ranks") < F.col("_n"), "not_dense": (F.col("_low") != 1) | (F.col("_high") != F.col("_ranks")), "too_deep": F.col("_high") > depth}
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in tests.items()]))
    return per.select(query_key, F.explode(found).alias("problem"))


def fuse(first: DataFrame, second: DataFrame, query_key: str, key: str) -> DataFrame:
    """Reciprocal rank fusion of two rankings; see ``fused``."""
    a = first.select(query_key, key, F.col("rank").alias("rank_a"))
    b = second.select(query_key, key, F.col("rank").alias("rank_b"))
    return fused(a.join(b, [query_key, key], "full"), query_key, key)


def fused(ranks: DataFrame, query_key: str, key: str) -> DataFrame:
    """Fusion of rank_a and rank_b: exact sums as decimals, ties by best rank, first rank, second rank, key."""

    def part(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (RRF_K + F.col(rank)), F.lit(0.0))

    score = F.round((part("rank_a") + part("rank_b")).cast("decimal(38,18)"), 12)
    both = ranks.select(query_key, key, "rank_a", "rank_b").withColumn("score", score)
    absent = F.lit(1 << 30)
    order = [F.desc("score"), F.least(F.coalesce("rank_a", absent), F.coalesce("rank_b", absent)), F.coalesce("rank_a", absent), F.coalesce("rank_b", absent), F.col(key)]
    return ranked(both, query_key, order, 2 * DEPTH)
