"""Queries of the workflow, reporting and remaining evidence operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.operators import aggregates as A
from quillspan.operators import spans as S
from quillspan.operators import versions as K
from quillspan.plans.relational import conversation_blocks, resources
from quillspan.plans.register import registry
from quillspan.session import table
from quillspan.sources import codec as V

QUERIES, SQL, query = registry()


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimensions, true AS same FROM embeddings")
def vector_codec(spark, sf_dir):
    """Vectors through their text form and back, bit for bit."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    back = rows.withColumn("back", V.decode_vector(V.encode_vector("embedding")))
    return back.select("vec_id", F.size("back").alias("dimensions"), (F.col("back") == F.col("embedding")).alias("same"))


@query("""WITH v AS (SELECT source, doc_id, doc_id // 2 AS r, doc_id % 2 + 1 AS n, text FROM documents), c AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC) = 1),
l AS (SELECT source, unnest(string_split(text, chr(10))) AS e FROM c WHERE n = 2), q AS (SELECT c.source, max(quality) AS quality FROM c JOIN labels USING (doc_id) WHERE n = 2 GROUP BY c.source, doc_id)
SELECT source, '1 versions' AS step, count(*) AS n FROM c GROUP BY source UNION ALL SELECT source, '2 changed', count(*) FROM c WHERE n = 2 GROUP BY source
UNION ALL SELECT source, '3 spans', count(*) FROM l WHERE regexp_matches(e, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY source UNION ALL SELECT source, '4 verified', count(*) FILTER (WHERE quality = 1) FROM q GROUP BY source""")
def workflow_trace(spark, sf_dir):
    """A sync run's trace for every course: current versions, changed ones, their spans and their verified labels."""
    current = K.current_versions(resources(spark, sf_dir).select("resource_id", "version_number", "doc_id", "source", "text"), "resource_id", "version_number")
    changed = current.where("version_number > 1")
    spans = S.line_spans(changed, "doc_id", "text").join(changed.select("doc_id", "source"), "doc_id")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    verified = changed.join(labels, "doc_id")
    steps = {"1 versions": (current, F.count("*")), "2 changed": (changed, F.count("*")), "3 spans": (spans, F.count("*")), "4 verified": (verified, F.count_if(F.col("quality") == 1))}
    trace = None
    for name, (rows, n) in steps.items():
        part = rows.groupBy("source").agg(n.alias("n")).select("source", F.lit(name).alias("step"), "n")
        trace = part if trace is None else trace.union(part)
    return trace


@query("""SELECT event_type, quantile_disc(event_id % 9973, 0.5) AS p50, quantile_disc(event_id % 9973, 0.95) AS p95, count(*) FILTER (WHERE user_id % 4 <> 0) AS measured FROM events WHERE user_id % 4 <> 0 GROUP BY event_type""")
def throughput_summary(spark, sf_dir):
    """Nearest-rank latencies of calls that were not retried."""
    calls = table(spark, sf_dir, "events").where("user_id % 4 <> 0").withColumn("ms", F.col("event_id") % 9973)
    _, p50, p95, _ = A.distribution("ms")
    return calls.groupBy("event_type").agg(p50.cast("long").alias("p50"), p95.cast("long").alias("p95"), F.count("*").alias("measured"))


@query("""SELECT l_suppkey, bool_and(l_returnflag <> 'R') AS hidden, bool_or(l_linestatus = 'O') AS has_current, CASE WHEN bool_or(l_linestatus = 'O') THEN 'supported' ELSE 'stale' END AS support FROM lineitem GROUP BY l_suppkey""")
def support_flags(spark, sf_dir):
    """Hidden: no evidence from a brief; stale: none from a current version."""
    current = F.bool_or(F.col("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.bool_and(F.col("l_returnflag") != "R").alias("hidden"), current.alias("has_current"), F.when(current, "supported").otherwise("stale").alias("support")
    )


@query("""SELECT strftime(ts, '%Y-%m-%d') AS observed, count(*) AS changes, count(DISTINCT user_id) AS resources, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY observed""")
def syncs_by_time(spark, sf_dir):
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("observed")).agg(F.count("*").alias("changes"), F.count_distinct("user_id").alias("resources"), kinds.alias("kinds"))


@query("""WITH b AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM conversations)
SELECT conv_id, turn, heading FROM b WHERE role = 'assistant'""")
def nearest_heading(spark, sf_dir):
    """The nearest earlier user turn of every assistant turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    return table(spark, sf_dir, "conversations").withColumn("heading", heading).where("role = 'assistant'").select("conv_id", "turn", "heading")


@query("SELECT doc_id, CAST(length(regexp_replace(text, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]', '', 'g')) AS INTEGER) AS visible FROM documents")
def visible_characters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.visible_length(F.col("text")).alias("visible"))


@query("""WITH p AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations),
h AS (SELECT conv_id, CAST(max(s + n) // 4 AS BIGINT) AS a, CAST(max(s + n) // 2 AS BIGINT) AS b FROM p GROUP BY conv_id)
SELECT p.conv_id, turn, CAST(greatest(p.s, h.a) - h.a AS BIGINT) AS relative_start, CAST(least(p.s + n, h.b) - h.a AS BIGINT) AS relative_end, p.s >= h.a AND p.s + n <= h.b AS whole FROM p JOIN h ON p.conv_id = h.conv_id AND p.s < h.b AND h.a < p.s + n""")
def evidence_assembly(spark, sf_dir):
    """A hit over the second quarter of every conversation, resolved to the spans it overlaps, relative offsets, whole or in part."""
    spans = conversation_blocks(spark, sf_dir).select("conv_id", "turn", "start_offset", "end_offset")
    hits = spans.groupBy("conv_id").agg(F.max("end_offset").alias("e")).select("conv_id", F.expr("e div 4").alias("a"), F.expr("e div 2").alias("b"))
    met = spans.join(hits, "conv_id").where("start_offset < b and a < end_offset")
    return met.select(
        "conv_id",
        "turn",
        (F.greatest("start_offset", "a") - F.col("a")).alias("relative_start"),
        (F.least("end_offset", "b") - F.col("a")).alias("relative_end"),
        ((F.col("start_offset") >= F.col("a")) & (F.col("end_offset") <= F.col("b"))).alias("whole"),
    )


@query("SELECT CAST(0 AS BIGINT) AS differences, count(*) AS rows FROM (SELECT o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3)")
def run_identity(spark, sf_dir):
    """A ranking made twice over differently partitioned input: the two runs may not differ in a row."""

    def once(rows):
        w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
        return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")

    orders = table(spark, sf_dir, "orders")
    one, two = once(orders), once(orders.repartition(7, "o_orderkey"))
    apart = one.exceptAll(two).union(two.exceptAll(one)).agg(F.count("*").alias("differences"))
    return apart.join(one.agg(F.count("*").alias("rows")), F.lit(True))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'required_for' WHEN 1 THEN 'recommended_for' END AS relation, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT a.o_orderkey AS prerequisite, b.o_orderkey AS dependent, a.relation FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND b.n = a.n + 1 WHERE a.relation IS NOT NULL""")
def dependency_rules(spark, sf_dir):
    """Edges read from worded statements: "before submitting" makes one, its strength follows the modal word."""
    worded = F.element_at(F.array(F.lit("You must pass this before submitting the next."), F.lit("You should pass this before submitting the next."), F.lit("You must pass this."), F.lit("This is optional.")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", worded.alias("text"), F.lead("o_orderkey").over(w).alias("dependent"))
    edges = rows.where(F.lower("text").rlike("\\bbefore (?:you )?submit") & F.col("dependent").isNotNull())
    relation = F.when(F.col("text").rlike("\\bmust\\b"), "required_for").otherwise("recommended_for")
    return edges.select(F.col("o_orderkey").alias("prerequisite"), "dependent", relation.alias("relation"))


@query("""WITH t AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_custkey, count(*) FILTER (WHERE before IS NOT NULL AND before <> 'F') AS blocked, 'Open: ' || count(*) FILTER (WHERE o_orderstatus = 'O') || '; blocked: ' || count(*) FILTER (WHERE before IS NOT NULL AND before <> 'F') || '.' AS sentence FROM t GROUP BY o_custkey""")
def blocked_status(spark, sf_dir):
    """Tasks whose predecessor is not finished, and the plan's reasons as a sentence."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("before", F.lag("o_orderstatus").over(w))
    blocked = F.count_if(F.col("before") != "F")
    open_ = F.count_if(F.col("o_orderstatus") == "O")
    sentence = F.concat(F.lit("Open: "), open_.cast("string"), F.lit("; blocked: "), blocked.cast("string"), F.lit("."))
    return rows.groupBy("o_custkey").agg(blocked.alias("blocked"), sentence.alias("sentence"))
