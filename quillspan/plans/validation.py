"""The query of claim validation: orders as claims of four kinds, their lines as evidence, parts as spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import validation as V
from quillspan.plans.register import registry
from quillspan.session import table
from quillspan.tables import settled

QUERIES, SQL, query = registry()

_KINDS = [V.ASSESSMENT, V.DEADLINE, V.REQUIREMENT, V.OBLIGATION]
_KEY = "array_to_string(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+'), ' ')"


@query(f"""WITH c AS (SELECT o_orderkey AS k, {_KINDS}[1 + o_orderkey % 4] AS kind, o_custkey % 2 AS course, o_orderkey % 5 < 4 AS verified, CASE WHEN o_orderkey % 3 = 0 THEN 10 END AS w, o_orderkey % 7 AS z, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 40 END AS call FROM orders),
l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(CAST(l_quantity AS INTEGER)) AS q, min(l_suppkey) AS s, bool_and(l_returnflag = 'N') AS ver FROM lineitem GROUP BY ALL),
m AS (SELECT l.*, c.kind, c.course, CASE kind WHEN 'assessment' THEN CASE n % 3 WHEN 1 THEN 'weighting' ELSE 'title' END WHEN 'obligation' THEN CASE n % 3 WHEN 1 THEN 'due_date' ELSE 'obligation' END ELSE 'any' END AS field, CASE WHEN s % 11 <> 0 THEN s % 40 END AS call, CASE WHEN s % 13 <> 0 THEN s % 40 % 6 END AS run,
CASE WHEN p % 7 = 0 THEN 'You are now done' ELSE 'It is part' || CASE WHEN p % 3 = 0 THEN repeat(' ', 20) ELSE ' number ' || p END END AS x, p % 2 AS part_course, p % 4 <> 0 AS cur FROM l JOIN c USING (k)),
i AS (SELECT kind, k, n, unnest(list_filter([CASE WHEN part_course <> course THEN 'evidence_cross_course' END, CASE WHEN n + q > length(x) THEN 'quote_out_of_bounds' WHEN trim(substr(x, n + 1, q)) = '' THEN 'quote_blank' WHEN p % 7 = 0 THEN 'evidence_on_injection' END,
CASE WHEN call IS NULL OR run IS NULL THEN 'lineage_missing' WHEN NOT (CASE WHEN call % 9 = 0 THEN (call + 1) % 6 ELSE call % 6 END = run AND run % 2 = course AND (run + p) % 5 <> 0) THEN 'lineage_inconsistent' END], lambda e: e IS NOT NULL)) AS code FROM m),
g AS (SELECT k, count(*) AS links, count(*) FILTER (WHERE field IN ('any', 'title', 'obligation')) AS prim, count(*) FILTER (WHERE field IN ('any', 'title', 'obligation') AND ver) AS sup, count(*) FILTER (WHERE field IN ('weighting', 'due_date') AND ver) AS val, count(*) FILTER (WHERE cur) AS cur, count(*) FILTER (WHERE ver) AS ver FROM m GROUP BY k),
d AS (SELECT DISTINCT k - 1 AS k FROM c JOIN g USING (k) WHERE kind = 'assessment_deadline' AND verified AND ver > 0),
e AS (SELECT c.*, coalesce(links, 0) AS links, coalesce(prim, 0) AS prim, coalesce(sup, 0) AS sup, coalesce(val, 0) AS val, coalesce(g.cur, 0) AS cur, d.k IS NOT NULL AS dated FROM c LEFT JOIN g USING (k) LEFT JOIN d USING (k)),
j AS (SELECT kind, k, CAST(NULL AS BIGINT) AS n, unnest(list_filter([CASE WHEN prim = 0 THEN 'claim_without_evidence' END, CASE WHEN verified AND NOT CASE WHEN kind = 'assessment' THEN dated OR val > 0 ELSE sup > 0 END THEN 'verified_without_verified_evidence' END, CASE WHEN verified AND links > 0 AND cur = 0 THEN 'stale_source_version' END,
CASE WHEN (kind = 'assessment' AND w IS NOT NULL OR kind = 'obligation' AND z <> 6) AND val = 0 THEN 'value_without_evidence' END, CASE WHEN kind IN ('assessment', 'assessment_requirement') AND k % 10 = 2 THEN 'canonical_key_mismatch' END, CASE WHEN kind IN ('assessment_deadline', 'obligation') AND z = 3 THEN 'instant_mismatch' END,
CASE WHEN kind = 'obligation' THEN CASE WHEN call IS NULL THEN 'lineage_missing' WHEN CASE WHEN call % 9 = 0 THEN (call + 1) % 6 ELSE call % 6 END % 2 <> course THEN 'lineage_inconsistent' END END], lambda e: e IS NOT NULL)) AS code FROM e)
SELECT code, CASE code WHEN 'stale_source_version' THEN 'warning' ELSE 'error' END AS severity, kind, k AS claim, n AS link FROM (SELECT * FROM i UNION ALL SELECT * FROM j)""")
def claim_validation(spark, sf_dir):
    """All issues of claims worded from orders: every code occurs."""
    return V.issues(*stored(spark, sf_dir))


def stored(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k % 4 + 1).cast("int"))
    text = F.concat(F.lit("Order "), k.cast("string"), F.lit(" of the year"))
    due = F.when(k % 7 != 6, F.to_date(F.lit("2027-07-01")))
    wrong = F.when(k % 7 == 3, F.expr("interval 1 hour")).otherwise(F.expr("interval 0 hour"))
    key = F.when(kind == V.ASSESSMENT, T.canonical_key(text)).otherwise(T.statement_key(text))
    claims = table(spark, sf_dir, "orders").select(
        kind.alias("kind"),
        k.alias("claim"),
        (F.col("o_custkey") % 2).alias("course"),
        F.when(k % 5 < 4, "verified").otherwise("needs_review").alias("status"),
        F.when(kind == V.DEADLINE, k - 1).alias("parent"),
        text.alias("text"),
        F.when(k % 10 == 2, "other").otherwise(key).alias("canonical_key"),
        F.when(k % 3 == 0, 10).alias("weighting"),
        due.alias("due_date"),
        F.lit("10:00").alias("due_time"),
        F.lit("Europe/London").alias("zone"),
        (F.to_timestamp(F.lit("2027-07-01 09:00:00")) + wrong).alias("due_at"),
        F.when(k % 11 != 0, k % 40).alias("call"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("n"))
    lines = lines.agg(F.min("l_partkey").alias("span"), F.min(F.col("l_quantity").cast("int")).alias("q"), F.min("l_suppkey").alias("s"), F.bool_and(F.col("l_returnflag") == "N").alias("ver"))
    lines = settled(lines)
    named = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (F.col("claim") % 4 + 1).cast("int"))
    second = F.col("n") % 3 == 1
    field = F.when(named == V.ASSESSMENT, F.when(second, "weighting").otherwise("title")).when(named == V.OBLIGATION, F.when(second, "due_date").otherwise("obligation")).otherwise("any")
    links = lines.select(
        F.col("n").cast("long").alias("link"), named.alias("kind"), "claim", field.alias("field"), "span", F.col("n").cast("int").alias("start"), (F.col("n") + F.col("q")).cast("int").alias("end"),
        F.when(F.col("ver"), "verified").otherwise("needs_review").alias("status"), F.when(F.col("s") % 11 != 0, F.col("s") % 40).alias("call"), F.when(F.col("s") % 13 != 0, F.col("s") % 40 % 6).alias("run"),
    )
    p = F.col("p_partkey")
    body = F.when(p % 3 == 0, F.repeat(F.lit(" "), F.lit(20))).otherwise(F.concat(F.lit(" number "), p.cast("string")))
    parts = lines.select(F.col("span").alias("p_partkey")).distinct()
    spans = parts.select(p.alias("span"), p.alias("version"), (p % 2).alias("course"), F.when(p % 7 == 0, "You are now done").otherwise(F.concat(F.lit("It is part"), body)).alias("excerpt"), (p % 4 != 0).alias("current"))
    calls = spark.range(40).select(F.col("id").alias("call"), F.when(F.col("id") % 9 == 0, (F.col("id") + 1) % 6).otherwise(F.col("id") % 6).alias("run"))
    runs = spark.range(6).select(F.col("id").alias("run"), (F.col("id") % 2).alias("course"))
    inputs = parts.select(p.alias("version"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("run")).where((F.col("run") + F.col("version")) % 5 != 0).select("run", "version")
    return claims, links, spans, calls, runs, inputs


@query(SQL["claim_validation"].replace("SELECT code, CASE code WHEN", "SELECT x.code, CASE x.code WHEN 'stale_source_version' THEN 'warning' ELSE 'error' END AS severity, count(r.code) AS n FROM (SELECT unnest(" + str(V.CODES) + ") AS code) x LEFT JOIN (SELECT code, CASE code WHEN") + ") r ON r.code = x.code GROUP BY x.code")
def claim_issue_counts(spark, sf_dir):
    """How often each of the twelve codes occurs."""
    return V.issue_counts(V.issues(*stored(spark, sf_dir)))
