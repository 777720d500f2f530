"""Queries of the relational operators: versions, writes, spans, intervals, joins, aggregations, ranks, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.operators import aggregates as A
from quillspan.operators import intervals as I
from quillspan.operators import spans as S
from quillspan.operators import versions as K
from quillspan.plans.register import registry
from quillspan.session import table

QUERIES, SQL, query = registry()


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as versions: two ids on end are one resource."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.expr("doc_id div 2").alias("resource_id"),
        (F.col("doc_id") % 2 + 1).alias("version_number"),
        "doc_id",
        "text",
        "source",
        F.sha2("text", 256).alias("content_hash"),
    )


_RESOURCES = "(SELECT doc_id // 2 AS resource_id, doc_id % 2 + 1 AS version_number, doc_id, text, source, sha256(text) AS content_hash FROM documents)"
_ORDER_VERSIONS = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number FROM orders)"


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("version_number", F.row_number().over(w))


@query(f"SELECT resource_id, version_number, doc_id, content_hash FROM {_RESOURCES} QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY version_number DESC) = 1")
def current_versions(spark, sf_dir):
    rows = resources(spark, sf_dir).select("resource_id", "version_number", "doc_id", "content_hash")
    return K.current_versions(rows, "resource_id", "version_number")


@query("""
WITH k AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version_number
FROM k WHERE n = 1 OR event_type IS DISTINCT FROM b""")
def version_history(spark, sf_dir):
    kept = K.version_history(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return kept.select("user_id", "event_id", "event_type", "version_number")


@query(f"""SELECT o_custkey, o_orderkey, CASE WHEN version_number = 1 THEN 'added' ELSE 'updated' END AS kind
FROM {_ORDER_VERSIONS} WHERE o_orderdate > TIMESTAMP '1996-01-01'""")
def changes_since(spark, sf_dir):
    rows = K.changes_since(order_versions(spark, sf_dir), "o_orderdate", "version_number", F.lit("1996-01-01").cast("timestamp"))
    return rows.select("o_custkey", "o_orderkey", "kind")


@query(f"""SELECT o_custkey, o_orderkey, CAST(version_number AS INTEGER) AS version_number FROM {_ORDER_VERSIONS} WHERE o_orderdate <= TIMESTAMP '1996-01-01'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY version_number DESC) = 1""")
def initial_snapshot(spark, sf_dir):
    rows = order_versions(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderdate", "version_number")
    return K.snapshot_at(rows, "o_custkey", "o_orderdate", "version_number", F.lit("1996-01-01").cast("timestamp")).drop("o_orderdate")


@query(f"""WITH e AS (SELECT resource_id, lag(version_number) OVER w AS old_version, version_number AS new_version, content_hash, lag(content_hash) OVER w AS b FROM {_RESOURCES} WINDOW w AS (PARTITION BY resource_id ORDER BY version_number))
SELECT resource_id, old_version, new_version, CASE WHEN old_version IS NULL THEN 'added' ELSE 'updated' END AS kind, content_hash IS DISTINCT FROM b AS differs FROM e""")
def change_events(spark, sf_dir):
    return K.change_events(resources(spark, sf_dir), "resource_id", "version_number", "content_hash")


@query(f"""WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice, version_number FROM {_ORDER_VERSIONS}),
s AS (SELECT o_custkey, version_number, CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE o_totalprice END AS p FROM v WHERE version_number <= 5 AND o_orderkey % 7 <> 0),
l AS (SELECT o_custkey, max(version_number) AS m FROM s GROUP BY o_custkey)
SELECT v.o_custkey, v.o_orderkey, CASE WHEN s.o_custkey IS NOT NULL AND s.p IS NOT DISTINCT FROM v.o_totalprice THEN 'skipped' WHEN s.o_custkey IS NOT NULL THEN 'conflict'
WHEN v.version_number > coalesce(l.m, 0) + 1 THEN 'gap' ELSE 'created' END AS outcome
FROM v LEFT JOIN s ON v.o_custkey = s.o_custkey AND v.version_number = s.version_number LEFT JOIN l ON v.o_custkey = l.o_custkey""")
def sync_classification(spark, sf_dir):
    incoming = order_versions(spark, sf_dir).select("o_custkey", "o_orderkey", "o_totalprice", "version_number")
    stored = incoming.where("version_number <= 5 and o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.col("o_totalprice")))
    latest = stored.groupBy("o_custkey").agg(F.max("version_number").alias("version_number"))
    out = K.classify_sync(incoming, stored, ["o_custkey", "version_number"], "o_totalprice", latest, "o_custkey", "version_number")
    return out.select("o_custkey", "o_orderkey", "outcome")


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderstatus AS st FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS st FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(s.k, n.k) AS o_orderkey, CASE WHEN n.k IS NOT NULL THEN n.st ELSE s.st END AS o_orderstatus, n.k IS NOT NULL AND (s.k IS NULL OR n.st IS DISTINCT FROM s.st) AS changed FROM s FULL JOIN n ON s.k = n.k""")
def upsert_changed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = orders.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return K.upsert(orders.where("o_orderkey % 3 <> 0"), new, "o_orderkey", "o_orderstatus")


@query("""WITH o AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'A'), n AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R')
SELECT change, count(*) AS n FROM (SELECT CASE WHEN o.l_partkey IS NULL THEN 'created' WHEN n.l_partkey IS NULL THEN 'removed' ELSE 'kept' END AS change
FROM o FULL JOIN n ON o.l_partkey = n.l_partkey AND o.l_suppkey = n.l_suppkey) GROUP BY change""")
def replace_set_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    out = K.replace_set(lines.where("l_returnflag <> 'A'"), lines.where("l_returnflag <> 'R'"), ["l_partkey", "l_suppkey"])
    return out.groupBy("change").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderpriority FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' UNION SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F')""")
def insert_if_absent(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    stored = orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderpriority").distinct()
    incoming = orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority")
    return K.insert_if_absent(stored, incoming, ["o_custkey", "o_orderpriority"])


@query("""SELECT (SELECT count(*) FROM nation WHERE n_regionkey <> 2) AS nations, (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)) AS customers,
(SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))) AS orders""")
def cascade_reset(spark, sf_dir):
    """What is left when one region goes with all that hangs on it."""
    gone_nations = table(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_nationkey")
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    gone = customers.join(gone_nations, customers.c_nationkey == gone_nations.n_nationkey, "left_semi")
    left = table(spark, sf_dir, "nation").join(gone_nations, "n_nationkey", "left_anti").agg(F.count("*").alias("nations"))
    kept = customers.join(gone, "c_custkey", "left_anti").agg(F.count("*").alias("customers"))
    rest = orders.join(gone, orders.o_custkey == gone.c_custkey, "left_anti").agg(F.count("*").alias("orders"))
    # Each side is one row.
    return left.join(kept, F.lit(True)).join(rest, F.lit(True))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS excerpt, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
o AS (SELECT *, coalesce(sum(length(excerpt) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ordinal, CAST(s AS BIGINT) AS start_offset, CAST(s + length(excerpt) AS BIGINT) AS end_offset, sha256(excerpt) AS excerpt_hash
FROM o WHERE regexp_matches(excerpt, '[^ \\t\\n\\x0B\\f\\r]')""")
def line_spans(spark, sf_dir):
    spans = S.line_spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    return spans.select("doc_id", "ordinal", "start_offset", "end_offset", F.sha2("excerpt", 256).alias("excerpt_hash"))


@query("""SELECT count(*) AS spans, CAST(0 AS BIGINT) AS violations FROM (SELECT unnest(string_split(text, chr(10))) AS e FROM documents) WHERE regexp_matches(e, '[^ \\t\\n\\x0B\\f\\r]')""")
def span_offsets_check(spark, sf_dir):
    """Spans whose excerpt is not the exact slice of their version's text; none may be left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = S.line_spans(docs, "doc_id", "text").join(docs, "doc_id")
    wrong = F.substring(F.col("text"), F.col("start_offset").cast("int") + 1, F.length("excerpt")) != F.col("excerpt")
    return spans.agg(F.count("*").alias("spans"), F.coalesce(F.sum(wrong.cast("long")), F.lit(0)).alias("violations"))


_KIND = "CASE role WHEN 'system' THEN 'heading' WHEN 'user' THEN 'slide_text' ELSE 'slide_notes' END"
_LAYOUT = f"""(SELECT conv_id, turn, {_KIND} AS kind, length(text) AS len, row_number() OVER w - 1 AS ordinal,
coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def conversation_blocks(spark, sf_dir):
    kind = F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", "slide_text").otherwise("slide_notes")
    return S.layout(table(spark, sf_dir, "conversations").withColumn("kind", kind), "conv_id", "turn", "text")


@query(f"SELECT conv_id, CAST(ordinal AS INTEGER) AS ordinal, kind, CAST(s AS BIGINT) AS start_offset, CAST(s + len AS BIGINT) AS end_offset FROM {_LAYOUT}")
def span_layout(spark, sf_dir):
    return conversation_blocks(spark, sf_dir).select("conv_id", "ordinal", "kind", "start_offset", "end_offset")


@query(f"SELECT conv_id, CAST(ordinal // 3 AS BIGINT) AS chunk_ordinal, count(*) AS spans, CAST(sum(len) AS BIGINT) AS chars FROM {_LAYOUT} GROUP BY ALL")
def span_chunk_range_join(spark, sf_dir):
    """Chunks of three spans, resolved back to the spans of their range."""
    spans = conversation_blocks(spark, sf_dir).select("conv_id", "ordinal", (F.col("end_offset") - F.col("start_offset")).alias("len"))
    chunks = spans.groupBy("conv_id", F.floor(F.col("ordinal") / 3).alias("chunk_ordinal")).agg(F.min("ordinal").alias("first_span"), F.max("ordinal").alias("last_span"))
    met = S.spans_of_ranges(chunks, spans, "conv_id")
    return met.groupBy("conv_id", "chunk_ordinal").agg(F.count("*").alias("spans"), F.sum("len").alias("chars"))


@query("""WITH r AS (SELECT conv_id, turn, role, lag(role) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(CASE WHEN b IS NOT DISTINCT FROM role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM r)
SELECT conv_id, CAST(n AS BIGINT) AS group_number, min(role) AS role, count(*) AS turns FROM g GROUP BY conv_id, n""")
def keep_together_groups(spark, sf_dir):
    grouped = S.together(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return grouped.groupBy("conv_id", "group_number").agg(F.min("role").alias("role"), F.count("*").alias("turns"))


_EVENT_RANGES = "(SELECT user_id, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 900 + event_id % 1800 AS e FROM events)"


def event_ranges(spark, sf_dir):
    start = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), start.alias("start"), (start + 900 + F.col("event_id") % 1800).alias("end"))


@query(f"SELECT a.user_id, a.id AS a_id, b.id AS b_id, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM {_EVENT_RANGES} a JOIN {_EVENT_RANGES} b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e AND a.id < b.id")
def interval_overlap(spark, sf_dir):
    rows = event_ranges(spark, sf_dir)
    return I.overlap_join(rows, rows, ["user_id"], 3600).where("a_id < b_id").select("user_id", "a_id", "b_id", "overlap")


@query(f"SELECT a.user_id, a.id AS a_id, b.id AS b_id FROM {_EVENT_RANGES} a JOIN {_EVENT_RANGES} b ON a.user_id = b.user_id AND a.s >= b.s AND a.e <= b.e + 43200 AND a.id <> b.id")
def interval_containment(spark, sf_dir):
    """Event ranges that lie wholly within another one's, which is half a day longer."""
    rows = event_ranges(spark, sf_dir)
    wide = rows.withColumn("end", F.col("end") + 43200)
    return I.containment_join(rows, wide, ["user_id"], 43200).where("a_id <> b_id").select("user_id", "a_id", "b_id")


@query("""WITH r AS (SELECT l_orderkey AS k, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e) AS g FROM m)
SELECT k AS l_orderkey, CAST(sum(w) AS BIGINT) AS union_length, count(*) AS n_ranges FROM (SELECT k, g, max(e) - min(s) AS w FROM i GROUP BY k, g) GROUP BY k""")
def interval_union_length(spark, sf_dir):
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))
    return I.union_length(rows, ["l_orderkey"])


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'R'), r AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM d),
e AS (SELECT l_orderkey, min(n) AS lo, max(n) AS hi FROM r GROUP BY l_orderkey, g)
SELECT l_orderkey, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM e GROUP BY l_orderkey""")
def run_length_ranges(spark, sf_dir):
    return I.run_ranges(table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'"), ["l_orderkey"], "l_linenumber")


@query("""SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def provenance_chain(spark, sf_dir):
    """Lines to their order, customer, nation and region."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    joined = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT d.doc_id, CASE quality WHEN 1 THEN 'verified' WHEN 0 THEN 'needs_review' ELSE 'undetermined' END AS status FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id")
def optional_parent_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    status = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "needs_review").otherwise("undetermined")
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", status.alias("status"))


@query("SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY c_mktsegment")
def semi_current(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') THEN 'verified' ELSE 'needs_review' END AS status FROM orders""")
def exists_verified(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "N").alias("has"))
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(facts, orders.o_orderkey == facts.l_orderkey, "left")
    return joined.select("o_orderkey", F.when(F.col("has"), "verified").otherwise("needs_review").alias("status"))


@query("SELECT role, count(*) AS spans FROM conversations GROUP BY role")
def block_kind_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("spans"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS versions, max(l_linenumber) AS last_number FROM lineitem GROUP BY l_partkey")
def distinct_version_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("versions"), F.max("l_linenumber").alias("last_number"))


@query("SELECT quality, count(*) FILTER (WHERE toxic = 0) AS clean, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels GROUP BY quality")
def status_histogram(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("""SELECT l_returnflag, min(l_extendedprice) AS least, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, max(l_extendedprice) AS most FROM lineitem GROUP BY l_returnflag""")
def distribution_nearest_rank(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*A.distribution("l_extendedprice"))


@query("SELECT p_brand, arg_min(p_name, (-length(p_name), p_name)) AS title FROM part GROUP BY p_brand")
def best_title(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(A.best_title("p_name").alias("title"))


@query("SELECT l_orderkey, CASE WHEN count(*) = count(nullif(l_discount, 0)) THEN CAST(sum(l_quantity) AS BIGINT) END AS tokens FROM lineitem GROUP BY l_orderkey")
def null_poisoning_sum(spark, sf_dir):
    tokens = F.when(F.col("l_discount") != 0, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(A.sum_or_null(tokens).cast("long").alias("tokens"))


@query("""SELECT event_type, count(*) AS calls, CAST(sum(CAST(event_id % 4096 AS BIGINT) * 13 + (user_id % 512) * 40) AS BIGINT) AS micro_cost, count(*) FILTER (WHERE value IS NULL) AS unknown FROM events GROUP BY event_type""")
def call_cost(spark, sf_dir):
    """Cost in millionths of prompt and completion tokens (event_id and user_id stand for them)."""
    cost = (F.col("event_id") % 4096) * 13 + (F.col("user_id") % 512) * 40
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(cost).alias("micro_cost"), F.count_if(F.col("value").isNull()).alias("unknown"))


@query("""WITH c AS (SELECT event_id, user_id, ts, sum(event_id % 97) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spend FROM events)
SELECT user_id, count(*) AS calls_within, max(CAST(spend AS BIGINT)) AS spend FROM c WHERE spend <= 1500 GROUP BY user_id""")
def spend_guard(spark, sf_dir):
    """Calls that stay under a running spending cap."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = table(spark, sf_dir, "events").withColumn("spend", F.sum(F.col("event_id") % 97).over(w)).where("spend <= 1500")
    return spent.groupBy("user_id").agg(F.count("*").alias("calls_within"), F.max("spend").alias("spend"))


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, floor(c_acctbal / 100) AS score FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY score DESC, c_custkey) AS rank FROM r)
SELECT c_mktsegment, c_custkey, CAST(rank AS INTEGER) AS rank, CAST(min(rank) OVER w AS INTEGER) AS tie_first, CAST(max(rank) OVER w AS INTEGER) AS tie_last FROM k WINDOW w AS (PARTITION BY c_mktsegment, score)""")
def score_ties(spark, sf_dir):
    scored = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.floor(F.col("c_acctbal") / 100).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("score"), "c_custkey")))
    tie = Window.partitionBy("c_mktsegment", "score")
    return ranked.select("c_mktsegment", "c_custkey", "rank", F.min("rank").over(tie).alias("tie_first"), F.max("rank").over(tie).alias("tie_last"))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rank FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 3")
def topk_per_key(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("SELECT user_id, max(event_id) FILTER (WHERE event_type = 'view') AS last_view, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).alias("last_view"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("""WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1)
SELECT l_suppkey, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS INTEGER) AS local_id FROM f""")
def first_occurrence_ids(spark, sf_dir):
    """First line of each part of a supplier, numbered anew."""
    first = Window.partitionBy("l_suppkey", "l_partkey").orderBy("l_orderkey", "l_linenumber")
    again = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    kept = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(first)).where("r = 1")
    return kept.select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(again).alias("local_id"))


@query("""SELECT l_orderkey, string_agg(l_linenumber || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_suppkey) AS evidence FROM lineitem GROUP BY l_orderkey""")
def evidence_order(spark, sf_dir):
    pairs = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(pairs.alias("e"))
    return lists.select("l_orderkey", F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_suppkey"])), ",").alias("evidence"))


@query("""SELECT 'both' AS side, l_partkey FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'expected only', l_partkey FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def exact_match_sets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    expected, found = (lines.where(F.col("l_returnflag") == f).select("l_partkey") for f in "RA")
    both = expected.intersect(found).select(F.lit("both").alias("side"), "l_partkey")
    return both.union(expected.subtract(found).select(F.lit("expected only"), "l_partkey"))
