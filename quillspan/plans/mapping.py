"""Queries of selections, their scores, and the inputs of model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import calls as C
from quillspan.operators import mapping as M
from quillspan.plans.register import registry
from quillspan.session import table

QUERIES, SQL, query = registry()


@query("""WITH i AS (SELECT l_orderkey, l_suppkey % 5 AS item, min(l_linenumber) AS ord FROM lineitem WHERE l_quantity < 30 GROUP BY ALL),
c AS (SELECT l_orderkey, l_suppkey % 5 AS item, l_linenumber AS place, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 5 ORDER BY l_linenumber) AS n FROM lineitem)
SELECT c.l_orderkey, c.item, place, ord, CASE WHEN i.item IS NULL THEN 'candidate_unknown' WHEN n > 1 THEN 'candidate_repeated' END AS reason FROM c LEFT JOIN i ON c.l_orderkey = i.l_orderkey AND c.item = i.item""")
def selection_gate(spark, sf_dir):
    """Lines choose their supplier's class; issued are the classes of the small lines of the order."""
    lines = table(spark, sf_dir, "lineitem").withColumn("item", F.col("l_suppkey") % 5)
    issued = lines.where("l_quantity < 30").groupBy("l_orderkey", "item").agg(F.min("l_linenumber").alias("ord"))
    return M.selection_gate(lines.select("l_orderkey", "item", F.col("l_linenumber").alias("place")), issued, "l_orderkey", "item", "place", "ord")


@query("""WITH h AS (SELECT l_orderkey, l_linenumber AS rank, c_nationkey % 3 AS scope, s_nationkey % 3 AS own, s_acctbal > 0 AS current, s_suppkey,
EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_orderkey = l.l_orderkey AND r.l_suppkey = l.l_suppkey) AS forbidden
FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 7 <> 0)
SELECT l_orderkey, rank, 'unknown_version' AS violation FROM h WHERE s_suppkey IS NULL
UNION ALL SELECT l_orderkey, rank, 'other_scope' FROM h WHERE s_suppkey IS NOT NULL AND own <> scope
UNION ALL SELECT l_orderkey, rank, 'not_current' FROM h WHERE s_suppkey IS NOT NULL AND NOT current
UNION ALL SELECT l_orderkey, rank, 'forbidden_version' FROM h WHERE s_suppkey IS NOT NULL AND forbidden""")
def hit_violations(spark, sf_dir):
    """Lines as hits of their suppliers; a customer's nation is the scope, returned lines make a supplier forbidden."""
    lines = table(spark, sf_dir, "lineitem")
    hits = lines.select(F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("version"))
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 3).alias("scope"))
    scopes = table(spark, sf_dir, "orders").join(owners, "o_custkey").select(F.col("o_orderkey").alias("case"), "scope")
    suppliers = table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0")
    versions = suppliers.select(F.col("s_suppkey").alias("version"), (F.col("s_nationkey") % 3).alias("own"), (F.col("s_acctbal") > 0).alias("current"))
    forbidden = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case"), F.col("l_suppkey").alias("version")).distinct()
    return M.hit_violations(hits, scopes, versions, forbidden).withColumnRenamed("case", "l_orderkey")


@query("""WITH v AS (SELECT DISTINCT l_orderkey AS r, CAST(l_linenumber AS BIGINT) AS v FROM lineitem), t AS (SELECT r, max(v) AS m FROM v GROUP BY r),
i AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4 + 1 END AS n, o_orderstatus = 'O' AS stale FROM orders),
e AS (SELECT o_custkey, o_orderkey, n AS version, stale FROM i WHERE n IS NOT NULL UNION ALL SELECT o_custkey, o_orderkey, v, stale FROM i JOIN v ON r = o_orderkey WHERE n IS NULL)
SELECT DISTINCT o_custkey, o_orderkey, version FROM e LEFT JOIN t ON r = o_orderkey WHERE NOT stale OR m IS NULL OR version <> m""")
def forbidden_versions(spark, sf_dir):
    """Orders as resources, their lines as versions; a third of the orders is meant as a whole, open ones as stale."""
    number = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 4 + 1)
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("resource"), number.alias("version"), (F.col("o_orderstatus") == "O").alias("stale"))
    versions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("resource"), F.col("l_linenumber").cast("long").alias("version"))
    out = M.forbidden_versions(items, versions)
    return out.select(F.col("case").alias("o_custkey"), F.col("resource").alias("o_orderkey"), "version")


@query("""WITH t AS (SELECT doc_id, lang, length(text) AS n, doc_id * 37 % (length(text) - 100) AS s FROM documents WHERE length(text) >= 120),
c AS (SELECT doc_id, unnest(range(0, n, 250)) AS s, n FROM t), h AS (SELECT DISTINCT t.doc_id FROM t JOIN c ON t.doc_id = c.doc_id AND c.s <= t.s AND t.s + 80 <= least(c.s + 300, c.n))
SELECT lang, count(*) AS targets, count(h.doc_id) AS contained FROM t LEFT JOIN h ON t.doc_id = h.doc_id GROUP BY lang""")
def chunk_containment(spark, sf_dir):
    """A passage of eighty characters a document against chunks of 300 characters that overlap by 50."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("n")).where("n >= 120")
    targets = docs.withColumn("start", F.col("doc_id") * 37 % (F.col("n") - 100)).withColumn("end", F.col("start") + 80)
    chunks = docs.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(250).cast("long"))))
    return M.contained_share(targets, chunks.withColumn("end", F.least(F.col("start") + 300, "n")), "doc_id", "lang")


@query("""WITH n AS (SELECT l_orderkey AS k, count(*) AS n, min(CASE l_linestatus WHEN 'O' THEN 'materials' ELSE 'no_material' END) AS said FROM lineitem WHERE l_linenumber IN (1, 3) AND l_quantity > 10 GROUP BY ALL),
l AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'materials' WHEN 'F' THEN 'no_material' ELSE 'unlabelled' END AS own FROM orders WHERE o_orderkey % 10 <> 0),
p AS (SELECT coalesce(n.k, l.k) AS label, CASE WHEN l.k IS NULL THEN 'unknown' WHEN n.k IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN said IS DISTINCT FROM own THEN 'other_expectation' END AS problem FROM n FULL JOIN l ON n.k = l.k)
SELECT label, problem FROM p WHERE problem IS NOT NULL""")
def split_problems(spark, sf_dir):
    """Lines name orders in a split; orders are the labels."""
    said = F.when(F.col("l_linestatus") == "O", "materials").otherwise("no_material")
    own = F.when(F.col("o_orderstatus") == "O", "materials").when(F.col("o_orderstatus") == "F", "no_material").otherwise("unlabelled")
    split = table(spark, sf_dir, "lineitem").where("l_linenumber in (1, 3) and l_quantity > 10").select(F.col("l_orderkey").alias("label"), said.alias("expect"))
    labels = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("label"), own.alias("expect"))
    return M.split_problems(split, labels, "label", "expect")


@query("""WITH e AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY ALL), a AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY ALL)
SELECT coalesce(e.o_custkey, a.o_custkey) AS o_custkey, coalesce(e.o_orderstatus, a.o_orderstatus) AS o_orderstatus, coalesce(e.n, 0) AS expected, coalesce(a.n, 0) AS actual
FROM e FULL JOIN a ON e.o_custkey = a.o_custkey AND e.o_orderstatus = a.o_orderstatus WHERE coalesce(e.n, 0) <> coalesce(a.n, 0)""")
def state_problems(spark, sf_dir):
    """Orders a customer and status, as two partly lost copies count them."""
    orders, keys = table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"]
    expected, actual = (orders.where(f"o_orderkey % {k} <> 0").groupBy(keys).agg(F.count("*").alias("n")) for k in (5, 7))
    return M.state_problems(expected, actual, keys)


@query("""WITH g AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem WHERE l_returnflag = 'R'),
c AS (SELECT l_orderkey AS k, l_quantity > 25 AS selected, l_discount > 0.08 AS bad, g.k IS NOT NULL AS gold FROM lineitem LEFT JOIN g ON g.k = l_orderkey AND g.i = l_linenumber WHERE l_linenumber <= 3),
p AS (SELECT k, bool_or(gold) AS r, bool_or(gold AND selected) AS h, bool_or(bad AND selected) AS w, bool_or(NOT gold AND selected) AS x FROM c GROUP BY k),
s AS (SELECT o_orderkey, o_orderstatus AS e, coalesce(r, false) AS r, coalesce(h, false) AS h, coalesce(w, false) AS w, coalesce(x, false) AS x, o_orderkey IN (SELECT k FROM g) AS t FROM orders LEFT JOIN p ON k = o_orderkey)
SELECT o_orderkey, CASE WHEN t THEN r END AS retrieval_hit, CASE WHEN t THEN h END AS mapping_hit, CASE
WHEN e = 'O' AND NOT r THEN 'retrieval_miss' WHEN e = 'O' AND (NOT h OR w) THEN 'verifier_mistake' WHEN e = 'O' AND x THEN 'ground_truth_ambiguity' WHEN e = 'O' THEN 'correct'
WHEN e = 'F' AND (h OR w OR x) THEN 'verifier_mistake' WHEN e = 'F' THEN 'correct' WHEN w THEN 'verifier_mistake' ELSE 'unlabelled_for_review' END AS category FROM s""")
def mapping_scores(spark, sf_dir):
    """Orders as cases: the first lines are candidates, large ones selected, returned ones the targets, discounted ones irrelevant."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("item"), "l_quantity", "l_discount", "l_returnflag")
    candidates = lines.where("item <= 3").select("case", "item", (F.col("l_quantity") > 25).alias("selected"), (F.col("l_discount") > 0.08).alias("bad"))
    expect = F.when(F.col("o_orderstatus") == "O", "materials").when(F.col("o_orderstatus") == "F", "no_material").otherwise("unlabelled")
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), expect.alias("expect"))
    return M.mapping_scores(cases, candidates, lines.where("l_returnflag = 'R'").select("case", "item")).withColumnRenamed("case", "o_orderkey")


@query(r"""WITH t AS (SELECT conv_id, conv_id * 1000 + turn AS span, text, role = 'assistant' AS fit, turn FROM conversations),
q AS (SELECT conv_id, span, turn % 5 AS s, turn % 5 + 10 AS e, CASE WHEN turn % 4 = 3 THEN 'x' ELSE '' END || substr(text, turn % 5 + 1, 10) AS quote FROM t),
a AS (SELECT * FROM q UNION ALL SELECT * FROM q WHERE span % 1000 = 1 AND conv_id % 3 = 0),
j AS (SELECT a.*, count(*) OVER (PARTITION BY a.conv_id, a.span) > 1 AS twice FROM a),
p AS (SELECT j.conv_id, j.span, CASE WHEN twice THEN 'selected_twice' WHEN fit IS NULL THEN 'absent' WHEN NOT fit THEN 'not_current_material'
WHEN NOT coalesce(e <= length(text) AND substr(text, s + 1, 10) = quote AND regexp_matches(quote, '\S'), false) THEN 'inexact_range' END AS problem FROM j LEFT JOIN (SELECT * FROM t WHERE conv_id % 11 <> 0) u ON u.span = j.span)
SELECT conv_id, span, problem FROM p WHERE problem IS NOT NULL""")
def mapping_integrity(spark, sf_dir):
    """Ten characters of every turn as a mapping's evidence; some altered, repeated or of turns that are not stored."""
    turns = table(spark, sf_dir, "conversations").withColumn("span", F.col("conv_id") * 1000 + F.col("turn"))
    start = (F.col("turn") % 5).cast("int")
    quote = F.concat(F.when(F.col("turn") % 4 == 3, "x").otherwise(""), F.substring("text", start + 1, F.lit(10)))
    once = turns.select(F.col("conv_id").alias("case"), "span", start.alias("start"), (start + 10).alias("end"), quote.alias("quote"))
    selected = once.union(once.where("span % 1000 = 1 and case % 3 = 0"))
    spans = turns.where("conv_id % 11 <> 0").select("span", "text", (F.col("role") == "assistant").alias("fit"))
    return M.integrity_violations(selected, spans).withColumnRenamed("case", "conv_id")


@query("""SELECT o_orderdate AS run, count(*) AS superseded FROM orders o WHERE o_orderkey < (SELECT max(o_orderkey) FROM orders c WHERE c.o_custkey = o.o_custkey) GROUP BY ALL""")
def superseded_during_run(spark, sf_dir):
    """Orders of a day that are no longer their customer's last."""
    orders = table(spark, sf_dir, "orders")
    current = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return M.superseded(orders.select(F.col("o_orderdate").alias("run"), "o_custkey", "o_orderkey"), current, "run", ["o_custkey", "o_orderkey"])


@query("""WITH e AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber END AS deadline, l_linestatus = 'O' AS ok, l_quantity < 10 AS clash FROM lineitem),
d AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS deadline FROM lineitem WHERE l_linenumber % 2 = 1 AND l_returnflag = 'A'),
f AS (SELECT e.id, bool_or(ok AND d.id IS NOT NULL) AS dated, bool_or(ok AND e.deadline IS NULL) AS weighed, bool_or(clash AND e.deadline IS NULL) AS clash FROM e LEFT JOIN d ON e.id = d.id AND e.deadline = d.deadline GROUP BY e.id),
s AS (SELECT o_orderkey AS id, coalesce(dated, false) OR (o_totalprice > 250000 AND coalesce(weighed, false)) AS fine, coalesce(clash, false) AS clash FROM orders LEFT JOIN f ON f.id = o_orderkey)
SELECT id, CASE WHEN fine THEN 'verified' ELSE 'needs_review' END AS status, CASE WHEN fine THEN NULL WHEN clash THEN 'conflicting_weighting' ELSE 'no_verified_assessment_fact' END AS reason FROM s""")
def assessment_statuses(spark, sf_dir):
    """Orders as assessments; odd lines are evidence of deadlines, even ones of weightings."""
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey"))
    odd, verified = F.col("l_linenumber") % 2 == 1, F.when(F.col("l_linestatus") == "O", M.VERIFIED).otherwise(M.NEEDS_REVIEW)
    deadlines = lines.where(odd).select("id", F.col("l_linenumber").alias("deadline"), F.when(F.col("l_returnflag") == "A", M.VERIFIED).otherwise(M.NEEDS_REVIEW).alias("status"))
    field = F.when(odd, "deadline").otherwise("weighting")
    reason = F.when(F.col("l_quantity") < 10, M.CONFLICTING)
    evidence = lines.select("id", F.when(odd, F.col("l_linenumber")).alias("deadline"), field.alias("field"), verified.alias("status"), reason.alias("reason"))
    assessments = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 250000, 10).alias("weighting"))
    return M.assessment_status(assessments, deadlines, evidence)


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 4 <> 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def hidden_obligations(spark, sf_dir):
    """Finished orders of some customers, none of whose lines was returned."""
    evidence = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = table(spark, sf_dir, "orders")
    return M.hidden(orders, evidence, "o_orderkey", F.col("o_orderstatus") == "F", F.col("o_custkey") % 4 != 0, F.col("l_returnflag") == "R")


@query("""SELECT c_nationkey, c_custkey, 'A' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS local_id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS evidenced FROM customer""")
def numbered_assessments(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return M.numbered(table(spark, sf_dir, "customer"), urgent, "c_nationkey", "c_name", "c_custkey").select("c_nationkey", "c_custkey", "local_id", "evidenced")


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, CASE role WHEN 'system' THEN 'slide ' || turn || CASE WHEN turn % 2 = 1 THEN ' notes' ELSE '' END WHEN 'user' THEN 'page ' || turn ELSE role END AS place FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, place, text) AS i FROM t)
SELECT conv_id, sha256(string_agg('[S' || i || '] ' || place || chr(10) || text, chr(10) || chr(10) ORDER BY i)) AS material_hash FROM n GROUP BY conv_id""")
def material_texts(spark, sf_dir):
    """Conversations as numbered, located blocks; a version's spans are few."""
    turn, role = F.col("turn"), F.col("role")
    place = C.locator(F.when(role == "system", turn), turn % 2 == 1, F.when(role == "user", turn), role)
    spans = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", place.alias("locator"), F.coalesce("text", F.lit("")).alias("excerpt")).alias("s"))
    return spans.groupBy("conv_id").agg(F.collect_list("s").alias("s")).select("conv_id", F.sha2(C.material(F.col("s")), 256).alias("material_hash"))


@query(r"""WITH t AS (SELECT item_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM benchmark)
SELECT item_id, sha256(CASE WHEN bare <> '' AND length(bare) <= 2000 THEN 'Instruct: find the passage' || chr(10) || 'Query:' || bare END) AS query_hash, sha256(CASE WHEN bare <> '' THEN text END) AS document_hash FROM t""")
def embedding_inputs(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(C.query_input(text, "find the passage"), 256).alias("query_hash"), F.sha2(C.document_input(text), 256).alias("document_hash"))


@query("SELECT doc_id, sha256(left('Requirement: ' || text || chr(10) || 'Assessment: ' || source || chr(10) || 'Course: ' || lang, 2000)) AS query_hash FROM documents")
def mapping_query_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(C.mapping_query(F.col("text"), F.col("source"), F.col("lang")), 256).alias("query_hash"))


@query("""WITH h AS (SELECT p_partkey, sha256(p_name) AS h, unnest(range(8)) AS place FROM part)
SELECT p_partkey, CAST(place AS INTEGER) AS place, 1 + CAST(CAST('0x' || substr(h, CAST(2 * place + 1 AS INTEGER), 2) AS INTEGER) AS DOUBLE) / 255 AS component FROM h""")
def placeholder_vectors(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(C.placeholder_vector(F.col("p_name"))).alias("place", "component"))


@query("""WITH h AS (SELECT event_id, 400 + event_id % 150 AS status, 1 + event_id % 6 AS retry, CAST(event_id % 97 AS DOUBLE) / 97 AS draw, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 90000 AS VARCHAR) WHEN event_id % 7 = 0 THEN 'soon' END AS ms,
CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 100 - 5 AS VARCHAR) WHEN event_id % 4 = 0 THEN 'Wed, 21 Oct 2026 07:28:00 GMT' END AS s FROM events),
a AS (SELECT *, coalesce(TRY_CAST(ms AS DOUBLE) * CAST(0.001 AS DOUBLE), CASE WHEN TRY_CAST(s AS DOUBLE) >= 0 THEN TRY_CAST(s AS DOUBLE) END) AS asked FROM h)
SELECT event_id, CASE WHEN status = 429 THEN 'rate_limited' WHEN status = 408 THEN 'timeout' WHEN status IN (501, 505) THEN 'invalid_request' WHEN status >= 500 THEN 'server_error' WHEN status IN (401, 403) THEN 'authentication' ELSE 'invalid_request' END AS category,
asked, CASE WHEN asked IS NULL THEN draw * least(CAST(8 AS DOUBLE), CAST(0.5 AS DOUBLE) * pow(2, retry - 1)) WHEN asked <= 8 THEN asked END AS delay FROM a""")
def retry_plan(spark, sf_dir):
    """Events as failed calls with what their servers ask for: in milliseconds, in seconds, as a date, or nothing."""
    i = F.col("event_id")
    milliseconds = F.when(i % 5 == 0, (i % 90000).cast("string")).when(i % 7 == 0, "soon")
    seconds = F.when(i % 3 == 0, (i % 100 - 5).cast("string")).when(i % 4 == 0, "Wed, 21 Oct 2026 07:28:00 GMT")
    calls = table(spark, sf_dir, "events").select("event_id", C.status_category(400 + i % 150).alias("category"), C.retry_after(milliseconds, seconds).alias("asked"))
    return calls.withColumn("delay", C.retry_delay(1 + i % 6, F.col("asked"), (i % 97) / 97, 0.5, 8.0))
