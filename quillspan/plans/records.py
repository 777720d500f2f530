"""Queries of the record operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import records as R
from quillspan.plans.register import registry
from quillspan.session import table

QUERIES, SQL, query = registry()


@query("""SELECT l_orderkey, l_linenumber, kind, CASE kind WHEN 'supplier' THEN s_name WHEN 'part' THEN p_name END AS label
FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'supplier' WHEN 1 THEN 'part' ELSE 'other' END AS kind FROM lineitem) LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey""")
def tagged_subjects(spark, sf_dir):
    """Lines that name, by their number, their supplier, their part or nothing."""
    kind = F.when(F.col("l_linenumber") % 3 == 0, "supplier").when(F.col("l_linenumber") % 3 == 1, "part").otherwise("other")
    links = table(spark, sf_dir, "lineitem").withColumn("kind", kind)
    links = links.select("l_orderkey", "l_linenumber", "kind", F.when(kind == "supplier", F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("ref"))
    named = {
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("label")),
        "part": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("label")),
    }
    return R.subjects(links, "kind", "ref", named).drop("ref")


@query("""SELECT 'customer' AS from_kind, c_custkey AS from_id, 'nation' AS to_kind, c_nationkey AS to_id, c_name AS from_label, n_name AS to_label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'nation', n_nationkey, 'region', n_regionkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def edge_end_labels(spark, sf_dir):
    customers, nations, regions = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))

    def edges(rows, kind, key, to_kind, to):
        return rows.select(F.lit(kind).alias("from_kind"), F.col(key).cast("long").alias("from_id"), F.lit(to_kind).alias("to_kind"), F.col(to).cast("long").alias("to_id"))

    def named(rows, key, label):
        return rows.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"))

    every = edges(customers, "customer", "c_custkey", "nation", "c_nationkey").union(edges(nations, "nation", "n_nationkey", "region", "n_regionkey"))
    return R.edge_ends(every, {"customer": named(customers, "c_custkey", "c_name"), "nation": named(nations, "n_nationkey", "n_name"), "region": named(regions, "r_regionkey", "r_name")})


@query("""SELECT lang, count(length(text)) AS n, CAST(sum(length(text)) AS BIGINT) AS total, CAST(min(length(text)) AS INTEGER) AS least, CAST(max(length(text)) AS INTEGER) AS most, CAST(grouping(lang) AS INTEGER) AS pooled FROM documents GROUP BY ROLLUP (lang)""")
def pooled_totals(spark, sf_dir):
    return R.pooled(table(spark, sf_dir, "documents"), "lang", F.length("text"))


@query("""SELECT o_orderdate AS run, CASE WHEN o_orderstatus = 'F' THEN 'merged' WHEN o_orderpriority LIKE '1%' THEN 'rejected' ELSE 'created' END AS outcome,
CASE WHEN o_orderstatus <> 'F' AND o_orderpriority LIKE '1%' THEN o_orderpriority END AS reason, count(*) AS n FROM orders GROUP BY ALL""")
def run_counters(spark, sf_dir):
    """Orders as proposals of a run a day: created, merged, or rejected for a reason."""
    rejected = (F.col("o_orderstatus") != "F") & F.col("o_orderpriority").startswith("1")
    outcome = F.when(F.col("o_orderstatus") == "F", "merged").when(rejected, "rejected").otherwise("created")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("run"), outcome.alias("outcome"), F.when(rejected, F.col("o_orderpriority")).alias("reason"))
    return R.run_summary(rows, "run", "outcome", "reason")


@query("SELECT DISTINCT o_orderkey, o_orderdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def distinct_after_fanout(spark, sf_dir):
    """Orders with a returned line; an order with several comes once."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(returned, "o_orderkey").dropDuplicates(["o_orderkey", "o_orderdate"])


@query("SELECT c_custkey, c_name, n_nationkey AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name < 'C'")
def listed_members(spark, sf_dir):
    """Customers of the nations that a manifest lists, at the manifest's places."""
    regions = table(spark, sf_dir, "region").where("r_name < 'C'").select(F.col("r_regionkey").alias("n_regionkey"))
    manifest = table(spark, sf_dir, "nation").join(regions, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_nationkey").alias("order"))
    return R.listed(table(spark, sf_dir, "customer"), manifest, "c_nationkey", "order").select("c_custkey", "c_name", "place")


@query(r"SELECT doc_id FROM documents WHERE text ILIKE '%the%in%' AND regexp_matches(text, '\b[Tt]he\s+\w+\s+in\b')")
def like_then_pattern(spark, sf_dir):
    return R.worded(table(spark, sf_dir, "documents"), "text", "%the%in%", "\\b[Tt]he\\s+\\w+\\s+in\\b").select("doc_id")


@query(r"""SELECT conv_id, turn, CASE WHEN text IS NULL OR turn < 0 OR lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) = turn THEN 'invalid' WHEN NOT regexp_matches(text, '\S') THEN 'no_visible_text' ELSE 'chunkable' END AS class FROM conversations""")
def content_classes(spark, sf_dir):
    """Turns by what they give an index; a turn number met twice is out of order."""
    from pyspark.sql import Window

    following = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations").withColumn("ordered", (F.col("turn") >= 0) & ~F.coalesce(following == F.col("turn"), F.lit(False)))
    return turns.select("conv_id", "turn", R.content_class(F.col("text"), F.col("ordered")).alias("class"))


_LINKS = """e AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem), c AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS e, count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag <> 'R') AS s FROM e GROUP BY l_orderkey),
s AS (SELECT l_orderkey, CASE WHEN s = 0 THEN 'zero' WHEN s = e THEN 'complete' ELSE 'inconsistent' END AS state FROM c)"""


def _link_states(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return R.link_state(lines.select("l_orderkey", "l_linenumber").distinct(), lines.where("l_returnflag <> 'R'"), "l_orderkey", "l_linenumber")


@query(f"WITH {_LINKS} SELECT l_orderkey, state FROM s")
def link_states(spark, sf_dir):
    """Orders whose stored links, the lines that were not returned, are none, all or some of their lines."""
    return _link_states(spark, sf_dir)


@query(f"""WITH {_LINKS} SELECT o_custkey, CASE WHEN bool_or(state = 'inconsistent') THEN 'corrupt' WHEN bool_or(state = 'zero') THEN 'unindexed' ELSE 'searchable' END AS state FROM s JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def search_states(spark, sf_dir):
    """Customers as scopes: one order with inconsistent links makes the whole scope corrupt."""
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return R.search_state(_link_states(spark, sf_dir).join(owners, "l_orderkey"), "o_custkey", "state")


@query("SELECT event_id FROM events WHERE (event_type = 'purchase' AND (value IS NULL OR user_id IS NULL)) OR (event_type = 'click' AND ts IS NULL)")
def locator_fit(spark, sf_dir):
    """Events without what their type requires."""
    return R.locator_violations(table(spark, sf_dir, "events"), "event_type", {"purchase": ["value", "user_id"], "click": ["ts"]}).select("event_id")


@query(r"SELECT conv_id, turn, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_hash FROM conversations")
def collapsed_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.collapsed(F.col("text")), 256).alias("text_hash"))


@query("""WITH q AS (SELECT c_custkey AS o_custkey, CASE WHEN c_custkey % 5 = 4 THEN 50 ELSE greatest(1, least([-3, 0, 4, 1000][1 + c_custkey % 5], 50)) END AS n FROM customer WHERE c_custkey % 3 = 0)
SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rank FROM orders JOIN q USING (o_custkey) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) QUALIFY row_number() OVER w <= n""")
def bounded_listings(spark, sf_dir):
    """Customers' latest orders, as many as asked within bounds; some ask for none, too few or too many."""
    k = F.col("c_custkey")
    asked = F.element_at(F.array(*[F.lit(n).cast("int") for n in (-3, 0, 4, 1000, None)]), (k % 5 + 1).cast("int"))
    requests = table(spark, sf_dir, "customer").where(k % 3 == 0).select(k.alias("o_custkey"), asked.alias("asked"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.bounded_listing(rows, requests, "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "rank")
