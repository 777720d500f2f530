"""Queries of the rule operators; order lines stand for evidence rows, orders for assessments, customers for courses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.operators import aggregates as A
from quillspan.operators import rules as R
from quillspan.plans.register import registry
from quillspan.session import table

QUERIES, SQL, query = registry()


_EVIDENCE = """(SELECT l_orderkey AS subject, l_linenumber AS n, strftime(l_shipdate, '%Y-%m') AS due, CASE WHEN l_linenumber % 2 = 0 THEN '17:00' END AS time, CASE WHEN l_suppkey % 3 = 0 THEN 'Europe/London' END AS zone,
l_returnflag = 'N' AS verified, CASE WHEN l_linestatus = 'O' THEN 'stated' ELSE 'institution' END AS zone_source, CASE WHEN l_linestatus = 'O' THEN 2 ELSE 1 END AS strength,
CAST(round(l_discount * 100) AS INTEGER) AS percent, CASE l_returnflag WHEN 'A' THEN 'value_unsupported' WHEN 'R' THEN 'quote_not_found' ELSE 'none' END AS reason, l_suppkey % 4 AS priority FROM lineitem)"""


def evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    stated = F.col("l_linestatus") == "O"
    return rows.select(
        F.col("l_orderkey").alias("subject"),
        F.col("l_linenumber").alias("n"),
        F.date_format("l_shipdate", "yyyy-MM").alias("due"),
        F.when(F.col("l_linenumber") % 2 == 0, "17:00").alias("time"),
        F.when(F.col("l_suppkey") % 3 == 0, "Europe/London").alias("zone"),
        (F.col("l_returnflag") == "N").alias("verified"),
        F.when(stated, "stated").otherwise("institution").alias("zone_source"),
        F.when(stated, 2).otherwise(1).alias("strength"),
        F.round(F.col("l_discount") * 100).cast("int").alias("percent"),
        F.when(F.col("l_returnflag") == "A", "value_unsupported").when(F.col("l_returnflag") == "R", "quote_not_found").otherwise("none").alias("reason"),
        (F.col("l_suppkey") % 4).alias("priority"),
    )


@query(f"""SELECT subject, due, time, zone, bool_or(verified) AS verified, arg_max(zone_source, (strength, zone_source)) AS zone_source, count(*) AS statements FROM {_EVIDENCE} GROUP BY subject, due, time, zone""")
def deadline_merge(spark, sf_dir):
    return R.merge_deadlines(evidence(spark, sf_dir), "subject")


@query(f"""WITH g AS (SELECT subject, count(DISTINCT percent) FILTER (WHERE verified) AS k, max(percent) FILTER (WHERE verified) AS v FROM {_EVIDENCE} GROUP BY subject)
SELECT subject, CASE WHEN k = 1 THEN v END AS percent, CASE WHEN k = 1 THEN 'verified' WHEN k > 1 THEN 'disputed' ELSE 'needs_review' END AS status FROM g""")
def weighting_merge(spark, sf_dir):
    return R.merge_values(evidence(spark, sf_dir), "subject", "percent")


@query(f"""WITH g AS (SELECT subject, bool_or(verified) AS v, arg_min(reason, (priority, reason)) AS r FROM {_EVIDENCE} GROUP BY subject)
SELECT subject, CASE WHEN v THEN 'verified' ELSE 'needs_review' END AS status, CASE WHEN NOT v THEN r END AS reason FROM g""")
def requirement_merge(spark, sf_dir):
    return R.merge_reasons(evidence(spark, sf_dir), "subject", "reason", "priority")


@query(f"""SELECT subject, arg_min(zone || time, n) FILTER (WHERE zone || time IS NOT NULL) AS value, count(DISTINCT zone || time) > 1 AS conflict FROM (SELECT subject, n, zone, CASE WHEN n % 4 = 0 THEN '09:00' ELSE time END AS time FROM {_EVIDENCE}) GROUP BY subject""")
def obligation_merge(spark, sf_dir):
    time = F.when(F.col("n") % 4 == 0, "09:00").otherwise(F.col("time"))
    rows = evidence(spark, sf_dir).withColumn("value", F.concat("zone", time))
    return R.adopt_in_order(rows, "subject", ["n"], "value")


_ACTIVE = f"(SELECT * FROM {_EVIDENCE} WHERE verified AND subject NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))"


def active(spark, sf_dir):
    """Verified evidence whose order is not finished."""
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("subject"))
    return evidence(spark, sf_dir).where("verified").join(finished, "subject", "left_anti")


@query(f"SELECT subject, min(due || ' ' || coalesce(time, '00:00')) AS first_due, count(*) AS active FROM {_ACTIVE} GROUP BY subject")
def active_deadlines(spark, sf_dir):
    due = F.concat_ws(" ", "due", F.coalesce("time", F.lit("00:00")))
    return active(spark, sf_dir).groupBy("subject").agg(F.min(due).alias("first_due"), F.count("*").alias("active"))


@query(f"SELECT subject, count(DISTINCT due || '|' || coalesce(time, chr(1))) AS sides FROM {_ACTIVE} GROUP BY subject HAVING count(DISTINCT due || '|' || coalesce(time, chr(1))) > 1")
def deadline_conflicts(spark, sf_dir):
    return R.disagreement(active(spark, sf_dir), "subject", ["due", "time"])


@query(f"""WITH d AS (SELECT subject FROM {_ACTIVE} GROUP BY subject HAVING count(DISTINCT due || '|' || coalesce(time, chr(1))) > 1), o AS (SELECT o_orderkey AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' ELSE 'resolved' END AS s FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(o.subject, d.subject) AS subject, CASE WHEN o.subject IS NULL THEN 'created' WHEN d.subject IS NOT NULL AND s = 'resolved' THEN 'reopened' WHEN d.subject IS NOT NULL THEN 'kept_' || s WHEN s = 'resolved' THEN 'kept_resolved' ELSE 'resolved_by_source' END AS transition
FROM o FULL JOIN d ON o.subject = d.subject""")
def conflict_lifecycle(spark, sf_dir):
    state = F.element_at(F.array(F.lit("open"), F.lit("acknowledged"), F.lit("resolved")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    old = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("subject"), state.alias("state"))
    return R.conflict_lifecycle(old, R.disagreement(active(spark, sf_dir), "subject", ["due", "time"]), "subject")


@query("""WITH s AS (SELECT o_custkey, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END AS section, o_orderdate AS at, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'),
d AS (SELECT o_custkey, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END AS section, o_orderdate AS at, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P')
SELECT d.id AS date_id, arg_min(s.id, (s.at, s.id)) AS superseded_by FROM d JOIN s ON d.o_custkey = s.o_custkey AND d.section IS NOT DISTINCT FROM s.section AND s.at > d.at GROUP BY d.id""")
def supersession(spark, sf_dir):
    section = F.when(~F.col("o_orderpriority").like("5%"), F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", section.alias("section"), "o_orderdate", "o_orderkey", "o_orderstatus")
    statements = orders.where("o_orderstatus = 'P'").withColumnsRenamed({"o_orderdate": "statement_order", "o_orderkey": "statement_id"})
    dates = orders.where("o_orderstatus <> 'P'").withColumnsRenamed({"o_orderdate": "date_order", "o_orderkey": "date_id"})
    return R.superseded(statements, dates, ["o_custkey", "section"])


@query(f"""WITH a AS (SELECT subject, min(due) AS earliest, count(DISTINCT due) AS k, max(due) AS latest FROM {_ACTIVE} GROUP BY subject)
SELECT o_orderkey, CASE WHEN k > 1 THEN earliest ELSE coalesce(latest, strftime(o_orderdate, '%Y-%m')) END AS anchor, coalesce(k > 1, false) AS conflicting FROM orders LEFT JOIN a ON subject = o_orderkey""")
def plan_anchor(spark, sf_dir):
    """The earliest conflicting side, else the active deadline, else the order's own month."""
    sides = active(spark, sf_dir).groupBy("subject").agg(F.min("due").alias("earliest"), F.count_distinct("due").alias("k"), F.max("due").alias("latest"))
    joined = table(spark, sf_dir, "orders").join(sides.withColumnRenamed("subject", "o_orderkey"), "o_orderkey", "left")
    anchor = F.when(F.col("k") > 1, F.col("earliest")).otherwise(F.coalesce("latest", F.date_format("o_orderdate", "yyyy-MM")))
    return joined.select("o_orderkey", anchor.alias("anchor"), F.coalesce(F.col("k") > 1, F.lit(False)).alias("conflicting"))


@query("""SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'studied' WHEN bool_or(o_orderstatus <> 'O') THEN 'studying' ELSE 'to_study' END AS state FROM orders GROUP BY o_custkey""")
def study_rollup(spark, sf_dir):
    state = F.when(F.bool_and(F.col("o_orderstatus") == "F"), "studied").when(F.bool_or(F.col("o_orderstatus") != "O"), "studying").otherwise("to_study")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(state.alias("state"))


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n, min(o_orderpriority) AS p FROM orders GROUP BY ALL), b AS (SELECT * FROM y WHERE y = 1996), a AS (SELECT * FROM y WHERE y = 1997),
d AS (SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, b.o_custkey AS hb, a.o_custkey AS ha, concat_ws(',', CASE WHEN b.n IS DISTINCT FROM a.n THEN 'n' END, CASE WHEN b.p IS DISTINCT FROM a.p THEN 'p' END) AS f FROM b FULL JOIN a ON b.o_custkey = a.o_custkey)
SELECT o_custkey, CASE WHEN hb IS NULL THEN 'added' WHEN ha IS NULL THEN 'removed' WHEN f <> '' THEN 'changed' ELSE 'unchanged' END AS change, CASE WHEN hb IS NOT NULL AND ha IS NOT NULL AND f <> '' THEN f END AS fields FROM d""")
def plan_diff(spark, sf_dir):
    years = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("p"))
    return R.snapshot_diff(years.where("y = 1996"), years.where("y = 1997"), "o_custkey", ["n", "p"])


@query("""WITH b AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE year(o_orderdate) = 1996), a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE year(o_orderdate) = 1997)
SELECT effect, count(*) AS n FROM (SELECT CASE WHEN b.o_custkey IS NULL THEN 'deadline_added' WHEN a.o_custkey IS NULL THEN 'deadline_superseded' ELSE 'kept' END AS effect FROM b FULL JOIN a ON b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority) GROUP BY effect""")
def change_impact(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    before, after = (pairs.where(F.col("y") == y).select("o_custkey", "o_orderpriority").distinct() for y in (1996, 1997))
    met = before.withColumn("_b", F.lit(True)).join(after.withColumn("_a", F.lit(True)), ["o_custkey", "o_orderpriority"], "full")
    effect = F.when(F.col("_b").isNull(), "deadline_added").when(F.col("_a").isNull(), "deadline_superseded").otherwise("kept")
    return met.groupBy(effect.alias("effect")).agg(F.count("*").alias("n"))


_CODES = ("no_order", "ships_before_order", "no_discount", "wrong_status", "negative_price")
_ISSUES = """(SELECT l_orderkey, l_linenumber, 'ships_before_order' AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT l_orderkey, l_linenumber, 'no_order' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT l_orderkey, l_linenumber, 'no_discount' FROM lineitem WHERE l_discount = 0
UNION ALL SELECT l_orderkey, l_linenumber, 'wrong_status' FROM lineitem WHERE (l_linestatus = 'F') <> (l_returnflag <> 'N')
UNION ALL SELECT l_orderkey, l_linenumber, 'negative_price' FROM lineitem WHERE l_extendedprice < 0)"""


def issues(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    tests = {
        "no_order": F.col("o_orderkey").isNull(),
        "ships_before_order": F.col("l_shipdate") < F.col("o_orderdate"),
        "no_discount": F.col("l_discount") == 0,
        "wrong_status": (F.col("l_linestatus") == "F") != (F.col("l_returnflag") != "N"),
        "negative_price": F.col("l_extendedprice") < 0,
    }
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests.items()]))
    return joined.select("l_orderkey", "l_linenumber", F.explode(codes).alias("code"))


@query(f"SELECT l_orderkey, l_linenumber, code FROM {_ISSUES}")
def validation_issues(spark, sf_dir):
    """All rule violations of order lines, found in one pass over one join."""
    return issues(spark, sf_dir)


@query(f"SELECT c.code, count(i.code) AS n FROM (VALUES {', '.join(f'({c!r})' for c in _CODES)}) c(code) LEFT JOIN {_ISSUES} i ON i.code = c.code GROUP BY c.code")
def issue_counts_zero_filled(spark, sf_dir):
    codes = spark.createDataFrame([(c,) for c in _CODES], "code string")
    return A.zero_filled(issues(spark, sf_dir), "code", codes)


@query("""SELECT count(*) AS links, count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) AS no_part, count(*) FILTER (WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS no_supplier,
count(*) FILTER (WHERE o_orderkey IS NULL) AS no_order FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def lineage_issues(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    joined = lines.join(table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    joined = joined.join(table(spark, sf_dir, "supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    joined = joined.join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.agg(F.count("*").alias("links"), *[F.count_if(F.col(c).isNull()).alias(n) for c, n in (("p_partkey", "no_part"), ("s_suppkey", "no_supplier"), ("o_orderkey", "no_order"))])


@query("""WITH e AS (SELECT DISTINCT a.l_suppkey AS prerequisite, b.l_suppkey AS dependent FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey)
SELECT prerequisite, count(*) AS dependents, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM e r WHERE r.prerequisite = e.dependent AND r.dependent = e.prerequisite)) AS mutual FROM e GROUP BY prerequisite""")
def dependency_edges(spark, sf_dir):
    """Edges between suppliers of neighbouring lines, and how many run both ways."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("dependent"))
    edges = lines.join(after, ["l_orderkey", "l_linenumber"]).where("l_suppkey <> dependent").select(F.col("l_suppkey").alias("prerequisite"), "dependent").distinct()
    back = edges.select(F.col("dependent").alias("prerequisite"), F.col("prerequisite").alias("dependent"), F.lit(True).alias("_back"))
    return edges.join(back, ["prerequisite", "dependent"], "left").groupBy("prerequisite").agg(F.count("*").alias("dependents"), F.count_if(F.col("_back")).alias("mutual"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey) = 1)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS key, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS position FROM t""")
def order_tasks(spark, sf_dir):
    """Lines of an order as tasks, each needing the one before it: whatever their dates, the order of numbers must come out."""
    tasks = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("key"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("anchor"), (F.col("l_returnflag") == "R").alias("optional"))
    tasks = tasks.groupBy("l_orderkey", "key").agg(F.min("anchor").alias("anchor"), F.bool_and("optional").alias("optional"))
    w = Window.partitionBy("l_orderkey").orderBy("key")
    needs = tasks.withColumn("needs", F.lag("key").over(w)).where("needs is not null").select("l_orderkey", "key", "needs")
    return R.order_tasks(tasks, needs, "l_orderkey").drop("status")
