"""Queries of statement structure, deadlines, gates and controls, over texts worded from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import dates as D
from quillspan.functions import statements as S
from quillspan.plans.data import BLOCKS
from quillspan.plans.register import registry
from quillspan.session import table

QUERIES, SQL, query = registry()

#: How each line of an order is worded, by its number and quantity; every kind of line meets every other.
LINES = ["'- Pack part '", "'and label part '", "'(b) Weigh part '", "'The parts follow '", "'12. Send part '", "''", "'  * Count part '", "'a) Seal part '", "'x '", "'1.5 Tons of part '"]
_WORDED = "CASE (l_linenumber * 7 + CAST(l_quantity AS INTEGER)) % 10 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(LINES)) + " END || CASE WHEN (l_linenumber * 7 + CAST(l_quantity AS INTEGER)) % 10 = 5 THEN '' ELSE CAST(l_partkey AS VARCHAR) || CASE WHEN l_linenumber % 3 = 0 THEN '. It is due. ' ELSE ' ' END END"


def order_texts(spark, sf_dir):
    """One text an order: its lines, worded by number and quantity."""
    kind = (F.col("l_linenumber") * 7 + F.col("l_quantity").cast("int")) % 10
    lead = F.element_at(F.array(*[F.expr(w) for w in LINES]), (kind + 1).cast("int"))
    line = F.when(kind == 5, "").otherwise(F.concat(lead, F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, ". It is due. ").otherwise(" ")))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line"))))
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(lines.alias("lines"))
    return orders.select("doc_id", F.array_join(F.col("lines.line"), "\n").alias("text"))


_ORDERS = f"t AS (SELECT l_orderkey AS doc_id, string_agg({_WORDED}, chr(10) ORDER BY l_linenumber, l_partkey, {_WORDED}) AS text FROM lineitem GROUP BY l_orderkey)"


@query(f"""WITH {_ORDERS}, {BLOCKS},
n AS (SELECT b.*, last_value(CASE WHEN NOT item THEN block END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block) AS above FROM b),
j AS (SELECT n.doc_id, n.block, n.s, n.e, m.s AS ms, m.e AS me, m.lines = 1 AND NOT m.unopened AS fit FROM n LEFT JOIN b m ON m.doc_id = n.doc_id AND m.block = n.above WHERE n.item),
x AS (SELECT j.*, substr(text, CAST(j.s AS BIGINT) + 1, CAST(j.e - j.s AS BIGINT)) AS part, CASE WHEN fit AND regexp_matches(substr(text, CAST(ms AS BIGINT) + 1, CAST(me - ms AS BIGINT)), '\\S') THEN substr(text, CAST(ms AS BIGINT) + 1, CAST(me - ms AS BIGINT)) END AS lead FROM j JOIN t USING (doc_id))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS INTEGER) AS item, CAST(s AS INTEGER) AS start, CAST(e - length(part) + length(rtrim(part)) AS INTEGER) AS "end",
CASE WHEN lead IS NOT NULL THEN CAST(ms + length(lead) - length(ltrim(lead)) AS INTEGER) END AS lead_start, CASE WHEN lead IS NOT NULL THEN CAST(me - length(lead) + length(rtrim(lead)) AS INTEGER) END AS lead_end FROM x""")
def list_structure(spark, sf_dir):
    """List items of texts worded from each order's lines, and the line that introduces them."""
    return S.list_items(order_texts(spark, sf_dir), "doc_id", "text")


_ZONES = [("' UK time'", "'Europe/London'", None), ("' UTC'", "'UTC'", None), ("''", "'Europe/London'", None), ("' CET'", "NULL", "unrecognised_timezone"), ("' GMT, not UK time'", "NULL", "conflicting_timezone")]
_TIMES = [("' at 01:30'", "90"), ("' at 5.45 p.m.'", "1065"), ("', noon'", "720"), ("''", "NULL"), ("' at midnight'", "NULL"), ("' at 24:15'", "NULL")]


def _choose(key, options):
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


#: Dates of 2015 and later, so that one rule of daylight saving holds: from the last Sunday of March to that of October, at 01:00 UTC.
_DUE = "o_orderdate + INTERVAL 20 YEAR"
_LAST_SUNDAY = "make_date(year(day), {month}, 31) - CAST(dayofweek(make_date(year(day), {month}, 31)) AS INTEGER)"


@query(f"""WITH a AS (SELECT o_orderkey, CAST({_DUE} AS DATE) AS day, {_choose('o_orderkey', [t for _, t in _TIMES])} AS minutes, o_orderkey % 6 AS kind, {_choose('(o_orderkey // 6)', [z for _, z, _ in _ZONES])} AS zone, (o_orderkey // 6) % 5 AS z, (o_orderkey // 30) % 4 AS d FROM orders),
b AS (SELECT *, CASE WHEN d = 3 THEN 'month_only' WHEN kind = 5 THEN 'impossible_time' END AS refused, CAST(day AS TIMESTAMP) + to_minutes(minutes) AS local, {_LAST_SUNDAY.format(month=3)} + INTERVAL 1 HOUR AS spring, {_LAST_SUNDAY.format(month=10)} + INTERVAL 1 HOUR AS autumn FROM a),
c AS (SELECT *, zone = 'Europe/London' AND local >= spring AND local < spring + INTERVAL 1 HOUR AS gap, zone = 'Europe/London' AND local >= autumn AND local < autumn + INTERVAL 1 HOUR AS twice,
CASE WHEN zone = 'Europe/London' AND local >= spring + INTERVAL 1 HOUR AND local < autumn THEN local - INTERVAL 1 HOUR ELSE local END AS utc FROM b),
e AS (SELECT *, coalesce(refused, CASE WHEN gap AND minutes IS NOT NULL THEN 'nonexistent_local_time' END) AS reason FROM c),
f AS (SELECT *, list_filter([CASE WHEN kind = 4 THEN 'ambiguous_time' END, CASE z WHEN 3 THEN CASE WHEN minutes IS NOT NULL THEN 'unrecognised_timezone' END WHEN 4 THEN 'conflicting_timezone' END, CASE WHEN d = 1 THEN 'weekday_mismatch' END,
CASE WHEN twice AND minutes IS NOT NULL THEN 'ambiguous_local_time' END], lambda r: r IS NOT NULL) AS review FROM e)
SELECT o_orderkey, CASE WHEN reason IS NULL THEN strftime(day, '%Y-%m-%d') END AS due, CASE WHEN reason IS NULL THEN CASE WHEN z = 3 AND minutes IS NULL THEN 'Europe/London' ELSE zone END END AS zone,
CASE WHEN reason IS NULL THEN CASE WHEN z IN (0, 1) THEN 'explicit_source' WHEN z = 2 OR (z = 3 AND minutes IS NULL) THEN 'institution_default' ELSE 'unknown' END END AS zone_source,
CASE WHEN reason IS NULL AND zone IS NOT NULL AND NOT twice THEN strftime(utc, '%Y-%m-%d %H:%M') END AS instant, reason, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN len(review) > 0 THEN 'needs_review' ELSE 'verified' END AS status,
CASE WHEN reason IS NULL THEN array_to_string(review, ' ') ELSE '' END AS review FROM f""")
def settled_deadlines(spark, sf_dir):
    """Deadlines worded from order dates with times, zones and weekdays of every kind, settled with London as the default zone."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.expr("cast(o_orderdate + interval 20 year as date)"))
    key = F.col("o_orderkey")
    time = F.element_at(F.array(*[F.expr(t) for t, _ in _TIMES]), (key % 6 + 1).cast("int"))
    zone = F.element_at(F.array(*[F.expr(z) for z, _, _ in _ZONES]), (F.floor(key / 6) % 5 + 1).cast("int"))
    kind = F.floor(key / 30) % 4
    day = (
        F.when(kind == 0, F.date_format("day", "EEEE d MMMM yyyy"))
        .when(kind == 1, F.concat(F.date_format(F.date_add("day", 1), "EEE"), F.lit(", "), F.date_format("day", "MMM d, yyyy")))
        .when(kind == 2, F.date_format("day", "yyyy-MM-dd"))
        .otherwise(F.date_format("day", "MMMM yyyy"))
    )
    text = F.concat(F.lit("To be sent by "), day, time, zone, F.lit("."))
    found = orders.select("o_orderkey", D.settled(D.deadline(text), "Europe/London").alias("d"))
    return found.select(
        "o_orderkey",
        F.date_format("d.date", "yyyy-MM-dd").alias("due"),
        F.col("d.zone").alias("zone"),
        F.col("d.zone_source").alias("zone_source"),
        F.date_format("d.instant", "yyyy-MM-dd HH:mm").alias("instant"),
        F.col("d.reason").alias("reason"),
        F.col("d.status").alias("status"),
        F.array_join("d.review", " ").alias("review"),
    )


_CLOSED = "[.!?][\"''”’)\\]]*"


@query(f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
o AS (SELECT *, CAST(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(x) - 1 AS BIGINT) AS s0, regexp_matches(x, '\\S') AS solid, sum(CASE WHEN regexp_matches(x, '\\S') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS para FROM p),
l AS (SELECT doc_id, i, para, s0 + length(regexp_extract(x, '^\\s*')) AS s, s0 + length(x) - length(regexp_extract(x, '\\s*$')) AS e, regexp_extract(x, '\\S.*') AS body FROM o WHERE solid),
m AS (SELECT *, regexp_matches(body, '{_CLOSED}\\s*$') AS ended, lead(body) OVER w AS nxt, row_number() OVER w = 1 AS first FROM l WINDOW w AS (PARTITION BY doc_id, para ORDER BY i)),
c AS (SELECT *, NOT ended AND e - s <= 60 AND (nxt IS NULL OR regexp_matches(nxt, '^[\\p{{Lu}}\\p{{Nd}}]')) AS fit, first OR lag(ended) OVER (PARTITION BY doc_id, para ORDER BY i) AS reset FROM m),
g AS (SELECT *, sum(CASE WHEN fit THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, para ORDER BY i) AS grp FROM c),
h AS (SELECT *, fit AND bool_or(reset AND fit) OVER (PARTITION BY doc_id, para, grp ORDER BY i) AS label FROM g),
r AS (SELECT *, sum(CASE WHEN label THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, para ORDER BY i) AS n FROM h),
u AS (SELECT doc_id, s, e, true AS label FROM r WHERE label UNION ALL SELECT doc_id, min(s), max(e), false FROM r WHERE NOT label GROUP BY doc_id, para, n),
t AS (SELECT *, string_split(part, '') AS chars FROM (SELECT u.*, substr(text, s + 1, e - s) AS part FROM u JOIN documents USING (doc_id))),
k AS (SELECT doc_id, s, part, label, unnest(list_concat([0], CASE WHEN label THEN [] ELSE list_filter(list_filter(range(1, len(chars)), lambda q: chars[q] IN ('.', '!', '?')), lambda q: regexp_matches(substr(part, q, 40), '^{_CLOSED}\\s+["“‘(]?[A-Z0-9]') AND NOT regexp_matches(substr(part, greatest(q - 4, 1), q - greatest(q - 4, 1) + 1), '(e\\.g|i\\.e|Dr|Prof|Mr|Mrs|Ms|cf|vs)\\.$')) END)) AS q FROM t),
z AS (SELECT *, CASE WHEN q = 0 THEN 0 ELSE q - 1 + length(regexp_extract(substr(part, q, 40), '^{_CLOSED}')) END AS cut FROM k),
y AS (SELECT *, lead(cut, 1, length(part)) OVER (PARTITION BY doc_id, s ORDER BY cut) AS until FROM z),
f AS (SELECT doc_id, s + cut + length(regexp_extract(substr(part, cut + 1, until - cut), '^\\s*')) AS a, s + until AS b FROM y)
SELECT doc_id, 'S' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) AS VARCHAR))) AS INTEGER), '0') AS sentence, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end" FROM f WHERE a < b""")
def numbered_sentences(spark, sf_dir):
    """Every document's sentences by number and place."""
    return S.numbered_sentences(table(spark, sf_dir, "documents"), "doc_id", "text").drop("said")
