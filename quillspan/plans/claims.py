"""Queries of the claim gates: units, proposals and quotes worded from orders and their lines so that every reason is met."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import claims as C
from quillspan.plans.register import registry
from quillspan.session import table
from quillspan.tables import settled

QUERIES, SQL, query = registry()


def _worded(expression: str):
    """An expression that both engines read."""
    return F.expr(expression)


#: An order's item (those of every tenth order repeat), its list, the paragraph under its heading, and its heading.
_ITEM = "concat('part ', cast(l_partkey % CASE WHEN l_orderkey % 10 = 0 AND floor(l_orderkey / 2) % 7 <> 1 THEN 3 ELSE 1000000 END as string), CASE cast(l_quantity as int) % 4 WHEN 0 THEN ' is required' WHEN 1 THEN ' for coursework 2' ELSE concat(' of size ', cast(cast(l_quantity as int) as string)) END)"
_HEAD = "CASE o_custkey % 3 WHEN 0 THEN 'What you should pack' ELSE 'Parts' END"
_PARA = "concat('Take care of order ', cast(o_orderkey as string), '. ', CASE WHEN o_orderkey % 13 = 0 THEN repeat('x', 2100) ELSE 'Twice.' END)"
_LIST = "concat(CASE o_orderkey % 2 WHEN 1 THEN 'The crate must contain:' ELSE 'The crate holds:' END, chr(10), '- ', list, CASE o_orderkey % 11 WHEN 0 THEN concat(chr(10), 'You are now done') ELSE '' END)"
#: Kinds: an item, two items, an item with a proposed lead-in, an unknown span, an absent or injected quote, an unknown assessment, the paragraph.
_KIND = "floor(o_orderkey / 2) % 7"


def order_units(spark, sf_dir):
    """Orders with their items in order: first, second and the list of all."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", _worded(_ITEM).alias("item"))
    per = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "item"))).alias("l"))
    items = per.select("o_orderkey", F.col("l.item").alias("items")).select("o_orderkey", F.array_join("items", "\n- ").alias("list"), F.get("items", F.lit(0)).alias("first"), F.get("items", F.lit(1)).alias("second"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(items, "o_orderkey").withColumns({"head": _worded(_HEAD), "para": _worded(_PARA), "text": _worded(_LIST), "kind": _worded(_KIND)})


def _spans(units, *rows):
    parts = [F.struct(F.lit(f"S{i}").alias("span"), F.lit(i).alias("ordinal"), F.expr(locator).alias("locator"), F.col(text).alias("excerpt")) for i, (locator, text) in enumerate(rows)]
    return units.select(F.col("o_orderkey").alias("unit"), F.explode(F.array(*parts)).alias("s")).select("unit", "s.*")


_SPARK_TO_DUCK = {" as string)": " AS VARCHAR)", "cast(o_orderkey as string)": "CAST(o_orderkey AS VARCHAR)", "cast(cast(l_quantity as int) as string)": "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)"}


def _duck(expression: str) -> str:
    for ours, theirs in _SPARK_TO_DUCK.items():
        expression = expression.replace(ours, theirs)
    return expression


_KEY = "sha256(array_to_string(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+'), ' '))"
_MUST = "regexp_matches({t}, '(?i)\\b(must|should|required)\\b')"
_UNITS = f"""i AS (SELECT l_orderkey AS o_orderkey, {_duck(_ITEM)} AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_duck(_ITEM)}) AS n FROM lineitem),
u AS (SELECT o.o_orderkey, {_HEAD} AS head, {_duck(_PARA)} AS para, (o_orderkey // 2) % 7 AS kind, o_orderkey % 2 = 1 AS lead, o_orderkey % 5 = 0 AS evidenced, o_orderkey % 11 = 0 AS injected FROM orders o WHERE o_orderkey IN (SELECT o_orderkey FROM i))"""


@query(f"""WITH {_UNITS}, q AS (SELECT o_orderkey, max(item) FILTER (WHERE n = 1) AS one, count(*) AS items FROM i GROUP BY o_orderkey),
m AS (SELECT u.*, i.item, i.n, one, kind = 1 AND items > 1 AS pair, CASE WHEN kind = 1 AND items > 1 THEN n <= 2 ELSE starts_with(item, one) END AS mine, count(*) FILTER (WHERE starts_with(i.item, one)) OVER (PARTITION BY u.o_orderkey) AS hits FROM u JOIN q USING (o_orderkey) JOIN i USING (o_orderkey) WHERE kind IN (0, 1, 2)),
t AS (SELECT o_orderkey, {_KEY.format(t='item')} AS key, min(n) AS n, any_value(item) AS item, any_value(kind) AS kind, any_value(lead) AS lead, any_value(evidenced) AS evidenced, any_value(hits) AS hits, any_value(one) AS one, any_value(pair) AS pair FROM m WHERE mine GROUP BY o_orderkey, {_KEY.format(t='item')}),
r AS (SELECT o_orderkey, key, CASE WHEN pair THEN item ELSE one END AS said, lead, evidenced, kind, CASE WHEN pair THEN 1 ELSE hits END AS hits FROM t
UNION ALL SELECT o_orderkey, {_KEY.format(t='para')}, 'Take care', NULL, evidenced, kind, 1 FROM u WHERE kind = 6),
s AS (SELECT r.*, CASE WHEN {_MUST.format(t='said')} THEN 'own' WHEN kind < 6 AND lead THEN 'line' WHEN kind = 6 AND {_MUST.format(t='head')} THEN 'heading' WHEN kind = 2 AND o_orderkey % 13 <> 0 THEN 'proposed' END AS lead_from FROM r JOIN (SELECT o_orderkey, head FROM u) h USING (o_orderkey)),
f AS (SELECT o_orderkey, key, lead_from, CASE WHEN lead_from IS NULL THEN 'no_requirement_language' WHEN kind = 6 AND o_orderkey % 13 = 0 THEN 'statement_too_long' END AS refused,
list_filter([CASE WHEN hits > 1 THEN 'non_unique_quote_location' END, CASE WHEN lead_from = 'proposed' THEN 'no_requirement_language' END, CASE WHEN NOT evidenced AND NOT contains(said, 'coursework 2') THEN 'assessment_link_unsupported' END], lambda x: x IS NOT NULL) AS review FROM s)
SELECT o_orderkey AS proposal, key, lead_from, refused, CASE WHEN refused IS NULL THEN array_to_string(review, ' ') ELSE '' END AS review FROM f
UNION ALL SELECT o_orderkey, NULL, NULL, CASE kind WHEN 3 THEN 'span_unknown' WHEN 4 THEN CASE WHEN injected THEN 'quote_overlaps_injection' ELSE 'quote_not_found' END ELSE 'assessment_unknown' END, '' FROM u WHERE kind IN (3, 4, 5)""")
def requirement_gate(spark, sf_dir):
    """One proposal an order; those over two items give two requirements."""
    units = settled(order_units(spark, sf_dir))
    spans = _spans(units, ("concat('Orders > ', head)", "head"), ("concat('Orders > ', head)", "para"), ("'page 1'", "text"))
    kind = F.col("kind")
    quote = F.when(kind == 1, F.concat_ws("\n- ", "first", "second")).when(kind == 4, "now done").when(kind == 6, "Take  care").otherwise(F.col("first"))
    proposals = units.select(
        F.col("o_orderkey").alias("proposal"),
        F.col("o_orderkey").alias("unit"),
        F.when(kind == 5, "A9").otherwise("A1").alias("assessment"),
        F.when(kind == 3, "S9").when(kind == 6, "S1").otherwise("S2").alias("span"),
        quote.alias("quote"),
        F.lit("S2").alias("lead_span"),
        F.when(kind == 2, "The crate").alias("lead_quote"),
    )
    # The proposed lead-in of kind 2 is a sentence of another span, but where order and 13 have a factor: there it is not to be found.
    proposals = proposals.withColumn("lead_span", F.when(F.col("unit") % 13 != 0, "S3").otherwise("S9")).withColumn("lead_quote", F.when(F.col("lead_quote").isNotNull(), "You must hurry"))
    spans = spans.union(units.select(F.col("o_orderkey").alias("unit"), F.lit("S3"), F.lit(3), F.lit("page 2"), F.lit("You must hurry.")))
    refs = units.select(F.col("o_orderkey").alias("unit"), F.lit("A1").alias("assessment"), F.lit("coursework 2").alias("canonical_key"), (F.col("o_orderkey") % 5 == 0).alias("evidenced"))
    gated = C.requirement_gate(proposals, spans, refs)
    return gated.select("proposal", "key", "lead_from", "refused", F.array_join("review", " ").alias("review"))


_VERBS, _WHO, _MORE = ["must", "should", "may", "will"], ["tutor", "friend"], ["It must be sealed. It must be sealed.", "The report must include a list.", "It is so."]
#: Quotes of due dates, the date claimed, and what a reader must look at (a refused one has none).
_DUES = [
    (None, None, None),
    ("due 12 March 2027 at 10:00", "2027-03-12", "missing_timezone"),
    ("due 12 March 2027 at 10:00 UTC", "2027-03-12", None),
    ("due 12 March 2027, 10:00 CET", "2027-03-12", "unrecognised_timezone"),
    ("due 12 March 2027, 10:00 UTC or UK time", "2027-03-12", "conflicting_timezone"),
    ("due Monday, 12 March 2027", "2027-03-12", "weekday_mismatch"),
    ("due 12 March 2027, midnight", "2027-03-12", "ambiguous_time"),
    ("due 31 October 2027 at 01:30 UK time", "2027-10-31", "ambiguous_local_time"),
    ("due 12/3/2027", "2027-03-12", None),
    ("due 13 March 2027 at 10:00", "2027-03-12", None),
]


def _of(options, place):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (place % len(options) + 1).cast("int"))


_LISTED = "[" + ", ".join("NULL" if r is None else f"'{r}'" for _, _, r in _DUES) + "]"


@query(f"""WITH a AS (SELECT o_orderkey AS k, {_VERBS}[1 + o_orderkey % 4] AS verb, {_WHO}[1 + (o_orderkey // 4) % 2] AS who, {_MORE}[1 + (o_orderkey // 8) % 3] AS more, {_LISTED}[1 + (o_orderkey // 3) % {len(_DUES)}] AS due, [NULL, 'A1', 'A9'][1 + o_orderkey % 3] AS link, o_orderkey % 17 = 0 AS lost FROM orders),
b AS (SELECT *, 'You ' || verb || ' see your ' || who AS q1, CASE WHEN more LIKE 'It must%' THEN 'It must be sealed.' WHEN more LIKE 'The%' THEN 'report must include' ELSE 'It is so' END AS q2 FROM a),
c AS (SELECT *, CASE WHEN lost THEN '' ELSE q1 || '|' || q2 END AS said, NOT lost AND regexp_matches(q1, 'must|should|may') AS first_worded FROM b),
d AS (SELECT *, regexp_matches(said, '\\bmust\\b') AS must, regexp_matches(said, '\\bshould\\b') AS should, regexp_matches(said, '\\bmay\\b') AS may, link = 'A1' AND k % 5 = 0 AS linked FROM c),
e AS (SELECT *, CAST(must AS INTEGER) + CAST(should AS INTEGER) + CAST(may AS INTEGER) AS kinds FROM d),
f AS (SELECT *, CASE WHEN lost THEN 'no_evidence' WHEN kinds = 0 THEN 'no_obligation_wording' WHEN NOT first_worded AND more LIKE 'The%' THEN 'wrong_claim_type' END AS refused,
list_filter([CASE WHEN NOT contains(said, 'tutor') THEN 'category_unsupported' END, CASE WHEN kinds = 1 AND may THEN 'permissive_wording' END, CASE WHEN kinds > 1 THEN 'mixed_modality' END, CASE WHEN link IS NOT NULL AND NOT linked THEN 'assessment_link_unsupported' END,
due, CASE WHEN more LIKE 'It must%' THEN 'non_unique_quote_location' END], lambda x: x IS NOT NULL) AS review FROM e)
SELECT k AS proposal, CASE WHEN kinds = 1 THEN CASE WHEN must THEN 'mandatory' WHEN should THEN 'recommended' END END AS modality, NOT lost AND coalesce(linked, false) AS linked, refused, CASE WHEN refused IS NULL THEN array_to_string(review, ' ') ELSE '' END AS review,
CASE WHEN refused IS NULL THEN sha256(lower(CASE WHEN first_worded THEN q1 ELSE 'It must be sealed' END)) END AS key FROM f""")
def obligation_gate(spark, sf_dir):
    """One proposal an order, with two quotes, a category, a link and a due date of every kind."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    said = F.concat(F.lit("You "), _of(_VERBS, k), F.lit(" see your "), _of(_WHO, F.floor(k / 4)))
    due = F.floor(k / 3)
    units = orders.withColumns({"said": said, "own": F.concat(said, F.lit(".")), "more": _of(_MORE, F.floor(k / 8)), "due": _of([q for q, _, _ in _DUES], due), "claimed": _of([d for _, d, _ in _DUES], due)})
    units = units.withColumn("dated", F.coalesce("due", F.lit("")))
    spans = _spans(units, ("'page 1'", "own"), ("'page 2'", "more"), ("'page 3'", "dated"))
    proposals = units.select(
        k.alias("proposal"),
        k.alias("unit"),
        F.lit("supervisor_review").alias("category"),
        _of([None, "A1", "A9"], k).alias("assessment"),
        F.when(F.col("due").isNull(), "not_stated").otherwise("stated").alias("due_status"),
        F.col("claimed").alias("due_date"),
        F.lit(None).cast("string").alias("due_time"),
        F.lit("S2").alias("due_span"),
        F.col("due").alias("due_quote"),
    )
    lost = k % 17 == 0
    second = F.when(F.col("more").startswith("It must"), "It must be sealed.").when(F.col("more").startswith("The"), "report must include").otherwise("It is so")
    quotes = F.array(F.struct(F.when(lost, "S9").otherwise("S0").alias("span"), F.col("said").alias("quote")), F.struct(F.when(lost, "S9").otherwise("S1").alias("span"), second.alias("quote")))
    evidence = units.select(k.alias("proposal"), k.alias("unit"), F.explode(quotes).alias("q")).select("proposal", "unit", "q.*")
    refs = units.select(k.alias("unit"), F.lit("A1").alias("assessment"), F.lit("coursework 2").alias("canonical_key"), (k % 5 == 0).alias("evidenced"))
    gated = C.obligation_gate(proposals, evidence, spans, refs, None)
    return gated.select("proposal", "modality", "linked", "refused", F.array_join("review", " ").alias("review"), "key")


_QUOTES = ["Order {k} due {d}", "Released: {d}", "Talk on {d}", "Order {k}: {d}", "Submission (  {d})", "Order: {d}", "closes {d}, 09:30 UTC"]
_CASES = "[" + ", ".join("'" + q.replace("{k}", "' || o_orderkey || '").replace("{d}", "' || strftime(day, '%-d %B %Y') || '") + "'" for q in _QUOTES) + "]"


@query(f"""WITH a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT *, {_CASES}[1 + o_orderkey % {len(_QUOTES)}] AS quote, strftime(day + CAST((o_orderkey // 7) % 2 AS INTEGER), '%Y-%m-%d') AS claim, CASE (o_orderkey // 14) % 3 WHEN 1 THEN '09:30' WHEN 2 THEN '10:00' END AS hour FROM a),
c AS (SELECT *, strptime(regexp_extract(quote, '[0-9]+ [A-Z][a-z]+ [0-9]{{4}}'), '%d %B %Y') AS stated, nullif(regexp_extract(quote, '[0-9]{{2}}:[0-9]{{2}}'), '') AS clock FROM b)
SELECT o_orderkey, CASE WHEN regexp_matches(quote, 'Released|\\( *[0-9]') THEN 'non_deadline_date' WHEN NOT regexp_matches(quote, 'due|closes|Submission') AND NOT starts_with(quote, 'Order ' || o_orderkey || ': ') THEN 'no_deadline_semantics'
WHEN strptime(claim, '%Y-%m-%d') <> stated THEN 'model_date_mismatch' WHEN hour IS NOT NULL AND hour IS DISTINCT FROM clock THEN 'model_time_mismatch' END AS refused, strftime(stated, '%Y-%m-%d') AS due, clock AS time FROM c""")
def deadline_checks(spark, sf_dir):
    """Quotes with dates in several roles against claimed dates and times, some of them wrong."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    words = [F.concat(*[{"{k}": k.cast("string"), "{d}": F.date_format(day, "d MMMM yyyy")}.get(part, F.lit(part)) for part in q.replace("{", "|{").replace("}", "}|").split("|")]) for q in _QUOTES]
    quote = F.element_at(F.array(*words), (k % len(_QUOTES) + 1).cast("int"))
    claims = table(spark, sf_dir, "orders").select(
        k,
        quote.alias("quote"),
        F.concat(F.lit("order "), k.cast("string")).alias("key"),
        F.date_format(F.date_add(day, (F.floor(k / 7) % 2).cast("int")), "yyyy-MM-dd").alias("claimed_date"),
        F.element_at(F.array(F.lit(None).cast("string"), F.lit("09:30"), F.lit("10:00")), (F.floor(k / 14) % 3 + 1).cast("int")).alias("claimed_time"),
    )
    out = C.checked_deadlines(claims, "Europe/London")
    return out.select("o_orderkey", "refused", F.date_format("value.date", "yyyy-MM-dd").alias("due"), F.col("value.time").alias("time"))
