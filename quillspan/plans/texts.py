"""Queries of the text, date, chunking and page operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import dates as D
from quillspan.functions import stem as ST
from quillspan.functions import text as T
from quillspan.operators import chunking as C
from quillspan.operators import spans as S
from quillspan.plans.register import registry
from quillspan.plans.retrieval import _STEMS
from quillspan.session import table
from quillspan.sources import pages as P
from quillspan.tables import settled

QUERIES, SQL, query = registry()


_WORDS = "regexp_extract_all(replace(lower({t}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


@query("""WITH a AS (SELECT doc_id, string_split(nfc_normalize(translate(replace(translate(text, 'xkqz', chr(11) || chr(133) || chr(8232) || chr(7)), chr(13) || chr(10), chr(10)), chr(13) || chr(11) || chr(12) || chr(133) || chr(8232) || chr(8233) || chr(7), repeat(chr(10), 6))), chr(10)) AS l FROM documents),
b AS (SELECT doc_id, list_transform(l, lambda x: array_to_string(list_filter(string_split(replace(x, chr(9), ' '), ' '), lambda w: w <> ''), ' ')) AS l FROM a),
c AS (SELECT doc_id, array_to_string(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: z[1] <> '' OR z[2] > 1 AND l[z[2] - 1] <> '').list_transform(lambda z: z[1]), chr(10)) AS t FROM b)
SELECT doc_id, sha256(trim(t, chr(10))) AS text_hash FROM c""")
def normalize_text(spark, sf_dir):
    """Documents in which some letters are turned into odd line breaks and a control character."""
    odd = F.translate("text", "xkqz", "\x0b\x85\u2028\x07")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalise(odd), 256).alias("text_hash"))


@query(f"SELECT doc_id, len({_WORDS.format(t='text')}) AS words, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, sha256(array_to_string({_WORDS.format(t='text')}, ' ')) AS statement_key FROM documents")
def words_and_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(T.words(F.col("text"))).cast("long").alias("words"), T.token_estimate(F.col("text")).alias("tokens"), T.statement_key(F.col("text")).alias("statement_key")
    )


_TITLE = "CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_size || ' ' || p_name WHEN 2 THEN p_name || ' (' || p_size || '), part 2' ELSE p_size || ': ' || p_size || ' of ' || p_brand END"


@query(f"""WITH w AS (SELECT p_partkey, {_WORDS.format(t=_TITLE)} AS w FROM part), n AS (SELECT p_partkey, w, unnest([2, 3, 4]) AS i FROM w), f AS (SELECT p_partkey, min(i) AS i FROM n WHERE try_cast(w[i] AS BIGINT) IS NOT NULL GROUP BY p_partkey)
SELECT p_partkey, array_to_string(list_slice(w, 1, coalesce(i, len(w))), ' ') AS canonical_key FROM w LEFT JOIN f USING (p_partkey)""")
def canonical_key(spark, sf_dir):
    """Titles worded from parts, with numbers in first and in later places."""
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 4
    title = (
        F.when(kind == 0, F.col("p_brand"))
        .when(kind == 1, F.concat_ws(" ", size, "p_name"))
        .when(kind == 2, F.concat("p_name", F.lit(" ("), size, F.lit("), part 2")))
        .otherwise(F.concat(size, F.lit(": "), size, F.lit(" of "), "p_brand"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", T.canonical_key(title).alias("canonical_key"))


@query("""SELECT conv_id, turn, substr(array_to_string(list_filter(string_split(translate('It''s "`' || turn || '`" <b>' || chr(9) || text, '"<>' || chr(9) || chr(10) || chr(13), repeat(' ', 6)), ' '), lambda w: w <> ''), ' '), 1, 200) AS title FROM conversations""")
def safe_title(spark, sf_dir):
    """Titles with quotes, marks and breaks, worded from turns."""
    title = F.concat(F.lit("It's \"`"), F.col("turn").cast("string"), F.lit('`" <b>\t'), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.safe_title(title).alias("title"))


_PHRASES = ["is", "May", "can", "could", "might", "is optional to", "if you wish, will", "should", "is recommended to", "is advised to", "must", "SHALL", "is required to", "needs to", "has to", "is compulsory to", "may  not", "must not", "cannot", "can not", "is not allowed to", "is not permitted to"]
_ENDS = ["be sent", "wait; no parcel may", "be sent and should be signed", "be sent. No one, not even a clerk who may", "be sent, maybe", "rest while others must"]


def _picked(words: list[str], place: str) -> str:
    return f"[{', '.join(repr(w) for w in words)}][1 + {place} % {len(words)}]"


_SAID = f"'Order ' || o_orderkey || ' ' || {_picked(_PHRASES, 'o_orderkey')} || ' ' || {_picked(_ENDS, '(o_orderkey // 3)')} || ' now.'"


@query(f"""WITH a AS (SELECT o_orderkey, {_SAID} AS said FROM orders), b AS (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(said), '[a-z]+|[.;:]'), ' ') || ' ' AS t FROM a),
c AS (SELECT *, list_filter(string_split('may not,must not,cannot,can not,not permitted,not allowed', ','), lambda p: contains(t, ' ' || p || ' ')) AS no, regexp_matches(t, ' no [^.;:]* ?may ') AS none FROM b),
d AS (SELECT *, regexp_replace(regexp_replace(t, ' (may not|must not|cannot|can not|not permitted|not allowed) ', ' # ', 'g'), ' no [^.;:]*?may ', ' # ') AS rest FROM c),
e AS (SELECT o_orderkey, said, len(no) > 0 OR none OR len(list_filter(string_split('must,required,requires,requirement,need to,needs to,have to,has to,shall,mandatory,compulsory', ','), lambda p: contains(t, ' ' || p || ' '))) > 0 AS mandatory,
len(list_filter(string_split('should,recommended,recommend,encouraged,advised,advisable', ','), lambda p: contains(t, ' ' || p || ' '))) > 0 AS recommended, len(list_filter(string_split('may,can,could,might,optional,optionally,if you wish', ','), lambda p: contains(rest, ' ' || p || ' '))) > 0 AS permissive FROM d)
SELECT o_orderkey, CASE WHEN CAST(mandatory AS INTEGER) + CAST(recommended AS INTEGER) + CAST(permissive AS INTEGER) > 1 THEN 'mixed' WHEN mandatory THEN 'mandatory' WHEN recommended THEN 'recommended' WHEN permissive THEN 'permissive' END AS modality,
CAST(nullif(strpos(lower(said), regexp_extract(lower(said), '\\b(no\\b[^.;:]{{0,60}}?\\bmay|may\\s+not|must|cannot|can|not allowed|not permitted|may|could|might|optional|if you wish|should|recommended|advised|shall|required|needs to|has to|compulsory)\\b')), 1) - 1 AS INTEGER) AS first FROM e""")
def modal_wording(spark, sf_dir):
    """Statements worded from each order with every modal phrase, classified by their words."""
    place = [F.col("o_orderkey") % len(_PHRASES), F.floor(F.col("o_orderkey") / 3) % len(_ENDS)]
    words = [F.element_at(F.array(*[F.lit(w) for w in ws]), (p + 1).cast("int")) for ws, p in zip((_PHRASES, _ENDS), place)]
    text = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), words[0], F.lit(" "), words[1], F.lit(" now."))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.modality(text).alias("modality"), T.wording(text)["first"].alias("first"))


@query("""SELECT value, count(*) AS n FROM (SELECT CAST(round(l_discount * 100) AS INTEGER) AS value FROM lineitem UNION ALL SELECT CAST(round(l_tax * 100) AS INTEGER) FROM lineitem) GROUP BY value""")
def percent_values(spark, sf_dir):
    """Percentages worded from discounts and taxes, found again in the text; the price's own decimals do not count."""
    text = F.concat(
        F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("% off "), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit(", tax "), F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit(" per cent")
    )
    found = table(spark, sf_dir, "lineitem").select(F.explode(T.percents(text)).alias("value"))
    return found.groupBy("value").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS due, CASE WHEN o_orderkey % 4 <> 3 THEN CASE o_orderkey % 3 WHEN 0 THEN '17:30' WHEN 1 THEN '15:00' END END AS time,
CASE WHEN o_orderkey % 4 = 3 THEN 'numeric_date' END AS reason FROM orders""")
def parse_deadline(spark, sf_dir):
    """Deadlines worded from order dates in four ways, parsed again; the numeric one must be refused."""
    day = [F.date_format("o_orderdate", f) for f in ("d MMMM yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "dd/MM/yyyy")]
    stated = F.element_at(F.array(*day), (F.col("o_orderkey") % 4 + 1).cast("int"))
    time = F.element_at(F.array(F.lit(" at 17:30"), F.lit(" at 3 pm"), F.lit("")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", D.deadline(F.concat(F.lit("Submit by "), stated, time, F.lit("."))).alias("d"))
    return found.select("o_orderkey", F.date_format("d.date", "yyyy-MM-dd").alias("due"), F.col("d.time").alias("time"), F.col("d.reason").alias("reason"))


#: In London the clocks go forward at 01:00 on the last Sunday of March and back at 02:00 (01:00 UTC) on that of October.
_SUNDAY = "make_date(year(ts), {month}, 31) - CAST(dayofweek(make_date(year(ts), {month}, 31)) AS INTEGER) + INTERVAL 1 HOUR"


@query(f"""WITH e AS (SELECT event_id, ts + to_days(CAST(event_id % 300 AS INTEGER)) AS ts FROM events), s AS (SELECT *, {_SUNDAY.format(month=3)} AS spring, {_SUNDAY.format(month=10)} AS autumn FROM e),
t AS (SELECT *, CASE WHEN ts >= spring AND ts < spring + INTERVAL 1 HOUR THEN 'gap' WHEN ts >= autumn AND ts < autumn + INTERVAL 1 HOUR THEN 'overlap' ELSE 'exact' END AS state FROM s)
SELECT event_id, CASE WHEN state = 'exact' THEN strftime(CASE WHEN ts >= spring AND ts < autumn THEN ts - INTERVAL 1 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S') END AS instant, state FROM t""")
def dst_instant(spark, sf_dir):
    """Event times, spread over a year, read as London wall-clock times: exact, in a gap or in an overlap."""
    spread = F.expr("cast(ts as timestamp) + make_dt_interval(cast(event_id % 300 as int))")
    found = table(spark, sf_dir, "events").select("event_id", D.local_instant(spread, "Europe/London").alias("i"))
    return found.select("event_id", F.date_format("i.instant", "yyyy-MM-dd HH:mm:ss").alias("instant"), F.col("i.state").alias("state"))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1997-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders WHERE o_orderstatus <> 'F'")
def days_until(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", F.datediff(F.to_date("o_orderdate"), F.lit("1997-01-01").cast("date")).alias("days"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CAST(ceil(length(text) / 4) AS BIGINT) AS n FROM conversations),
f AS (SELECT conv_id, i, n AS size, CAST(1 AS BIGINT) AS unit FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.i, CASE WHEN f.size + t.n <= 150 THEN f.size + t.n ELSE t.n END, CASE WHEN f.size + t.n <= 150 THEN f.unit ELSE f.unit + 1 END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
SELECT conv_id, unit, count(*) AS turns, max(size) AS tokens FROM f GROUP BY conv_id, unit""")
def pack_units(spark, sf_dir):
    """Turns of each conversation packed in order into units of at most 150 estimated tokens; a longer turn stands alone."""
    ordered = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", T.token_estimate(F.col("text")).alias("n")))).alias("t"))
    start = F.expr("named_struct('unit', 0L, 'size', 0L, 'out', cast(array() as array<struct<unit:bigint,size:bigint>>))")

    def step(acc, x):
        fits = (acc["unit"] > 0) & (acc["size"] + x["n"] <= 150)
        unit, size = F.when(fits, acc["unit"]).otherwise(acc["unit"] + 1), F.when(fits, acc["size"] + x["n"]).otherwise(x["n"])
        return F.struct(unit.alias("unit"), size.alias("size"), F.concat(acc["out"], F.array(F.struct(unit.alias("unit"), size.alias("size")))).alias("out"))

    units = ordered.select("conv_id", F.explode(F.aggregate("t", start, step, lambda a: a["out"])).alias("u"))
    return units.groupBy("conv_id", F.col("u.unit").alias("unit")).agg(F.count("*").alias("turns"), F.max("u.size").alias("tokens"))


def document_versions(spark, sf_dir):
    """Documents with their line spans as one array each, written once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mark = F.struct(F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("slide"), F.col("start_offset").alias("start"), F.col("end_offset").alias("end"))
    spans = S.line_spans(docs, "doc_id", "text").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", mark.alias("m")))).alias("s"))
    return settled(docs.join(spans.select("doc_id", F.transform("s", lambda x: x["m"]).alias("spans")), "doc_id", "left"))


@query()
def chunk_documents(spark, sf_dir):
    return C.chunk_documents(document_versions(spark, sf_dir), "doc_id")


@query("SELECT CAST(0 AS BIGINT) AS violations, count(*) AS documents FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]')")
def chunk_check(spark, sf_dir):
    """Chunks that break the contract, of which there may be none, and documents with chunks, which must be all with visible text."""
    versions = document_versions(spark, sf_dir)
    chunks = settled(C.chunk_documents(versions, "doc_id"))
    wrong = C.violations(chunks, versions, "doc_id").agg(F.count("*").alias("violations"))
    return wrong.join(chunks.agg(F.count_distinct("doc_id").alias("documents")), F.lit(True))


#: Ranges of three lines each that share one; those of odd number begin two characters late where the line is long enough.
_LINE_CHUNKS = """p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
o AS (SELECT *, CAST(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(x) - 1 AS BIGINT) AS s FROM p), l AS (SELECT doc_id, s, s + length(x) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, count(*) OVER (PARTITION BY doc_id) AS m FROM o WHERE regexp_matches(x, '\\S')),
k AS (SELECT a.doc_id, CASE WHEN (a.n // 2) % 2 = 1 AND a.e - a.s > 4 THEN a.s + 2 ELSE a.s END AS s, b.e, a.n AS f, b.n AS z FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.n = least(a.n + 2, a.m - 1) WHERE a.n % 2 = 0 AND (a.n = 0 OR a.n < a.m - 1))"""


def line_chunks(spans):
    w = Window.partitionBy("doc_id")
    third = F.lead("end_offset", 2).over(w.orderBy("ordinal"))
    late = (F.floor(F.col("ordinal") / 2) % 2 == 1) & (F.col("end_offset") - F.col("start_offset") > 4)
    last = F.max("ordinal").over(w)
    rows = spans.withColumns({"_last": last, "end": F.coalesce(third, F.max("end_offset").over(w)), "last_span": F.least(F.col("ordinal") + 2, last), "start": F.when(late, F.col("start_offset") + 2).otherwise(F.col("start_offset"))})
    return rows.where("ordinal % 2 = 0 and (ordinal = 0 or ordinal < _last)").select("doc_id", "start", "end", F.col("ordinal").alias("first_span"), "last_span")


_VISIBLE = "length(regexp_replace({t}, '\\s', '', 'g'))"


@query(f"""WITH {_LINE_CHUNKS}, c AS (SELECT k.*, CAST(ceil((k.e - k.s) / 4) AS BIGINT) AS t, k.z - k.f + 1 AS n, CASE WHEN k.s > l.s THEN 1 ELSE 0 END AS g FROM k JOIN l ON l.doc_id = k.doc_id AND l.n = k.f),
a AS (SELECT doc_id, grouping(doc_id) AS pooled, count(*) AS chunks, min(t) AS tokens_min, quantile_disc(t, 0.5) AS tokens_p50, quantile_disc(t, 0.95) AS tokens_p95, max(t) AS tokens_max, count(*) FILTER (WHERE t >= 800) AS at_target, count(*) FILTER (WHERE t = 1000) AS at_hard,
round(avg(n), 6) AS spans_per_chunk, max(n) AS spans_per_chunk_max, CAST(sum(g) AS BIGINT) AS edges_inside, CAST(sum(e - s) AS BIGINT) AS chunk_chars FROM c GROUP BY ROLLUP (doc_id)),
h AS (SELECT l.doc_id, l.n, bool_or(k.s <= l.s AND l.e <= k.e) AS held FROM l JOIN k ON k.doc_id = l.doc_id AND l.n BETWEEN k.f AND k.z GROUP BY l.doc_id, l.n),
r AS (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM k), x AS (SELECT doc_id, CASE WHEN b > s THEN b ELSE s END AS s, e FROM r WHERE b IS NULL OR e > b),
v AS (SELECT doc_id, CAST(sum(x.e - x.s) AS BIGINT) AS covered, CAST(sum({_VISIBLE.format(t='substr(text, x.s + 1, x.e - x.s)')}) AS BIGINT) AS seen FROM x JOIN documents USING (doc_id) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(q.spans, 0) AS spans, coalesce(split, 0) AS split_spans, {_VISIBLE.format(t='text')} AS visible_chars, coalesce(covered, 0) AS covered_chars, coalesce(seen, 0) AS covered_visible_chars, length(text) AS size
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS spans, count(*) FILTER (WHERE NOT held) AS split FROM h GROUP BY doc_id) q USING (doc_id) LEFT JOIN v USING (doc_id)),
t AS (SELECT doc_id, grouping(doc_id) AS pooled, CAST(sum(spans) AS BIGINT) AS spans, CAST(sum(split_spans) AS BIGINT) AS split_spans, CAST(sum(visible_chars) AS BIGINT) AS visible_chars, CAST(sum(covered_chars) AS BIGINT) AS covered_chars, CAST(sum(covered_visible_chars) AS BIGINT) AS covered_visible_chars, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY ROLLUP (doc_id))
SELECT t.doc_id, coalesce(chunks, 0) AS chunks, spans, spans AS visible_spans, tokens_min, tokens_p50, tokens_p95, tokens_max, coalesce(at_target, 0) AS at_target, coalesce(at_hard, 0) AS at_hard, spans_per_chunk, spans_per_chunk_max, split_spans, coalesce(edges_inside, 0) AS edges_inside, coalesce(chunk_chars, 0) AS chunk_chars, covered_chars,
round(chunk_chars / nullif(covered_chars, 0), 6) AS duplication, round((chunk_chars - covered_chars) / nullif(covered_chars, 0), 6) AS overlap_extra, visible_chars, covered_visible_chars, round(covered_visible_chars / nullif(visible_chars, 0), 6) AS visible_coverage, size - covered_chars - (visible_chars - covered_visible_chars) AS uncovered_white
FROM t LEFT JOIN a ON a.doc_id IS NOT DISTINCT FROM t.doc_id AND a.pooled = t.pooled""")
def chunk_measures(spark, sf_dir):
    """All measures of a set of ranges that SQL can state, for each document and pooled (a null doc_id)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = settled(S.line_spans(docs, "doc_id", "text").select("doc_id", "ordinal", "start_offset", "end_offset"))
    return C.chunk_measures(settled(line_chunks(spans)), spans.select("doc_id", "ordinal", F.col("start_offset").alias("start"), F.col("end_offset").alias("end")), docs, "doc_id")


@query(f"""WITH {_LINE_CHUNKS}, j AS (SELECT * FROM l WHERE (doc_id + n) % 5 < 2), g AS (SELECT doc_id, coalesce(lag(e) OVER w, 0) AS s, s AS e FROM j WINDOW w AS (PARTITION BY doc_id ORDER BY s)
UNION ALL SELECT d.doc_id, coalesce(max(j.e), 0), any_value(length(d.text)) FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY d.doc_id),
t AS (SELECT g.doc_id, g.s, g.e, substr(text, g.s + 1, g.e - g.s) AS x FROM g JOIN documents USING (doc_id) WHERE g.s < g.e)
SELECT doc_id, s + length(regexp_extract(x, '^\\s*')) AS start, e - length(regexp_extract(x, '\\s*$')) AS "end" FROM t WHERE regexp_matches(x, '\\S')""")
def uncovered_text(spark, sf_dir):
    """What two lines of five leave uncovered of each document's visible text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = S.line_spans(docs, "doc_id", "text").where("(doc_id + ordinal) % 5 < 2")
    return C.uncovered_text(spans.select("doc_id", F.col("start_offset").alias("start"), F.col("end_offset").alias("end")), docs, "doc_id")


@query()
def chunk_stats(spark, sf_dir):
    """All measures of the packed chunks of every document, and pooled."""
    versions = document_versions(spark, sf_dir)
    chunks = settled(C.chunk_documents(versions, "doc_id").select("doc_id", F.col("start_offset").alias("start"), F.col("end_offset").alias("end"), "first_span", "last_span"))
    spans = versions.select("doc_id", F.posexplode("spans").alias("ordinal", "s")).select("doc_id", "ordinal", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    return C.chunk_measures(chunks, spans, versions, "doc_id")


@query()
def html_blocks(spark, sf_dir):
    """Structural blocks of every page with their heading trail."""
    return P.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query(f"WITH {_STEMS} SELECT lexeme, count(DISTINCT doc_id) AS documents FROM dl GROUP BY lexeme")
def stemmed_lexemes(spark, sf_dir):
    """How many documents hold each stem."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(ST.lexeme_list("text")).alias("lexeme")).groupBy("lexeme").agg(F.count("*").alias("documents"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), o AS (SELECT *, CAST(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(x) - 1 AS BIGINT) AS s FROM p),
l AS (SELECT doc_id, s, s + length(x) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM o WHERE regexp_matches(x, '\\S')),
d AS (SELECT doc_id, n, CASE WHEN (doc_id + n) % 7 = 0 AND n > 0 THEN s - 3 ELSE s END AS s, CASE WHEN (doc_id + n) % 11 = 0 THEN e + 1000000 ELSE e END AS e FROM l WHERE NOT (doc_id % 5 = 0 AND n = 2) AND doc_id % 23 <> 0),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS r, lag(e) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM d)
SELECT doc_id, n AS ordinal, CASE WHEN n <> r THEN 'not_numbered' WHEN s < 0 OR s >= e OR e > length(text) THEN 'outside_text' ELSE 'not_in_order' END AS problem FROM w JOIN documents USING (doc_id) WHERE n <> r OR s < 0 OR s >= e OR e > length(text) OR s < b
UNION ALL SELECT doc_id, NULL, 'no_spans' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d)""")
def span_problems(spark, sf_dir):
    """Line spans of documents, some missing, moved or stretched, against what chunking needs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    k, n = F.col("doc_id"), F.col("ordinal")
    lines = S.line_spans(docs, "doc_id", "text").where(~((k % 5 == 0) & (n == 2)) & (k % 23 != 0))
    start = F.when(((k + n) % 7 == 0) & (n > 0), F.col("start_offset") - 3).otherwise(F.col("start_offset"))
    end = F.when((k + n) % 11 == 0, F.col("end_offset") + 1_000_000).otherwise(F.col("end_offset"))
    return S.span_problems(lines.select("doc_id", "ordinal", start.alias("start_offset"), end.alias("end_offset")), docs, "doc_id")
