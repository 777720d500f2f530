"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import stem as ST
from quillspan.operators import retrieval as R
from quillspan.operators import spans as S
from quillspan.plans.register import registry
from quillspan.session import table
from quillspan.tables import settled

QUERIES, SQL, query = registry()


_TERMS = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"
_MATCHES = f"""q AS (SELECT DISTINCT item_id, unnest({_TERMS.format(t='text')}) AS lexeme FROM benchmark),
d AS (SELECT doc_id, unnest({_TERMS.format(t='text')}) AS lexeme FROM documents),
m AS (SELECT item_id, doc_id, count(*) AS score, count(DISTINCT lexeme) AS shared FROM d JOIN q USING (lexeme) GROUP BY item_id, doc_id)"""
_RANKS = """a AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, score, doc_id) AS rank FROM m QUALIFY rank <= 50),
b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM m QUALIFY rank <= 50)"""
_FUSED = """f AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS ra, b.rank AS rb,
round(CAST(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS DECIMAL(38,18)), 12) AS score FROM a FULL JOIN b ON a.item_id = b.item_id AND a.doc_id = b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, least(coalesce(ra, 1073741824), coalesce(rb, 1073741824)), coalesce(ra, 1073741824), coalesce(rb, 1073741824), doc_id) AS rank FROM f)"""


@query("""SELECT label, count(*) AS vectors, count(*) FILTER (WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0) AS valid FROM embeddings GROUP BY label""")
def vector_validity(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.groupBy("label").agg(F.count("*").alias("vectors"), F.count_if(R.valid_vector(F.col("embedding"), 64)).alias("valid"))


@query("""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""")
def cosine_topk(spark, sf_dir):
    """Exact nearest vectors of the query's own type (label is the scope), to six decimals."""
    rows = table(spark, sf_dir, "embeddings").where(R.valid_vector(F.col("embedding"), 64))
    asks = rows.where("vec_id % 20 = 0").select("label", F.col("vec_id").alias("query_id"), "embedding")
    # One more than ten, as a query may be among its own best.
    scored = R.nearest(asks, "query_id", rows, "vec_id", "label", 11).where("vec_id <> query_id")
    return R.ranked(scored, "query_id", [F.desc("score"), F.col("vec_id")], 10)


def matches(spark, sf_dir):
    return R.lexical_matches(table(spark, sf_dir, "benchmark"), "item_id", "text", table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {_MATCHES}, {_RANKS} SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank FROM b")
def lexical_topk(spark, sf_dir):
    return R.ranked(matches(spark, sf_dir), "item_id", [F.desc("score"), F.col("doc_id")], R.DEPTH).select("item_id", "doc_id", "rank")


BY_TERMS, BY_SCORE = [F.desc, "shared", "score", "doc_id"], [F.desc, "score", "doc_id"]


def _order(columns):
    first, *rest = columns[1:]
    return [columns[0](first), *[F.col(c) for c in rest]]


def both_ranks(spark, sf_dir):
    return R.ranked_twice(matches(spark, sf_dir), "item_id", "doc_id", _order(BY_TERMS), _order(BY_SCORE), R.DEPTH)


def fused(spark, sf_dir):
    return R.fused(both_ranks(spark, sf_dir), "item_id", "doc_id")


def _suffixes(table, least, extra=""):
    """A step of the stemmer in SQL: the longest suffix that fits is replaced where enough vowel-consonant pairs stand before it."""
    rows = sorted((x.split(":") if ":" in x else (x, "") for x in table.split()), key=lambda x: -len(x[0]))
    return "CASE " + " ".join(f"WHEN ends_with(w, '{end}') THEN CASE WHEN regexp_matches(left(w, -{len(end)}), '{least}'){extra if end == 'ion' else ''} THEN left(w, -{len(end)}) || '{new}' ELSE w END" for end, new in rows) + " ELSE w END"


_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
# A y that begins a word is a consonant: only behind one may it begin the vowels.
_BEGIN = f"^({_C}{_V}|[aeiou]+)"
_ONE, _TWO, _JUST_ONE, _SHORT, _VOWEL = f"{_BEGIN}{_C}", f"{_BEGIN}{_C}{_V}{_C}", f"{_BEGIN}{_C}({_V})?$", f"^{_C}[aeiouy][^aeiouwxy]$", f"^({_C}[aeiouy]|[aeiou])"
_CUT = f"""CASE WHEN b IS NULL THEN w WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN length(b) > 1 AND right(b, 1) = left(right(b, 2), 1) AND regexp_matches(b, '[^aeioulszy]$|(^|[aeiou])y(yy)+$|[^aeiouy](yy)+$') THEN left(b, -1)
WHEN regexp_matches(b, '{_JUST_ONE}') AND regexp_matches(b, '{_SHORT}') THEN b || 'e' ELSE b END"""
#: The stemmer as regular expressions over the distinct words of both tables.
_STEMS = f"""dw AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM (SELECT doc_id, unnest({_TERMS.format(t='text')}) AS word, generate_subscripts({_TERMS.format(t='text')}, 1) AS i FROM documents)),
qw AS (SELECT item_id, unnest({_TERMS.format(t='text')}) AS word, generate_subscripts({_TERMS.format(t='text')}, 1) AS place FROM benchmark),
s0 AS (SELECT word, word AS w FROM (SELECT word FROM dw UNION SELECT word FROM qw) WHERE regexp_matches(word, '^[a-z]{{3,}}$')),
s1 AS (SELECT word, CASE WHEN regexp_matches(w, '(sses|ies)$') THEN left(w, -2) WHEN regexp_matches(w, '(^|[^s])s$') THEN left(w, -1) ELSE w END AS w FROM s0),
s2 AS (SELECT word, w, CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') AND regexp_matches(left(w, -2), '{_VOWEL}') THEN left(w, -2) WHEN ends_with(w, 'ing') AND regexp_matches(left(w, -3), '{_VOWEL}') THEN left(w, -3) END AS b FROM s1),
s3 AS (SELECT word, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches(left(w, -3), '{_ONE}') THEN left(w, -1) ELSE w END ELSE {_CUT} END AS w FROM s2),
s4 AS (SELECT word, CASE WHEN ends_with(w, 'y') AND regexp_matches(left(w, -1), '{_VOWEL}') THEN left(w, -1) || 'i' ELSE w END AS w FROM s3),
s5 AS (SELECT word, {_suffixes(ST.STEP2, _ONE)} AS w FROM s4), s6 AS (SELECT word, {_suffixes(ST.STEP3, _ONE)} AS w FROM s5), s7 AS (SELECT word, {_suffixes(ST.STEP4, _TWO, " AND regexp_matches(left(w, -3), '[st]$')")} AS w FROM s6),
s8 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND (regexp_matches(left(w, -1), '{_TWO}') OR regexp_matches(left(w, -1), '{_JUST_ONE}') AND NOT regexp_matches(left(w, -1), '{_SHORT}')) THEN left(w, -1) ELSE w END AS w FROM s7),
s9 AS (SELECT word, CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{_TWO}') THEN left(w, -1) ELSE w END AS w FROM s8),
stops AS (SELECT unnest(string_split('{' '.join(sorted(ST.STOP))}', ' ')) AS word),
dl AS (SELECT doc_id, coalesce(w, dw.word) AS lexeme, place FROM dw LEFT JOIN s9 USING (word) WHERE dw.word NOT IN (SELECT word FROM stops)),
ql AS (SELECT item_id, lexeme, min(place) AS place FROM (SELECT item_id, coalesce(w, qw.word) AS lexeme, place FROM qw LEFT JOIN s9 USING (word) WHERE qw.word NOT IN (SELECT word FROM stops)) GROUP BY item_id, lexeme),
ca AS (SELECT item_id, doc_id, count(*) AS n FROM dl JOIN ql USING (lexeme) GROUP BY item_id, doc_id)"""
_COVER_LEXICAL = "l AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM ca QUALIFY rank <= 50)"

def by_covers(items, docs, every=None):
    scored = R.cover_matches(items, "item_id", "text", docs, "doc_id", "text", every)
    return R.ranked(scored, "item_id", [F.desc("score"), F.col("doc_id")], R.DEPTH)


_COVER_ORDER = "row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)"


@query(f"""WITH {_STEMS}, p AS (SELECT * FROM (SELECT item_id, lexeme, row_number() OVER (PARTITION BY item_id ORDER BY place) AS part FROM ql) WHERE part <= 2),
k AS (SELECT item_id, count(*) AS parts FROM p GROUP BY item_id),
e AS (SELECT item_id, doc_id, place, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY place) AS i, part FROM dl JOIN p USING (lexeme)),
t AS (SELECT *, max(place) FILTER (WHERE part = 1) OVER w AS a, max(place) FILTER (WHERE part = 2) OVER w AS b, max(i) FILTER (WHERE part = 1) OVER w AS ai, max(i) FILTER (WHERE part = 2) OVER w AS bi FROM e WINDOW w AS (PARTITION BY item_id, doc_id ORDER BY i)),
c AS (SELECT t.*, CASE WHEN parts = 1 THEN a WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END AS start, CASE WHEN parts = 1 THEN ai WHEN a IS NOT NULL AND b IS NOT NULL THEN least(ai, bi) END AS si FROM t JOIN k USING (item_id)),
m AS (SELECT *, lag(start) OVER (PARTITION BY item_id, doc_id ORDER BY i) AS before FROM c),
s AS (SELECT item_id, doc_id, round(sum(CAST(0.1::DOUBLE / (1 + (place - start + 1) - (i - si + 1)) AS DECIMAL(38, 18))), 9) AS score FROM m WHERE start > coalesce(before, 0) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, CAST({_COVER_ORDER} AS INTEGER) AS rank, CAST(score AS DOUBLE) AS score FROM s QUALIFY {_COVER_ORDER} <= 50""")
def lexical_every_rank(spark, sf_dir):
    """Fifty best documents that hold both of an item's first two stems, by the density of their minimal covers."""
    found = by_covers(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 2)
    return found.select("item_id", "doc_id", "rank", F.col("score").cast("double").alias("score"))


@query(f"WITH {_STEMS}, s AS (SELECT item_id, doc_id, n / 10 AS score FROM ca) SELECT item_id, doc_id, CAST({_COVER_ORDER} AS INTEGER) AS rank, score FROM s QUALIFY {_COVER_ORDER} <= 50")
def lexical_cover_rank(spark, sf_dir):
    """Fifty best documents of each item by cover density of its stems, any of which is a cover."""
    found = by_covers(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    return found.select("item_id", "doc_id", "rank", F.col("score").cast("double").alias("score"))


_VECTORS = """v AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.vec_id AS item_id, x.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]), 6) AS score
FROM embeddings q JOIN embeddings x ON q.label = x.label WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND x.vec_id IN (SELECT doc_id FROM documents)) QUALIFY rank <= 50)"""


def hybrid(spark, sf_dir, scope=None):
    """Items' vectors against documents' vectors of their label, fused with the lexical ranking; ``scope`` narrows the documents of both."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    docs = docs.where(scope) if scope else docs
    vectors = table(spark, sf_dir, "embeddings").where(R.valid_vector(F.col("embedding"), 64))
    asks = vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "item_id")
    own = vectors.withColumnRenamed("vec_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    by_vector = R.ranked(R.vector_scores(asks, "item_id", own, "doc_id", "label"), "item_id", [F.desc("score"), F.col("doc_id")], R.DEPTH)
    return R.fuse(by_vector, by_covers(items, docs), "item_id", "doc_id").select("item_id", "doc_id", "rank", F.col("score").cast("double").alias("score"))


_HYBRID = _FUSED.replace("FROM a FULL JOIN b ON", "FROM v AS a FULL JOIN l AS b ON")


@query(f"WITH {_STEMS}, {_COVER_LEXICAL}, {_VECTORS}, {_HYBRID} SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, CAST(score AS DOUBLE) AS score FROM r")
def hybrid_topk(spark, sf_dir):
    """Vector and lexical rankings of 50 each, fused."""
    return hybrid(spark, sf_dir)


_SCOPED = "lang = 'en'"


def _inside(sql):
    return sql.replace("FROM documents", "FROM inside")


@query(f"""WITH inside AS (SELECT * FROM documents WHERE {_SCOPED}), {_inside(_STEMS)}, {_COVER_LEXICAL}, {_inside(_VECTORS)}, {_HYBRID} SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, CAST(score AS DOUBLE) AS score FROM r""")
def scoped_search(spark, sf_dir):
    """The same within one language: what is out of scope takes no place in either ranking."""
    return hybrid(spark, sf_dir, _SCOPED)


@query(f"WITH {_MATCHES}, {_RANKS}, {_FUSED} SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, CAST(score AS DOUBLE) AS score FROM r")
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("item_id", "doc_id", "rank", F.col("score").cast("double").alias("score"))


@query(f"""WITH {_MATCHES}, {_RANKS}, {_FUSED}, h AS (SELECT r.item_id, min(rank) AS first FROM r JOIN documents d ON r.doc_id = d.doc_id JOIN benchmark b ON b.item_id = r.item_id WHERE contains(d.text, b.text) GROUP BY r.item_id)
SELECT count(*) AS found, count(*) FILTER (WHERE first <= 1) AS at_1, count(*) FILTER (WHERE first <= 3) AS at_3, count(*) FILTER (WHERE first <= 5) AS at_5,
CAST(coalesce(sum(CASE WHEN first <= 10 THEN 2520 // first ELSE 0 END), 0) AS BIGINT) AS mrr_2520 FROM h""")
def recall_mrr(spark, sf_dir):
    """Hits at 1, 3, 5 and the reciprocal ranks to 10 in units of 1/2520, of items that a fused document contains."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    hits = settled(fused(spark, sf_dir)).join(items, "item_id").join(docs, "doc_id").where(F.contains("text", "item"))
    first = hits.groupBy("item_id").agg(F.min("rank").alias("first"))
    at = [F.count_if(F.col("first") <= k).alias(f"at_{k}") for k in (1, 3, 5)]
    return first.agg(F.count("*").alias("found"), *at, F.coalesce(F.sum(F.when(F.col("first") <= 10, F.expr("2520 div first")).otherwise(0)), F.lit(0)).alias("mrr_2520"))


@query(f"""WITH {_MATCHES}, n AS (SELECT item_id, count(*) AS terms FROM q GROUP BY item_id), x AS (SELECT item_id, max(shared) AS best FROM m GROUP BY item_id)
SELECT n.item_id, terms, coalesce(best, 0) AS best_shared, coalesce(best, 0) = terms AS whole FROM n LEFT JOIN x USING (item_id)""")
def lexical_overlap(spark, sf_dir):
    """Each item's distinct lexemes and the most of them that one document shares."""
    terms = R.term_table(table(spark, sf_dir, "benchmark"), "item_id", "text").groupBy("item_id").agg(F.count_distinct("lexeme").alias("terms"))
    best = matches(spark, sf_dir).groupBy("item_id").agg(F.max("shared").alias("best"))
    joined = terms.join(best, "item_id", "left")
    shared = F.coalesce("best", F.lit(0))
    return joined.select("item_id", "terms", shared.alias("best_shared"), (shared == F.col("terms")).alias("whole"))


@query(f"""WITH {_MATCHES}, t AS (SELECT item_id, doc_id FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, score, doc_id) <= 3),
p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS excerpt, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id IN (SELECT doc_id FROM t)),
o AS (SELECT *, coalesce(sum(length(excerpt) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p),
l AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ordinal, CAST(s AS BIGINT) AS start_offset, CAST(s + length(excerpt) AS BIGINT) AS end_offset, excerpt FROM o WHERE regexp_matches(excerpt, '[^ \\t\\n\\x0B\\f\\r]')),
e AS (SELECT DISTINCT doc_id, ordinal, start_offset, end_offset, unnest({_TERMS.format(t='excerpt')}) AS lexeme FROM l),
c AS (SELECT t.item_id, e.doc_id, ordinal, start_offset, end_offset, count(*) AS terms FROM t JOIN e ON t.doc_id = e.doc_id JOIN q ON q.item_id = t.item_id AND q.lexeme = e.lexeme GROUP BY ALL)
SELECT item_id, doc_id, ordinal, start_offset, end_offset, terms FROM c QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY terms DESC, ordinal) = 1""")
def search_evidence(spark, sf_dir):
    """Three best documents of every item, each with the line span that shares most of the item's lexemes."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    top = R.ranked(matches(spark, sf_dir), "item_id", [F.desc("shared"), F.col("score"), F.col("doc_id")], 3).select("item_id", "doc_id")
    top = settled(top)
    spans = S.line_spans(docs.join(top.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "text")
    terms = spans.select("doc_id", "ordinal", "start_offset", "end_offset", F.explode(F.array_distinct(R.lexemes(F.col("excerpt")))).alias("lexeme"))
    asked = R.term_table(items, "item_id", "text").distinct()
    met = top.join(terms, "doc_id").join(asked, ["item_id", "lexeme"]).groupBy("item_id", "doc_id", "ordinal", "start_offset", "end_offset").agg(F.count("*").alias("terms"))
    w = Window.partitionBy("item_id", "doc_id").orderBy(F.desc("terms"), "ordinal")
    return met.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@query(f"""WITH {_MATCHES}, {_RANKS}, {_FUSED}, h AS (SELECT b.item_id, 'terms' AS mode, min(a.rank) AS first FROM a JOIN documents d ON a.doc_id = d.doc_id JOIN benchmark b ON b.item_id = a.item_id WHERE contains(d.text, b.text) GROUP BY b.item_id
UNION ALL SELECT x.item_id, 'score', min(b.rank) FROM b JOIN documents d ON b.doc_id = d.doc_id JOIN benchmark x ON x.item_id = b.item_id WHERE contains(d.text, x.text) GROUP BY x.item_id
UNION ALL SELECT x.item_id, 'fused', min(r.rank) FROM r JOIN documents d ON r.doc_id = d.doc_id JOIN benchmark x ON x.item_id = r.item_id WHERE contains(d.text, x.text) GROUP BY x.item_id),
s AS (SELECT mode, count(*) FILTER (WHERE first <= 5) AS at_5, CAST(sum(CASE WHEN first <= 10 THEN 2520 // first ELSE 0 END) AS BIGINT) AS mrr FROM h GROUP BY mode)
SELECT mode, at_5, mrr, row_number() OVER (ORDER BY at_5 DESC, mrr DESC, mode) = 1 AS selected FROM s""")
def mode_selection(spark, sf_dir):
    """Hits at 5, then reciprocal ranks, choose among the modes; at most three rows are compared."""
    ranks = settled(both_ranks(spark, sf_dir))
    rows = F.array(*[F.struct(F.lit(name).alias("mode"), F.col(rank).alias("rank")) for name, rank in (("terms", "rank_a"), ("score", "rank_b"))])
    single = ranks.select("item_id", "doc_id", F.explode(rows).alias("m")).select("m.mode", "item_id", "doc_id", "m.rank").where("rank is not null")
    ranks = single.union(R.fused(ranks, "item_id", "doc_id").select(F.lit("fused").alias("mode"), "item_id", "doc_id", "rank"))
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    first = ranks.join(items, "item_id").join(docs, "doc_id").where(F.contains("text", "item")).groupBy("mode", "item_id").agg(F.min("rank").alias("first"))
    sums = first.groupBy("mode").agg(F.count_if(F.col("first") <= 5).alias("at_5"), F.sum(F.when(F.col("first") <= 10, F.expr("2520 div first")).otherwise(0)).alias("mrr"))
    return sums.withColumn("selected", F.row_number().over(Window.orderBy(F.desc("at_5"), F.desc("mrr"), "mode")) == 1)
