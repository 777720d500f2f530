"""Queries of index runs and of search on a pinned, verified index."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import chunking as C
from quillspan.operators import index as I
from quillspan.operators import spans as S
from quillspan.plans.register import registry
from quillspan.plans.retrieval import _STEMS
from quillspan.plans.texts import document_versions
from quillspan.session import table
from quillspan.tables import shared_folder

QUERIES, SQL, query = registry()


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN ' ' ELSE text END AS t, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S'))) AS n FROM documents),
b AS (SELECT *, CASE WHEN t IS NULL OR (doc_id % 23 = 0 AND n > 0) OR (doc_id % 19 = 0 AND n > 1) THEN 'load' WHEN doc_id % 11 = 0 AND n > 1 AND NOT (doc_id % 19 = 0 AND n > 1) THEN 'check' END AS stage FROM a)
SELECT doc_id, CASE WHEN stage IS NOT NULL THEN 'failed' WHEN NOT regexp_matches(t, '\\S') THEN 'no_visible_text' WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'unchanged' ELSE 'indexed' END AS outcome, stage,
CASE stage WHEN 'load' THEN 'invalid_source' WHEN 'check' THEN 'uncovered_text' END AS error FROM b""")
def index_run(spark, sf_dir):
    """Documents as versions, some without text, with spans out of order or beyond the text, or with a line in no span; a third was indexed before, half of it as it is now."""
    docs = document_versions(spark, sf_dir)
    k = F.col("doc_id")
    text = F.when(k % 17 == 0, None).when(k % 23 == 0, " ").otherwise(F.col("text"))
    spans = F.when(k % 19 == 0, F.reverse("spans")).when((k % 11 == 0) & (F.size("spans") > 1), F.slice("spans", 1, F.greatest(F.size("spans") - 1, F.lit(1)))).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<kind:string,slide:int,start:bigint,end:bigint>>)")))
    versions = docs.select("doc_id", text.alias("text"), spans.alias("spans"))
    had = C.chunk_documents(docs.where("doc_id % 3 = 0"), "doc_id").withColumn("text_hash", F.when(k % 2 == 0, F.col("text_hash")).otherwise("old"))
    _, outcomes = I.index_run(versions, had, "doc_id")
    return outcomes.drop("chunks")


_PIECES = """pieces AS (SELECT doc_id * 1000000 + row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS doc_id, x AS text, lang FROM
(SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id % 7 <> 0) WHERE regexp_matches(x, '\\S'))"""


@query(f"""WITH {_PIECES}, {_STEMS.replace('FROM documents', 'FROM pieces')}, g AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), n AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS m FROM g),
h AS (SELECT ca.item_id, ca.doc_id, ca.n FROM ca JOIN pieces USING (doc_id) JOIN n USING (lang) WHERE ca.item_id % n.m = n.i)
SELECT item_id AS request, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id // 1000000 AS doc_id, CAST(doc_id % 1000000 AS INTEGER) AS chunk_ordinal, n / 10 AS score FROM h WINDOW w AS (PARTITION BY item_id ORDER BY n DESC, doc_id) QUALIFY row_number() OVER w <= 10""")
def pinned_search(spark, sf_dir):
    """Items asked within one language each, of an index whose chunks are lines; a seventh of the documents is not indexed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    lines = S.line_spans(docs.where("doc_id % 7 <> 0"), "doc_id", "text")
    chunks = lines.select("doc_id", F.col("ordinal").alias("chunk_ordinal"), "start_offset", "end_offset", F.sha2("excerpt", 256).alias("text_hash"))
    root = shared_folder(spark)
    number = I.commit(chunks, root, 0)
    I.commit(chunks.where("doc_id % 2 = 0"), root, number)
    langs = [r.lang for r in docs.select("lang").where("lang is not null").distinct().orderBy("lang").collect()]
    asks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request"), F.element_at(F.array(*[F.lit(x) for x in langs]), (F.col("item_id") % len(langs) + 1).cast("int")).alias("lang"), "text")
    hits, _ = I.search(spark, root, docs, asks, "lang", "doc_id", 10, version=number)
    return hits.select("request", "rank", "doc_id", "chunk_ordinal", F.col("score").cast("double").alias("score"))
