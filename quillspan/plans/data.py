"""Queries of the storage, evidence, office-file and streaming operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quillspan.functions import statements as ST
from quillspan.operators import gates as G
from quillspan.operators import index as I
from quillspan.operators import spans as S
from quillspan.operators import store as K
from quillspan.plans.register import registry
from quillspan.session import table
from quillspan.sources import office as O
from quillspan.streaming import sync
from quillspan.tables import shared_folder

QUERIES, SQL, query = registry()

_MARKER = "^\\s*([-•*]|\\(?([0-9]{1,2}|[a-z])[.)])\\s+"
#: Lines and blocks of the texts in ``t`` (doc_id, text), by windows over lines; ``doc_id`` names a text.
BLOCKS = f"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
l1 AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS s, regexp_matches(line, '{_MARKER}') AS item, regexp_matches(line, '^\\s*\\p{{Ll}}') AS small FROM l0),
l2 AS (SELECT *, sum(CASE WHEN i = 1 OR item OR NOT small THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM l1),
b AS (SELECT doc_id, block, min(s) AS s, max(s + length(line)) AS e, arg_min(item, i) AS item, count(*) AS lines, arg_min(length(regexp_extract(line, '{_MARKER}')), i) AS marker, bool_or(i = 1 AND small AND NOT item) AS unopened FROM l2 GROUP BY doc_id, block)"""
SENTENCES = f"""WITH t AS (SELECT doc_id, text FROM documents), {BLOCKS}, x AS (SELECT b.*, substr(text, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)) AS part FROM b JOIN t USING (doc_id)),
c AS (SELECT doc_id, block, s, part, unnest(list_concat([0], list_filter(range(CAST(marker AS BIGINT) + 1, length(part) + 1), lambda p: substr(part, p, 1) IN ('.', '!', '?') AND (p = length(part) OR regexp_matches(substr(part, p + 1, 1), '\\s'))))) AS a FROM x),
d AS (SELECT *, lead(a, 1, length(part)) OVER (PARTITION BY doc_id, block ORDER BY a) AS z FROM c),
f AS (SELECT doc_id, s + a + length(regexp_extract(substr(part, a + 1, z - a), '^\\s*')) AS s, s + z - length(regexp_extract(substr(part, a + 1, z - a), '\\s*$')) AS e FROM d)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS number, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM f WHERE s < e"""


@query("SELECT DISTINCT 'sha256:' || sha256(text) AS address, CAST(strlen(text) AS INTEGER) AS size FROM documents WHERE text IS NOT NULL")
def content_store(spark, sf_dir):
    return K.content_store(table(spark, sf_dir, "documents"), "text").select("address", "size")


@query("SELECT count(DISTINCT sha256(text)) AS objects, count(DISTINCT CASE WHEN doc_id % 3 = 0 THEN sha256(text) END) AS corrupt, CAST(2 AS BIGINT) AS version FROM documents")
def stored_version_verification(spark, sf_dir):
    """The store in two versions, of which the second has some contents altered: the last one is read back and re-hashed."""
    root = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    store = K.content_store(docs, "text")
    first = I.commit(store, root, 0)
    marked = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("address")).distinct().withColumn("_bad", F.lit(True))
    altered = I.pinned(spark, root, first).join(marked, "address", "left").withColumn("content", F.when(F.col("_bad"), F.concat("content", F.lit("!"))).otherwise(F.col("content"))).drop("_bad")
    second = I.commit(altered, root, first)
    stored = I.pinned(spark, root)
    return stored.agg(F.count("*").alias("objects")).join(K.corrupt_objects(stored).agg(F.count("*").alias("corrupt")), F.lit(True)).withColumn("version", F.lit(second).cast("long"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS e FROM documents), l AS (SELECT doc_id, count(*) AS n FROM p WHERE regexp_matches(e, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'none' WHEN doc_id % 5 = 0 OR (doc_id % 3 = 0 AND n > 1) THEN 'mismatch' ELSE 'exact' END AS state FROM l""")
def chunk_states(spark, sf_dir):
    """Line spans as expected chunks against a stored set in which some are missing, altered or cut short."""
    expected = S.line_spans(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "ordinal", F.sha2("excerpt", 256).alias("content"))
    altered = F.when(F.col("doc_id") % 5 == 0, F.lit("other")).otherwise(F.col("content"))
    stored = expected.where("doc_id % 7 <> 0 and not (doc_id % 3 = 0 and ordinal = 1)").withColumn("content", altered)
    return K.chunk_state(expected, stored, "doc_id", "ordinal", "content")


@query("""WITH i AS (SELECT l_partkey, count(*) - 1 AS deduplicated FROM lineitem GROUP BY l_partkey)
SELECT i.l_partkey, CASE WHEN c.p IS NULL THEN 'created' ELSE 'reused' END AS source, deduplicated FROM i LEFT JOIN (SELECT DISTINCT p_partkey AS p FROM part WHERE p_size > 25) c ON c.p = i.l_partkey""")
def vector_cache(spark, sf_dir):
    cache = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return K.resolve_vectors(table(spark, sf_dir, "lineitem"), cache, "l_partkey")


@query("""SELECT o_orderkey, sha256(to_json([CAST(o_custkey AS VARCHAR), o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END])) AS fingerprint FROM orders""")
def fingerprints(spark, sf_dir):
    maybe = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", K.fingerprint(F.col("o_custkey"), F.col("o_orderstatus"), maybe).alias("fingerprint"))


@query("""WITH p AS (SELECT doc_id, text, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'zz' || substr(text, 1 + doc_id % 50, 40) ELSE substr(text, 1 + doc_id % 50, 40) END AS q FROM documents)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'unknown_unit' WHEN coalesce(q, '') = '' OR regexp_matches(q, '^\\s*$') THEN 'empty_quote' WHEN NOT contains(text, q) THEN 'quote_not_found' WHEN doc_id % 3 = 0 THEN 'value_unsupported' END AS reason FROM p""")
def evidence_gate(spark, sf_dir):
    """Proposals with quotes from their documents, some altered, empty, of an unknown unit or with a value that is not supported."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = F.substring(F.col("text"), (F.col("doc_id") % 50 + 1).cast("int"), F.lit(40))
    quote = F.when(F.col("doc_id") % 13 == 0, None).when(F.col("doc_id") % 5 == 0, F.concat(F.lit("zz"), cut)).otherwise(cut)
    proposals = docs.select("doc_id", quote.alias("quote"), (F.col("doc_id") % 3 != 0).alias("fine"))
    return G.gate(proposals, docs.where("doc_id % 11 <> 0"), "doc_id", F.col("fine")).select("doc_id", "reason")


@query(r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(substr(text, 1, 12), '\S+') AS parts FROM documents),
k AS (SELECT doc_id, text, parts, array_to_string(list_transform(parts, lambda p: regexp_replace(p, '([^\p{L}\p{N}])', '\\\1', 'g')), '\s+') AS pattern FROM t),
g AS (SELECT doc_id, pattern, substr(parts[1], 1, 1) AS c, string_split(text, substr(parts[1], 1, 1)) AS g FROM k WHERE len(parts) > 0),
p AS (SELECT doc_id, any_value(g) AS g, count(*) AS n, min(i) AS i FROM (SELECT doc_id, g, unnest(list_filter(range(2, len(g) + 1), lambda i: regexp_matches(c || list_reduce(list_slice(g, i, i + 12), lambda a, b: a || c || b), '^' || pattern))) AS i FROM g) GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS places, CAST(list_sum(list_transform(g[1:i - 1], lambda x: length(x))) + i - 2 AS INTEGER) AS first FROM t LEFT JOIN p USING (doc_id)""")
def quote_locations(spark, sf_dir):
    """Every place of each document's first twelve characters in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", ST.quotes("text", F.substring("text", 1, 12)).alias("q"))
    return found.select("doc_id", F.size("q").alias("places"), F.get("q", F.lit(0))["start"].alias("first"))


@query(SENTENCES)
def sentence_bounds(spark, sf_dir):
    """Sentences of every document, by offsets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(ST.sentences("text")).alias("number", "s")).select("doc_id", "number", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query("""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal, sha256(text) AS text_hash FROM t WHERE text <> ''""")
def office_round_trip(spark, sf_dir):
    """Conversations written as word-processing files and parsed back, block by block."""

    @F.pandas_udf("binary")
    def render(turns: pd.Series) -> pd.Series:
        return pd.Series([O.make_docx([("Heading1" if t["role"] == "system" else "", t["text"] or "") for t in ts]) for ts in turns])

    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    files = turns.select(F.concat(F.col("conv_id").cast("string"), F.lit(".docx")).alias("path"), render("t").alias("content"))
    blocks = O.parse_files(files).where("error is null")
    return blocks.select(F.regexp_replace("name", "\\.docx$", "").cast("long").alias("conv_id"), "ordinal", F.sha2("text", 256).alias("text_hash"))


@query("""
WITH k AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version_number
FROM k WHERE n = 1 OR event_type IS DISTINCT FROM b""")
def stream_versions(spark, sf_dir):
    """The events read as a file stream and merged batch by batch; the same versions as the batch query's."""
    schema = table(spark, sf_dir, "events").schema
    # A pattern, which matches a file as well as a folder of part files.
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/[e]vents.parquet")
    root = shared_folder(spark)
    running = sync.sync_stream(arrivals.select("user_id", "event_id", "event_type", "ts"), f"{root}/versions", f"{root}/progress", "user_id", ["ts", "event_id"], "event_type")
    running.awaitTermination()
    return sync.published_versions(spark, f"{root}/versions").select("user_id", "event_id", "event_type", "version_number")
