"""Queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillspan.llm import tables
from quillspan.llm.ann import nearest
from quillspan.llm.conversations import damage, repair_report
from quillspan.llm.decontaminate import contaminated
from quillspan.llm.exact_dedup import exact_dedup
from quillspan.llm.html_extract import extract_pages
from quillspan.llm.lexical import ranked_search
from quillspan.llm.line_dedup import line_dedup
from quillspan.llm.near_dedup import near_dedup
from quillspan.llm.packing import pack
from quillspan.llm.pii import CONTEXT, CONTEXT_CHARS, NEAR, SCORE, pii_report
from quillspan.llm.substring_dedup import substring_dedup
from quillspan.llm.toxicity import toxicity
from quillspan.llm.warc import page_records, read_warc, write_warc
from quillspan.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return line_dedup(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = tables.new_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path, compression="gzip")
    return page_records(read_warc(spark, path))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return repair_report(damage(table(spark, sf_dir, "conversations")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = [op1_line_dedup, op2_decontaminate, op3_warc, op4_substring_dedup, op5_toxicity, op6_html_extract, op7_pattern_packing, op8_pii, op9_hnsw, op10_minhash_near_dedup, op11_conversation_repair, op12_ranked_search, op13_exact_dedup]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_WORDS = r"coalesce(regexp_extract_all({t}, '[^\x20\x09-\x0D]+'), [])"

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS holder FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda g: list_sum(list_transform(range(1, 6), lambda k: (strpos('0123456789abcdef', substr(x, 5 * g + k, 1)) - 1) * CAST(power(16, 5 - k) AS BIGINT)))) AS groups FROM d)
SELECT page_id, payload_bytes,
array_to_string(list_transform(groups, lambda n: array_to_string(list_transform([32768, 1024, 32, 1], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST(n AS BIGINT) // s % 32 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> holder THEN holder END AS refers_to FROM v"""

_OP4 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(t='text')} AS ws FROM documents),
x AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i+19], ' ') ORDER BY doc_id, i) AS r FROM x),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM k WHERE r > 1),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
g AS (SELECT t.doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY t.p) FILTER (WHERE c.p IS NULL) AS kept FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.p = c.p GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON w.doc_id = g.doc_id"""

_OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 75 * (x.n + y.n - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, q.c AS component_id, q.c = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) q USING (doc_id)"""


_SPACE = r"[\x20\x09-\x0D]"

#: States: b begun, s, u, a after such a turn.  Inserts before a row, then the row's own edit; of a state's ways the least by (cost, audit) is kept.
_OP11 = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda k: CAST(ascii(substr(name, k, 1)) AS BIGINT))),
lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS kind FROM o),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS c FROM d),
f AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS b, CASE WHEN regexp_matches(text, '^{_SPACE}*$') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?]{_SPACE}*$') THEN 3 ELSE 0 END AS fault FROM p),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE b || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
ins(s, t, add, labels, said) AS (VALUES ('b', 'b', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''), ('b', 'u', 5, 'I', chr(10) || 'user:'), ('s', 'u', 5, 'I', chr(10) || 'user:'), ('a', 'u', 5, 'I', chr(10) || 'user:'), ('u', 'a', 5, 'I', chr(10) || 'assistant:'), ('b', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
e(s, c, t, label, cost) AS (SELECT s, '', s, 'D', 2 FROM (VALUES ('b'), ('s'), ('u'), ('a')) x(s) UNION ALL VALUES ('b', 's', 's', 'K', 0), ('b', 'u', 'u', 'K', 0), ('s', 'u', 'u', 'K', 0), ('a', 'u', 'u', 'K', 0), ('u', 'a', 'a', 'K', 0), ('b', '', 'u', 'R', 1), ('s', '', 'u', 'R', 1), ('a', '', 'u', 'R', 1), ('u', '', 'a', 'R', 1)),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 'b' AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS said FROM g
UNION ALL SELECT conv_id, i, t, w.cost, w.audit, w.said FROM (SELECT f.conv_id, f.i, e.t, min({{'cost': r.cost + add + e.cost + CASE WHEN fault = 3 AND e.label <> 'D' THEN 5 ELSE 0 END, 'audit': audit || labels || e.label,
'said': r.said || ins.said || CASE e.label WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE e.t WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text END}}) AS w
FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 JOIN ins ON ins.s = r.s JOIN e ON e.s = ins.t AND (e.label = 'D' OR fault IN (0, 3) AND (e.label = 'R' OR e.c = f.c)) GROUP BY f.conv_id, f.i, e.t)),
z AS (SELECT g.conv_id, min({{'cost': cost + add, 'audit': audit || labels, 'said': r.said || ins.said}}) AS w FROM g JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.n JOIN ins ON ins.s = r.s AND ins.t IN ('b', 'a') GROUP BY g.conv_id)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.cost, 0) AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(substr(w.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM k.conv_id"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP12 = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT doc_id, {_TERMS} AS terms FROM documents), k AS (SELECT doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM k),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM k) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
m AS (SELECT doc_id, 50 + ((50 * n * docs) // total) AS m FROM k, c),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""

_OP13 = r"""
WITH p AS (SELECT doc_id, length(coalesce(text, '')) AS c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY c DESC, doc_id) AS place FROM p)
SELECT r.doc_id, k.doc_id AS keep_id, n.n AS group_size, place = 1 AS kept, h AS text_sha256 FROM r JOIN (SELECT h, doc_id FROM r WHERE place = 1) k USING (h) JOIN (SELECT h, count(*) AS n FROM p GROUP BY h) n USING (h)"""

_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(x.t, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INTEGER) > 255)) = 0"),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])+",
        "length(regexp_replace(x.t, '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(regexp_replace(x.t, '[^0-9]', '', 'g')) + 1), lambda i: "
        "CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(regexp_replace(x.t, '[^0-9]', '', 'g')), i, 1) AS INTEGER) ELSE "
        "(CAST(substr(reverse(regexp_replace(x.t, '[^0-9]', '', 'g')), i, 1) AS INTEGER) * 2) // 10 + (CAST(substr(reverse(regexp_replace(x.t, '[^0-9]', '', 'g')), i, 1) AS INTEGER) * 2) % 10 END)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(x.t, '[^0-9]', '', 'g')) BETWEEN 10 AND 15"),
}


def _pii_sql() -> str:
    """Positions from the lengths of gaps and matches; added kinds are left out, as the given tables hold none of them."""
    parts = []
    for rank, (kind, (pattern, valid)) in enumerate(_PII.items()):
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, x.s AS s, x.s + length(x.t) AS e, text FROM (SELECT doc_id, text, unnest(list_transform(range(1, len(m) + 1), lambda i: "
            f"{{'s': list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0), 't': m[i]}})) AS x "
            f"FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM t)) WHERE {valid}"
        )
    context = " ".join(f"WHEN '{k}' THEN '{CONTEXT[k]}'" for k in _PII)
    counts = ", ".join(f"count(kind) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _PII)
    near = f"regexp_matches(substr(text, CAST(greatest(s - {CONTEXT_CHARS}, 0) + 1 AS BIGINT), CAST(s - greatest(s - {CONTEXT_CHARS}, 0) AS BIGINT)), '(?i)\\b(?:' || CASE kind {context} END || ')')"
    order = "ORDER BY s, rank"
    spans = f"coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' {order}), '')"
    return (
        f"WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS ({' UNION ALL '.join(parts)}) "
        f"SELECT t.doc_id, {counts}, sha256({spans}) AS base_sha256, {spans} AS spans, coalesce(string_agg(CASE WHEN {near.replace('text', 'a.text')} THEN '{NEAR}' ELSE '{SCORE}' END, ',' {order}) FILTER (WHERE kind IS NOT NULL), '') AS scores "
        "FROM t LEFT JOIN a ON t.doc_id = a.doc_id GROUP BY t.doc_id"
    )


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express and run over whole tables; the others are tested against brute force."""
    return {"op3_warc": _OP3, "op4_substring_dedup": _OP4, "op8_pii": _pii_sql(), "op10_minhash_near_dedup": _OP10, "op11_conversation_repair": _OP11, "op12_ranked_search": _OP12, "op13_exact_dedup": _OP13}
