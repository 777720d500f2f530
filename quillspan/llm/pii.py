"""Personal data by regular expressions, checksum validators and nearby context words; DataFrame functions only.

A pattern proposes spans, left to right without overlap within its kind.
Validators confirm them: part values for addresses, Luhn for cards, digit
counts for phones, mod-97 for bank accounts.  Words near a span raise its
score.  Positions come from the lengths of what lies between matches, so no
Python runs; they are added up in blocks, so that a text with very many matches
takes time linear in them.  Patterns use possessive quantifiers and anchored starts, which
match the same spans as the plain forms but in time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "A-Za-z0-9._%+-"
#: Kinds in the order that breaks ties of position; the first four are the base kinds.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: A text without the hint holds no span of the kind.
HINTS = {"email": "@", "phone": "+"}
RLIKE_HINTS = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}
#: Words that, within CONTEXT_CHARS before a span, raise its score.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto",
}
CONTEXT_CHARS = 40
#: Scores of a confirmed span without and with a context word.
SCORE, NEAR = 0.7, 0.95
#: Matches whose positions are added up in one array.
BLOCK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digit string passes Luhn's check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _mod97(match: Column) -> Column:
    """Whether a bank account number passes ISO 7064 mod 97-10."""
    plain = F.regexp_replace(match, "\\x20", "")
    moved = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c))) == 1)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) < 4) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(14, 19) & _luhn(F.substring(digits, 1, 19))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return _mod97(match)
    return F.lit(True)


def _hinted(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike(RLIKE_HINTS[kind])


def _found(kind: str, rank: int, text: Column, matches: Column) -> Column:
    """Confirmed spans of a kind as structs (start, rank, kind, end, score), code points, end exclusive."""
    between = F.split(text, PATTERNS[kind], -1)
    spans = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"

    def tail(before: Column, pair: Column) -> Column:
        """What stands before the next match, as far as its context goes."""
        return F.right(F.concat(F.right(before, F.lit(CONTEXT_CHARS)), F.right(pair["gap"], F.lit(CONTEXT_CHARS)), F.right(pair["match"], F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        before = F.right(F.concat(acc["tail"], F.right(pair["gap"], F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))
        score = F.when(before.rlike(rf"(?i)\b(?:{CONTEXT[kind]})"), F.lit(NEAR)).otherwise(F.lit(SCORE))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), score.alias("score"))
        out = F.when(_valid(kind, pair["match"]), F.concat(acc["out"], F.array(span).cast(spans))).otherwise(acc["out"])
        return F.struct(end.alias("at"), tail(acc["tail"], pair).alias("tail"), out.alias("out"))

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"))
    # Blocks of pairs; where each begins and what stands before it; then the spans of each.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")), lambda i: F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)))

    def advance(acc: Column, block: Column) -> Column:
        size = F.aggregate(block, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["match"]))
        begin = F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), block.alias("block"))
        return F.struct((acc["at"] + size).alias("at"), F.aggregate(block, acc["tail"], tail).alias("tail"), F.concat(acc["out"], F.array(begin)).alias("out"))

    none = F.expr("cast(array() as array<struct<at:int,tail:string,block:array<struct<gap:string,match:string>>>>)")
    begun = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out")), advance, lambda acc: acc["out"])
    empty = F.expr(f"cast(array() as {spans})")
    found = F.transform(begun, lambda b: F.aggregate(b["block"], F.struct(b["at"].alias("at"), b["tail"].alias("tail"), empty.alias("out")), step, lambda acc: acc["out"]))
    return F.when(F.size(matches) > 0, F.flatten(found)).otherwise(empty)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, its text and ``found``, an array of (start, rank, kind, end, score) by start, then kind.

    A null text counts as empty; no row is dropped, repeated rows are judged
    each, a null ``doc_id`` stays null.  Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.expr("cast(array() as array<string>)")
    matched = texts.select(
        "doc_id",
        "text",
        *[F.when(_hinted(k, F.col("text")), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(k) for k, p in PATTERNS.items()],
    )
    spans = matched.select("doc_id", "text", *[_found(k, i, F.col("text"), F.col(k)).alias(k) for i, k in enumerate(PATTERNS)])
    return spans.select("doc_id", "text", F.array_sort(F.concat(*PATTERNS)).alias("found"))


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, all spans and their scores, one row a document."""
    found = find_pii(docs).select("doc_id", "found")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    scores = F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with each confirmed span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    found = find_pii(docs)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        add = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], add).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return found.select("doc_id", F.aggregate("found", start, step, rest).alias("text"))
