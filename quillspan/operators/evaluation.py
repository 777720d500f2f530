"""Evaluation: what a gate makes of a text without its injected wording, recall against labels, replayed answers, and golden labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions import statements as S
from quillspan.functions.batched import per_distinct
from quillspan.operators.intervals import overlap_join
from quillspan.tables import settled

_CUT = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("length", T.IntegerType())])
_LEFT = T.StructType([T.StructField("text", T.StringType()), T.StructField("cuts", T.ArrayType(_CUT))])
#: Characters of a bucket where labels and claims of a span meet.
WIDTH = 1024


def _left(text: str | None) -> dict:
    kept, cuts, end = [], [], 0
    for a, b in sorted(S.injected_spans(text)):
        if b > end:
            a = max(a, end)
            kept.append(text[end:a])
            cuts.append({"at": sum(map(len, kept)), "length": b - a})
            end = b
    return {"text": None, "cuts": []} if text is None else {"text": "".join([*kept, text[end:]]), "cuts": cuts}


#: The text without its injected spans, and where in what is left how many characters went.
without_injections = per_distinct(_left, _LEFT)


def restored(offset: Column, cuts: Column, end: bool) -> Column:
    """An offset into the text as it was; an end that touches a cut stays before it, a start goes behind it."""
    gone = F.filter(cuts, lambda c: c["at"] < offset if end else c["at"] <= offset)
    return F.aggregate(gone, offset.cast("long"), lambda n, c: n + c["length"])


def bare_units(units: DataFrame) -> DataFrame:
    """``units`` with ``_l``, their texts without injected spans; written once, for any number of gates."""
    return settled(units.withColumn("_l", without_injections("text")))


def injection_control(proposals: DataFrame, units: DataFrame, on: str, gate: Callable[[DataFrame, DataFrame], DataFrame], key: list[str], bare: DataFrame | None = None) -> DataFrame:
    """What a gate accepts only with (``side`` with) or only without the injected wording: (key, start, end, side). No row: unchanged.

    ``gate`` takes proposals and units (on, text) and returns ``key``, start, end
    and reason, null for accepted ones; it runs on both texts, and offsets into
    the shorter one are mapped back.  ``bare``: ``bare_units`` of the units, where several gates share them.
    """
    bare = bare_units(units) if bare is None else bare
    accepted = lambda rows: rows.where("reason is null").select(*key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    one = accepted(gate(proposals, bare.select(on, "text")))
    other = gate(proposals, bare.select(on, F.col("_l.text").alias("text"))).where("reason is null")
    other = other.join(bare.select(on, F.col("_l.cuts").alias("_cuts")), on)
    other = other.withColumns({"start": restored(F.col("start"), F.col("_cuts"), False), "end": restored(F.col("end"), F.col("_cuts"), True), "reason": F.lit(None).cast("string")})
    # Both differences are read off one count a row.
    each = one.withColumn("_n", F.lit(1)).union(accepted(other).withColumn("_n", F.lit(-1)))
    more = settled(each.groupBy(*key, "start", "end").agg(F.sum("_n").alias("_n")).where("_n <> 0"))
    side = F.when(F.col("_n") > 0, "with").otherwise("without")
    return more.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))).select(*key, "start", "end", side.alias("side"))


def label_matches(labels: DataFrame, claims: DataFrame) -> DataFrame:
    """(label, claim, overlap): each claim with the one label that it overlaps most, the least label of several.

    ``labels``: label, span, start, end; ``claims``: claim, span, start, end;
    both may have several places.
    """
    met = overlap_join(claims.select("span", "claim", "start", "end"), labels.select("span", "label", "start", "end"), ["span"], WIDTH)
    sums = met.groupBy(F.col("a_claim").alias("claim"), F.col("b_label").alias("label")).agg(F.sum("overlap").alias("overlap"))
    best = Window.partitionBy("claim").orderBy(F.desc("overlap"), "label")
    return sums.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("label", "claim", "overlap")


def label_scores(labels: DataFrame, claims: DataFrame, right: Column) -> DataFrame:
    """One row a label: (label, kind, rows, matched, verified, guard_broken).

    ``labels`` also has kind and guard, what ``right`` reads; ``claims`` status.
    A label is matched by a claim of which ``right`` holds, verified by a
    verified one.  A guard is broken by any verified claim; it is not matched.
    """
    own = labels.dropDuplicates(["label"]).drop("span", "start", "end")
    met = label_matches(labels, claims).join(claims.dropDuplicates(["claim"]).drop("span", "start", "end"), "claim").join(own, "label")
    fit = F.coalesce(right, F.lit(False))
    per = met.groupBy("label").agg(F.count_if(fit).alias("rows"), F.bool_or(fit & (F.col("status") == "verified")).alias("verified"), F.bool_or(F.col("status") == "verified").alias("_any"))
    joined = own.join(per, "label", "left")
    no = F.lit(False)
    return joined.select(
        "label",
        "kind",
        F.when(F.col("guard"), F.lit(0).cast("long")).otherwise(F.coalesce("rows", F.lit(0).cast("long"))).alias("rows"),
        (~F.col("guard") & (F.coalesce("rows", F.lit(0)) > 0)).alias("matched"),
        (~F.col("guard") & F.coalesce("verified", no)).alias("verified"),
        (F.col("guard") & F.coalesce("_any", no)).alias("guard_broken"),
    )


def recall(scores: DataFrame) -> DataFrame:
    """Per kind of label: labelled, matched, verified, broken guards; a kind of guards has nothing to match."""
    return scores.groupBy("kind").agg(F.count("*").alias("labelled"), *[F.count_if(F.col(c)).alias(c) for c in ("matched", "verified", "guard_broken")])


def extras(labels: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims that overlap no label, for a reader to look at; labels need not be exhaustive."""
    return claims.join(label_matches(labels, claims).select("claim"), "claim", "left_anti").dropDuplicates(["claim"])


def material_key(message: Column) -> Column:
    """The hash of a message's material, which stands between its markers; the nonce of the markers does not count. Null without them."""
    inside = F.regexp_extract(message, r"(?s)<<<MATERIAL ([0-9a-f]+)>>>\n(.*)\n<<<END MATERIAL \1>>>", 2)
    return F.when(message.rlike(r"(?s)<<<MATERIAL ([0-9a-f]+)>>>\n.*\n<<<END MATERIAL \1>>>"), F.sha2(inside, 256))


def recorded_answers(calls: DataFrame) -> DataFrame:
    """(key, output) of recorded calls (message, output, place): of calls with one material the last."""
    keyed = calls.select(material_key(F.col("message")).alias("key"), "output", "place").where("key is not null")
    return keyed.groupBy("key").agg(F.max_by("output", "place").alias("output"))


def missing_answers(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests whose material has no recorded answer."""
    keyed = requests.withColumn("key", material_key(F.col("message")))
    return keyed.join(answers.select("key"), "key", "left_anti")


def replayed(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests (message, ...) with the recorded output; the job fails where there is none, and asks nothing instead."""
    keyed = requests.withColumn("key", material_key(F.col("message"))).join(answers.withColumn("_known", F.lit(True)), "key", "left")
    told = F.concat(F.lit("no recorded answer for material "), F.coalesce(F.left("key", F.lit(12)), F.lit("(no markers)")))
    return keyed.withColumn("output", F.when(F.col("_known"), F.col("output")).otherwise(F.raise_error(told))).drop("_known")


#: Fields of each kind of golden label beside label_id, kind and course; those with a question mark may be left out.
LABEL_KINDS = {
    "assessment": ["assessment", "title", "quote", "resource"],
    "requirement": ["assessment", "quote", "resource"],
    "obligation": ["assessment?", "modality", "quote", "resource"],
    "deadline_claim": ["assessment", "due", "quote", "resource", "superseded_by?"],
    "not_a_deadline": ["quote", "resource"],
}
_FIELDS = ["label_id", "kind", "course", *sorted({f.rstrip("?") for fields in LABEL_KINDS.values() for f in fields})]


def parsed_labels(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Golden labels of JSON lines (line, value) under one schema, and their violations (line, label_id, problem).

    A label's kind says which fields it has.  Violations: unreadable,
    unknown_kind, missing:<field>, unknown:<field>, label_id_twice.  Labels with
    one are left out.
    """
    schema = ", ".join(f"{f} string" for f in _FIELDS)
    read = lines.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})).withColumn("_keys", F.json_object_keys("value"))
    rows = read.select("line", "r.*", F.coalesce("_keys", F.expr("cast(array() as array<string>)")).alias("_keys"))
    tests = [F.when(F.col("_bad").isNotNull() | F.col("label_id").isNull(), F.lit("unreadable")), F.when(F.col("_bad").isNull() & F.col("label_id").isNotNull() & ~F.coalesce(F.col("kind").isin(*LABEL_KINDS), F.lit(False)), F.lit("unknown_kind"))]
    for kind, fields in LABEL_KINDS.items():
        own = (F.col("kind") == kind) & F.col("_bad").isNull()
        tests += [F.when(own & F.col(f).isNull(), F.lit(f"missing:{f}")) for f in ["course", *fields] if not f.endswith("?")]
    known = allowed_fields()
    extra = F.transform(F.filter("_keys", lambda k: ~F.array_contains(F.coalesce(known, F.array(*[F.lit(f) for f in _FIELDS])), k)), lambda k: F.concat(F.lit("unknown:"), k))
    problems = F.concat(F.array_compact(F.array(*tests)), extra)
    judged = rows.withColumn("_p", problems).withColumn("_n", F.count("label_id").over(Window.partitionBy("label_id")))
    judged = judged.withColumn("_p", F.when(F.col("_n") > 1, F.concat("_p", F.array(F.lit("label_id_twice")))).otherwise(F.col("_p")))
    wrong = judged.select("line", "label_id", F.explode("_p").alias("problem"))
    return judged.where(F.size("_p") == 0).select("line", *_FIELDS), wrong


def allowed_fields() -> Column:
    """The field names that a row's kind allows; null for an unknown kind."""
    out = F.lit(None).cast("array<string>")
    for kind, fields in LABEL_KINDS.items():
        out = F.when(F.col("kind") == kind, F.array(*[F.lit(f) for f in ["label_id", "kind", "course", *[f.rstrip("?") for f in fields]]])).otherwise(out)
    return out


def resolved_labels(labels: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels with the one span and offset of their quote, and violations (line, label_id, problem).

    ``spans``: course, resource, span, text.  Violations: unknown_resource,
    quote_not_found, quote_not_unique (over all spans of the resource),
    unknown_assessment (no assessment label of the course has it), unknown_label
    (what supersedes it is none).
    """
    place = ["course", "resource"]
    there = spans.select(*place).distinct().withColumn("_there", F.lit(True))
    found = labels.join(spans, place).withColumn("_at", F.expr("locate(quote, text)")).where("_at > 0")
    twice = F.expr("locate(quote, text, cast(_at as int) + 1)") > 0
    per = found.groupBy("line").agg(F.sum(F.when(twice, 2).otherwise(1)).alias("_n"), F.min(F.struct("span", (F.col("_at") - 1).alias("start"))).alias("_s"))
    named = labels.where("kind = 'assessment'").select("course", "assessment").distinct().withColumn("_named", F.lit(True))
    ids = labels.select(F.col("label_id").alias("superseded_by")).distinct().withColumn("_known", F.lit(True))
    rows = labels.join(there, place, "left").join(per, "line", "left").join(named, ["course", "assessment"], "left").join(ids, "superseded_by", "left")
    tests = {
        "unknown_resource": F.col("_there").isNull(),
        "quote_not_found": F.col("_there").isNotNull() & F.col("_n").isNull(),
        "quote_not_unique": F.col("_n") > 1,
        "unknown_assessment": F.col("assessment").isNotNull() & F.col("_named").isNull(),
        "unknown_label": F.col("superseded_by").isNotNull() & F.col("_known").isNull(),
    }
    rows = rows.withColumn("_p", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()])))
    good = rows.where(F.size("_p") == 0).select(*labels.columns, F.col("_s.span").alias("span"), F.col("_s.start").alias("start"), (F.col("_s.start") + F.length("quote")).alias("end"))
    return good, rows.select("line", "label_id", F.explode("_p").alias("problem"))
