"""Gates of proposed requirements, obligations and deadlines: what a source's own words and structure bear out.

Proposals, evidence and spans are tables; a claim is judged by joins on the unit
it was proposed for.  Only what a text's lines and sentences say runs in Arrow
batches.  A gate returns every judged claim: refused ones with ``refused``,
others with ``review``, the reasons why a reader must look at them, in order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions import dates as D
from quillspan.functions import statements as S
from quillspan.functions import text as X
from quillspan.functions.batched import per_distinct
from quillspan.tables import settled

#: Characters of a requirement's text at most.
LONGEST = 2000
# Words one of which a category of obligation must have in its evidence.
CATEGORY_WORDS = {
    "supervisor_review": r"(?i)\b(?:supervisors?|tutors?|advisers?|advisors?)\b",
    "approval": r"(?i)\bapprov\w*\b",
    "ethics_admin_form": r"(?i)\b(?:ethic\w*|forms?|consent|registration|register\w*)\b",
    "formative_prerequisite": r"(?i)\b(?:before|prior\s+to|until|first|formative|draft)\b",
    "submission_prerequisite": r"(?i)\b(?:submit\w*|submission)\b",
}
# The order in which an obligation's reasons are told.
REASONS = (
    "category_unsupported permissive_wording mixed_modality assessment_link_unsupported missing_timezone unrecognised_timezone conflicting_timezone "
    "weekday_mismatch ambiguous_time ambiguous_local_time non_unique_quote_location"
).split()
# Wording of dates that are no deadlines, and of those that are.
NO_DEADLINE = r"(?i)\b(?:releas\w*|publish\w*|publication|issued|available|opens|opened|opening|feedback|returned)\b"
DEADLINE = r"(?i)\b(?:deadlines?|due|submit\w*|submission|hand(?:ed)?\s+in|no\s+later\s+than|closes|closing)\b"

_NONE = "cast(array() as array<string>)"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def _slice(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def headings(spans: DataFrame) -> DataFrame:
    """Spans (unit, span, ordinal, locator, excerpt) with ``heading``, the text of the one that heads their section, and ``heading_span``.

    A heading is the first span of a unit with the same locator whose text is
    the locator's last part; it heads those behind it.  Pages and slides have none.
    """
    last = F.element_at(F.split("locator", " > "), -1)
    own = F.when(_stripped(F.col("excerpt")) == last, F.struct("ordinal", "span", "excerpt"))
    first = F.min(own).over(Window.partitionBy("unit", "locator"))
    flat = ~F.contains("locator", F.lit(" > ")) & F.split("locator", " ")[0].isin("page", "slide")
    fits = ~flat & (F.col("_h.ordinal") < F.col("ordinal"))
    found = spans.withColumn("_h", first)
    return found.withColumn("heading", F.when(fits, _stripped(F.col("_h.excerpt")))).withColumn("heading_span", F.when(fits, F.col("_h.span"))).drop("_h")


def located(refs: DataFrame, spans: DataFrame, span: str = "span", quote: str = "quote") -> DataFrame:
    """References (unit, span, quote, ...) with their span's columns, every place of the quote, its text there, and why it is refused.

    span_unknown, quote_not_found, or quote_overlaps_injection where any place
    touches wording that addresses a model.  White space may differ.
    """
    own = spans.select(F.col("unit"), F.col("span").alias(span), *[c for c in spans.columns if c not in ("unit", "span")])
    joined = refs.join(own, ["unit", span], "left")
    placed = joined.withColumns({"places": S.quotes_once("excerpt", quote), "_i": S.injections_once("excerpt")})
    injected = F.exists("places", lambda p: F.exists("_i", lambda i: (p["start"] < i["end"]) & (i["start"] < p["end"])))
    refused = F.when(F.col("excerpt").isNull(), "span_unknown").when(F.size("places") == 0, "quote_not_found").when(injected, "quote_overlaps_injection")
    first = F.get("places", F.lit(0))
    return placed.withColumn("refused", refused).withColumn("said", _slice(F.col("excerpt"), first["start"], first["end"])).drop("_i")


_UNIT = T.StructType(
    [
        *(T.StructField(c, T.IntegerType()) for c in ("place", "a", "b", "start", "end", "lead_start", "lead_end")),
        T.StructField("text", T.StringType()),
        T.StructField("lead", T.StringType()),
    ]
)


@F.pandas_udf(T.ArrayType(_UNIT))
def source_units(excerpt: pd.Series, headed: pd.Series, places: pd.Series) -> pd.Series:
    """What a quote is evidence for, at each of its places: the list items it touches, else the paragraph under a heading, else the sentence it begins in.

    Each with its bounds a to b, the part of the quote inside, its bare text,
    and the line that introduces it as a list item.
    """

    def units(text: str, under: bool, spots) -> list[dict]:
        out = []
        for n, spot in enumerate(spots if text is not None and spots is not None else ()):
            start, end = spot["start"], spot["end"]
            own = S.items_touched(text, start, end)
            whole = own or [S._trimmed(text, 0, len(text)) if under else S.sentence_at(text, start)]
            for a, b in whole:
                inside = (max(start, a), min(end, b)) if own else (start, end if under else min(end, b))
                if inside[0] < inside[1]:
                    lead = S.lead_in(text, a)
                    bounds = lead or (None, None)
                    out.append(dict(zip(_UNIT.names, (n, a, b, *inside, *bounds, S.bare(text[a:b]), lead and text[lead[0] : lead[1]]))))
        return out

    return pd.Series([units(t, bool(h), p) for t, h, p in zip(excerpt, headed, places)])


def _required(text: Column) -> Column:
    return F.coalesce(text.rlike(X.WORDING["mandatory"]) | text.rlike(X.WORDING["recommended"]), F.lit(False))


def _names(key: Column, text: Column) -> Column:
    """Whether a text has all words of a key, which is not empty."""
    return (F.length(key) > 0) & (F.size(F.array_except(F.split(key, " "), X.words(text))) == 0)


def requirement_gate(proposals: DataFrame, spans: DataFrame, assessments: DataFrame) -> DataFrame:
    """Requirements that proposals give, one a statement of the source: (proposal, key, text, span, places, lead_in, lead_from, refused, review).

    ``proposals``: proposal, unit, assessment, span, quote, lead_span,
    lead_quote (may be null); ``spans`` as for ``headings``; ``assessments``:
    unit, assessment, canonical_key, evidenced.  A quote over several list items
    gives a requirement each.  What says that it is required is the statement
    itself, else the line or heading that the source puts above it, else, to be
    reviewed, the proposed one.  Refused: assessment_unknown, a reason of
    ``located``, no_requirement_language, statement_too_long.
    """
    known = settled(headings(spans))
    proposed = proposals.join(assessments.withColumn("_known", F.lit(True)), ["unit", "assessment"], "left")
    placed = located(proposed, known).withColumn("refused", F.when(F.col("_known").isNull(), "assessment_unknown").otherwise(F.col("refused")))
    placed = settled(placed.select("proposal", "span", "excerpt", "heading", "places", "canonical_key", "evidenced", "refused"))
    leads = proposals.where("lead_quote is not null").select("proposal", "unit", F.col("lead_span").alias("span"), F.col("lead_quote").alias("quote"))
    leads = located(leads, known).where("refused is null").select("proposal", F.col("said").alias("proposed_lead"))
    fine = placed.where("refused is null").withColumn("_u", F.explode(source_units("excerpt", F.col("heading").isNotNull(), "places")))
    keyed = fine.withColumn("key", X.statement_key(F.col("_u.text")))
    first = F.struct(
        F.col("_u.place"), F.col("_u.a"), F.col("_u.start"), F.col("_u.end"), F.col("_u.text").alias("text"), F.col("_u.lead").alias("lead"), _slice(F.col("excerpt"), F.col("_u.start"), F.col("_u.end")).alias("supporting"),
        "heading", "canonical_key", "evidenced", "span", F.size("places").alias("n"),
    )
    per = keyed.groupBy("proposal", "key").agg(F.min(first).alias("f"), F.array_sort(F.collect_set(F.struct(F.col("_u.start").alias("start"), F.col("_u.end").alias("end")))).alias("places"))
    per = per.join(leads, "proposal", "left")
    f = F.col("f")
    derived = F.coalesce(f["lead"], f["heading"])
    source = F.when(_required(f["supporting"]), "own").when(_required(derived), F.when(f["lead"].isNotNull(), "line").otherwise("heading")).when(_required(F.col("proposed_lead")), "proposed")
    per = per.withColumn("lead_from", source)
    lead = F.when(F.col("lead_from").isin("line", "heading"), derived).when(F.col("lead_from") == "proposed", F.col("proposed_lead"))
    linked = f["evidenced"] | _names(f["canonical_key"], f["supporting"]) | F.coalesce(_names(f["canonical_key"], lead), F.lit(False))
    review = F.array_compact(
        F.array(
            F.when(f["n"] > 1, F.lit("non_unique_quote_location")),
            F.when(F.col("lead_from") == "proposed", F.lit("no_requirement_language")),
            F.when(~linked, F.lit("assessment_link_unsupported")),
        )
    )
    refused = F.when(F.col("lead_from").isNull(), "no_requirement_language").when(F.length(f["text"]) > LONGEST, "statement_too_long")
    judged = per.select("proposal", "key", f["text"].alias("text"), f["span"].alias("span"), "places", lead.alias("lead_in"), "lead_from", refused.alias("refused"), F.when(refused.isNull(), review).otherwise(F.expr(_NONE)).alias("review"))
    gone = placed.where("refused is not null").select("proposal", "refused", F.expr(_NONE).alias("review"))
    return judged.unionByName(gone, allowMissingColumns=True)


def deadline_role(quote: Column, key: Column, found: Column) -> Column:
    """Why a quote's date is no deadline, or null: wording of another role (non_deadline_date) or brackets around it; without a deadline's wording (no_deadline_semantics) only after "<title>:".

    ``found``: the quote's dates by ``dates.date_spans``.
    """
    colon = F.instr(quote, ":")
    bracketed = F.exists(found, lambda d: F.rtrim(F.substring(quote, F.lit(1), d["start"])).endswith("(") & F.ltrim(F.substring(quote, d["end"] + 1, F.length(quote))).startswith(")"))
    behind = F.filter(found, lambda d: d["start"] >= colon)
    at_once = F.trim(F.substring(quote, colon + 1, F.get(behind, F.lit(0))["start"] - colon)) == ""
    labelled = (colon > 0) & _names(key, F.substring(quote, F.lit(1), colon - 1)) & (F.size(behind) > 0) & F.coalesce(at_once, F.lit(False))
    return F.when(quote.rlike(NO_DEADLINE) | bracketed, "non_deadline_date").when(~quote.rlike(DEADLINE) & ~labelled, "no_deadline_semantics")


def checked_deadlines(claims: DataFrame, default_zone: str | None) -> DataFrame:
    """Claims (quote, key, claimed_date, claimed_time, ...) with ``value``, the deadline that the quote states, and ``refused``.

    The value is the quote's, a time that the claim leaves out too.  Refused, in
    this order: what the quote does not state clearly, its role, a local time
    that does not exist, model_date_invalid, model_date_mismatch,
    model_time_invalid, model_time_mismatch.
    """
    read = claims.withColumns({"_d": D.deadline("quote"), "_s": D.date_spans("quote")})
    read = read.withColumn("value", D.settled(F.col("_d"), default_zone))
    day = F.try_to_timestamp(F.col("claimed_date"), F.lit("yyyy-MM-dd")).cast("date")
    hour = F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), "claimed_time"), F.lit("yyyy-MM-dd HH:mm"))
    refused = F.coalesce(
        F.col("_d.reason"),
        deadline_role(F.col("quote"), F.col("key"), F.col("_s")),
        F.col("value.reason"),
        F.when(day.isNull(), "model_date_invalid").when(day != F.col("value.date"), "model_date_mismatch"),
        F.when(F.col("claimed_time").isNotNull(), F.when(hour.isNull(), "model_time_invalid").when(~F.date_format(hour, "HH:mm").eqNullSafe(F.col("value.time")), "model_time_mismatch")),
    )
    return read.withColumn("refused", refused).drop("_d", "_s")


def _sentence(text: str | None, at: int) -> dict:
    """The bare sentence at ``at``, and whether it says what a piece of work must contain."""
    if text is None:
        return {"said": None, "content": False}
    a, b = S.sentence_at(text, at)
    return {"said": S.bare(text[a:b]), "content": S.artefact_content(text, at)}


_anchored = per_distinct(_sentence, T.StructType([T.StructField("said", T.StringType()), T.StructField("content", T.BooleanType())]), once=True)


def obligation_gate(proposals: DataFrame, evidence: DataFrame, spans: DataFrame, assessments: DataFrame, default_zone: str | None) -> DataFrame:
    """Obligations, one a proposal: (proposal, key, modality, linked, due, anchor_span, anchor, refused, review).

    ``proposals``: proposal, unit, category, assessment, due_status, due_date,
    due_time, due_span, due_quote; ``evidence``: proposal, unit, span, quote.
    Quotes that ``located`` refuses drop out.  The modality is that of all
    quotes together; ``anchor`` is the first modal word of the earliest quote
    that has one, and the sentence around it is the obligation's identity.
    Refused: no_evidence, no_obligation_wording, wrong_claim_type (what a piece
    of work must contain).  ``review`` is in the order of REASONS.
    """
    known = settled(headings(spans))
    good = located(evidence, known).where("refused is null").withColumn("_w", X.wording(F.col("said")))
    named = good.join(proposals.select("proposal", "unit", "assessment"), ["proposal", "unit"]).join(assessments.withColumn("_known", F.lit(True)), ["unit", "assessment"], "left")
    worded = F.col("_w.first").isNotNull()
    place = F.get("places", F.lit(0))
    anchor = F.min(F.when(worded, F.struct("ordinal", place["start"].alias("start"), place["end"].alias("end"), F.col("_w.first").alias("first"), "span", "excerpt", "heading")))
    per = named.groupBy("proposal").agg(
        *[F.bool_or(F.col("_w")[k]).alias(k) for k in ("mandatory", "recommended", "permissive")],
        F.bool_or(F.size("places") > 1).alias("repeated"),
        F.bool_or(_names(F.col("canonical_key"), F.col("said"))).alias("named"),
        F.bool_or("evidenced").alias("evidenced"),
        F.bool_or("_known").alias("known"),
        *[F.bool_or(F.col("said").rlike(pattern)).alias(f"_{c}") for c, pattern in CATEGORY_WORDS.items()],
        anchor.alias("_a"),
        F.max("canonical_key").alias("canonical_key"),
    )
    at = F.col("_a.start") + F.coalesce("_a.first", F.lit(0))
    per = per.withColumn("anchor", at).withColumn("_own", _anchored("_a.excerpt", F.coalesce("anchor", F.lit(0))))
    per = per.withColumn("key", X.statement_key(F.col("_own.said")))
    content = F.coalesce(F.col("_own.content"), F.lit(False)) | F.coalesce(F.col("_a.heading").rlike(f"(?i){S.ARTEFACT.pattern}"), F.lit(False))
    joined = proposals.join(per, "proposal", "left")
    kinds = sum(F.coalesce(F.col(k), F.lit(False)).cast("int") for k in ("mandatory", "recommended", "permissive"))
    refused = F.when(F.col("repeated").isNull(), "no_evidence").when(kinds == 0, "no_obligation_wording").when(content, "wrong_claim_type")
    guarded = reduce(lambda rest, c: F.when(F.col("category") == c, F.col(f"_{c}")).otherwise(rest), CATEGORY_WORDS, F.lit(True))
    linked = F.col("assessment").isNotNull() & F.coalesce(F.col("known"), F.lit(False)) & F.coalesce(F.col("evidenced") | F.col("named"), F.lit(False))
    joined = joined.withColumns({"refused": refused, "linked": linked, "modality": F.when(kinds == 1, F.when(F.col("mandatory"), "mandatory").when(F.col("recommended"), "recommended"))})
    joined = settled(joined.withColumns({"_kinds": kinds, "_guarded": guarded}))
    due = joined.where("refused is null and due_status = 'stated'").select(
        "proposal", "unit", F.col("due_span").alias("span"), F.col("due_quote").alias("_q"), F.when(F.col("linked"), F.col("canonical_key")).otherwise("").alias("key"), F.col("due_date").alias("claimed_date"), F.col("due_time").alias("claimed_time")
    )
    due = located(due, known, quote="_q").where("refused is null").drop("refused").withColumn("quote", F.col("said"))
    # Written before the filter, which would else work every value out once more for each of its parts.
    due = settled(checked_deadlines(due, default_zone).select("proposal", F.col("value").alias("due"), (F.size("places") > 1).alias("_due_repeated"), "refused"))
    due = due.where("refused is null").drop("refused")
    joined = joined.join(due, "proposal", "left")
    of_due: Callable[[str], Column] = lambda r: F.get("due.review", F.lit(0)) == r
    holds = {
        "category_unsupported": ~F.col("_guarded"),
        "permissive_wording": (F.col("_kinds") == 1) & F.col("permissive"),
        "mixed_modality": F.col("_kinds") > 1,
        "assessment_link_unsupported": F.col("assessment").isNotNull() & ~F.col("linked"),
        "non_unique_quote_location": F.col("repeated") | (F.coalesce(F.size("due.review"), F.lit(0)) == 0) & F.col("_due_repeated"),
    }
    review = F.array_compact(F.array(*[F.when(holds[r] if r in holds else of_due(r), F.lit(r)) for r in REASONS]))
    return joined.select(
        "proposal", F.when(F.col("refused").isNull(), F.col("key")).alias("key"), "modality", "linked", "due", F.col("_a.span").alias("anchor_span"), "anchor", "refused", F.when(F.col("refused").isNull(), review).otherwise(F.expr(_NONE)).alias("review")
    )
