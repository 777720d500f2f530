"""Validation of stored claims and their evidence, of all courses at once: twelve issue codes, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import statements as S
from quillspan.functions import text as X
from quillspan.tables import settled

# The codes, in order, and which only warn.
CODES = (
    "canonical_key_mismatch claim_without_evidence evidence_cross_course evidence_on_injection instant_mismatch lineage_inconsistent lineage_missing "
    "quote_blank quote_out_of_bounds stale_source_version value_without_evidence verified_without_verified_evidence"
).split()
WARNINGS = ("stale_source_version",)
ASSESSMENT, DEADLINE, REQUIREMENT, OBLIGATION = "assessment", "assessment_deadline", "assessment_requirement", "obligation"
#: The field of a link that states the claim itself; other kinds take any, an assessment is verified by a value instead.
PRIMARY = {ASSESSMENT: "title", OBLIGATION: "obligation"}
#: The field that must support a stored value.
VALUE = {ASSESSMENT: "weighting", OBLIGATION: "due_date"}


def _codes(tests: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in tests.items()]))


def joined_links(links: DataFrame, claims: DataFrame, spans: DataFrame, calls: DataFrame, runs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Links with their claim's course, their span's text, version and course, and whether their lineage fits."""
    own = claims.select("kind", "claim", F.col("course").alias("_claim_course"))
    sources = spans.select("span", "version", F.col("course").alias("_span_course"), "excerpt", "current")
    rows = links.join(own, ["kind", "claim"]).join(sources, "span", "left")
    rows = rows.join(calls.select("call", F.col("run").alias("_call_run")), "call", "left").join(runs.select("run", F.col("course").alias("_run_course")), "run", "left")
    return rows.join(inputs.select("run", "version").distinct().withColumn("_input", F.lit(True)), ["run", "version"], "left")


def link_issues(rows: DataFrame) -> DataFrame:
    """(kind, claim, link, code) of what is wrong with single links, in one pass over the joined rows."""
    quote = F.substring("excerpt", F.col("start") + 1, F.col("end") - F.col("start"))
    beyond = F.col("end") > F.length("excerpt")
    blank = ~beyond & ~quote.rlike("(?U)\\S")
    touched = F.exists("_i", lambda i: (i["start"] < F.col("end")) & (F.col("start") < i["end"]))
    missing = F.col("call").isNull() | F.col("run").isNull()
    fits = F.col("_call_run").eqNullSafe(F.col("run")) & F.col("_run_course").eqNullSafe(F.col("_claim_course")) & F.col("_input").isNotNull()
    tests = {
        "evidence_cross_course": ~F.col("_span_course").eqNullSafe(F.col("_claim_course")),
        "quote_out_of_bounds": beyond,
        "quote_blank": blank,
        "evidence_on_injection": ~beyond & ~blank & touched,
        "lineage_missing": missing,
        "lineage_inconsistent": ~missing & ~fits,
    }
    return rows.withColumn("_i", S.injections("excerpt")).select("kind", "claim", "link", F.explode(_codes(tests)).alias("code"))


def claim_issues(claims: DataFrame, rows: DataFrame, calls: DataFrame, runs: DataFrame) -> DataFrame:
    """(kind, claim, code) of what is wrong with claims, given the joined rows of all their links."""
    verified = F.col("status") == "verified"
    primary = F.lit(True)
    for kind, field in PRIMARY.items():
        primary = F.when(F.col("kind") == kind, F.col("field") == field).otherwise(primary)
    valued = F.lit(False)
    for kind, field in VALUE.items():
        valued = F.when(F.col("kind") == kind, F.col("field") == field).otherwise(valued)
    per = rows.groupBy("kind", "claim").agg(
        F.count_if(primary).alias("_primary"), F.count_if(primary & verified).alias("_supported"), F.count_if(valued & verified).alias("_valued"), F.count_if(F.coalesce("current", F.lit(False))).alias("_current"), F.count("*").alias("_links"), F.count_if(verified).alias("_verified")
    )
    every = claims.join(per, ["kind", "claim"], "left").na.fill(0, ["_primary", "_supported", "_valued", "_current", "_links", "_verified"])
    dated = every.where((F.col("kind") == DEADLINE) & (F.col("status") == "verified") & (F.col("_verified") > 0)).select(F.col("parent").alias("claim")).distinct().withColumns({"kind": F.lit(ASSESSMENT), "_dated": F.lit(True)})
    proposer = calls.join(runs, "run", "left").select("call", F.col("course").alias("_call_course"))
    every = every.join(dated, ["kind", "claim"], "left").join(proposer, "call", "left")
    kind = F.col("kind")
    supported = F.when(kind == ASSESSMENT, F.col("_dated").isNotNull() | (F.col("_valued") > 0)).otherwise(F.col("_supported") > 0)
    value = F.when(kind == ASSESSMENT, F.col("weighting").isNotNull()).when(kind == OBLIGATION, F.col("due_date").isNotNull()).otherwise(False)
    key = F.when(kind == ASSESSMENT, X.canonical_key(F.col("text"))).when(kind == REQUIREMENT, X.statement_key(F.col("text")))
    local = F.try_to_timestamp(F.concat(F.date_format("due_date", "yyyy-MM-dd"), F.lit(" "), "due_time"), F.lit("yyyy-MM-dd HH:mm"))
    instant = F.to_utc_timestamp(local, F.coalesce("zone", F.lit("UTC")))
    tests = {
        "claim_without_evidence": F.col("_primary") == 0,
        "verified_without_verified_evidence": verified & ~supported,
        "stale_source_version": verified & (F.col("_links") > 0) & (F.col("_current") == 0),
        "value_without_evidence": value & (F.col("_valued") == 0),
        "canonical_key_mismatch": key.isNotNull() & ~key.eqNullSafe(F.col("canonical_key")),
        "instant_mismatch": kind.isin(DEADLINE, OBLIGATION) & F.col("zone").isNotNull() & (F.col("due_at") != instant),
        "lineage_missing": (kind == OBLIGATION) & F.col("call").isNull(),
        "lineage_inconsistent": (kind == OBLIGATION) & F.col("call").isNotNull() & ~F.col("_call_course").eqNullSafe(F.col("course")),
    }
    return every.select("kind", "claim", F.explode(_codes(tests)).alias("code"))


def issues(claims: DataFrame, links: DataFrame, spans: DataFrame, calls: DataFrame, runs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Every issue as (code, severity, kind, claim, link): link issues name their link, claim issues none.

    ``claims``: kind, claim, course, status, parent (a deadline's assessment),
    text, canonical_key, weighting, due_date, due_time, zone, due_at, call (an
    obligation's proposer); ``links``: link, kind, claim, field, span, start,
    end, status, call, run; ``spans``: span, version, course, excerpt, current;
    ``calls``: call, run; ``runs``: run, course; ``inputs``: run, version.
    """
    # Joined once: issues of links and of claims both read the rows.
    rows = settled(joined_links(links, claims, spans, calls, runs, inputs))
    both = link_issues(rows).unionByName(claim_issues(claims, rows, calls, runs).withColumn("link", F.lit(None).cast(links.schema["link"].dataType)))
    return both.select("code", F.when(F.col("code").isin(*WARNINGS), "warning").otherwise("error").alias("severity"), "kind", "claim", "link")


def issue_counts(found: DataFrame) -> DataFrame:
    """How often each code occurs, all twelve with zeros, with its severity."""
    codes = found.sparkSession.createDataFrame([(c, "warning" if c in WARNINGS else "error") for c in CODES], "code string, severity string")
    return codes.join(found.groupBy("code").agg(F.count("*").alias("n")), "code", "left").select("code", "severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
