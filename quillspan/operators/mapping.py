"""Selections of candidates and their scores: gates, violations, containment, and what a declared state gets wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN, REPEATED = "candidate_unknown", "candidate_repeated"
VERIFIED, NEEDS_REVIEW = "verified", "needs_review"
CONFLICTING, NO_FACT = "conflicting_weighting", "no_verified_assessment_fact"


def selection_gate(chosen: DataFrame, issued: DataFrame, case: str, item: str, place: str, order: str) -> DataFrame:
    """Each chosen item with its issued order, or why it is rejected: never issued, or chosen at an earlier place.

    ``chosen``: (case, item, place); ``issued``: (case, item, order), an item
    once a case.  Those without a reason, by ``order``, are the selection.
    """
    again = F.row_number().over(Window.partitionBy(case, item).orderBy(place))
    rows = chosen.withColumn("_again", again).join(issued.select(case, item, order), [case, item], "left")
    reason = F.when(F.col(order).isNull(), UNKNOWN).when(F.col("_again") > 1, REPEATED)
    return rows.select(case, item, place, order, reason.alias("reason"))


def hit_violations(hits: DataFrame, scopes: DataFrame, versions: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Rows (case, rank, violation): hits of unknown versions, other scopes, versions not current or forbidden.

    ``hits``: (case, rank, version); ``scopes``: (case, scope); ``versions``:
    (version, own, current); ``forbidden``: (case, version), each once.  An
    unknown version has no other violation.
    """
    rows = hits.join(scopes, "case").join(versions, "version", "left")
    rows = rows.join(forbidden.withColumn("_f", F.lit(True)), ["case", "version"], "left")
    unknown = F.col("own").isNull()
    found = F.when(unknown, F.array(F.lit("unknown_version"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("own") != F.col("scope"), "other_scope"),
                F.when(~F.col("current"), "not_current"),
                F.when(F.col("_f"), "forbidden_version"),
            )
        )
    )
    return rows.select("case", "rank", F.explode(found).alias("violation"))


def forbidden_versions(items: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows (case, resource, version) that no hit may come from.

    ``items``: (case, resource, version, stale); without a version all of the
    resource's are meant.  A stale item never covers the latest version.
    """
    latest = versions.groupBy("resource").agg(F.max("version").alias("_latest"))
    named = items.where("version is not null")
    whole = items.where("version is null").drop("version").join(versions.select("resource", "version").distinct(), "resource")
    rows = named.unionByName(whole).join(latest, "resource", "left")
    fresh = F.col("stale") & F.coalesce(F.col("version") == F.col("_latest"), F.lit(False))
    return rows.where(~fresh).select("case", "resource", "version").distinct()


def contained_share(targets: DataFrame, chunks: DataFrame, owner: str, group: str) -> DataFrame:
    """Of each group's targets, how many lie wholly inside some chunk of their owner; both have start and end."""
    inside = chunks.select(F.col(owner).alias("_o"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    fits = (F.col(owner) == F.col("_o")) & (F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e"))
    held = targets.join(inside, fits, "left_semi").groupBy(group).agg(F.count("*").alias("_held"))
    every = targets.groupBy(group).agg(F.count("*").alias("targets"))
    return every.join(held, group, "left").select(group, "targets", F.coalesce("_held", F.lit(0)).alias("contained"))


def split_problems(split: DataFrame, labels: DataFrame, key: str, expected: str) -> DataFrame:
    """Rows (key, problem) of a split that does not name every label exactly once with the label's own expectation."""
    named = split.groupBy(key).agg(F.count("*").alias("_n"), F.min(expected).alias("_said"))
    both = named.join(labels.select(key, F.col(expected).alias("_own"), F.lit(True).alias("_label")), key, "full")
    problem = (
        F.when(F.col("_label").isNull(), "unknown")
        .when(F.col("_n").isNull(), "missing")
        .when(F.col("_n") > 1, "repeated")
        .when(~F.col("_said").eqNullSafe(F.col("_own")), "other_expectation")
    )
    return both.select(key, problem.alias("problem")).where("problem is not null")


def state_problems(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Every key whose count is not the expected one; what only one side has counts as none on the other."""
    both = expected.select(*keys, F.col("n").alias("expected")).join(actual.select(*keys, F.col("n").alias("actual")), keys, "full")
    return both.na.fill(0, ["expected", "actual"]).where("expected <> actual")


#: What a case counts as: of its rows the first whose condition holds for what the case expects (None: anything else, or always).
OUTCOMES = (
    ("materials", "no_target_offered", "retrieval_miss"),
    ("materials", "misjudged", "verifier_mistake"),
    ("materials", "others_taken", "ground_truth_ambiguity"),
    ("materials", None, "correct"),
    ("no_material", "any_taken", "verifier_mistake"),
    ("no_material", None, "correct"),
    (None, "irrelevant_taken", "verifier_mistake"),
    (None, None, "unlabelled_for_review"),
)


def mapping_scores(cases: DataFrame, candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Per case: whether a target was a candidate and was selected (null without targets), and its category by OUTCOMES.

    ``cases``: (case, expect); ``candidates``: (case, item, selected, bad);
    ``gold``: (case, item).
    """
    marked = candidates.join(gold.distinct().withColumn("_target", F.lit(True)), ["case", "item"], "left").withColumn("_target", F.col("_target").isNotNull())
    target, taken = F.col("_target"), F.coalesce("selected", F.lit(False))
    counted = {"offered": target, "targets_taken": target & taken, "others_taken": ~target & taken, "irrelevant_taken": F.coalesce("bad", F.lit(False)) & taken, "any_taken": taken}
    per = marked.groupBy("case").agg(*[F.count_if(test).alias(name) for name, test in counted.items()])
    every = cases.join(per, "case", "left").na.fill(0, list(counted)).join(gold.groupBy("case").agg(F.count("*").alias("_targets")), "case", "left")
    holds = {name: F.col(name) > 0 for name in ("others_taken", "irrelevant_taken", "any_taken")}
    holds |= {"no_target_offered": F.col("offered") == 0, "misjudged": (F.col("targets_taken") == 0) | (F.col("irrelevant_taken") > 0)}
    always = F.lit(True)
    rows = [F.when((F.col("expect") == expect if expect else always) & holds.get(test, always), F.lit(category)) for expect, test, category in OUTCOMES]
    known = F.col("_targets").isNotNull()
    return every.select("case", F.when(known, F.col("offered") > 0).alias("retrieval_hit"), F.when(known, F.col("targets_taken") > 0).alias("mapping_hit"), F.coalesce(*rows).alias("category"))


def integrity_violations(selected: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (case, span, problem): spans selected twice, absent, outside current teaching material, or quoted inexactly.

    ``selected``: (case, span, start, end, quote), offsets from 0, end
    exclusive; ``spans``: (span, text, fit), fit where the span is of a current
    version of the case's teaching material.
    """
    twice = F.count("*").over(Window.partitionBy("case", "span")) > 1
    rows = selected.withColumn("_twice", twice).join(spans, "span", "left")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    exact = inside & (F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote")) & F.col("quote").rlike("(?U)\\S")
    problem = (
        F.when(F.col("_twice"), "selected_twice")
        .when(F.col("fit").isNull(), "absent")
        .when(~F.col("fit"), "not_current_material")
        .when(~F.coalesce(exact, F.lit(False)), "inexact_range")
    )
    return rows.select("case", "span", problem.alias("problem")).where("problem is not null")


def superseded(processed: DataFrame, current: DataFrame, run: str, keys: list[str]) -> DataFrame:
    """How many versions of each run are no longer current; runs without one are left out."""
    return processed.join(current.select(keys), keys, "left_anti").groupBy(run).agg(F.count("*").alias("superseded"))


def assessment_status(assessments: DataFrame, deadlines: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verified with a verified deadline or weighting that verified evidence supports; else why it needs review.

    ``assessments``: (id, weighting); ``deadlines``: (id, deadline, status);
    ``evidence``: (id, deadline, field, status, reason), deadline null where the
    assessment itself is meant.
    """
    own = deadlines.where(F.col("status") == VERIFIED).select("id", "deadline")
    dated = evidence.where(F.col("status") == VERIFIED).join(own, ["id", "deadline"], "left_semi").select("id", F.lit("dated").alias("_fact"))
    weighed = evidence.where("deadline is null")
    facts = dated.union(weighed.where((F.col("field") == "weighting") & (F.col("status") == VERIFIED)).select("id", F.lit("weighed")))
    facts = facts.union(weighed.where(F.col("reason") == CONFLICTING).select("id", F.lit("conflict")))
    per = facts.groupBy("id").agg(*[F.bool_or(F.col("_fact") == f).alias(f"_{f}") for f in ("dated", "weighed", "conflict")])
    rows = assessments.join(per, "id", "left").na.fill(False, ["_dated", "_weighed", "_conflict"])
    verified = F.col("_dated") | (F.col("weighting").isNotNull() & F.col("_weighed"))
    reason = F.when(~verified, F.when(F.col("_conflict"), CONFLICTING).otherwise(NO_FACT))
    return rows.select("id", F.when(verified, VERIFIED).otherwise(NEEDS_REVIEW).alias("status"), reason.alias("reason"))


def hidden(obligations: DataFrame, evidence: DataFrame, key: str, verified: Column, linked: Column, brief: Column) -> DataFrame:
    """Keys of verified, linked obligations whose evidence, of which there is some, is never from a brief."""
    sources = evidence.groupBy(key).agg(F.bool_or(brief).alias("_brief")).where("not _brief")
    return obligations.where(verified & linked).join(sources, key, "left_semi").select(key)


def numbered(rows: DataFrame, evidenced: DataFrame, scope: str, order: str, key: str) -> DataFrame:
    """A scope's rows as A1 to An in canonical order, with whether ``evidenced`` holds their key."""
    place = F.row_number().over(Window.partitionBy(scope).orderBy(order, key))
    flags = evidenced.select(key).distinct().withColumn("evidenced", F.lit(True))
    named = rows.withColumn("local_id", F.concat(F.lit("A"), place.cast("string"))).join(flags, key, "left")
    return named.withColumn("evidenced", F.coalesce("evidenced", F.lit(False)))
