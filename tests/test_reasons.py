"""Queries that word every case do meet every reason and code."""

import os

from quillspan.operators import claims as C
from quillspan.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_every_reason_is_met(spark):
    required = rows(spark, "requirement_gate")
    assert {r.refused for r in required} == {None, "assessment_unknown", "span_unknown", "quote_not_found", "quote_overlaps_injection", "no_requirement_language", "statement_too_long"}
    assert {x for r in required for x in r.review.split()} == {"non_unique_quote_location", "no_requirement_language", "assessment_link_unsupported"}
    assert {r.lead_from for r in required} == {None, "own", "line", "heading", "proposed"}
    owed = rows(spark, "obligation_gate")
    assert {r.refused for r in owed} == {None, "no_evidence", "no_obligation_wording", "wrong_claim_type"}
    assert {x for r in owed for x in r.review.split()} == set(C.REASONS)
    assert {r.refused for r in rows(spark, "deadline_checks")} == {None, "non_deadline_date", "no_deadline_semantics", "model_date_mismatch", "model_time_mismatch"}
    assert all(r.n > 0 for r in rows(spark, "claim_issue_counts"))
