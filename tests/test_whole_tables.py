"""What the queries on whole tables must tell apart, beside giving their SQL's rows."""

from __future__ import annotations

from collections import Counter

import pytest

from ledgerloom.plans import registry

from .test_queries import SF, con  # noqa: F401


def test_merged_reports_of_all_lines(spark, con):  # noqa: F811
    found = registry.QUERIES["merged_positions"](spark, SF).collect()
    assert sum(r.is_closed for r in found) == con.execute("SELECT count(*) FROM lineitem WHERE l_linestatus = 'F'").fetchone()[0]
    assert set(Counter((r.is_closed, r.is_carry_over) for r in found)) == {(True, False), (False, True), (False, False)}
    assert registry.QUERIES["merged_reports"](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["asof_backward", "asof_forward", "asof_forward_window", "asof_nearest", "execution_quote", "mark_quote", "snapshot_60"])
def test_every_quote_is_an_anchor(spark, con, name):  # noqa: F811
    found = registry.QUERIES[name](spark, SF).collect()
    assert sorted(r[0] for r in found) == [r[0] for r in con.execute("SELECT event_id FROM events ORDER BY 1").fetchall()]


@pytest.mark.parametrize(("name", "column", "values"), [
    ("execution_quote", "status", {"no_quote", "invalid_quote", "same_time", "duplicate", "selected"}),
    ("mark_quote", "status", {"no_quote", "invalid_quote", "same_time", "duplicate", "selected"}),
    ("snapshot_60", "support", {"invalid_row", "empty_prefix", "duplicate_timestamp", "no_anchor", "quote_gap", "supported"}),
])
def test_all_reasons_occur(spark, name, column, values):
    found = {r[0] for r in registry.QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()}
    assert found <= values and len(found) >= len(values) - 1


@pytest.mark.parametrize(("name", "column", "values"), [
    ("clock_mapping", "status", {"unique", "nonexistent", "ambiguous"}),
    ("window_censoring", "status", {"clock_unresolved", "invalid_transition", "cross_fold_continuation", "left_censored_unknown_bootstrap", "coverage_censored_no_valid_tick", "right_censored_no_terminal", "valid"}),
    ("selected_cases", "selection", {"earliest_eligible_date", "chronological_fallback"}),
    ("supported_bins", "censor_reason", {None, "target_event", "competing_endpoint", "synthetic_right_censor", "coverage_right_censor"}),
    ("support_audit", "exclusion_reason", {None, "ineligible_state", "no_complete_bin", "left_truncated", "cross_development_holdout"}),
    ("feature_audit", "reason", {None, "below_floor", "window_10", "window_2"}),
    ("gap_evidence", "class", {"unknown_coverage_gap", "scheduled_market_closed", "replicated_coverage_gap"}),
    ("intake_sessions", "status", {"PASS", "FAIL", "INCOMPLETE"}),
    ("streamed_groups", "kind", {"group", "late", "invalid_time", "poisoned"}),
])
def test_every_branch_is_met(spark, name, column, values):
    found = {r[0] for r in registry.QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()}
    assert found >= values
