"""Physical plans: what reaches the scan, what is limited before the shuffle, and that nothing is crossed but single rows."""

import re

import pytest

from heronry import plans

QUERIES = plans.queries()
#: Queries that join results of one row.
SINGLE_ROWS = {"C16_dashboard", "D15_row_counts", "A20_api_stats", "I18_graph_counts", "I21_crawler_status", "I21_paused", "I22_domain_detail", "D9_percentile", "F4_relevance", "I24_search_salary"}


def plan(spark, folder, name):
    return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n[0] in "BCDEFG" or n.startswith("I")])
def test_no_cross_joins(spark, small, name):
    p = plan(spark, small, name)
    assert "CartesianProduct" not in p
    assert name in SINGLE_ROWS or "BroadcastNestedLoopJoin" not in p


def test_pushdown_and_pruning(spark, small):
    p = plan(spark, small, "D1_open_per_domain")
    assert re.search(r"PushedFilters: \[IsNull\(closed_at\), IsNotNull\(domain_id\)\]", p) and re.search(r"ReadSchema: struct<domain_id:bigint,closed_at:bigint>", p)
    assert "GreaterThanOrEqual(fetched_at" in plan(spark, small, "F8_graph_page") or "LessThanOrEqual(fetched_at" in plan(spark, small, "F8_graph_page")


def test_limits_before_shuffles(spark, small):
    p = plan(spark, small, "E1_frontier_next")
    assert "WindowGroupLimit" in p and "TakeOrderedAndProject" in p
    assert "TakeOrderedAndProject" in plan(spark, small, "F1_recent")


def test_scalars_stay_in_the_jvm(spark, small):
    for name in (n for n in QUERIES if n.startswith("H") and n not in ("H14_html_to_text", "H50_organizations", "H51_replies")):
        assert "Python" not in plan(spark, small, name) and "MapInPandas" not in plan(spark, small, name)
    for name in ("I2_score_links", "I3_assess_pages", "I6_category_seniority", "I7_skills", "I8_geocode", "I9_rules", "I11_match_scores"):
        assert "InPandas" not in plan(spark, small, name)
