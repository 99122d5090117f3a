"""Queries read and enrich the events once."""

import pytest

from visitlens.plans import journey_queries, registry  # noqa: F401


def scans(df, table):
    return df._jdf.queryExecution().optimizedPlan().toString().count(table)


@pytest.mark.parametrize("name, most", [
    ("score_intent", 0), ("intent_signals", 0), ("attribution", 0), ("top_content", 0), ("merge_intent_parts", 0), ("replay_journeys", 0), ("visitor_overview", 0),
    ("high_intent_journeys", 1), ("recent_journeys", 1), ("rollup_events", 0), ("unique_sessions_approx_bound", 0),
])
def test_events_are_enriched_once(spark, sf, name, most):
    """``most`` counts the user agents' pattern in the plan beside the stored steps."""
    plan = registry.QUERIES[name](spark, sf)
    assert scans(plan, "spider|crawl") <= most * 4  # it is in filters and joins too


def test_dedup_carries_what_it_needs(spark, sf, monkeypatch):
    seen = []
    whole = registry.dedup.dedup_ttl
    monkeypatch.setattr(registry.dedup, "dedup_ttl", lambda rows, seconds: seen.append(rows.columns) or whole(rows, seconds))
    registry.QUERIES["dedup_ttl"](spark, sf)
    assert seen == [["event_id", "event_time", "server_time"]]


def test_matches_are_counted_by_hash(spark, sf):
    steps = journey_queries.steps(spark, sf)
    parts = journey_queries.journeys.intent_parts(steps, journey_queries.R.signal_rules(spark), journey_queries.R.metadata(spark))
    plan = parts.where("signal_key not like 'content:%'")._jdf.queryExecution().optimizedPlan().toString()
    assert "first(r_description" not in plan
