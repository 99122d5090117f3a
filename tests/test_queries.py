"""Every registered query with SQL against DuckDB, on the smallest data."""

import pytest

from visitlens.plans import column_queries, journey_queries, registry  # noqa: F401


def rows(columns, data):
    def norm(v):
        return round(float(v), 6) if isinstance(v, float) else v

    return sorted((tuple(norm(r[c]) for c in columns) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    names = list(want.columns)
    assert rows(columns, got.collect()) == rows(columns, [dict(zip(names, r)) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_run(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).collect() is not None


def test_approximate_sessions_are_near(spark, sf):
    exact = {tuple(r)[:6]: r.unique_sessions for r in registry.QUERIES["unique_sessions_exact"](spark, sf).collect()}
    near = {tuple(r)[:6]: r.unique_sessions for r in registry.QUERIES["unique_sessions_approx"](spark, sf).collect()}
    assert exact.keys() == near.keys() and all(abs(near[k] - n) <= max(1, 0.1 * n) for k, n in exact.items())
