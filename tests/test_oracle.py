"""Every registered tenancy query against its SQL on the smallest tables, and its columns without nested surprises."""

import math
import os

import duckdb
import pytest

from tenora.operators.registry import registered, registered_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registered_sql()))
def test_matches_sql(spark, sf_dir, duck, name):
    got = registered()[name](spark, sf_dir)
    want = duck.execute(registered_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in got.collect()), key=str)
    order = [columns.index(c) for c in sorted(columns)]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)
    assert rows == expected


def test_queries_without_sql_have_rows(spark, sf_dir):
    for name in set(registered()) - set(registered_sql()):
        assert registered()[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists(__spark_entry__.__file__)


def test_owners_are_found_without_members(spark, sf_dir):
    from tenora.sources.fixtures import Fixture

    x = Fixture(spark, sf_dir)
    plan = x.owners._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Join ") == 1, plan
    made = x.memberships.where("role = 30").selectExpr("tenant_id", "user_id", "created_at")
    assert sorted(map(tuple, x.owners.collect())) == sorted(map(tuple, made.collect()))


def test_many_members_are_not_sorted(spark, sf_dir, monkeypatch):
    from tenora.operators import queries
    from tenora.sources import fixtures

    few = fixtures.Fixture(spark, sf_dir)
    monkeypatch.setattr(fixtures, "LINES", 0, raising=False)
    x = fixtures.Fixture(spark, sf_dir)
    plan = queries.tenant_summary(x.memberships, x.tenants)._jdf.queryExecution().sparkPlan().toString()
    members = plan[: plan.index("SortAggregate")]
    assert "ShuffledHashJoin" in members and "SortMergeJoin" not in members, plan
    assert sorted(map(tuple, x.memberships.collect())) == sorted(map(tuple, few.memberships.collect()))
