"""Every registered audit query against its SQL in DuckDB, over whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from dialoglens.plans import queries as audit


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f'{value:.9g}')
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(audit.ORACLE))
def test_matches_sql(spark, sf, con, name):
    df = audit.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = con.execute(audit.ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(dict(zip(columns, r))[c]) for c in names) for r in found.fetchall()), key=repr)
    assert got == want


def test_every_audit_query_has_sql():
    assert set(audit.QUERIES) == set(audit.ORACLE)


@pytest.mark.parametrize("name", ["sla_group_by", "tenant_trends_day", "tenant_trends_run", "run_trends", "previous_run_delta"])
def test_means_are_the_same_to_the_last_bit(spark, name):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    df = audit.QUERIES[name](spark, sf)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    names = ", ".join(f'"{x}"' for x in sorted(df.columns))
    assert got == sorted(c.execute(f"select {names} from ({audit.ORACLE[name]})").fetchall(), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).first()["metric"] == "answer_relevance"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
