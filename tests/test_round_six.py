"""Deviations that equal a threshold, whose side the order of sums decides."""

from __future__ import annotations

import datetime

import duckdb
import pytest

import __spark_entry__
from dialoglens.operators import scoring

#: Scores of pairs whose deviation is 0.2 but for rounding, by which order puts it above.
TIED = [(0.8315, 0.4315), (0.83152, 0.43152), (0.9502, 0.5502), (0.43892, 0.83892), (0.87512, 0.47512), (0.975, 0.575), (0.9932, 0.5932), (0.50096, 0.90096), (0.59468, 0.99468)]


def test_deviations_follow_the_place_of_samples(spark):
    rows = [(i, s, score, "read", -s) for i, pair in enumerate(TIED) for s, score in enumerate(pair)]
    samples = spark.createDataFrame(rows, "qa_id int, sample int, score double, reasoning string, place int")
    turned = spark.createDataFrame([(i, 1 - s, score, "read") for i, s, score, _, _ in rows], "qa_id int, sample int, score double, reasoning string")

    def low(df):
        return {r["qa_id"]: r["is_low_confidence"] for r in scoring.collapsed(df, "qa_id").collect()}

    assert low(samples) == low(turned) != low(samples.drop("place"))


def test_dispatched_scores_sides_with_the_sql_where_deviations_tie(spark, sf, tmp_path):
    # beside those of a table, as the SQL goes another way over a few rows: two of one metric, whose samples tie, and two of others
    events = spark.read.parquet(f"{sf}/events.parquet")
    at, rows = datetime.datetime(2024, 1, 1), []
    for i, (first, second) in enumerate(TIED):
        for j, (kind, score) in enumerate([("view", first), ("view", second), ("signup", 0.5), ("click", 0.25)]):
            rows.append((36 * (1000 + i) + 4 + j, at, 5 * i + 3, kind, round((1 - score) * 250, 2), '{"k": 40}'))
    events.unionByName(spark.createDataFrame(rows, events.schema)).coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    found = __spark_entry__.queries()["dispatched_scores"](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql("SET threads = 1")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    db.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    wanted = db.sql(__spark_entry__.oracle_sql()["dispatched_scores"])
    assert sorted(map(tuple, found.select(wanted.columns).collect()), key=repr) == sorted(wanted.fetchall(), key=repr)


@pytest.mark.parametrize("order", [["place", "sample"], ["sample"]])
def test_the_median_does_not_depend_on_places(spark, order):
    rows = spark.createDataFrame([(1, s, x, "read", -s) for s, x in enumerate((0.2, 0.9, 0.4))], "qa_id int, sample int, score double, reasoning string, place int")
    assert scoring.collapsed(rows.select("qa_id", "score", "reasoning", *order), "qa_id").first()["score"] == 0.4
