"""Operators whose work is dealt over ranges, bins and blocks, against plain programs."""

import math
import random
import statistics as plain

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoglens.functions import numbers
from dialoglens.operators import bm25, ordered, quantiles, resampling, retrieval, statistics, vectors
from dialoglens.sources.storage import kept


@pytest.mark.parametrize(("few", "bins"), [(200_000, 4096), (3, 4), (1, 2)])
def test_quantiles_by_selection(spark, monkeypatch, few, bins):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "ROUNDS", 80)
    rng = random.Random(few)
    values = {"a": [rng.random() for _ in range(101)], "b": [0.5] * 40 + [0.25], "c": [-1e308, 1e308, 3.0], None: [7.0], "d": [float(i % 3) for i in range(50)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("none", None)]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, score double").repartition(5), ["k"], "score", {"low": 0.1, "mid": 0.5, "high": 0.9}).collect()
    assert {r["k"] for r in got} == set(values)
    for r in got:
        assert (r["low"], r["mid"], r["high"]) == pytest.approx(tuple(np.percentile(values[r["k"]], [10, 50, 90])), rel=1e-12)


def test_no_task_holds_a_metric(spark):
    rows = spark.range(50_000).select(F.lit("m").alias("metric"), F.pmod(F.hash("id"), F.lit(10_007)).cast("double").alias("score"))
    df = statistics.sla_summary(rows)
    plan = df._jdf.queryExecution().toString().lower()
    assert "median(" not in plan and "percentile(" not in plan
    assert df.first()["median"] == plain.median(r["score"] for r in rows.collect())


def test_running_totals_and_ranks(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9), rng.choice([1.0, 2.0, 2.0, 3.5])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, n long, v double").repartition(7)
    total = {r["id"]: r["t"] for r in ordered.running_total(df, ["id"], "n", "t").collect()}
    assert [total[i] for i in range(500)] == np.cumsum([r[1] for r in rows]).tolist()
    values = sorted(r[2] for r in rows)
    mid = {v: (values.index(v) + 1 + values.index(v) + values.count(v)) / 2 for v in set(values)}
    assert all(r["rank"] == mid[r["v"]] for r in ordered.mid_ranks(df, "v", "rank").collect())
    assert ordered.running_total(df.limit(0), ["id"], "n", "t").collect() == []


@pytest.mark.parametrize("parts", [1, 9])
def test_the_budget_cuts_at_one_place(spark, parts):
    calls = spark.createDataFrame([(i, "m" if i % 2 else "free", 1000, 500) for i in range(40)], "call long, model string, tokens_in long, tokens_out long").repartition(parts)
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, price_in double, price_out double")
    got = statistics.budgeted(calls, prices, ["call"], 0.005).orderBy("call").collect()
    assert [r["call"] for r in got if r["kept"]] == [0, 1, 2, 3, 4, 5] and len(got) == 40
    assert got[4]["spent"] == pytest.approx(0.004) and statistics.total_cost(calls, prices).where("model = 'm'").first()["cost"] == pytest.approx(0.04)


def uniform(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.random(n), rng.random(n)


@pytest.mark.parametrize(("n", "c", "m"), [(20, 7, 9), (20, 15, 4), (20, 3, 18), (10_000, 40, 5_000), (10_000, 9_990, 2_000), (100_000, 30_000, 50_000), (10**9, 10**4, 10**6)])
def test_hypergeometric_counts(n, c, m):
    u, v = uniform(20_000)
    k = resampling.hypergeometric(float(n), float(c), np.full(20_000, float(m)), u, v)
    assert k.min() >= max(0, m - (n - c)) and k.max() <= min(c, m) and (k == np.round(k)).all()
    spread = m * c * (n - c) * (n - m) / (n * n * (n - 1))
    assert k.mean() == pytest.approx(m * c / n, abs=6 * math.sqrt(spread / 20_000)) and k.var() == pytest.approx(spread, rel=0.06)


@pytest.mark.parametrize("mean", [0.0, 0.3, 1.0, 30.0, 400.0])
def test_other_counts(mean):
    u, v = uniform(20_000)
    k = resampling.poisson(mean, u, v)
    assert k.mean() == pytest.approx(mean, abs=6 * math.sqrt(mean / 20_000) + 1e-12) and k.var() == pytest.approx(mean, rel=0.06, abs=1e-12)
    for share in (0.0, 0.2, 0.9, 1.0):
        k = resampling.binomial(np.full(20_000, mean), share, u, v) if mean == round(mean) else None
        if k is not None:
            assert k.mean() == pytest.approx(mean * share, abs=6 * math.sqrt(mean * share * (1 - share) / 20_000) + 1e-12)


def test_resampled_intervals_cover_as_they_should(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(0.6, 0.1, 3000)
    df = spark.createDataFrame([("m", i, float(x)) for i, x in enumerate(values)], "metric string, eval_id long, score double")
    half = 1.96 * values.std() / math.sqrt(3000)
    for f in (statistics.bootstrap_ci, statistics.poisson_ci):
        r = f(df, samples=1000).first()
        assert r["n"] == 3000 and (r["low"], r["high"]) == pytest.approx((values.mean() - half, values.mean() + half), abs=0.12 * half)


def brute_bm25(queries, chunks, k, k1=1.5, b=0.75):
    held = {c: bm25.all_terms(t) for c, t in chunks.items()}
    mean = sum(sum(x.values()) for x in held.values()) / len(held)
    out = {}
    for q, text in queries.items():
        found = []
        for c, terms in held.items():
            size, score = max(1, sum(terms.values())), 0.0
            for t, times in bm25.all_terms(text).items():
                df = sum(t in x for x in held.values())
                if tf := terms[t]:
                    score += times * math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
            if round(score, 9) > 0:
                found.append((-round(score, 9), c))
        out[q] = [(c, -s) for s, c in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("settings", [{}, {"QUERIES": 2, "BLOCK": 5, "SAMPLE": 20, "FEW_TERMS": 60}])
def test_pruned_search_is_exact(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(bm25, name, value)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    chunks = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for i in range(150)}
    chunks |= {200 + i: chunks[3] for i in range(6)} | {300: None, 301: " \n"}
    queries = {f"q{i}": " ".join(rng.choice(words) for _ in range(6)) for i in range(7)} | {"same": chunks[3], "none": None, "strange": "zzzz"}
    q = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    c = spark.createDataFrame(list(chunks.items()), "chunk_id long, content string").repartition(6)
    got = {}
    for r in retrieval.bm25_search(q, c, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    for name, want in brute_bm25(queries, chunks, 5).items():
        assert [x[0] for x in got.get(name, [])] == [x[0] for x in want]
        assert [x[1] for x in got.get(name, [])] == pytest.approx([x[1] for x in want], abs=1e-9)
    assert retrieval.bm25_search(q.limit(0), c, 5).collect() == retrieval.bm25_search(q, c.limit(0), 5).collect() == []


def test_vector_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    held = {i: [float(x) for x in rng.integers(-2, 3, 4)] for i in range(60)}
    bad = [(90, None), (91, [1.0, None, 0.0, 0.0]), (92, [1.0]), (93, [float("nan")] * 4)]
    v = spark.createDataFrame([*held.items(), *bad], "vec_id long, v array<double>").repartition(3)
    q = spark.createDataFrame([(f"q{i}", held[i]) for i in range(9)], "query_id string, qv array<double>")
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1.0)
    want = {(f"q{i}", r): s[1] for i in range(9) for r, s in enumerate(sorted(((round(float(unit(held[i]) @ unit(x)), 9), j) for j, x in held.items()), reverse=True)[:5])}
    for size in (16 << 20, 64):
        monkeypatch.setattr(vectors, "BYTES", size)
        found = retrieval.vector_search(q, v, 5)
        assert {(r["query_id"], r["rank"]): r["vec_id"] for r in found.collect()} == want
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_vector_search_bounds_a_block_by_its_best_rows(spark, monkeypatch):
    """Short vectors: many queries fit few bytes, but each holds k rows; no block leaves any out."""
    rng = np.random.default_rng(7)
    held = {i: [float(x) for x in rng.normal(size=2)] for i in range(80)}
    v = kept(spark.createDataFrame(list(held.items()), "vec_id long, v array<double>").repartition(3))
    q = v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    units = {i: np.array(x) / np.linalg.norm(x) for i, x in held.items()}
    want = {(i, r): s[1] for i in range(0, 80, 2) for r, s in enumerate(sorted(((round(float(units[i] @ x), 9), j) for j, x in units.items()), reverse=True)[:20])}
    monkeypatch.setattr(vectors, "BYTES", 8192)
    found = retrieval.vector_search(q, v, 20)
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 5  # 40 queries of 16 bytes and 20 rows; one block by the vectors alone
    assert "LogicalRDD" not in plan  # an empty part would start Python workers of its own
    none = retrieval.vector_search(q.where("query_id < 0"), v, 20)
    assert none.schema.simpleString() == found.schema.simpleString() and none.collect() == []


def test_unit_takes_the_norm_once(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, []), (3, None), (4, [1.0, None])], "i int, v array<double>")
    assert numbers.unit(F.col("v"))._jc.toString().count("aggregate") == 1
    assert [r["u"] for r in rows.select("i", numbers.unit(F.col("v")).alias("u")).orderBy("i").collect()] == [[0.6, 0.8], [0.0, 0.0], [], None, [None, None]]
