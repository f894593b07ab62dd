"""Pinned numbers and edge cases of the audit operators."""

import json

import pytest
from pyspark.sql import functions as F

from dialoglens.config import lookup, merged
from dialoglens.functions.numbers import cosine, five_bins
from dialoglens.functions.pii import detected, masked
from dialoglens.functions.text import pairs, search_terms, token_set, without_numbering, word_count
from dialoglens.operators import retrieval, scoring, statistics, turns
from dialoglens.operators.judge import judged
from dialoglens.sources import call_logs, writers


def rows(df, *keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


def call(spark, *said):
    return spark.createDataFrame([("c", i, r, t) for i, (r, t) in enumerate(said)], "call_id string, turn_id int, role string, content string")


def test_runs_of_turns_merge_and_stock_answers_go(spark):
    t = call(spark, ("user", "first"), ("user", "second"), ("bot", "answer"), ("bot", "more"), ("user", "question"), ("system", "x"), ("bot", "late"), ("user", "hello there"), ("bot", "네, 알겠습니다"))
    assert rows(turns.question_answer_pairs(t).select("question", "answer", "turn_index", "turn_id"), "turn_id") == [("first second", "answer more", 1, 1)]


def test_text_functions(spark):
    r = spark.range(1).select(
        pairs(F.lit("abc")).alias("p"), pairs(F.lit("a")).alias("q"), token_set(F.lit("Ab ab")).alias("t"), search_terms(F.lit("A  b")).alias("s"), word_count(F.lit("  ")).alias("n"), without_numbering(F.lit("1. x")).alias("w")
    ).first()
    assert (r["p"], r["q"], r["n"], r["w"]) == (["ab", "bc"], [], 0, "x")
    assert sorted(r["t"]) == ["Ab", "ab", "ba"] and r["s"] == ["a", "b", "A ", " b"]


@pytest.mark.parametrize("text,found", [("주민번호 901201-1234567 확인", ["resident_number"]), ("연락처 010-1234-5678", ["phone"]), ("계좌 110-123-456789 로", ["account"]), ("010-1234-5678입니다", []), ("clean", []), (None, [])])
def test_personal_data(spark, text, found):
    df = spark.createDataFrame([(text,)], "t string")
    assert detected(df, "t").first()["pii"] == found
    assert not found or "<" in df.select(masked(F.col("t")).alias("m")).first()["m"]


def scores(spark, *values):
    return spark.createDataFrame([(i, m, float(s), 1.0, False) for i, (m, s) in enumerate(values)], "eval_id int, metric string, score double, confidence double, is_low_confidence boolean")


def test_sla_summary(spark):
    r = statistics.sla_summary(scores(spark, ("faithfulness", 0.9), ("faithfulness", 0.9), ("faithfulness", 0.5))).first()
    assert r["sla_pass_rate"] == pytest.approx(2 / 3) and r["below_sla_count"] == 1
    assert statistics.sla_summary(scores(spark, ("x", 1)).limit(0)).count() == 0


def test_diagnosis(spark):
    data = [(i, m, float(v)) for i, (f, c) in enumerate([(0.9, 0.9), (0.9, 0.4), (0.5, 0.9), (0.5, 0.4)]) for m, v in (("faithfulness", f), ("context_recall", c))]
    found = statistics.diagnosed(spark.createDataFrame(data, "eval_id int, metric string, score double"))
    assert [r[1] for r in rows(found, "eval_id")] == ["healthy", "retrieval_failure", "generation_hallucination", "both"]


def test_collapsed_samples(spark):
    s = spark.createDataFrame([("a", 0, 0.8, "x"), ("a", 1, 0.8, "y"), ("a", 2, 0.0, "Parse error"), ("b", 0, 0.0, "Parse error")], "qa string, sample int, score double, reasoning string")
    assert rows(scoring.collapsed(s, "qa").select("qa", "score", "confidence", "n_samples", "reasoning"), "qa") == [("a", 0.8, 1.0, 2, "x"), ("b", 0.0, 1.0, 1, "Parse error")]


def test_ensemble_and_escalation(spark):
    j = spark.createDataFrame([("a", "p", 0.82), ("a", "q", 0.8), ("b", "p", 1.0), ("b", "q", 0.15)], "qa string, provider string, score double")
    got = {r["qa"]: r for r in scoring.ensembles(j, "qa").collect()}
    assert got["a"]["score"] == pytest.approx(0.81) and got["b"]["score"] == pytest.approx(0.575) and got["b"]["is_low_confidence"]
    final = spark.createDataFrame([("b", 0.9)], "qa string, verdict double")
    assert {r["qa"]: r["score"] for r in scoring.ensembles(j, "qa", by_median=True, verdicts=final).collect()}["b"] == 0.9


def test_claims_and_nuggets(spark):
    c = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", [])], "qa string, claims array<string>")
    v = spark.createDataFrame([("a", " x ", "supported", 0), ("a", "y", "contradicted", 1)], "qa string, claim string, verdict string, place int")
    assert rows(scoring.claim_faithfulness(c, v, "qa"), "qa") == [("a", pytest.approx(1 / 3), 3, 1, 1), ("b", 1.0, 0, 0, 0)]
    n = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "qa string, nuggets array<string>")
    m = spark.createDataFrame([("a", "x", True, 0)], "qa string, nugget string, found boolean, place int")
    assert rows(scoring.nugget_recall(n, m, "qa"), "qa") == [("a", 0.5, 2, 1), ("b", 1.0, 0, 0)]


def test_expected_score(spark):
    t = spark.createDataFrame([("a", "1", 0.6), ("a", " 0.5", 0.4), ("a", "yes", 0.9)], "qa string, token string, prob double")
    assert scoring.expected_score(t, "qa").first()["score"] == pytest.approx(0.8)


def test_meta_evaluation(spark):
    p = spark.createDataFrame([(x, x) for x in (0.0, 0.5, 1.0, 0.25)], "judge double, human double")
    assert tuple(statistics.meta_evaluation(p).first()) == (4, 0.0, pytest.approx(1.0), 1.0)
    assert statistics.meta_evaluation(p.withColumn("human", 1 - F.col("human"))).first()["spearman"] == pytest.approx(-1.0)
    assert spark.range(1).select(five_bins(F.lit(0.625)).alias("b")).first()["b"] == 2


def test_resampling(spark):
    low = scores(spark, *[("m", v) for v in (0.5, 0.52, 0.48, 0.51, 0.49)])
    high = scores(spark, *[("m", v) for v in (0.86, 0.85, 0.87, 0.88, 0.84)])
    r = statistics.significant_regressions(low, high, permutations=200).first()
    assert r["delta"] < 0 and r["p_value"] < 0.05 and r["is_regression"]
    assert not statistics.permutation_test(high, high, permutations=100).first()["significant"]
    ci = statistics.bootstrap_ci(high, samples=200).first()
    assert ci["low"] <= ci["mean"] <= ci["high"]
    one = statistics.bootstrap_ci(scores(spark, ("m", 0.3)), samples=50).first()
    assert one["low"] == one["high"] == 0.3
    d = statistics.delta_ci(low, high, samples=100).first()
    assert d["ci_high"] < 0


def test_regressions(spark):
    now, then = (spark.createDataFrame([("m", x)], "metric string, mean double") for x in (0.7, 0.8))
    assert statistics.regressions(now, then).first()["is_regression"] and not statistics.regressions(then, now).first()["is_regression"]


def test_chunks_cover_all_words(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(2300)))), (2, ""), (3, None)], "id int, text string")
    got = retrieval.chunked(df, "id", "text").collect()
    assert {w for r in got if r["level"] == "child" for w in r["content"].split()} == set(map(str, range(2300)))
    assert {r["source_id"] for r in got} == {1} and len({r["chunk_id"] for r in got}) == len(got)
    assert {r["parent_chunk_id"] for r in got if r["level"] == "child"} == {r["chunk_id"] for r in got if r["level"] == "parent"}


def test_fusion(spark):
    d = spark.createDataFrame([(0, "a", 0, 1.0), (0, "b", 1, 0.9)], "query_id int, chunk_id string, rank int, score double")
    s = spark.createDataFrame([(0, "b", 0, 1.0)], "query_id int, chunk_id string, rank int, score double")
    got = {r["chunk_id"]: r["score"] for r in retrieval.fused(d, s, 5).collect()}
    assert got["a"] == pytest.approx(0.7 / 60) and got["b"] == pytest.approx(0.7 / 61 + 0.3 / 60)


def test_zero_vectors(spark):
    assert spark.sql("select array(0d, 0d) a, array(1d, 0d) b").select(cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] == 0


def test_call_logs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"call_id": "A", "turns": [{"role": "user", "content": "     "}, {"role": "bot", "content": "hi"}, {"role": "bot", "content": "long enough", "timestamp": "2024-01-01T00:00:00Z"}]}))
    (tmp_path / "noid.json").write_text(json.dumps({"turns": [{"role": "user", "content": "a question"}]}))
    (tmp_path / "bad_role.json").write_text(json.dumps({"call_id": "R", "turns": [{"role": "robot", "content": "a question"}]}))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "b.csv").write_text("call_id,subscriber_id,timestamp,role,content\nB,S,2024-01-01 00:00:00,user,hello there\nX,Y,bad,bot,ok\nB,S,,bot,the answer\n")
    sub = tmp_path / "sub"
    sub.mkdir()
    (sub / "c.txt").write_text("[CALL_ID: C] [SUBSCRIBER: T]\n[2024-01-01 11:00:00] USER: a question\n[x] bot: no\n[2024-01-01 11:00:05] BOT: an answer\n")
    (tmp_path / "d.xml").write_text("<x/>")
    got = rows(call_logs.read_call_logs(spark, str(tmp_path)).select("call_id", "subscriber_id", "turn_id", "role", "content"), "call_id", "turn_id")
    assert got == [("A", "unknown", 0, "user", ""), ("A", "unknown", 2, "bot", "long enough"), ("B", "S", 0, "user", "hello there"), ("B", "S", 2, "bot", "the answer"), ("C", "T", 0, "user", "a question"), ("C", "T", 1, "bot", "an answer"), ("noid", "unknown", 0, "user", "a question")]
    assert {r["path"].rsplit("/", 1)[-1] for r in call_logs.quarantined(spark, str(tmp_path)).collect()} == {"broken.json", "bad_role.json", "d.xml"}


def test_golden_set(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"qa_id": "a", "metric": "m", "human_score": 0.1}\nnot json\n{"qa_id": "a", "metric": "m", "human_score": 0.9}\n')
    assert rows(call_logs.read_golden(spark, str(tmp_path / "g.jsonl")), "qa_id") == [("a", "m", 0.9)]


def test_upsert_twice(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for v, score in enumerate((0.5, 0.95, 0.95)):
        writers.upsert(spark, spark.createDataFrame([("e", score, v)], "eval_id string, score double, version int"), path, ["eval_id"], "version")
    assert rows(writers.current(spark, path), "eval_id") == [("e", 0.95, 2)]


def test_report(spark):
    s = scores(spark, ("faithfulness", 0.9))
    page = writers.report_html(statistics.sla_summary(s), spark.createDataFrame([("C<1>",)], "call_id string"), "r")
    assert "C&lt;1&gt;" in page and "good" in page


def test_judge(spark):
    class Broken:
        def complete(self, prompts):
            raise OSError

    pairs = spark.createDataFrame([("q", "a b", "a b")], "qa_id string, question string, answer string")
    got = judged(pairs, Broken(), ("m",), samples=2, retries=0).collect()
    assert len(got) == 2 and all(r["score"] == 0 and r["reasoning"].startswith("Parse error") for r in got)


def test_steps_and_settings(spark):
    from dialoglens.plans.audit import METHODS, STEPS, Audit

    pairs = spark.createDataFrame([("q1", "call me", "at 010-1234-5678"), ("q2", "a", "b")], "qa_id string, question string, answer string")
    s = spark.createDataFrame([("q1", "faithfulness", 0.9), ("q2", "faithfulness", 0.1)], "qa_id string, metric string, score double")
    a = Audit(pairs, None, s)
    assert {x for m in METHODS.values() for x in m} == set(STEPS) and a.also("quick") == {}
    assert [r["qa_id"] for r in a.also("safety_audit")["review"].collect()] == ["q2"]
    assert {r["category"]: r["n"] for r in a.also(["diagnosis"])["diagnosis"].collect()}["generation_hallucination"] == 1
    with pytest.raises(ValueError):
        a.also("nothing here")
    assert lookup({"a": {"b": 1}}, "a.b") == 1 and lookup({}, "a.b", 2) == 2 and merged({"a": {"x": 1, "y": 2}}, {"a": {"x": 3}}) == {"a": {"x": 3, "y": 2}}


def test_score_stream_covers_its_table(spark, sf):
    from __spark_entry__ import queries

    events = spark.read.parquet(f"{sf}/events.parquet").where("ts is not null")
    assert queries()["score_stream"](spark, sf).agg(F.sum("n")).first()[0] == events.select("event_id").distinct().count()
