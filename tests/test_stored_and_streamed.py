"""Runs that are taken up again, tables that are rewritten in part, streams that restart, dispatch, logs of all kinds."""

import json

import pytest
from pyspark.sql import functions as F

from dialoglens import config
from dialoglens.functions.text import grounding, pooled_grounding
from dialoglens.operators import dispatch, judge, retrieval, scoring, statistics
from dialoglens.plans import served
from dialoglens.sources import call_logs, runs, writers
from dialoglens.sources.progress import Progress, run_stages
from dialoglens.sources.storage import Files
from dialoglens.sources.tables import BucketTable, ChunkIndex
from dialoglens.streaming import scores as streams


def test_a_killed_run_ends_with_each_item_once(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("qa_id"))
    asked = []

    def work(some):
        asked.append(1)
        if len(asked) == 4:
            raise KeyboardInterrupt
        return some.withColumn("score", F.col("qa_id") * 2)

    with pytest.raises(KeyboardInterrupt):
        Progress(spark, str(tmp_path), "r").items("cp4", rows, "qa_id", work)
    run = Progress(spark, str(tmp_path), "r")
    run.attempt(rows.withColumn("score", F.lit(-1)))  # what a killed attempt may leave behind
    first = run.done("cp4").count()
    assert 0 < first < 200
    done = run.items("cp4", rows, "qa_id", work).orderBy("qa_id").collect()
    assert [tuple(r) for r in done] == [(i, 2 * i) for i in range(200)] and len(asked) == 9
    assert run.items("cp4", rows, "qa_id", work).count() == 200 and len(asked) == 9
    more = spark.range(203).select(F.col("id").alias("qa_id"))
    assert run.items("cp4", more, "qa_id", work).count() == 203
    assert run.clear() == 1 and run.done("cp4").count() == 203
    assert Progress(spark, str(tmp_path), "other").done("cp4") is None


def test_stages_are_skipped_and_end_where_they_should(spark, tmp_path):
    made = []

    def stage(name):
        def make(before):
            made.append(name)
            return spark.range(1) if before is None else before.withColumn(name, F.lit(name))

        return name, make

    stages = [stage(n) for n in ("cp1", "cp2", "cp3")]
    run = Progress(spark, str(tmp_path), "r")
    assert run_stages(run, stages, until="cp2").columns == ["id", "cp2"] and made == ["cp1", "cp2"]
    assert run_stages(Progress(spark, str(tmp_path), "r"), stages).columns == ["id", "cp2", "cp3"] and made == ["cp1", "cp2", "cp3"]
    assert run_stages(run, stages).count() == 1 and len(made) == 3
    with pytest.raises(ValueError):
        run_stages(run, stages, until="cp9")


def test_a_file_appears_for_one_writer_only(spark, tmp_path):
    files = Files(spark, str(tmp_path / "f"))
    assert files.claim("a/b", "é1") and not files.claim("a/b", "2") and files.read("a/b") == "é1" and files.names("a") == ["b"]


def folders(path):
    return {str(p.relative_to(path)) for p in path.glob("data/*/*") if p.is_dir()}


def test_updates_rewrite_touched_buckets_only(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), ["k"], buckets=8)
    rows = lambda *xs: spark.createDataFrame(xs, "k long, v string, at long")
    assert table.scan() is None
    table.upsert(rows(*((i, "old", 0) for i in range(100)), (None, "null", 0)), ["k"], "at")
    before = folders(tmp_path)
    assert table.upsert(rows((3, "old", 0)), ["k"], "at") == [] and folders(tmp_path) == before
    assert len(table.upsert(rows((3, "new", 1), (None, "late", -1)), ["k"], "at")) <= 2
    found = {r["k"]: r["v"] for r in table.scan().collect()}
    assert len(found) == 101 and found[3] == "new" and found[None] == "null" and found[4] == "old"
    wide = rows((5, "wide", 2)).withColumn("more", F.lit(1))
    table.upsert(wide, ["k"], "at")
    assert {r["k"]: r["more"] for r in table.scan().where("k in (5, 6)").collect()} == {5: 1, 6: None}
    assert len(list((tmp_path / "_versions").glob("0*"))) == 2
    table.rebuild(rows((1, "only", 0)))
    assert table.scan().count() == 1
    table.rebuild(rows((1, "only", 0)))
    assert len(folders(tmp_path)) == 2  # the version before stays for its readers


def test_an_unchanged_text_writes_nothing(spark, tmp_path):
    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    texts = lambda *xs: spark.createDataFrame(xs, "doc long, body string")
    index = ChunkIndex(spark, str(tmp_path), buckets=4)
    index.update(texts((1, words(300, "a")), (2, words(20, "b")), (3, None), (4, words(5, "d"))), "doc", "body")
    before = folders(tmp_path)
    assert index.update(texts((4, words(5, "d")), (1, words(300, "a")), (3, None), (2, words(20, "b"))), "doc", "body") == [] and folders(tmp_path) == before
    touched = index.update(texts((1, words(300, "a")), (2, words(21, "b")), (3, None), (5, "new one here")), "doc", "body")
    assert 0 < len(touched) <= 3
    want = retrieval.chunked(texts((1, words(300, "a")), (2, words(21, "b")), (5, "new one here")), "doc", "body").where("level = 'child'")
    key = lambda df: sorted((r["source_id"], r["chunk_id"], r["content"], r["parent_chunk_id"]) for r in df.collect())
    assert key(index.scan()) == key(want)
    found = retrieval.vector_search(index.scan().where("source_id = 5").select(F.lit("q").alias("query_id"), F.col("v").alias("qv")), index.scan().select(F.col("chunk_id").alias("vec_id"), "v"), 1).first()
    assert found["score"] == pytest.approx(1.0)
    index.rebuild(texts((9, "all else is gone")), "doc", "body")
    assert [r["source_id"] for r in index.scan().collect()] == [9]


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, *rows):
    return spark.createDataFrame([(i, m, u) for i, m, u in rows], "event_id long, m long, user_id long").select(
        "event_id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("m").cast("int"))).alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))


def test_sessions_close_across_a_restart(spark, tmp_path):
    """A session that is open when the stream stops goes on after the restart; repeats and stragglers change nothing."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    like = events(spark, (0, 0, 0))

    def run(*rows):
        events(spark, *rows).coalesce(1).write.mode("append").parquet(source)
        streams.run_stream(streams.idle_sessions(streams.event_stream(spark, source, like), late="1 hour"), streams.to_folder(out), str(tmp_path / "checkpoint"))
        return sorted((r["user_id"], r["n"], r["ended_at"].hour * 60 + r["ended_at"].minute) for r in spark.read.parquet(out).collect())

    assert run((1, 0, 7), (2, 10, 7), (3, 5, 8)) == []
    assert run((4, 35, 7), (2, 10, 7), (5, 100, 9)) == [(8, 1, 35)]
    assert run((6, 300, 9), (7, 1, 8)) == [(7, 3, 65), (8, 1, 35), (9, 1, 130)]
    assert run((8, 310, 9)) == [(7, 3, 65), (8, 1, 35), (9, 1, 130)]


def test_a_failed_batch_is_done_again(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    like = events(spark, (0, 0, 0))
    events(spark, *((i, i, i % 5) for i in range(50))).write.parquet(source)
    stream = lambda: streams.event_stream(spark, source, like).select("user_id", "event_id")

    def broken(rows, number):
        writers.upsert(rows.sparkSession, rows, path, ["user_id"], "event_id")
        raise OSError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        streams.run_stream(stream(), broken, str(tmp_path / "checkpoint"))
    streams.upsert_stream(stream(), path, ["user_id"], "event_id", str(tmp_path / "checkpoint"))
    assert sorted(map(tuple, writers.current(spark, path).select("user_id", "event_id").collect())) == [(u, 45 + u) for u in range(5)]


def judgements(spark, samples, extra):
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return dispatch.Judgements(
        claims=make([("a", [" x ", "y", ""]), ("b", [])], "qa_id string, claims array<string>"),
        verdicts=make([("a", "x", "supported", 0), ("a", "x", "contradicted", 1), ("a", "other", "supported", 0)], "qa_id string, claim string, verdict string, place int"),
        nuggets=make([("a", ["n", "m"]), ("b", [])], "qa_id string, nuggets array<string>"),
        matches=make([("a", "n", True, 0)], "qa_id string, nugget string, found boolean, place int"),
        providers=make([("c", "faithfulness", "p", 0.2), ("c", "faithfulness", "q", 1.0)], "qa_id string, metric string, provider string, score double"),
        tokens=make([("d", "faithfulness", "1", 0.5), ("d", "faithfulness", "0.5", 0.5), ("d", "faithfulness", "7", 0.9), ("e", "faithfulness", "no", 1.0)], "qa_id string, metric string, token string, prob double"),
        samples=make(samples, "qa_id string, metric string, sample int, score double, reasoning string"), extra=make(extra, "qa_id string, metric string, sample int, score double, reasoning string"))


def test_every_row_finds_its_evaluator(spark):
    f = "faithfulness"
    plans = spark.createDataFrame([(0, True, True, False, False, True), (1, False, False, True, True, True), (2, False, False, False, True, False), (3, False, False, False, False, True)], "plan_id int, nugget boolean, claims boolean, ensemble boolean, calibration boolean, routing boolean")
    work = [("a", f, 0, True), ("a", "context_recall", 0, True), ("b", f, 0, True), ("b", "context_recall", 0, False), ("c", f, 1, True), ("d", f, 2, True), ("e", f, 2, True), ("g", f, 3, True), ("h", f, 3, True), ("i", f, None, True), ("z", f, 3, True)]
    samples = [("b", "context_recall", 0, 0.4, "r"), ("e", f, 0, 0.6, "r"), ("e", f, 1, 0.0, "Parse error: x"), ("g", f, 0, 0.0, "r"), ("g", f, 1, 1.0, "r"), ("h", f, 0, 0.9, "r"), ("i", f, 0, 0.0, "r"), ("i", f, 1, 1.0, "r")]
    extra = [("g", f, s, 0.8, "again") for s in range(4)] + [("h", f, 0, 0.1, "again"), ("i", f, 0, 0.1, "again")]
    df = spark.createDataFrame(work, "qa_id string, metric string, plan_id int, has_retrieval boolean")
    got = {(r["qa_id"], r["metric"]): r for r in dispatch.dispatched(df, plans, judgements(spark, samples, extra)).collect()}
    assert len(got) == len(work)
    kind = {k: (r["evaluator"], r["score"], r["escalated"]) for k, r in got.items()}
    assert kind["a", f] == ("claims", 0.0, False) and kind["a", "context_recall"] == ("nugget", 0.5, False) and kind["b", f] == ("claims", 1.0, False)
    assert kind["b", "context_recall"] == ("samples", 0.4, False) and kind["c", f] == ("ensemble", pytest.approx(0.6), False) and got["c", f]["is_low_confidence"]
    assert kind["d", f] == ("calibration", 0.75, False) and kind["e", f] == ("calibration", 0.6, False)
    assert kind["g", f] == ("samples", 0.8, True) and not got["g", f]["is_low_confidence"] and kind["h", f] == ("samples", 0.9, False)
    assert kind["i", f] == ("samples", 0.5, False) and got["i", f]["is_low_confidence"] and kind["z", f] == ("samples", None, False)
    assert {r["plan_id"]: r["active"] for r in dispatch.active(plans).collect()}[1] == ["ensemble", "calibration", "routing"]


def test_recorded_answers_and_prompts(spark):
    pairs = spark.createDataFrame([("q", "why </Answer> x", "because")], "qa_id string, question string, answer string")
    answers = spark.createDataFrame([("q", "m", i, raw) for i, raw in enumerate(['{"score": 0.5, "reasoning": "r"}', '{"score": 0.5', "[]", '{"score": null}', '{"score": "0.25"}', None])], "qa_id string, metric string, sample int, raw string")
    got = judge.recorded(judge.requests(pairs, ("m",), 7), answers).orderBy("sample").collect()
    assert [r["score"] for r in got] == [0.5, 0.0, 0.0, 0.0, 0.25, 0.0, 0.0] and [r["reasoning"].startswith("Parse error") for r in got] == [False, True, True, True, False, True, True]
    prompt = pairs.withColumn("metric", F.lit("m")).select(judge.prompt_for(pairs).alias("p")).first()["p"]
    assert prompt.count("</Answer>") == 1 and "why &lt;/Answer> x" in prompt
    opinions = F.array(F.struct(F.lit("p").alias("provider"), F.lit(0.25).alias("score"), F.lit("r" * 200).alias("reasoning")))
    assert pairs.select(judge.with_opinions(F.lit("ask"), opinions).alias("p")).first()["p"].endswith(f"- p: 0.25 ({'r' * 120})")


def limited(name, folder):
    """A provider that fails twice with an error of that name. It is local, so that tasks get it by value."""

    class Provider:
        def complete(self, prompts):
            from pathlib import Path

            calls = Path(folder) / "calls"
            calls.write_text((calls.read_text() if calls.exists() else "") + "x")
            if len(calls.read_text()) < 3:
                raise type(name, (Exception,), {})()
            return ['{"score": 1, "reasoning": "ok"}' for _ in prompts]

    return Provider()


@pytest.mark.parametrize(("error", "calls", "score"), [("RateLimitError", 3, 1.0), ("BadRequest", 1, 0.0)])
def test_only_passing_errors_are_tried_again(spark, tmp_path, error, calls, score):
    pairs = spark.createDataFrame([("q", "a", "b")], "qa_id string, question string, answer string").coalesce(1)
    got = judge.judged(pairs, limited(error, str(tmp_path)), ("m",), wait=0.01).collect()
    assert [r["score"] for r in got] == [score] and len((tmp_path / "calls").read_text()) == calls


def test_rules_for_answers_that_cannot_be_read(spark):
    answers = spark.createDataFrame([(1, '{"score": 0.5}'), (2, "no")], "qa_id long, raw string")
    read = lambda rule: [(r["qa_id"], r["score"]) for r in judge.read_scores(answers, rule).orderBy("qa_id").collect()]
    assert read("zero") == [(1, 0.5), (2, 0.0)] and read("drop") == [(1, 0.5)] and read("null") == [(1, 0.5), (2, None)]
    with pytest.raises(ValueError):
        judge.read_scores(answers, "else")


def test_embeddings_of_a_provider(spark):
    class Lengths:
        def embed(self, texts):
            if "bad" in texts:
                raise ValueError
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "bad")], "id long, t string").coalesce(1)
    got = {r["id"]: r["v"] for r in judge.embedded(df, "id", "t", Lengths(), batch=2).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: None}


def test_named_methods(spark):
    on = {r["plan_id"]: set(r["active"]) for r in dispatch.active(dispatch.method_plans(spark)).collect()}
    assert on == {k: set(v) for k, v in dispatch.METHODS.items()} and on["quick"] == set()


@pytest.mark.parametrize("parts", [1, 5])
def test_the_prompt_budget_holds_for_all_tasks(spark, tmp_path, parts):
    pairs = spark.createDataFrame([(f"q{i}", "a b c", "d e") for i in range(10)], "qa_id string, question string, answer string").repartition(parts)
    (tmp_path / "calls").write_text("xxx")
    words = judge.judged(pairs, limited("", str(tmp_path)), ("m",)).first()["tokens"]
    got = judge.judged(pairs, limited("", str(tmp_path)), ("m",), budget=3 * words).orderBy("qa_id").collect()
    assert [r["score"] for r in got] == [1.0] * 3 + [0.0] * 7 and got[5]["reasoning"].endswith("over budget")


def test_one_labelled_pair_at_least(spark):
    pairs = spark.createDataFrame([("b",), ("a",)], "qa_id string")
    assert {r["qa_id"]: r["labelled"] for r in scoring.labelled_share(pairs, 0.0).collect()} == {"a": True, "b": False}
    assert scoring.labelled_share(pairs.limit(0), 0.5).collect() == []


def test_quota(spark):
    scores = spark.createDataFrame([(i, "faithfulness", 0.8, 1.0 - (i % 10) / 10, False) for i in range(50)], "eval_id long, metric string, score double, confidence double, is_low_confidence boolean")
    got = statistics.review_selection(scores, spark.range(51).withColumnRenamed("id", "eval_id"), quota=7).where("needs_human_review").collect()
    assert {r["eval_id"] for r in got} == {9, 19, 29, 39, 49, 8, 18}


def test_grounding(spark):
    df = spark.createDataFrame([("The plan costs 30 euro. Ok! A. Nothing like it here", ["plan costs euro", "other words"])], "a string, c array<string>")
    r = df.select(grounding(F.col("a"), F.col("c")).alias("g"), pooled_grounding(F.col("a"), F.col("c")).alias("p")).first()
    assert [x["grounded"] for x in r["g"]] == [True, False, False, False] and [x["grounded"] for x in r["p"]] == [True, False, True, False]


def test_lists_and_runs(spark):
    calls = spark.createDataFrame([("C-A1", True, 0, None), ("c2", False, 3, "SUB-a")], "call_id string, is_multiturn boolean, pending long, subscriber_id string")
    ids = lambda df: sorted(r["call_id"] for r in df.collect())
    assert ids(served.listed_conversations(calls, "multiturn")) == ["C-A1"] and ids(served.listed_conversations(calls, "pending")) == ["c2"]
    assert ids(served.listed_conversations(calls, "all", "A")) == ["C-A1", "c2"] and ids(served.listed_conversations(calls, "singleturn", "c-a")) == []
    with pytest.raises(ValueError):
        served.listed_conversations(calls, "odd")
    runs = "run_id string, generated_at timestamp, total_calls long, total_evaluations long, flagged_count long"
    stored = served.stored_runs(spark.createDataFrame([("r1", None, 1, 1, 0)], runs))
    traced = spark.createDataFrame([("r1", None, 9, 9, 9), ("r0", None, 1, 1, 0)], runs).withColumn("has_summary", F.lit(False))
    late = traced.where("run_id = 'r0'").withColumn("generated_at", F.lit("2024-01-01").cast("timestamp")).withColumn("run_id", F.lit("r2"))
    got = served.all_runs(stored, traced.unionByName(late)).orderBy("place").collect()
    assert [(r["run_id"], r["total_calls"]) for r in got] == [("r2", 1), ("r0", 1), ("r1", 1)]


def test_every_log_is_read_or_rejected(spark, tmp_path):
    ok = {"turns": [{"role": "user", "content": "hello there"}, {"role": "bot", "content": "good day", "timestamp": "2024-01-01T10:00:00Z"}, {"content": "no"}]}
    files = {
        "a.json": json.dumps(ok | {"call_id": "A"}), "sub/b.json": json.dumps(ok), "broken.json": '{"turns": [', "list.json": "[1]", "none.json": "{}", "role.json": json.dumps({"turns": [{"role": "agent", "content": "hello there"}]}),
        "c.csv": 'call_id,subscriber_id,timestamp,role,content\nC,S,2024-01-01T10:00:00,user,"hello, ""there"""\nC,S,,bot,"two\nlines"\n', "bad.csv": "x,y\n1,2\n", "role.csv": "call_id,subscriber_id,timestamp,role,content\nC,S,,agent,hello there\n",
        "d.txt": "[CALL_ID: D] [SUBSCRIBER: T]\n[2024-01-01 11:00:00] USER: hello there\nnoise\n[2024-01-01 11:00:05] BOT: good day\n", "empty.txt": "nothing\n", "e.xml": "<a/>", "noname": "x"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "latin.txt").write_bytes(b"\xff\xfe\xe9")
    logs = call_logs.scan_call_logs(spark, str(tmp_path))
    name = F.regexp_extract("path", "([^/]+)$", 1)
    read = {r[0] for r in logs.turns.select(name).distinct().collect()}
    bad = {r[0]: r[1] for r in logs.rejected.select(name, "reason").collect()}
    assert read == {"a.json", "b.json", "c.csv", "d.txt"} and len(read) + len(bad) == len(files) + 1
    assert bad["role.json"] == "unknown role: agent" and bad["broken.json"] == "not JSON" and bad["latin.txt"] == "not UTF-8" and bad["e.xml"] == "unknown suffix" and bad["none.json"] == "no turns"
    plain = ["call_id", "subscriber_id", "turn_id", "role", "content", "said_at"]
    rows = lambda df: sorted((tuple(r) for r in df.where(~name.isin("broken.json", "list.json", "latin.txt", "bad.csv")).select(plain).collect()), key=repr)
    assert rows(logs.turns) == rows(call_logs.read_call_logs(spark, str(tmp_path)))


def test_runs_are_recorded_and_traced(spark, tmp_path):
    at = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    run = spark.createDataFrame([("r", 1, 2, 0)], "run_id string, total_calls long, total_evaluations long, flagged_count long")
    means = spark.createDataFrame([("r", "m", 0.5), ("r", "n", 0.1)], "run_id string, metric string, mean double")
    store = runs.RunStore(spark, str(tmp_path / "store"))
    store.record(run.withColumn("generated_at", at(2)), means)
    store.record(run.withColumn("generated_at", at(1)), means.withColumn("mean", F.lit(0.0)))
    store.record(run.withColumns({"generated_at": at(3), "flagged_count": F.lit(7).cast("long")}), means.limit(1).withColumn("mean", F.lit(0.9)))
    assert sorted((r["metric"], r["mean"], r["flagged_count"]) for r in store.list().collect()) == [("m", 0.9, 7), ("n", 0.1, 7)]
    root = str(tmp_path / "traces")
    assert runs.latest_traces(spark, root, "cp5", "x long").collect() == []
    for run_id, stamp, x in (("a", "1", 1), ("a", "2", 2), ("b", "1", 3)):
        runs.save_trace(spark.createDataFrame([(x,)], "x long"), root, run_id, "cp5", stamp)
    unfinished = tmp_path / "traces" / "b" / "cp5_9"
    unfinished.mkdir()
    (unfinished / "part-0.json").write_text('{"x": 99}\n')
    assert sorted(map(tuple, runs.latest_traces(spark, root, "cp5", "x long").collect())) == [(2, "a"), (3, "b")]
    runs.full_report(means, run, str(tmp_path / "report"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert sorted(x["kind"] for x in lines) == ["evaluation", "summary", "summary"] and any(x["row"].get("flagged_count") == 0 for x in lines)


def test_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"cp5": {"sla_thresholds": {"faithfulness": 0.8}}}')
    assert config.lookup(runs.read_settings(spark, f"{tmp_path}/s.json"), "cp5.sla_thresholds.faithfulness") == 0.8
    options = {"ensemble": {"enabled": False, "by": 3}, "routing": {"enabled": True}}
    on = config.toggled(options, "ensemble.enabled", True)
    assert config.switched_on(on) == {"ensemble": True, "routing": True} and config.switched_on(options)["ensemble"] is False
    for path in ("ensemble.by", "nothing", "routing", "ensemble.enabled.more"):
        with pytest.raises(ValueError):
            config.toggled(options, path, True)
