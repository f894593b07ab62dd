"""Queries over recorded judgements, stored tables, resumed runs and streams, each with the SQL that says the same."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from dialoglens.config import METRICS
from dialoglens.functions.pii import EXTENDED, KOREAN, detected
from dialoglens.functions.numbers import score_band
from dialoglens.functions.text import context_block, grounding, overlap, pooled_grounding, sentences, without_numbering, words
from dialoglens.operators import dispatch, judge, retrieval, scoring, statistics, turns
from dialoglens.plans import served
from dialoglens.plans.queries import BM25_SQL, CI_SQL, EVAL, EVAL_COLUMNS, EXACT, HASHED_SQL, MEANS_SQL, MULTINOMIAL_SQL, QA_SQL, REPLICATES, TERMS_SQL, binned_sql, corpus, halves, mod_100_sql, query, rounded, tokens_sql, trend_sql
from dialoglens.sources import call_logs, runs, views, writers
from dialoglens.sources.progress import Progress
from dialoglens.sources.runs import RunStore
from dialoglens.sources.storage import kept, working_folder
from dialoglens.sources.tables import ChunkIndex
from dialoglens.streaming import scores as streams


def folder(spark, name: str) -> str:
    return f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, event_type NULLS FIRST, value NULLS FIRST) AS nth FROM events WHERE ts IS NOT NULL)
WHERE nth = 1 GROUP BY 1, 2""")
def score_stream(spark, sf_dir):
    """Daily means of all events, sent through a stream in two slices with a stop between."""
    events = views.table(spark, sf_dir, "events")
    return rounded(streams.streamed(events, folder(spark, "days"), streams.daily_means, "5 days"), "mean")


@query("""SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTE AS ended_at, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true))::INT AS fresh FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, session""")
def stream_sessions(spark, sf_dir):
    """Idle sessions of all users, from the same slices."""
    events = views.table(spark, sf_dir, "events")
    found = streams.streamed(events, folder(spark, "sessions"), streams.idle_sessions, "3 days")
    return found.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")), "n")


SCORED_SQL = f""", tr AS (SELECT call_id, string_agg('[' || upper(role) || '] ' || content, chr(10) ORDER BY turn_id) AS transcript FROM v_turns GROUP BY call_id
), tk AS (SELECT q.call_id, turn_index, sha256(concat(q.call_id, '|', turn_index)) AS qa_id, {tokens_sql("question")} AS q, {tokens_sql("answer")} AS a, {tokens_sql("transcript")} AS c FROM v_qa q JOIN tr ON tr.call_id = q.call_id
), ov AS (SELECT *, unnest(['faithfulness', 'answer_relevance', 'context_precision', 'context_recall']) AS metric, unnest([a, a, a, q]) AS of_, unnest([c, q, q, c]) AS among FROM tk)"""


@query(f"""{QA_SQL}{SCORED_SQL} SELECT call_id, turn_index, metric, round(CASE WHEN len(of_) = 0 THEN 0 ELSE len(list_intersect(of_, among)) / len(of_) END, 6) AS score,
  CASE WHEN {mod_100_sql("qa_id")} < 20 THEN 'judge' ELSE 'ppi_classifier' END AS method FROM ov""")
def resumed_scores(spark, sf_dir):
    """A run that is stopped after three of eight batches and taken up again, with the classifier's records beside it."""
    rows = views.turns(spark, sf_dir)
    pairs = turns.question_answer_pairs(rows).join(turns.transcripts(rows), "call_id").withColumn("contexts", F.array(F.struct(F.col("transcript").alias("content"))))
    pairs = kept(scoring.labelled_share(pairs.drop("transcript"), 0.2), "pairs")
    root, asked = folder(spark, "run"), pairs.where("labelled")

    def work(some):
        return scoring.overlap_scores(some).withColumn("method", F.lit("judge"))

    Progress(spark, root, "r").items("cp4", asked, "qa_id", work, only=range(3))
    done = Progress(spark, root, "r").items("cp4", asked, "qa_id", work)
    rest = scoring.classifier_records(pairs.where("not labelled")).drop("confidence")
    every = rest if done is None else done.unionByName(rest)
    return rounded(every.join(pairs.select("qa_id", "call_id", "turn_index"), "qa_id").drop("qa_id"), "score")


CHUNKED_SQL = """, w AS (SELECT {id} AS id, list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '') AS ws FROM {rel}
), p AS (SELECT id, st // 950 AS p, ws[st + 1 : st + 1000] AS pw FROM (SELECT id, ws, unnest(range(0, len(ws), 950)) AS st FROM w) WHERE st = 0 OR st + 50 < len(ws)
), c AS (SELECT id, p, pw, st // 150 AS c, pw[st + 1 : st + 200] AS cw FROM (SELECT id, p, pw, unnest(range(0, len(pw), 150)) AS st FROM p) WHERE st = 0 OR st + 50 < len(pw))"""


@query(CHUNKED_SQL.format(id="doc_id", text="text", rel="documents") + " SELECT id AS source_id, array_to_string(cw, ' ') AS content, len(cw)::INT AS token_count FROM c")
def chunk_index(spark, sf_dir):
    """An index of an older state of the texts, brought up to date: changed texts' buckets are rewritten, no others."""
    texts = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    index = ChunkIndex(spark, folder(spark, "index"))
    older = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(32)) == 0, F.concat_ws(" ", F.lit("older"), "text")).otherwise(F.col("text"))
    index.update(texts.withColumn("text", older), "doc_id", "text")
    index.update(texts, "doc_id", "text")
    return index.scan().select("source_id", "content", "token_count")


@query(CHUNKED_SQL.format(id="doc_id", text="text", rel="documents") + " SELECT id AS source_id, array_to_string(cw, ' ') AS content, length(array_to_string(pw, ' '))::INT AS parent_length FROM c")
def chunk_parents(spark, sf_dir):
    found = retrieval.with_parents(retrieval.chunked(views.table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("source_id", "content", F.length("parent_content").alias("parent_length"))


@query("SELECT eval_id, metric, round(score, 6) AS score, round(confidence, 6) AS confidence, is_low_confidence FROM v_scores")
def upsert_latest(spark, sf_dir):
    """Scores that come in two batches, each evaluation's later events in the second, merged into a bucketed table."""
    rows = views.with_eval(spark, sf_dir).select("eval_id", "metric", "event_id", "score", "confidence", (F.col("confidence") < views.LOW_CONFIDENCE).alias("is_low_confidence"))
    path = folder(spark, "scores")
    for late in (False, True):
        batch = rows.where((F.col("event_id") % 4 >= 2) == late)
        table = writers.upsert(spark, writers.latest(batch, ["eval_id", "metric"], "event_id"), path, ["eval_id", "metric"], "event_id")
    return rounded(table.drop("event_id"), "score", "confidence")


def judge_word_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda x: x <> ''))"


@query(f"""{QA_SQL}, tr AS (SELECT call_id, string_agg('[' || upper(role) || '] ' || content, chr(10) ORDER BY turn_id) AS c FROM v_turns GROUP BY call_id
), w AS (SELECT q.call_id, turn_index, {judge_word_sql("question")} AS q, {judge_word_sql("answer")} AS a, {judge_word_sql("c")} AS c FROM v_qa q JOIN tr USING (call_id)
), m AS (SELECT call_id, turn_index, unnest(['faithfulness', 'answer_relevance', 'context_precision', 'context_recall']) AS metric, unnest([a, a, c, q]) AS of_, unnest([c, q, q, c]) AS among FROM w)
SELECT call_id, turn_index, metric, CASE WHEN len(of_) = 0 THEN 0::DOUBLE ELSE len(list_intersect(of_, among)) / len(of_) END AS score FROM m""")
def judge_batches(spark, sf_dir):
    """All question-answer pairs and metrics through the judges' boundary; the recorded answers are shares of words, from the texts."""
    rows = views.turns(spark, sf_dir)
    pairs = kept(turns.question_answer_pairs(rows).join(turns.transcripts(rows), "call_id"), "pairs")
    q, a, c = (F.array_distinct(words(F.lower(x))) for x in ("question", "answer", "transcript"))
    sets = pairs.select("qa_id", q.alias("q"), a.alias("a"), c.alias("c"))
    share = {"faithfulness": ("a", "c"), "answer_relevance": ("a", "q"), "context_precision": ("c", "q"), "context_recall": ("q", "c")}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), overlap(F.col(x), F.col(y)).alias("score")) for m, (x, y) in share.items())))
    answers = sets.select("qa_id", each.alias("s")).select("qa_id", "s.metric", F.lit(0).alias("sample"), F.to_json(F.struct("s.score", F.lit("shared words").alias("reasoning"))).alias("raw"))
    found = judge.recorded(judge.requests(pairs, list(share)), answers)
    return found.join(pairs.select("qa_id", "call_id", "turn_index"), "qa_id").select("call_id", "turn_index", "metric", "score")


@query("""SELECT eval_id, metric, event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 0 ELSE round(score, 3) END AS score,
  CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'failed' ELSE event_id::VARCHAR END AS reasoning FROM v_events""")
def recorded_answers(spark, sf_dir):
    """Recorded answers of all events: JSON objects, some cut short and some missing."""
    rows = views.with_eval(spark, sf_dir).select("event_id", F.col("eval_id").alias("qa_id"), "metric", F.col("event_id").alias("sample"), "score")
    answer = F.to_json(F.struct(F.round("score", 3).alias("score"), F.col("event_id").cast("string").alias("reasoning")))
    raw = F.when(F.col("event_id") % 11 == 0, F.expr("substr(answer, 1, length(answer) - 1)")).otherwise(F.col("answer"))
    answers = rows.withColumn("answer", answer).where("event_id % 13 <> 0").withColumn("raw", raw)
    found = judge.recorded(rows, answers)
    reasoning = F.when(F.col("reasoning").startswith("Parse error"), "failed").otherwise(F.col("reasoning"))
    return found.select(F.col("qa_id").alias("eval_id"), "metric", F.col("sample").alias("event_id"), "score", reasoning.alias("reasoning"))


#: Judgements that are events; five plans by call.
DISPATCHED_SQL = """, ev AS (SELECT e.eval_id, event_id, metric, score, confidence, v.call_id % 5 AS plan FROM v_events e JOIN v_eval v ON v.eval_id = e.eval_id
), r AS (SELECT DISTINCT eval_id, metric, plan, CASE WHEN metric = 'context_recall' AND plan = 0 AND eval_id % 3 <> 0 THEN 'nugget' WHEN metric = 'faithfulness' AND plan = 0 THEN 'claims'
    WHEN plan = 1 THEN 'ensemble' WHEN plan = 2 THEN 'calibration' ELSE 'samples' END AS evaluator FROM ev
), by_eval AS (SELECT eval_id, count(*) FILTER (score >= 0.5 AND event_id % 5 <> 0) / count(*) AS nuggets, count(*) FILTER (score >= 0.6 AND event_id % 7 <> 0) / count(*) AS claims FROM ev GROUP BY 1
), by_key AS (SELECT eval_id, metric, avg(score) AS mean, coalesce(stddev_pop(score), 0) AS std, bool_or(event_id % 9 <> 0) AS readable,
    sum(round_even(score * 4, 0) / 4 * confidence) FILTER (event_id % 6 <> 0) / nullif(sum(confidence) FILTER (event_id % 6 <> 0), 0) AS expected, avg(score) FILTER (event_id % 9 <> 0) AS read FROM ev GROUP BY 1, 2
), smp AS (SELECT e.eval_id, e.metric, median(score) AS score, coalesce(stddev_pop(score), 0) AS std FROM ev e JOIN by_key k ON k.eval_id = e.eval_id AND k.metric = e.metric WHERE event_id % 9 <> 0 OR NOT readable GROUP BY 1, 2
), xtr AS (SELECT eval_id, metric, median(score * 0.9::DOUBLE + s * 0.02::DOUBLE) AS score, coalesce(stddev_pop(score * 0.9::DOUBLE + s * 0.02::DOUBLE), 0) AS std FROM ev, range(0, 4) t(s) GROUP BY 1, 2
), fst AS (SELECT r.*, CASE evaluator WHEN 'nugget' THEN nuggets WHEN 'claims' THEN claims WHEN 'ensemble' THEN mean WHEN 'calibration' THEN coalesce(expected, read, 0) ELSE s.score END AS score,
    CASE evaluator WHEN 'ensemble' THEN greatest(0, 1 - k.std / 0.5) WHEN 'samples' THEN greatest(0, 1 - s.std / 0.5) ELSE 1 END AS confidence,
    CASE evaluator WHEN 'ensemble' THEN k.std > 0.25 WHEN 'samples' THEN s.std > 0.2 ELSE false END AS low
  FROM r JOIN by_eval b ON b.eval_id = r.eval_id JOIN by_key k ON k.eval_id = r.eval_id AND k.metric = r.metric JOIN smp s ON s.eval_id = r.eval_id AND s.metric = r.metric
), fin AS (SELECT f.*, low AND plan IN (0, 3) AND evaluator <> 'ensemble' AS escalated, x.score AS xs, x.std AS xstd FROM fst f JOIN xtr x ON x.eval_id = f.eval_id AND x.metric = f.metric)
SELECT eval_id, metric, evaluator, round(CASE WHEN escalated THEN xs ELSE score END, 6) AS score, round(CASE WHEN escalated THEN greatest(0, 1 - xstd / 0.5) ELSE confidence END, 6) AS confidence,
  CASE WHEN escalated THEN xstd > 0.2 ELSE low END AS is_low_confidence, escalated FROM fin"""


@query(DISPATCHED_SQL)
def dispatched_scores(spark, sf_dir):
    """Every evaluation and metric through its plan's evaluator; doubtful ones of two plans judged again."""
    ev = views.with_eval(spark, sf_dir).withColumnRenamed("eval_id", "qa_id")
    plan = views.evaluations(spark, sf_dir).select(F.col("eval_id").alias("qa_id"), (F.col("call_id") % 5).cast("int").alias("plan_id"))
    ev = kept(ev.join(plan, "qa_id").select("qa_id", "event_id", "metric", "score", "confidence", "plan_id"), "judgements")
    plans = spark.createDataFrame([(0, True, True, False, False, True), (1, False, False, True, False, True), (2, False, False, False, True, True), (3, False, False, False, False, True), (4, False, False, False, False, False)], "plan_id int, " + ", ".join(f"{s} boolean" for s in dispatch.SWITCHES))
    work = ev.select("qa_id", "metric", "plan_id").distinct().withColumn("has_retrieval", F.col("qa_id") % 3 != 0)
    named = ev.withColumn("text", F.concat(F.lit("point "), F.col("event_id").cast("string"))).withColumn("place", F.lit(0))
    lists = named.groupBy("qa_id").agg(F.sort_array(F.collect_list(F.concat(F.lit(" "), "text"))).alias("claims"), F.sort_array(F.collect_list("text")).alias("nuggets"))
    verdict = F.when(F.col("score") >= 0.6, "supported").when(F.col("score") < 0.3, "contradicted").otherwise("unclear")
    token = F.when(F.col("event_id") % 6 == 0, "none").otherwise((F.bround(F.col("score") * 4, 0) / 4).cast("string"))
    reasoning = F.when(F.col("event_id") % 9 == 0, "Parse error: {").otherwise("read")
    # places are the order in which the SQL's joins hand out rows: a deviation that equals a threshold is above it or not by that order
    extra = ev.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("qa_id", "metric", (F.col("event_id") * 4 + F.col("s")).alias("sample"), (F.col("score") * 0.9 + F.col("s") * 0.02).alias("score"), F.lit("again").alias("reasoning"), F.col("s").alias("place"))
    said = dispatch.Judgements(
        claims=lists.select("qa_id", "claims"), verdicts=named.where("event_id % 7 <> 0").select("qa_id", F.col("text").alias("claim"), verdict.alias("verdict"), "place"),
        nuggets=lists.select("qa_id", "nuggets"), matches=named.where("event_id % 5 <> 0").select("qa_id", F.col("text").alias("nugget"), (F.col("score") >= 0.5).alias("found"), "place"),
        providers=ev.select("qa_id", "metric", F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("provider"), "score", F.col("event_id").alias("place")),
        tokens=ev.select("qa_id", "metric", token.alias("token"), F.col("confidence").alias("prob"), F.col("event_id").alias("place")),
        samples=ev.select("qa_id", "metric", F.col("event_id").alias("sample"), "score", reasoning.alias("reasoning"), (-F.col("event_id")).alias("place")), extra=extra)
    out = dispatch.dispatched(work, plans, said).withColumnRenamed("qa_id", "eval_id")
    return rounded(out, "score", "confidence")


HALF_SQL = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
LISTS_SQL = f""", benchmark AS (SELECT item_id * 10 + o AS item_id, CASE o WHEN 0 THEN text WHEN 1 THEN array_to_string({HALF_SQL}[1 : len({HALF_SQL}) // 2], ' ') ELSE array_to_string({HALF_SQL}[len({HALF_SQL}) // 2 + 1 :], ' ') END AS text
  FROM main.benchmark, range(0, 3) t(o))"""


@query(f"""{LISTS_SQL}{BM25_SQL}{HASHED_SQL}, ff AS (SELECT query_id, doc_id, round(sum(part), 12) AS score FROM (
  SELECT query_id // 10 AS query_id, doc_id, 0.7::DOUBLE / (60 + rank) AS part FROM hk UNION ALL SELECT query_id // 10, doc_id, 0.3::DOUBLE / (60 + rank) FROM bm) GROUP BY 1, 2)
SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM ff QUALIFY rank < 20""")
def fan_out_fusion(spark, sf_dir):
    """Each passage and its two halves as rewrites: six lists a question in one fusion."""
    queries, chunks = corpus(spark, sf_dir)
    w = words(F.col("query"))
    half = F.floor(F.size(w) / 2).cast("int")
    parts = queries.select("query_id", F.posexplode(F.array(F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " "))).alias("at", "query"))
    found = retrieval.fan_out_search(queries, parts.select("query_id", (F.col("at") + 1).alias("ordinal"), "query"), chunks, 20)
    return rounded(found.select("query_id", "chunk_id", "score", "rank"), "score")


@query("""SELECT event_id, round(cost, 6) AS cost, round((upto - parts) / 1e6, 6) AS spent, upto - parts < 25000000 AS kept FROM (
  SELECT *, sum(parts) OVER (ORDER BY event_id) AS upto FROM (SELECT *, round(cost * 1e6)::BIGINT AS parts FROM (
    SELECT event_id, ((event_id % 1000 + 100) * coalesce(i, 0) + (event_id % 700) * coalesce(o, 0)) / 1e6 AS cost FROM events LEFT JOIN (VALUES ('click', 1.0, 2.0), ('view', 3.0, 15.0), ('error', 2.0, 8.0)) m(name, i, o) ON event_type = name)))""")
def cost_budget(spark, sf_dir):
    """Judge calls in order until 25 dollars are spent, whatever the partitions."""
    calls = views.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), (F.col("event_id") % 1000 + 100).alias("tokens_in"), (F.col("event_id") % 700).alias("tokens_out"))
    prices = spark.createDataFrame([("click", 1.0, 2.0), ("view", 3.0, 15.0), ("error", 2.0, 8.0)], "model string, price_in double, price_out double")
    return rounded(statistics.budgeted(calls, prices, ["event_id"], 25.0).select("event_id", "cost", "spent", "kept"), "cost", "spent")


@query(""", thr AS (SELECT *, CASE metric WHEN 'faithfulness' THEN 0.8 WHEN 'answer_relevance' THEN 0.75 WHEN 'context_precision' THEN 0.7 WHEN 'context_recall' THEN 0.7 END::DOUBLE AS t FROM v_scores
), pr AS (SELECT eval_id, round(sum(1 - confidence + CASE WHEN is_low_confidence THEN 0.5 ELSE 0 END + CASE WHEN abs(score - t) < 0.1::DOUBLE THEN (0.1::DOUBLE - abs(score - t)) * 10 ELSE 0 END) / count(*), 9) AS priority FROM thr GROUP BY eval_id
), top AS (SELECT eval_id FROM pr ORDER BY priority DESC, eval_id LIMIT 20)
SELECT eval_id, call_id, eval_id IN (SELECT eval_id FROM top) AS needs_human_review FROM v_eval""")
def review_selection(spark, sf_dir):
    return statistics.review_selection(views.scores(spark, sf_dir), views.evaluations(spark, sf_dir)).select("eval_id", "call_id", "needs_human_review")


@query(""", p AS (SELECT s.metric, s.score AS judge, r.human_score AS human FROM v_scores s JOIN v_reviews r ON r.eval_id = s.eval_id AND r.metric = s.metric
), r AS (SELECT metric, judge, human, rank() OVER (PARTITION BY metric ORDER BY judge) + (count(*) OVER (PARTITION BY metric, judge) - 1) / 2 AS rj, rank() OVER (PARTITION BY metric ORDER BY human) + (count(*) OVER (PARTITION BY metric, human) - 1) / 2 AS rh,
    least(4, greatest(0, round_even(judge * 4, 0)))::INT AS bj, least(4, greatest(0, round_even(human * 4, 0)))::INT AS bh FROM p
), k AS (SELECT metric, count(*) AS n, avg(abs(judge - human)) AS mae, coalesce(corr(rj, rh), 0) AS spearman, avg((bj = bh)::INT) AS po FROM r GROUP BY 1
), e AS (SELECT k.metric, coalesce(sum(a.c * b.c), 0)::DOUBLE / any_value(n * n) AS pe FROM k LEFT JOIN (SELECT metric, bj, count(*) AS c FROM r GROUP BY 1, 2) a ON a.metric = k.metric LEFT JOIN (SELECT metric, bh, count(*) AS c FROM r GROUP BY 1, 2) b ON b.metric = k.metric AND a.bj = b.bh GROUP BY 1)
SELECT k.metric, n, round(mae, 6) AS mae, round(spearman, 6) AS spearman, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1 END, 6) AS kappa FROM k JOIN e ON e.metric = k.metric""")
def meta_eval_by_metric(spark, sf_dir):
    scores = views.scores(spark, sf_dir).withColumnRenamed("eval_id", "qa_id")
    golden = views.reviews(spark, sf_dir).withColumnRenamed("eval_id", "qa_id")
    return rounded(statistics.meta_evaluation(kept(statistics.golden_pairs(scores, golden), "golden"), "metric"), "mae", "spearman", "kappa")


RUNS_SQL = """, traced AS (SELECT run_id, CASE WHEN right(run_id, 1) = '5' THEN NULL ELSE max(evaluated_at) END AS generated_at, count(DISTINCT call_id) AS total_calls, count(*) AS total_evaluations FROM v_eval GROUP BY 1
), flags AS (SELECT run_id, count(DISTINCT call_id) AS flagged_count FROM v_eval JOIN v_sla USING (eval_id) WHERE score < sla GROUP BY 1
), every AS (SELECT t.*, coalesce(flagged_count, 0) AS flagged_count, right(t.run_id, 1) IN ('0', '2', '4', '6', '8') AS stored FROM traced t LEFT JOIN flags f ON f.run_id = t.run_id)"""


@query(f"{RUNS_SQL} SELECT run_id, generated_at, total_calls, total_evaluations, flagged_count, stored OR generated_at IS NOT NULL AS has_summary, row_number() OVER (ORDER BY generated_at DESC NULLS LAST, run_id) AS place FROM every")
def run_index(spark, sf_dir):
    """Runs of the store (those of even days) and those that only traces know, the latest first."""
    stored, traced = run_tables(spark, sf_dir)
    return served.all_runs(stored, traced)


def run_tables(spark, sf_dir):
    ev, scores = views.evaluations(spark, sf_dir), views.scores(spark, sf_dir)
    at = F.when(~F.col("run_id").endswith("5"), F.col("at"))
    runs = ev.groupBy("run_id").agg(F.max("evaluated_at").alias("at"), F.countDistinct("call_id").alias("total_calls"), F.count(F.lit(1)).alias("total_evaluations")).withColumn("generated_at", at).drop("at")
    low = scores.where(statistics.below_sla()).join(ev, "eval_id").groupBy("run_id").agg(F.countDistinct("call_id").alias("flagged_count"))
    runs = kept(runs.join(low, "run_id", "left").withColumn("flagged_count", F.coalesce("flagged_count", F.lit(0))), "runs")
    return served.stored_runs(runs.where("right(run_id, 1) in ('0', '2', '4', '6', '8')")), runs.withColumn("has_summary", F.col("generated_at").isNotNull())


@query(f"{MEANS_SQL}{RUNS_SQL} SELECT e.run_id, generated_at, flagged_count, metric, mean FROM every e LEFT JOIN means m ON m.run_id = e.run_id WHERE stored")
def run_metrics(spark, sf_dir):
    stored, _ = run_tables(spark, sf_dir)
    means = served.run_means(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir)).drop("n")
    return served.run_scores(stored, means).select("run_id", "generated_at", "flagged_count", "metric", "mean")


@query("""SELECT call_id, tenant_id, count(*) FILTER (level = 'turn') > 1 AS is_multiturn, count(*) FILTER (level = 'turn' AND review_status = 'pending') AS pending FROM v_eval
  GROUP BY call_id, tenant_id HAVING pending > 0 AND contains(call_id::VARCHAR, '1')""")
def conversation_search(spark, sf_dir):
    found = served.conversations(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir))
    return served.listed_conversations(found, "pending", "1").select("call_id", "tenant_id", "is_multiturn", "pending")


@query(f"SELECT {EVAL} FROM v_eval QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY eval_id) = 1")
def drill_calls(spark, sf_dir):
    return served.drill_down(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir), "calls").select(EVAL_COLUMNS)


@query(f"SELECT {EVAL} FROM v_eval WHERE eval_id IN (SELECT eval_id FROM v_scores WHERE metric = 'context_recall' AND score < 0.8)")
def drill_metric(spark, sf_dir):
    return served.drill_down(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir), "metric", "context_recall").select(EVAL_COLUMNS)


@query("""SELECT call_id, tenant_id, min(evaluated_at) AS started_at, row_number() OVER (ORDER BY min(evaluated_at) DESC, call_id, tenant_id) AS place FROM v_eval GROUP BY call_id, tenant_id
  ORDER BY started_at DESC, call_id, tenant_id LIMIT 50 OFFSET 5""")
def conversations_page(spark, sf_dir):
    found = served.conversations(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir))
    return served.conversation_page(found, 50, 5).select("call_id", "tenant_id", "started_at", "place")


@query(f"""{trend_sql("run_id")} ORDER BY tenant_id, bucket, metric LIMIT 100""")
def trend_page(spark, sf_dir):
    points = served.trends(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir), "run")
    return points.orderBy("tenant_id", "bucket", "metric").limit(100)


@query("SELECT DISTINCT metric FROM v_scores WHERE metric IS NOT NULL")
def score_metrics(spark, sf_dir):
    return served.score_metrics(views.scores(spark, sf_dir))


def said_words_sql(text: str, marks: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '{marks}', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2)"


MARKS_SQL, POOLED_SQL = "[.,!?·…\"''()\\[\\]]", "[.,!?·…]"
S1, Q1 = f"list_distinct({said_words_sql('s', MARKS_SQL)})", f"list_distinct({said_words_sql('question', MARKS_SQL)})"
S2, Q2 = said_words_sql("s", POOLED_SQL), said_words_sql("question", POOLED_SQL)


@query(f"""{QA_SQL}, g AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(answer, '([.!?。])\\s+', '\\1' || chr(10), 'g'), chr(10) || '+'), lambda x: trim(x) <> '') AS s1,
    list_filter(string_split(regexp_replace(answer, '([.!?。])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s2 FROM v_qa)
SELECT call_id, turn_index, len(s1) AS sentences, len(list_filter(s1, lambda s: len({S1}) > 0 AND len(list_intersect({S1}, {Q1})) / len({S1}) >= 0.3)) AS grounded, len(s2) AS pooled_sentences,
  len(list_filter(s2, lambda s: len({S2}) = 0 OR len(list_filter({S2}, lambda w: list_contains({Q2}, w))) / len({S2}) >= 0.3)) AS pooled_grounded FROM g""")
def evidence_grounding(spark, sf_dir):
    """How many of an answer's sentences its question grounds, by both rules."""
    pairs = turns.question_answer_pairs(views.turns(spark, sf_dir))
    found = pairs.select("call_id", "turn_index", grounding(F.col("answer"), F.array("question")).alias("g"), pooled_grounding(F.col("answer"), F.array("question")).alias("p"))
    counts = {f"{name}{what}": F.size(F.filter(c, lambda x: x["grounded"]) if what == "grounded" else c).cast("long") for name, c in (("", F.col("g")), ("pooled_", F.col("p"))) for what in ("sentences", "grounded")}
    return found.select("call_id", "turn_index", *(c.alias(n) for n, c in counts.items()))


@query(""", cx AS (SELECT v.tenant_id, CASE WHEN event_id % 50 = 0 THEN '' ELSE 'c' || (event_id % 500) END AS chunk, CASE WHEN event_id % 11 = 0 THEN 'doc' ELSE e.user_id::VARCHAR END AS source FROM v_events e JOIN v_eval v ON v.eval_id = e.eval_id WHERE level = 'turn')
SELECT tenant_id, count(DISTINCT chunk) FILTER (chunk <> '') AS chunk_count, count(DISTINCT source) AS document_count, array_to_string(list_sort(list(DISTINCT source))[1:10], ',') AS source_names FROM cx GROUP BY 1""")
def knowledge_sources(spark, sf_dir):
    ev = views.with_eval(spark, sf_dir)
    chunk = F.when(F.col("event_id") % 50 == 0, "").otherwise(F.concat(F.lit("c"), (F.col("event_id") % 500).cast("string")))
    contexts = ev.select("eval_id", chunk.alias("chunk_id"), F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("source"))
    return served.knowledge_sources(views.evaluations(spark, sf_dir), contexts).withColumn("source_names", F.array_join("source_names", ","))


@query("""SELECT eval_id, metric, round(sum(round_even(score * 4, 0) / 4 * confidence) FILTER (event_id % 6 <> 0) / nullif(sum(confidence) FILTER (event_id % 6 <> 0), 0), 6) AS score FROM v_events GROUP BY 1, 2""")
def expected_scores(spark, sf_dir):
    token = F.when(F.col("event_id") % 6 == 0, "none").otherwise((F.bround(F.col("score") * 4, 0) / 4).cast("string"))
    rows = views.with_eval(spark, sf_dir).select("eval_id", "metric", token.alias("token"), F.col("confidence").alias("prob"), F.col("event_id").alias("place"))
    return rounded(scoring.expected_score(rows, "eval_id", "metric"), "score")


def found_sql(patterns) -> str:
    """The names of the patterns that occur, each looked for in what those before it left."""
    rest, names = "text", []
    for name, pattern in patterns:
        names.append(f"CASE WHEN regexp_matches({rest}, '{pattern}') THEN '{name}' END")
        rest = f"regexp_replace({rest}, '{pattern}', '_', 'g')"
    return f"concat_ws(',', {', '.join(names)})"


@query(f"SELECT doc_id, {found_sql(KOREAN)} AS pii FROM documents")
def pii_names(spark, sf_dir):
    return detected(views.table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", F.array_join("pii", ",").alias("pii"))


@query(f"SELECT d.doc_id, CASE WHEN {found_sql(EXTENDED)} <> '' THEN 0 ELSE coalesce(1 - toxic, 1) END::DOUBLE AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def safety_scores(spark, sf_dir):
    judged = views.table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("toxic")).cast("double").alias("score"))
    return scoring.safety(views.table(spark, sf_dir, "documents"), "doc_id", "text", judged, EXTENDED).select("doc_id", "score")


@query(f"""SELECT tenant_id, bucket, {", ".join(f"max(avg_score) FILTER (metric = '{m}') AS {m}" for m in METRICS)} FROM ({trend_sql("run_id")}) GROUP BY 1, 2""")
def trend_table(spark, sf_dir):
    return served.trend_points(served.trends(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir), "run"), list(METRICS))


@query("""SELECT e.eval_id, call_id, string_agg(coalesce(s.metric, r.metric) || '=' || round(coalesce(r.human_score, s.score) * 1e6)::BIGINT, ';' ORDER BY coalesce(s.metric, r.metric)) AS scores, max(s.score) FILTER (s.metric = 'faithfulness') AS faithfulness
  FROM v_eval e LEFT JOIN (v_scores s FULL JOIN v_reviews r ON s.eval_id = r.eval_id AND s.metric = r.metric) ON e.eval_id = coalesce(s.eval_id, r.eval_id) GROUP BY 1, 2""")
def nested_scores(spark, sf_dir):
    """Evaluations with all their scores in one array, and one metric's picked out of it."""
    rows = served.assembled(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir), views.reviews(spark, sf_dir))
    text = F.array_join(F.transform("scores", lambda s: F.concat_ws("=", s["metric"], F.round(s["final_score"] * 1e6).cast("long").cast("string"))), ";")
    plain = F.transform("scores", lambda s: F.struct(s["metric"].alias("metric"), s["auto_score"].alias("score")))
    return rows.select("eval_id", "call_id", text.alias("scores"), scoring.score_of(plain, "faithfulness").alias("faithfulness"))


@query(f"""SELECT metric, c AS current, p AS previous, c - p AS delta, c - p < -0.05 AS is_regression FROM (
  SELECT metric, {EXACT.replace("score", "score").replace("sum(", "sum(").replace("count(score)", "count(score) FILTER (late)").replace("::BIGINT)", "::BIGINT) FILTER (late)")} AS c,
    {EXACT.replace("count(score)", "count(score) FILTER (NOT late)").replace("::BIGINT)", "::BIGINT) FILTER (NOT late)")} AS p
  FROM (SELECT s.metric, s.score, day(e.evaluated_at) > 15 AS late FROM v_scores s JOIN v_eval e USING (eval_id)) GROUP BY 1) WHERE c IS NOT NULL AND p IS NOT NULL""")
def regressions(spark, sf_dir):
    from dialoglens.functions.numbers import exact_mean

    now, before = (h.groupBy("metric").agg(exact_mean(F.col("score")).alias("mean")) for h in halves(spark, sf_dir))
    return statistics.regressions(now, before)


@query(f"SELECT {EVAL} FROM v_eval QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY evaluated_at, eval_id) = 1")
def first_records(spark, sf_dir):
    rows = views.evaluations(spark, sf_dir).withColumn("order_", F.struct("evaluated_at", "eval_id"))
    return writers.first_per_call(rows, "order_").select(EVAL_COLUMNS)


@query("SELECT eval_id AS qa_id, metric, round(confidence, 6) AS human_score FROM v_events WHERE true QUALIFY row_number() OVER (PARTITION BY eval_id, metric ORDER BY event_id DESC) = 1 AND event_id % 4 <> 1")
def golden_set(spark, sf_dir):
    """The last review of each evaluation and metric, from a log; some only approve and give no value."""
    log = views.with_eval(spark, sf_dir).select("eval_id", "metric", F.when(F.col("event_id") % 4 != 1, F.col("confidence")).alias("human_score"), F.col("event_id").alias("reviewed_at"))
    return rounded(writers.golden_set(log), "human_score")


@query(f"{MEANS_SQL}{RUNS_SQL} SELECT e.run_id, generated_at, total_calls, total_evaluations, flagged_count, metric, mean, n FROM every e LEFT JOIN means m ON m.run_id = e.run_id WHERE generated_at IS NOT NULL")
def stored_runs(spark, sf_dir):
    """All dated runs recorded twice, the second time with what is true now, and listed with their metrics."""
    _, traced = run_tables(spark, sf_dir)
    now = traced.drop("has_summary").where("generated_at is not null")
    means = served.run_means(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir))
    store = RunStore(spark, folder(spark, "runs"))
    older = now.withColumns({"generated_at": F.col("generated_at") - F.expr("interval 1 day"), "flagged_count": F.lit(0).cast("long")})
    store.record(older, means.withColumn("mean", F.lit(0.5)))
    store.record(now, means)
    return store.list()


@query(f"{MEANS_SQL} SELECT run_id, metric, mean, n FROM means")
def run_traces(spark, sf_dir):
    """Each run's means as JSON traces, saved twice; the newest of each is read."""
    means, root = kept(served.run_means(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir)), "means"), folder(spark, "traces")
    for stamp, table in (("20240101", means.withColumn("mean", F.lit(0.0))), ("20240102", means)):
        for half in (0, 1):  # two runs' worth of folders, whatever the number of runs
            runs.save_trace(table.where(F.pmod(F.xxhash64("run_id"), F.lit(2)) == half).withColumnRenamed("run_id", "of"), root, f"half{half}", "cp5_audit_summary", stamp)
    found = runs.latest_traces(spark, root, "cp5_audit_summary", "of string, metric string, mean double, n long")
    return found.select(F.col("of").alias("run_id"), "metric", "mean", "n")


@query(f"""SELECT {EVAL} FROM v_eval WHERE tenant_id = 1 AND review_status = 'pending' AND eval_id IN (SELECT eval_id FROM v_scores WHERE metric = 'faithfulness' AND score < 0.7) AND eval_id IN (SELECT eval_id FROM v_scores WHERE is_low_confidence)
  UNION ALL SELECT {EVAL} FROM v_eval WHERE run_id = 'run_20240110' AND call_id = 7""")
def evals_scoped(spark, sf_dir):
    ev, scores = views.evaluations(spark, sf_dir), views.scores(spark, sf_dir)
    both = served.filtered(ev, scores, tenant=1, status="pending", metric="faithfulness", limit=0.7, low=True).unionByName(served.filtered(ev, scores, run="run_20240110", call=7))
    return both.select(EVAL_COLUMNS)


@query("""SELECT call_id, string_agg(CASE role WHEN 'user' THEN 'Customer' WHEN 'bot' THEN 'Agent' ELSE role END || ': ' || content, chr(10) ORDER BY turn_id) AS dialogue,
  string_agg(nth || '. ' || content, chr(10) ORDER BY turn_id) FILTER (role = 'bot') AS answers, coalesce(string_agg('[' || nth || '] (chunk_id=' || turn_id || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY turn_id) FILTER (role = 'bot'), '(none)') AS block
  FROM (SELECT *, row_number() OVER (PARTITION BY call_id, role ORDER BY turn_id) AS nth FROM v_turns) GROUP BY call_id""")
def call_texts(spark, sf_dir):
    """The texts that judges read: a dialogue with names, numbered answers, answers as a block of contexts."""
    rows = views.turns(spark, sf_dir)
    listed = rows.groupBy("call_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "bot", F.struct("turn_id", "content")))).alias("l"))
    block = listed.select("call_id", context_block(F.transform("l", lambda x: F.struct(x["turn_id"].cast("string").alias("chunk_id"), x["content"].alias("content")))).alias("block"))
    out = turns.dialogues(rows, {"user": "Customer", "bot": "Agent"}).join(turns.bot_answer_lists(rows).drop("n_answers"), "call_id", "left")
    return out.join(block, "call_id").select("call_id", "dialogue", "answers", "block")


@query(r"""SELECT call_id, turn_id, len(list_filter(regexp_split_to_array(content, '[.!?。\n]'), lambda x: length(trim(x)) > 3)) AS n_sentences, regexp_replace(trim(content), '^[0-9.\-) ]+', '') AS bare FROM v_turns""")
def turn_sentences(spark, sf_dir):
    return views.turns(spark, sf_dir).select("call_id", "turn_id", F.size(sentences(F.col("content"))).cast("long").alias("n_sentences"), without_numbering(F.col("content")).alias("bare"))


@query("""SELECT eval_id, metric, round(score, 4) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'middle' ELSE 'low' END AS band FROM v_scores""")
def score_bands(spark, sf_dir):
    return views.scores(spark, sf_dir).select("eval_id", "metric", F.round("score", 4).alias("score"), score_band(F.col("score")).alias("band"))


@query("""SELECT call_id, metric, round(score, 6) AS score FROM (
  SELECT call_id, unnest(['resolution', 'efficiency', 'escalation_handling']) AS metric, unnest([coalesce(r, resolved::INT), coalesce(e, 1), CASE WHEN needed THEN 0 ELSE 1 END::DOUBLE]) AS score
  FROM (SELECT call_id, bool_or(review_status = 'approved') AS resolved, CASE WHEN call_id % 2 = 0 THEN min(eval_id) % 10 / 10 END AS r, CASE WHEN count(*) > 12 THEN 0.5 END::DOUBLE AS e, bool_or(review_status = 'skipped') AS needed FROM v_eval GROUP BY call_id)
  UNION ALL SELECT e.call_id, 'consistency', CASE WHEN n < 2 THEN 1 WHEN e.call_id % 5 = 0 THEN 0.4 ELSE (e.call_id % 3 <> 0)::INT END FROM (SELECT DISTINCT call_id FROM v_eval) e JOIN (SELECT call_id, count(*) FILTER (role = 'bot') AS n FROM v_turns GROUP BY 1) t ON t.call_id = e.call_id
  UNION ALL SELECT e.call_id, 'gt_similarity', greatest(0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) FROM (SELECT DISTINCT call_id FROM v_eval) e JOIN embeddings a ON a.vec_id = e.call_id JOIN embeddings b ON b.vec_id = e.call_id + 1)""")
def session_reports(spark, sf_dir):
    """Session metrics with given and missing scores, consistency of the calls' answers, likeness of two vectors."""
    by = views.evaluations(spark, sf_dir).groupBy("call_id").agg(
        F.bool_or(F.col("review_status") == "approved").alias("resolved"), F.min("eval_id").alias("first"),
        F.when(F.count(F.lit(1)) > 12, 0.5).alias("efficiency_score"), F.bool_or(F.col("review_status") == "skipped").alias("escalation_needed"))
    by = by.withColumn("resolution_score", F.when(F.col("call_id") % 2 == 0, F.col("first") % 10 / 10))
    answers = turns.session_shape(views.turns(spark, sf_dir)).select("call_id", F.col("bot_turns").alias("n_answers"))
    judged = answers.select("call_id", F.when(F.col("call_id") % 5 == 0, 0.4).alias("score"), (F.col("call_id") % 3 != 0).alias("consistent"))
    v = views.table(spark, sf_dir, "embeddings")
    similar = v.select(F.col("vec_id").alias("call_id"), F.col("embedding").alias("answers")).join(v.select((F.col("vec_id") - 1).alias("call_id"), F.col("embedding").alias("truth")), "call_id")
    return rounded(scoring.session_evaluations(by, scoring.consistency(answers, judged), similar), "score")


@query("""SELECT call_id::VARCHAR AS call_id, 'S' || call_id AS subscriber_id, row_number() OVER (PARTITION BY call_id ORDER BY turn_id) - 1 AS turn_id, role, CASE call_id % 3 WHEN 2 THEN trim(regexp_replace(content, '\\s+', ' ', 'g')) ELSE content END AS content FROM v_turns""")
def log_files(spark, sf_dir):
    """All calls written as logs, a file each, JSON, CSV and text by turns, beside files that are none, and read in one scan."""
    rows = turns.in_order(views.turns(spark, sf_dir)).withColumn("id", F.col("call_id").cast("string"))
    path, kind = folder(spark, "logs"), F.col("call_id") % 3
    said = F.array_sort(F.collect_list(F.struct("turn_id", "role", "content")))
    calls = rows.groupBy("call_id", "id").agg(said.alias("t"))
    subscriber = F.concat(F.lit("S"), F.col("id"))
    listed = calls.where(kind == 0).select(F.col("call_id").alias("c"), F.struct(F.col("id").alias("call_id"), subscriber.alias("subscriber_id"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns")).alias("o"))
    # a row is a file; a folder for each call would cost as much as its file. Files take the time, not bytes, so all cores get some
    tasks = 4 * spark.sparkContext.defaultParallelism
    listed.repartition(tasks, "c").select("o.*").write.option("maxRecordsPerFile", 1).json(f"{path}/json")
    table = rows.where(kind == 1).select(F.col("call_id").alias("c"), "id", subscriber.alias("subscriber_id"), F.lit("").alias("timestamp"), "role", "content", "place").withColumnRenamed("id", "call_id")
    table.repartition(tasks, "c").sortWithinPartitions("c", "place").drop("place").write.partitionBy("c").option("header", True).option("escape", '"').csv(f"{path}/csv")
    line = lambda x: F.concat(F.lit("[-] "), F.upper(x["role"]), F.lit(": "), F.regexp_replace(x["content"], r"\s+", " "))
    head = F.concat(F.lit("[CALL_ID: "), F.col("id"), F.lit("] [SUBSCRIBER: "), subscriber, F.lit("]"))
    calls.where(kind == 2).repartition(tasks, "call_id").select(F.array_join(F.concat(F.array(head), F.transform("t", line)), "\n").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/text")
    spark.createDataFrame([("{",)], "value string").coalesce(1).write.text(f"{path}/bad")
    return call_logs.scan_call_logs(spark, path).turns.select("call_id", "subscriber_id", F.col("turn_id").cast("long").alias("turn_id"), "role", "content")


@query("SELECT eval_id::VARCHAR AS qa_id, metric, human_score FROM (SELECT eval_id, metric, round(confidence, 3) AS human_score, row_number() OVER (PARTITION BY eval_id, metric ORDER BY event_id DESC) AS nth FROM v_events) WHERE nth = 1")
def golden_file(spark, sf_dir):
    """A golden set of JSON lines with broken ones between; the last line of a key counts."""
    rows = views.with_eval(spark, sf_dir).select("event_id", F.to_json(F.struct(F.col("eval_id").cast("string").alias("qa_id"), "metric", F.round("confidence", 3).alias("human_score"))).alias("line"))
    path = folder(spark, "golden")
    lines = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"qa_id": '), F.lit("\n"), "line")).otherwise(F.col("line"))
    rows.select("event_id", lines.alias("value")).repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return call_logs.read_golden(spark, path)


@query("SELECT eval_id, metric, round(confidence, 6) AS human_score, event_id AS reviewed_at FROM v_events QUALIFY row_number() OVER (PARTITION BY eval_id, metric ORDER BY event_id DESC) = 1")
def review_log(spark, sf_dir):
    """Reviews appended to a log in two batches; the last of each evaluation and metric."""
    rows = views.with_eval(spark, sf_dir).select("eval_id", "metric", F.round("confidence", 6).alias("human_score"), F.col("event_id").alias("reviewed_at"))
    path = folder(spark, "reviews")
    for late in (False, True):
        writers.record_reviews(rows.where((F.col("reviewed_at") % 4 >= 2) == late), path)
    return writers.latest_reviews(spark.read.parquet(path))


def renamed(sql: str, mark: str) -> str:
    return re.sub(r"\b(vals|spans|bins|chain|reps|bounds|ci)\b", rf"\1_{mark}", sql)


def half_sql(late: str, mark: str) -> str:
    values = f"SELECT s.metric, s.score, 0 AS now FROM v_scores s JOIN v_eval e USING (eval_id) WHERE {late} day(e.evaluated_at) > 15"
    return renamed(binned_sql(values) + MULTINOMIAL_SQL + CI_SQL, mark)


@query(f"""{half_sql("", "a")}{half_sql("NOT", "b")} SELECT a.metric, round(a.low - b.high, 6) AS ci_low, round(a.high - b.low, 6) AS ci_high FROM ci_a a JOIN ci_b b ON a.metric = b.metric""")
def delta_interval(spark, sf_dir):
    return rounded(statistics.delta_ci(*halves(spark, sf_dir), samples=REPLICATES), "ci_low", "ci_high")


@query("""SELECT event_type AS model, round(sum(((event_id % 1000 + 100) * coalesce(i, 0) + (event_id % 700) * coalesce(o, 0)) / 1e6), 6) AS cost
  FROM events LEFT JOIN (VALUES ('click', 1.0, 2.0), ('view', 3.0, 15.0), ('error', 2.0, 8.0)) m(name, i, o) ON event_type = name GROUP BY 1""")
def cost_by_model(spark, sf_dir):
    calls = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 1000 + 100).alias("tokens_in"), (F.col("event_id") % 700).alias("tokens_out"))
    prices = spark.createDataFrame([("click", 1.0, 2.0), ("view", 3.0, 15.0), ("error", 2.0, 8.0)], "model string, price_in double, price_out double")
    return rounded(statistics.total_cost(calls, prices), "cost")


@query("SELECT call_id, count(*) AS n_below FROM v_eval JOIN v_sla USING (eval_id) WHERE score < sla GROUP BY 1")
def below_counts(spark, sf_dir):
    return served.below_counts(views.scores(spark, sf_dir), views.evaluations(spark, sf_dir))


AUDIT_SQL = f"""{QA_SQL}, tr AS (SELECT call_id, string_agg('[' || upper(role) || '] ' || content, chr(10) ORDER BY turn_id) AS transcript FROM v_turns GROUP BY call_id
){CHUNKED_SQL.format(id="call_id", text="transcript", rel="tr")}
, documents AS (SELECT sha256(sha256(concat(id, '|p|', p)) || '|c|' || c) AS doc_id, array_to_string(cw, ' ') AS text FROM c
), benchmark AS (SELECT sha256(concat(call_id, '|', turn_index)) AS item_id, question AS text, answer FROM v_qa){BM25_SQL}{HASHED_SQL}
, pr AS (SELECT f.query_id, f.doc_id, f.rank, list_distinct({TERMS_SQL.format(t="b.text")}) AS q, list_distinct({TERMS_SQL.format(t="d.text")}) AS c FROM fk f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d ON d.doc_id = f.doc_id
), rr AS (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, rank, len(list_intersect(q, c)) / len(q) AS score FROM pr) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) <= 5
), ctx AS (SELECT rr.query_id, list_distinct(flatten(list({tokens_sql("d.text")}))) AS c FROM rr JOIN documents d ON d.doc_id = rr.doc_id GROUP BY 1
), tk AS (SELECT item_id, {tokens_sql("text")} AS q, {tokens_sql("answer")} AS a, coalesce(c, []) AS c FROM benchmark LEFT JOIN ctx ON ctx.query_id = item_id
), ov AS (SELECT unnest(['faithfulness', 'answer_relevance', 'context_precision', 'context_recall']) AS metric, unnest([a, a, a, q]) AS of_, unnest([c, q, q, c]) AS among FROM tk
), sc AS (SELECT metric, CASE WHEN len(of_) = 0 THEN 0 ELSE len(list_intersect(of_, among)) / len(of_) END::DOUBLE AS score, CASE metric WHEN 'faithfulness' THEN 0.8 WHEN 'answer_relevance' THEN 0.75 ELSE 0.7 END::DOUBLE AS sla FROM ov)
SELECT metric, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.9), 6) AS p90,
  count(*) FILTER (score < sla) AS below_sla_count, count(*) AS total_count, round(1 - count(*) FILTER (score < sla) / count(*), 6) AS sla_pass_rate FROM sc GROUP BY metric"""


@query(AUDIT_SQL)
def audit_report(spark, sf_dir):
    from dialoglens.plans.audit import audit

    return rounded(audit(views.turns(spark, sf_dir)).summary, "mean", "median", "p10", "p90", "sla_pass_rate")
