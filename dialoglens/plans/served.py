"""The read queries that an audit portal serves, over ``evaluations``, ``scores`` and ``reviews``.

A reviewer's value is never written into a score: ``final_scores`` lays the latest review over it when read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglens.functions.numbers import exact_mean
from dialoglens.operators.ordered import running_total
from dialoglens.operators.statistics import below_sla, diagnosed, flagged_calls

AGREED = ("approved", "overridden")
TOLERANCE = 0.13


def below(evaluations: DataFrame, scores: DataFrame, metric: str, limit: float) -> DataFrame:
    """Evaluations whose score of the metric is below the limit."""
    return evaluations.join(scores.where((F.col("metric") == metric) & (F.col("score") < limit)).select("eval_id"), "eval_id", "left_semi")


def low_confidence(evaluations: DataFrame, scores: DataFrame) -> DataFrame:
    return evaluations.join(scores.where("is_low_confidence").select("eval_id"), "eval_id", "left_semi")


def flagged(evaluations: DataFrame, scores: DataFrame) -> DataFrame:
    """All evaluations of the calls that have any score below its SLA."""
    return evaluations.join(flagged_calls(scores, evaluations), "call_id", "left_semi")


def flagged_by_summary(evaluations: DataFrame, summaries: DataFrame) -> DataFrame:
    """The same from a run's stored list (``run_id, flagged_json``, a JSON array of call ids)."""
    ids = summaries.select("run_id", F.explode(F.from_json("flagged_json", "array<string>")).alias("call_id"))
    keyed = evaluations.withColumn("call_key", F.col("call_id").cast("string"))
    return keyed.join(ids.withColumnRenamed("call_id", "call_key"), ["run_id", "call_key"], "left_semi").drop("call_key")


def page(evaluations: DataFrame, limit: int = 1000, offset: int = 0) -> DataFrame:
    """One page, by call and evaluation."""
    return evaluations.orderBy("call_id", "eval_id").offset(offset).limit(limit)


def filtered(evaluations: DataFrame, scores: DataFrame, *, tenant=None, run=None, call=None, level=None, status=None, metric=None, limit=None, low: bool = False, date_from=None, date_to=None) -> DataFrame:
    """Any of the portal's filters together; a metric without a limit asks for evaluations that have it."""
    out = evaluations
    for column, value in (("tenant_id", tenant), ("run_id", run), ("call_id", call), ("level", level), ("review_status", status)):
        if value is not None:
            out = out.where(F.col(column) == value)
    day = F.to_date("evaluated_at")
    if date_from:
        out = out.where(day >= F.lit(date_from).cast("date"))
    if date_to:
        out = out.where(day <= F.lit(date_to).cast("date"))
    if metric and limit is not None:
        out = below(out, scores, metric, limit)
    elif metric:
        out = out.join(scores.where(F.col("metric") == metric).select("eval_id"), "eval_id", "left_semi")
    return low_confidence(out, scores) if low else out


def final_scores(scores: DataFrame, reviews: DataFrame) -> DataFrame:
    """``eval_id, metric, auto_score, human_score, final_score``; metrics that only the reviewer gave are there, too."""
    both = scores.select("eval_id", "metric", F.col("score").alias("auto_score")).join(reviews, ["eval_id", "metric"], "full_outer")
    return both.select("eval_id", "metric", "auto_score", "human_score", F.coalesce("human_score", "auto_score").alias("final_score"))


def assembled(evaluations: DataFrame, scores: DataFrame, reviews: DataFrame) -> DataFrame:
    """Evaluations with an array of their scores, reviewer's values laid over."""
    lists = final_scores(scores, reviews).groupBy("eval_id").agg(F.array_sort(F.collect_list(F.struct("metric", "auto_score", "human_score", "final_score"))).alias("scores"))
    return evaluations.join(lists, "eval_id", "left")


def trends(evaluations: DataFrame, scores: DataFrame, by: str = "day", date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """``tenant_id, bucket, metric, avg_score, n, first_at`` of turn evaluations; ``by`` is day or run."""
    rows = filtered(evaluations, scores, level="turn", date_from=date_from, date_to=date_to)
    bucket = F.date_format("evaluated_at", "yyyy-MM-dd") if by == "day" else F.col("run_id")
    rows = rows.select("eval_id", "tenant_id", bucket.alias("bucket"), "evaluated_at").join(scores.select("eval_id", "metric", "score"), "eval_id")
    # a row for each evaluation and metric: rows count evaluations
    return rows.groupBy("tenant_id", "bucket", "metric").agg(exact_mean(F.col("score")).alias("avg_score"), F.count(F.lit(1)).alias("n"), F.min("evaluated_at").alias("first_at"))


def trend_points(points: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each bucket, a column for each metric: for display."""
    return points.groupBy("tenant_id", "bucket").pivot("metric", metrics).agg(F.first("avg_score"))


def run_means(evaluations: DataFrame, scores: DataFrame) -> DataFrame:
    """``run_id, metric, mean, n``."""
    rows = scores.select("eval_id", "metric", "score").join(evaluations.select("eval_id", "run_id"), "eval_id")
    return rows.groupBy("run_id", "metric").agg(exact_mean(F.col("score")).alias("mean"), F.count(F.lit(1)).alias("n"))


def run_deltas(means: DataFrame, limit: float = 0.05) -> DataFrame:
    """Each run's means against those of the run before (by id): ``run_id, metric, mean, previous, delta, is_regression``."""
    runs = means.select("run_id").distinct()
    order = runs.withColumn("before", F.lag("run_id").over(Window.orderBy("run_id")))
    old = means.select(F.col("run_id").alias("before"), "metric", F.col("mean").alias("previous"))
    both = means.join(order, "run_id").join(old, ["before", "metric"]).withColumn("delta", F.col("mean") - F.col("previous"))
    return both.select("run_id", "metric", "mean", "previous", "delta", (F.col("delta") < -limit).alias("is_regression"))


def runs(evaluations: DataFrame) -> DataFrame:
    """``run_id, n_evaluations, n_calls, started_at, is_latest``; the latest run has the largest id."""
    out = evaluations.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_evaluations"), F.countDistinct("call_id").alias("n_calls"), F.min("evaluated_at").alias("started_at"))
    last = evaluations.agg(F.max("run_id").alias("last"))
    return out.crossJoin(F.broadcast(last)).select("run_id", "n_evaluations", "n_calls", "started_at", (F.col("run_id") == F.col("last")).alias("is_latest"))  # one row


def stored_runs(summaries: DataFrame) -> DataFrame:
    """Runs of a store (``run_id, generated_at, total_calls, total_evaluations, flagged_count``), which all have a summary."""
    return summaries.select("run_id", "generated_at", "total_calls", "total_evaluations", "flagged_count", F.lit(True).alias("has_summary"))


def all_runs(stored: DataFrame, traced: DataFrame) -> DataFrame:
    """Stored runs and those that only traces know, with their ``place`` from 1: the latest first, undated ones last, equal times by id.

    Runs are few; their places come from totals of ranges all the same.
    """
    more = traced.join(stored.select("run_id"), "run_id", "left_anti")
    every = stored.unionByName(more.select(stored.columns)).withColumn("one_", F.lit(1))
    every = every.withColumn("late_", F.coalesce(-F.unix_micros(F.col("generated_at").cast("timestamp")), F.lit((1 << 63) - 1)))
    return running_total(every, ["late_", "run_id"], "one_", "place").drop("one_", "late_")


def run_scores(summaries: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row for each run and metric: the runs table with its metric table; runs without metrics have one row."""
    return summaries.join(metrics, "run_id", "left")


def latest_of_tenants(evaluations: DataFrame, limit: int) -> DataFrame:
    """Each tenant's ``limit`` latest evaluations with their ``place`` from 1; equal times by id."""
    order = Window.partitionBy("tenant_id").orderBy(F.desc("evaluated_at"), "eval_id")
    best = evaluations.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return best.withColumn("place", F.col("place").cast("long"))


def with_diagnosis(evaluations: DataFrame, scores: DataFrame, category: str) -> DataFrame:
    """Evaluations of one diagnosis."""
    return evaluations.join(diagnosed(scores).where(F.col("category") == category).select("eval_id"), "eval_id", "left_semi")


def tenants(evaluations: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """``tenant_id, name, conversation_count, pending_review_count``."""
    pending = F.count_if((F.col("level") == "turn") & (F.col("review_status") == "pending"))
    name = F.col("tenant_id").cast("string")
    for tenant, text in (names or {}).items():
        name = F.when(F.col("tenant_id") == tenant, text).otherwise(name)
    out = evaluations.groupBy("tenant_id").agg(F.countDistinct("call_id").alias("conversation_count"), pending.alias("pending_review_count"))
    return out.select("tenant_id", name.alias("name"), "conversation_count", "pending_review_count")


def conversations(evaluations: DataFrame, scores: DataFrame) -> DataFrame:
    """``call_id, tenant_id, n_turn_evals, is_multiturn, pending, started_at, session_score`` of each conversation."""
    turn = F.col("level") == "turn"
    calls = evaluations.groupBy("call_id", "tenant_id").agg(
        F.count_if(turn).alias("n_turn_evals"), F.count_if(turn & (F.col("review_status") == "pending")).alias("pending"), F.min("evaluated_at").alias("started_at")
    )
    session = evaluations.where("level = 'session'").select("eval_id", "call_id").join(scores.select("eval_id", "score"), "eval_id")
    session = session.groupBy("call_id").agg(F.avg("score").alias("session_score"))
    out = calls.join(session, "call_id", "left")
    return out.select("call_id", "tenant_id", "n_turn_evals", (F.col("n_turn_evals") > 1).alias("is_multiturn"), "pending", "started_at", "session_score")


def listed_conversations(found: DataFrame, kind: str = "all", text: str = "", columns: tuple[str, ...] = ("call_id", "subscriber_id")) -> DataFrame:
    """Conversations of a kind (all, multiturn, singleturn, pending) whose id or subscriber holds a text, in any case; blank: all."""
    tests = {"all": F.lit(True), "multiturn": F.col("is_multiturn"), "singleturn": ~F.col("is_multiturn"), "pending": F.coalesce("pending", F.lit(0)) > 0}
    if kind not in tests:
        raise ValueError(f"unknown kind: {kind}")
    out = found.where(tests[kind])
    if not text.strip():
        return out
    holds = [F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False)) for c in columns if c in out.columns]
    return out.where(reduce(lambda a, b: a | b, holds))


def conversation_page(found: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of conversations with their ``place`` from 1, the latest first; a task keeps ``limit + offset`` rows at most."""
    page = found.orderBy(F.desc_nulls_last("started_at"), "call_id", "tenant_id").limit(limit + offset)
    # the page is small: one task numbers it
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("started_at"), "call_id", "tenant_id"))
    return page.withColumn("place", place.cast("long")).where(F.col("place") > offset)


def drill_down(evaluations: DataFrame, scores: DataFrame, kind: str, metric: str | None = None, limit: float = 0.8) -> DataFrame:
    """Evaluations behind a figure: those whose ``metric`` is below the limit, pending ones, or one for each conversation."""
    if kind == "metric":
        return below(evaluations, scores, metric, limit)
    if kind == "pending":
        return evaluations.where("review_status = 'pending'")
    if kind == "calls":
        return first_of_calls(evaluations)
    raise ValueError(f"unknown kind: {kind}")


def first_of_calls(evaluations: DataFrame) -> DataFrame:
    """The evaluation of least id of each conversation; an aggregate, so that a long conversation isn't sorted."""
    others = [c for c in evaluations.columns if c != "call_id"]
    kept = evaluations.groupBy("call_id").agg(F.min_by(F.struct(*others), "eval_id").alias("e"))
    return kept.select("call_id", *(F.col(f"e.{c}").alias(c) for c in others)).select(evaluations.columns)


def score_metrics(scores: DataFrame) -> DataFrame:
    """``metric``: all names that scores have."""
    return scores.select("metric").where("metric is not null").distinct()


def knowledge_sources(evaluations: DataFrame, contexts: DataFrame, listed: int = 10) -> DataFrame:
    """``tenant_id, chunk_count, document_count, source_names``: distinct chunks and sources of what turns retrieved.

    ``contexts`` is ``eval_id, chunk_id, source``. Empty chunk ids don't count; a missing source is ``doc``; the first
    ``listed`` names are listed.
    """
    rows = evaluations.where("level = 'turn'").select("eval_id", "tenant_id").join(contexts, "eval_id")
    source = F.coalesce(F.col("source").cast("string"), F.lit("doc"))
    chunks = rows.where(F.coalesce("chunk_id", F.lit("")) != "").groupBy("tenant_id").agg(F.countDistinct("chunk_id").alias("chunk_count"))
    names = rows.select("tenant_id", source.alias("source")).distinct()
    first = names.withColumn("place", F.row_number().over(Window.partitionBy("tenant_id").orderBy("source"))).where(F.col("place") <= listed)
    first = first.groupBy("tenant_id").agg(F.array_sort(F.collect_list("source")).alias("source_names"))
    counts = names.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("document_count"))
    out = counts.join(chunks, "tenant_id", "left").join(first, "tenant_id")
    return out.select("tenant_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "document_count", "source_names")


def agreement_samples(evaluations: DataFrame, scores: DataFrame, reviews: DataFrame) -> DataFrame:
    """``tenant_id, eval_id, metric, auto_score, human_score, delta, agree`` of reviewed evaluations.

    What a reviewer left as it was counts as agreed.
    """
    seen = evaluations.where(F.col("review_status").isin(*AGREED)).select("eval_id", "tenant_id")
    rows = scores.select("eval_id", "metric", F.col("score").alias("auto_score")).join(seen, "eval_id").join(reviews, ["eval_id", "metric"], "left")
    rows = rows.withColumn("human_score", F.coalesce("human_score", "auto_score")).withColumn("delta", F.col("human_score") - F.col("auto_score"))
    return rows.select("tenant_id", "eval_id", "metric", "auto_score", "human_score", "delta", (F.abs("delta") < TOLERANCE).alias("agree"))


def agreement(samples: DataFrame) -> DataFrame:
    """``tenant_id, metric, n, mae, agreement``; the rows without a metric are the tenant's total."""
    sets = samples.groupingSets([["tenant_id", "metric"], ["tenant_id"]], "tenant_id", "metric")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("delta")).alias("mae"), F.avg(F.col("agree").cast("double")).alias("agreement"))


def knowledge_base(evaluations: DataFrame, scores: DataFrame) -> DataFrame:
    """``tenant_id, sources, last_indexed_at, avg_recall, n_gaps`` from turn evaluations and their recall."""
    recall = scores.where("metric = 'context_recall'").select("eval_id", F.col("score").alias("recall"))
    rows = evaluations.where("level = 'turn'").join(recall, "eval_id", "left")
    return rows.groupBy("tenant_id").agg(
        F.countDistinct("call_id").alias("sources"), F.max("evaluated_at").alias("last_indexed_at"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("avg_recall"), F.count_if(F.col("recall") < 0.7).alias("n_gaps")
    )


def coverage_gaps(evaluations: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` worst recalls below 0.7 of each tenant."""
    recall = scores.where("metric = 'context_recall' and score < 0.7").select("eval_id", F.col("score").alias("recall"))
    rows = evaluations.where("level = 'turn'").join(recall, "eval_id")
    w = Window.partitionBy("tenant_id").orderBy("recall", "eval_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("tenant_id", "place", "eval_id", "call_id", "recall")


def review_queue(evaluations: DataFrame, scores: DataFrame, limit: int = 50) -> DataFrame:
    """``eval_id, level, min_confidence, min_score``: what waits for review, the least sure first, unscored ones ahead."""
    least = scores.groupBy("eval_id").agg(F.min("confidence").alias("min_confidence"), F.min("score").alias("min_score"))
    rows = evaluations.where("review_status = 'pending'").join(least, "eval_id", "left")
    return rows.orderBy(F.asc_nulls_first("min_confidence"), "eval_id").limit(limit).select("eval_id", "level", "min_confidence", "min_score")


def resume(pairs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return pairs.join(done.select(key), key, "left_anti")


def below_counts(scores: DataFrame, evaluations: DataFrame) -> DataFrame:
    """``call_id, n_below``: how many scores of each call are below their SLA."""
    rows = scores.where(below_sla()).select("eval_id").join(evaluations.select("eval_id", "call_id"), "eval_id")
    return rows.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_below"))
