"""Audit tables derived from the star-schema test tables, so that each operator has whole tables to run over.

``turns`` comes from ``conversations``. Four consecutive ``events`` make one evaluation: the first gives its
keys, each gives a score of the metric its type stands for (the latest wins), the last one the reviewer's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglens.functions.text import strip

STATUSES = ("pending", "approved", "overridden", "skipped")
METRIC_OF = {"error": "faithfulness", "click": "answer_relevance", "view": "context_precision", "purchase": "context_recall", "signup": "safety_compliance"}
LOW_CONFIDENCE = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str, min_length: int = 5) -> DataFrame:
    """``call_id, turn_id, role, content``: stripped texts of ``min_length`` characters or more."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("call_id"),
        F.col("turn").alias("turn_id"),
        F.when(F.col("role") == "assistant", "bot").otherwise(F.col("role")).alias("role"),
        strip(F.col("text")).alias("content"),
    )
    return rows.where(F.length("content") >= min_length)


def with_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.lit(None).cast("string")
    for kind, name in METRIC_OF.items():
        metric = F.when(F.col("event_type") == kind, name).otherwise(metric)
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.expr("event_id div 4").alias("eval_id"),
        metric.alias("metric"),
        (1.0 - F.least(F.lit(1.0), F.col("value") / 250.0)).alias("score"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"),
    )


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eval_id, call_id, tenant_id, run_id, evaluated_at, review_status, level``."""
    first = with_eval(spark, sf_dir).groupBy("eval_id").agg(F.min_by(F.struct("user_id", "ts"), "event_id").alias("e"))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("eval_id") % 4 + 1).cast("int"))
    return first.select(
        "eval_id",
        F.col("e.user_id").alias("call_id"),
        (F.col("e.user_id") % 3).alias("tenant_id"),
        F.concat(F.lit("run_"), F.date_format("e.ts", "yyyyMMdd")).alias("run_id"),
        F.col("e.ts").alias("evaluated_at"),
        status.alias("review_status"),
        F.when(F.col("eval_id") % 10 == 9, "session").otherwise("turn").alias("level"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eval_id, metric, score, confidence, is_low_confidence``, one row for each evaluation and metric."""
    last = with_eval(spark, sf_dir).groupBy("eval_id", "metric").agg(F.max_by(F.struct("score", "confidence"), "event_id").alias("s"))
    return last.select("eval_id", "metric", "s.score", "s.confidence", (F.col("s.confidence") < LOW_CONFIDENCE).alias("is_low_confidence"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eval_id, metric, human_score``: the reviewer's value of one metric of each overridden evaluation."""
    last = with_eval(spark, sf_dir).groupBy("eval_id").agg(F.max_by(F.struct("metric", "confidence"), "event_id").alias("r"))
    rows = last.select("eval_id", "r.metric", F.col("r.confidence").alias("human_score"))
    return rows.join(evaluations(spark, sf_dir).where("review_status = 'overridden'").select("eval_id"), "eval_id", "left_semi")


#: The same tables in SQL, as common table expressions.
SQL = """
v_turns AS (
  SELECT conv_id AS call_id, turn AS turn_id, CASE role WHEN 'assistant' THEN 'bot' ELSE role END AS role, trim(text) AS content
  FROM conversations WHERE length(trim(text)) >= 5
), v_events AS (
  SELECT event_id, ts, user_id, event_id // 4 AS eval_id,
         CASE event_type WHEN 'error' THEN 'faithfulness' WHEN 'click' THEN 'answer_relevance' WHEN 'view' THEN 'context_precision'
           WHEN 'purchase' THEN 'context_recall' WHEN 'signup' THEN 'safety_compliance' END AS metric,
         1.0::DOUBLE - least(1.0::DOUBLE, value / 250.0::DOUBLE) AS score, json_extract_string(props, '$.k')::DOUBLE / 100 AS confidence
  FROM events
), v_eval AS (
  SELECT eval_id, arg_min(user_id, event_id) AS call_id, arg_min(user_id, event_id) % 3 AS tenant_id,
         'run_' || strftime(arg_min(ts, event_id), '%Y%m%d') AS run_id, arg_min(ts, event_id) AS evaluated_at,
         CASE eval_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'overridden' ELSE 'skipped' END AS review_status,
         CASE WHEN eval_id % 10 = 9 THEN 'session' ELSE 'turn' END AS level
  FROM v_events GROUP BY eval_id
), v_scores AS (
  SELECT eval_id, metric, arg_max(score, event_id) AS score, arg_max(confidence, event_id) AS confidence,
         arg_max(confidence, event_id) < 0.3 AS is_low_confidence
  FROM v_events GROUP BY eval_id, metric
), v_reviews AS (
  SELECT eval_id, arg_max(metric, event_id) AS metric, arg_max(confidence, event_id) AS human_score
  FROM v_events WHERE eval_id % 4 = 2 GROUP BY eval_id
), v_sla AS (
  SELECT *, CASE metric WHEN 'faithfulness' THEN 0.8 WHEN 'answer_relevance' THEN 0.75 WHEN 'context_precision' THEN 0.7
    WHEN 'context_recall' THEN 0.7 ELSE 0.7 END::DOUBLE AS sla FROM v_scores
)"""
