"""Writers: stage tables, keyed upserts, an append-only review log, conversations and reports."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglens.sources.tables import BucketTable, latest


def save_stage(df: DataFrame, root: str, run_id: str, stage: str) -> DataFrame:
    """A stage's table under the run, overwritten as a whole; returned as reread."""
    path = f"{root}/run_id={run_id}/stage={stage}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: list[str], order: str) -> DataFrame:
    """Merges ``new`` into the bucketed table at ``path``: the latest row of each key stays, columns may be added.

    Only buckets with changed rows are rewritten; a failure midway leaves the version before.
    """
    table = BucketTable(spark, path, keys)
    table.upsert(new, keys, order)
    return table.scan()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that ``upsert`` last completed; None before the first."""
    return BucketTable(spark, path, []).scan()


def record_reviews(reviews: DataFrame, path: str) -> None:
    """Appends to the log (``eval_id, status, metric, human_score, reviewer, reviewed_at``); nothing is overwritten."""
    reviews.write.mode("append").parquet(path)


def latest_reviews(log: DataFrame) -> DataFrame:
    """The last review of each evaluation and metric."""
    return latest(log, ["eval_id", "metric"], "reviewed_at")


def golden_set(log: DataFrame) -> DataFrame:
    """Reviewers' values as a golden set: ``qa_id, metric, human_score``."""
    return latest_reviews(log).where("human_score is not null").select(F.col("eval_id").alias("qa_id"), "metric", "human_score")


def conversation_table(turns: DataFrame) -> DataFrame:
    """``call_id, turn_count, is_multiturn, turns`` (an array of structs in order) for storing."""
    return turns.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("turn_count"), (F.count_if(F.col("role") == "bot") > 1).alias("is_multiturn"), F.array_sort(F.collect_list(F.struct("turn_id", "role", "content"))).alias("turns")
    )


def newest_per_run(paths: DataFrame) -> DataFrame:
    """``run_id, path`` of the lexically last trace of each run."""
    return paths.groupBy("run_id").agg(F.max("path").alias("path"))


def report_json(summary: DataFrame, path: str) -> None:
    """The summary as one JSON object a line."""
    summary.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def report_html(summary: DataFrame, flagged: DataFrame, run_id: str, listed: int = 100) -> str:
    """A page of the metrics' table (a row for each metric) and up to ``listed`` flagged calls with their number."""
    from dialoglens.functions.numbers import status_band

    rows = summary.withColumn("band", status_band(F.col("sla_pass_rate"))).orderBy("metric").collect()
    names = ["metric", "mean", "median", "p10", "p90", "below_sla_count", "total_count", "sla_pass_rate", "band"]
    cells = "".join("<tr>" + "".join(f"<td>{html.escape(f'{r[n]:.3f}' if isinstance(r[n], float) else str(r[n]))}</td>" for n in names) + "</tr>" for r in rows)
    n = flagged.count()
    calls = "".join(f"<li>{html.escape(str(r['call_id']))}</li>" for r in flagged.orderBy("call_id").limit(listed).collect())
    head = "".join(f"<th>{x}</th>" for x in names)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Audit {html.escape(run_id)}</title></head><body><h1>Audit {html.escape(run_id)}</h1><table><tr>{head}</tr>{cells}</table><h2>{n} flagged calls</h2><ul>{calls}</ul></body></html>"


def first_per_call(records: DataFrame, order: str) -> DataFrame:
    """The first record of each call."""
    w = Window.partitionBy("call_id").orderBy(order)
    return records.withColumn("place_", F.row_number().over(w)).where("place_ = 1").drop("place_")
