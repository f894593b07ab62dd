"""Stored runs: a table of runs and one of their metrics, JSON traces of each stage, and reports made of both."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglens.sources.storage import Files
from dialoglens.sources.tables import BucketTable


class RunStore:
    """Runs (``run_id, generated_at, total_calls, total_evaluations, flagged_count``) and metrics (``run_id, metric, ...``); the latest word on a run stays."""

    def __init__(self, spark: SparkSession, path: str):
        self.runs, self.metrics = (BucketTable(spark, f"{path}/{name}", ["run_id"], buckets=4) for name in ("runs", "metrics"))

    def record(self, runs: DataFrame, metrics: DataFrame) -> None:
        """Upserts runs and all their metrics; ``generated_at`` decides which of two is later."""
        self.runs.upsert(runs, ["run_id"], "generated_at")
        dated = metrics.join(runs.select("run_id", "generated_at"), "run_id")
        self.metrics.upsert(dated, ["run_id", "metric"], "generated_at")

    def list(self) -> DataFrame:
        """Every run with its metrics, a row for each."""
        runs, metrics = self.runs.scan(), self.metrics.scan()
        return runs.join(metrics.drop("generated_at"), "run_id", "left")


def save_trace(df: DataFrame, root: str, run_id: str, name: str, stamp: str) -> str:
    """A stage's rows as JSON lines in a folder named by the stage and the time; nothing older is touched."""
    path = f"{root}/{run_id}/{name}_{stamp}"
    df.write.json(path)
    return path


def traces(spark: SparkSession, root: str, name: str) -> dict[str, str]:
    """Run to the folder of its newest trace of that name, by the folders' names; runs without one are not there."""
    files, found = Files(spark, root), {}
    for run in files.names():
        mine = [n for n in files.names(run) if n.startswith(f"{name}_") and files.exists(f"{run}/{n}/_SUCCESS")]
        if mine:
            found[run] = f"{root}/{run}/{max(mine)}"
    return found


def latest_traces(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The newest traces of all runs, with ``run_id`` from their path; a trace that wasn't finished doesn't count."""
    paths = list(traces(spark, root, name).values())  # one for each run
    if not paths:
        return spark.createDataFrame([], f"{schema}, run_id string")
    return spark.read.schema(schema).json(paths).select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+/[^/]+$", 1).alias("run_id"))


def full_report(summary: DataFrame, evaluations: DataFrame, path: str) -> None:
    """One JSON object a line: the metrics' summary rows, then all evaluations, told apart by ``kind``."""
    rows = summary.select(F.lit("summary").alias("kind"), F.to_json(F.struct("*")).alias("row")).unionByName(evaluations.select(F.lit("evaluation").alias("kind"), F.to_json(F.struct("*")).alias("row")))
    rows.select(F.format_string('{"kind":"%s","row":%s}', "kind", "row").alias("value")).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    """Nested settings of a JSON file, or of a YAML file where a reader for that is installed."""
    folder, _, name = path.rpartition("/")
    text = Files(spark, folder).read(name)
    if name.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)
