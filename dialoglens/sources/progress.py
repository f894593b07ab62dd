"""A run that can be stopped anywhere and taken up again: stages, and items within a stage.

Results are written to folders of their own, one for each attempt; a small file that appears whole then says
which attempt counts. What a stopped run left without that file is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglens.sources.storage import Files, kept


class Progress:
    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.folder = spark, f"{root}/{run_id}"
        self.files = Files(spark, self.folder)

    def attempt(self, df: DataFrame) -> str:
        name = f"attempts/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return name

    def has_stage(self, stage: str) -> bool:
        return self.files.exists(f"stages/{stage}")

    def stage(self, stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, made only if no run before has finished it; of two runs at once the first one's counts."""
        if not self.has_stage(stage):
            self.files.claim(f"stages/{stage}", self.attempt(make()))
        return self.spark.read.parquet(f"{self.folder}/{self.files.read(f'stages/{stage}')}")

    def done(self, stage: str) -> DataFrame | None:
        """The committed items of a stage; None before the first."""
        names = self.files.names(f"items/{stage}")
        paths = [f"{self.folder}/{self.files.read(f'items/{stage}/{n}')}" for n in names]  # a path for each committed batch
        return self.spark.read.parquet(*paths) if paths else None

    def pending(self, stage: str, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key no committed item has."""
        held = self.done(stage)
        return rows if held is None else rows.join(held.select(key).distinct(), key, "left_anti")

    def items(self, stage: str, rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], batches: int = 8, only: Collection[int] | None = None) -> DataFrame | None:
        """Does the work for all pending rows, a hash batch of keys at a time, and gives all items, old and new.

        ``work`` keeps the key. A batch counts once its file is there; one that fails leaves the others' results.
        ``only`` names the batches to do now.
        """
        left = kept(self.pending(stage, rows, key).withColumn("batch_", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")), "pending")
        waiting = [r["batch_"] for r in left.select("batch_").distinct().collect()]  # as many as batches
        names = self.files.names(f"items/{stage}")
        for batch in sorted(set(waiting) & set(range(batches) if only is None else only)):
            turn = sum(n.startswith(f"{batch:05d}-") for n in names)
            path = self.attempt(work(left.where(F.col("batch_") == batch).drop("batch_")))
            self.files.claim(f"items/{stage}/{batch:05d}-{turn:05d}", path)
        return self.done(stage)

    def clear(self) -> int:
        """Removes attempts that don't count; none may be running. Their number."""
        counted = {self.files.read(f"stages/{s}") for s in self.files.names("stages")}
        counted |= {self.files.read(f"items/{s}/{n}") for s in self.files.names("items") for n in self.files.names(f"items/{s}")}
        lost = [a for a in (f"attempts/{n}" for n in self.files.names("attempts")) if a not in counted]
        for name in lost:
            self.files.remove(name)
        return len(lost)


def run_stages(progress: Progress, stages: Sequence[tuple[str, Callable[[DataFrame | None], DataFrame]]], until: str | None = None) -> DataFrame | None:
    """Stages in order, each made from the one before, up to and with ``until``; the last one's table.

    What is finished is read, and nothing before the last finished stage is made again.
    """
    names = [name for name, _ in stages]
    if until is not None and until not in names:
        raise ValueError(f"unknown stage: {until}")
    wanted = stages[: names.index(until) + 1] if until else stages
    finished = max((i for i, (name, _) in enumerate(wanted) if progress.has_stage(name)), default=-1)
    table = progress.stage(wanted[finished][0], lambda: None) if finished >= 0 else None
    for name, make in wanted[finished + 1 :]:
        table = progress.stage(name, lambda make=make, before=table: make(before))
    return table
