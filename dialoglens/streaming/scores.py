"""Score events as a stream: daily means and idle sessions within a watermark, tables updated batch by batch.

A stream runs as often as one likes and takes up where its checkpoint left it. Each batch's rows go to a folder
named by the batch, so one that is done twice is there once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """New Parquet files of a folder, with the columns of ``like`` and the time as a timestamp."""
    raw = spark.readStream.schema(like.schema).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")


def once(events: DataFrame, late: str) -> DataFrame:
    """Repeated ids count once within the watermark; what comes later than ``late`` is left out."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def daily_means(events: DataFrame, late: str = "2 days") -> DataFrame:
    """``day, event_type, n, mean`` of a stream, a row when its day is closed."""
    days = once(events, late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return days.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "mean")


def idle_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """``user_id, started_at, ended_at, n``: a user's events with less than ``gap`` between, a row when the user fell idle."""
    rows = once(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "n")


def run_stream(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Takes in all that is new, then stops."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def to_folder(out: str) -> Callable[[DataFrame, int], None]:
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/batch={number:010d}")


def upsert_stream(events: DataFrame, path: str, keys: list[str], order: str, checkpoint: str) -> None:
    """Merges all new rows into the table at ``path``, the latest row of a key wins; a batch done twice changes nothing."""
    from dialoglens.sources.writers import upsert

    run_stream(events, lambda rows, _: upsert(rows.sparkSession, rows, path, keys, order) and None, checkpoint)


def arriving(table: DataFrame, folder: str, slices: int, closed_by: str) -> Iterator[int]:
    """Lays a table into a folder as it would have come: ``slices`` stretches of time in order, then a closing event.

    The closing event has a time and nothing else; it lies ``closed_by`` after the last event, so that every
    window before it closes. A slice is there when its number is given out.
    """
    rows = table.where(F.col("ts").isNotNull())
    bounds = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    width = F.unix_micros(F.col("high").cast("timestamp")) - F.unix_micros(F.col("low").cast("timestamp")) + 1
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("low").cast("timestamp"))) * slices / width)
    dealt = rows.crossJoin(F.broadcast(bounds)).withColumn("at_", at)  # one row
    for i in range(slices):
        dealt.where(F.col("at_") == i).select(table.columns).write.mode("append").parquet(folder)
        yield i
    empty = {c: F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns}
    last = (F.col("high") + F.expr(f"interval {closed_by}")).cast(table.schema["ts"].dataType)
    bounds.where("high is not null").select(*(last.alias("ts") if c == "ts" else empty[c] for c in table.columns)).write.mode("append").parquet(folder)
    yield slices


def streamed(table: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame], closed_by: str, slices: int = 2) -> DataFrame:
    """A table of events sent through a stream that stops and starts again behind each slice; all rows that it closed."""
    spark, out = table.sparkSession, f"{folder}/out"
    for _ in arriving(table, f"{folder}/in", slices, closed_by):
        result = make(event_stream(spark, f"{folder}/in", table))
        run_stream(result, to_folder(out), f"{folder}/checkpoint")
    return spark.read.schema(result.schema).parquet(out).select(result.columns)
