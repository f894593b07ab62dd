"""The labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo five; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``limit`` labelled rows outside fold 0, those with the smallest hash of the id.

    A document with several labels counts as positive if any is. ``limit`` rows of ids are what is broadcast.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    ids = ids.where((fold(F.col("doc_id")) != 0) & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(limit)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.join(F.broadcast(ids), "doc_id")
