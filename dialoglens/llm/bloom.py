"""A blocked Bloom filter of a column's values, built by an aggregation and probed inside tasks.

A key sets one bit in each of the eight 64-bit words of one block, so a probe touches 64 bytes. The filter's
size is bounded by ``max_blocks``, whatever the number of keys; beyond that it lets more false positives
through, which an exact join behind it removes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8


class BlockedBloom:
    def __init__(self, blocks: np.ndarray, spark):
        self.n_blocks = len(blocks)
        self.shared = spark.sparkContext.broadcast(blocks)

    @staticmethod
    def of(keys: DataFrame, column: str, max_blocks: int = 1 << 17, keys_per_block: int = 32) -> BlockedBloom:
        """``max_blocks`` blocks of 64 bytes at most (8 MB by default) reach the driver and the executors."""
        keys = keys.select(F.col(column).alias("key")).where(F.col("key").isNotNull())
        n = keys.count()
        n_blocks = 1
        while n_blocks < max_blocks and n_blocks * keys_per_block < n:
            n_blocks *= 2
        h = F.xxhash64(F.lit(1), "key")
        bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {6 * i}) & 63 as int))").alias(f"w{i}") for i in range(WORDS)]
        rows = keys.select(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"), h.alias("h")).select("block", *bits)
        table = rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))).toArrow()
        blocks = np.zeros((n_blocks, WORDS), dtype=np.uint64)
        at = table.column("block").to_numpy()
        for i in range(WORDS):
            blocks[at, i] = table.column(f"w{i}").to_numpy().astype(np.int64).view(np.uint64)
        return BlockedBloom(blocks, keys.sparkSession)

    def probes(self, key: Column) -> list[Column]:
        """``block, bits``: what ``among`` needs of a key that is not null."""
        return [F.pmod(F.xxhash64(key), F.lit(self.n_blocks)).alias("block"), F.xxhash64(F.lit(1), key).alias("bits")]

    def held(self, block: np.ndarray, bits: np.ndarray) -> np.ndarray:
        rows, bits = self.shared.value[block], bits.view(np.uint64)
        hit = np.ones(len(bits), dtype=bool)
        for i in range(WORDS):
            hit &= (rows[:, i] >> ((bits >> np.uint64(6 * i)) & np.uint64(63)) & np.uint64(1)).astype(bool)
        return hit

    def among(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of a batch with the columns of ``probes`` that may be among the keys; so a task needs no second Python worker."""
        return batch.filter(pa.array(self.held(batch.column("block").to_numpy(), batch.column("bits").to_numpy())))

    def may_hold(self, key: Column) -> Column:
        """False for a null and for what is certainly not among the keys."""
        held = self.held

        @F.pandas_udf("boolean")
        def probe(block: pd.Series, bits: pd.Series) -> pd.Series:
            return pd.Series(held(block.to_numpy(np.int64), bits.to_numpy(np.int64)))

        return F.when(key.isNull(), F.lit(False)).otherwise(probe(*self.probes(key)))
