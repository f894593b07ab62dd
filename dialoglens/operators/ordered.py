"""Running totals and ranks over a whole table without one task that holds it.

Rows are dealt by ranges of their order; each range adds up on its own, and what all ranges before it hold is
added from their totals, one number for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglens.sources.storage import kept


def running_total(rows: DataFrame, order: Sequence[str], amount: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount``, a whole number, up to and with each row in the order of columns.

    Rows that are equal in all of ``order`` lie in one range and get their totals in no set order, so ``order``
    should tell rows apart. A null amount counts as 0.
    """
    dealt = kept(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    totals = dict(dealt.groupBy("range_").agg(F.coalesce(F.sum(F.col(amount).cast("long")), F.lit(0)).alias("t")).collect())  # a number for each range
    before, base = [], 0
    for part in sorted(totals):
        before.append((part, base))
        base += totals[part]
    bases = F.broadcast(rows.sparkSession.createDataFrame(before, "range_ int, base_ long"))
    within = F.sum(F.coalesce(F.col(amount).cast("long"), F.lit(0))).over(Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.join(bases, "range_").withColumn(out, F.col("base_") + within).drop("range_", "base_")


def mid_ranks(rows: DataFrame, value: str, out: str, key: str | None = None) -> DataFrame:
    """Adds ``out``: ranks from 1 in order of ``value``, within ``key`` if given, ties sharing the mean of theirs.

    Values are counted before they are ordered, so many equal ones weigh as one row. Null values and keys have
    no row.
    """
    by = [key, value] if key else [value]
    known = rows.where(F.col(value).isNotNull() & (F.col(key).isNotNull() if key else F.lit(True)))
    counts = known.groupBy(*by).agg(F.count(F.lit(1)).alias("c_"))
    upto = running_total(counts, by, "c_", "upto_")
    rank = F.col("upto_") - (F.col("c_") - 1) / 2
    if not key:
        return rows.join(upto.select(value, rank.alias(out)), value)
    bases = upto.groupBy(key).agg(F.min(F.col("upto_") - F.col("c_")).alias("base_"))
    return rows.join(upto.join(bases, key).select(*by, (rank - F.col("base_")).alias(out)), by)


def within_budget(rows: DataFrame, order: Sequence[str], cost: Column, budget: float, scale: int = 1_000_000) -> DataFrame:
    """Adds ``spent`` (before the row) and ``kept``: whether what came before had left any of the budget.

    Costs are taken in whole parts of ``1 / scale``, so the cut is the same for any partitioning. The row that
    crosses the budget still runs; all later ones are skipped.
    """
    priced = rows.withColumn("parts_", F.coalesce(F.round(cost * scale).cast("long"), F.lit(0)))
    total = running_total(priced, order, "parts_", "upto_").withColumn("before_", F.col("upto_") - F.col("parts_"))
    return total.withColumns({"spent": F.col("before_") / scale, "kept": F.col("before_") < round(budget * scale)}).drop("parts_", "upto_", "before_")
