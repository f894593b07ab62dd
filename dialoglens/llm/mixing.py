"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Raking works on the cells source x language x topic, a table that doesn't grow with the number of documents;
documents are touched by one scan for their vector and one for their draw. Topics are clusters of the texts'
hashed bags of words, with the corpus mean taken out, so that what all texts share doesn't count.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglens.llm.storage import Scratch
from dialoglens.llm.textops import hashed_words, mixed, parts

MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Targets:
    """Target shares of tokens for each margin, as ``{value: share}``; a margin left out is tempered.

    Tempering raises the observed shares to the power ``temper`` (1 keeps them, 0 makes them equal).
    ``budget`` is the share of all tokens that the sample should hold; where a cell can't give as much as the
    targets ask, all of it is taken and the others give more. ``topics`` clusters are fitted on
    all texts with words, and every text is dealt to one.
    """

    shares: Mapping[str, Mapping[str, float]] | None = None
    temper: Mapping[str, float] | None = None
    budget: float = 0.6
    topics: int = 8
    rounds: int = 100
    tolerance: float = 1e-9
    seed: int = 17


DEFAULT = Targets(temper={"source": 0.5, "lang": 0.7, "topic": 0.7})


#: Length of a text's hashed bag of words.
DIMENSIONS = 64


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row for each text, and its number of words: each distinct word adds 1 or -1 in one of 64 places; unit length."""
    words, n = hashed_words(column)
    row = np.repeat(np.arange(len(n)), n)
    _, once = np.unique(words ^ mixed(row.astype(np.uint64)), return_index=True)
    place = row[once] * DIMENSIONS + (words[once] % np.uint64(DIMENSIONS)).astype(np.int64)
    sign = 1.0 - 2.0 * (words[once] >> np.uint64(63)).astype(np.float64)
    out = np.bincount(place, weights=sign, minlength=len(n) * DIMENSIONS).reshape(len(n), DIMENSIONS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12), n


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, DIMENSIONS).astype(np.float64)


def directions(column: pa.Array | pa.ChunkedArray, mean: np.ndarray) -> np.ndarray:
    rows = matrix(column) - mean
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def clusters(bags: DataFrame, mean: np.ndarray, k: int, seed: int, rounds: int = 20) -> np.ndarray:
    """Unit-length centres by k-means on the sphere over all rows (``doc_id, bag``); each starts at the row that is
    farthest from those before. A pass sends one row or ``k`` sums from each task."""
    keyed = bags.select(F.xxhash64(F.lit(seed), "doc_id").alias("tie"), "doc_id", "bag")
    centres = directions(keyed.orderBy("tie", "doc_id", "bag").limit(1).select("bag").toArrow().column("bag"), mean)

    def farthest(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            near = np.round((directions(b.column("bag"), mean) @ centres.T).max(axis=1), 9)
            few = b.take(pa.array(np.flatnonzero(near == near.min()))) if b.num_rows else b
            for tie, doc, bag in zip(*(c.to_pylist() for c in few.columns), strict=True):
                best = min(best or (np.inf,), (float(near.min()), tie, doc is not None, doc or 0, bag))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (best[0], best[1], best[4])], ["near", "tie", "bag"])

    def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), DIMENSIONS), np.int64)
        for b in batches:
            rows = directions(b.column("bag"), mean)
            at = np.argmax(rows @ centres.T, axis=1)
            np.add.at(total, at, np.round(rows * 1e6).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "total"])

    while 0 < len(centres) < k:
        found = keyed.mapInArrow(lambda batches, c=centres: farthest(batches, c), "near double, tie long, bag binary")
        row = found.orderBy("near", "tie", "bag").limit(1).toArrow()
        if row.column("near")[0].as_py() >= 1 - 1e-9:  # no more directions than centres
            break
        centres = np.vstack([centres, directions(row.column("bag"), mean)])
    for _ in range(rounds if len(centres) else 0):
        found = keyed.mapInArrow(lambda batches, c=centres: sums(batches, c), "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").toArrow()
        total = found.column("total").to_numpy().reshape(len(centres), DIMENSIONS) / 1e6
        size = np.linalg.norm(total, axis=1, keepdims=True)
        before, centres = centres, np.where(size > 0, total / np.maximum(size, 1e-12), centres)
        if np.array_equal(before, centres):
            break
    return centres


def with_cells(docs: DataFrame, targets: Targets, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens`` (words) for every row; null sources and languages are ''.

    Texts without words have topic 0.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, limit=1 << 20):
            bag, n = bags(part.column("text"))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x.tobytes() for x in bag.astype(np.float32)], pa.binary()), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "bag", "n_tokens"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    rows = Scratch(spark, "mixing").save(narrow.mapInArrow(run, "doc_id long, source string, lang string, bag binary, n_tokens long"), "bags")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS), 0
        for b in batches:
            total, n = total + matrix(b.column("bag")).sum(axis=0), n + b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(DIMENSIONS), pa.int64()), pa.array(np.round(total * 1e6).astype(np.int64)), pa.array([n] * DIMENSIONS, pa.int64())], ["at", "total", "n"])

    some = rows.where("n_tokens > 0")
    # a row for each of the 64 places
    total = some.select("bag").mapInArrow(sums, "at long, total long, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("at").toArrow()
    mean = total.column("total").to_numpy() / 1e6 / np.maximum(total.column("n").to_numpy(), 1) if total.num_rows else np.zeros(DIMENSIONS)
    centres = clusters(some, mean, targets.topics, targets.seed)
    shared = spark.sparkContext.broadcast((mean, centres if len(centres) else np.zeros((1, DIMENSIONS))))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, centres = shared.value
        for b in batches:
            topic = np.argmax((matrix(b.column("bag")) - mean) @ centres.T, axis=1)
            topic = np.where(b.column("n_tokens").to_numpy() > 0, topic, 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(topic.astype(str).tolist(), pa.string()), b.column("n_tokens")], ["doc_id", "source", "lang", "topic", "n_tokens"])

    return rows.mapInArrow(name, "doc_id long, source string, lang string, topic string, n_tokens long")


def wanted(cells: Sequence[tuple], tokens: np.ndarray, targets: Targets) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each margin the position of each cell's value, and the target shares (over values that hold tokens)."""
    out = []
    for m, name in enumerate(MARGINS):
        values, at = np.unique([c[m] for c in cells], return_inverse=True)
        seen = np.bincount(at, weights=tokens, minlength=len(values))
        given = (targets.shares or {}).get(name)
        share = np.array([float(given.get(v, 0.0)) for v in values]) if given else (seen / max(seen.sum(), 1)) ** (targets.temper or {}).get(name, 1.0)
        share = np.where(seen > 0, share, 0.0)
        out.append((at, share / share.sum() if share.sum() else share))
    return out


def raked(cells: Sequence[tuple], tokens: np.ndarray, targets: Targets) -> np.ndarray:
    """Each cell's target tokens (shares that sum to 1): the fit closest to the observed ones with the target margins."""
    fit = tokens / max(tokens.sum(), 1)
    margins = wanted(cells, tokens, targets)
    for _ in range(targets.rounds):
        before = fit
        for at, share in margins:
            now = np.bincount(at, weights=fit, minlength=len(share))
            fit = fit * np.divide(share, now, out=np.zeros_like(share), where=now > 0)[at]
        if np.abs(fit - before).max(initial=0) < targets.tolerance:
            break
    return fit / fit.sum() if fit.sum() else fit


def probabilities(fit: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Inclusion probabilities in proportion to fit / tokens, at most 1, whose expected tokens meet the budget.

    Cells that reach 1 are taken whole, and the scale for the rest is set anew until none exceeds 1.
    """
    weight = np.divide(fit, tokens, out=np.zeros_like(fit), where=tokens > 0)
    p, full = np.zeros_like(fit), np.zeros(len(fit), dtype=bool)
    goal = budget * tokens.sum()
    for _ in range(len(fit) + 1):
        rest = (weight * tokens)[~full].sum()
        p = np.where(full, 1.0, weight * ((goal - tokens[full].sum()) / rest if rest > 0 else 0.0))
        over = ~full & (p >= 1)
        if not over.any():
            break
        full |= over
    return np.clip(p, 0.0, 1.0)


def mixed_sample(docs: DataFrame, targets: Targets = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, probability, draw, kept`` for every row of ``docs``.

    ``weight`` is the cell's target share over its observed share; a row is kept if its ``draw``, a hash of its
    id and place in (0, 1), is below the cell's ``probability``, so the choice doesn't depend on partitioning.
    Null and empty texts have no tokens, topic 0 and their cell's probability; cells without tokens have
    weight 0 and probability 1, as they change no margin. Equal rows are drawn alike. Other columns are not
    read; an empty table gives no rows.
    """
    rows = Scratch(docs.sparkSession, "mixing").save(with_cells(docs, targets, id_col, text_col), "cells")
    # one row for each source, language and topic, as the task's contract fixes their numbers
    totals = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).orderBy(*MARGINS).toArrow()
    cells = list(zip(*(totals.column(m).to_pylist() for m in MARGINS), strict=True))
    tokens = totals.column("tokens").to_numpy().astype(np.float64)
    fit = raked(cells, tokens, targets)
    p = probabilities(fit, tokens, targets.budget)
    share = tokens / max(tokens.sum(), 1)
    weight = np.divide(fit, share, out=np.zeros_like(fit), where=share > 0)
    table = docs.sparkSession.createDataFrame(
        [(*c, float(w), float(q) if t else 1.0) for c, w, q, t in zip(cells, weight, p, tokens, strict=True)],
        "source string, lang string, topic string, weight double, probability double",
    )
    draw = F.pmod(F.xxhash64(F.lit(targets.seed), "doc_id"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    out = rows.join(table, list(MARGINS), "left").withColumn("draw", draw)
    return out.select("doc_id", *MARGINS, "n_tokens", "weight", "probability", "draw", (F.col("draw") < F.col("probability")).alias("kept"))
