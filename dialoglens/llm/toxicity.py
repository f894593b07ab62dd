"""Toxicity by votes of the nearest labelled examples, found exactly with a block-max inverted index.

The vector space holds every word of the labelled examples. A word weighs (1 + ln tf) * idf, times one plus
the square of its smoothed z-score for the label, so words that tell the labels apart count most and none is
left out; document frequencies come from all documents. Examples are bounded, so the index goes to every
executor and each document is searched where it lies: two scans, no shuffle of texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglens.llm.labelled import fold, training_rows
from dialoglens.llm.storage import Scratch
from dialoglens.llm.textops import parts

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """``max_labelled`` bounds the examples, and so the words of the space; searches and counts cover all documents."""

    max_labelled: int = 4096
    neighbours: int = 32
    block: int = 128
    softening: float = 0.05
    evidence: int = 5


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def terms_of(text: str | None, place: dict[str, int]) -> np.ndarray:
    """The numbers of a text's words within the vector space, one for each occurrence."""
    found = [i for i in map(place.get, words(text)) if i is not None]
    return np.array(found, dtype=np.int64)


def label_weights(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Every word of the sample, sorted, with 1 + z * z of its presence against the label.

    ``z`` is the deviation of positives among the rows with the word in standard deviations, whose variance has
    one added; it tends to 0 for rare words. With one kind of label all weights are 1.
    """

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            found: Counter = Counter()
            for t, y in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                found.update((w, int(y > 0)) for w in set(words(t)))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["term", "label", "n"])

    totals = sample.agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    n, share = float(totals["n"]), float(totals["pos"] or 0) / max(totals["n"], 1)
    terms = sample.select("text", "label").mapInArrow(present, "term string, label int, n long")
    table = terms.groupBy("term").agg(F.sum(F.col("n") * F.col("label")).alias("a"), F.sum("n").alias("df")).toArrow().sort_by("term")
    a, df = table.column("a").to_numpy().astype(float), table.column("df").to_numpy().astype(float)
    z = (a - df * share) / np.sqrt(df * share * (1 - share) * (1 - df / max(n, 1.0)) + 1)
    return table.column("term").to_pylist(), 1 + z * z


def document_frequencies(docs: DataFrame, place: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents. Tasks send a row for each term at most."""
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value) + 1, dtype=np.int64)
        for part in parts(batches):
            for t in part.column("text").to_pylist():
                df[-1] += 1
                df[np.unique(terms_of(t, shared.value))] += 1
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], ["term", "n"])

    table = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(place) + 1, dtype=np.int64)
    out[table.column("term").to_numpy()] = table.column("n").to_numpy()
    return out[:-1], int(out[-1])


def vector(text: str | None, place: dict[str, int], scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and unit-length weights (1 + ln tf) * scale; empty if the text has none of the terms."""
    terms, tf = np.unique(terms_of(text, place), return_counts=True)
    if not len(terms):
        return terms, np.empty(0)
    weights = (1 + np.log(tf)) * scale[terms]
    return terms, weights / np.linalg.norm(weights)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, ... of each run, one run after another."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


class BlockMaxIndex:
    """Postings of unit vectors in cells (term, block of ``block`` examples), each with its largest weight.

    A query's bound for a block is the sum of its weights times the largest weights of its terms' cells there.
    Blocks are scored best bound first, until the ``k``-th best score exceeds the bounds of all blocks left; so
    the neighbours are exact. Terms of at least a block's examples and a tenth of all keep a weight for every
    example, zeros included, in place of postings; other cells take memory only where they hold postings.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int):
        # examples that weigh the same frequent term most lie in the same blocks, which keeps the bounds low
        count = np.bincount(np.concatenate([np.empty(0, np.int64), *(t for t, _ in vectors)]), minlength=n_terms)
        top = np.full(len(ids), n_terms, dtype=np.int64)
        for i, (t, w) in enumerate(vectors):
            common = np.flatnonzero(count[t] >= block)
            if len(common):
                top[i] = t[common[np.argmax(w[common])]]
        order = np.lexsort((ids, top))
        self.ids, self.labels, self.block = ids[order], labels[order], block
        self.n_blocks = -(-len(ids) // block)
        term = np.concatenate([np.empty(0, np.int64), *(vectors[i][0] for i in order)])
        doc = np.repeat(np.arange(len(ids)), [len(vectors[i][0]) for i in order])
        weight = np.concatenate([np.empty(0), *(vectors[i][1] for i in order)])
        by = np.lexsort((doc, term))
        term, doc, weight = term[by], doc[by], weight[by]
        cell = term * max(self.n_blocks, 1) + doc // block
        start = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_block, self.highest = doc[start] // block, np.maximum.reduceat(weight, start) if len(start) else np.empty(0)
        self.cells = np.searchsorted(term[start], np.arange(n_terms + 1))
        full = np.flatnonzero(count >= max(block, len(ids) / 10))
        self.row = np.full(n_terms, -1)
        self.row[full] = np.arange(len(full))
        self.rows = np.zeros((len(full), self.n_blocks, block))
        held = self.row[term] >= 0
        self.rows[self.row[term[held]], doc[held] // block, doc[held] % block] = weight[held]
        sizes = np.add.reduceat(~held, start, dtype=np.int64) if len(start) else np.empty(0, np.int64)
        self.size, self.start = sizes, np.cumsum(sizes) - sizes
        self.doc, self.weight = doc[~held], weight[~held]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the ``k`` nearest with a cosine over 0; ties go to the smaller id."""
        size = self.cells[terms + 1] - self.cells[terms]
        cells, w = spread(self.cells[terms], size), np.repeat(weights, size)
        home = self.cell_block[cells]
        bounds = np.bincount(home, weights=w * self.highest[cells], minlength=self.n_blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        whole = self.row[terms] >= 0
        rows, w_rows = self.row[terms[whole]], weights[whole]
        posted = self.size[cells] > 0
        cells, home, w = cells[posted], home[posted], w[posted]
        found, scores, at, step = np.empty(0, np.int64), np.empty(0), 0, 4
        while at < len(order):
            if len(scores) >= k and scores[k - 1] > bounds[order[at]] + 1e-9:
                break
            blocks = order[at : at + step]
            at, step = at + step, 2 * step
            chosen = np.zeros(self.n_blocks, dtype=bool)
            chosen[blocks] = True
            here = np.flatnonzero(chosen[home])
            size = self.size[cells[here]]
            run = spread(self.start[cells[here]], size)
            sums = np.bincount(self.doc[run], weights=self.weight[run] * np.repeat(w[here], size), minlength=self.n_blocks * self.block).astype(float)
            if len(rows):
                part = self.rows[rows[:, None], blocks].reshape(len(rows), -1)
                sums.reshape(-1, self.block)[blocks] += (w_rows @ part).reshape(-1, self.block)
            new = np.flatnonzero(sums > 0)
            cos = np.minimum(sums[new], 1.0)
            if without is not None:
                cos, new = cos[self.ids[new] != without], new[self.ids[new] != without]
            if len(cos) > k:
                near = cos >= np.partition(cos, len(cos) - k)[len(cos) - k] - 1e-9
                cos, new = cos[near], new[near]
            found, scores = np.concatenate([found, new]), np.concatenate([scores, cos])
            best = np.lexsort((self.ids[found], -np.round(scores, 12)))[:k]
            found, scores = found[best], scores[best]
        return found, scores

    def vote(self, found: np.ndarray, scores: np.ndarray, prior: float, softening: float) -> float:
        """The share of positive neighbours weighted by 1 / distance, with one far vote for the prior."""
        w = 1 / (1 - scores + softening)
        return float((w @ self.labels[found] + prior) / (w.sum() + 1))


@dataclass(frozen=True)
class Calibration:
    """Platt scaling of votes; texts without neighbours have a rate of their own."""

    slope: float
    offset: float
    alone: float

    def of(self, vote: float | None) -> float:
        if vote is None:
            return self.alone
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, self.slope * math.log(vote / (1 - vote)) + self.offset))))

    @staticmethod
    def fitted(votes: list[float | None], y: list[int]) -> Calibration:
        alone = [t for v, t in zip(votes, y, strict=True) if v is None]
        x = np.array([math.log(v / (1 - v)) for v in votes if v is not None])
        t = np.array([float(t) for v, t in zip(votes, y, strict=True) if v is not None])
        rate = (sum(alone) + 0.5) / (len(alone) + 1 + 1e-9) if alone else 0.5 * (sum(y) + 1) / (len(y) + 2)
        a, b = 1.0, 0.0
        for _ in range(25 if 0 < t.sum() < len(t) else 0):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([((p - t) * x).sum() + 1e-3 * (a - 1), (p - t).sum() + 1e-3 * b])
            r = p * (1 - p)
            h = np.array([[(r * x * x).sum() + 1e-3, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-3]])
            move = np.clip(np.linalg.solve(h, g), -2, 2)
            a, b = a - move[0], b - move[1]
        return Calibration(float(max(a, 0.05)), float(b), float(min(rate, 0.999)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_neighbours, evidence`` for every row, from the whole text alone.

    ``evidence`` lists the nearest labelled examples (id, cosine, label). Examples, terms and the calibration
    (leave-one-out votes) come from labelled rows outside fold 0. Null and empty texts, and texts with none
    of the examples' words, have no neighbours and get the rate of such examples. Equal cosines: smaller id.
    Repeated rows get equal scores; other columns are not read. Without labels of both kinds every score is
    half the smoothed share of positives; an empty table gives no rows.
    """
    s, spark = settings, docs.sparkSession
    sample = Scratch(spark, "toxicity").save(training_rows(docs, labels, label, s.max_labelled).select("doc_id", "label", "text"), "sample")
    terms, gain = label_weights(sample)
    place = {w: i for i, w in enumerate(terms)}
    df, n = document_frequencies(docs, place)
    space = spark.sparkContext.broadcast((place, gain * (np.log((1 + n) / (1 + df)) + 1)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            rows = [vector(t, *space.value) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["doc_id", "label", "terms", "weights"])

    examples = sample.mapInArrow(vectors, "doc_id long, label int, terms array<long>, weights array<double>").toArrow().combine_chunks()
    ids, y = examples.column("doc_id").to_numpy(), (examples.column("label").to_numpy() > 0).astype(float)
    ends = np.cumsum(pc.list_value_length(examples.column("terms")).to_numpy())[:-1]
    split = [np.split(pc.list_flatten(examples.column(c)).to_numpy(), ends) if len(y) else [] for c in ("terms", "weights")]
    order = sorted(range(len(y)), key=lambda i: (ids[i], split[0][i].tolist()))
    prior = (y.sum() + 1) / (len(y) + 2)
    index = BlockMaxIndex(ids[order], y[order], [(split[0][i], split[1][i]) for i in order], len(terms), s.block)
    shared = spark.sparkContext.broadcast(index)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            votes = []
            for doc, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                found, cos = shared.value.search(*vector(t, *space.value), s.neighbours, doc)
                votes.append(shared.value.vote(found, cos, prior, s.softening) if len(found) else None)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(votes, pa.float64())], ["doc_id", "label", "vote"])

    tried = sample.mapInArrow(left_out, "doc_id long, label int, vote double").toArrow().to_pylist()
    tried.sort(key=lambda r: (r["doc_id"], r["vote"] or 0))
    calibration = Calibration.fitted([r["vote"] for r in tried], [int(r["label"] > 0) for r in tried])

    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for part in parts(batches):
            p, count, evidence = [], [], []
            for t in part.column("text").to_pylist():
                found, cos = ix.search(*vector(t, *space.value), s.neighbours)
                p.append(calibration.of(ix.vote(found, cos, prior, s.softening) if len(found) else None))
                count.append(len(found))
                evidence.append([(int(ix.ids[i]), float(c), int(ix.labels[i])) for i, c in zip(found[: s.evidence], cos, strict=False)])
            p = np.array(p)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(count, pa.int32()), pa.array(evidence, kind)], ["doc_id", "held_out", "score", "predicted", "n_neighbours", "evidence"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return narrow.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, n_neighbours int, evidence array<struct<doc_id: long, cosine: double, label: int>>")
