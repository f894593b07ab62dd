"""Approximate nearest neighbours with a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every vector is then dealt to its leaf. Equal vectors count once, so
a vector that a third of all rows share is one entry, with as many of its smallest ids as a result can show.
Neighbouring leaves lie on one shelf, so that a query goes to each shelf once, with the leaves it visits there.
Shelves of any size are cut into parts by a hash; within a part, all queries of a leaf are one matrix product.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglens.llm.storage import Scratch


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the vectors the tree is fitted on, ``probes`` the queries that calibrate the visits.

    Leaves hold about ``leaf`` vectors, shelves ``shelf`` leaves; a part of a shelf ``part`` at most, on average.
    """

    sample: int = 20_000
    branch: int = 16
    leaf: int = 256
    max_leaves: int = 65_536
    rounds: int = 8
    probes: int = 512
    recall: float = 0.94
    shelf: int = 16
    part: int = 2048
    seed: int = 5


class Tree:
    """Nodes with unit-length centres; ``leaf`` numbers the leaves, -1 for inner nodes."""

    def __init__(self, rows: np.ndarray, leaves: int, s: Settings):
        self.centre, self.children, self.leaf, self.n_leaves = [np.zeros(rows.shape[1])], [[]], [-1], 0
        rng = np.random.default_rng(s.seed)
        todo = [(0, rows, max(1, leaves))]
        while todo:
            node, own, want = todo.pop(0)
            k = min(s.branch, want, len(own))
            groups = self.split(own, k, rng, s.rounds) if k > 1 else []
            if len(groups) < 2:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            for centre, members in groups:
                self.centre.append(centre)
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(len(self.centre) - 1)
                todo.append((len(self.centre) - 1, members, max(1, round(want * len(members) / len(own)))))
        self.centre = np.array(self.centre)

    @staticmethod
    def split(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = rows[rng.choice(len(rows), k, replace=False)]
        for _ in range(rounds):
            at = np.argmax(rows @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, rows)
            centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, centres)
            centres = centres / np.linalg.norm(centres, axis=1, keepdims=True)
        at = np.argmax(rows @ centres.T, axis=1)
        return [(centres[j], rows[at == j]) for j in range(k) if (at == j).any()]

    def home(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each unit vector descends to."""
        out, todo = np.zeros(len(rows), dtype=np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if self.leaf[node] >= 0:
                out[own] = self.leaf[node]
                continue
            kids = self.children[node]
            # one row after another gives the same bits for equal vectors, however rows are batched
            at = np.argmax(np.einsum("ij,kj->ik", rows[own], self.centre[kids]), axis=1)
            todo += [(kid, own[at == j]) for j, kid in enumerate(kids)]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first: the open node nearest to the query is opened next."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                continue
            kids = self.children[node]
            for kid, near in zip(kids, self.centre[kids] @ query, strict=True):
                heapq.heappush(queue, (-float(near), kid))
        return out


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1, so that no norm over- or underflows."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, initial=0))[1][:, None])


def units(raw: np.ndarray) -> np.ndarray:
    raw = scaled(raw)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors from lists of doubles, or from their bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def as_bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(rows, dtype=np.float64)], pa.binary())


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal bits wherever they are computed."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


#: More than the matrix product's rounding may move a cosine.
MARGIN = 1e-9


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` without vectors that are null, empty, zero or hold null, infinite or NaN components."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    # two hashes tell vectors apart
    rows = rows.select("id", "v", F.xxhash64("v").alias("key"), F.xxhash64(F.lit(11), "v").alias("key2"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    settings: Settings = Settings(),
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest cosines for each row whose id is divisible by ``every``.

    A query's own row is left out; fewer rows if there are fewer vectors. Ties go to the smaller id; equal
    vectors tie. How many leaves a query visits is calibrated: the fewest that reach ``recall`` on sampled
    queries against a brute-force search over all vectors. Vectors that are null, zero or hold null or
    non-finite components take no part, as do null ids and vectors of another length than most have (of the
    shorter among equals); repeated ids are rows of their own; other columns are not read; an empty table gives
    no rows.
    """
    s, spark = settings, vectors.sparkSession
    scratch = Scratch(spark, "kmeans-tree")
    rows = usable(vectors, id_col, vector_col)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == length["n"])
    # equal vectors: the smallest k + 1 ids answer any query; the limit is applied before the shuffle, too
    order = Window.partitionBy("key", "key2").orderBy("id")
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    sets = scratch.save(first.groupBy("key", "key2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")), "sets")
    asked = scratch.save(rows.where(F.col("id") % every == 0).select("id", "key", "key2", "v"), "asked")
    n = sets.count()

    def sampled(df: DataFrame, most: int) -> pa.Table:
        """At most ``most`` vectors, those with the smallest hash."""
        return df.orderBy(F.xxhash64(F.lit(3), "key"), "key", "key2").limit(most).select("key", "key2", "v").toArrow()

    fit = units(matrix(sampled(sets, s.sample).column("v")))
    tree = spark.sparkContext.broadcast(Tree(fit, min(s.max_leaves, -(-n // s.leaf), max(1, len(fit) // 8)), s))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"))
                leaf = tree.value.home(units(v))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("key2"), as_bytes(v), b.column("ids"), pa.array(leaf), pa.array(leaf // s.shelf)], ["key", "key2", "v", "ids", "leaf", "shelf"])

    placed = scratch.save(sets.mapInArrow(leaves, "key long, key2 long, v binary, ids array<long>, leaf long, shelf long"), "placed")
    questions = asked.groupBy("key", "key2").agg(F.first("v").alias("v"))
    most = visits_needed(placed, sampled(questions, s.probes), tree, k, s)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"))
            row, shelf, seen = [], [], []
            for i, q in enumerate(units(v) if len(v) else v):
                leaf = np.sort(tree.value.visits(q, most))
                cut = np.flatnonzero(np.diff(leaf // s.shelf, prepend=-1))
                row += [i] * len(cut)
                shelf += (leaf[cut] // s.shelf).tolist()
                seen += [x.tolist() for x in np.split(leaf, cut[1:])]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key").take(take), b.column("key2").take(take), as_bytes(v).take(take), pa.array(seen, pa.list_(pa.int64())), pa.array(shelf, pa.int64())], ["key", "key2", "v", "leaves", "shelf"])

    visits = scratch.save(questions.mapInArrow(opened, "key long, key2 long, v binary, leaves array<long>, shelf long"), "visits")

    def cuts(df: DataFrame, name: str) -> DataFrame:
        """Into how many parts a shelf's rows are dealt; a row for each shelf, of which there are fewer than leaves."""
        return df.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / s.part).cast("long").alias(name))

    parts = F.broadcast(cuts(placed, "cuts").join(cuts(visits, "turns"), "shelf"))
    every_cut, every_turn = (F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)) for c in ("cuts", "turns"))
    # each part of a shelf's vectors meets each part of the queries that visit the shelf
    visits = visits.join(parts, "shelf").withColumn("turn", F.pmod("key2", "turns")).select("key", "key2", "v", "leaves", "shelf", "turn", every_cut.alias("cut"))
    dealt = placed.join(parts, "shelf").withColumn("cut", F.pmod("key", "cuts")).select("v", "ids", "leaf", "shelf", "cut", every_turn.alias("turn"))

    def search(queries: pa.Table, data: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        if not queries.num_rows or not data.num_rows:
            return schema.empty_table()
        q, x = scaled(matrix(queries.column("v"))), scaled(matrix(data.column("v")))
        q1, x1 = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, x))
        leaf, visited = data.column("leaf").to_numpy(), queries.column("leaves").combine_chunks()
        asks = np.repeat(np.arange(len(q)), np.diff(visited.offsets.to_numpy()))
        visited = visited.flatten().to_numpy()
        near = np.full((len(q), len(x)), -np.inf)
        for one in np.unique(leaf):
            some, of = np.flatnonzero(leaf == one), asks[visited == one]
            near[np.ix_(of, some)] = q1[of] @ x1[some].T
        # k + 1 sets: the query's own may have no other id; rounding must not decide, so those near the edge stay
        edge = np.partition(near, len(x) - k - 1, axis=1)[:, len(x) - k - 1] if len(x) > k + 1 else np.full(len(q), -2.0)
        row, at = np.nonzero((near >= edge[:, None] - MARGIN) & (near > -np.inf))
        score = cosines(q[row], x[at])
        smallest = np.array([i[0] for i in data.column("ids").to_pylist()], dtype=np.int64)
        by = np.lexsort((smallest[at], -score, row))
        row, at, score = row[by], at[by], score[by]
        kept = np.arange(len(row)) - np.searchsorted(row, row) <= k
        take = pa.array(row[kept])
        return pa.table([queries.column("key").take(take), queries.column("key2").take(take), pa.array(score[kept]), data.column("ids").take(pa.array(at[kept]))], schema=schema)

    found = visits.groupBy("shelf", "cut", "turn").cogroup(dealt.groupBy("shelf", "cut", "turn")).applyInArrow(search, "key long, key2 long, score double, ids array<long>")
    ranked = Window.partitionBy("key", "key2").orderBy(F.desc("score"), F.col("ids")[0])
    top = found.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1)
    lists = top.groupBy("key", "key2").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    # at most (k + 1) * (k + 1) candidates for each query
    pairs = asked.join(lists, ["key", "key2"]).select(F.col("id").alias("query_id"), F.explode("found").alias("f"))
    pairs = pairs.select("query_id", F.col("f.score").alias("score"), F.explode("f.ids").alias("vec_id")).where("vec_id <> query_id")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def visits_needed(placed: DataFrame, probes: pa.Table, tree, k: int, s: Settings) -> int:
    """The fewest leaves, best bin first, that hold ``recall`` of the probes' true neighbours among all other vectors."""
    if not probes.num_rows:
        return 1
    q = units(matrix(probes.column("v")))
    asked = placed.sparkSession.sparkContext.broadcast((q, probes.column("key").to_numpy()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = asked.value
        score, leaf = np.full((len(q), k), -2.0), np.full((len(q), k), -1, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                some = b.slice(at, 2048)
                cos = q @ units(matrix(some.column("v"))).T
                cos[own[:, None] == some.column("key").to_numpy()[None, :]] = -3.0
                near = np.hstack([score, cos])
                home = np.hstack([leaf, np.broadcast_to(some.column("leaf").to_numpy(), cos.shape)])
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                score, leaf = np.take_along_axis(near, top, 1), np.take_along_axis(home, top, 1)
        probe, at = np.nonzero(score > -2.0)
        yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(leaf[probe, at]), pa.array(score[probe, at])], ["probe", "leaf", "score"])

    # each task sends k rows for each probe; sums of those meet by probe
    near = placed.select("key", "v", "leaf").mapInArrow(exact, "probe long, leaf long, score double")
    by = Window.partitionBy("probe").orderBy(F.desc("score"), "leaf")
    truth = near.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k).select("probe", "leaf").collect()
    if not truth:
        return 1
    order = [{leaf: i for i, leaf in enumerate(tree.value.visits(x, tree.value.n_leaves))} for x in q]
    depth = np.sort([order[r["probe"]][r["leaf"]] for r in truth])
    return int(depth[min(len(depth) - 1, int(np.ceil(s.recall * len(depth))) - 1)]) + 1
