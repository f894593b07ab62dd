"""N-gram Jaccard join: exact components of near-duplicate documents by prefix trees.

A document keeps at least ``percent`` of its shingles in any partner, so at most a fifth (for 80) of them may
be its own. Two filters use that bound with the shingles that several distinct sets hold: first on a head of
each set in hash order, then on whole sets. What survives is mostly true families. Sets are ordered by rising
document frequency; those that share an element of their prefixes form a block; a prefix tree joins a block,
or parts of it where it is large. Equal sets count once throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglens.llm.bloom import BlockedBloom
from dialoglens.llm.components import components
from dialoglens.llm.postings import blobs, gathered, n_ranges, runs
from dialoglens.llm.prefix_tree import linked
from dialoglens.llm.storage import Scratch
from dialoglens.llm.textops import mixed, parts, row_shingles


@dataclass(frozen=True)
class Settings:
    """``part``: sets that one task's tree holds; larger blocks are joined part by part."""

    width: int = 5
    percent: int = 80
    part: int = 1500


def spare(n, percent: int):
    """Shingles that a set of ``n`` may hold alone and still have a partner."""
    return (n * (100 - percent)) // 100


#: Bytes of text whose shingles a task holds at a time.
PART = 1 << 20


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    every, n = row_shingles(texts, width)
    return [np.unique(x) for x in np.split(every, np.cumsum(n)[:-1])] if len(n) else []


def signatures(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, f1, f2, head``: set size, a 128-bit fingerprint of the set, its smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, limit=PART):
            n, f1, f2, head = [], [], [], []
            for own in shingle_sets(part.column("text"), s.width):
                n.append(len(own))
                f1.append(mixed(own ^ np.uint64(0x51ED270B)).sum(dtype=np.uint64).astype(np.int64))
                f2.append(np.bitwise_xor.reduce(mixed(own + np.uint64(0x2545F491)), initial=np.uint64(0)).astype(np.int64))
                head.append(own[: spare(len(own), s.percent) + max(1, len(own) // 10)].tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(head, pa.binary())], ["doc_id", "n", "f1", "f2", "head"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, head binary")


def dealt(sets: DataFrame, column: str, ranges: int) -> DataFrame:
    """``bucket, keys, doc``: postings of the 64-bit values in ``column``, cut by value range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, column):
            own = [np.frombuffer(x, np.uint64) for x in part.column(column).to_pylist()]
            doc = np.repeat(part.column("doc_id").to_numpy(), [len(x) for x in own])
            yield blobs(np.concatenate(own), {"doc": doc}, ranges)

    return sets.select("doc_id", column).mapInArrow(run, "bucket long, keys binary, doc binary")


KINDS = {"keys": "u8", "doc": "i8"}


def shared_in_head(classes: DataFrame, ranges: int) -> DataFrame:
    """``doc_id, shared``: how many of a set's head other sets' heads hold, too (summed over ranges)."""

    def count(table: pa.Table) -> pa.Table:
        got = gathered(table, KINDS)
        first, size = runs(got["keys"])
        doc, n = np.unique(got["doc"][np.repeat(size, size) > 1], return_counts=True)
        return pa.table({"doc_id": doc, "shared": n.astype(np.int64)})

    found = dealt(classes, "head", ranges).groupBy("bucket").applyInArrow(count, "doc_id long, shared long")
    return found.groupBy("doc_id").agg(F.sum("shared").alias("shared"))


def ordered_sets(sets: DataFrame, ranges: int, percent: int) -> DataFrame:
    """``doc_id, n, keys, dfs``: the shingles that several sets hold, by rising document frequency, then by hash.

    Sets with too few of them are left out: they can't have a partner.
    """

    def count(table: pa.Table) -> pa.Table:
        got = gathered(table, KINDS)
        _, size = runs(got["keys"])
        df = np.repeat(size, size)
        many = df > 1
        doc = got["doc"][many]
        return pa.Table.from_batches([blobs(mixed(doc.view(np.uint64)), {"doc": doc, "key": got["keys"][many], "df": df[many].astype(np.int64)}, ranges)])

    def order(table: pa.Table) -> pa.Table:
        got = gathered(table, {"keys": "u8", "doc": "i8", "df": "i8", "key": "u8"})
        first, size = runs(got["doc"])
        cut = [(x, x + n) for x, n in zip(first, size, strict=True)]
        return pa.table({"doc_id": got["doc"][first], "keys": pa.array([got["key"][x:y].tobytes() for x, y in cut], pa.binary()), "dfs": pa.array([got["df"][x:y].tobytes() for x, y in cut], pa.binary())})

    by_key = dealt(sets, "keys", ranges).groupBy("bucket").applyInArrow(count, "bucket long, keys binary, doc binary, key binary, df binary")
    by_doc = by_key.groupBy("bucket").applyInArrow(order, "doc_id long, keys binary, dfs binary")
    enough = F.octet_length("keys") / 8 >= F.col("n") - F.floor(F.col("n") * (100 - percent) / 100)
    return by_doc.join(sets.select("doc_id", "n"), "doc_id").where(enough).select("doc_id", "n", "keys", "dfs")


def prefix_edges(ordered: DataFrame, percent: int) -> DataFrame:
    """``a, b``: each set with the smallest document that has one of its prefix elements in its own prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = [], []
            for doc, n, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "keys")), strict=True):
                own = np.frombuffer(own, np.int64)
                # the elements that no other set holds come first in the order and fill part of the prefix
                keys.append(own[: spare(n, percent) + 1 - (n - len(own))])
                docs.append(np.full(len(keys[-1]), doc))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(docs))], ["key", "doc_id"])

    posts = ordered.select("doc_id", "n", "keys").mapInArrow(run, "key long, doc_id long")
    least = posts.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("key", "a")
    return posts.join(least, "key").select("a", F.col("doc_id").alias("b")).where("a <> b").distinct()


def tree_links(blocks: DataFrame, s: Settings) -> DataFrame:
    """``a, b``: links that connect each block's components (columns ``block, doc_id, n, keys, dfs``).

    A block of up to ``part`` sets is one tree. A larger one is cut by size class (partners differ in size by
    less than a class) and by a hash into parts of about ``part`` sets; each part meets itself, the parts of
    its class and those of the next.
    """
    step = 100 / s.percent
    rows = blocks.withColumn("class", F.floor(F.log(step, F.col("n").cast("double")) + 1e-9))
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("members"))
    cells = rows.groupBy("block", "class").agg(F.ceil(F.count(F.lit(1)) / s.part).cast("long").alias("cuts"))
    below = cells.select("block", (F.col("class") + 1).alias("class"), F.col("cuts").alias("cuts_below"))
    above = cells.select("block", (F.col("class") - 1).alias("class"), F.col("cuts").alias("cuts_above"))
    around = cells.join(below, ["block", "class"], "left").join(above, ["block", "class"], "left").join(sizes, "block")
    around = around.na.fill(0, ["cuts_below", "cuts_above"]).withColumnRenamed("block", "block_").withColumnRenamed("class", "class_")
    rows = rows.join(around, (F.col("block") == F.col("block_")) & (F.col("class") == F.col("class_"))).drop("block_", "class_")
    rows = rows.withColumn("cut", F.pmod(F.xxhash64("doc_id"), "cuts"))

    def turn(low: str, a: str, high: str, b: str, side: int) -> str:
        return f"named_struct('low', cast({low} as long), 'a', cast({a} as long), 'high', cast({high} as long), 'b', cast({b} as long), 'side', {side})"

    def upto(c: str) -> str:
        return f"if({c} > 0, sequence(0L, {c} - 1), cast(array() as array<bigint>))"

    split = f"""concat(
        transform({upto("cuts")}, x -> {turn("class", "least(cut, x)", "class", "greatest(cut, x)", 0).replace("'side', 0", "'side', if(cut = x, 0, if(cut < x, 1, 2))")}),
        transform({upto("cuts_above")}, x -> {turn("class", "cut", "class + 1", "x", 1)}),
        transform({upto("cuts_below")}, x -> {turn("class - 1", "x", "class", "cut", 2)}))"""
    rows = rows.withColumn("turn", F.explode(F.expr(f"if(members <= {s.part}, array({turn('-1', '0', '-1', '0', 0)}), {split})")))

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        doc, n, side = (table.column(c).to_numpy() for c in ("doc_id", "n", "side"))
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        df = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("dfs").to_pylist()])
        every, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        rank = np.empty(len(every), dtype=np.int64)
        rank[np.lexsort((every, df[first]))] = np.arange(len(every))
        sets = np.split(rank[at], np.cumsum([len(k) for k in keys])[:-1])
        root = linked(sets, n, side, s.percent)
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": doc[root[far]], "b": doc[far]})

    rows = rows.select("block", "turn.low", "turn.a", "turn.high", "turn.b", "turn.side", "doc_id", "n", "keys", "dfs")
    return rows.groupBy("block", "low", "a", "high", "b").applyInArrow(join, "a long, b long").distinct()


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Words are lower-cased in A-Z only; a set holds the distinct ``width``-word shingles, the whole sequence if
    the text is shorter, nothing for null, empty and blank texts, which link with nothing. Two rows link if
    100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id reached by links. Equal
    sets are linked; repeated rows are rows of their own with the same id; a null id gets no component but
    its set counts for no one either. Other columns are not read; an empty table gives no rows. Shingles are
    compared by 64-bit hashes.
    """
    s, spark = settings, docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    known = scratch.save(signatures(docs, s, id_col, text_col), "signatures")
    sound = known.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.save(sound.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    one_each = sound.join(reps, "doc_id").where("f1 = g1 and f2 = g2").dropDuplicates(["doc_id", "f1", "f2"]).select("doc_id", "n", "head")
    total = sound.agg(F.coalesce(F.sum(F.octet_length("head")), F.lit(0))).first()[0] // 8
    shared = shared_in_head(one_each, n_ranges(total))
    # of the head, all but the spare ones must be shared
    need = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.min(F.greatest(F.lit(1), F.floor(F.col("n") / 10))).alias("need"))
    likely = scratch.save(shared.join(need, "doc_id").where("shared >= need").select("doc_id"), "likely")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(map(bloom.among, batches), limit=PART):
            own = shingle_sets(part.column("text"), s.width)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["doc_id", "n", "keys"])

    bloom = BlockedBloom.of(likely, "doc_id")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    found = texts.select("doc_id", "text", *bloom.probes(F.col("doc_id"))).mapInArrow(whole, "doc_id long, n long, keys binary").where("n > 0")
    sets = scratch.save(found.join(likely, "doc_id", "left_semi").dropDuplicates(["doc_id", "keys"]), "sets")
    postings = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ordered = scratch.save(ordered_sets(sets, n_ranges(postings), s.percent), "ordered")
    families = components(prefix_edges(ordered, s.percent), scratch, "blocks")
    blocks = ordered.join(families.select(F.col("node").alias("doc_id"), F.col("root").alias("block")), "doc_id")
    found = components(tree_links(blocks, s), scratch, "links")
    roots = classes.join(found, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n", F.coalesce("root", "rep").alias("component_id"))
    rows = known.select("doc_id", "n", "f1", "f2").join(roots, ["f1", "f2", "n"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
