"""Keyed tables in hash buckets, of which an update rewrites only those it touches, and an index of chunks on top.

A version is a small file that names each bucket's folder; it appears whole, so readers see the old version or
the new one. Folders that neither the newest version nor the one before names are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dialoglens.operators.retrieval import chunked
from dialoglens.operators.vectors import hashed_vectors
from dialoglens.sources.storage import Files, kept


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest ``order``, whole."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in others)).select(rows.columns)


def same(names: Iterable[str]):
    """A null-safe join condition between ``a`` and ``b``."""
    return reduce(lambda x, y: x & y, (F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names))


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, by: list[str], buckets: int = 16):
        self.spark, self.path, self.by, self.buckets, self.files = spark, path, by, buckets, Files(spark, path)

    def bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def version(self) -> tuple[int, dict]:
        names = self.files.names("_versions")
        return (int(names[-1]), json.loads(self.files.read(f"_versions/{names[-1]}"))) if names else (-1, {"buckets": {}, "schema": None})

    def scan(self, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The newest version, or some of its buckets; None before the first. Columns that a bucket lacks are null."""
        held = self.version()[1]
        if held["schema"] is None:
            return None
        folders = [f for b, f in held["buckets"].items() if buckets is None or int(b) in set(buckets)]
        schema = StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # as many as buckets

    def swap(self, rows: DataFrame, touched: list[int], whole: bool = False) -> None:
        """Puts ``rows``, all of touched buckets, in their place. ``whole``: nothing else stays."""
        number, held = self.version()
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket_", self.bucket()).repartition(F.col("bucket_")).write.partitionBy("bucket_").parquet(f"{self.path}/{folder}")
        found = {n.removeprefix("bucket_=") for n in self.files.names(folder) if n.startswith("bucket_=")}
        stay = {} if whole else {b: f for b, f in held["buckets"].items() if int(b) not in touched}
        new = {"buckets": stay | {b: f"{folder}/bucket_={b}" for b in found}, "schema": json.loads(rows.schema.json())}
        if not self.files.claim(f"_versions/{number + 1:010d}", json.dumps(new)):
            self.files.remove(folder)
            raise RuntimeError(f"another writer changed {self.path}")
        self.clear(number + 1)

    def clear(self, newest: int) -> None:
        names = [n for n in self.files.names("_versions") if int(n) >= newest - 1]
        used = {f for n in names for f in json.loads(self.files.read(f"_versions/{n}"))["buckets"].values()}
        for n in set(self.files.names("_versions")) - set(names):
            self.files.remove(f"_versions/{n}")
        for data in self.files.names("data"):
            mine = [f"data/{data}/{b}" for b in self.files.names(f"data/{data}")]
            if not any(m in used for m in mine):
                self.files.remove(f"data/{data}")
            else:
                for m in mine:
                    if "bucket_=" in m and m not in used:
                        self.files.remove(m)

    def upsert(self, new: DataFrame, keys: list[str], order: str) -> list[int]:
        """The latest row of each key stays; columns may be added. Gives the rewritten buckets, none if nothing is new."""
        old = self.scan()
        fresh = new
        if old is not None and set(new.columns) <= set(old.columns):
            fresh = kept(new.alias("a").join(old.alias("b"), same(new.columns), "left_anti").select(new.columns), "fresh")
        touched = self.touched(fresh)
        if touched:
            part = self.scan(touched)
            both = fresh if part is None else part.unionByName(fresh, allowMissingColumns=True)
            self.swap(latest(both, keys, order), touched)
        return touched

    def rebuild(self, rows: DataFrame) -> None:
        """Drops all rows for these."""
        self.swap(rows, [], whole=True)


class ChunkIndex:
    """Child chunks of texts with their hashed vectors; texts that have not changed cost a comparison of hashes."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.table = BucketTable(spark, path, ["source_id"], buckets)

    def rows(self, texts: DataFrame) -> DataFrame:
        """``source_id, text_hash, chunk_id, parent_chunk_id, content, token_count, v``; a text without words has one row without a chunk."""
        cut = chunked(texts, "source_id", "text", also=["text_hash"]).where("level = 'child'")
        names = ["source_id", "text_hash", "chunk_id", "parent_chunk_id", "content", "token_count"]
        # vectors are added to the chunks' own rows, so that texts are cut once and no content is shuffled
        whole = hashed_vectors(cut, "source_id", "content", also=names[1:])
        bare = texts.where(~F.coalesce("text", F.lit("")).rlike(r"\S")).select("source_id", "text_hash")
        return whole.select(*names, "v").unionByName(bare, allowMissingColumns=True)

    @staticmethod
    def named(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return texts.select(F.col(id_col).alias("source_id"), F.col(text_col).alias("text"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_hash"))

    def update(self, texts: DataFrame, id_col: str, text_col: str) -> list[int]:
        """Brings the index to these texts (ids tell them apart) and gives the rewritten buckets: changed, new and vanished texts' only."""
        now, old = self.named(texts, id_col, text_col), self.table.scan()
        if old is None:
            self.table.rebuild(self.rows(now))
            return list(range(self.table.buckets))
        held = old.select("source_id", "text_hash").distinct()
        ids = now.select("source_id", "text_hash")
        changed = ids.alias("a").join(held.alias("b"), same(["source_id", "text_hash"]), "left_anti")
        gone = held.alias("a").join(ids.alias("b"), same(["source_id"]), "left_anti")
        moved = kept(changed.select("source_id").unionByName(gone.select("source_id")).distinct(), "moved")
        touched = self.table.touched(moved)
        if touched:
            stay = self.table.scan(touched).alias("a").join(moved.alias("b"), same(["source_id"]), "left_anti")
            renewed = now.alias("a").join(moved.alias("b"), same(["source_id"]), "left_semi")
            self.table.swap(stay.unionByName(self.rows(renewed)), touched)
        return touched

    def rebuild(self, texts: DataFrame, id_col: str, text_col: str) -> None:
        self.table.rebuild(self.rows(self.named(texts, id_col, text_col)))

    def scan(self) -> DataFrame:
        """All child chunks."""
        return self.table.scan().where("chunk_id is not null")
