"""From raw documents to packed training sequences, in stages that each reread what the last one wrote."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglens.llm.compact_windows import repeated_passages
from dialoglens.llm.compression_rules import quality_rules
from dialoglens.llm.jaccard_join import jaccard_join
from dialoglens.llm.mixing import Targets, mixed_sample
from dialoglens.llm.packing import pack
from dialoglens.llm.queries import vocabulary
from dialoglens.llm.storage import Scratch
from dialoglens.llm.textops import PART_BYTES, parts, without_words

#: Sources, languages and topics move towards equal shares, and 85 % of the tokens stay.
MIX = Targets(temper={"source": 0.7, "lang": 0.85, "topic": 0.85}, budget=0.85)


def kept_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids``; rows without an id go, as no decision can name them."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; what stays is unchanged.

    Null, empty and blank texts go by the base rule, long ones are judged whole. Rows that share an id stay or
    go together: one that the rules keep keeps them all. Columns of any other name pass through.
    """
    return kept_ids(docs, quality_rules(docs).where("kept"))


def by_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays.

    Of rows that share an id the first in order of their columns stays, maps and variants, which have no order,
    aside. Texts without words are linked with nothing and stay. Columns of any other name pass through.
    """
    found = jaccard_join(docs).where("doc_id = component_id")
    rest, names = unused("rest", docs), [c for c in docs.columns if c != "doc_id"]
    ordered = [c for c in names if not any(x in docs.schema[c].dataType.simpleString() for x in ("map<", "variant"))]
    rows = kept_ids(docs, found).groupBy("doc_id").agg(F.min_by(F.struct(*names), F.struct(*ordered)).alias(rest) if ordered != names else F.min(F.struct(*names)).alias(rest))
    return rows.select("doc_id", f"{rest}.*").select(docs.columns)


def unused(name: str, docs: DataFrame) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def by_compact_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat one of a document with a smaller id are cut out; documents left without a word go.

    ``n_chars`` follows the text where there is such a column. Documents without repeated passages, null and
    empty texts and null ids among them, are unchanged. Rows that share id and text are cut alike, those that
    share the id alone by their own passages. Columns of any other name pass through.
    """
    names, length = docs.columns, docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    spans, key, kind = (unused(name, docs) for name in ("spans", "key", "kind"))
    found = repeated_passages(docs).groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(kind)).agg(F.collect_set(F.struct("start_word", "n_words")).alias(spans))
    found = Scratch(spark, "cut").save(found, "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text", PART_BYTES):
            texts = part.column("text").to_pylist()
            for i, some in enumerate(part.column(spans).to_pylist()):
                if some:
                    texts[i] = without_words(texts[i], [(x["start_word"], x["n_words"]) for x in some]) or None
            columns = {name: part.column(name) for name in names}
            changed = pa.array([s is not None for s in part.column(spans).to_pylist()])
            if length is not None:
                own = pa.array([len(t) if t is not None else 0 for t in texts]).cast(columns["n_chars"].type)
                columns["n_chars"] = pc.if_else(changed, own, columns["n_chars"])
            columns["text"] = pa.array(texts, columns["text"].type)
            kept = pc.or_(pc.invert(changed), pc.is_valid(columns["text"]))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(kept)

    own = (F.col("doc_id") == F.col(key)) & F.coalesce(F.col(kind) == F.xxhash64("text"), F.lit(True))
    return docs.join(found, own, "left").select(*names, spans).mapInArrow(cut, docs.schema)


def by_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn with the probabilities that bring the token mix to its targets.

    Rows that share an id are drawn alike; null sources and languages are cells of their own; texts without
    words are in a cell whose probability they don't change. Columns of any other name pass through.
    """
    return kept_ids(docs, mixed_sample(docs, MIX).where("kept"))


def by_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token sequences and where they are packed.

    Null and empty texts are one piece with the closing id alone; repeated rows are packed each.
    """
    return pack(docs, vocabulary("word_bpe_49k.json").decode())


STAGES = [
    ("quality_rules", by_quality_rules),
    ("jaccard_join", by_jaccard_join),
    ("compact_windows", by_compact_windows),
    ("mixing", by_mixing),
    ("packing", by_packing),
]

#: SQL has no zstandard ratios and no tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
