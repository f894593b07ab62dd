"""Quality rules on word repetition and on zstandard compression bands.

One scan measures every text and its chunks; an aggregate over length classes fits the bands to all of them; the
measures, a few numbers for each text, are then judged. Texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglens.llm.storage import Scratch
from dialoglens.llm.textops import Memo, hashed, parts, windows, word_memo

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
REPEAT_WORDS = 8


@dataclass(frozen=True)
class Bands:
    """How allowed compressed/original sizes follow from the corpus.

    Inputs of similar length (a class for each doubling of bytes) share a band: on a logarithmic scale from
    ``fence`` quartile distances below the first quartile of their ratios to as many above the third; quartile
    distances count as ``spread`` at least. Chunks, the closing one too, have bands of their own lengths. A text
    fails if its own ratio leaves its band, or if more than ``bad_chunks`` of its chunks leave theirs.
    """

    level: int = 3
    chunk_bytes: int = 2048
    fence: float = 3.0
    spread: float = 0.05
    bad_chunks: float = 0.5
    accuracy: int = 10_000


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, size long, chunks array<long>"


def repeated_words(words: list[bytes], memo: Memo) -> int:
    """Words that lie in windows of eight words which occur at least twice in the text, by 64-bit hashes."""
    if len(words) <= REPEAT_WORDS:
        return 0
    w = windows(hashed(words, memo), REPEAT_WORDS)
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(w, twice))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + REPEAT_WORDS, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measured(text: str | None, bands: Bands, press: zstandard.ZstdCompressor, memo: Memo) -> tuple:
    """One text's row of ``MEASURES``: counts, bytes, compressed bytes, compressed bytes of each chunk."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACES)) if words else 0
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chunks = [len(press.compress(raw[at : at + bands.chunk_bytes])) for at in range(0, len(raw), bands.chunk_bytes)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words, memo), len(raw), len(press.compress(raw)), chunks


def fitted(sizes: DataFrame, bands: Bands) -> dict[int, tuple[float, float]]:
    """The band of each length class for rows of ``n_bytes, size``; a row for each doubling of length reaches the driver."""
    rows = sizes.where("n_bytes > 0").select(length_class(F.col("n_bytes")).alias("class"), F.log(F.col("size") / F.col("n_bytes")).alias("r"))
    found = rows.groupBy("class").agg(F.percentile_approx("r", [0.25, 0.75], bands.accuracy).alias("q")).collect()
    out = {}
    for r in found:
        low, high = r["q"]
        far = bands.fence * max(high - low, bands.spread)
        out[r["class"]] = (math.exp(low - far), math.exp(high + far))
    return out


def length_class(n_bytes: Column) -> Column:
    return F.floor(F.log2(n_bytes.cast("double")) + 1e-12).cast("int")


def side(n_bytes: Column, size: Column, band: dict[int, tuple[float, float]]) -> Column:
    """-1 below the band of its length class, 1 above, else 0."""
    low, high = (F.create_map(*(F.lit(x) for k, v in band.items() for x in (k, v[i]))) if band else F.create_map().cast("map<int,double>") for i in (0, 1))
    kind, ratio = length_class(n_bytes), F.try_divide(size, n_bytes)
    return F.when(ratio < F.try_element_at(low, kind), -1).when(ratio > F.try_element_at(high, kind), 1).otherwise(0)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per input row: the id as ``doc_id``, counts, ratios, ``base_failed``, ``kept`` and ``verdict``.

    ``verdict`` is base, repetitive, incompressible, chunks or kept. A null text has no words and fails the base
    rule (so do empty and blank ones); repeated rows and tied values are judged alike; other columns are not
    read; an empty table gives no rows. Bands are fitted to all rows (quartiles to within 1 / ``accuracy`` in
    rank), so what makes up a quarter of a length class is never outside them.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, memo = zstandard.ZstdCompressor(level=bands.level), word_memo()
        for part in parts(batches):
            rows = [measured(t, bands, press, memo) for t in part.column("text").to_pylist()]
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = Scratch(docs.sparkSession, "rules").save(narrow.mapInArrow(run, f"doc_id long, {MEASURES}"), "measures")
    whole = fitted(rows.select("n_bytes", "size"), bands)
    length = F.least(F.lit(bands.chunk_bytes).cast("long"), F.col("n_bytes") - F.col("i") * bands.chunk_bytes)
    chunk = fitted(rows.select("n_bytes", F.posexplode("chunks").alias("i", "size")).select(length.alias("n_bytes"), "size"), bands)

    n_chunks = F.size("chunks")
    # all chunks but the last are full
    full = F.filter(F.slice("chunks", 1, F.greatest(n_chunks - 1, F.lit(0))), lambda c: side(F.lit(bands.chunk_bytes), c, chunk) != 0)
    last = F.when(n_chunks > 0, (side(F.col("n_bytes") - (n_chunks - 1) * bands.chunk_bytes, F.element_at("chunks", -1), chunk) != 0).cast("int")).otherwise(0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "ratio": F.when(F.col("n_bytes") > 0, F.col("size") / F.col("n_bytes")), "n_chunks": n_chunks.cast("long"), "n_bad_chunks": (F.size(full) + last).cast("long"), "out": side(F.col("n_bytes"), F.col("size"), whole)})
    verdict = F.when(F.col("base_failed"), "base").when(F.col("out") < 0, "repetitive").when(F.col("out") > 0, "incompressible").when(F.col("n_bad_chunks") > bands.bad_chunks * F.col("n_chunks"), "chunks").otherwise("kept")
    rows = rows.withColumn("verdict", verdict)
    return rows.select("doc_id", *names[:5], "base_failed", (F.col("verdict") == "kept").alias("kept"), "n_bytes", "ratio", "n_chunks", "n_bad_chunks", "verdict")
