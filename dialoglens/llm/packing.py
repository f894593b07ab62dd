"""Packing token sequences into fixed windows by shortest-pack-first over the length histogram.

The histogram has one entry per length at most, so the plan is made on the driver from a few thousand counts
and holds for any number of documents; documents meet it by their rank among pieces of their length.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglens.llm.storage import Scratch
from dialoglens.llm.textops import hashes_at, parts, raw_bytes, word_places

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: The tokenizers whose ids are those of a text's words, one after another.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
LETTER, DIGIT, SIGN = 1, 2, 3
#: Apostrophes are no signs, as pre-tokens may start with them.
KIND = np.array([LETTER if 97 <= b <= 122 else DIGIT if 48 <= b <= 57 else SIGN if 33 <= b <= 126 and b != 39 and not 65 <= b <= 90 else 0 for b in range(256)], dtype=np.uint8)
_encoders: dict[int, Encoder] = {}


class Encoder:
    """Texts to ids as little-endian 32-bit integers, through a bounded memory of words.

    Where a tokenizer lower-cases, drops white space and ends its pre-tokens between ASCII letters, digits and
    signs, texts are cut there, each distinct word of a batch is looked up once by its 64-bit hash, and only
    words not met before are tokenised. The memory has two halves of ``limit`` words: what the older half
    holds and is met again moves to the newer one, and a full newer half replaces the older. Texts with a
    special token's name, and all texts of other tokenizers, are tokenised whole.
    """

    def __init__(self, spec: str, limit: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.limit, self.new, self.old = Tokenizer.from_str(spec), limit, {}, {}
        rules = json.loads(spec)
        steps, cut = rules.get("normalizer") or {}, (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_words = (
            [n.get("type") for n in steps.get("normalizers", [])] == NORMALIZERS
            and [n.get("pattern") for n in steps["normalizers"]][1] == {"Regex": r"\s+"}
            and cut[0].get("pattern") == {"Regex": PRETOKENS}
            and len(cut) == 2 and cut[1].get("type") == "ByteLevel" and not cut[1].get("add_prefix_space")
        )
        self.names = [t["content"].encode() for t in rules.get("added_tokens") or []]

    def encoded(self, texts: list[str], some: int = 2048) -> list[np.ndarray]:
        # the tokenizer's own results are large, so few texts at a time
        found = (self.model.encode_batch_fast(texts[at : at + some], add_special_tokens=False) for at in range(0, len(texts), some))
        return [np.array(e.ids, dtype="<u4") for few in found for e in few]

    def words(self, words: list[str]) -> list[bytes]:
        """Each word's ids. Words go together, between signs that none of them holds, as single calls cost more."""
        bar = self.model.token_to_id("|</w>")
        alone = [i for i, w in enumerate(words) if bar is None or "|" in w]
        apart = set(alone)
        joint = [i for i in range(len(words)) if i not in apart]
        out = [b""] * len(words)
        for i, ids in zip(alone, self.encoded([words[i] for i in alone]), strict=True):
            out[i] = ids.tobytes()
        texts = [" | ".join([words[i] for i in joint[at : at + 64]] + [""]) for at in range(0, len(joint), 64)]
        ids = np.concatenate([np.empty(0, "<u4"), *self.encoded(texts, 64)])
        held, at = ids.tobytes(), 0
        for i, end in zip(joint, (4 * np.flatnonzero(ids == bar)).tolist(), strict=True):
            out[i] = held[at:end]
            at = end + 4
        return out

    def whole(self, text: str | None) -> bytes:
        return self.encoded([text])[0].tobytes() if text else b""

    def looked_up(self, hashes: list[int], word: Callable[[int], str]) -> list[bytes]:
        """The ids of distinct words; ``word`` gives the one at a place."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        out = [self.new.get(h) for h in hashes]
        todo = []
        for i in [i for i, x in enumerate(out) if x is None]:
            if (x := self.old.get(hashes[i])) is None:
                todo.append(i)
            else:
                out[i] = self.new[hashes[i]] = x
        for i, x in zip(todo, self.words([word(i) for i in todo]), strict=True):
            out[i] = self.new[hashes[i]] = x
        return out

    def ids(self, column: pa.Array) -> list[bytes]:
        if not self.by_words:
            return [self.whole(t) for t in column.to_pylist()]
        raw, rows = raw_bytes(column)
        data = FOLDED[raw]
        kind = KIND[data]
        a, b = kind[:-1], kind[1:]
        cuts = 1 + np.flatnonzero((a == DIGIT) | (b == DIGIT) | (a + b == LETTER + SIGN) & (a > 0) & (b > 0))
        first, end = word_places(data, rows, cuts)
        hashes, at, back = np.unique(hashes_at(data, first, end, lower=False), return_index=True, return_inverse=True)
        held = data.tobytes()
        known = self.looked_up(hashes.tolist(), lambda i: held[first[at[i]] : end[at[i]]].decode("utf-8", "replace"))
        size = np.array([len(x) for x in known], dtype=np.int64) // 4
        every, begin = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        n = size[back]
        ids = every[np.repeat(begin[back] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        edge = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(first, rows)]
        out = [ids[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
        plain = raw.tobytes()
        if any(name in plain for name in self.names):
            for i in range(len(out)):
                if any(name in plain[rows[i] : rows[i + 1]] for name in self.names):
                    out[i] = self.whole(column[i].as_py())
        return out


def encoder(spec: str) -> Encoder:
    """One for all tasks of a worker."""
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def pieces(docs: DataFrame, spec: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises whole texts, adds ``end_id`` and cuts each into full windows and a rest."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for part in parts(batches, limit=1 << 20):
            rows = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), encode.ids(part.column("text")), strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(doc, at, min(window, n - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, PIECES)


def patterns(histogram: dict[int, int], window: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) for a histogram of lengths.

    Lengths go longest first. Each goes into the packs that are shortest so far (those with most room left);
    a new pack is opened only if no pack has room. A step ends a length or a pattern, so there are at most
    two patterns for each length.
    """
    packs: dict[int, list[list]] = {}
    roomy: list[int] = []

    def put(room: int, count: int, lengths: tuple[int, ...]) -> None:
        if room not in packs:
            packs[room] = []
            heapq.heappush(roomy, -room)
        packs[room].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left, made = histogram[length], []
        while left:
            if not roomy or -roomy[0] < length:
                made.append((window - length, left, (length,)))
                break
            room = -roomy[0]
            pack = packs[room][-1]
            take = min(left, pack[0])
            made.append((room - length, take, (*pack[1], length)))
            left -= take
            pack[0] -= take
            if not pack[0]:
                packs[room].pop()
                if not packs[room]:
                    del packs[room]
                    heapq.heappop(roomy)
            # packs that just took this length may take it again once no shorter pack is left
            if left and (not roomy or -roomy[0] < max(length, max(m[0] for m in made))):
                for m in made:
                    put(*m)
                made = []
        for m in made:
            put(*m)
    return [(c, lengths) for room in sorted(packs) for c, lengths in packs[room]]


@dataclass(frozen=True)
class Slots:
    """For each length, runs of ranks that share a pattern's slot. Sorted by (length, first rank)."""

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(plan: list[tuple[int, tuple[int, ...]]]) -> Slots:
        used: dict[int, int] = {}
        rows, base = [], 0
        for count, lengths in plan:
            at = 0
            for length in lengths:
                rank = used.get(length, 0)
                rows.append((length, rank, base, at))
                used[length] = rank + count
                at += length
            base += count
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        return Slots((table[:, 0] << 48) + table[:, 1], *table[:, 1:].T)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


def pack(docs: DataFrame, spec: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with the sequence and offset they are packed at.

    ``spec`` is the JSON of a tokenizer (a fixed file of a few megabytes). Columns:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, then ``padded_length``: what the
    sequence is padded to, ``window`` unless its tokens number a power of two. Null and empty texts are one
    piece with ``end_id`` alone; repeated rows are packed each; extra columns are not read; an empty table
    gives no rows. Ranks are dealt over groups within each length, as many as the square root of the commonest
    length's pieces, so that a length which many documents share is not ranked in one task.
    """
    spark = docs.sparkSession
    cut = Scratch(spark, "packing").save(pieces(docs, spec, window, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    salts = math.isqrt(max(histogram.values(), default=1))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    plan = patterns(histogram, window)
    slots = spark.sparkContext.broadcast(Slots.of(plan))
    sums = np.array([sum(lengths) for _, lengths in plan], dtype=np.int64)
    ends = np.cumsum([x[0] for x in plan], dtype=np.int64)

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    places = cut.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "salt"])
    places = places.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = slots.value.find(length, rank)
            total = sums[np.searchsorted(ends, sequence, side="right")] if len(sequence) else sequence
            padded = np.where(total & (total - 1), window, total)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(x.astype(np.int64)) for x in (sequence, offset, padded))], [*batch.schema.names[:5], "sequence_id", "offset", "padded_length"])

    return places.mapInArrow(place, f"{PIECES}, sequence_id long, offset long, padded_length long")
