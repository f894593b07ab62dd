"""Compression of vectors to short codes: one small codebook of integer parts for each position.

Equal parts are first counted, so that each Lloyd round goes over distinct parts with their weights; the last
assignment is made once for each distinct part and joined back to the vectors that hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglens.llm.storage import Scratch

#: Integer components are kept within plus and minus this.
FAR = 1 << 62
#: Doubles add whole numbers exactly below this.
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1
#: A part held by at least one in so many vectors is joined by broadcast: there are at most that many for each position.
COMMON = 4096
#: Labels whose sums are broadcast; more are joined by a shuffle.
FEW_LABELS = 100_000
Codebooks = list[list[list[int]]]


def packed(values: np.ndarray) -> list[bytes]:
    """Each row's integers in the fewest bytes (2, 4 or 8 for each), so that equal rows have equal bytes."""
    out = [b""] * len(values)
    top = np.maximum(values.max(axis=1), -1 - values.min(axis=1)) if len(values) else np.empty(0)
    width = np.where(top < 1 << 15, 2, np.where(top < 1 << 31, 4, 8))
    for size in (2, 4, 8):
        rows = np.flatnonzero(width == size)
        held, step = values[rows].astype(f"<i{size}").tobytes(), size * values.shape[1]
        for i, row in enumerate(rows.tolist()):
            out[row] = held[i * step : (i + 1) * step]
    return out


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """The integers of ``packed`` rows, a row each."""
    held = column.to_pylist()
    sizes = np.fromiter(map(len, held), np.int64, len(held)) // width
    out = np.empty((len(held), width), dtype=np.int64)
    for size in (2, 4, 8):
        rows = np.flatnonzero(sizes == size)
        if len(rows):
            out[rows] = np.frombuffer(b"".join([held[i] for i in rows.tolist()]), f"<i{size}").reshape(-1, width)
    return out


def nearest(values: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lower of equals, and its squared distance: exact whole numbers."""
    entries = np.array(book, dtype=np.int64)
    reach = int(np.abs(values).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if reach * reach * values.shape[1] < EXACT:
        x, e = values.astype(np.float64), entries.astype(np.float64)
        off = (x * x).sum(axis=1)[:, None] - 2 * (x @ e.T) + (e * e).sum(axis=1)
        code = off.argmin(axis=1)
        return code, off[np.arange(len(code)), code].astype(np.int64)
    every = ((values.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(axis=2)
    code = np.array([min(range(len(book)), key=row.__getitem__) for row in every], dtype=np.int64)
    return code, np.array([min(int(row[c]), LARGEST) for row, c in zip(every, code, strict=True)], dtype=np.int64)


def positions(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each position in a batch of distinct parts: its number, its rows' places, their integers."""
    at = batch.column("pos").to_numpy(zero_copy_only=False)
    values = unpacked(batch.column("part"), width)
    for pos in np.unique(at).tolist():
        rows = np.flatnonzero(at == pos)
        yield pos, rows, values[rows]


def weighed(distinct: DataFrame, books: Codebooks, width: int) -> dict[tuple[int, int], list[int]]:
    """(position, entry) to the sums of its parts' components, then their number.

    Tasks send one row for each entry and component; what meets on the driver is as large as the codebooks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            weights = batch.column("weight").to_numpy(zero_copy_only=False)
            for pos, rows, values in positions(batch, width):
                w = weights[rows]
                code, _ = nearest(values, books[pos])
                small = int(np.abs(values).max(initial=1)) * int(w.sum()) < EXACT
                every = np.column_stack([values, np.ones(len(values), np.int64)])
                for entry in np.unique(code).tolist():
                    mine = code == entry
                    if small:
                        sums = (w[mine].astype(np.float64) @ every[mine].astype(np.float64)).astype(np.int64).astype(object)
                    else:
                        sums = w[mine].astype(object) @ every[mine].astype(object)
                    totals[pos, entry] = totals.get((pos, entry), 0) + sums
        rows = [(pos, entry, place, str(x)) for (pos, entry), sums in totals.items() for place, x in enumerate(sums)]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["pos", "entry", "place", "total"])

    parts = distinct.mapInArrow(run, "pos int, entry int, place int, total string")
    sums = parts.groupBy("pos", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out: dict[tuple[int, int], list[int]] = {}
    for r in sums.collect():
        out.setdefault((r["pos"], r["entry"]), [0] * (width + 1))[r["place"]] = int(r["total"])
    return out


def moved(books: Codebooks, sums: dict[tuple[int, int], list[int]]) -> Codebooks:
    """Each entry at the floored mean of its parts; one without parts stays."""
    return [[[x // sums[p, e][-1] for x in sums[p, e][:-1]] if (p, e) in sums else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def assigned(distinct: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """``pos, part, weight, code, error`` of distinct parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for pos, rows, values in positions(batch, width):
                codes[rows], errors[rows] = nearest(values, books[pos])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes), pa.array(errors)], [*batch.schema.names, "code", "error"])

    return distinct.mapInArrow(run, "pos int, part binary, weight long, code int, error long")


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector with finite components only.

    Components become ``floor(scale * x)``, vectors are cut into ``parts`` equal parts. Each position's codebook
    begins with the parts of the ``entries`` rows of smallest id (null ids last, equal ids by their parts; fewer
    rows give fewer entries), is moved ``rounds`` times and then gives the codes. ``label_error`` sums the errors
    of equal labels, nulls together. Null vectors and those with null, NaN or infinite components have no row;
    repeated rows and ids have a row each; an empty table gives none. Vectors shorter than the longest are filled
    with zeros, as is a length that ``parts`` doesn't divide. Integers beyond 2^62 count as that, errors beyond
    the largest long as the largest. Extra columns are not read.

    Parts go by shuffles of (position, part). Those that one vector in 4096 holds, 4096 a position at most, are
    joined back by a broadcast instead, so copies of one vector don't meet in one task.
    """
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vector.alias("v")).where(F.col("v").isNotNull() & finite)
    top = rows.agg(F.max(F.size("v")).alias("n")).first()["n"]
    width = max(1, -(-(top or 0) // parts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            table = np.zeros((batch.num_rows, parts * width))
            table[np.arange(parts * width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            whole = np.clip(np.floor(scale * table), -float(FAR), float(FAR)).astype(np.int64)
            held = packed(whole.reshape(-1, width))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(held) + 1, parts), pa.int32()), pa.array(held, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists], ["vec_id", "label", "parts"])

    label_type = rows.schema["label"].dataType.simpleString()
    kept = rows.mapInArrow(cut, f"vec_id long, label {label_type}, parts array<binary>")
    kept = scratch.save(kept.withColumn("row", F.monotonically_increasing_id()), "kept")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "parts").select("parts").limit(entries).collect()  # `entries` rows
    books = [[unpacked(pa.array([bytes(r["parts"][p])]), width)[0].tolist() for r in first] for p in range(parts)]

    exploded = kept.select("row", "vec_id", "label", F.posexplode("parts").alias("pos", "part"))
    distinct = scratch.save(exploded.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("weight")), "distinct")
    for _ in range(rounds if first else 0):
        books = moved(books, weighed(distinct, books, width))

    coded = scratch.save(assigned(distinct, books, width), "coded")
    scratch.drop("distinct")
    hot = F.col("weight") * COMMON >= F.lit(kept.count())
    # id and label ride with the first part only
    ride = exploded.select("row", *(F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("vec_id", "label")), "pos", "part")
    few = coded.where(hot).select("pos", "part", "code", "error")
    common = ride.join(F.broadcast(few), ["pos", "part"])
    other = ride.join(F.broadcast(few.select("pos", "part")), ["pos", "part"], "left_anti").join(coded.where(~hot).select("pos", "part", "code", "error"), ["pos", "part"])
    digits = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: F.lpad(F.lower(F.hex(x["code"])), 2, "0"))
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    out = common.unionByName(other).groupBy("row").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.array_join(digits, "").alias("code"), total.alias("error"))
    out = scratch.save(out.drop("row"), "vectors")
    scratch.drop("kept", "coded")
    sums = out.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    sums = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    return out.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
