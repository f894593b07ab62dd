"""Grouping (64-bit key, document) postings by key through compact Arrow blobs.

A task cuts its postings by key range and sends one row for each range, so the shuffle carries plain arrays.
The number of ranges grows with the postings, which keeps a range's arrays at a bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Postings that one range holds on average.
RANGE = 400_000


def n_ranges(postings: int, each: int = RANGE) -> int:
    n = 16
    while n * each < postings:
        n *= 2
    return n


def blobs(keys: np.ndarray, columns: dict[str, np.ndarray], ranges: int) -> pa.RecordBatch:
    """One row for each key range that occurs: ``bucket`` and the arrays as bytes, in their given order."""
    bucket = (keys >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    ends = np.append(edges[1:], len(bucket))[: len(edges)]
    every = {"keys": keys, **columns}
    cut = [pa.array([x[order[a:b]].tobytes() for a, b in zip(edges, ends, strict=True)], pa.binary()) for x in every.values()]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges], pa.int64()), *cut], ["bucket", *every])


def gathered(table: pa.Table, dtypes: dict[str, str]) -> dict[str, np.ndarray]:
    """The arrays of all blobs of a range, sorted by key, then in a fixed order of the other columns."""
    out = {name: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=d) for name, d in dtypes.items()}
    order = np.lexsort([*(out[name] for name in reversed(list(dtypes)))])
    return {name: x[order] for name, x in out.items()}


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and size of each run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))

