"""Small helpers that run inside tasks: words, hashes and Arrow batches of bounded size."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that a task holds as Python objects at a time (a single longer text is still whole).
PART_BYTES = 2 << 20


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows whose ``column`` holds at most ``limit`` bytes, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


class Memo(dict):
    """Remembers ``make(key)``; empties itself at ``limit`` keys so that memory stays bounded."""

    def __init__(self, make: Callable, limit: int = 100_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def word_memo(limit: int = 100_000) -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, limit)


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """The runs of characters other than space and U+0009..U+000D; ``lower`` maps A-Z only."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hashed(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads all bits (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A-Z as a-z, other bytes as they are.
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Words of more bytes are hashed one by one.
SHORT = 64
#: The lowest bytes of eight, by their number.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1 modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1024), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row's begin (one entry more than rows); nulls are empty."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_binary())
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return held, at - at[0]


def word_places(data: np.ndarray, rows: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all rows start and end in ``data``; no word reaches over a row's end or a place in ``cuts``."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    space = SPACE[data]
    before, after = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
    before[1:], after[:-1] = space, space
    before[rows] = after[rows] = True
    if cuts is not None:
        before[cuts] = after[cuts] = True
    return np.flatnonzero(~space & before[:-1]), np.flatnonzero(~space & after[1:]) + 1


def hashed_words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows in order, and each row's number of words.

    Words are those of ``words_of``; none becomes a Python object unless it is long.
    """
    data, rows = raw_bytes(column)
    first, end = word_places(data, rows)
    return hashes_at(data, first, end, lower), np.diff(np.searchsorted(first, rows))


def hashes_at(data: np.ndarray, first: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word of ``data``: eight bytes at a time are mixed into its state, which begins as its length.

    Every step mixes all bits, so no pattern of letters cancels out. Long words take xxh3 of their bytes.
    """
    held = np.concatenate([LOWERED[data] if lower else data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(held) - 7, "<u8", held, strides=(1,))
    size = end - first
    out = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo, at = np.flatnonzero(size <= SHORT), 0
    while len(todo):
        left = size[todo] - at
        out[todo] = mixed(out[todo] ^ (eight[first[todo] + at] & MASKS[np.minimum(left, 8)]))
        todo, at = todo[left > 8], at + 8
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(held[first[i] : end[i]])
    return out


def row_shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of all rows in order, and each row's number of them.

    A row with fewer words, but one at least, has one: the hash of the whole sequence.
    """
    words, n = hashed_words(column)
    every = windows(words, width)
    first = np.cumsum(n) - n
    size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    short = np.flatnonzero((n > 0) & (n < width))
    out = np.append(every, np.zeros(width, np.uint64))[np.minimum(at, len(every))]
    out[(np.cumsum(size) - size)[short]] = [mixed(windows(words[first[i] : first[i] + n[i]], int(n[i])) + np.uint64(n[i]))[0] for i in short]
    return out, size


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mixed(out)


def shingles(words: list[bytes], memo: Memo, width: int = 5) -> np.ndarray:
    """Hashes of all ``width``-word shingles in order; of the whole sequence if there are fewer words."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hashed(words, memo)
    if len(words) >= width:
        return windows(h, width)
    return mixed(windows(h, len(words)) + np.uint64(len(words)))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of (first, number) spans and the white space behind them; '' if no word is left."""
    words = [m.span() for m in WORD.finditer(text)]
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for first, n in spans:
        gone[first] += 1
        gone[min(first + n, len(words))] -= 1
    gone = np.cumsum(gone)[: len(words)] > 0
    if gone.all():
        return ""
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(text[at : words[a][0]])
        at = words[b][0] if b < len(words) else len(text)
    return "".join([*out, text[at:]])
