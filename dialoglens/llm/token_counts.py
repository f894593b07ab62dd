"""Unigram token counts of documents: words share their prefixes' forward scores in a trie.

Each task keeps its own trie of the distinct pre-tokens it has met, so counting is one scan with no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglens.llm.textops import parts, words_of

SPACE = "▁"


def pieces_of(model: bytes) -> dict[str, float]:
    """Log probabilities of a SentencePiece model's pieces by Zipf's law on their rank (the file has ranks only).

    Control pieces and pieces without a rank are left out; ``<0xNN>`` are the byte pieces.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and sp.get_score(i) > -1e8]
    total = math.log(sum(1 / (r + 2) for r in range(len(names))))
    return {p: -math.log(r + 2) - total for r, p in enumerate(sorted(names, key=lambda p: (p.startswith("<0x"), -sp.get_score(sp.piece_to_id(p)))))}


class Trie:
    """Distinct pre-tokens with, at each node, the best score and token count of its prefix.

    A node's forward score depends on the path to it alone, so words with a common prefix share it. Equal
    scores: fewer tokens. A character without a piece is spelt by its byte pieces. At ``limit`` nodes the
    trie starts anew; counts don't depend on that.
    """

    def __init__(self, pieces: dict[str, float], limit: int = 600_000):
        self.pieces, self.limit = pieces, limit
        self.longest = max((len(p) for p in pieces if not p.startswith("<0x")), default=1)
        self.byte = {b: pieces.get(f"<0x{b:02X}>", min(pieces.values(), default=0.0) - 10.0) for b in range(256)}
        self.reset()

    def reset(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count, self.terminal = [0.0], [0], {}

    def forward(self, word: str, end: int, path: list[int]) -> tuple[float, int]:
        """The best (score, tokens) of ``word[:end]``, given the nodes of its shorter prefixes."""
        spelt = word[end - 1].encode("utf-8", "surrogatepass")
        best, fewest = self.score[path[end - 1]] + sum(self.byte[b] for b in spelt), self.count[path[end - 1]] + len(spelt)
        for start in range(max(0, end - self.longest), end):
            if (p := self.pieces.get(word[start:end])) is not None:
                score, count = self.score[path[start]] + p, self.count[path[start]] + 1
                if score > best or score == best and count < fewest:
                    best, fewest = score, count
        return best, fewest

    def insert(self, word: str) -> int:
        """Adds the word's missing nodes; returns the token count at its last node."""
        node, path = 0, [0]
        for end, char in enumerate(word, 1):
            key = (node, char)
            node = self.child.get(key, 0)
            if not node:
                score, count = self.forward(word, end, path)
                node = self.child[key] = len(self.score)
                self.score.append(score)
                self.count.append(count)
            path.append(node)
        return self.count[node]

    def counts(self, words: list[bytes]) -> np.ndarray:
        if len(self.score) >= self.limit:
            self.reset()
        known = self.terminal
        for w in sorted(set(words) - known.keys()):
            known[w] = self.insert(SPACE + w.decode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def token_counts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = 600_000) -> DataFrame:
    """``doc_id``, ``n_pretokens`` and ``n_tokens`` of every row's whole text.

    ``model`` holds the bytes of a SentencePiece model (a fixed file of about a megabyte, sent to executors
    once). Pre-tokens are the words between white space, each with a leading space mark. Null, empty and
    blank texts have zero tokens; repeated rows are each counted; other columns are not read; an empty table
    gives no rows.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(pieces_of(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(pieces.value, limit)
        for part in parts(batches):
            words = [words_of(t, lower=False) for t in part.column("text").to_pylist()]
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            each = np.concatenate([[0], np.cumsum(trie.counts([x for w in words for x in w]))])
            ends = np.cumsum(sizes)
            tokens = each[ends] - each[ends - sizes]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(tokens.astype(np.int64))], ["doc_id", "n_pretokens", "n_tokens"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
