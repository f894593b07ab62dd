"""Byte-pair encoding of whole texts in linear time, and decoding by a table of offsets.

A pre-token's encoding is the one sequence of tokens in which each token is its own encoding and no merge would
have crossed a border between two neighbours. An Aho-Corasick automaton gives the longest token at each place in
one pass; going left to right, a token is taken if it is compatible with the one before, else its longest prefix
that is a token is tried, and where none is left the token before is given up. A place that was given up once
leads nowhere, so each is tried once.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglens.llm.packing import NORMALIZERS, PRETOKENS
from dialoglens.llm.textops import Memo, parts

#: Words of ASCII and of Latin letters that have one lower-case letter each and no decomposition left to undo.
SIMPLE = re.compile("[!-~À-ÖØ-öø-įı-ž]*")
#: The pre-tokens of ``PRETOKENS`` in such words, lower-cased.
CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^0-9a-zß-öø-ž]+")
#: Longer words are not remembered, so that the memory is bounded in bytes.
LONG = 48
#: Ids that are decoded at a time.
SLICE = 1 << 18
NEVER = 1 << 40
_built: dict[int, Bpe] = {}


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Bpe:
    """Tokens as strings over bytes (U+0000 to U+00FF) and, with an end-of-word mark, last bytes (256 further on)."""

    def __init__(self, spec: str, memory: int = 200_000):
        import ahocorasick
        from tokenizers import Tokenizer

        rules, self.library = json.loads(spec), Tokenizer.from_str(spec)
        model = rules["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("a byte-level BPE vocabulary is needed")
        self.vocab, self.mark = model["vocab"], model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        self.table = {ord(k): v for k, v in self.letters.items()}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        symbols = {self.vocab[c]: chr(b) for c, b in self.letters.items()}
        if self.mark:
            symbols |= {self.vocab[c + self.mark]: chr(256 + b) for c, b in self.letters.items()}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, both = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[left, right], self.rank[both], self.halves[both] = rank, rank, (left, right)
            symbols[both] = symbols[left] + symbols[right]
        self.length = [0] * (max(symbols) + 1)
        for token, text in symbols.items():
            self.length[token] = len(text)
        self.pairs = Memo(lambda pair: self.apart(*pair), 1 << 18)
        self.shorter = self.prefixes(symbols)
        self.matches = ahocorasick.Automaton()
        for token in self.shorter:
            self.matches.add_word(symbols[token], token)
        self.matches.make_automaton()
        added = rules.get("added_tokens") or []
        self.names = {t["content"]: t["id"] for t in added}
        self.split = re.compile("(" + "|".join(re.escape(n) for n in sorted(self.names, key=len, reverse=True)) + ")") if added else None
        steps, cut = rules.get("normalizer") or {}, (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_words = [n.get("type") for n in steps.get("normalizers", [])] == NORMALIZERS and cut[0].get("pattern") == {"Regex": PRETOKENS} and len(cut) == 2
        self.words = Memo(self.word, memory)
        self.known = Memo(lambda piece: np.array(self.encode(self.symbols(piece)), dtype="<u4").tobytes(), 2 * memory)
        self.pieces, self.offsets, self.between = self.decoder(rules)

    def prefixes(self, symbols: dict[int, str]) -> dict[int, int | None]:
        """Each token that is its own encoding, with the longest other one that begins it."""
        sound = {}
        for token, text in symbols.items():  # parts come before wholes
            halves = self.halves.get(token)
            if halves is None or (halves[0] in sound and halves[1] in sound and self.apart(*halves, self.rank[token])):
                sound[token] = text
        known = {text: token for token, text in sound.items()}
        return {token: next((known[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in known), None) for token, text in sound.items()}

    def apart(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether no merge ranked under ``before`` crosses the border of two tokens.

        Their merges are undone from the last on, the right one's first among equals, as merging goes from left
        to right; what then meets at the border must not have had an earlier turn.
        """
        while True:
            if self.merges.get((left, right), NEVER) < before:
                return False
            x, y = self.rank.get(left, -1), self.rank.get(right, -1)
            if x < 0 and y < 0:
                return True
            if y >= x:
                before, right = y + 1, self.halves[right][0]
            else:
                before, left = x, self.halves[left][1]

    def encode(self, text: str) -> list[int]:
        """The tokens of one pre-token, given in symbols."""
        longest = [0] * len(text)
        length, shorter, pairs = self.length, self.shorter, self.pairs
        for end, token in self.matches.iter(text):  # ends rise, so the longest of a start comes last
            longest[end + 1 - length[token]] = token
        out: list[int] = []
        at, token, dead = 0, longest[0], set()
        while True:
            end = at + length[token]
            if end not in dead and (not out or pairs[out[-1], token]):
                out.append(token)
                at = end
                if at == len(text):
                    return out
                token = longest[at]
                continue
            token = shorter[token]
            while token is None:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]

    def symbols(self, word: bytes) -> str:
        text = word.decode("latin-1")
        return text[:-1] + chr(256 + word[-1]) if self.mark else text

    def pretokens(self, text: str) -> list[bytes]:
        """The bytes of a text's pre-tokens; those of words that aren't simple by the library's own steps."""
        if self.by_words and SIMPLE.fullmatch(text):
            return [piece.encode() for piece in CUT.findall(text.lower())]
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return [piece.translate(self.table).encode("latin-1") for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def plain(self, text: str) -> bytes:
        """The ids of a text without names of added tokens; those of short pre-tokens are remembered."""
        known, encode, symbols = self.known, self.encode, self.symbols
        return b"".join([known[x] if len(x) <= LONG else np.array(encode(symbols(x)), dtype="<u4").tobytes() for x in self.pretokens(text)])

    def word(self, word: bytes) -> bytes:
        """A word's ids as little-endian 32-bit integers."""
        text = word.decode("utf-8", "replace")
        if self.split is None or not any(name in text for name in self.names):
            return self.plain(text)
        pieces = (p for p in self.split.split(text) if p)
        return b"".join(np.array([self.names[p]], dtype="<u4").tobytes() if p in self.names else self.plain(p) for p in pieces)

    def ids(self, text: str | None) -> bytes:
        """A whole text's ids. Where the tokenizer drops white space, words are encoded one by one, short ones once."""
        if not text:
            return b""
        raw = text.encode("utf-8", "replace")
        if not self.by_words:
            return self.word(raw)
        known, word = self.words, self.word
        return b"".join([known[w] if len(w) <= LONG else word(w) for w in raw.split()])

    def decoder(self, rules: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
        """All tokens' bytes behind one another, where each begins (one place more than ids), what lies between tokens."""
        kind = (rules.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder: {kind}")
        between = b"" if kind else b" "
        held = [b""] * (max([*self.vocab.values(), *self.names.values()]) + 1)
        for token, i in self.vocab.items():
            held[i] = bytes(self.letters[c] for c in token) if kind else token.encode() + between
        for name, i in self.names.items():
            held[i] = name.encode() + between
        return np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in held])]), between

    def text(self, ids: bytes) -> str:
        every, out = np.frombuffer(ids, "<u4").astype(np.int64), []
        for at in range(0, len(every), SLICE):
            some = every[at : at + SLICE]
            first, size = self.offsets[some], self.offsets[some + 1] - self.offsets[some]
            ends = np.cumsum(size)
            out.append(self.pieces[np.repeat(first - (ends - size), size) + np.arange(ends[-1])].tobytes())
        raw = b"".join(out)
        return (raw[: len(raw) - len(self.between)] if raw else raw).decode("utf-8", "replace")


def built(spec: str) -> Bpe:
    """One for all tasks of a worker."""
    key = zlib.crc32(spec.encode())
    if key not in _built:
        _built[key] = Bpe(spec)
    return _built[key]


def bpe_encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers) of every whole text.

    ``spec`` is the JSON of a byte-level BPE tokenizer, a fixed file of a few megabytes; names of its added tokens
    in a text are those tokens. Null and empty texts have no ids, null ids stay null, repeated rows have a row
    each, extra columns are not read, and an empty table gives no rows. A text is held whole by its task, however
    long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = built(shared.value)
        for part in parts(batches, limit=1 << 20):
            ids = [encoder.ids(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, spec: str) -> DataFrame:
    """Adds ``decoded`` to rows of ``bpe_encode``: what the tokenizer's own decoder writes, added tokens included."""
    shared = encoded.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = built(shared.value)
        for part in parts(batches, "ids", 1 << 20):
            texts = [decoder.text(x) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
