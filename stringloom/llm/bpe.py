"""Byte-level BPE as a monoid: encodings of neighbouring byte strings are joined, decodings concatenated.

``TreeCodec.encode_piece`` halves a long piece, encodes the halves and joins the two token lists. A join
re-encodes a window around the border and widens it until the tokens outside provably stay: a token list
is the encoding of its bytes exactly if every two neighbours are the encoding of their own bytes, and all
neighbours outside the window were neighbours before, so only the two seams need a test.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stringloom.llm.common import pick

LEAF_BYTES = 32
CACHE_PIECES = 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class TreeCodec:
    """Encoder and decoder for one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_BYTES):
        self.ranks, self.leaf = ranks, leaf
        self.none = max(ranks.values(), default=0) + 1
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.stable: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[str, int, bytes]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Lowest-rank-first merging of a short byte string; only the two pairs beside a merge get a new rank."""
        get, none = self.ranks.get, self.none
        parts = [data[i : i + 1] for i in range(len(data))]
        order = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while order and (best := min(order)) != none:
            at = order.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at < len(order):
                order[at] = get(parts[at] + parts[at + 1], none)
            if at:
                order[at - 1] = get(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def is_stable(self, left: int, right: int) -> bool:
        """Whether the two tokens next to each other are the encoding of their bytes."""
        found = self.stable.get((left, right))
        if found is None:
            if len(self.stable) > CACHE_PIECES:
                self.stable.clear()
            found = self.stable[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the two lists' bytes, one after the other; both must be encodings."""
        if not left or not right or self.is_stable(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.merge(b"".join(self.bytes_of[t] for t in (*left[len(left) - a :], *right[:b])))
            left_holds = a == len(left) or self.is_stable(left[len(left) - a - 1], window[0])
            right_holds = b == len(right) or self.is_stable(window[-1], right[b])
            if left_holds and right_holds:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if left_holds else 2 * a, b if right_holds else 2 * b

    def encode_piece(self, data: bytes) -> list[int]:
        """Tokens of one match of the splitting pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self._tree(data)

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self._tree(data[:half]), self._tree(data[half:]))

    def decode(self, tokens: list[int]) -> bytes:
        """Bytes of the tokens, concatenated up a binary tree."""
        level = [self.bytes_of[t] for t in tokens]
        while len(level) > 2:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return b"".join(level)

    def encode(self, text: str) -> list[int]:
        return [t for piece in self.split(text) for t in self.encode_piece(piece.encode())]

    def _piece(self, piece: str) -> tuple[str, int, bytes]:
        tokens = self.encode_piece(piece.encode())
        made = ",".join(map(str, tokens)), len(tokens), self.decode(tokens)
        if len(self.pieces) >= CACHE_PIECES:
            self.pieces.clear()
        if len(piece) <= 64:
            self.pieces[piece] = made
        return made

    def digest(self, text: str) -> tuple[int, str, str]:
        """(tokens, SHA-256 of the ids, SHA-256 of the decoded bytes), encoding each distinct piece once."""
        known, made = self.pieces, []
        for piece in self.split(text):
            made.append(known.get(piece) or self._piece(piece))
        if not made:
            empty = hashlib.sha256(b"").hexdigest()
            return 0, empty, empty
        ids, counts, raw = zip(*made)
        return sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()


_CODECS: dict[tuple[str, str], TreeCodec] = {}


def codec(path: str, pattern: str) -> TreeCodec:
    """One codec for each worker process and rank file."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = TreeCodec(load_ranks(path), pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens array<int>) of each document: the ids themselves, for a tokenised corpus.

    A null or empty text gives an empty list; repeated rows stay; texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            tokens = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(tokens, pa.list_(pa.int32()))], names=[id_col, "tokens"])

    named = pick(docs, id_col, text_col)
    kind = named.schema[id_col].dataType.simpleString()
    return named.mapInArrow(run, f"`{id_col}` {kind}, tokens array<int>")


def decode_tokens(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, data binary) from ``encode_documents``; a null list of tokens gives no bytes. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            data = [own.decode(t or []) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=[id_col, "data"])

    named = pick(df, id_col, "tokens")
    kind = named.schema[id_col].dataType.simpleString()
    return named.mapInArrow(run, f"`{id_col}` {kind}, data binary")


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes every whole text and keeps digests only.

    No shuffle. Null and empty texts have 0 tokens and the digests of no bytes; repeated rows and ids stay
    as they are; an empty table gives no rows; other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            made = [own.digest(t.as_py() or "") for t in batch.column(1)]
            counts, ids, raw = zip(*made) if made else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    named = pick(docs, id_col, text_col)
    kind = named.schema[id_col].dataType.simpleString()
    return named.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
