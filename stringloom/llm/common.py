"""Vectorised kernels and plan helpers that several operators share.

A word is a maximal run of bytes outside the ASCII white space 0x20, 0x09-0x0D. Texts stay in Arrow
buffers: word borders and word fingerprints come from whole-buffer numpy passes over bounded chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.places import positions  # noqa: F401  (for the operators beside this module)

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd and 5 modulo 8, so that powers of it have long periods
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the base and of its inverse, long enough for the largest chunk seen."""

    size = 0

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.size:
            cls.size = max(n, 2 * CHUNK_BYTES)
            cls.up, cls.down = _powers(_BASE, cls.size), _powers(_INVERSE, cls.size)
        return cls.up[:n], cls.down


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, row borders in the bytes) for runs of rows of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, borders, data = column.buffers()
    borders = np.frombuffer(borders, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + limit, side="right")) - 1)
        yield i, j - i, data[borders[i] : borders[j]], borders[i : j + 1] - borders[i]
        i = j


def word_spans(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, its end, for each row the first word) of a chunk; the last holds rows + 1 entries."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(borders), np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cuts = np.unique(borders[(borders > 0) & (borders < len(data))])
    first[cuts] |= solid[cuts]
    last[cuts - 1] |= solid[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, borders)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes, equal for equal words wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Tables.get(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    out = (total[ends] - total[starts]) * down[starts]
    return mix64(out + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingles(words: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Fingerprints of each ``width`` consecutive entries, row borders ignored."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = np.uint64((0x2545F4914F6CDD1D + 2 * seed * 0x9E3779B97F4A7C15) & (2**64 - 1) | 5)
    for k in range(width):
        total *= factor
        total += words[k : k + n]
    return mix64(total ^ np.uint64(seed * 0x632BE59BD9B4E019 & (2**64 - 1)))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows with equal ``key`` from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        values = keys.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(values[1:] != values[:-1]) + 1
        parts = [batch.slice(a, b - a) for a, b in zip([0, *edges], [*edges, batch.num_rows])]
        for part in parts:
            if held and held[0].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, key: str, kernel: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, partitions: int | None = None) -> DataFrame:
    """``kernel`` over each group of equal ``key``: one shuffle and sort, groups streamed without a call each from the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, key):
            yield from kernel(table)

    dealt = df.repartition(partitions, key) if partitions else df.repartition(key)
    return dealt.sortWithinPartitions(key).mapInArrow(run, schema)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just the columns of these names, whatever else the table holds: names that differ in case or stand twice
    don't clash. A name is taken as written where it stands so, else without regard to case."""
    plain, at = shield(df)
    return plain.select(*[F.col(at[n]).alias(n) for n in names])


class _Names(dict):
    """Shielded names by column name."""

    def __missing__(self, name: str) -> str:
        for own, safe in self.items():
            if own.lower() == name.lower():
                return safe
        raise ValueError(f"no column {name!r} among {list(self)}")


def shield(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with names that clash with nothing, and the new name behind each old one (the first, if it stands twice).
    ``toDF(*df.columns)`` on a result with the same columns brings the old names back."""
    safe = [f"c{i}_" for i in range(len(df.columns))]
    at = _Names()
    for own, name in zip(df.columns, safe):
        at.setdefault(own, name)
    return df.toDF(*safe), at


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all values of a string column."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def crc_fold(df_column: str, modulus: int):
    """crc32 of the column's decimal text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(df_column).cast("string").cast("binary")), F.lit(modulus))
