"""Searching an index that was built once: packed suffix arrays by text, kept as Parquet.

``pack`` makes one row for each text: its symbols, suffix array and a bitmap of its character pairs, as binary columns, in as
few bytes an entry as the text's largest symbol and length need. A search reads these rows and builds nothing. A text whose character pairs don't cover a pattern's is passed over without a
look at its suffix array. A few patterns go to every task; a table of any number of patterns is dealt to the texts in
parts of bounded size (``find_all``), so there is no number of patterns that fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.operators import kernels
from stringloom.operators.index import text_batches
from stringloom.operators.search import find_range, total
from stringloom.session import cut

PART_CHARS = 16 << 20  # characters of the patterns that a task holds at once
SHARE_BYTES = 64 << 20  # of the packed index that meets one part in one task
PACKED = "n bigint, symbols binary, sa binary, pairs binary"
MASK_BITS = 1 << 12


def _pairs(symbols: np.ndarray) -> np.ndarray:
    """Hashed pairs of neighbouring symbols, below MASK_BITS."""
    return ((symbols[:-1] * 0x9E3779B1 + symbols[1:] * 0x85EBCA6B) & 0xFFFFFFFF) >> 20


def symbol_width(symbols: np.ndarray) -> int:
    """Bytes that the largest symbol takes: 1, 2 or 4."""
    top = int(symbols.max(initial=0))
    return 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4


def packed_symbols(symbols: np.ndarray, width: int) -> bytes:
    """Symbols as big-endian bytes of a width, as ``raw_symbols``."""
    return symbols.astype(f">u{width}").tobytes()


def places_of(sa: bytes, n: int) -> np.ndarray:
    """The suffix array of a packed text of n suffixes."""
    return np.frombuffer(sa, f"<u{len(sa) // n}")


def pack(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, n, symbols, sa, pairs): what a search needs of each text, without a shuffle. Null texts have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, held in text_batches(batch):
                order = kernels.suffix_order(held, with_lcp=False)
                made: list[tuple] = []
                for a, b in zip(order.bounds[:-1], order.bounds[1:]):
                    symbols, mask = order.symbols[a:b], np.zeros(MASK_BITS, bool)
                    mask[_pairs(symbols)] = True
                    made.append((int(b - a), packed_symbols(symbols, symbol_width(symbols)), order.sa[a:b].astype("<u2" if b - a <= 1 << 16 else "<u4").tobytes(), np.packbits(mask).tobytes()))
                n, *packed = zip(*made)
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], names=[id_col, "n", "symbols", "sa", "pairs"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {PACKED}")


def save(texts: DataFrame, path: str, id_col: str = "text_id", text_col: str = "text", mode: str = "overwrite") -> None:
    """Build the packed index of all texts and keep it at ``path``."""
    pack(texts, id_col, text_col).write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The packed index at ``path``."""
    return spark.read.parquet(path)


class Patterns:
    """Patterns ready to be looked for in packed texts."""

    def __init__(self, patterns: list[str]):
        coded = [kernels.codes(p) + 1 for p in patterns]
        self.names = patterns
        # By width: the bytes of each pattern, None where a symbol needs more.
        self.raw = {w: [packed_symbols(c, w) if symbol_width(c) <= w else None for c in coded] for w in (1, 2, 4)}
        used = np.zeros((len(patterns), MASK_BITS), bool)
        for row, c in zip(used, coded):
            row[_pairs(c)] = True
        self.used = np.packbits(used, axis=1).view(np.uint64)

    def hits(self, n: int, symbols: bytes, sa: bytes, pairs: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(place of the pattern, sp, ep, suffix array) for every pattern that the text holds."""
        lacks, places, width = ~np.frombuffer(pairs, np.uint64), places_of(sa, n), len(symbols) // n
        raw = self.raw[width]
        for i in np.flatnonzero(~(self.used & lacks).any(axis=1)).tolist():
            if raw[i] is not None:
                sp, ep = find_range(symbols, places, raw[i], width)
                if sp <= ep:
                    yield i, sp, ep, places


def _rows(batch: pa.RecordBatch, *columns: int) -> Iterator[tuple]:
    """The values of some columns, row by row."""
    for r in range(batch.num_rows):
        yield tuple(batch.column(c)[r].as_py() for c in columns)


def summary(index: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, found, matches, chars) as ``search.summary`` of ``find``; only the sums of a batch leave its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, said = Patterns(patterns), pa.array(patterns, pa.string())
        found, matches, seen = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64), False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            for row in _rows(batch, 0, 1, 2, 3):
                for i, low, high, _ in own.hits(*row):
                    found[i] += 1
                    matches[i] += high - low + 1
        if seen:
            yield pa.record_batch([said, pa.array(found), pa.array(matches)], names=["pattern", "found", "matches"])

    return total(index.select("n", "symbols", "sa", "pairs").mapInArrow(run, "pattern string, found bigint, matches bigint"))


def find(index: DataFrame, patterns: list[str], id_col: str = "text_id") -> DataFrame:
    """(id, pattern, sp, ep, cnt) for every text of a packed index and every pattern; an empty range is (1, 0)."""
    names = [id_col, "pattern", "sp", "ep", "cnt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, said = Patterns(patterns), pa.array(patterns, pa.string())
        for batch in batches:
            n, m = batch.num_rows, len(patterns)
            sp, ep = np.ones((n, m), np.int64), np.zeros((n, m), np.int64)
            for r in range(n):
                for i, low, high, _ in own.hits(*(batch.column(c)[r].as_py() for c in (1, 2, 3, 4))):
                    sp[r, i], ep[r, i] = low, high
            sp, ep = sp.ravel(), ep.ravel()
            yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(np.arange(n), m))), said.take(pa.array(np.tile(np.arange(m), n))), pa.array(sp), pa.array(ep), pa.array(ep - sp + 1)], names=names)

    kind = index.schema[id_col].dataType.simpleString()
    return index.select(id_col, "n", "symbols", "sa", "pairs").mapInArrow(run, f"`{id_col}` {kind}, pattern string, sp bigint, ep bigint, cnt bigint")


def locate(index: DataFrame, patterns: list[str], id_col: str = "text_id") -> DataFrame:
    """(id, pattern, rank, pos): every occurrence in the texts of a packed index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Patterns(patterns)
        for batch in batches:
            for r in range(batch.num_rows):
                for i, sp, ep, places in own.hits(*(batch.column(c)[r].as_py() for c in (1, 2, 3, 4))):
                    n = ep - sp + 1
                    yield pa.record_batch([batch.column(0).take(pa.array(np.full(n, r))), pa.array([patterns[i]] * n, pa.string()), pa.array(np.arange(sp, ep + 1)), pa.array(places[sp : ep + 1].astype(np.int64))], names=[id_col, "pattern", "rank", "pos"])

    kind = index.schema[id_col].dataType.simpleString()
    return index.select(id_col, "n", "symbols", "sa", "pairs").mapInArrow(run, f"`{id_col}` {kind}, pattern string, rank bigint, pos bigint")


def find_all(index: DataFrame, patterns: DataFrame, column: str = "pattern", id_col: str = "text_id", part_chars: int = PART_CHARS, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """(id, pattern, sp, ep, cnt) with cnt > 0, for a table of patterns of any size; nulls and repeats don't count.

    Patterns are dealt into parts of about ``part_chars`` characters and the index into shares of about
    ``share_bytes``; every part meets every share, as a search of all patterns in all texts must. A task holds one part and
    streams the share's texts past it.
    """
    distinct = cut(patterns.select(F.col(column).alias("asked")).filter(F.col(column).isNotNull()).distinct())
    parts = max(1, -(-int(distinct.agg(F.coalesce(F.sum(F.char_length("asked") + 1), F.lit(0))).first()[0]) // part_chars))
    shares = max(1, -(-int(index.agg(F.coalesce(F.sum(8 * F.col("n")), F.lit(0))).first()[0]) // share_bytes))
    key = F.xxhash64("part", "share")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = distinct.withColumn("part", F.pmod(F.xxhash64("asked"), F.lit(parts)).cast("int")).withColumn("share", each(shares))
    held = index.withColumn("share", F.pmod(F.xxhash64(id_col), F.lit(shares)).cast("int")).withColumn("part", each(parts))
    columns = [id_col, "n", "symbols", "sa", "pairs"]
    none = [F.lit(None).cast(index.schema[c].dataType).alias(c) for c in columns]
    both = asked.select(key.alias("key"), "part", "share", F.lit(0).alias("kind"), "asked", *none).unionByName(held.select(key.alias("key"), "part", "share", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("asked"), *columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, said, own = None, [], None
        for batch in batches:
            part, share, kind = (batch.column(c).to_numpy() for c in (1, 2, 3))
            rows = []
            for r in range(batch.num_rows):
                if at != (part[r], share[r]):
                    at, said, own = (part[r], share[r]), [], None
                if kind[r] == 0:
                    said.append(batch.column(4)[r].as_py())
                else:
                    own = own or Patterns(said)
                    rows += [(r, said[i], sp, ep) for i, sp, ep, _ in own.hits(*(batch.column(c)[r].as_py() for c in (6, 7, 8, 9)))]
            at_row, names, sp, ep = (list(x) for x in zip(*rows)) if rows else ([],) * 4
            low, high = np.array(sp, np.int64), np.array(ep, np.int64)
            yield pa.record_batch([batch.column(5).take(pa.array(at_row, pa.int64())), pa.array(names, pa.string()), pa.array(low), pa.array(high), pa.array(high - low + 1)], names=[id_col, "pattern", "sp", "ep", "cnt"])

    kind = index.schema[id_col].dataType.simpleString()
    return both.repartition("key").sortWithinPartitions("key", "part", "share", "kind").mapInArrow(run, f"`{id_col}` {kind}, pattern string, sp bigint, ep bigint, cnt bigint")


def order_faults(index: DataFrame, found: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, pattern, cnt, faults) of ranges (id, pattern, sp, ep, cnt): how many of these tests a range fails. The first and the
    last suffix start with the pattern, the one before is smaller, the one after greater, and an empty range means that the
    text does not hold the pattern. No range of a right search has faults."""
    joined = found.select(id_col, "pattern", "sp", "ep", "cnt").join(index.select(id_col, "n", "symbols", "sa"), id_col)
    kind = index.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faults = [_range_faults(n, raw, places_of(sa, n), kernels.codes(pattern) + 1, sp, ep) for pattern, sp, ep, n, raw, sa in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 5, 6, 7)))]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(4), pa.array(faults, pa.int64())], names=[id_col, "pattern", "cnt", "faults"])

    return joined.mapInArrow(run, f"`{id_col}` {kind}, pattern string, cnt bigint, faults bigint")


def find_faults(index: DataFrame, patterns: list[str], id_col: str = "text_id") -> DataFrame:
    """As ``order_faults`` of ``find``: each range is tested in the task that has found it, and no packed text is sent anywhere."""
    names = [id_col, "pattern", "cnt", "faults"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, said, coded = Patterns(patterns), pa.array(patterns, pa.string()), [kernels.codes(p) + 1 for p in patterns]
        for batch in batches:
            rows, m = batch.num_rows, len(patterns)
            counts, faults = np.zeros((rows, m), np.int64), np.zeros((rows, m), np.int64)
            for r, row in enumerate(_rows(batch, 1, 2, 3, 4)):
                n, symbols, sa, _ = row
                ranges = {i: (low, high) for i, low, high, _ in own.hits(*row)}
                places = places_of(sa, n)
                for i, p in enumerate(coded):
                    low, high = ranges.get(i, (1, 0))
                    counts[r, i], faults[r, i] = high - low + 1, _range_faults(n, symbols, places, p, low, high)
            yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(np.arange(rows), m))), said.take(pa.array(np.tile(np.arange(m), rows))), pa.array(counts.ravel()), pa.array(faults.ravel())], names=names)

    kind = index.schema[id_col].dataType.simpleString()
    return index.select(id_col, "n", "symbols", "sa", "pairs").mapInArrow(run, f"`{id_col}` {kind}, pattern string, cnt bigint, faults bigint")


def _range_faults(n: int, raw: bytes, places: np.ndarray, pattern: np.ndarray, sp: int, ep: int) -> int:
    """How many of the tests of ``order_faults`` a range fails."""
    width = len(raw) // n
    if symbol_width(pattern) > width:  # no text of this width holds it
        return int(sp <= ep)
    p = packed_symbols(pattern, width)
    start = lambda r: raw[width * int(places[r]) : width * int(places[r]) + len(p)]
    if sp > ep:
        at = raw.find(p)
        while at >= 0 and at % width:  # between two symbols
            at = raw.find(p, at + 1)
        return int(at >= 0)
    return [start(sp) == p, start(ep) == p, sp == 0 or start(sp - 1) < p, ep + 1 >= n or start(ep + 1) > p].count(False)


def forward_step(here: DataFrame, nodes: DataFrame, texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, pattern, sp, ep, matched): one step down the suffix tree from (id, pattern, sp, ep, matched); no row where it does
    not go on. The child is found by its edge's first character, the rest of the edge is compared with the text."""
    kids = nodes.filter(F.col("child_no").isNotNull()).select(F.col(id_col).alias("_id"), "parent_sp", "parent_ep", "edge_ch", F.col("sp").alias("_sp"), F.col("ep").alias("_ep"), F.col("depth").alias("_depth"), F.col("pos").alias("_pos"))
    own = texts.select(F.col(id_col).alias("_text_id"), F.col(text_col).alias("_text"))
    asked = here.withColumn("_next", F.substr("pattern", (F.col("matched") + 1).cast("int"), F.lit(1)))
    joined = asked.join(kids, (F.col(id_col) == F.col("_id")) & (F.col("sp") == F.col("parent_sp")) & (F.col("ep") == F.col("parent_ep")) & (F.col("_next") == F.col("edge_ch")))
    length = F.least(F.col("_depth"), F.char_length("pattern")).cast("int")
    same = F.substr("_text", F.col("_pos").cast("int") + 1, length) == F.substr("pattern", F.lit(1), length)
    return joined.join(own, F.col("_id") == F.col("_text_id")).filter(same).select(id_col, "pattern", F.col("_sp").alias("sp"), F.col("_ep").alias("ep"), length.cast("bigint").alias("matched"))


def forward_find(nodes: DataFrame, texts: DataFrame, patterns: list[str], id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, pattern, sp, ep) of patterns found from the root of the suffix tree downwards, an edge at a time; no row for a
    pattern that does not occur. A round of equi-joins takes all texts and patterns one edge on."""
    names = F.explode(F.array(*[F.lit(p) for p in patterns])).alias("pattern")
    here = nodes.filter(F.col("child_no").isNull()).select(id_col, names, "sp", "ep", F.lit(0).cast("bigint").alias("matched"))
    out = None
    for _ in range(max(map(len, patterns), default=0) + 1):
        done = here.filter(F.col("matched") >= F.char_length("pattern")).select(id_col, "pattern", "sp", "ep")
        out = done if out is None else out.unionByName(done)
        here = cut(forward_step(here.filter(F.col("matched") < F.char_length("pattern")), nodes, texts, id_col, text_col))
        if here.isEmpty():
            break
    return out
