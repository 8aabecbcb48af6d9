"""Pattern search: ranges of suffix ranks, counts, places, ordered digests and checks.

Counting needs no index: one look-ahead regular expression pass counts overlapping hits of a pattern. Ranges and
places in suffix order come from a binary search per pattern over each text's suffix array, in the task that
built it. Patterns are a small table whose size is checked before it is sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.operators import kernels
from stringloom.operators.index import answers, text_batches

MOST_PATTERN_CHARS = 64 << 20  # of all patterns together, sent to every task


def overlap_count(text: str | Column, pattern: Column) -> Column:
    """Overlapping occurrences of a literal pattern; an empty one occurs at every position, the end included."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    text = F.col(text) if isinstance(text, str) else text
    return F.when(pattern == "", F.char_length(text) + 1).otherwise(F.size(F.regexp_extract_all(text, quoted, F.lit(0)))).cast("bigint")


def count_scan(texts: DataFrame, patterns: list[str], id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, pattern, cnt) in one pass over the texts, without an index or a shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), overlap_count(text_col, F.lit(p)).alias("cnt")) for p in patterns]))
    return texts.filter(F.col(text_col).isNotNull()).select(id_col, each.alias("_hit")).select(id_col, "_hit.pattern", "_hit.cnt")


def collect_patterns(patterns: DataFrame, column: str = "pattern") -> list[str]:
    """The distinct patterns, if they are small enough to send to every task."""
    size = patterns.agg(F.coalesce(F.sum(F.char_length(column)), F.lit(0))).first()[0]
    if size > MOST_PATTERN_CHARS:
        raise ValueError(f"{size} characters of patterns are too many for every task; saved.find_all takes any number")
    return sorted(r[0] for r in patterns.select(column).filter(F.col(column).isNotNull()).distinct().collect())


def raw_symbols(symbols: np.ndarray) -> bytes:
    """Symbols as big-endian bytes, whose order is theirs: slices compare without unpacking."""
    return symbols.astype(">u4").tobytes()


def find_range(raw: bytes, sa: Sequence[int], pattern: bytes, width: int = 4) -> tuple[int, int]:
    """Ranks whose suffixes start with the pattern, both included; (1, 0) without any. A symbol takes ``width`` bytes."""
    m = len(pattern)

    def side(after: bool) -> int:
        low, high = 0, len(sa)
        while low < high:
            mid = (low + high) // 2
            at = width * int(sa[mid])
            own = raw[at : at + m]
            if own < pattern or (after and own == pattern):
                low = mid + 1
            else:
                high = mid
        return low

    first, last = side(False), side(True) - 1
    return (first, last) if first <= last else (1, 0)


def _search(texts: DataFrame, patterns: list[str], places: bool, id_col: str, text_col: str) -> DataFrame:
    coded = [(p, raw_symbols(kernels.codes(p) + 1), frozenset((kernels.codes(p) + 1).tolist())) for p in patterns]
    names = [id_col, "pattern", "rank", "pos"] if places else [id_col, "pattern", "sp", "ep", "cnt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, held in text_batches(batch):
                order = kernels.suffix_order(held, with_lcp=False)
                at, said, numbers = [], [], []
                for row, a, b in zip(rows, order.bounds[:-1], order.bounds[1:]):
                    sa, raw = order.sa[a:b].tolist(), raw_symbols(order.symbols[a:b])
                    known = set(np.unique(order.symbols[a:b]).tolist())
                    for name, p, used in coded:
                        sp, ep = find_range(raw, sa, p) if used <= known else (1, 0)
                        if places:
                            at += [row] * (ep - sp + 1)
                            said += [name] * (ep - sp + 1)
                            numbers += [(r, sa[r]) for r in range(sp, ep + 1)]
                        else:
                            at.append(row)
                            said.append(name)
                            numbers.append((sp, ep, ep - sp + 1))
                columns = np.array(numbers, np.int64).reshape(-1, 2 if places else 3)
                yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(said, pa.string()), *(pa.array(columns[:, i]) for i in range(columns.shape[1]))], names=names)

    kind = texts.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, pattern string, " + ("rank bigint, pos bigint" if places else "sp bigint, ep bigint, cnt bigint")
    return texts.select(id_col, text_col).mapInArrow(run, schema)


def find(texts: DataFrame, patterns: list[str], id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, pattern, sp, ep, cnt) for every text and pattern. The empty pattern has the whole range."""
    return _search(texts, patterns, False, id_col, text_col)


def locate(texts: DataFrame, patterns: list[str], id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, pattern, rank, pos): every occurrence; in rank order within a pattern."""
    return _search(texts, patterns, True, id_col, text_col)


def summary(ranges: DataFrame) -> DataFrame:
    """(pattern, found, matches, chars) over all texts: texts with a hit, hits, characters of the pattern."""
    return ranges.groupBy("pattern").agg(F.count_if(F.col("cnt") > 0).alias("found"), F.sum("cnt").alias("matches"), F.max(F.char_length("pattern")).cast("bigint").alias("chars"))


def checked_of(texts: DataFrame, patterns: list[str], id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``checked`` of all places of the patterns: each task looks at the texts whose places it has found, and only the sums
    of a chunk leave it."""

    def make(order: kernels.SuffixOrder) -> tuple:
        hits, faults = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        for a, b in zip(order.bounds[:-1], order.bounds[1:]):
            symbols, sa, raw = order.symbols[a:b], order.sa[a:b], raw_symbols(order.symbols[a:b])
            for i, p in enumerate(coded):
                sp, ep = find_range(raw, sa, raws[i])
                places = sa[sp : ep + 1]
                right = places + len(p) < len(symbols)
                for k in range(len(p)):
                    right &= symbols[np.minimum(places + k, len(symbols) - 1)] == p[k]
                hits[i] += len(places)
                faults[i] += int(np.count_nonzero(~right))
        return np.zeros(len(patterns), np.int64), pa.array(patterns, pa.string()), hits, faults

    coded = [kernels.codes(p) + 1 for p in patterns]
    raws = [raw_symbols(p) for p in coded]
    summed = answers(texts, "pattern string, hits bigint, faults bigint", make, id_col=id_col, text_col=text_col)
    return summed.groupBy("pattern").agg(F.sum("hits").alias("hits"), F.sum("faults").alias("faults")).filter("hits > 0")


def summary_of(texts: DataFrame, patterns: list[str], id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``summary`` of ``find``; only the sums of a chunk leave its task."""

    def make(order: kernels.SuffixOrder) -> tuple:
        found, matches = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        for a, b in zip(order.bounds[:-1], order.bounds[1:]):
            sa, raw, known = order.sa[a:b], raw_symbols(order.symbols[a:b]), set(np.unique(order.symbols[a:b]).tolist())
            for i, (p, used) in enumerate(coded):
                if used <= known:
                    sp, ep = find_range(raw, sa, p)
                    found[i] += sp <= ep
                    matches[i] += ep - sp + 1
        return np.zeros(len(patterns), np.int64), pa.array(patterns, pa.string()), found, matches

    coded = [(raw_symbols(c), frozenset(c.tolist())) for c in (kernels.codes(p) + 1 for p in patterns)]
    return total(answers(texts, "pattern string, found bigint, matches bigint", make, id_col=id_col, text_col=text_col))


def total(parts: DataFrame) -> DataFrame:
    """(pattern, found, matches, chars) of partial sums (pattern, found, matches)."""
    return parts.groupBy("pattern").agg(F.sum("found").alias("found"), F.sum("matches").alias("matches"), F.max(F.char_length("pattern")).cast("bigint").alias("chars"))


def place_digest(places: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, digest): FNV-1a over the positions found, by pattern and then rank; the digest as decimal text."""
    rows = F.array_sort(F.collect_list(F.struct("pattern", "rank", "pos")))
    held = places.groupBy(id_col).agg(F.transform(rows, lambda r: r["pos"]).alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([str(kernels.fnv1a(x)) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "digest"])

    return held.mapInArrow(run, f"`{id_col}` {places.schema[id_col].dataType.simpleString()}, digest string")


def violations(texts: DataFrame, places: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """Occurrences at which the text does not hold the pattern; none if the search is right."""
    held = F.substr(F.col(text_col), F.col("pos").cast("int") + 1, F.char_length("pattern"))
    return places.join(texts.select(id_col, text_col), id_col).filter(held != F.col("pattern")).select(id_col, "pattern", "rank", "pos")


def checked(texts: DataFrame, places: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(pattern, hits, faults): occurrences found, and those at which the text does not hold the pattern."""
    held = F.substr(F.col(text_col), F.col("pos").cast("int") + 1, F.char_length("pattern"))
    return places.join(texts.select(id_col, text_col), id_col).groupBy("pattern").agg(F.count("*").alias("hits"), F.count_if(held != F.col("pattern")).alias("faults"))
