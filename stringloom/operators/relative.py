"""Integer columns stored as copies from another column, and reports on what such storage takes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringloom.operators import kernels
from stringloom.operators.align import pair_chunks
from stringloom.operators.ranges import differences

MOST_PHRASE = 1024
MEGA, GIGA = 1 << 20, 1 << 30


def _ordered(table: pa.Table) -> np.ndarray:
    ranks, values = table.column("rank").to_numpy(), table.column("value").to_numpy()
    return values[np.argsort(ranks)].astype(np.int64)


def copy_phrases(target: DataFrame, source: DataFrame, key: str = "pair_id", most: int = MOST_PHRASE) -> DataFrame:
    """(key, phrase_id, start, len, src, literal, low): greedy phrases over the differences of ``target``.

    Both are (key, rank, value). A phrase copies differences from place ``src`` of the source's (null
    for none) and ends with one literal difference (null where the column ends before it); ``low`` is the
    least value under the phrase.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, other = _ordered(left), _ordered(right)
        d, s = np.diff(own, prepend=0), np.diff(other, prepend=0)
        rows = kernels.copy_parse(d, s, most)
        start, copied, src = np.array([r[:3] for r in rows], np.int64).reshape(-1, 3).T
        literals = [r[3] for r in rows]
        length = copied + np.array([x is not None for x in literals], np.int64)
        low = np.minimum.reduceat(own, start) if rows else start
        keys = (left if left.num_rows else right).column(key).combine_chunks().take(pa.array([0] * len(rows), pa.int64()))
        return pa.table([keys, pa.array(np.arange(len(rows))), pa.array(start), pa.array(length), pa.array(src, mask=src < 0), pa.array(literals, pa.int64()), pa.array(low)], names=[key, "phrase_id", "start", "len", "src", "literal", "low"])

    kind = target.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, phrase_id bigint, start bigint, len bigint, src bigint, literal bigint, low bigint"
    return target.select(key, "rank", "value").groupBy(key).cogroup(source.select(key, "rank", "value").groupBy(key)).applyInArrow(run, schema)


def _prefix_columns(texts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Common prefixes of the suffixes of each text, and their differences."""
    order = kernels.suffix_order(texts)
    values = [order.lcp[a:b] for a, b in zip(order.bounds[:-1], order.bounds[1:])]
    return values, [np.diff(v, prepend=0) for v in values]


def phrases_of(pairs: DataFrame, most: int = MOST_PHRASE) -> DataFrame:
    """As ``copy_phrases`` of seq's common prefixes from ref's, for pairs (pair_id, ref, seq); no column leaves its task."""
    kind = pairs.schema["pair_id"].dataType.simpleString()
    names = ["pair_id", "phrase_id", "start", "len", "src", "literal", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, refs, seqs in pair_chunks(batch, 1, 2):
                values, steps = _prefix_columns(seqs)
                of, start, copied, src, literal = kernels.copy_parses(steps, _prefix_columns(refs)[1], most)
                sizes = np.array([len(v) for v in values], np.int64)
                first, column = np.cumsum(sizes) - sizes, np.concatenate(values)
                low = np.minimum.reduceat(column, first[of] + start)
                said = pa.array(np.concatenate(steps)[first[of] + np.maximum(literal, 0)], mask=literal < 0)
                number = np.arange(len(of)) - np.searchsorted(of, of)
                yield pa.record_batch([batch.column(0).take(pa.array(np.array(rows, np.int64)[of])), pa.array(number), pa.array(start), pa.array(copied + (literal >= 0)), pa.array(src, mask=src < 0), said, pa.array(low)], names=names)

    return pairs.select("pair_id", "ref", "seq").mapInArrow(run, f"pair_id {kind}, phrase_id bigint, start bigint, len bigint, src bigint, literal bigint, low bigint")


def phrase_faults(pairs: DataFrame, most: int = MOST_PHRASE) -> DataFrame:
    """(pair_id, places, faults): places of seq's common prefixes, and those that its phrases don't give back from ref's."""
    kind = pairs.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, refs, seqs in pair_chunks(batch, 1, 2):
                values, steps = _prefix_columns(seqs)
                sources = _prefix_columns(refs)[1]
                of, start, copied, src, literal = kernels.copy_parses(steps, sources, most)
                cuts = np.searchsorted(of, np.arange(len(rows) + 1))
                places, faults = [], []
                for k, (own, step, source) in enumerate(zip(values, steps, sources)):
                    part = slice(cuts[k], cuts[k + 1])
                    decoded = _decoded(copied[part], src[part], [int(step[x]) if x >= 0 else None for x in literal[part].tolist()], source)
                    shared = min(len(own), len(decoded))
                    places.append(max(len(own), len(decoded)))
                    faults.append(places[-1] - shared + int(np.count_nonzero(own[:shared] != decoded[:shared])))
                yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int64()), pa.array(faults, pa.int64())], names=["pair_id", "places", "faults"])

    return pairs.select("pair_id", "ref", "seq").mapInArrow(run, f"pair_id {kind}, places bigint, faults bigint")


def _decoded(copied: np.ndarray, src: np.ndarray, literals: list[int | None], source: np.ndarray) -> np.ndarray:
    """The column back from its phrases in order: differences from the source and literals, summed up."""
    ended = np.array([x is not None for x in literals], bool)
    sizes = copied + ended
    ends = np.cumsum(sizes)
    steps = np.zeros(int(sizes.sum()), np.int64)
    within = np.arange(int(copied.sum())) - np.repeat(np.cumsum(copied) - copied, copied)
    steps[np.repeat(ends - sizes, copied) + within] = source[np.repeat(src, copied) + within]
    steps[ends[ended] - 1] = [x for x in literals if x is not None]
    return np.cumsum(steps)


def decode_phrases(phrases: DataFrame, source: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, rank, value) back from phrases: copies by an equi-join on the source place, then a running sum."""
    steps = phrases.select(key, "start", "len", "src", "literal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1)).alias("i"))
    is_literal = (F.col("i") == F.col("len") - 1) & F.col("literal").isNotNull()
    coded = differences(source, key, "rank", "value")
    plain = F.when(F.col("code") % 2 == 1, -F.floor((F.col("code") + 1) / 2)).otherwise(F.floor(F.col("code") / 2))
    copies = coded.select(F.col(key).alias("_key"), F.col("rank").alias("_place"), plain.alias("_d"))
    joined = steps.join(copies, (F.col(key) == F.col("_key")) & (F.col("src") + F.col("i") == F.col("_place")), "left")
    found = joined.select(key, (F.col("start") + F.col("i")).alias("rank"), F.when(is_literal, F.col("literal")).otherwise(F.col("_d")).alias("d"))
    own = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return found.select(key, "rank", F.sum("d").over(own).cast("bigint").alias("value"))


def phrase_statistics(phrases: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, phrases, values, average_length)."""
    return phrases.groupBy(key).agg(F.count("*").alias("phrases"), F.sum("len").alias("values"), F.avg("len").alias("average_length"))


def phrase_of(phrases: DataFrame, probes: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, rank, phrase_id) of asked (key, rank): an interval join as an equi-join on the exploded places."""
    places = phrases.select(key, "phrase_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("rank"))
    return probes.select(key, "rank").join(places, [key, "rank"], "left")


def megabytes(size: Column) -> Column:
    return size / F.lit(float(MEGA))


def gigabytes(size: Column) -> Column:
    return size / F.lit(float(GIGA))


def bits_per_char(size: Column, chars: Column) -> Column:
    """Bits that each of ``chars`` characters takes; null for none."""
    return F.when(chars > 0, size * F.lit(8.0) / chars)


def microseconds(seconds: Column, operations: Column) -> Column:
    return F.when(operations > 0, seconds * F.lit(1e6) / operations)


def size_report(parts: DataFrame, key: str, part: str, size: str, chars: str) -> DataFrame:
    """(key, part, bytes, mb, bpc) for each part of a structure and, as part 'total', their sum."""
    each = parts.groupBy(key, part).agg(F.sum(size).alias("bytes"), F.max(chars).alias("chars"))
    total = each.groupBy(key).agg(F.sum("bytes").alias("bytes"), F.max("chars").alias("chars")).select(key, F.lit("total").alias(part), "bytes", "chars")
    return each.unionByName(total).select(key, part, "bytes", megabytes(F.col("bytes")).alias("mb"), bits_per_char(F.col("bytes"), F.col("chars")).alias("bpc"))


def size_tree(parts: DataFrame, path: str, size: str) -> DataFrame:
    """(node, level, bytes): sizes of nested parts summed up to every ancestor; ``path`` is an array of names from the root."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(F.col(path), 1, n))
    each = parts.filter(F.size(path) > 0).select(F.explode(prefixes).alias("_p"), F.col(size).alias("_s"))
    return each.groupBy("_p").agg(F.sum("_s").alias("bytes")).select(F.array_join("_p", "/").alias("node"), F.size("_p").alias("level"), "bytes")
