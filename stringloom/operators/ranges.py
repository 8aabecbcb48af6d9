"""Range minima and nearest smaller values over integer columns, in groups ordered by a rank column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringloom.operators import kernels
from stringloom.operators.index import answers

NEIGHBOURS = ("psv", "psev", "nsv", "nsev")
LARGE = 255  # values from here on count as large


def _grouped(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(group).to_pandas().to_numpy()
        edges = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            part = batch.slice(a, b - a)
            if held and held[0].column(group)[0].as_py() != part.column(group)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def smaller_values(rows: DataFrame, group: str = "text_id", rank: str = "rank", value: str = "lcp", columns: tuple[str, ...] = NEIGHBOURS) -> DataFrame:
    """``rows``' (group, rank, value) with the rank of the previous / next smaller (or equal) value, or null.

    One shuffle by group; a group is held by one task. Null values are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, group):
            ranks, values = (table.column(c).combine_chunks() for c in (rank, value))
            v, r, bounds = values.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False), np.array([0, len(values)])
            made = []
            for c in columns:
                at = (kernels.previous_smaller if c[0] == "p" else kernels.next_smaller)(v, bounds, c[2] == "e")
                made.append(pa.array(r[np.maximum(at, 0)], ranks.type, mask=at < 0))
            yield pa.record_batch([table.column(group).combine_chunks(), ranks, values, *made], names=[group, rank, value, *columns])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (group, rank, value)] + [f"{c} {kinds[rank]}" for c in columns])
    whole = rows.select(group, rank, value).filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    return whole.repartition(group).sortWithinPartitions(group, rank).mapInArrow(run, schema)


def range_minimum(rows: DataFrame, ranges: DataFrame, group: str = "text_id", rank: str = "rank", value: str = "lcp") -> DataFrame:
    """(group, sp, ep, pos, value) for ranges (group, sp, ep) of dense ranks from 0: the leftmost minimum, or nulls
    for an empty range or one that leaves the column."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left.column(rank).to_numpy()) if left.num_rows else np.zeros(0, int)
        values = left.column(value).to_numpy()[order] if left.num_rows else np.zeros(0, np.int64)
        sp, ep = right.column("sp").to_numpy(), right.column("ep").to_numpy()
        at = kernels.RangeMinimum(values).places(sp, ep)
        found = values[np.maximum(at, 0)] if len(values) else np.zeros(len(at), np.int64)
        return pa.table([right.column(group), right.column("sp"), right.column("ep"), pa.array(at, pa.int64(), mask=at < 0), pa.array(found, left.schema.field(value).type, mask=at < 0)], names=[group, "sp", "ep", "pos", value])

    schema = f"`{group}` {kinds[group]}, sp bigint, ep bigint, pos bigint, `{value}` {kinds[value]}"
    asked = ranges.select(group, F.col("sp").cast("bigint").alias("sp"), F.col("ep").cast("bigint").alias("ep"))
    return rows.select(group, rank, value).groupBy(group).cogroup(asked.groupBy(group)).applyInArrow(run, schema)


def block_minima(rows: DataFrame, branching: int = 64, levels: int = 3, group: str = "text_id", rank: str = "rank", value: str = "lcp") -> DataFrame:
    """(group, level, block, low): minima of blocks of branching ** level ranks, level by level."""
    each = F.explode(F.sequence(F.lit(1), F.lit(levels)))
    leveled = rows.select(group, rank, value, each.alias("level"))
    block = F.floor(F.col(rank) / F.pow(F.lit(float(branching)), "level")).cast("bigint")
    return leveled.groupBy(group, "level", block.alias("block")).agg(F.min(value).alias("low"))


def large_values(rows: DataFrame, group: str = "text_id", rank: str = "rank", value: str = "lcp", least: int = LARGE) -> DataFrame:
    """(group, rank, value, large_rank) of values from ``least`` on; large_rank counts the earlier ones."""
    own = Window.partitionBy(group).orderBy(rank)
    return rows.filter(F.col(value) >= least).select(group, rank, value, (F.row_number().over(own) - 1).cast("bigint").alias("large_rank"))


def differences(rows: DataFrame, group: str = "text_id", rank: str = "rank", value: str = "lcp") -> DataFrame:
    """(group, rank, code): each value's difference from the previous one (from 0 at first), zig-zag coded."""
    own = Window.partitionBy(group).orderBy(rank)
    d = F.col(value).cast("bigint") - F.coalesce(F.lag(value).over(own), F.lit(0)).cast("bigint")
    return rows.select(group, rank, d.alias("_d")).select(group, rank, F.when(F.col("_d") < 0, -2 * F.col("_d") - 1).otherwise(2 * F.col("_d")).alias("code"))


def from_differences(coded: DataFrame, group: str = "text_id", rank: str = "rank") -> DataFrame:
    """(group, rank, value) back from ``differences``."""
    own = Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    d = F.when(F.col("code") % 2 == 1, -F.floor((F.col("code") + 1) / 2)).otherwise(F.floor(F.col("code") / 2))
    return coded.select(group, rank, F.sum(d).over(own).alias("value"))


def bit_runs(rows: DataFrame, group: str, rank: str, bit: str) -> DataFrame:
    """(group, bit, runs, longest, bits, length_bits): runs of equal bits, and the bits that their lengths take."""
    own = Window.partitionBy(group).orderBy(rank)
    starts = rows.withColumn("_new", F.when(F.lag(bit).over(own).eqNullSafe(F.col(bit)), 0).otherwise(1))
    runs = starts.withColumn("_run", F.sum("_new").over(own)).groupBy(group, bit, "_run").agg(F.count("*").alias("_n"))
    return runs.groupBy(group, bit).agg(F.count("*").alias("runs"), F.max("_n").alias("longest"), F.sum("_n").alias("bits"), F.sum(F.length(F.bin("_n"))).cast("bigint").alias("length_bits"))


def run_measures(rows: DataFrame, group: str, rank: str, bit: str) -> DataFrame:
    """(group, runs, gap0, gap1, run): what different codes of a bit column take. ``runs`` counts runs of ones; ``gap0`` and
    ``gap1`` are the bits of the distances between zeros and between ones, ``run`` those of the lengths of the runs, each
    counted from the start of the column; zeros before the first one are part of the first run's distance."""
    own = Window.partitionBy(group).orderBy(rank)
    placed = rows.select(group, rank, F.col(bit).alias("_bit"), F.row_number().over(own).alias("_at"), F.coalesce(F.lag(bit).over(own), F.lit(False)).alias("_before"))
    same = Window.partitionBy(group, "_bit").orderBy(rank)
    gaps = placed.withColumn("_gap", F.col("_at") - F.coalesce(F.lag("_at").over(same), F.lit(0)))
    bits = lambda x: F.length(F.bin(x))
    border = F.when(F.col("_bit") != F.col("_before"), F.col("_at"))
    last = F.last(border, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = gaps.withColumn("_border", border).withColumn("_length", F.when(border.isNotNull(), F.col("_at") - F.coalesce(last, F.lit(0))))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    return marked.groupBy(group).agg(
        F.count_if(F.col("_bit") & F.col("_border").isNotNull()).alias("runs"), total(F.when(~F.col("_bit"), bits(F.col("_gap")))).alias("gap0"),
        total(F.when(F.col("_bit"), bits(F.col("_gap")))).alias("gap1"), total(bits(F.col("_length"))).alias("run"),
    )


def coverage(intervals: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """(group, intervals, total, covered, islands) of half-open [low, high) intervals: length of their union."""
    real = intervals.filter(F.col(low) < F.col(high))
    before = Window.partitionBy(group).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    reach = real.withColumn("_reach", F.max(high).over(before))
    fresh = F.greatest(F.lit(0), F.col(high) - F.greatest(F.col(low), F.coalesce("_reach", low)))
    island = F.when(F.col("_reach").isNull() | (F.col("_reach") < F.col(low)), 1).otherwise(0)
    return reach.groupBy(group).agg(F.count("*").alias("intervals"), F.sum(F.col(high) - F.col(low)).alias("total"), F.sum(fresh).alias("covered"), F.sum(island).cast("bigint").alias("islands"))


def increasing_length(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, entries, length): the longest strictly increasing subsequence of a column in the given order.

    Sequential by nature: a group streams through one task, which holds the current tails only."""
    kind = rows.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tails, n, started = None, [], 0, False

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([key], group_type), pa.array([n], pa.int64()), pa.array([len(tails)], pa.int64())], names=[group, "entries", "length"])

        group_type = None
        for batch in batches:
            group_type = batch.schema.field(group).type
            keys, values = batch.column(group).to_pylist(), batch.column(value).to_pylist()
            for k, v in zip(keys, values):
                if not started or k != key:
                    if started:
                        yield done()
                    key, tails, n, started = k, [], 0, True
                kernels.increasing_length([v], tails)
                n += 1
        if started:
            yield done()

    whole = rows.filter(F.col(value).isNotNull()).select(group, *[c for c in order if c != group], *[c for c in (value,) if c not in (*order, group)])
    return whole.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, f"`{group}` {kind}, entries bigint, length bigint")


def value_slice(rows: DataFrame, low: int, high: int, group: str = "text_id", rank: str = "rank", value: str = "lcp") -> DataFrame:
    """(group, values): the values of ranks [low, high), in order; ranks past the end are left out."""
    inside = rows.filter((F.col(rank) >= low) & (F.col(rank) < high))
    held = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(value).alias("v"))))
    return inside.groupBy(group).agg(F.transform(held, lambda x: x["v"]).alias("values"))


# ---- the same columns of the common prefixes of texts: each task takes them from the suffix orders that it builds ----


def lcp_codes(texts: DataFrame, decoded: bool = False, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``differences`` of the common prefixes, (id, rank, code); ``decoded`` takes the codes back, (id, rank, value)."""

    def make(order: kernels.SuffixOrder) -> tuple:
        lengths = np.diff(order.bounds)
        of = np.repeat(np.arange(len(lengths)), lengths)
        step = np.diff(order.lcp, prepend=0)
        step[order.bounds[:-1]] = order.lcp[order.bounds[:-1]]
        codes = kernels.zigzag(step)
        if decoded:
            total = np.cumsum(kernels.unzigzag(codes))
            codes = total - np.concatenate([[0], total])[order.bounds[of]]
        return of, np.arange(len(of)) - order.bounds[of], codes

    return answers(texts, f"rank bigint, {'value' if decoded else 'code'} bigint", make, with_lcp=True, id_col=id_col, text_col=text_col)


def lcp_slice_of(texts: DataFrame, low: int, high: int, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``value_slice`` of the common prefixes; texts without a rank in the range have no row."""

    def make(order: kernels.SuffixOrder) -> tuple:
        own = [(t, order.lcp[a + low : min(b, a + high)]) for t, (a, b) in enumerate(zip(order.bounds[:-1], order.bounds[1:])) if low < min(b - a, high)]
        ends = np.cumsum([0, *(len(x) for _, x in own)])
        values = np.concatenate([x for _, x in own]) if own else np.zeros(0, np.int64)
        return np.array([t for t, _ in own], np.int64), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32)))

    return answers(texts, "values array<int>", make, with_lcp=True, id_col=id_col, text_col=text_col)
