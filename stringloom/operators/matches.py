"""Matching statistics and maximal matches of query texts in other texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringloom.operators import kernels
from stringloom.operators.align import pair_chunks

KEYS = ("query_id", "text_id")
PART_CHARS, SHARE_CHARS, SHARE_TEXTS = 1 << 15, 1 << 22, 256  # of queries that meet a text at once; of texts in a group, which bounds its rows
SUM_CHARS = 1 << 17  # of queries that meet a text at once where only sums are kept
SORTED_CHARS = 1 << 17  # of texts and all queries of a part, sorted at once
BORDER = 0x110000  # stands between queries; no text holds it


def _extendable(of: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions, in text order, whose match is none or goes on from the previous position's."""
    before = np.concatenate([[0], length[:-1]])
    before[1:][of[1:] != of[:-1]] = 0
    return (length == 0) | (length < before)


def matching_statistics(pairs: DataFrame, ranges: bool = True, maximal: bool = False) -> DataFrame:
    """(query_id, text_id, start, length, sp, ep) for pairs (query_id, query, text_id, text).

    For every position of the query the longest prefix from there that occurs in the text and the text's ranks
    that start with it; length 0 where the character does not occur (the whole range). Null texts give no rows. Without
    ``ranges`` sp and ep are left out; ``maximal`` leaves only what ``maximal_matches`` keeps.
    """
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in KEYS}
    names = [*KEYS, "start", "length", *(["sp", "ep"] if ranges else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, queries, texts in pair_chunks(batch, 2, 3):
                joint = kernels.joint_order(queries, texts)
                of, start, length, place = kernels.longest_matches(joint)
                if maximal:
                    kept = ~_extendable(of, length)
                    of, start, length, place = of[kept], start[kept], length[kept], place[kept]
                columns = [start, length]
                if ranges:
                    sizes = np.array([len(t) + 1 for t in texts], np.int64)
                    first, some = np.cumsum(sizes) - sizes, np.flatnonzero(length > 0)
                    sp, ep = np.zeros(len(of), np.int64), sizes[of] - 1
                    low, high = kernels.match_ranks(joint, place[some], length[some])
                    sp[some], ep[some] = low - first[of[some]], high - first[of[some]]
                    columns += [sp, ep]
                at = pa.array(np.array(rows, np.int64)[of])
                yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, columns)], names=names)

    schema = f"query_id {kinds['query_id']}, text_id {kinds['text_id']}, " + ", ".join(f"{c} bigint" for c in names[2:])
    return pairs.select(*KEYS, "query", "text").mapInArrow(run, schema)


def maximal_sums(pairs: DataFrame) -> DataFrame:
    """As ``match_summary`` of the pairs' maximal matches by query; only a pair's sums leave a task."""
    kind = pairs.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, queries, texts in pair_chunks(batch, 2, 3):
                of, _, length, _ = kernels.longest_matches(kernels.joint_order(queries, texts))
                kept = ~_extendable(of, length)
                n = np.bincount(of[kept], minlength=len(rows))
                total = np.bincount(of[kept], length[kept], len(rows)).astype(np.int64)
                some = np.flatnonzero(n)
                yield pa.record_batch([batch.column(0).take(pa.array(np.array(rows, np.int64)[some])), pa.array(n[some]), pa.array(total[some])], names=["query_id", "_n", "_total"])

    sums = pairs.select(*KEYS, "query", "text").mapInArrow(run, f"query_id {kind}, _n bigint, _total bigint")
    return sums.groupBy("query_id").agg(F.sum("_n").alias("matches"), (F.sum("_total") / F.sum("_n")).alias("average_length"))


def maximal_matches(statistics: DataFrame) -> DataFrame:
    """Matches that cannot be made longer on either side: a position's length exceeds the previous one's less one."""
    own = Window.partitionBy(*KEYS).orderBy("start")
    before = F.coalesce(F.lag("length").over(own), F.lit(0)) - 1
    return statistics.withColumn("_before", before).filter((F.col("length") > 0) & (F.col("length") > F.col("_before"))).drop("_before")


def _against(queries: list[np.ndarray], texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each text the longest match of every position of the queries, which stand one after the other, each with a border.

    A chunk of texts is sorted once with all queries. Among the queries' suffixes a text's own stand at known places, with
    known common prefixes to both neighbours; running minima from there give every query suffix its longest match in this text."""
    joined = np.concatenate([x for q in queries for x in (q, [BORDER])]).astype(np.int64)
    n, at = len(joined), 0
    while at < len(texts):
        held, size = [], 0
        while at < len(texts) and (not held or size + len(texts[at]) < max(SORTED_CHARS, 2 * n)):
            held.append(texts[at])
            size += len(texts[at]) + 1
            at += 1
        lengths = np.array([len(t) + 1 for t in held], np.int64)
        order = kernels.suffix_order([np.concatenate([x for t in held for x in (t + 1, [0])] + [joined + 1])])
        asked = (order.sa >= size) & (order.sa < size + n)
        left, right = kernels.nearest_minima(order.lcp, asked, False), kernels.nearest_minima(order.lcp, asked, True)
        own, place = left[asked], order.sa[asked] - size
        ahead = np.append(own[1:], 0)
        large = int(order.lcp.max()) + 1
        owner = np.repeat(np.arange(len(held)), lengths)
        rows = np.flatnonzero(order.sa < size)
        rows = rows[kernels.sorted_places(owner[order.sa[rows]])[0]]
        after, low, high = np.cumsum(asked)[rows], left[rows], right[rows]
        found = np.zeros(n, np.int64)
        for a, b in zip(np.cumsum(lengths) - lengths, np.cumsum(lengths)):
            found[place] = np.maximum(_spread(own, after[a:b], high[a:b], large), _spread(ahead[::-1], n - after[a:b][::-1], low[a:b][::-1], large)[::-1])
            yield found


def _spread(common: np.ndarray, at: np.ndarray, first: np.ndarray, large: int) -> np.ndarray:
    """For each place the least of ``common`` since the last place of ``at`` up to it, whose own value is ``first``; 0 before all."""
    inside = at < len(common)
    at, first = at[inside], first[inside]
    values, begun = common.copy(), np.zeros(len(common), np.int64)
    values[at] = first  # of several the last counts: it stands nearest
    begun[at] = large
    shift = np.cumsum(begun)
    values -= shift
    out = np.minimum.accumulate(values)
    out += shift
    out[: int(at[0]) if len(at) else len(out)] = 0
    return out


def _groups(texts: DataFrame, queries: DataFrame, part_chars: int, share_chars: int) -> tuple[DataFrame, DataFrame]:
    """Texts and queries, each with the parts and shares that they meet in."""
    texts, queries = texts.filter("text IS NOT NULL").select("text_id", "text"), queries.filter("query <> ''").select("query_id", "query")
    held, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    asked_chars = queries.agg(F.coalesce(F.sum(F.char_length("query")), F.lit(0))).first()[0]
    groups = [max(1, math.ceil(asked_chars / part_chars)), max(1, math.ceil(chars / share_chars), math.ceil(held / SHARE_TEXTS))]
    parts, shares = (F.sequence(F.lit(0), F.lit(n - 1)) for n in groups)
    left = texts.withColumn("share", F.pmod(F.xxhash64("text_id", "text"), F.lit(groups[1])).cast("int")).withColumn("part", F.explode(parts))
    right = queries.withColumn("part", F.pmod(F.xxhash64("query_id", "query"), F.lit(groups[0])).cast("int")).withColumn("share", F.explode(shares))
    return left, right


def against_all(texts: DataFrame, queries: DataFrame, part_chars: int = PART_CHARS, share_chars: int = SHARE_CHARS) -> DataFrame:
    """(query_id, text_id, start, length, chars): maximal matches of every query (query_id, query) in every text
    (text_id, text), and how long the query is.

    Queries are dealt to parts and texts to shares, both of bounded size by their total; each share meets each part in one
    group, where chunks of texts are sorted with all queries of the part. So a text is sent once for each part, and neither
    side goes to the driver or to every task. Null texts and null or empty queries give no rows; repeated rows count each.
    """
    left, right = _groups(texts, queries, part_chars, share_chars)
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "text_id": texts.schema["text_id"].dataType.simpleString()}
    names = [*KEYS, "start", "length", "chars"]

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        codes = [kernels.codes(q) for q in asked.column("query").to_pylist()]
        sizes = np.array([len(c) for c in codes], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        rows: list[tuple[np.ndarray, ...]] = []
        for i, length in enumerate(_against(codes, [kernels.codes(t) for t in own.column("text").to_pylist()]) if codes else []):
            at = np.flatnonzero((length > 0) & (length >= np.concatenate([[0], length[:-1]])))
            of = np.searchsorted(starts, at, "right") - 1
            rows.append((of, np.full(len(at), i), at - starts[of], length[at], sizes[of]))
        of, i, *rest = (np.concatenate(x) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
        return pa.table([asked.column("query_id").take(pa.array(of)), own.column("text_id").take(pa.array(i)), *map(pa.array, rest)], names=names)

    schema = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in names)
    return left.groupBy("part", "share").cogroup(right.groupBy("part", "share")).applyInArrow(run, schema)


def passage_sums(texts: DataFrame, queries: DataFrame, part_chars: int = SUM_CHARS, share_chars: int = SHARE_CHARS) -> DataFrame:
    """As ``passage_summary`` of ``against_all``; only the sums of a group leave its task, not its matches."""
    left, right = _groups(texts, queries, part_chars, share_chars)
    kind = queries.schema["query_id"].dataType.simpleString()
    names = ["query_id", "matches", "whole", "longest"]

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        codes = [kernels.codes(q) for q in asked.column("query").to_pylist()]
        sizes = np.array([len(c) for c in codes], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        hits, whole, longest = (np.zeros(len(codes), np.int64) for _ in range(3))
        marks = np.zeros(int((sizes + 1).sum()), np.int64)
        best = np.zeros(len(marks), np.int64)
        for length in _against(codes, [kernels.codes(t) for t in own.column("text").to_pylist()]) if codes else []:
            kept = length > 0
            kept[1:] &= length[1:] >= length[:-1]
            marks += kept
            np.maximum(best, length, out=best)
            whole += length[starts] == sizes
        if codes:
            hits, longest = np.add.reduceat(marks, starts), np.maximum.reduceat(best, starts)
        some = np.flatnonzero(hits)
        return pa.table([asked.column("query_id").take(pa.array(some)), *(pa.array(x[some]) for x in (hits, whole, longest))], names=names)

    schema = f"query_id {kind}, matches bigint, whole bigint, longest bigint"
    found = left.groupBy("part", "share").cogroup(right.groupBy("part", "share")).applyInArrow(run, schema)
    return found.groupBy("query_id").agg(F.sum("matches").alias("matches"), F.sum("whole").alias("whole"), F.max("longest").alias("longest"))


def passage_summary(matches: DataFrame) -> DataFrame:
    """(query_id, matches, whole, longest) of ``against_all``: all matches, those of the whole query, the longest length."""
    return matches.groupBy("query_id").agg(F.count("*").alias("matches"), F.count_if(F.col("length") == F.col("chars")).alias("whole"), F.max("length").alias("longest"))


def match_summary(matches: DataFrame, group: str = "query_id") -> DataFrame:
    """(group, matches, average_length)."""
    return matches.groupBy(group).agg(F.count("*").alias("matches"), F.avg("length").alias("average_length"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that two results don't share; none if they agree."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))
