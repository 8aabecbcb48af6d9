"""Exact top-k inner products with norm order, rotated partial sums and Cauchy-Schwarz residual bounds.

Candidates are dealt by falling length into blocks. A task meets one block of queries with every n-th block
of candidates, longest first, and stops for a query once the product of lengths cannot reach its k-th score.
Within a block both sides are rotated by the singular vectors of a sample, so that the first coordinates
carry most of the product; the rest is bounded by the product of the residual lengths, and only pairs whose
bound reaches the k-th score get their exact integer product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm import vectors
from stringloom.llm.common import map_groups, pick

SCALE = 1024
BLOCK_ROWS = 1024
QUERY_ROWS = 2048
TASK_ROWS = 8192
SAMPLE_ROWS = 10_000


def _rotation(sample: np.ndarray, dim: int) -> np.ndarray:
    """Right singular vectors of the sample, from its Gram matrix."""
    if len(sample) < 2:
        return np.eye(dim)
    return np.linalg.svd(sample.T @ sample)[0]


def _search(queries: Iterator, candidates: Iterator, rotation: np.ndarray, head: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vector ids, scores) of the best pairs of each query block."""
    found = list(queries)
    if not found:
        return
    q_ids, q = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    if not len(q_ids):
        return
    q_real = q.astype(np.float64)
    q_turned, q_len = q_real @ rotation, np.sqrt((q_real**2).sum(1))
    q_rest = np.sqrt((q_turned[:, head:] ** 2).sum(1))
    q_most = int(np.abs(q).max(initial=0))
    held_ids = [np.zeros(0, np.int64)] * len(q)
    held = [np.zeros(0, np.int64)] * len(q)
    floor = np.full(len(q), -np.inf)
    for ids, rows in candidates:
        real = rows.astype(np.float64)
        length = np.sqrt((real**2).sum(1))
        open_ = np.flatnonzero(q_len * length.max(initial=0) * (1 + 1e-9) >= floor)
        if not len(open_):
            break  # later blocks are no longer
        turned = real @ rotation
        rest = np.sqrt((turned[:, head:] ** 2).sum(1))
        bound = q_turned[open_, :head] @ turned[:, :head].T + q_rest[open_, None] * rest[None, :]
        bound += 1e-9 * q_len[open_, None] * length[None, :] + 1e-6
        alive = bound >= floor[open_, None]
        exact = float(q_most) * float(np.abs(rows).max(initial=0)) * rows.shape[1] < 2**52
        if alive.mean() > 0.2 and exact:
            products = (q_real[open_] @ real.T).astype(np.int64)
            at, to = np.nonzero(alive)
            scores = products[at, to]
        else:
            at, to = np.nonzero(alive)
            scores = np.empty(len(at), np.int64)
            for i in range(0, len(at), 65536):
                part = slice(i, i + 65536)
                scores[part] = (q[open_[at[part]]] * rows[to[part]]).sum(1)
        other = q_ids[open_[at]] != ids[to]
        at, to, scores = at[other], to[other], scores[other]
        edges = np.searchsorted(at, np.arange(len(open_) + 1))
        for n, i in enumerate(open_):
            a, b = edges[n], edges[n + 1]
            if a == b:
                continue
            all_scores, all_ids = np.concatenate([held[i], scores[a:b]]), np.concatenate([held_ids[i], ids[to[a:b]]])
            kept = vectors.top_rows(all_scores, all_ids, k)
            held[i], held_ids[i] = all_scores[kept], all_ids[kept]
            if len(kept) == k:
                floor[i] = held[i][-1]
    counts = [len(x) for x in held]
    yield np.repeat(q_ids, counts), np.concatenate(held_ids), np.concatenate(held)


def top_inner_products(df: DataFrame, k: int = 10, query_step: int = 100, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer products of each row whose id ``query_step`` divides.

    Components become floor(1024 * x). Vectors that are null, hold a null or non-finite component, or differ in
    length from the commonest length take no part; a zero vector does (score 0). A query never meets rows of its
    own id. Ties go to the smaller id; fewer than k candidates give fewer rows; an empty table gives none.
    The rotation is fitted on at most about 11,250 rows; it changes speed, never a result.
    """
    spark = df.sparkSession
    result = "query_id bigint, vec_id bigint, score bigint"
    df = pick(df, id_col, vector)
    dim = vectors.dimension(df, vector)
    if not dim:
        return vectors.best(spark.createDataFrame([], result), k)
    rows = vectors.clean(df, id_col, vector, dim, nonzero=False)
    total = rows.count()
    rotation = _rotation(vectors.collect_sample(rows, SAMPLE_ROWS, total, dim), dim)
    head = max(1, dim // 4)
    blocks = max(1, math.ceil(total / BLOCK_ROWS))
    stripes = max(1, math.ceil(total / TASK_ROWS))
    whole = rows.select("id", F.transform("vec", lambda x: F.floor(x * SCALE).cast("bigint")).alias("vec"))
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    asks = whole.filter(F.pmod("id", F.lit(query_step)) == 0)
    query_blocks = max(1, math.ceil(asks.count() / QUERY_ROWS))

    def candidate_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if held:
            ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
            data = np.concatenate([vectors.matrix(b.column(1), dim, np.int64) for b in held])
            for n, i in enumerate(range(0, len(ids), 4 * BLOCK_ROWS)):
                part = slice(i, i + 4 * BLOCK_ROWS)
                yield vectors.packed_batch([vectors.pack(ids[part], data[part], b * stripes + (place + n) % stripes, 1, place) for b in range(query_blocks)])

    def query_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch.column(0).to_numpy(zero_copy_only=False), vectors.matrix(batch.column(1), dim, np.int64)
            of = batch.column(2).to_numpy(zero_copy_only=False)
            for b in np.unique(of):
                at = of == b
                yield vectors.packed_batch([vectors.pack(ids[at], data[at], b * stripes + s, 0, 0) for s in range(stripes)])

    by_length = whole.withColumn("_length", length).repartitionByRange(blocks, F.col("_length").desc(), "id").sortWithinPartitions(F.col("_length").desc(), "id")
    packed = by_length.select("id", "vec").mapInArrow(candidate_blocks, vectors.PACKED)
    asked = asks.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).mapInArrow(query_packs, vectors.PACKED)

    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for a, b, c in _search(vectors.unpack(table, 0, dim, np.int64), vectors.unpack(table, 1, dim, np.int64), rotation, head, k):
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(c)], names=["query_id", "vec_id", "score"])

    pairs = map_groups(asked.unionByName(packed), "key", search, result, partitions=max(2, query_blocks * stripes))
    return vectors.best(pairs, k)
