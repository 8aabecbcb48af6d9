"""Shared parts of the two vector searches: cleaning, packing rows into binary blocks, dealing block pairs.

A search takes a stated query set against all rows in blocks: packed query blocks meet packed candidate
blocks under one key, so no row-by-row join exists and each task holds two bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PACKED = "key bigint, kind int, block int, ids binary, data binary"


def dimension(df: DataFrame, vector: str) -> int:
    """The commonest length of the vectors (ties to the smaller); 0 without any. Other lengths take no part."""
    row = df.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(row["d"]) if row else 0


def clean(df: DataFrame, id_col: str, vector: str, dim: int, nonzero: bool) -> DataFrame:
    """(id bigint, vec array<double>) of the rows whose vector has ``dim`` finite components."""
    vec = F.transform(F.col(vector), lambda x: x.cast("double"))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = df.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull() & (F.size(vector) == dim)).select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec")).filter(whole)
    return out.filter(F.exists("vec", lambda x: x != 0)) if nonzero else out


def matrix(column: pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dim)


def collect_sample(df: DataFrame, rows: int, total: int, dim: int, seed: int = 5) -> np.ndarray:
    """About ``rows`` vectors, chosen by a hash of the id: a bounded sample to fit rotations and centroids on."""
    share = min(1.0, rows / max(1, total))
    kept = df.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(rows + rows // 8)
    found = [r["vec"] for r in kept.select("vec").collect()]
    return np.array(found, dtype=np.float64).reshape(-1, dim)


def pack(ids: np.ndarray, data: np.ndarray, key: int, kind: int, block: int) -> dict:
    return {"key": int(key), "kind": kind, "block": int(block), "ids": np.ascontiguousarray(ids, np.int64).tobytes(), "data": np.ascontiguousarray(data).tobytes()}


def packed_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, schema=kinds)


def unpack(table: pa.Table, kind: int, dim: int, dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) of each packed block of one kind, blocks in rising order."""
    blocks = table.column("block").to_pylist()
    kinds = table.column("kind").to_pylist()
    for i in sorted((i for i, k in enumerate(kinds) if k == kind), key=lambda i: blocks[i]):
        yield np.frombuffer(table.column("ids")[i].as_py(), np.int64), np.frombuffer(table.column("data")[i].as_py(), dtype).reshape(-1, dim)


def best(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest scores, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]
