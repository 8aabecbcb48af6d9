"""Approximate nearest neighbours by cosine: inverted lists scanned with adaptive dimension tests.

Vectors are scaled to length 1 and turned by one random rotation. Centroids are fitted on a bounded sample;
every row goes to the list of its nearest centroid, long lists are cut into pieces, and a query probes the
lists nearest to it: as many as the sample's own neighbours need for the recall asked for, and on until they hold k
rows of other ids. Inside a list the rotated coordinates are read in column blocks: after each block a
hypothesis test on the partial squared distance gives up the candidates that cannot, but for a small error,
come under the query's k-th distance so far. What is left gets its cosine from the original vectors.
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
from stringloom.session import cut

SAMPLE_ROWS = 20_000
MOST_LISTS = 4096
SAMPLE_RECALL = 0.975  # of the sample's own neighbours, which the probed lists must hold
SAMPLE_QUERIES = 256
PIECE_ROWS = 8192
QUERY_ROWS = 1024
BLOCK_DIMS = 16
TEST_ERROR = 2.1  # the test keeps a candidate within (1 + TEST_ERROR / sqrt(dimensions read)) of the k-th distance
PAIRS_AT_ONCE = 1 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means; an empty list takes a random row."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        counts = np.bincount(near, minlength=lists)
        for j in range(sample.shape[1]):
            centres[:, j] = np.bincount(near, weights=sample[:, j], minlength=lists)
        empty = counts == 0
        centres[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centres = centres / np.maximum(np.sqrt((centres**2).sum(axis=1, keepdims=True)), 1e-12)
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest nearest lists that hold ``recall`` of the sample's own k nearest neighbours."""
    asks = np.linspace(0, len(sample) - 1, min(len(sample), SAMPLE_QUERIES)).astype(int)
    sims = sample[asks] @ sample.T
    sims[np.arange(len(asks)), asks] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    true = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    near = (sample @ centres.T).argmax(axis=1)[true]
    ranks = np.argsort(np.argsort(-(sample[asks] @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(ranks, near, axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


def enough_lists(sims: np.ndarray, sizes: np.ndarray, least: np.ndarray, probes: int) -> list[np.ndarray]:
    """For each row of similarities its nearest lists: at least ``probes``, and as many as it takes to hold ``least`` rows."""
    near = np.argsort(-sims, axis=1, kind="stable")
    full = np.cumsum(sizes[near], axis=1) >= least[:, None]
    reached = np.where(full.any(axis=1), full.argmax(axis=1) + 1, sims.shape[1])
    return [row[: max(probes, int(n))] for row, n in zip(near, reached)]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same rows give the same bits whatever stands around them."""
    a_most, b_most = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    big = (a_most > 1e100) | (b_most > 1e100) | (a_most < 1e-100) | (b_most < 1e-100)
    a, b = np.where(big, a / a_most, a), np.where(big, b / b_most, b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def adaptive_scan(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query places, candidate places) that pass every test on the rotated unit vectors ``q`` and ``c``."""
    dim = q.shape[1]
    borders = list(range(0, dim, BLOCK_DIMS)) + [dim]
    head = np.linspace(0, len(c) - 1, min(len(c), 32)).astype(int)
    first = 2 - 2 * q @ c[head].T
    first[q_ids[:, None] == c_ids[head][None, :]] = np.inf
    floor = np.partition(first, min(k, len(head)) - 1, axis=1)[:, min(k, len(head)) - 1] if len(head) >= k else np.full(len(q), np.inf)
    out_q, out_c = [], []
    step = max(1, PAIRS_AT_ONCE // max(1, len(q)))
    for lo in range(0, len(c), step):
        part = c[lo : lo + step]
        b = borders[1]
        partial = (q[:, :b] ** 2).sum(1)[:, None] + (part[:, :b] ** 2).sum(1)[None, :] - 2 * q[:, :b] @ part[:, :b].T
        keep = partial * (dim / b) <= floor[:, None] * (1 + TEST_ERROR / math.sqrt(b)) ** 2 + 1e-9
        at, to = np.nonzero(keep)
        partial = partial[at, to]
        for a, b in zip(borders[1:-1], borders[2:]):
            partial = partial + ((q[at, a:b] - part[to, a:b]) ** 2).sum(axis=1)
            loose = 1 + TEST_ERROR / math.sqrt(b) if b < dim else 1.0
            keep = partial * (dim / b) <= floor[at] * loose**2 + 1e-9
            at, to, partial = at[keep], to[keep], partial[keep]
        other = q_ids[at] != c_ids[lo + to]
        at, to, partial = at[other], to[other], partial[other]
        out_q.append(at)
        out_c.append(lo + to)
        edges = np.searchsorted(at, np.arange(len(q) + 1))
        for i in np.flatnonzero(np.diff(edges) >= k):
            floor[i] = min(floor[i], np.partition(partial[edges[i] : edges[i + 1]], k - 1)[k - 1])
    return np.concatenate(out_q), np.concatenate(out_c)


def nearest(df: DataFrame, k: int = 5, query_step: int = 50, id_col: str = "vec_id", vector: str = "embedding", recall: float = SAMPLE_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row whose id ``query_step`` divides.

    Vectors that are null, zero, hold a null or non-finite component, or differ in length from the commonest
    length take no part. A query never meets rows of its own id; ties go to the smaller id; with fewer than k
    candidates all come back. The index is fitted on at most about 22,500 rows and holds every row.
    """
    spark = df.sparkSession
    result = "query_id bigint, vec_id bigint, score double"
    df = pick(df, id_col, vector)
    dim = vectors.dimension(df, vector)
    rows = vectors.clean(df, id_col, vector, dim, nonzero=True) if dim else None
    total = rows.count() if dim else 0
    if not total:
        return vectors.best(spark.createDataFrame([], result), k)
    sample = _unit(vectors.collect_sample(rows, SAMPLE_ROWS, total, dim))
    lists = max(1, min(MOST_LISTS, int(math.sqrt(total)), len(sample) // 8))
    centres = fit_centroids(sample, lists) if len(sample) else np.eye(1, dim)
    lists = len(centres)
    probes = probes_needed(sample, centres, k, recall) if len(sample) else lists
    rotation = np.linalg.qr(np.random.default_rng(3).standard_normal((dim, dim)))[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_unit(vectors.matrix(batch.column(1), dim)) @ centres.T).argmax(axis=1)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(near, pa.int32())], names=["id", "vec", "list"])

    placed = cut(rows.mapInArrow(place, "id bigint, vec array<double>, list int"))
    held = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row for each list
    sizes = np.array([held.get(i, 0) for i in range(lists)], np.int64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sims = _unit(vectors.matrix(batch.column(1), dim)) @ centres.T
                near = enough_lists(sims, sizes, k + batch.column(2).to_numpy(zero_copy_only=False), probes)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array([x.tolist() for x in near], pa.list_(pa.int32()))], names=["id", "vec", "lists"])

    queries = placed.filter(F.pmod("id", F.lit(query_step)) == 0).select("id", "vec")
    own = queries.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("own"))  # rows that a query must not meet
    asked = cut(queries.join(own, F.col("id") == F.col("_id")).select("id", "vec", "own").mapInArrow(probe, "id bigint, vec array<double>, lists array<int>"))
    wanted = {r["list"]: r["n"] for r in asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect()}
    pieces = np.array([math.ceil(held.get(i, 0) / PIECE_ROWS) for i in range(lists)])
    shares = np.array([math.ceil(wanted.get(i, 0) / QUERY_ROWS) for i in range(lists)])
    base = np.concatenate([[0], np.cumsum(pieces * shares)])  # list i has the keys base[i] + piece * shares[i] + share

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, data = batch.column(0).to_numpy(zero_copy_only=False), vectors.matrix(batch.column(1), dim)
            near, piece = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            of = near.astype(np.int64) * (1 << 32) + piece % np.maximum(pieces[near], 1)
            made = []
            for value in np.unique(of):
                i, p, at = int(value >> 32), int(value & 0xFFFFFFFF), of == value
                made += [vectors.pack(ids[at], data[at], base[i] + p * shares[i] + s, 1, 0) for s in range(shares[i])]
            if made:
                yield vectors.packed_batch(made)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, data = batch.column(0).to_numpy(zero_copy_only=False), vectors.matrix(batch.column(1), dim)
            share = batch.column(3).to_numpy(zero_copy_only=False)
            probed = batch.column(2)
            counts, flat = np.diff(probed.offsets.to_numpy()), probed.flatten().to_numpy(zero_copy_only=False)
            who = np.repeat(np.arange(len(ids)), counts)
            for i in np.unique(flat):
                at = who[flat == i]
                part = share[at] % max(1, shares[i])
                rows_made = [vectors.pack(ids[at[part == s]], data[at[part == s]], base[i] + p * shares[i] + s, 0, 0) for s in np.unique(part) for p in range(pieces[i])]
                if rows_made:
                    yield vectors.packed_batch(rows_made)

    salt = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")
    packed = placed.withColumn("salt", salt).mapInArrow(deal, vectors.PACKED).unionByName(asked.withColumn("salt", salt).mapInArrow(ask, vectors.PACKED))

    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        asks, holds = list(vectors.unpack(table, 0, dim, np.float64)), list(vectors.unpack(table, 1, dim, np.float64))
        if not asks or not holds:
            return
        q_ids, q = (np.concatenate([x[i] for x in asks]) for i in (0, 1))
        c_ids, c = (np.concatenate([x[i] for x in holds]) for i in (0, 1))
        q_turned, c_turned = _unit(q) @ rotation, _unit(c) @ rotation
        at, to = adaptive_scan(q_turned, c_turned, q_ids, c_ids, k)
        ranked = np.sort(c_ids)
        others = len(c_ids) - (np.searchsorted(ranked, q_ids, side="right") - np.searchsorted(ranked, q_ids))
        short = np.flatnonzero(np.bincount(at, minlength=len(q_ids)) < np.minimum(k, others))
        if len(short):  # the tests may err, but not to leave a query without rows that stand here
            more_at, more_to = np.nonzero(q_ids[short][:, None] != c_ids[None, :])
            passed = ~np.isin(at, short)
            at, to = np.concatenate([at[passed], short[more_at]]), np.concatenate([to[passed], more_to])
        order = np.argsort(at, kind="stable")
        at, to = at[order], to[order]
        scores = np.concatenate([cosine(q[at[i : i + 65536]], c[to[i : i + 65536]]) for i in range(0, len(at), 65536)]) if len(at) else np.zeros(0)
        edges = np.searchsorted(at, np.arange(len(q_ids) + 1))
        kept = [a + vectors.top_rows(scores[a:b], c_ids[to[a:b]], k) for a, b in zip(edges[:-1], edges[1:]) if b > a]
        if kept:
            kept = np.concatenate(kept)
            yield pa.record_batch([pa.array(q_ids[at[kept]]), pa.array(c_ids[to[kept]]), pa.array(scores[kept])], names=["query_id", "vec_id", "score"])

    pairs = map_groups(packed, "key", search, result)
    return vectors.best(pairs, k)
