import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringloom.llm import ann, topk


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit(7)).withColumn("rank", F.lit("x")).withColumn("Embedding_", F.lit(0))


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((700, 12)) * rng.gamma(2, 1, (700, 1))
    data[300:420] = data[300]  # ties and repeats
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(9001, None), (9002, [1.0, None] * 6), (9003, [math.nan] * 12), (9004, [math.inf] * 12), (9005, [1.0]), (9100, [0.0] * 12)]
    got = topk.top_inner_products(table(spark, rows)).collect()
    whole = np.floor(np.vstack([data, np.zeros((1, 12))]) * 1024).astype(np.int64)
    ids = np.array([*range(700), 9100])
    expected = []
    for i in np.flatnonzero(ids % 100 == 0):
        scores = whole @ whole[i]
        other = ids != ids[i]
        best = np.lexsort((ids[other], -scores[other]))[:10]
        expected += [(ids[i], r + 1, ids[other][b], scores[other][b]) for r, b in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(map(tuple, expected))


@pytest.mark.parametrize("search", [topk.top_inner_products, ann.nearest])
def test_few_and_no_rows(spark, search):
    assert search(table(spark, [(1, [1.0, 2.0])]).limit(0)).count() == 0
    assert search(table(spark, [(100, [1.0, 2.0])])).count() == 0
    got = search(table(spark, [(100, [1.0, 2.0]), (3, [1.0, 2.5]), (2, [1.0, 2.5])])).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 3)]


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((3000, 24))
    data[1000:1900] = data[1000]  # a third of all rows are one vector
    data[5] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(9050, None), (9051, [None] * 24)]
    got = ann.nearest(table(spark, rows)).toPandas()
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-300)
    hit = total = 0
    for i in range(0, 3000, 50):
        own = got[got.query_id == i].sort_values("rank")
        cos = unit @ unit[i]
        cos[[i, 5]] = -9
        best = np.lexsort((np.arange(3000), -np.round(cos, 12)))[:5]
        assert own.score.tolist() == pytest.approx(cos[own.vec_id].tolist())
        assert (own["rank"] == range(1, 6)).all() and own.score.is_monotonic_decreasing
        hit += len(set(own.vec_id) & set(best))
        total += 5
    assert hit / total >= 0.9
    assert 5 not in set(got.vec_id)


def test_exact_copies_break_ties_by_id(spark):
    rows = [(i, [1.0, 1.0, 0.5]) for i in range(40)]
    got = ann.nearest(table(spark, rows)).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]


def test_ann_fills_up_queries_in_small_lists(spark):
    rng = np.random.default_rng(4)
    axes = np.eye(24)
    data = [axes[i % 3] + 0.01 * rng.standard_normal(24) for i in range(1500)]  # three dense groups
    rows = [(i + 1, v.tolist()) for i, v in enumerate(data) if (i + 1) % 50]
    lone = [axes[3 + j] + 0.01 * rng.standard_normal(24) for j in range(20)]
    rows += [(5000 + 50 * j, v.tolist()) for j, v in enumerate(lone)]  # outliers, each alone in its direction
    got = ann.nearest(table(spark, rows), recall=0.0).toPandas()
    assert got.groupby("query_id").size().to_dict() == {5000 + 50 * j: 5 for j in range(20)}
    assert not (got.query_id == got.vec_id).any()


def test_lists_are_taken_until_they_hold_enough():
    sims = np.array([[0.9, 0.5, 0.1, 0.0], [0.1, 0.9, 0.2, 0.3]])
    got = ann.enough_lists(sims, np.array([2, 3, 900, 0]), np.array([6, 6]), 1)
    assert [x.tolist() for x in got] == [[0, 1, 2], [1, 3, 2]]
    assert [len(x) for x in ann.enough_lists(sims, np.array([2, 3, 900, 0]), np.array([9999, 1]), 2)] == [4, 2]


def test_repeated_and_missing_ids(spark):
    """Rows that share an id are all candidates of others, never of each other; rows without an id take no part as queries."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)] + [(100, [1.0] + [0.0] * 7), (100, [0.0, 1.0] + [0.0] * 6), (7, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    top = topk.top_inner_products(df, k=70).filter("query_id = 100").collect()
    assert len(top) > 0 and all(r["vec_id"] != 100 for r in top) and sum(r["vec_id"] == 7 for r in top) >= 2
    near = ann.nearest(df, k=3).collect()
    assert {r["query_id"] for r in near} == {0, 50, 100} and all(r["vec_id"] != r["query_id"] for r in near)
