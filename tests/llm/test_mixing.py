import pytest
from pyspark.sql import functions as F

from stringloom.llm import mixing


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, out = sum(sizes.values()), {}
    open_ = set(sizes)
    while open_:
        left = total - sum(out.values())
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if each * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: each * weight[s] for s in open_}
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("size", F.lit("x")).withColumn("Target", F.lit(1))


@pytest.mark.parametrize("sources", [{"a": 40, "b": 400, "c": 3, "d": 90, None: 60}, {"only": 30}, {"é": 10, "z": 500}])
def test_targets_and_takes(spark, sources):
    rows = [(100 * k + i, s, "w " * (i % 7 + 1)) for k, (s, n) in enumerate(sources.items()) for i in range(n)]
    rows = [(i, s, t) for i, (_, s, t) in enumerate(rows)]
    got = mixing.mix_counts(table(spark, rows)).toPandas()
    sizes = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in sources}
    expected = targets_by_hand(sizes)
    for s in sources:
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert set(own.source_size) == {sizes[s]}
        assert own.target.iloc[0] == pytest.approx(expected[s])
        assert abs(own.taken.sum() - expected[s]) <= 3 * 7
    assert (got.taken <= 3 * got["size"]).all() and (got["size"].sum() == sum(sizes.values()))
    again = mixing.mix_counts(table(spark, rows).orderBy(F.desc("doc_id"))).toPandas()
    assert sorted(map(tuple, got[["doc_id", "taken"]].values)) == sorted(map(tuple, again[["doc_id", "taken"]].values))


def test_edge_rows(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, "a", " \t\n"), (4, "b", "one word two"), (4, "b", "one word two")]
    got = mixing.mix_counts(table(spark, rows)).toPandas().sort_values("doc_id")
    assert got["size"].tolist() == [0, 0, 0, 2, 2]
    assert got[got.source == "a"].taken.sum() == 0
    assert mixing.mix_counts(table(spark, rows).limit(0)).count() == 0


def test_mix_repeats_whole_rows(spark):
    rows = [(i, "ab"[i % 2], "w " * (i % 5 + 1)) for i in range(60)]
    docs = table(spark, rows)
    counts = {r["doc_id"]: r["copies"] for r in mixing.mix_counts(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in counts.items() if n}


def test_mix_takes_what_is_counted_of_rows_that_share_an_id(spark):
    rows = [(None, "big", f"w{i} x") for i in range(90)] + [(7, "big", f"v{i} y z") for i in range(60)] + [(i, "other", "a b c d") for i in range(8, 12)]
    docs = table(spark, rows).repartition(3)
    expected = {(r["doc_id"], r["source"]): r["n"] for r in mixing.mix_counts(docs).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()}
    mixed = mixing.mix(docs)
    got = {(r["doc_id"], r["source"]): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    assert got == {k: n for k, n in expected.items() if n}
    assert 0 < got[None, "big"] < 90
    assert max(r["count"] for r in mixed.groupBy("text", "source").count().collect() if r["source"] == "big") == 1
