import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stringloom.llm import chosenpath
from stringloom.llm.common import text_chunks
from stringloom.llm.components import components


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids, forest, links, copy = sorted(sets), chosenpath.Forest(), Counter(), {}
    first = {}
    repeats = Counter(i for i, _ in rows)
    for i in ids:
        copy[i] = first.setdefault(sets[i], i) if sets[i] else i
        for j in ids:
            if i != j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += repeats[j]
                forest.join(i, j)
        if sets[i]:
            links[i] += repeats[i] - 1
    return {i: (forest.root(i), copy[i], links[i]) for i in ids}


def corpus(rng):
    words = [f"w{i}" for i in range(500)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "one  two"), (1005, "one two three"), (1006, "é " * 30), (1007, "é " * 31)]
    base = [[rng.choice(words) for _ in range(rng.randint(5, 120))] for _ in range(25)]
    common = [rng.choice(words) for _ in range(40)]
    for i in range(160):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 5])):
            own[rng.randrange(len(own))] = rng.choice(words)
        if rng.random() < 0.3:
            own += common
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize(("small", "block"), [(256, 256), (3, 4)])
def test_equals_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(chosenpath, "SMALL_BUCKET", small)
    monkeypatch.setattr(chosenpath, "BLOCK_ROWS", block)
    monkeypatch.setattr(chosenpath, "WHOLE_ROWS", block)
    rows = corpus(random.Random(small))
    rows += [rows[20], rows[20]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", F.lit("q")).withColumn("batch", F.lit(0)).withColumn("n_links", F.lit(0))
    got = {(r["doc_id"], r["class_id"], r["copy_id"], r["n_links"]) for r in chosenpath.near_duplicates(df).collect()}
    assert got == {(i, *v) for i, v in brute(rows).items()}
    assert chosenpath.near_duplicates(df).count() == len(rows)


def test_hot_near_copies_keep_every_link(spark, monkeypatch):
    monkeypatch.setattr(chosenpath, "SMALL_BUCKET", 16)
    monkeypatch.setattr(chosenpath, "BLOCK_ROWS", 50)
    monkeypatch.setattr(chosenpath, "WHOLE_ROWS", 50)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        own = list(base)
        own[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(own)))
    got = chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 299)}


def test_empty_null_ids_and_keep_one(spark):
    schema = "doc_id bigint, text string, _id string"
    assert chosenpath.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(5, text, "a"), (3, text, "b"), (None, text, "c"), (None, None, "d"), (8, None, "e"), (9, "", "f")], schema)
    kept = chosenpath.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["_id"] for r in kept.collect()) == ["b", "c", "d", "e", "f"]


def test_overlaps_and_components(spark):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    expected = [[len(set(a) & set(b)) for b in sets] for a in sets]
    assert chosenpath._overlaps(sets, list(sets)).tolist() == expected
    own = chosenpath._overlaps(sets, sets)
    np.fill_diagonal(own, 0)
    assert own.tolist() == [[0 if i == j else x for j, x in enumerate(row)] for i, row in enumerate(expected)]
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (300, 200), (200, 250)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200}


def test_keep_one_keeps_one_row_of_repeats(spark):
    schema = "doc_id bigint, text string, mark string"
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(1, texts[0], "a"), (1, texts[0], "a"), (1, texts[0], "a"), (2, texts[0], "b"), (7, texts[1], "c"), (7, texts[2], "d")]
    rows += [(None, texts[1], "e"), (None, "n " + texts[2], "f"), (None, " ".join(texts), "g"), (None, " ".join(texts), "g"), (None, None, "h"), (None, None, "h")]
    df = spark.createDataFrame(rows, schema).repartition(4)
    kept = chosenpath.keep_one(df, nameless=True)
    assert kept.columns == df.columns
    assert sorted(r["mark"] for r in kept.collect()) == ["a", "c", "d", "g", "h", "h"]
    assert sorted(r["mark"] for r in chosenpath.keep_one(df).collect()) == ["a", "c", "d", "e", "f", "g", "g", "h", "h"]


def test_a_pair_stays_on_some_path():
    """The chance that two sets which share 80 % of the tokens meet, at every depth, by simulation and by the formula."""
    rng = np.random.default_rng(2)
    assert chosenpath.RUNS == chosenpath.runs_needed() == 4
    assert chosenpath.runs_needed(0.9) < chosenpath.runs_needed(0.99999)
    met = [0] * chosenpath.LEVELS
    for _ in range(2000):
        a = rng.integers(0, 2**63, (1, chosenpath.SKETCH)).astype(np.uint64)
        b = np.where(rng.random((1, chosenpath.SKETCH)) < 0.8, a, a + np.uint64(1))
        keys = np.arange(1, dtype=np.uint64)
        for level in range(chosenpath.LEVELS):
            at = np.zeros(len(keys), np.int64)
            one, two = (chosenpath.child_keys(keys, at, h, level).ravel() for h in (a, b))
            keys = one[one == two]
            met[level] += len(keys) > 0
    assert all(m / 2000 >= 0.9 for m in met)


def test_large_nodes_are_split(monkeypatch):
    """Sets that share one passage part on the way down; near copies stay whole."""
    monkeypatch.setattr(chosenpath, "SMALL_BUCKET", 20)
    rng = np.random.default_rng(4)
    passage, sets = rng.integers(0, 2**63, 60).astype(np.uint64), []
    for i in range(400):
        own = rng.integers(0, 2**63, 140).astype(np.uint64)
        sets.append(np.unique(np.concatenate([passage, own]) if i < 300 else np.concatenate([passage[:50], own[:1]])))
    classes = pa.table({"id": list(range(400)), "hashes": pa.array([h.tobytes() for h in chosenpath.minhashes(sets)], pa.binary()), "batch": [0] * 400})
    answers = None
    for level in range(chosenpath.LEVELS):
        sent = chosenpath._ask(classes, answers, 1, level)
        answers = pa.Table.from_batches(list(chosenpath._answer(sent)))
    paths = chosenpath.Paths(classes, answers, 1, chosenpath.LEVELS)
    copies = [rows[rows >= 300] for rows, _ in paths.whole]
    assert set(np.concatenate(copies).tolist()) == set(range(300, 400))
    sizes = [sum(len(rows[rows < 300]) for rows, _ in paths.whole), sum(len(rows[rows < 300]) for rows, _ in paths.small)]
    assert sizes[0] < 300 * chosenpath.RUNS


TABLE = Path("/root/testdata/sf0.1/documents.parquet")


@pytest.mark.skipif(not TABLE.exists(), reason="needs the driver's tables")
def test_recall_on_a_whole_table(spark):
    """Links of all 10,000 documents against those counted over an index of all shingles."""
    docs = spark.read.parquet(str(TABLE)).select("doc_id", "text")
    rows = {r[0]: r[1] for r in docs.collect()}
    column = pa.array(list(rows.values()), pa.string())
    sets = [s for _, _, data, borders in text_chunks(column) for s in chosenpath.shingle_sets(data, borders)]
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    edges = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1, [len(flat)]])
    shared = Counter()
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a > 1:
            own = np.sort(of[a:b]).tolist()
            for k, i in enumerate(own):
                for j in own[k + 1 :]:
                    shared[i, j] += 1
    links = Counter()
    for (i, j), n in shared.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            links[i] += 1
            links[j] += 1
    ids = list(rows)
    got = {r["doc_id"]: r["n_links"] for r in chosenpath.near_duplicates(docs).collect()}
    assert sum(links.values()) > 1000
    assert all(got[i] <= links[k] for k, i in enumerate(ids))
    assert sum(got.values()) >= 0.999 * sum(links.values())
