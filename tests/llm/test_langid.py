import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from stringloom.llm import langid

WORDS = {"aa": "the and with house river stone water light".split(), "bb": "über straße für nicht gewiß öl schön weiß".split(), "cc": "мир дом река свет вода камень".split()}


def corpus(n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(2, 40))), lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus() + [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "bb"), (903, "straße nicht", None), (904, "water " * 20000, "aa"), (904, "water " * 20000, "aa"), (None, "water", "aa")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit(2)).withColumn("_text", F.lit(3))
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    for i, text, lang in rows:
        r = got[i]
        assert 0 <= r["score"] <= 1
        assert i is None or r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        if i in (900, 901, 902):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif lang:
            assert r["lang_pred"] == lang
    assert got[903]["lang_pred"] == "bb"
    assert langid.identify(df).count() == len(rows)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_rows_teach_nothing(spark):
    rows = corpus()
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, t, x in rows]
    a, b = (sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(x, "doc_id bigint, text string, lang string")).collect()) for x in (rows, changed))
    assert a == b


def _direct(text, matrix):
    """Sum and n-grams of one text, n-gram by n-gram."""
    text = " " + text.lower() + " "
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    total, count = np.zeros(matrix.shape[1], np.int64), 0
    for i in range(len(codes)):
        value = 0
        for n in range(1, min(3, len(codes) - i) + 1):
            value = (value * 0x01000193 + (int(codes[i + n - 1]) + n) * 0x9E3779B1) & 0xFFFFFFFF
            total += matrix[(((value ^ (value >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF) >> 17]
            count += 1
    return total, count


def test_a_text_has_one_score_in_any_batch_and_chunk(monkeypatch):
    rng = random.Random(3)
    matrix = np.random.default_rng(1).integers(-(1 << 24), 0, (langid.BUCKETS, 3)).astype(np.int32)
    texts = ["abc def", "x" * 50, "", "é ü ß", "ab cd", "zebra"] + ["".join(rng.choice("abcß м") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    expected = [_direct(t, matrix) for t in texts]
    for limit in (1, 2, 3, 7, 50, 1 << 18):
        monkeypatch.setattr(langid.chunks, "__defaults__", (limit,))
        for start in (0, 3):
            sums, counts = langid.score_texts(texts[start:], matrix)
            assert [(s.tolist(), n) for s, n in zip(sums, counts)] == [(s.tolist(), n) for s, n in expected[start:]]
        assert all(langid.score_texts([t], matrix)[0][0].tolist() == s.tolist() for t, (s, _) in zip(texts, expected))


def test_partitions_do_not_change_scores(spark):
    rows = corpus(200) + [(5000, "über straße " * 30000, "bb"), (5001, "x", "aa"), (5002, "ß", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    results = [sorted(map(tuple, langid.identify(df.repartition(n, "doc_id")).collect())) for n in (1, 7, 200)]
    assert results[0] == results[1] == results[2]
    assert len(rows[200][1]) > 300_000 and [r for r in results[0] if r[0] == 5000][0][2] == "bb"
