import random

import corpus_pipeline
from stringloom.llm import bpe


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    docs = [(i, " ".join(fresh(60)), "en", f"s{i % 3}") for i in range(90)]
    near = fresh(100)
    docs += [(200 + i, " ".join(near[:50] + [f"edit{i}"] + near[51:]), "en", "s0") for i in range(4)]
    passage = fresh(55)
    docs += [(300 + i, " ".join(fresh(30) + passage + fresh(30)), "en", "s1") for i in range(3)]
    docs += [(400 + i, " ".join([*fresh(20), "idiot", "moron", *fresh(20), "idiot", "moron"]), "en", "s2") for i in range(40)]
    docs += [(500, None, None, None), (501, "", "en", "s0")]
    rows = [(i, t, x, s, len(t) if t is not None else None) for i, t, x, s in docs]
    labels = [(i, 1, int(400 <= i < 440)) for i, *_ in rows if i < 90 or 400 <= i < 430]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    table, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        columns = table.columns
        stage(spark, table, str(tmp_path)).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        seen.append(table)
        assert name == "byte_bpe" or table.columns == columns
    toxic, near_, cut, mixed, encoded = seen
    assert {r[0] for r in toxic.select("doc_id").collect()} == {i for i, *_ in rows if not 400 <= i < 440}
    assert {r[0] for r in near_.select("doc_id").collect()} == {i for i, *_ in rows if not 400 <= i < 440 and i not in (201, 202, 203)}
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert all(" ".join(passage) not in (t or "") and len(texts[i].split()) == 60 for i, t in texts.items() if i and 300 <= i < 303)
    assert all(texts[i] == t for i, t, *_ in rows if i in texts and not 300 <= i < 303)
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies and max(copies.values()) <= 3
    codec = bpe.codec(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    assert encoded.count() == sum(copies.values())
    assert all(r["n_tokens"] == len(codec.encode(texts[r["doc_id"]] or "")) for r in encoded.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == encoded.count()


def test_empty_and_odd_tables(spark, tmp_path):
    """No rows at all, then rows that repeat, without ids, with a long text, ties in size and columns whose names clash."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, batch string, _text string, score int, class_id int"
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    twice, long = text(50), text(30_000)
    rows = [(1, twice, "en", "a"), (1, twice, "en", "a"), (None, twice, None, None), (None, None, None, None), (2, "", "en", "a"), (3, long, "en", None), (4, text(20), "en", "b"), (4, text(20), "en", "b")]
    tables = {"none": spark.createDataFrame([], schema), "odd": spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", 1, 2) for r in rows], schema)}
    for name, table in tables.items():
        for stage, make in corpus_pipeline.STAGES:
            columns = table.columns
            make(spark, table, str(tmp_path)).write.parquet(str(tmp_path / f"{name}-{stage}"))
            table = spark.read.parquet(str(tmp_path / f"{name}-{stage}"))
            assert stage == "byte_bpe" or table.columns == columns
            if name == "none":
                assert table.count() == 0
            elif stage == "ngram_jaccard_join":
                kept = [r["text"] for r in table.collect()]
                assert sorted(map(str, kept)) == sorted(map(str, [twice, None, "", long, rows[6][1], rows[7][1]]))
            elif stage == "substring_dedup":
                assert sorted(map(str, (r["text"] for r in table.collect()))) == sorted(map(str, kept))
