import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stringloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return bpe.TreeCodec(bpe.load_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def other(own):
    return tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_agrees_with_library_on_long_and_odd_pieces(own, other):
    rng = random.Random(4)
    for letters in ("ab", "abcdefghij", "éèñßü", "漢字仮名", "  \n\t", "0123456789", "=-_*#", "aaaaab"):
        for n in (0, 1, 33, 64, 700, 5000):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert own.encode(text) == other.encode_ordinary(text)
            assert own.decode(own.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    codec = bpe.codec(PATH, PATTERN)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_small_leaves_force_joins(own, other):
    tiny = bpe.TreeCodec(own.ranks, PATTERN, leaf=1)
    rng = random.Random(5)
    for _ in range(200):
        word = "".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 60)))
        assert tiny.encode_piece(word.encode()) == other.encode_ordinary(word)


def test_digest_query(spark, own, other):
    texts = [None, "", "hello world", "hello world", "x" * 20000, " \n\n a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "text", "1 AS n_tokens", "'t' AS tokens")
    rows = {r["doc_id"]: r for r in bpe.bpe_digest(df, PATH, PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = other.encode_ordinary(text or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.bpe_digest(df.limit(0), PATH, PATTERN).count() == 0
    tokens = bpe.encode_documents(df, PATH, PATTERN)
    assert {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.decode_tokens(tokens, PATH, PATTERN).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_decoding_passes_over_clashing_columns(spark):
    import public_tokenizers
    from pyspark.sql import functions as F

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = ["a b", "", None, "über \U0001d54f" * 40, "a b"]
    df = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("tokens", F.lit(1))
    tokens = bpe.encode_documents(df, ranks, public_tokenizers.PATTERN).withColumn("DATA", F.lit(2)).withColumn("data", F.lit(3))
    back = bpe.decode_tokens(tokens, ranks, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["data"]) for r in back) == sorted((t or "").encode() for t in texts)
