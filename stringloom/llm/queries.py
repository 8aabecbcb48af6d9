"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers

from stringloom.llm import ann, bpe, chosenpath, langid, licenses, mixing, substring, topk, toxicity, warc
from stringloom.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.add("op1_license_scan")
def op1_license_scan(spark, sf_dir):
    return licenses.license_report(table(spark, sf_dir, "documents"))


@REGISTRY.add(
    "op2_exact_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM pairs)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 10
    """,
)
def op2_exact_topk(spark, sf_dir):
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


@REGISTRY.add("op3_source_mixing")
def op3_source_mixing(spark, sf_dir):
    mixed = mixing.mix_counts(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@REGISTRY.add("op4_byte_bpe")
def op4_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@REGISTRY.add(
    "op5_warc",
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
    SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, digest AS payload_digest,
      CASE WHEN octet_length(payload) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN octet_length(payload) >= 100 AND page_id > first THEN first END AS refers_to
    FROM f
    """,
)
def op5_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@REGISTRY.add("op6_language_id")
def op6_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@REGISTRY.add("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@REGISTRY.add("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    return substring.removal_digest(table(spark, sf_dir, "documents"))


@REGISTRY.add("op9_adaptive_ann")
def op9_adaptive_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@REGISTRY.add("op10_ngram_jaccard_join")
def op10_ngram_jaccard_join(spark, sf_dir):
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"))


@REGISTRY.add("pipeline")  # its stages hold a trained model, which SQL cannot express
def pipeline(spark, sf_dir):
    import corpus_pipeline  # the script stands beside the package, which also works installed alone

    return corpus_pipeline.run(spark, sf_dir)
