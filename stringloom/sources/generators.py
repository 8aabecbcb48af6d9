"""Seeded generators: random positions and ranges, mutated copies of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.operators import kernels

SEED = 0xDEADBEEF
# Fixed values of the mutation model.
INDEL_SHARE, EXTEND, BASES = 0.1, 0.8, "ACGT"


def random_positions(spark: SparkSession, n: int, size: int, seed: int = SEED) -> DataFrame:
    """(qid, pos): n positions below ``size``, the same for one seed."""
    return spark.range(n).select(F.col("id").alias("qid"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(size)).alias("pos"))


def random_ranges(spark: SparkSession, n: int, size: int, seed: int = SEED, base: int = 16) -> DataFrame:
    """(qid, sp, ep): closed ranges; the length bound is base ** k with probability 0.5 ** k, cut at the end."""
    draw = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    k = F.least(F.lit(15.0), F.greatest(F.lit(1.0), F.ceil(-F.log2(F.lit(1.0) - draw("k")))))
    made = spark.range(n).select(F.col("id").alias("qid"), F.floor(draw("sp") * size).cast("bigint").alias("sp"), (F.floor(draw("len") * F.pow(F.lit(float(base)), k)) + 1).cast("bigint").alias("n"))
    return made.select("qid", "sp", F.least(F.col("sp") + F.col("n") - 1, F.lit(size - 1)).alias("ep"))


def mutate_text(text: str, rate: float, seed: int) -> tuple[str, dict[str, int]]:
    """A mutated copy and what was done: of the mutations 5 % insert, 5 % delete, the rest substitutes another base.

    Indels have length k with probability 0.2 * 0.8 ** (k - 1). In a run of N, insertions insert N and nothing is substituted.
    """
    rng = np.random.default_rng(seed)
    done = dict.fromkeys(("substitutions", "insertions", "deletions", "inserted", "deleted"), 0)
    hits = np.flatnonzero(rng.random(len(text)) < rate)  # only these places are visited
    kinds, lengths, picks = rng.random(len(hits)), rng.geometric(1 - EXTEND, len(hits)), rng.integers(0, 1 << 30, len(hits))
    out, end = [], 0  # text up to ``end`` is copied or gone
    for i, kind, k, pick in zip(hits.tolist(), kinds.tolist(), lengths.tolist(), picks.tolist()):
        if i < end:
            continue  # inside a deletion
        ch = text[i]
        if kind >= INDEL_SHARE and ch == "N":
            continue
        out.append(text[end:i])
        if kind >= INDEL_SHARE:
            others = BASES.replace(ch, "")
            out.append(others[pick % len(others)])
            done["substitutions"] += 1
            end = i + 1
        elif kind >= INDEL_SHARE / 2:
            end = min(len(text), i + k)
            done["deletions"] += 1
            done["deleted"] += end - i
        else:
            made = "N" * k if text[max(0, i - 1) : i + 1] == "NN" else "".join(BASES[x] for x in rng.integers(0, len(BASES), k))
            out.append(made + ch)
            done["insertions"] += 1
            done["inserted"] += k
            end = i + 1
    return "".join([*out, text[end:]]), done


def mutate(texts: DataFrame, rate: float, seed: int = SEED, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, text, substitutions, insertions, deletions, inserted, deleted); each text's seed comes from the seed and its id.
    A null text stays null, with no mutations."""
    counts = ("substitutions", "insertions", "deletions", "inserted", "deleted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [mutate_text(t or "", rate, kernels.fnv1a([int(i) & 0xFFFFFFFFFFFFFFFF], kernels.fnv1a([seed]))) for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array([None if t is None else m[0] for t, m in zip(batch.column(2).to_pylist(), made)], pa.string()), *(pa.array([m[1][c] for m in made], pa.int64()) for c in counts)], names=[id_col, "text", *counts])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col), F.xxhash64(id_col).alias("_seed"), text_col).mapInArrow(run, f"`{id_col}` {kind}, text string, " + ", ".join(f"{c} bigint" for c in counts))
