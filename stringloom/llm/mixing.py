"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. The prefix sum of that expectation
runs over the source's documents; with one random offset added, a document comes out once for each whole
number that its stretch of the sum crosses. Documents stand by falling size, every second one from the other
end, so that sizes fall and rise again: what an offset adds at the one end it takes at the other, and the words
taken stay near the target whatever the offset.

Positions within a source come from a range-partitioned sort and per-partition counts, so that a source
with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import WORD, pick, positions, shield
from stringloom.session import cut

OFFSET_STEPS = 4096  # offsets are multiples of 1 / 4096, so that adding one never rounds up to a whole number
MOST_COPIES = 3


def word_count(column: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes by them. A target
    stops at ``most`` times its source's size; what is over goes to the others by weight, until none is above.
    Each round is an aggregate over the source table, and stops at least one source.
    """
    table = cut(positions(cut(sizes.withColumn("_one", F.lit(1))), "_one", [F.col("source").asc_nulls_last()]).drop("_one"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = table.withColumn("_weight", weight).withColumn("_most", F.col("source_size") * F.lit(most))
    rate = None  # words for each unit of weight; it only rises, so a stopped source stays stopped
    while True:
        stopped = F.lit(False) if rate is None else F.col("_most") < F.lit(rate) * F.col("_weight")
        row = table.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(stopped, F.col("_most")).otherwise(0)).alias("held"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("_weight"))).alias("open"),
        ).first()
        found = (row["all"] - row["held"]) / row["open"] if row["all"] and row["open"] else (rate or 0.0)
        if rate is not None and found <= rate:
            break
        rate = found
    target = F.when(F.col("_most") < F.lit(rate) * F.col("_weight"), F.col("_most").cast("double")).otherwise(F.lit(rate) * F.col("_weight"))
    return table.select("source", "source_size", target.alias("target"))


def mix_counts(docs: DataFrame, seed: int = 17, weights: Sequence[float] = (1, 2, 3), id_col: str = "doc_id") -> DataFrame:
    """One row for each document: (id, source, size, source_size, target, copies, taken).

    ``size`` counts words, null text 0; a null source is a source of its own, the last one. Ties in size go by a
    hash of the id and then the id itself; repeated rows count one by one. Reruns agree for one seed. A source
    without words has target 0 and takes nothing. An empty table gives no rows. Other columns are not read.
    """
    narrow = pick(docs, id_col, "source", "text").select(id_col, "source", word_count().alias("size"))
    return _counted(narrow, seed, weights, id_col, [F.col(id_col)]).select(id_col, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _counted(narrow: DataFrame, seed: int, weights: Sequence[float], id_col: str, ties: list[Column]) -> DataFrame:
    """``narrow``, which holds the id, ``source`` and ``size``, with its sources' facts and each row's ``copies``."""
    narrow = cut(narrow)
    sizes = cut(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_documents")))
    targets = source_targets(sizes.drop("_documents"), weights).join(sizes.select(F.col("source").alias("_s"), "_documents"), F.col("source").eqNullSafe(F.col("_s")))
    order = [F.col("size").desc(), F.xxhash64(F.lit(seed), F.col(id_col)), *ties]
    mixed = positions(narrow, "source", order, facts=targets.select(F.col("source").alias("_group"), "source_size", "target", "_documents"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(OFFSET_STEPS)) / F.lit(float(OFFSET_STEPS))
    half = F.floor(F.col("position") / 2)
    place = F.when(F.col("position") % 2 == 1, half + 1).otherwise(F.col("_documents") - half + 1)
    copies = (F.floor(place * each + offset) - F.floor((place - 1) * each + offset)).cast("bigint")
    return mixed.withColumn("copies", copies)


def mix(docs: DataFrame, seed: int = 17, weights: Sequence[float] = (1, 2, 3), id_col: str = "doc_id") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it (0 to 3 times).

    Every row counts for itself by a generated key, so rows that share an id, or have none, add up to the copies counted.
    """
    plain, at = shield(docs)
    keyed = cut(plain.withColumn("_key", F.monotonically_increasing_id()))
    narrow = keyed.select("_key", F.col(at[id_col]).alias("_id"), F.col(at["source"]).alias("source"), word_count(at["text"]).alias("size"), F.xxhash64(F.col(at["text"])).alias("_mark"))
    counts = _counted(narrow, seed, weights, "_id", [F.col("_id"), F.col("_mark"), F.col("_key")]).filter("copies > 0").select(F.col("_key").alias("_k"), F.col("copies").cast("int").alias("_copies"))
    joined = keyed.join(counts, F.col("_key") == F.col("_k"))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*plain.columns).toDF(*docs.columns)
