"""Suffix-order tables: one row for each suffix of each text, with the columns a caller asks for.

``suffix_table`` runs the array kernels over chunks of whole texts inside one narrow ``mapInArrow``, so that
suffix array, Burrows-Wheeler column, common prefixes, LF, Psi and neighbours need no shuffle and no suffix
string ever travels. A text bounds the memory of a task; ``suffix_ranks_of_long_text`` orders a text that is too long
for that with joins and range-partitioned ranks. Positions count code points from 0; rank 0 is the empty suffix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringloom.operators import kernels
from stringloom.session import cut

CHUNK_SYMBOLS = 1 << 14  # sorted at once: the arrays of a chunk stay in a core's own cache, which halves the time of 1 << 18 on 8 cores
DEFAULT_SYMBOLS = ["", *"ACGNT"]  # fixed values: the alphabet of texts without one of their own

#: Column types of ``suffix_table``. ``ch`` is '' for the end marker; places that don't exist are null.
COLUMNS = {
    "pos": "bigint", "ch": "string", "lcp": "int", "lf": "bigint", "psi": "bigint", "occ": "bigint", "first_ch": "string",
    "psv": "bigint", "psev": "bigint", "nsv": "bigint", "nsev": "bigint",
}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def text_batches(batch: pa.RecordBatch, limit: int = CHUNK_SYMBOLS) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(rows, code points) of runs of texts of about ``limit`` symbols; null texts are left out."""
    rows, held, size = [], [], 0
    for i, text in enumerate(batch.column(1).to_pylist()):
        if text is None:
            continue
        own = kernels.codes(text)
        rows.append(i)
        held.append(own)
        size += len(own) + 1
        if size >= limit:
            yield rows, held
            rows, held, size = [], [], 0
    if held:
        yield rows, held


def _chars(symbols: np.ndarray) -> pa.Array:
    """Symbols as characters, '' for the end marker."""
    if not len(symbols):
        return pa.array([], pa.string())
    known = np.zeros(int(symbols.max()) + 1, bool)
    known[symbols] = True
    names = pa.array([chr(int(c) - 1) if c else "" for c in np.flatnonzero(known)], pa.string())
    return names.take(pa.array((np.cumsum(known) - 1)[symbols]))


def _neighbour(found: np.ndarray, start: np.ndarray) -> pa.Array:
    return pa.array(found - start, mask=found < 0)


def suffix_columns(order: kernels.SuffixOrder, wanted: Sequence[str]) -> dict[str, pa.Array]:
    """The wanted columns, in rank order, text by text."""
    lengths = np.diff(order.bounds)
    start, n = np.repeat(order.bounds[:-1], lengths), np.repeat(lengths, lengths)
    before = start + (order.sa - 1) % n  # position of the character before each suffix, wrapping to the end marker
    bwt = order.symbols[before]
    out: dict[str, pa.Array] = {}
    makers = {
        "pos": lambda: pa.array(order.sa), "ch": lambda: _chars(bwt), "lcp": lambda: pa.array(order.lcp.astype(np.int32)),
        "lf": lambda: pa.array(order.isa[before]), "psi": lambda: pa.array(order.isa[start + (order.sa + 1) % n]),
        "occ": lambda: pa.array(kernels.occurrence_rank(bwt, start)), "first_ch": lambda: _chars(order.symbols[start + order.sa]),
        "psv": lambda: _neighbour(kernels.previous_smaller(order.lcp, order.bounds), start), "psev": lambda: _neighbour(kernels.previous_smaller(order.lcp, order.bounds, True), start),
        "nsv": lambda: _neighbour(kernels.next_smaller(order.lcp, order.bounds), start), "nsev": lambda: _neighbour(kernels.next_smaller(order.lcp, order.bounds, True), start),
    }
    for name in wanted:
        out[name] = makers[name]()
    return out


def suffix_table(texts: DataFrame, columns: Sequence[str] = ("pos", "ch", "lcp"), id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, rank, *columns) with a row for each suffix, the empty one included. A null text has no rows."""
    unknown = set(columns) - set(COLUMNS)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    with_lcp = bool({"lcp", "psv", "psev", "nsv", "nsev"} & set(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, held in text_batches(batch):
                order = kernels.suffix_order(held, with_lcp=with_lcp)
                lengths = np.diff(order.bounds)
                ids = batch.column(0).take(pa.array(np.repeat(rows, lengths)))
                ranks = np.arange(order.bounds[-1]) - np.repeat(order.bounds[:-1], lengths)
                made = suffix_columns(order, columns)
                yield pa.record_batch([ids, pa.array(ranks), *made.values()], names=[id_col, "rank", *made])

    kind = texts.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", "rank bigint", *(f"{c} {COLUMNS[c]}" for c in columns)])
    return texts.select(id_col, text_col).mapInArrow(run, schema)


def answers(rows: DataFrame, schema: str, make: Callable[..., tuple], extra: Sequence[str] = (), with_lcp: bool = False, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, *schema): what ``make`` finds in the suffix order of each chunk of texts, without a row for each suffix and without a
    shuffle. ``make(order, *asked)`` gets the order and, of the columns ``extra``, each text's value; it returns the
    number of each row's text in the chunk and the columns of ``schema``. A null text has no rows."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held_rows, held in text_batches(batch):
                at = pa.array(held_rows)
                of, *columns = make(kernels.suffix_order(held, with_lcp=with_lcp), *(batch.column(2 + i).take(at).to_pylist() for i in range(len(extra))))
                yield pa.record_batch([batch.column(0).take(at.take(pa.array(of))), *(pa.array(c) if isinstance(c, np.ndarray) else c for c in columns)], names=[id_col, *names])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col, *extra).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def suffix_table_sql(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, rank, pos, ch) by plain expressions: explodes suffix strings, so for short texts only."""
    positions = texts.filter(F.col(text_col).isNotNull()).select(id_col, text_col, F.explode(F.sequence(F.lit(0), F.char_length(text_col))).alias("pos"))
    ranked = F.row_number().over(Window.partitionBy(id_col).orderBy(F.expr(f"substring({text_col}, pos + 1)"))) - 1
    ch = F.when(F.col("pos") == 0, "").otherwise(F.expr(f"substring({text_col}, pos, 1)"))
    return positions.select(id_col, ranked.cast("bigint").alias("rank"), F.col("pos").cast("bigint").alias("pos"), ch.alias("ch"))


def char_counts(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, ch, cnt): one row for each text and different character, the end marker '' among them, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, held in text_batches(batch):
                lengths = np.array([len(x) + 1 for x in held])
                symbols = np.concatenate([np.append(x + 1, 0) for x in held])
                keys, counts = np.unique(np.repeat(np.arange(len(held)), lengths) * (1 << 21) + symbols, return_counts=True)
                yield pa.record_batch([batch.column(0).take(pa.array(np.array(rows)[keys >> 21])), _chars(keys & ((1 << 21) - 1)), pa.array(counts.astype(np.int64))], names=[id_col, "ch", "cnt"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ch string, cnt bigint")


def default_alphabet(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, ch, comp) for texts whose alphabet file is missing: '' and ACGNT in this order where a text has six symbols with
    the end marker; other texts have no default and no rows."""
    sizes = char_counts(texts, id_col, text_col).groupBy(id_col).agg(F.count_distinct("ch").alias("_n")).filter(F.col("_n") == len(DEFAULT_SYMBOLS))
    return sizes.select(id_col, F.posexplode(F.array(*[F.lit(x) for x in DEFAULT_SYMBOLS])).alias("comp", "ch")).select(id_col, "ch", F.col("comp").cast("bigint").alias("comp"))


def alphabet(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, ch, comp, cnt, c): the end marker is '' with comp 0 and count 1; ``c`` counts smaller symbols."""
    counts = char_counts(texts, id_col, text_col).groupBy(id_col, "ch").agg(F.sum("cnt").alias("cnt"))
    own = Window.partitionBy(id_col).orderBy("ch")
    comp = (F.row_number().over(own) - 1).cast("bigint")
    below = F.coalesce(F.sum("cnt").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(id_col, "ch", comp.alias("comp"), "cnt", below.alias("c"))


def reassign_alphabet(letters: DataFrame, symbols: str, id_col: str = "text_id") -> DataFrame:
    """(id, valid, ch, comp): give each text's symbols the order of ``symbols`` ('' first). Valid only if that
    names as many different symbols as the text has; then comp is the place, else null."""
    order = ["", *symbols]
    places = F.create_map(*[x for i, c in enumerate(dict.fromkeys(order)) for x in (F.lit(c), F.lit(i))])
    sizes = letters.withColumn("_size", F.count("*").over(Window.partitionBy(id_col)))
    valid = (F.col("_size") == F.lit(len(order))) & F.lit(len(set(order)) == len(order))
    return sizes.select(id_col, valid.alias("valid"), "ch", F.when(valid, F.try_element_at(places, F.col("ch"))).cast("bigint").alias("comp"))


def recode(texts: DataFrame, letters: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, comps array<bigint>): each text as its symbols' compact codes."""
    maps = letters.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("ch", "comp"))).alias("_map"))
    joined = texts.filter(F.col(text_col).isNotNull()).join(maps, id_col)
    return joined.select(id_col, F.transform(F.filter(F.split(text_col, ""), lambda x: x != ""), lambda c: F.element_at("_map", c)).alias("comps"))


def sample_ranks(index: DataFrame, rate: int = 17) -> DataFrame:
    """Suffix-order samples: ranks that ``rate`` divides; no rows for rate 0."""
    return index.filter(F.pmod("rank", F.lit(rate)) == 0) if rate else index.limit(0)


def sample_positions(index: DataFrame, rate: int = 64) -> DataFrame:
    """Text-order samples: positions that ``rate`` divides; no rows for rate 0."""
    return index.filter(F.pmod("pos", F.lit(rate)) == 0) if rate else index.limit(0)


def suffix_ranks_of_long_text(chars: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(pos, rank) of one text given as (pos bigint, ch string) rows, end marker left out.

    Prefix doubling with equi-joins; ranks are the number of smaller keys, from a range-partitioned sort and the
    partitions' counts. No step needs the text in one task. Every round is cut to shared storage.
    """
    ends = chars.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("pos")).select("pos", F.lit("").alias("ch"))
    ranked = _dense(chars.unionByName(ends).select("pos", F.col("ch").alias("k1"), F.lit(0).cast("bigint").alias("k2")))
    step = 1
    for _ in range(most_rounds):
        if ranked.groupBy("rank").count().filter("count > 1").isEmpty():
            return ranked
        ahead = ranked.select((F.col("pos") - step).alias("pos"), (F.col("rank") + 1).alias("k2"))
        ranked = _dense(ranked.withColumnRenamed("rank", "k1").join(ahead, "pos", "left").select("pos", "k1", F.coalesce("k2", F.lit(0)).alias("k2")))
        step *= 2
    raise RuntimeError("the text did not settle")


def _dense(keys: DataFrame) -> DataFrame:
    """(pos, rank): rank counts the rows with a smaller (k1, k2)."""
    counts = keys.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    ranged = cut(counts.repartitionByRange(F.col("k1"), F.col("k2")).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("s"))  # one row for each partition
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    named = ranged.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "part").select("k1", "k2", (F.col("below") + F.col("offset")).alias("rank"))
    return cut(keys.join(named, ["k1", "k2"]).select("pos", "rank"))
