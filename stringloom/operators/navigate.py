"""Rank, select and navigation on suffix tables: equi-joins and filters on (text, rank) or (text, position)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringloom.operators import kernels
from stringloom.operators.index import answers


def rank_of(index: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, rank, ch, rank_before): how often each row's character stands earlier in the Burrows-Wheeler column.

    Takes the kernel's ``occ`` column, or a window where the table has none."""
    if "occ" in index.columns:
        return index.select(id_col, "rank", "ch", F.col("occ").alias("rank_before"))
    own = Window.partitionBy(id_col, "ch").orderBy("rank")
    return index.select(id_col, "rank", "ch", (F.row_number().over(own) - 1).cast("bigint").alias("rank_before"))


def select_of(index: DataFrame, k: Column | int, id_col: str = "text_id") -> DataFrame:
    """(id, ch, k, rank): the place of the k-th (from 1) copy of every character; no row where there is none."""
    k = F.lit(k) if isinstance(k, int) else k
    return rank_of(index, id_col).withColumn("k", (k).cast("bigint")).filter(F.col("rank_before") + 1 == F.col("k")).select(id_col, "ch", "k", "rank")


def rank_at(index: DataFrame, probes: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, i, ch, occurrences) for probes (id, i, ch): copies of ch in the Burrows-Wheeler column before place i.

    Probes stand among the column's rows of their character, in one running count: no probe meets rows of other
    characters, and each row is read once, however many probes there are."""
    rows = index.select(id_col, "ch", F.col("rank").alias("i"), F.lit(1).alias("_row"))
    asked = probes.select(id_col, "ch", F.col("i").cast("bigint").alias("i"), F.lit(0).alias("_row")).distinct()
    before = Window.partitionBy(id_col, "ch").orderBy("i", "_row").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.unionByName(asked).withColumn("occurrences", F.sum("_row").over(before))
    return counted.filter("_row = 0").select(id_col, "i", "ch", "occurrences")


def backward_step(index: DataFrame, letters: DataFrame, ranges: DataFrame, id_col: str = "text_id") -> DataFrame:
    """One step of backward search: (id, sp, ep, ch, new_sp, new_ep) for ranges (id, sp, ep, ch).

    An unknown character and an empty range give (1, 0)."""
    asked = ranges.select(id_col, F.col("sp").cast("bigint").alias("sp"), F.col("ep").cast("bigint").alias("ep"), "ch").distinct()
    borders = asked.select(id_col, F.explode(F.array("sp", F.col("ep") + 1)).alias("i"), "ch")
    counted = rank_at(index, borders, id_col)
    side = lambda name: counted.select(F.col(id_col).alias(f"_{name}"), F.col("ch").alias(f"_{name}_ch"), F.col("i").alias(f"_{name}_i"), F.col("occurrences").alias(name))
    out = asked.join(side("low"), (F.col(id_col) == F.col("_low")) & (F.col("ch") == F.col("_low_ch")) & (F.col("sp") == F.col("_low_i")))
    out = out.join(side("high"), (F.col(id_col) == F.col("_high")) & (F.col("ch") == F.col("_high_ch")) & (F.col("ep") + 1 == F.col("_high_i")))
    known = letters.select(F.col(id_col).alias("_id"), F.col("ch").alias("_c"), "c")
    out = out.join(known, (F.col(id_col) == F.col("_id")) & (F.col("ch") == F.col("_c")), "left")
    some = F.col("c").isNotNull() & (F.col("high") > F.col("low"))
    return out.select(id_col, "sp", "ep", "ch", F.when(some, F.col("c") + F.col("low")).otherwise(1).alias("new_sp"), F.when(some, F.col("c") + F.col("high") - 1).otherwise(0).alias("new_ep"))


def lf(index: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, rank, lf): the rank of the suffix one position to the left; from the start it wraps to the end marker."""
    return index.select(id_col, "rank", "lf")


def psi(index: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, rank, psi): the rank of the suffix one position to the right; from the end it wraps to the start."""
    return index.select(id_col, "rank", "psi")


def psi_steps(index: DataFrame, k: int, id_col: str = "text_id") -> DataFrame:
    """(id, rank, psi_k): k steps to the right in one equi-join on the position; null past the end of the text."""
    ahead = index.select(F.col(id_col).alias("_id"), F.col("pos").alias("_pos"), F.col("rank").alias("psi_k"))
    return index.select(id_col, "rank", "pos").join(ahead, (F.col(id_col) == F.col("_id")) & (F.col("pos") + k == F.col("_pos")), "left").select(id_col, "rank", "psi_k")


def locate(index: DataFrame, ranks: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, rank, pos) of asked (id, rank); null position outside the text's ranks."""
    return ranks.select(id_col, "rank").join(index.select(id_col, "rank", "pos"), [id_col, "rank"], "left")


def inverse(index: DataFrame, positions: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, pos, rank) of asked (id, pos); null rank outside the text."""
    return positions.select(id_col, "pos").join(index.select(id_col, "pos", "rank"), [id_col, "pos"], "left")


def extract(texts: DataFrame, low: Column | int, high: Column | int, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, part): the text from position low to high, both included; high stops at the end, an empty range gives ''."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    length = F.greatest(F.lit(0), F.least(high, F.char_length(text_col) - 1) - low + 1)
    return texts.select(id_col, F.substring(text_col, low.cast("int") + 1, length.cast("int")).alias("part"))


def extract_bwt(index: DataFrame, low: int, high: int, id_col: str = "text_id") -> DataFrame:
    """(id, part): the Burrows-Wheeler column from rank low to high, both included, the end marker as ''."""
    inside = index.filter(F.col("rank").between(low, high))
    rows = F.array_sort(F.collect_list(F.struct("rank", "ch")))
    return inside.groupBy(id_col).agg(F.array_join(F.transform(rows, lambda r: r["ch"]), "").alias("part"))


def char_ranges(index: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, ch, sp, ep): the ranks of the suffixes that start with each character."""
    return index.filter(F.col("first_ch") != "").groupBy(id_col, F.col("first_ch").alias("ch")).agg(F.min("rank").alias("sp"), F.max("rank").alias("ep"))


def text_sizes(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, size): positions of each text, end marker included."""
    return texts.filter(F.col(text_col).isNotNull()).select(id_col, (F.char_length(text_col) + 1).cast("bigint").alias("size"))


def sequence_counts(texts: DataFrame, id_col: str = "text_id", text_col: str = "text", mark: str = "\0") -> DataFrame:
    """(id, sequences): the sequences of a text, each ended by a mark or by the text's end."""
    return texts.filter(F.col(text_col).isNotNull()).select(id_col, F.size(F.split(F.regexp_replace(text_col, f"{mark}$", ""), mark)).cast("bigint").alias("sequences"))


def clamp(value: Column, low: Column, high: Column) -> Column:
    """Bound a value to [low, high]."""
    return F.greatest(F.least(value, high), low)


def range_length(sp: Column, ep: Column) -> Column:
    """Entries of a closed range; 0 for an empty one."""
    return F.when(sp + 1 > ep + 1, F.lit(0)).otherwise(ep + 1 - sp)


# ---- the same from the texts themselves: each task asks the suffix orders that it builds, and only answers leave it ----


def _code(ch: str) -> int:
    """Symbol of a character, 0 for the end marker ''; -1 for what no text holds at one place."""
    return 0 if ch == "" else ord(ch) + 1 if len(ch) == 1 else -1


def _column(order: kernels.SuffixOrder, a: int, b: int) -> np.ndarray:
    """The Burrows-Wheeler column of the text between two bounds, as symbols."""
    return order.symbols[a:b][order.sa[a:b] - 1]


def psi_steps_of(texts: DataFrame, k: int, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``psi_steps``."""

    def make(order: kernels.SuffixOrder) -> tuple:
        lengths = np.diff(order.bounds)
        of = np.repeat(np.arange(len(lengths)), lengths)
        start, ahead = order.bounds[of], order.sa + k
        out = (ahead < 0) | (ahead >= lengths[of])
        return of, np.arange(len(of)) - start, pa.array(order.isa[np.where(out, start, start + ahead)], mask=out)

    return answers(texts, "rank bigint, psi_k bigint", make, id_col=id_col, text_col=text_col)


def rank_at_of(rows: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``rank_at``, for rows (id, text, asked) with an array of probes (i, ch) each; repeats count once."""

    def make(order: kernels.SuffixOrder, asked: list) -> tuple:
        of, i, ch, found = [], [], [], []
        for t, (a, b, own) in enumerate(zip(order.bounds[:-1], order.bounds[1:], asked)):
            own = sorted({(x["i"], x["ch"]) for x in own or []})
            column = _column(order, a, b)
            places = {c: np.flatnonzero(column == _code(c)) for c in {c for _, c in own}}
            of += [t] * len(own)
            i += [x for x, _ in own]
            ch += [c for _, c in own]
            found += [int(np.searchsorted(places[c], x)) for x, c in own]
        return np.array(of, np.int64), pa.array(i, pa.int64()), pa.array(ch, pa.string()), pa.array(found, pa.int64())

    return answers(rows, "i bigint, ch string, occurrences bigint", make, ["asked"], id_col=id_col, text_col=text_col)


def backward_step_of(texts: DataFrame, last: str, letters: list[str], id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``backward_step``, from each text's range of the suffixes that start with ``last`` to each of ``letters``; texts
    without ``last`` have no rows."""

    def make(order: kernels.SuffixOrder) -> tuple:
        of, rows = [], []
        for t, (a, b) in enumerate(zip(order.bounds[:-1], order.bounds[1:])):
            symbols = order.symbols[a:b]
            below = lambda c: int(np.count_nonzero(symbols < c))  # noqa: B023, E731
            sp, ep = below(_code(last)), below(_code(last) + 1) - 1
            if sp > ep:
                continue
            column = _column(order, a, b)
            for ch in letters:
                c = _code(ch)
                low, high = (int(np.count_nonzero(column[:x] == c)) for x in (sp, ep + 1))
                of.append(t)
                rows.append((sp, ep, ch, below(c) + low, below(c) + high - 1) if high > low else (sp, ep, ch, 1, 0))
        columns = list(zip(*rows)) if rows else [()] * 5
        return np.array(of, np.int64), *(pa.array(x, pa.string() if i == 2 else pa.int64()) for i, x in enumerate(columns))

    return answers(texts, "sp bigint, ep bigint, ch string, new_sp bigint, new_ep bigint", make, id_col=id_col, text_col=text_col)


def locate_of(rows: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``locate``, for rows (id, text, asked) with an array of ranks each; texts that are null have no positions."""
    return _asked_places(rows, "rank", "pos", "sa", id_col, text_col)


def inverse_of(rows: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``inverse``, for rows (id, text, asked) with an array of positions each; texts that are null have no ranks."""
    return _asked_places(rows, "pos", "rank", "isa", id_col, text_col)


def _asked_places(rows: DataFrame, name: str, answer: str, array: str, id_col: str, text_col: str) -> DataFrame:
    def make(order: kernels.SuffixOrder, asked: list) -> tuple:
        counts = [len(x or []) for x in asked]
        of = np.repeat(np.arange(len(asked)), counts)
        wanted = pa.array([v for own in asked for v in own or []], pa.int64())
        at = wanted.fill_null(-1).to_numpy(zero_copy_only=False)
        out = (at < 0) | (at >= np.diff(order.bounds)[of])
        return of, wanted, pa.array(getattr(order, array)[order.bounds[of] + np.where(out, 0, at)], pa.int64(), mask=out)

    found = answers(rows.filter(F.col(text_col).isNotNull()), f"{name} bigint, {answer} bigint", make, ["asked"], id_col=id_col, text_col=text_col)
    none = rows.filter(F.col(text_col).isNull()).select(id_col, F.explode("asked").alias(name), F.lit(None).cast("bigint").alias(answer))
    return found.unionByName(none)


def extract_bwt_of(texts: DataFrame, low: int, high: int, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``extract_bwt``; texts without a rank in the range have no row."""

    def make(order: kernels.SuffixOrder) -> tuple:
        of, parts = [], []
        for t, (a, b) in enumerate(zip(order.bounds[:-1], order.bounds[1:])):
            if low < b - a and low <= high:
                of.append(t)
                own = _column(order, a, b)[max(low, 0) : high + 1]
                parts.append((own[own > 0] - 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"))
        return np.array(of, np.int64), pa.array(parts, pa.string())

    return answers(texts, "part string", make, id_col=id_col, text_col=text_col)
