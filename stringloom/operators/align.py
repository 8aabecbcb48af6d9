"""Comparing two similar texts: merged suffix order, neighbour matches, common subsequences, block alignment.

All operators take pairs (pair_id, ref, seq). Within a pair the work is sequential or needs both texts; the
pairs are what runs in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringloom.operators import kernels
from stringloom.operators.index import CHUNK_SYMBOLS

BLOCK, DEPTH, SEED, MOST_EDITS = 1024, 32, 4, 8192
_INT = "bigint"


def _by_pair(pairs: DataFrame, names: list[str], kernel: Callable[[str, str], list[np.ndarray]]) -> DataFrame:
    """Run ``kernel`` on every pair of non-null texts; all columns but the id are bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (ref, seq) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if ref is not None and seq is not None:
                    made = kernel(ref, seq)
                    ids = batch.column(0).take(pa.array(np.full(len(made[0]), i)))
                    yield pa.record_batch([ids, *(pa.array(np.asarray(x, dtype=np.int64)) for x in made)], names=["pair_id", *names])

    kind = pairs.schema["pair_id"].dataType.simpleString()
    return pairs.select("pair_id", "ref", "seq").mapInArrow(run, f"pair_id {kind}, " + ", ".join(f"{n} {_INT}" for n in names))


def pair_chunks(batch: pa.RecordBatch, first: int, second: int, limit: int = CHUNK_SYMBOLS) -> Iterator[tuple[list[int], list[np.ndarray], list[np.ndarray]]]:
    """(rows, code points of the first texts, of the second) of runs of pairs of about ``limit`` symbols; a null leaves a pair out."""
    rows, a, b, size = [], [], [], 0
    for i, (x, y) in enumerate(zip(batch.column(first).to_pylist(), batch.column(second).to_pylist())):
        if x is None or y is None:
            continue
        rows.append(i)
        a.append(kernels.codes(x))
        b.append(kernels.codes(y))
        size += len(a[-1]) + len(b[-1]) + 2
        if size >= limit:
            yield rows, a, b
            rows, a, b, size = [], [], [], 0
    if rows:
        yield rows, a, b


def _by_pairs(pairs: DataFrame, names: list[str], make: Callable[[list[np.ndarray], list[np.ndarray]], tuple]) -> DataFrame:
    """As ``_by_pair`` for chunks of pairs: ``make(refs, seqs)`` returns the number of each row's pair in the chunk and the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, refs, seqs in pair_chunks(batch, 1, 2):
                of, *made = make(refs, seqs)
                ids = batch.column(0).take(pa.array(np.array(rows, np.int64)[of]))
                yield pa.record_batch([ids, *(x if isinstance(x, pa.Array) else pa.array(np.asarray(x, dtype=np.int64)) for x in made)], names=["pair_id", *names])

    kind = pairs.schema["pair_id"].dataType.simpleString()
    return pairs.select("pair_id", "ref", "seq").mapInArrow(run, f"pair_id {kind}, " + ", ".join(f"{n} {_INT}" for n in names))


def merged_order(pairs: DataFrame) -> DataFrame:
    """(pair_id, mutual_rank, from_seq, pos): suffixes of both texts in one order; equal ones from ref first."""

    def make(refs: list[np.ndarray], seqs: list[np.ndarray]) -> tuple:
        joint = kernels.joint_order(refs, seqs, with_lcp=False)
        return joint.of, np.arange(len(joint.of)) - joint.bounds[joint.of], joint.from_b, joint.pos

    return _by_pairs(pairs, ["mutual_rank", "from_seq", "pos"], make)


def neighbour_runs(pairs: DataFrame) -> DataFrame:
    """As ``neighbour_matches`` of the pairs' merged order, which stays in the task that makes it."""

    def make(refs: list[np.ndarray], seqs: list[np.ndarray]) -> tuple:
        joint = kernels.joint_order(refs, seqs, with_lcp=False)
        sides = []
        for ahead in (-1, 1):
            at = np.flatnonzero(~joint.from_b & (joint.rest > 0))
            near = at + ahead
            inside = (near >= joint.bounds[joint.of[at]]) & (near < joint.bounds[joint.of[at] + 1])
            at, near = at[inside], near[inside]
            hit = joint.from_b[near] & (joint.rest[near] > 0)
            sides.append((joint.of[at[hit]], np.full(int(hit.sum()), (ahead + 1) // 2), joint.pos[at[hit]], joint.pos[near[hit]]))
        of, side, ref, seq = (np.concatenate(x) for x in zip(*sides))
        longest = int(np.diff(joint.bounds).max(initial=0))
        order, _ = kernels.sorted_places((2 * of + side) * 2 * longest + ref - seq + longest, ref)
        of, side, ref, seq = of[order], side[order], ref[order], seq[order]
        new = np.ones(len(of), bool)
        new[1:] = (np.diff(of) != 0) | (np.diff(side) != 0) | (np.diff(ref) != 1) | (np.diff(seq) != 1)
        at = np.flatnonzero(new)
        return of[at], side[at], ref[at], seq[at], np.diff(np.append(at, len(of)))

    return _by_pairs(pairs, ["side", "ref_start", "seq_start", "length"], make)


def neighbour_matches(merged: DataFrame, least: int = 1) -> DataFrame:
    """(pair_id, side, ref_start, seq_start, length): runs of positions whose suffixes are neighbours in the
    merged order. Side 0: seq's suffix stands just before ref's, side 1: just after. Runs go on while both positions
    go up by one. Gaps and islands on the diagonal; empty suffixes are left out."""
    own = Window.partitionBy("pair_id").orderBy("mutual_rank")
    near = merged.select("pair_id", "from_seq", "pos", F.lag(F.struct("from_seq", "pos")).over(own).alias("b"), F.lead(F.struct("from_seq", "pos")).over(own).alias("a"))
    ends = near.groupBy("pair_id").agg(F.max(F.when(F.col("from_seq") == 0, F.col("pos"))).alias("ref_end"), F.max(F.when(F.col("from_seq") == 1, F.col("pos"))).alias("seq_end"))
    sides = near.filter("from_seq = 0").select("pair_id", "pos", F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("side"), F.col("b").alias("n")), F.struct(F.lit(1).cast("bigint").alias("side"), F.col("a").alias("n")))).alias("s"))
    hits = sides.filter("s.n.from_seq = 1").select("pair_id", "s.side", F.col("pos").alias("ref_pos"), F.col("s.n.pos").alias("seq_pos")).join(ends, "pair_id").filter("ref_pos < ref_end and seq_pos < seq_end")
    diagonal = Window.partitionBy("pair_id", "side", F.col("ref_pos") - F.col("seq_pos")).orderBy("ref_pos")
    marked = hits.withColumn("island", F.col("ref_pos") - F.row_number().over(diagonal)).withColumn("diagonal", F.col("ref_pos") - F.col("seq_pos"))
    runs = marked.groupBy("pair_id", "side", "diagonal", "island").agg(F.min("ref_pos").alias("ref_start"), F.min("seq_pos").alias("seq_start"), F.count("*").alias("length"))
    return runs.filter(F.col("length") >= least).select("pair_id", "side", "ref_start", "seq_start", "length")


def lcs_alignment(pairs: DataFrame, most_edits: int = MOST_EDITS) -> DataFrame:
    """(pair_id, k, ref_pos, seq_pos): a longest common subsequence, its k-th pair from 1. Beyond ``most_edits`` edits
    the copies of the commonest shared character instead."""

    def kernel(ref: str, seq: str) -> list[np.ndarray]:
        found = kernels.common_subsequence(ref, seq, most_edits)
        found = kernels.commonest_match(ref, seq) if found is None else found
        flat = np.array(found, np.int64).reshape(-1, 2)
        return [np.arange(1, len(flat) + 1), flat[:, 0], flat[:, 1]]

    return _by_pair(pairs, ["k", "ref_pos", "seq_pos"], kernel)


def lcs_lengths(alignment: DataFrame) -> DataFrame:
    return alignment.groupBy("pair_id").agg(F.max("k").alias("lcs"))


def map_position(alignment: DataFrame, positions: DataFrame) -> DataFrame:
    """(pair_id, ref_pos, seq_pos): where the k-th aligned ref position stands in seq; null if it is not aligned."""
    return positions.select("pair_id", "ref_pos").join(alignment.select("pair_id", "ref_pos", "seq_pos"), ["pair_id", "ref_pos"], "left")


def invariant_alignment(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """(pair_id, k, ref_pos, seq_pos): a longest increasing choice among the neighbour matches of each position."""
    options = runs.select("pair_id", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1), lambda i: F.struct((F.col("ref_start") + i).alias("r"), (F.col("seq_start") + i).alias("s")))).alias("o"))
    held = options.groupBy("pair_id").agg(F.array_sort(F.collect_list("o")).alias("options"))
    kind = pairs.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own in enumerate(batch.column(1).to_pylist()):
                by: dict[int, list[int]] = {}
                for o in own:
                    by.setdefault(o["r"], []).append(o["s"])
                refs = sorted(by)
                chosen = kernels.increasing_choice([by[r] for r in refs])
                ids = batch.column(0).take(pa.array([i] * len(chosen), pa.int64()))
                yield pa.record_batch([ids, pa.array(range(1, len(chosen) + 1), pa.int64()), pa.array([refs[e] for e, _ in chosen], pa.int64()), pa.array([v for _, v in chosen], pa.int64())], names=["pair_id", "k", "ref_pos", "seq_pos"])

    return held.mapInArrow(run, f"pair_id {kind}, k bigint, ref_pos bigint, seq_pos bigint")


def to_suffix_order(alignment: DataFrame, ref_index: DataFrame, seq_index: DataFrame) -> DataFrame:
    """(pair_id, ref_rank, seq_rank): text-order pairs as places in the Burrows-Wheeler columns; the indexes are
    keyed by pair_id. A character stands at the rank of the suffix after it."""
    a = ref_index.select("pair_id", (F.col("pos") - 1).alias("ref_pos"), F.col("rank").alias("ref_rank"))
    b = seq_index.select("pair_id", (F.col("pos") - 1).alias("seq_pos"), F.col("rank").alias("seq_rank"))
    return alignment.join(a, ["pair_id", "ref_pos"]).join(b, ["pair_id", "seq_pos"]).select("pair_id", "ref_rank", "seq_rank")


def _numbered(of: np.ndarray) -> np.ndarray:
    """Number of each row within its pair, from 0; the rows of a pair stand together."""
    return np.arange(len(of)) - np.searchsorted(of, of)


def _shared(joint: kernels.JointOrder, block: int, depth: int) -> tuple[np.ndarray, ...]:
    """(pair, its first row of all refs' columns, of all seqs', first row of the block and its size in ref, in seq)."""
    start, size = kernels.shared_blocks(joint, block, depth, SEED)
    seen = np.concatenate([[0], np.cumsum(joint.from_b)])
    of, b, b_size = joint.of[start], seen[start], seen[start + size] - seen[start]
    first = joint.bounds[of]
    return of, first - seen[first], seen[first], start - b, size - b_size, b, b_size


def block_rows(refs: list[np.ndarray], seqs: list[np.ndarray], block: int, depth: int, most_edits: int) -> tuple[np.ndarray, ...]:
    """(pair, block_no, ref_rank, seq_rank) of ``block_alignment``."""
    joint = kernels.joint_order(refs, seqs)
    of, ref_base, seq_base, ref, ref_size, seq, seq_size = _shared(joint, block, depth)
    k, i, j = kernels.block_subsequences(joint.before[~joint.from_b], joint.before[joint.from_b], ref, ref_size, seq, seq_size, most_edits)
    return of[k], _numbered(of)[k], (ref - ref_base)[k] + i, (seq - seq_base)[k] + j


def block_alignment(pairs: DataFrame, block: int = BLOCK, depth: int = DEPTH, most_edits: int = MOST_EDITS) -> DataFrame:
    """(pair_id, block_no, ref_rank, seq_rank): a common subsequence of the two Burrows-Wheeler columns, made block by block
    of suffixes that share a prefix. Increasing in both ranks; not the longest over block borders."""
    return _by_pairs(pairs, ["block_no", "ref_rank", "seq_rank"], lambda refs, seqs: block_rows(refs, seqs, block, depth, most_edits))


def partitions(pairs: DataFrame, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """(pair_id, block_no, ref_sp, ref_ep, seq_sp, seq_ep): the rank ranges that ``block_alignment`` works on, in order."""

    def make(refs: list[np.ndarray], seqs: list[np.ndarray]) -> tuple:
        of, ref_base, seq_base, ref, ref_size, seq, seq_size = _shared(kernels.joint_order(refs, seqs), block, depth)
        return of, _numbered(of), ref - ref_base, ref - ref_base + ref_size - 1, seq - seq_base, seq - seq_base + seq_size - 1

    return _by_pairs(pairs, ["block_no", "ref_sp", "ref_ep", "seq_sp", "seq_ep"], make)


def partition_sums(pairs: DataFrame, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """As ``partition_statistics`` of the pairs' partitions, a row for each pair."""

    def make(refs: list[np.ndarray], seqs: list[np.ndarray]) -> tuple:
        of, *both = _shared(kernels.joint_order(refs, seqs), block, depth)
        n = len(refs)
        total = lambda x: np.bincount(of, x, n).astype(np.int64)
        ranges, shared = total(None), total(np.minimum(both[3], both[5]))
        missed, over, sizes = [], [], []
        for texts, base, start, size in ((refs, both[0], both[2], both[3]), (seqs, both[1], both[4], both[5])):
            sp = start - base
            ends = sp + size
            expected = np.where(_numbered(of) == 0, 0, np.concatenate([[0], ends[:-1]]))
            last = np.zeros(n, np.int64)
            last[of] = ends  # the last block's stays
            sizes.append(np.array([len(t) + 1 for t in texts], np.int64))
            missed.append(total(sp - expected) + sizes[-1] - last)
            over.append(total(sp < expected))
        return np.arange(n), ranges, shared, *missed, sizes[0] - shared - missed[0], sizes[1] - shared - missed[1], *over

    return _by_pairs(pairs, ["ranges", "intersection", "ref_missed", "seq_missed", "ref_lost", "seq_lost", "ref_overlaps", "seq_overlaps"], make)


def partition_statistics(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pair_id, ranges, intersection, ref_missed, seq_missed, ref_lost, seq_lost, ref_overlaps, seq_overlaps): ranks outside all
    blocks, ranks that a block of the other side is too short for, and blocks that begin inside their predecessor.
    ``sizes`` is (pair_id, ref_size, seq_size)."""
    own = Window.partitionBy("pair_id").orderBy("block_no")
    length = lambda s: F.col(f"{s}_ep") - F.col(f"{s}_sp") + 1
    steps = blocks
    for s in ("ref", "seq"):
        expected = F.coalesce(F.lag(f"{s}_ep").over(own) + 1, F.lit(0))
        steps = steps.withColumn(f"{s}_gap", F.col(f"{s}_sp") - expected).withColumn(f"{s}_over", (F.col(f"{s}_sp") < expected).cast("int"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    summed = steps.groupBy("pair_id").agg(
        F.count("*").alias("ranges"), total(F.least(length("ref"), length("seq"))).alias("intersection"),
        *[x for s in ("ref", "seq") for x in (total(f"{s}_gap").alias(f"{s}_gaps"), total(f"{s}_over").alias(f"{s}_overlaps"), F.max_by(f"{s}_ep", "block_no").alias(f"{s}_last"))],
    )
    joined = sizes.join(summed, "pair_id", "left")
    for s in ("ref", "seq"):
        joined = joined.withColumn(f"{s}_missed", F.coalesce(f"{s}_gaps", F.lit(0)) + F.col(f"{s}_size") - F.coalesce(F.col(f"{s}_last") + 1, F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    lost = lambda s: (F.col(f"{s}_size") - F.coalesce("intersection", F.lit(0)) - F.col(f"{s}_missed")).cast("bigint").alias(f"{s}_lost")
    missed = lambda s: F.col(f"{s}_missed").cast("bigint").alias(f"{s}_missed")
    return joined.select("pair_id", zero("ranges"), zero("intersection"), missed("ref"), missed("seq"), lost("ref"), lost("seq"), zero("ref_overlaps"), zero("seq_overlaps"))


def _columns(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, symbols) of the Burrows-Wheeler columns of texts, one after the other."""
    order = kernels.suffix_order(texts, with_lcp=False)
    lengths = np.diff(order.bounds)
    start, n = np.repeat(order.bounds[:-1], lengths), np.repeat(lengths, lengths)
    return order.bounds, order.symbols[start + (order.sa - 1) % n]


def run_rows(refs: list[np.ndarray], seqs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(pair, k, ref_rank, seq_rank) of ``run_alignment``."""
    n = len(refs)
    at, column = _columns([*refs, *seqs])
    found = [kernels.run_matches(column[at[k] : at[k + 1]], column[at[n + k] : at[n + k + 1]]) for k in range(n)]
    of = np.repeat(np.arange(len(refs)), [len(i) for i, _ in found])
    return of, _numbered(of) + 1, *(np.concatenate(z) for z in zip(*found))


def run_alignment(pairs: DataFrame) -> DataFrame:
    """(pair_id, k, ref_rank, seq_rank): the two Burrows-Wheeler columns aligned run by run, the rule for blocks of end markers."""
    return _by_pairs(pairs, ["k", "ref_rank", "seq_rank"], run_rows)


def faults_of(pairs: DataFrame, rows: Callable[[list[np.ndarray], list[np.ndarray]], tuple[np.ndarray, ...]]) -> DataFrame:
    """(pair_id, aligned, faults) as ``alignment_faults``, of the alignment that ``rows`` makes of each chunk, (pair, number, ref_rank,
    seq_rank): held against columns that are built anew from the texts. Pairs that share nothing have a row with none."""

    def make(refs: list[np.ndarray], seqs: list[np.ndarray]) -> tuple:
        of, _, ref, seq = rows(refs, seqs)
        order, _ = kernels.sorted_places(2 * of + (ref >= 0), np.maximum(ref, 0))
        of, ref, seq = of[order], ref[order], seq[order]
        wrong, held = np.zeros(len(of), bool), []
        bounds, column = _columns([*refs, *seqs])
        for text, rank in ((of, ref), (of + len(refs), seq)):
            out = (rank < 0) | (rank >= np.diff(bounds)[text])
            held.append(column[bounds[text] + np.where(out, 0, rank)])
            wrong |= out
            wrong[1:] |= (of[1:] == of[:-1]) & (rank[1:] <= rank[:-1])
        wrong |= held[0] != held[1]
        return np.arange(len(refs)), np.bincount(of, minlength=len(refs)), np.bincount(of[wrong], minlength=len(refs))

    return _by_pairs(pairs, ["aligned", "faults"], make)


def alignment_faults(alignment: DataFrame, ref_index: DataFrame, seq_index: DataFrame) -> DataFrame:
    """(pair_id, aligned, faults): aligned pairs of Burrows-Wheeler rows, and those that don't increase on both sides or whose
    characters differ; any alignment of two columns must have none."""
    own = Window.partitionBy("pair_id").orderBy("ref_rank")
    rows = alignment.select("pair_id", "ref_rank", "seq_rank", F.lag("ref_rank").over(own).alias("_r"), F.lag("seq_rank").over(own).alias("_s"))
    a = ref_index.select("pair_id", F.col("rank").alias("ref_rank"), F.col("ch").alias("_a"))
    b = seq_index.select("pair_id", F.col("rank").alias("seq_rank"), F.col("ch").alias("_b"))
    joined = rows.join(a, ["pair_id", "ref_rank"], "left").join(b, ["pair_id", "seq_rank"], "left")
    wrong = ~F.col("_a").eqNullSafe(F.col("_b")) | F.col("_a").isNull() | (F.coalesce("_r", F.lit(-1)) >= F.col("ref_rank")) | (F.coalesce("_s", F.lit(-1)) >= F.col("seq_rank"))
    return joined.groupBy("pair_id").agg(F.count("*").alias("aligned"), F.count_if(wrong).alias("faults"))


def relative_lf(ref_index: DataFrame, seq_rest: DataFrame, alignment: DataFrame) -> DataFrame:
    """(pair_id, rank, ch, occ, lf) of seq without its own index: characters come through the alignment from ref's column or
    from seq's rest, ranks from running counts of a character, and LF adds the smaller characters."""
    column = rebuild_bwt(ref_index, seq_rest, alignment)
    own = Window.partitionBy("pair_id", "ch").orderBy("rank")
    counted = column.withColumn("occ", (F.row_number().over(own) - 1).cast("bigint"))
    letters = column.groupBy("pair_id", "ch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("pair_id").orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)
    starts = letters.select("pair_id", "ch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    return counted.join(starts, ["pair_id", "ch"]).select("pair_id", "rank", "ch", "occ", (F.col("_c") + F.col("occ")).alias("lf"))


def complement(index: DataFrame, alignment: DataFrame, side: str) -> DataFrame:
    """(pair_id, rank, ch) of the Burrows-Wheeler rows of one side ('ref' or 'seq') that are not aligned."""
    used = alignment.select("pair_id", F.col(f"{side}_rank").alias("rank"))
    return index.select("pair_id", "rank", "ch").join(used, ["pair_id", "rank"], "left_anti")


def rebuild_bwt(ref_index: DataFrame, seq_rest: DataFrame, alignment: DataFrame) -> DataFrame:
    """(pair_id, rank, ch) of seq from ref's aligned characters and seq's complement."""
    copied = alignment.join(ref_index.select("pair_id", F.col("rank").alias("ref_rank"), "ch"), ["pair_id", "ref_rank"]).select("pair_id", F.col("seq_rank").alias("rank"), "ch")
    return copied.unionByName(seq_rest.select("pair_id", "rank", "ch"))


def alignment_losses(alignment: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pair_id, aligned, ref_lost, seq_lost) with sizes (pair_id, ref_size, seq_size)."""
    counted = alignment.groupBy("pair_id").agg(F.count("*").alias("aligned"))
    joined = sizes.join(counted, "pair_id", "left").withColumn("aligned", F.coalesce("aligned", F.lit(0)))
    return joined.select("pair_id", "aligned", (F.col("ref_size") - F.col("aligned")).alias("ref_lost"), (F.col("seq_size") - F.col("aligned")).alias("seq_lost"))


def seeds(pairs_index: DataFrame, other_index: DataFrame, texts: DataFrame, others: DataFrame, length: int = SEED) -> DataFrame:
    """(pair_id, seed, ref_sp, ref_ep, seq_sp, seq_ep): prefixes of a length that occur in both texts, with their ranks;
    an inner join of the two sides' groups, largest ranges first by ``weight``."""

    def side(index: DataFrame, source: DataFrame, name: str) -> DataFrame:
        cut_ = index.join(source.select("pair_id", "text"), "pair_id").select("pair_id", "rank", F.substr("text", F.col("pos").cast("int") + 1, F.lit(length)).alias("seed"))
        return cut_.filter(F.char_length("seed") == length).groupBy("pair_id", "seed").agg(F.min("rank").alias(f"{name}_sp"), F.max("rank").alias(f"{name}_ep"))

    joined = side(pairs_index, texts, "ref").join(side(other_index, others, "seq"), ["pair_id", "seed"])
    return joined.withColumn("weight", F.col("ref_ep") - F.col("ref_sp") + F.col("seq_ep") - F.col("seq_sp") + 2)


def commonest_character(pairs: DataFrame) -> DataFrame:
    """(pair_id, ch, copies): the character with most common copies in both texts, ties to the smaller."""
    ref, seq = (pairs.select("pair_id", F.explode(F.filter(F.split(c, ""), lambda x: x != "")).alias("ch")).groupBy("pair_id", "ch").agg(F.count("*").alias(c)) for c in ("ref", "seq"))
    shared = ref.join(seq, ["pair_id", "ch"]).withColumn("copies", F.least("ref", "seq"))
    own = Window.partitionBy("pair_id").orderBy(F.desc("copies"), "ch")
    return shared.withColumn("_n", F.row_number().over(own)).filter("_n = 1").select("pair_id", "ch", "copies")


def map_alphabet(ref: DataFrame, seq: DataFrame, is_sorted: bool = True) -> DataFrame:
    """(pair_id, ch, ref_ch, exact): for each seq character the smallest ref character that is not smaller, or null.

    Both sides are (pair_id, ch) alphabets; a union and one backward-looking window instead of a range join. Alphabets that
    are not in code point order map every character to itself."""
    if not is_sorted:
        return seq.select("pair_id", "ch", F.col("ch").alias("ref_ch"), F.lit(True).alias("exact"))
    both = ref.select("pair_id", "ch", F.col("ch").alias("r")).unionByName(seq.select("pair_id", "ch", F.lit(None).cast("string").alias("r")))
    ahead = Window.partitionBy("pair_id").orderBy(F.col("ch"), F.col("r").isNull().desc()).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("ref_ch", F.first("r", ignorenulls=True).over(ahead)).filter(F.col("r").isNull())
    return found.select("pair_id", "ch", "ref_ch", F.coalesce(F.col("ref_ch") == F.col("ch"), F.lit(False)).alias("exact"))
