"""Jaccard self-join of word-shingle sets by chosen paths.

Copies (equal shingle sets) become one class first. A run is a tree of nodes: a node that holds many classes samples
BRANCH tokens (minhash positions, the same for all its classes), and every class goes to a child for each of them; two
classes meet in a child if they share its token. Nodes are split on, level by level, until they hold few classes, which are
then compared all against all by sketches. A pair whose sets agree in a share t of the tokens stays together on some path
with a chance of at least x = 1 - (1 - t * x) ** BRANCH at any depth, and runs are repeated until that makes RECALL of the
pairs at the threshold. A node that sampled tokens no longer split (near copies share them all) or that is still large at the
last level is compared by brute force: its classes form one candidate cluster.

Candidate pairs only decide which classes meet: connected candidates form clusters, and within a cluster
all pairs get their exact similarity, in blocks of bounded size, each pair once; block pairs whose set sizes rule out the
similarity are left out. So links are counted exactly and without emitting pairs. How large a node is gets asked
and answered by batch, as in a census: one row for each batch and distinct node, however many rows share it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringloom.llm.common import grouped, map_groups, mix64, pick, positions, shield, shingles, text_chunks, word_hashes, word_spans
from stringloom.llm.components import components
from stringloom.session import cut

WIDTH = 5
NUMERATOR, DENOMINATOR = 4, 5  # the similarity asked for, as a fraction
RECALL = 0.9999  # of the pairs at the threshold, by the sampled tokens
BRANCH, LEVELS = 2, 6
UNSPLIT = 6  # steps of 2 ** -0.125: a child that holds more than 2 ** -0.75 of its parent was not split
SKETCH = 64
SKETCH_SHARE = 0.55  # equal sketch bytes of a candidate pair: five deviations below the threshold
SMALL_BUCKET = 256
BLOCK_ROWS, CLUSTER_BLOCKS = 1024, 28  # the largest block, and the blocks that a middling cluster is cut into
WHOLE_ROWS = 1024  # clusters that are compared in one piece
MOST_PARTITIONS = 1 << 16  # beyond that, partitions hold more batches; a task holds one batch at a time
BATCH_ROWS = 2048  # classes that ask together
PARTITION_BATCHES = 4  # several batches share a partition, which evens the partitions out
MEMBER_SALTS = 256
SPOTS = 1 << 20

_SEEDS = mix64(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64) * np.uint64(0xB5297A4D3F84D5B5))
_XOR, _TIMES = _SEEDS[:SKETCH], _SEEDS[SKETCH:] | np.uint64(1)


def runs_needed(recall: float = RECALL, share: float = NUMERATOR / DENOMINATOR, branch: int = BRANCH) -> int:
    """Runs after which a pair that shares ``share`` of its tokens has met with a chance of ``recall``."""
    meets = 1.0
    for _ in range(1000):
        meets = 1 - (1 - share * meets) ** branch
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


RUNS = runs_needed()


def shingle_sets(data: np.ndarray, borders: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingles of each text of a chunk; a text of fewer words is one shingle, without words none."""
    starts, ends, bounds = word_spans(data, borders)
    words = word_hashes(data, starts, ends)
    flat = shingles(words, width, width)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            out.append(np.unique(flat[a : b - width + 1]))
        else:
            out.append(shingles(words[a:b], int(b - a), int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def fingerprint(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums of each set."""
    sums = [(s.sum(dtype=np.uint64), mix64(s ^ np.uint64(0x8CB92BA72F3D8DD7)).sum(dtype=np.uint64)) for s in sets]
    return np.array([x for x, _ in sums], np.uint64).view(np.int64), np.array([y for _, y in sums], np.uint64).view(np.int64)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCH minhashes of each non-empty set."""
    out = np.zeros((len(sets), SKETCH), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k in range(SKETCH):
            out[full, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _TIMES[k], starts)
    return out


def child_keys(keys: np.ndarray, rows: np.ndarray, hashes: np.ndarray, level: int) -> np.ndarray:
    """The children of nodes: for each (node, class) BRANCH keys, by tokens that the node samples from the level's
    share of the positions, so that no path samples a position twice."""
    if level == 0:
        first, width = 0, BRANCH * RUNS
        place = (keys.astype(np.int64) * BRANCH)[:, None] + np.arange(BRANCH)
    else:
        width = (SKETCH - BRANCH * RUNS) // (LEVELS - 1)
        first = BRANCH * RUNS + (level - 1) * width
        drawn = mix64(keys ^ np.uint64(0xC2B2AE3D27D4EB4F))
        start, step = (drawn % np.uint64(width)).astype(np.int64), (drawn >> np.uint64(32)) % np.uint64(width - 1)
        place = (start[:, None] + np.arange(BRANCH) * (1 + step.astype(np.int64))[:, None]) % width
    own = hashes[rows[:, None], first + place]
    return mix64(keys[:, None] * np.uint64(0x2545F4914F6CDD1D) + mix64(own + (first + place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, fp1, fp2, hashes) of every document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, data, borders in text_chunks(batch.column(1)):
                sets = shingle_sets(data, borders)
                one, two = fingerprint(sets)
                hashes = minhashes(sets)
                n = np.array([len(s) for s in sets], np.int64)
                keep = np.flatnonzero(n)
                made = [hashes[i].tobytes() for i in keep]
                yield pa.record_batch([batch.column(0).slice(first, rows).take(pa.array(keep)), pa.array(n[keep]), pa.array(one[keep]), pa.array(two[keep]), pa.array(made, pa.binary())], names=["id", "n", "fp1", "fp2", "hashes"])

    named = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), text_col)
    return named.mapInArrow(run, "id bigint, n bigint, fp1 bigint, fp2 bigint, hashes binary")


def _by_bucket(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(order, bucket of each name in that order, borders of the buckets)."""
    of = (mix64(names ^ np.uint64(0x589965CC75374CC3)) >> np.uint64(1)).astype(np.int64) % buckets
    order = np.argsort(of, kind="stable")
    of = of[order]
    edges = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]) if len(of) else np.zeros(1, int)
    return order, of, list(zip(edges[:-1], edges[1:]))


def _hash_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH)


class Paths:
    """The classes of one batch on their paths: open nodes, small ones, and those that cannot be split."""

    def __init__(self, classes: pa.Table, answers: pa.Table | None, buckets: int, levels: int):
        self.ids, self.hashes = classes.column("id").to_numpy(), _hash_rows(classes.column("hashes"))
        self.buckets, self.notes, self.of, self.level = buckets, {}, {}, 0
        for kind, bucket, sizes in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "sizes"))) if answers is not None else ():
            if kind < 0:
                self.notes[kind] = sizes
            else:
                self.of[bucket] = np.frombuffer(sizes, np.uint8)
        self.rows = np.repeat(np.arange(len(self.ids)), RUNS)
        self.keys = np.tile(np.arange(RUNS, dtype=np.uint64), len(self.ids))
        self.held = np.full(len(self.rows), 1 << 20)  # how large each open node is
        self.small: list[tuple[np.ndarray, np.ndarray]] = []
        self.whole: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(levels):
            self.hear(self.ask())

    def ask(self) -> np.ndarray:
        """Go down a level: the keys of all children."""
        keys = child_keys(self.keys, self.rows, self.hashes, self.level)
        self.rows, self.held, self.keys = np.repeat(self.rows, BRANCH), np.repeat(self.held, BRANCH), keys.ravel()
        return self.keys

    def hear(self, keys: np.ndarray) -> None:
        """Take in how many classes each child holds."""
        names, back = np.unique(keys, return_inverse=True)
        kind = -1 - self.level
        if kind in self.notes:
            codes = np.frombuffer(self.notes[kind], np.uint8) if self.notes[kind] else np.zeros(0, np.uint8)
        else:
            order, of, parts = _by_bucket(names, self.buckets)
            codes = np.zeros(len(names), np.uint8)
            for a, b in parts:
                codes[order[a:b]] = self.of[int(of[a])]
            self.notes[kind] = codes.tobytes()
        size = codes[back].astype(np.int64)
        small, large = size == 1, size > 1
        whole = large & ((size > self.held - UNSPLIT) | (self.level == LEVELS - 1))
        self.small.append((self.rows[small], keys[small]))
        self.whole.append((self.rows[whole], keys[whole]))
        on = large & ~whole
        self.rows, self.keys, self.held = self.rows[on], keys[on], size[on]
        self.level += 1


ASKED = "bucket bigint, batch bigint, kind int, names binary, counts binary"
ANSWERED = "batch bigint, kind int, bucket bigint, sizes binary"


def _ask(classes: pa.Table, answers: pa.Table | None, buckets: int, level: int) -> pa.Table:
    """A batch's distinct nodes of one level with the number of its classes in each, and notes of what it has heard."""
    rows: list[tuple[int, int, bytes, bytes]] = []
    batch = classes.column("batch")[0].as_py() if classes.num_rows else 0
    if classes.num_rows:
        paths = Paths(classes, answers, buckets, level)
        names, counts = np.unique(paths.ask(), return_counts=True)
        order, of, parts = _by_bucket(names, buckets)
        names, counts = names[order], counts[order].astype(np.int32)
        rows = [(int(of[a]), level, names[a:b].tobytes(), counts[a:b].tobytes()) for a, b in parts]
        rows += [(batch % buckets, kind, b"", sizes) for kind, sizes in paths.notes.items()]
    columns = list(zip(*rows)) or [()] * 4
    return pa.table({"bucket": pa.array(columns[0], pa.int64()), "batch": pa.array([batch] * len(rows), pa.int64()), "kind": pa.array(columns[1], pa.int32()), "names": pa.array(columns[2], pa.binary()), "counts": pa.array(columns[3], pa.binary())})


def size_codes(classes: np.ndarray) -> np.ndarray:
    """0 for a single class, 1 for a small node, and from 2 on the size of a large one in steps of 2 ** 0.125."""
    steps = np.floor(8 * np.log2(np.maximum(classes / SMALL_BUCKET, 1)))
    return np.where(classes > SMALL_BUCKET, np.minimum(2 + steps, 255), classes > 1).astype(np.uint8)


def _answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """For every node asked for how large it is over all batches. Notes go back as they are."""
    table = table.combine_chunks()
    kinds, rows = table.column("kind").to_numpy(), table.column("counts").to_pylist()
    asking = np.flatnonzero(kinds >= 0)
    if len(asking):
        raw = table.column("names").to_pylist()
        names = [np.frombuffer(raw[r], np.uint64) for r in asking]
        _, back = np.unique(np.concatenate(names), return_inverse=True)
        counts = np.concatenate([np.frombuffer(rows[r], np.int32) for r in asking])
        total = size_codes(np.bincount(back, weights=counts))[back]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        for r, a, b in zip(asking, edges[:-1], edges[1:]):
            rows[r] = total[a:b].tobytes()
    yield pa.record_batch([table.column("batch").combine_chunks(), table.column("kind").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(rows, pa.binary())], names=["batch", "kind", "bucket", "sizes"])


def _deal(classes: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Rows for the small nodes; of a node that stays whole its smallest id alone, and edges from that id to the
    batch's others."""
    empty = pa.table({"bucket": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "ids": pa.array([], pa.binary()), "sketches": pa.array([], pa.binary())})
    if not classes.num_rows:
        return empty
    paths = Paths(classes, answers, buckets, LEVELS)
    ids, sketches = paths.ids, (mix64(paths.hashes) & np.uint64(255)).astype(np.uint8)
    made: dict[str, list] = {name: [] for name in empty.column_names}
    rows, keys = (np.concatenate(x) for x in zip(*paths.small))
    order, of, parts = _by_bucket(keys, buckets)
    for a, b in parts:
        at = rows[order[a:b]]
        for name, value in zip(made, (int(of[a]), 1, keys[order[a:b]].tobytes(), ids[at].tobytes(), sketches[at].tobytes())):
            made[name].append(value)
    rows, keys = (np.concatenate(x) for x in zip(*paths.whole))
    if len(rows):
        own = ids[rows]
        by = np.lexsort((own, keys))
        keys, own = keys[by], own[by]
        new = np.ones(len(by), bool)
        new[1:] = keys[1:] != keys[:-1]
        heads = own[np.flatnonzero(new)][np.cumsum(new) - 1]
        local = np.unique(np.stack([heads[~new], own[~new]], axis=1), axis=0)
        keys, own = keys[new], own[new]
        order, of, parts = _by_bucket(keys, buckets)
        for a, b in parts:
            for name, value in zip(made, (int(of[a]), 2, keys[order[a:b]].tobytes(), own[order[a:b]].tobytes(), b"")):
                made[name].append(value)
        if len(local):
            for name, value in zip(made, (int(ids.min()) % buckets, 3, b"", local.tobytes(), b"")):
                made[name].append(value)
    return pa.table({name: pa.array(values, empty.schema.field(name).type) for name, values in made.items()})


class Forest:
    """Union-find that keeps the smallest id as root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = self.parent[min(a, b)] = min(a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(self.root(x), x) for x in list(self.parent)]
        flat = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
        return flat[:, 0], flat[:, 1]


def _compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Edges that span the candidates of all path buckets in one dealt bucket."""
    forest = Forest()
    kinds = table.column("kind").to_pylist()
    cols = {name: table.column(name).to_pylist() for name in ("keys", "ids", "sketches")}
    gather = lambda kind, name, dtype: np.frombuffer(b"".join(x for x, k in zip(cols[name], kinds) if k == kind), dtype)
    for kind in (1, 2):
        keys, ids = gather(kind, "keys", np.uint64), gather(kind, "ids", np.int64)
        sketches = gather(kind, "sketches", np.uint8).reshape(-1, SKETCH)
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a < 2:
                continue
            if kind == 2:
                for i in ids[a + 1 : b].tolist():
                    forest.join(int(ids[a]), i)
                continue
            own = sketches[order[a:b]]
            for i in range(b - a - 1):
                near = np.flatnonzero((own[i + 1 :] == own[i]).sum(axis=1) >= SKETCH_SHARE * SKETCH)
                for j in near.tolist():
                    forest.join(int(ids[a + i]), int(ids[a + i + 1 + j]))
    for a, b in gather(3, "ids", np.int64).reshape(-1, 2).tolist():
        forest.join(a, b)
    a, b = forest.edges()
    if len(a):
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets; of a list with itself, without the diagonal."""
    out = np.zeros((len(left), len(right)), np.int64)
    if len(left) * len(right) <= 64:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                out[i, j] = len(np.intersect1d(x, y, assume_unique=True))
        return out
    l_flat, r_flat = np.concatenate(left), np.concatenate(right)
    if left is right:  # the diagonal is not asked for, so a shingle of one set alone adds nothing
        names, counts = np.unique(l_flat, return_counts=True)
        names = names[counts > 1]
    else:
        names = np.intersect1d(l_flat, r_flat)
    l_row, r_row = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    l_at, r_at = np.searchsorted(names, l_flat), np.searchsorted(names, r_flat)
    l_ok, r_ok = (names[np.minimum(at, len(names) - 1)] == flat if len(names) else np.zeros(len(flat), bool) for at, flat in ((l_at, l_flat), (r_at, r_flat)))
    l_row, l_at, r_row, r_at = l_row[l_ok], l_at[l_ok], r_row[r_ok], r_at[r_ok]
    l_order, r_order = np.argsort(l_at, kind="stable"), np.argsort(r_at, kind="stable")
    l_row, l_at, r_row, r_at = l_row[l_order], l_at[l_order], r_row[r_order], r_at[r_order]
    step = 4096
    total = np.zeros(out.shape, np.float32)
    for c in range(0, len(names), step):
        la, lb = np.searchsorted(l_at, (c, c + step))
        ra, rb = np.searchsorted(r_at, (c, c + step))
        wide = min(step, len(names) - c)
        x, y = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        x[l_row[la:lb], l_at[la:lb] - c] = 1
        y[r_row[ra:rb], r_at[ra:rb] - c] = 1
        total += x @ y.T
    return np.rint(total).astype(np.int64)


def _verify(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Exact links between two blocks of a cluster (or inside one): for each class its links, counted by
    documents, and the smallest class that it hangs together with here."""
    expected, ids_all, copies_all = (table.column(c).to_numpy() for c in ("fp1", "id", "copies"))
    own_block, one, two = (table.column(c).to_numpy() for c in ("block", "i", "j"))
    sets: list[np.ndarray] = []
    for _, _, data, borders in text_chunks(table.column("_text")):
        sets += shingle_sets(data, borders)
    seen, rows = set(), []
    for r, (i, f) in enumerate(zip(ids_all.tolist(), fingerprint(sets)[0].tolist())):
        if f == expected[r] and i not in seen:  # rows that repeat an id count once here
            seen.add(i)
            rows.append(r)
    i, j = int(one[0]), int(two[0])
    left = [r for r in rows if own_block[r] == i]
    right = left if i == j else [r for r in rows if own_block[r] == j]
    links = np.zeros(len(expected), np.int64)
    forest = Forest()
    if left and right:
        l_sets = [sets[r] for r in left]
        over = _overlaps(l_sets, l_sets if i == j else [sets[r] for r in right])
        size_l, size_r = np.array([len(sets[r]) for r in left]), np.array([len(sets[r]) for r in right])
        linked = over * DENOMINATOR >= NUMERATOR * (size_l[:, None] + size_r[None, :] - over)
        if i == j:
            np.fill_diagonal(linked, False)
        left_at, right_at = np.array(left), np.array(right)
        links[left_at] = linked @ copies_all[right_at]
        if i != j:
            links[right_at] = copies_all[left_at] @ linked
        _spread(forest, linked, ids_all[left_at], ids_all[right_at])
    root = np.array([forest.root(int(ids_all[r])) for r in rows], np.int64)
    yield pa.record_batch([pa.array(ids_all[rows]), pa.array(links[rows]), pa.array(root), pa.array(np.full(len(rows), bool(table.column("whole")[0].as_py())))], names=["id", "links", "root", "whole"])


def _spread(forest: Forest, linked: np.ndarray, l_ids: np.ndarray, r_ids: np.ndarray) -> None:
    """Join what the matrix links, visiting every node once."""
    open_l, open_r = np.ones(len(l_ids), bool), np.ones(len(r_ids), bool)
    for start in range(len(l_ids)):
        if not open_l[start] or not linked[start].any():
            continue
        open_l[start] = False
        new_l = [start]
        while new_l:
            reached = np.flatnonzero(linked[new_l].any(axis=0) & open_r)
            open_r[reached] = False
            for x in r_ids[reached].tolist():
                forest.join(int(l_ids[start]), x)
            new_l = np.flatnonzero(linked[:, reached].any(axis=1) & open_l).tolist() if len(reached) else []
            open_l[new_l] = False
            for x in l_ids[new_l].tolist():
                forest.join(int(l_ids[start]), x)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: (id, class_id, copy_id, n_links).

    ``copy_id`` is the smallest id with the same set of five-word shingles, ``n_links`` the number of other
    documents (copies included) whose sets have a Jaccard similarity of 0.8 or more, and ``class_id`` the smallest
    id that such links lead to. A text of one to four words is a single shingle. Texts that are null or without
    words have no links. Rows without an id take no part and have no class. Repeated rows are copies of each
    other; an id should not stand for two texts. Other columns are not read.
    """
    docs = pick(docs, id_col, text_col)
    described = cut(_describe(docs, id_col, text_col))
    shape = Window.partitionBy("fp1", "fp2")
    packed = described.groupBy("fp1", "fp2", F.pmod(F.xxhash64("id"), F.lit(MEMBER_SALTS)).alias("salt")).agg(F.collect_list("id").alias("ids"), F.min("id").alias("least"), F.count("*").alias("held"), F.min("n").alias("n"))
    members = cut(packed.withColumn("rep", F.min("least").over(shape)).withColumn("copies", F.sum("held").over(shape)).select("fp1", "rep", "copies", "n", "ids", "least"))
    heads = members.filter("least = rep").select("rep", "fp1", "copies", "n").distinct()

    classes = described.select("id", F.col("fp1").alias("_f"), "hashes").join(heads, (F.col("id") == F.col("rep")) & (F.col("_f") == F.col("fp1"))).dropDuplicates(["id"])
    count = heads.count()
    batches = max(1, math.ceil(count / BATCH_ROWS))
    partitions = min(MOST_PARTITIONS, max(1, math.ceil(batches / PARTITION_BATCHES)))
    buckets = max(12, partitions)
    # Cut before they are dealt, so that all levels share one shuffle of a plain scan.
    dealt = cut(classes.select("id", "hashes", F.pmod(F.xxhash64("id"), F.lit(batches)).alias("batch"))).repartition(partitions, "batch")

    def asked(level: int, answers: DataFrame | None) -> DataFrame:
        if answers is None:
            return dealt.sortWithinPartitions("batch").mapInArrow(lambda batches: (b for t in grouped(batches, "batch") for b in _ask(t, None, buckets, level).to_batches()), ASKED)
        return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda c, a: _ask(c, a, buckets, level), ASKED)

    answers = None
    for level in range(LEVELS):
        answers = map_groups(asked(level, answers), "bucket", _answer, ANSWERED)
    rows = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda c, a: _deal(c, a, buckets), "bucket bigint, kind int, keys binary, ids binary, sketches binary")
    candidates = map_groups(rows, "bucket", _compare, "a bigint, b bigint")

    sized = components(candidates).join(heads.select(F.col("rep").alias("node"), "n"), "node")
    step = F.least(F.lit(BLOCK_ROWS), F.ceil(F.col("size") / CLUSTER_BLOCKS)).cast("int")
    steps = sized.groupBy("component").agg(F.count("*").alias("size")).select(F.col("component").alias("_group"), F.when(F.col("size") <= WHOLE_ROWS, F.col("size").cast("int")).otherwise(step).alias("step"))
    numbered = positions(cut(sized), "component", [F.col("n"), F.col("node")], facts=steps)
    blocked = cut(numbered.select("node", "component", "n", F.floor((F.col("position") - 1) / F.col("step")).cast("int").alias("block")))
    # Classes stand by set size, so the blocks that one can hold links to lie side by side.
    spans = blocked.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    every = spans.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("block", "low", "high"))).alias("all"))
    before = F.size(F.filter("all", lambda x: x["high"] * DENOMINATOR < F.col("low") * NUMERATOR))
    after = F.size(F.filter("all", lambda x: x["low"] * NUMERATOR <= F.col("high") * DENOMINATOR)) - 1
    near = spans.join(every, "component").select(F.col("component").alias("_c"), F.col("block").alias("_b"), before.alias("first"), after.alias("last"), (F.size("all") == 1).alias("whole"))
    placed = blocked.join(near, (F.col("component") == F.col("_c")) & (F.col("block") == F.col("_b"))).join(heads.drop("n"), F.col("node") == F.col("rep"))
    placed = cut(placed.select(F.col("node").alias("id"), "component", "block", "first", "last", "whole", "fp1", "copies"))
    # Only texts of clusters are dealt: a broadcast of at most SPOTS hashes of their ids lets most others fall before that.
    spot = F.pmod(F.xxhash64("id"), F.lit(SPOTS))
    named = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("_text"))
    near_ones = named.join(F.broadcast(placed.select(spot.alias("_spot")).distinct()), spot == F.col("_spot"), "left_semi")
    texts = near_ones.join(placed, "id")
    paired = texts.withColumn("other", F.explode(F.sequence("first", "last")))
    paired = paired.select("id", "_text", "component", "fp1", "copies", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "whole")
    paired = paired.withColumn("key", F.xxhash64("component", "i", "j"))
    verified = cut(map_groups(paired, "key", _each_cluster, "id bigint, links bigint, root bigint, whole boolean"))

    parts = components(verified.filter("not whole and id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")))
    summed = verified.groupBy("id").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.first("whole").alias("whole"))
    summed = summed.join(parts, F.col("id") == F.col("node"), "left").select(F.col("id").alias("_id"), "links", F.when(F.col("whole"), F.col("root")).otherwise(F.coalesce("component", "id")).alias("class"))

    found = members.join(summed, F.col("rep") == F.col("_id"), "left")
    found = found.select(F.explode("ids").alias("id"), F.coalesce("class", "rep").alias("class_id"), F.col("rep").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    kind = docs.schema[id_col].dataType
    wordless = docs.filter(F.col(id_col).isNull() | F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    rest = wordless.select(F.col(id_col).cast("bigint").alias("id")).select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(0).cast("bigint").alias("n_links"))
    whole = found.unionByName(rest)
    return whole.select(F.col("id").cast(kind).alias(id_col), F.col("class_id").cast(kind).alias("class_id"), F.col("copy_id").cast(kind).alias("copy_id"), "n_links")


def _each_cluster(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Block pairs whose keys happen to be equal are told apart again."""
    parts = list(zip(*(table.column(c).to_pylist() for c in ("component", "i", "j"))))
    distinct = set(parts)
    if len(distinct) == 1:
        yield from _verify(table)
        return
    for part in sorted(distinct):
        yield from _verify(table.filter(pa.array([p == part for p in parts])))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nameless: bool = False) -> DataFrame:
    """One row of each class of near copies, and all rows without words.

    The row with the smallest id stays, of repeated ids just one row. Rows without an id stay, unless ``nameless``
    lets them join classes as well; there they stand behind the rows with an id. Every row counts for itself by a
    generated key, so an id that stands for two texts loses neither.
    """
    plain, at = shield(docs)
    keyed = cut(plain.withColumn("_key", F.monotonically_increasing_id()))
    own = keyed if nameless else keyed.filter(F.col(at[id_col]).isNotNull())
    found = cut(near_duplicates(own.select("_key", F.col(at[text_col]).alias("_t")), "_key", "_t").select("_key", "class_id"))
    ids = own.select(F.col("_key").alias("_k"), F.col(at[id_col]).alias("_id"))
    ranked = found.join(ids, F.col("_key") == F.col("_k"))
    first = ranked.groupBy("class_id").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_key")).alias("best"))
    drop = found.join(first.select(F.col("best._key").alias("_first")), F.col("_key") == F.col("_first"), "left_anti").select(F.col("_key").alias("_drop"))
    return keyed.join(drop, F.col("_key") == F.col("_drop"), "left_anti").select(*plain.columns).toDF(*docs.columns)
