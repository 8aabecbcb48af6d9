"""Suffix-tree operators on interval rows: a node is a closed range of ranks with the depth of its string.

Inner nodes are the LCP intervals, leaves single ranks. All links are computed per text from neighbours and range minima:
the parent is the interval at the deeper border, a child starts at a border of its parent's depth, and the
suffix link of an inner node is the interval at the minimum between the Psi images of its borders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringloom.operators import kernels
from stringloom.operators.index import answers, text_batches

NODE = "sp bigint, ep bigint, depth bigint, left_lcp bigint, right_lcp bigint, leaf boolean, parent_sp bigint, parent_ep bigint, parent_depth bigint, child_no bigint, edge_ch string, link_sp bigint, link_ep bigint, pos bigint"
_NAMES = [x.split()[0] for x in NODE.split(", ")]


def tree_arrays(order: kernels.SuffixOrder, a: int, b: int, wanted: frozenset[str] = frozenset(_NAMES)) -> dict[str, np.ndarray]:
    """All nodes of one text in preorder. Places that don't exist are -1; the root's parent is the root itself. Links and
    children are only worked out where a wanted column asks for them."""
    sa, isa, lcp, n = order.sa[a:b], order.isa[a:b], order.lcp[a:b], b - a
    bounds = np.array([0, n])
    psv, psev, nsv = kernels.previous_smaller(lcp, bounds), kernels.previous_smaller(lcp, bounds, True), kernels.next_smaller(lcp, bounds)
    low, high = np.maximum(psv, 0), np.where(nsv < 0, n, nsv) - 1
    # Rank 0 has no predecessor, so no interval of its own; a value's interval counts once, at its first border.
    first = (psev < 1) | (lcp[np.maximum(psev, 0)] < lcp)
    first[0] = False
    inner = np.flatnonzero(first)
    if n == 1:
        inner = np.zeros(0, np.int64)
    sp, ep = np.concatenate([low[inner], np.arange(n)]), np.concatenate([high[inner], np.arange(n)])
    depth = np.concatenate([lcp[inner], n - 1 - sa])
    leaf = np.concatenate([np.zeros(len(inner), bool), np.ones(n, bool)])
    if wanted <= {"sp", "ep", "depth", "leaf", "pos"}:
        order_of = np.lexsort((-ep, sp))
        out = {"sp": sp, "ep": ep, "depth": depth, "leaf": leaf, "pos": sa[sp]}
        return {k: v[order_of] for k, v in out.items()} | {"child_no": np.ones(len(sp), np.int64)}
    padded = np.append(lcp, 0)
    left, right = padded[sp], padded[ep + 1]
    border = np.where(left >= right, sp, np.minimum(ep + 1, n - 1))  # the deeper border lies inside the parent
    root = (sp == 0) & (ep == n - 1)
    parent_sp, parent_ep = np.where(root, 0, low[border]), np.where(root, n - 1, high[border])
    at_left_edge = (sp == 0) & ~root
    if at_left_edge.any():  # no suffix before: only the right border counts
        x = ep[at_left_edge] + 1
        parent_sp[at_left_edge], parent_ep[at_left_edge] = low[x], high[x]
    parent_depth = np.where(root, 0, np.where(sp == 0, right, np.maximum(left, right)))
    link_sp, link_ep = np.full(len(sp), -1, np.int64), np.full(len(sp), -1, np.int64)
    if wanted & {"link_sp", "link_ep"}:
        psi = isa[(sa + 1) % n]
        deep = leaf & (depth > 0)
        link_sp[deep] = link_ep[deep] = psi[sp[deep]]
        inside = np.flatnonzero(~leaf & (depth > 0))
        x, y = psi[sp[inside]], psi[ep[inside]]
        at = kernels.RangeMinimum(lcp).places(np.minimum(x, y) + 1, np.maximum(x, y))
        link_sp[inside], link_ep[inside] = low[at], high[at]
    order_of = np.lexsort((-ep, sp))
    out = {"sp": sp, "ep": ep, "depth": depth, "left_lcp": left, "right_lcp": right, "leaf": leaf, "parent_sp": parent_sp, "parent_ep": parent_ep, "parent_depth": parent_depth, "link_sp": link_sp, "link_ep": link_ep, "pos": sa[sp]}
    out = {k: v[order_of] for k, v in out.items()}
    siblings = np.lexsort((out["sp"], out["parent_ep"], out["parent_sp"]))
    siblings = siblings[~((out["sp"] == 0) & (out["ep"] == n - 1))[siblings]]
    keys = out["parent_sp"][siblings] * (n + 1) + out["parent_ep"][siblings]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    number = np.arange(len(keys)) - np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) + 1 if len(keys) else keys
    child = np.zeros(len(sp), np.int64)
    child[siblings] = number
    symbol = np.zeros(len(sp), np.int64)
    place = sa[out["sp"]] + out["parent_depth"]
    symbol[siblings] = order.symbols[a + np.minimum(place[siblings], n - 1)]
    return out | {"child_no": child, "edge": symbol}


def tree_nodes(texts: DataFrame, id_col: str = "text_id", text_col: str = "text", columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each node of each text's suffix tree, without a shuffle: (id, *columns), by default all of ``NODE``.

    ``child_no`` counts from 1 among the siblings by range; the root has parent null, child_no null and no edge character;
    ``edge_ch`` is the first character of the edge from the parent, '' for the end marker; the suffix link of the
    root and of the empty suffix is null (the root); ``pos`` is the first suffix's place in the text. The empty text has one
    node, a leaf. Only the columns asked for are worked out and cross to Spark.
    """
    kind = texts.schema[id_col].dataType.simpleString()
    names = [c for c in _NAMES if columns is None or c in columns]
    wanted = frozenset(names)

    def column(name: str, flat: dict[str, np.ndarray], root: np.ndarray) -> pa.Array:
        if name == "edge_ch":
            distinct, back = np.unique(flat["edge"], return_inverse=True)
            return pa.array([chr(int(c) - 1) if c else "" for c in distinct], pa.string()).take(pa.array(back, mask=root))
        return pa.array(flat[name], mask=root if name in ("parent_sp", "parent_ep", "parent_depth", "child_no") else flat[name] < 0 if name in ("link_sp", "link_ep") else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, held in text_batches(batch):
                order = kernels.suffix_order(held)
                parts = [tree_arrays(order, a, b, wanted) for a, b in zip(order.bounds[:-1], order.bounds[1:])]
                flat = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
                ids = batch.column(0).take(pa.array(np.repeat(rows, [len(p["sp"]) for p in parts])))
                yield pa.record_batch([ids, *(column(c, flat, flat["child_no"] == 0) for c in names)], names=[id_col, *names])

    kinds = dict(x.split() for x in NODE.split(", "))
    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} {kinds[c]}" for c in names))


def walk(nodes: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, visit, sp, ep, depth): the nodes in the order in which a depth-first walk first meets them, from 0."""
    own = Window.partitionBy(id_col).orderBy("sp", F.desc("ep"))
    return nodes.select(id_col, (F.row_number().over(own) - 1).cast("bigint").alias("visit"), "sp", "ep", "depth")


def intervals(nodes: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, sp, ep, depth) of the inner nodes."""
    return nodes.filter(~F.col("leaf")).select(id_col, "sp", "ep", "depth")


def parents(nodes: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, sp, ep, parent_sp, parent_ep, parent_depth); the root is its own parent."""
    return nodes.select(id_col, "sp", "ep", F.coalesce("parent_sp", "sp").alias("parent_sp"), F.coalesce("parent_ep", "ep").alias("parent_ep"), F.coalesce("parent_depth", F.lit(0)).alias("parent_depth"))


def children(nodes: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, parent_sp, parent_ep, child_no, edge_ch, sp, ep, depth) of all nodes but roots."""
    return nodes.filter(F.col("child_no").isNotNull()).select(id_col, "parent_sp", "parent_ep", "child_no", "edge_ch", "sp", "ep", "depth")


def select_child(nodes: DataFrame, i: int, id_col: str = "text_id") -> DataFrame:
    """(id, sp, ep, child_sp, child_ep): every inner node's i-th child from 1, or null; 1 gives the first child."""
    own = nodes.filter(~F.col("leaf")).select(id_col, "sp", "ep")
    found = children(nodes, id_col).filter(F.col("child_no") == i).select(F.col(id_col).alias("_id"), "parent_sp", "parent_ep", F.col("sp").alias("child_sp"), F.col("ep").alias("child_ep"))
    return own.join(found, (F.col(id_col) == F.col("_id")) & (F.col("sp") == F.col("parent_sp")) & (F.col("ep") == F.col("parent_ep")), "left").select(id_col, "sp", "ep", "child_sp", "child_ep")


def child_by_char(nodes: DataFrame, ch: str, id_col: str = "text_id") -> DataFrame:
    """(id, sp, ep, child_sp, child_ep): every inner node's child whose edge starts with ``ch``; no row without one."""
    found = children(nodes, id_col).filter(F.col("edge_ch") == ch)
    return found.select(id_col, F.col("parent_sp").alias("sp"), F.col("parent_ep").alias("ep"), F.col("sp").alias("child_sp"), F.col("ep").alias("child_ep"))


def siblings(nodes: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, sp, ep, sibling_sp, sibling_ep): the next child of the same parent, or null."""
    own = Window.partitionBy(id_col, "parent_sp", "parent_ep").orderBy("child_no")
    return children(nodes, id_col).select(id_col, "sp", "ep", F.lead("sp").over(own).alias("sibling_sp"), F.lead("ep").over(own).alias("sibling_ep"))


def suffix_links(nodes: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, sp, ep, link_sp, link_ep) of all nodes with a string; the others link to the root and are left out."""
    return nodes.filter(F.col("link_sp").isNotNull()).select(id_col, "sp", "ep", "link_sp", "link_ep")


def leaves(nodes: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, rank, left_lcp, right_lcp, depth) of the leaves; past the last rank the border is 0."""
    return nodes.filter("leaf").select(id_col, F.col("sp").alias("rank"), "left_lcp", "right_lcp", "depth")


def counts(nodes: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, nodes, inner, leaves, deepest): what a traversal visits."""
    return nodes.groupBy(id_col).agg(F.count("*").alias("nodes"), F.count_if(~F.col("leaf")).alias("inner"), F.count_if("leaf").alias("leaves"), F.max(F.when(~F.col("leaf"), F.col("depth"))).alias("deepest"))


def _inner(order: kernels.SuffixOrder) -> np.ndarray:
    """Ranks at which an inner node of a text shows first: the first border of its interval. Counts over the whole chunk."""
    psev = kernels.previous_smaller(order.lcp, order.bounds, True)
    start = np.repeat(order.bounds[:-1], np.diff(order.bounds))
    first = (psev <= start) | (order.lcp[np.maximum(psev, 0)] < order.lcp)
    first[order.bounds[:-1]] = False
    return np.flatnonzero(first)


def intervals_of(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``intervals`` of the texts' nodes; leaves and links are not worked out."""

    def make(order: kernels.SuffixOrder) -> tuple:
        lengths = np.diff(order.bounds)
        at = _inner(order)
        of = np.searchsorted(order.bounds, at, "right") - 1
        low, high = kernels.previous_smaller(order.lcp, order.bounds)[at], kernels.next_smaller(order.lcp, order.bounds)[at]
        sp, ep = np.where(low < 0, 0, low - order.bounds[of]), np.where(high < 0, lengths[of], high - order.bounds[of]) - 1
        return of, sp, ep, order.lcp[at]

    return answers(texts, "sp bigint, ep bigint, depth bigint", make, with_lcp=True, id_col=id_col, text_col=text_col)


def counts_of(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``counts`` of the texts' nodes, a row for each text; no node leaves a task."""

    def make(order: kernels.SuffixOrder) -> tuple:
        leaves = np.diff(order.bounds)
        inner = np.bincount(np.searchsorted(order.bounds, _inner(order), "right") - 1, minlength=len(leaves))
        deepest = np.maximum.reduceat(order.lcp, order.bounds[:-1])
        return np.arange(len(leaves)), leaves + inner, inner, leaves, pa.array(deepest, mask=inner == 0)

    return answers(texts, "nodes bigint, inner bigint, leaves bigint, deepest bigint", make, with_lcp=True, id_col=id_col, text_col=text_col)


def walk_values(sp: np.ndarray, ep: np.ndarray) -> np.ndarray:
    """sp, ep of every visit of a depth-first walk over the nodes (sp, ep), inner ones on the way down and up. A node is met
    after the longer ones that start at its rank and left after all that end at its last, the shorter first."""
    inner = np.flatnonzero(sp < ep)
    n = int(ep.max(initial=0)) + 1
    at = np.concatenate([np.arange(len(sp)), inner])
    order, _ = kernels.sorted_places(np.concatenate([2 * sp, 2 * ep[inner] + 1]), n - np.concatenate([ep, sp[inner]]))
    at = at[order]
    return np.stack([sp[at], ep[at]], axis=1).ravel()


def digest_of(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``traversal_digest`` of the texts' nodes, a row for each text; no node leaves a task."""

    def make(order: kernels.SuffixOrder) -> tuple:
        at = _inner(order)
        low, high = kernels.previous_smaller(order.lcp, order.bounds), kernels.next_smaller(order.lcp, order.bounds)
        digests, cuts = [], np.searchsorted(at, order.bounds)
        for t, (a, b) in enumerate(zip(order.bounds[:-1], order.bounds[1:])):
            own = at[cuts[t] : cuts[t + 1]]
            leaves = np.arange(b - a)
            sp = np.concatenate([np.where(low[own] < 0, 0, low[own] - a), leaves])
            ep = np.concatenate([np.where(high[own] < 0, b, high[own]) - 1 - a, leaves])
            digests.append(str(kernels.fnv1a_array(walk_values(sp, ep))))
        return np.arange(len(digests)), pa.array(digests, pa.string())

    return answers(texts, "digest string", make, with_lcp=True, id_col=id_col, text_col=text_col)


def find_of(texts: DataFrame, patterns: Sequence[str], id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, pattern, sp, ep) of patterns found from the root of each text's suffix tree downwards, an edge at a time; no row for a
    pattern that does not occur. A child is the range of ranks with the edge's first character below its parent's
    depth and its depth the least common prefix within, so that only nodes on a pattern's way are worked out."""
    coded = [kernels.codes(p) + 1 for p in patterns]

    def down(symbols: np.ndarray, sa: np.ndarray, lcp: np.ndarray, p: np.ndarray) -> tuple[int, int] | None:
        n = len(sa)
        sp, ep, matched = 0, n - 1, 0
        while matched < len(p):
            if sp == ep and matched == n - 1 - sa[sp]:  # a leaf's string is over
                return None
            first = symbols[np.minimum(sa[sp : ep + 1] + matched, n - 1)]
            low, high = np.searchsorted(first, p[matched]), np.searchsorted(first, p[matched], "right")
            if low == high:
                return None
            sp, ep = sp + int(low), sp + int(high) - 1
            depth = int(lcp[sp + 1 : ep + 1].min()) if sp < ep else n - 1 - int(sa[sp])
            length = min(depth, len(p))
            edge = symbols[sa[sp] + matched : sa[sp] + length]
            if len(edge) < length - matched or (edge != p[matched:length]).any():
                return None
            matched = length
        return sp, ep

    def make(order: kernels.SuffixOrder) -> tuple:
        rows = []
        for t, (a, b) in enumerate(zip(order.bounds[:-1], order.bounds[1:])):
            own = order.symbols[a:b], order.sa[a:b], order.lcp[a:b]
            rows += [(t, i, *found) for i, p in enumerate(coded) if (found := down(*own, p)) is not None]
        of, which, sp, ep = np.array(rows, np.int64).reshape(-1, 4).T
        return of, pa.array(patterns, pa.string()).take(pa.array(which)), sp.copy(), ep.copy()

    return answers(texts, "pattern string, sp bigint, ep bigint", make, with_lcp=True, id_col=id_col, text_col=text_col)


def traversal_digest(nodes: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, digest): FNV-1a over (sp, ep) of every visit of a depth-first walk, inner nodes on the way down and up."""
    down = F.struct(F.col("sp").alias("k1"), F.lit(0).alias("k2"), (-F.col("ep")).alias("k3"), "sp", "ep")
    rows = F.array_sort(F.collect_list(down))
    held = nodes.groupBy(id_col).agg(F.transform(rows, lambda r: F.struct(r["sp"], r["ep"])).alias("walk"))
    kind = nodes.schema[id_col].dataType.simpleString()

    def visits(walk: list[dict]) -> Iterator[int]:
        open_: list[tuple[int, int]] = []
        for node in walk:
            sp, ep = node.values()
            while open_ and open_[-1][1] < sp:
                yield from open_.pop()
            yield from (sp, ep)
            if sp < ep:
                open_.append((sp, ep))
        while open_:
            yield from open_.pop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([str(kernels.fnv1a(list(visits(w)))) for w in batch.column(1).to_pylist()], pa.string())], names=[id_col, "digest"])

    return held.mapInArrow(run, f"`{id_col}` {kind}, digest string")
