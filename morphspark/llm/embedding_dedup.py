"""Embedding near-dedup by a forest of random-projection trees.

Each tree splits its points at the median of a random projection, again and
again, and hands those near the split to both sides. The tops of the trees are
fitted on samples of bounded size, node by node, until no node holds more than
one task compares; what is broadcast is three numbers a node. With the tops
known every point finds its nodes in one pass, so vectors are shuffled once a
tree. Within its task a node is split further down to leaves; all pairs within
a leaf are compared by their exact cosine similarity; pairs at the threshold or
above are united. Equal vectors are represented by one. Each level parts some
pairs, so the number of trees grows with the depth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._scratch import Scratch

TREES = 8  # at least
#: Share of pairs at the threshold that a level keeps together where vectors are crowded: a cluster whose members have a cosine of 0.8 (simulated: 0.873). RECALL: of such pairs, by all trees.
KEPT, RECALL = 0.87, 0.95
SPILL = 0.05
LEAF = 512
NODE = 20_000
THRESHOLD = 0.95
#: Points that fit a node's top, and the fewest that a split is taken from.
MOST_SAMPLE, LEAST_SAMPLE = 16_384, 128
#: Numbers of all splits that are broadcast at once; with more, the trees are grown in turns.
MOST_SPLITS = 16_000_000
BLOCK = 8192


def trees_for(n: int, leaf: int, spill: float) -> int:
    """Trees that find RECALL of the pairs where each level of the depth that n points need keeps KEPT of them."""
    levels = max(0.0, math.log(max(1, n) / leaf) / -math.log(0.5 + spill))
    return max(TREES, math.ceil(math.log(1 - RECALL) / math.log1p(-(KEPT**levels)))) if levels else TREES


def direction(tree: int, node: int, dim: int) -> np.ndarray:
    """The node's projection, the same wherever it is computed."""
    v = np.random.default_rng([77, tree, node % 2**63]).standard_normal(dim)
    return v / np.linalg.norm(v)


def split(p: np.ndarray, spill: float) -> tuple[float, float, float] | None:
    """(low, middle, high) of projections: up to high goes left, from low on right. None if that gains nothing."""
    n = len(p)
    at = [min(n - 1, int(n * q)) for q in (0.5 - spill, 0.5, 0.5 + spill)]
    part = np.partition(p, at)
    lo, mid, hi = (float(part[k]) for k in at)
    return None if max((p <= hi).sum(), (p >= lo).sum()) >= 0.9 * n else (lo, mid, hi)


def leaves(x: np.ndarray, tree: int, node: int, leaf: int, spill: float):
    """Index arrays of the leaves below a node. Points that no projection tells apart stay together."""
    todo = [(node, np.arange(len(x)))]
    while todo:
        at, idx = todo.pop()
        if len(idx) <= leaf:
            yield idx
            continue
        p = x[idx] @ direction(tree, at, x.shape[1])
        cut = split(p, spill)
        if cut is None:
            yield idx
            continue
        todo += [(2 * at, idx[p <= cut[2]]), (2 * at + 1, idx[p >= cut[0]])]


def top(x: np.ndarray, tree: int, node: int, share: float, most: int, spill: float) -> list[tuple[int, float, float]]:
    """(node, low, high) of the splits below a node, from a sample that holds that share of its points, down to nodes of at most `most` points."""
    out, todo = [], [(node, np.arange(len(x)))]
    while todo:
        at, idx = todo.pop()
        if len(idx) <= most * share or len(idx) < LEAST_SAMPLE:
            continue
        p = x[idx] @ direction(tree, at, x.shape[1])
        if cut := split(p, spill):
            out.append((at, cut[0], cut[2]))
            todo += [(2 * at, idx[p <= cut[2]]), (2 * at + 1, idx[p >= cut[0]])]
    return out


class Tops:
    """The splits known so far: for (dimension, tree), sorted nodes with the ends of their overlap."""

    def __init__(self):
        self.of: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, dim: int, tree: int, nodes: list[int], low: list[float], high: list[float]) -> None:
        have = self.of.get((dim, tree), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
        every = [np.concatenate([a, np.asarray(b, a.dtype)]) for a, b in zip(have, (nodes, low, high))]
        order = np.argsort(every[0])
        self.of[dim, tree] = tuple(e[order] for e in every)

    def find(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) of the nodes without a split that the rows come to."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        got = self.of.get((x.shape[1], tree))
        if got is None:
            return row, node
        nodes, low, high = got
        rows, ends = [], []
        while len(row):
            k = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            inner = nodes[k] == node
            rows.append(row[~inner])
            ends.append(node[~inner])
            row, node, k = row[inner], node[inner], k[inner]
            if not len(row):
                break
            which, of = np.unique(node, return_inverse=True)
            p = np.empty(len(row))
            order = np.argsort(of, kind="stable")
            edge = np.searchsorted(of[order], np.arange(len(which) + 1))
            for j, w in enumerate(which):
                i = order[edge[j] : edge[j + 1]]
                p[i] = x[row[i]] @ direction(tree, int(w), x.shape[1])
            left, right = p <= high[k], p >= low[k]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return np.concatenate(rows), np.concatenate(ends)


def near_pairs(x: np.ndarray, idx: np.ndarray, threshold: float, block: int = 2048):
    """(a, b) of the pairs within the leaf, as indices, that reach the threshold, block by block."""
    for s in range(0, len(idx), block):
        rows = idx[s : s + block]
        for t in range(0, s + 1, block):
            cols = idx[t : t + block]
            a, b = np.nonzero(x[rows] @ x[cols].T >= threshold)
            keep = (a + s) > (b + t)
            yield rows[a[keep]], cols[b[keep]]


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives both ends of each pair, and all that hang on them, the least root; root is changed in place."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        low = np.minimum(ra[apart], rb[apart])
        np.minimum.at(root, ra[apart], low)
        np.minimum.at(root, rb[apart], low)
        while (root[root] != root).any():
            root[:] = root[root]


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, list) -> (id, vector of length one as bytes, dimension), without those that have none."""
    for batch in batches:
        v = batch.column(1)
        off = v.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        inner = v.values
        flat = inner.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
        if inner.null_count:
            flat = np.where(inner.is_null().to_numpy(zero_copy_only=False), np.float32("nan"), flat)
        n = np.diff(off)
        ok = (n > 0) & ~v.is_null().to_numpy(zero_copy_only=False)
        for dim in np.unique(n[ok]):
            at = np.flatnonzero(ok & (n == dim))
            for s in range(0, len(at), BLOCK):
                i = at[s : s + BLOCK]
                x = flat[off[i][:, None] + np.arange(dim)].astype(np.float64)
                with np.errstate(all="ignore"):
                    norm = np.sqrt((x * x).sum(1))
                good = np.isfinite(norm) & (norm > 0)
                x = (x[good] / norm[good, None]).astype(np.float32) + np.float32(0)  # no negative zeros
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i[good])), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.full(len(x), dim, np.int32))], ["id", "v", "dim"])


def _matrix(v: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a binary column, all of that dimension."""
    v = v.cast(pa.large_binary())
    off = np.frombuffer(v.buffers()[1], np.int64)[v.offset : v.offset + len(v) + 1]
    return np.frombuffer(v.buffers()[2], np.float32, (off[-1] - off[0]) // 4, off[0]).reshape(-1, dim) if len(v) else np.zeros((0, dim), np.float32)


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, trees: int | None = None, spill: float = SPILL, leaf: int = LEAF, node: int = NODE) -> DataFrame:
    """(vec_id, group_id, keep) of every vector that has a near duplicate.

    Two vectors are near duplicates if their cosine similarity reaches the
    threshold; groups are connected components, named by their least id, the
    one to keep. Ids are whole numbers. Null ids, null or empty vectors,
    vectors with a null or non-finite entry or of length zero are in no group;
    vectors of different dimension are never compared. Repeated rows of one id
    count once. An empty table gives an empty one. Vectors of one direction,
    however many, are compared as one. `trees` is taken from the largest number
    of vectors of one dimension unless given: 0.95 of the pairs at the
    threshold are found within clusters of cosine 0.8, more where vectors are
    spread, fewer in tighter clusters.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = F.col(f"`{vector_col}`").cast("array<float>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = scratch.table(rows.mapInArrow(_clean, "id long, v binary, dim int"))
    # The least id stands for equal vectors; two hashes make 128 bits.
    slim = rows.select("id", F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(7)).alias("g"))
    twins = slim.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").drop("last")
    copies = scratch.table(slim.join(twins, ["h", "g"]).where("id <> first").distinct())
    ones = rows if copies.isEmpty() else rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64("v", F.lit(7))).join(copies.select("id", "h", "g"), ["id", "h", "g"], "left_anti")
    count = {r.dim: r["count"] for r in ones.groupBy("dim").count().where(F.col("count") > 1).collect()}  # dimensions, not vectors
    n = max(count.values(), default=0)
    if trees is None:
        trees = trees_for(n, leaf, spill)
    each = max(1.0, 6 * sum(count.values()) / node)  # numbers of a tree's splits, about
    turn = max(1, min(trees, int(MOST_SPLITS / each)))

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        dim, tree, at = (t.column(c)[0].as_py() for c in ("dim", "tree", "node"))
        ids = t.column("id").to_numpy()
        x = _matrix(t.column("v").combine_chunks(), dim)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        root = np.arange(len(ids))
        for idx in leaves(x, tree, at, leaf, spill):
            for a, b in near_pairs(x, idx, threshold):
                unite(root, a, b)
        i = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": ids[i], "b": ids[root[i]]})

    def to_nodes(held, first: int, last: int, what: str, picks: dict | None = None):
        """Each vector with its nodes in trees first to last: their sizes, a sample of those to be split, or all."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tally: dict[tuple[int, int, int], int] = {}
            for batch in batches:
                dims = batch.column(2).to_numpy(zero_copy_only=False)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    for s in range(0, len(at), BLOCK):
                        part = batch.take(pa.array(at[s : s + BLOCK]))
                        x = _matrix(part.column(1), int(dim))
                        for tree in range(first, last):
                            row, end = held.value.find(x, tree)
                            if what == "sizes":
                                for k, m in zip(*(u.tolist() for u in np.unique(end, return_counts=True))):
                                    tally[int(dim), tree, k] = tally.get((int(dim), tree, k), 0) + m
                                continue
                            if what == "sample":
                                draw = part.column(3).to_numpy(zero_copy_only=False)[row]
                                keys, of = np.unique(end, return_inverse=True)
                                rate = np.array([picks.get((int(dim), tree, int(k)), -1.0) for k in keys])[of]
                                some = draw < rate
                                row, end = row[some], end[some]
                            take = pa.array(row)
                            if len(row):
                                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(np.full(len(row), dim, np.int32)), pa.array(np.full(len(row), tree, np.int32)), pa.array(end)], ["id", "v", "dim", "tree", "node"])
            if what == "sizes" and tally:
                keys = np.array(list(tally), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].astype(np.int32)), pa.array(keys[:, 1].astype(np.int32)), pa.array(keys[:, 2]), pa.array(list(tally.values()), pa.int64())], ["dim", "tree", "node", "n"])

        return run

    def fitter(rate: dict):
        def fit(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            dim, tree, at = (t.column(c)[0].as_py() for c in ("dim", "tree", "node"))
            got = top(_matrix(t.column("v").combine_chunks(), dim), tree, at, rate[dim, tree, at], node, spill)
            lists = [pa.array([[g[k] for g in got]], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.float64(), pa.float64()))]
            return pa.Table.from_arrays([t.column("dim")[:1], t.column("tree")[:1], t.column("node")[:1], *lists], ["dim", "tree", "node", "nodes", "low", "high"])

        return fit

    draw = (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / (1 << 30)).alias("draw")
    input_ = ones.where(F.col("dim").isin(list(count))).select("id", "v", "dim", draw) if len(count) < 1000 else ones.select("id", "v", "dim", draw)
    found = []
    for first in range(0, trees, turn):
        last = min(first + turn, trees)
        tops, held = Tops(), None
        big = {(d, t, 1): c for d, c in count.items() for t in range(first, last) if c > node}
        stuck: set[tuple[int, int, int]] = set()
        while big:
            rate = {k: min(1.0, min(MOST_SAMPLE, max(2048, LEAST_SAMPLE * 2 * c // node)) / c) for k, c in big.items()}
            held = spark.sparkContext.broadcast(tops)
            picked = input_.mapInArrow(to_nodes(held, first, last, "sample", rate), "id long, v binary, dim int, tree int, node long")

            fitted = picked.groupBy("dim", "tree", "node").applyInArrow(fitter(rate), "dim int, tree int, node long, nodes array<long>, low array<double>, high array<double>").collect()  # three numbers a node
            more = False
            for r in fitted:
                if r.nodes:
                    tops.add(r.dim, r.tree, r.nodes, r.low, r.high)
                    more = True
                else:
                    stuck.add((r.dim, r.tree, r.node))
            held.unpersist()
            if not more:
                break
            held = spark.sparkContext.broadcast(tops)
            size = input_.mapInArrow(to_nodes(held, first, last, "sizes"), "dim int, tree int, node long, n long").groupBy("dim", "tree", "node").agg(F.sum("n").alias("n"))
            big = {(r.dim, r.tree, r.node): r.n for r in size.where(F.col("n") > 3 * node).collect()}  # samples err; a task takes thrice a node
            big = {k: c for k, c in big.items() if k not in stuck}
            held.unpersist()
        held = spark.sparkContext.broadcast(tops)
        state = input_.mapInArrow(to_nodes(held, first, last, "all"), "id long, v binary, dim int, tree int, node long")
        found.append(scratch.table(state.groupBy("dim", "tree", "node").applyInArrow(compare, "a long, b long").where("a <> b").distinct()))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    root = components(pairs, scratch)
    # Copies take the root of the one that stands for them.
    lot = copies.join(root.toDF("first", "root"), "first", "left").select("id", F.coalesce("root", "first").alias("root"))
    heads = copies.select(F.col("first").alias("id")).distinct().join(root.select("id"), "id", "left_anti").select("id", F.col("id").alias("root"))
    out = root.union(lot).union(heads).groupBy("id").agg(F.min("root").alias("root"))
    return out.select(F.col("id").alias("vec_id"), F.col("root").alias("group_id"), (F.col("id") == F.col("root")).alias("keep"))
