"""MinHash near-dedup with tensored banding.

Two small collections of sub-keys, U of three minhashes each and V of two, are
computed for each document; a table's key is a pair from U x V. So 14 x 7 = 98
tables, which would take 490 minhashes one by one, come from 56. Documents
that share a key are candidates: in each bucket all are compared with the
least, and then the members of different components with each other, large
buckets in blocks. Comparison is by the exact Jaccard similarity of the sets of
shingles, so nothing but true pairs is united.

Of documents with one set of shingles only the least has keys. Within a batch
only the first document of a key carries it into the shuffle, the others are
paired with it at once: a key or a set that a third of all documents share
comes once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._scratch import Scratch, fresh
from ._text import chunks, lower_words, mix, ragged
from .exact_dedup import probe, probing, repeat_filter

SHINGLE = 2
THRESHOLD = 0.6
U, U_ROWS, V, V_ROWS = 14, 3, 7, 2
BLOCK = 4096

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, U * U_ROWS + V * V_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, len(_A), dtype=np.uint64)


def shingles(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit shingles of SHINGLE words, row offsets). A text of fewer words is one shingle; one of none has none."""
    h, _, _, rows = lower_words(b, offsets)
    n = np.diff(rows)
    if not len(h):
        return np.zeros(0, np.uint32), rows
    pair = mix(h[:-1] * np.uint64(3) + np.roll(h, -1)[:-1])
    last = rows[1:][n > 0] - 1
    keep = np.ones(len(h), bool)
    keep[last] = False
    single = rows[:-1][n == 1]
    keep[single] = True
    value = np.append(pair, np.uint64(0))
    value[single] = mix(h[single])
    size = np.where(n > 1, n - 1, n)
    return (value[keep] >> np.uint64(32)).astype(np.uint32), np.concatenate([[0], np.cumsum(size)])


def sub_keys(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(U keys, V keys) of each row that has shingles."""
    at = rows[:-1][np.diff(rows) > 0]
    wide = x.astype(np.uint64)
    low = np.empty((len(_A), len(at)), np.uint64)
    for k, (a, c) in enumerate(zip(_A, _B)):
        low[k] = np.minimum.reduceat(((wide * a + c) >> np.uint64(32)).astype(np.uint32), at)

    def join(part: np.ndarray, r: int) -> np.ndarray:
        key = np.zeros((len(part) // r, part.shape[1]), np.uint64)
        for k in range(r):
            key = mix(key * np.uint64(31) + part[k::r] + np.uint64(1))
        return key

    return join(low[: U * U_ROWS], U_ROWS), join(low[U * U_ROWS :], V_ROWS)


def _sets(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, and their numbers."""
    row = np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows))
    u = np.unique(row << np.uint64(32) | x.astype(np.uint64))
    return (u & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.bincount((u >> np.uint64(32)).astype(np.int64), minlength=len(rows) - 1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, whole: a hash of the set of shingles, twin: the batch's least id with that set if it is another, keys, shared, heads).

    shared are the keys that a document of a smaller id in the batch has too,
    heads the least of those; keys are the others. Twins have none.
    """
    for batch in batches:
        got = []
        for i, j, b, o in chunks(batch.column(1)):
            x, rows = shingles(b, o)
            has = np.flatnonzero(np.diff(rows))
            if not len(has):
                continue
            u, v = sub_keys(x, rows)
            keys = mix(u[:, None, :] * np.uint64(0x9E3779B97F4A7C15) + v[None, :, :] + (np.arange(U * V, dtype=np.uint64)).reshape(U, V, 1))
            s, n = _sets(x, rows)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s.astype(np.uint64) + np.uint64(0xABCD)))])
            end = np.cumsum(n)
            got.append((i + has, mix(total[end] - total[end - n])[has], keys.reshape(U * V, -1).T))
        if not got:
            continue
        at, whole, keys = (np.concatenate(c) for c in zip(*got))
        ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
        order = np.lexsort((ids, whole))
        ids, whole, keys = ids[order], whole[order], keys[order]
        first = np.concatenate([[True], whole[1:] != whole[:-1]])
        head = ids[np.flatnonzero(first)][np.cumsum(first) - 1]
        twin = ~first & (ids != head)
        own = np.flatnonzero(first)
        flat, of = keys[own].ravel(), np.repeat(own, U * V)
        order = np.lexsort((ids[of], flat))
        start = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
        least = np.empty(len(flat), np.int64)
        least[order] = ids[of[order[np.flatnonzero(start)]]][np.cumsum(start) - 1]
        extra = least != ids[of]
        count = lambda w: np.bincount(of[w], minlength=len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(whole.view(np.int64)), pa.array(head, mask=~twin), ragged(flat[~extra].view(np.int64), count(~extra), pa.int64()), ragged(flat[extra].view(np.int64), count(extra), pa.int64()), ragged(least[extra], count(extra), pa.int64())], ["id", "whole", "twin", "keys", "shared", "heads"])


def _wanted(bitmap, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.flatnonzero(probe(bitmap.value, bits, ids))
            if not len(at):
                continue
            batch = batch.take(pa.array(at))
            for i, j, b, o in chunks(batch.column(1)):
                s, n = _sets(*shingles(b, o))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ragged(s.view(np.int32), n, pa.int32())], ["id", "s"])

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, keep) of every document that has a near copy.

    Two documents are near copies if the Jaccard similarity of their sets of
    two-word shingles (runs of letters and digits, in small letters) is at
    least the threshold; groups are the connected components, named by their
    least id, which is the one to keep. A pair at 0.7 is found with a
    probability of 0.98, one at 0.6 with 0.92 by itself, more within a group.
    Ids are whole numbers. Null, empty and wordless texts and null ids are in
    no group. Several rows of one id count as one document: keys of all of them
    find candidates, which are compared by the least of their sets. A text of one word is one shingle. An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    text = docs.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    keyed = scratch.table(text.mapInArrow(_keys, "id long, whole long, twin long, keys array<long>, shared array<long>, heads array<long>"))
    # Documents with the same set of shingles are near copies as they are; the least stands for them.
    twins = scratch.table(keyed.where("twin is not null").select("id", F.col("twin").alias("first")))
    once = keyed.where("twin is null").select("id", "whole")
    least = once.groupBy("whole").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("whole", "first")
    firsts = scratch.table(once.join(least, "whole").where("id <> first").select("id", "first").distinct())
    alone = keyed.where("twin is null").join(firsts.select("id"), "id", "left_anti")
    by_key = Window.partitionBy("key")
    across = alone.select("id", F.explode("keys").alias("key")).withColumn("c", F.min("id").over(by_key)).withColumn("n", F.count("*").over(by_key)).where("n > 1").select("key", "id", "c")
    within = alone.where(F.size("shared") > 0).select("id", F.explode(F.arrays_zip("shared", "heads")).alias("x")).select(F.col("x.shared").alias("key"), "id", F.col("x.heads").alias("head"))
    within = within.join(firsts.toDF("head", "stands"), "head", "left").select("key", "id", F.coalesce("stands", "head").alias("c"))
    buckets = scratch.table(across.union(within))
    pairs = buckets.where("id <> c").select(F.greatest("id", "c").alias("a"), F.least("id", "c").alias("b")).distinct()
    members = buckets.select("key", "id").union(within.select("key", F.col("c").alias("id")).distinct())
    n = buckets.count()
    bitmap, bits = repeat_filter(buckets.select("id").union(buckets.select("c")).distinct(), max(1, n // 4), 1)
    held = spark.sparkContext.broadcast(bitmap)
    sets = scratch.table(text.mapInArrow(_wanted(held, bits), "id long, s array<int>").groupBy("id").agg(F.min("s").alias("s")))

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, ok) of each pair (a, b)."""
        one = pairs.join(sets.toDF("a", "sa"), "a")
        both = one.join(sets.toDF("b", "sb"), "b")
        inter = F.size(F.array_intersect("sa", "sb"))
        return scratch.table(both.select("a", "b", (inter >= F.lit(threshold) * (F.size("sa") + F.size("sb") - inter)).alias("ok")))

    seen = verified(pairs)
    edges = scratch.table(seen.where("ok").select("a", "b"))
    root = components(edges, scratch)
    # Members of one bucket that no edge has united: all pairs across components, but those compared before.
    named = scratch.table(members.join(root, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")).distinct())
    size = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("lo <> hi").select("key", "blocks")
    mixed = scratch.table(named.join(size, "key"))
    scratch.drop(buckets, named, keyed)
    one = mixed.select("key", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.col("id").alias("a"), F.col("root").alias("ra"))
    other = mixed.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("b"), F.col("root").alias("rb"))
    cross = one.join(other, ["key", "block"]).where("a > b and ra <> rb").select("a", "b").distinct().join(seen, ["a", "b"], "left_anti")
    more = verified(cross).where("ok").select("a", "b")
    # What they unite are whole components; each then has the least of their roots.
    up = lambda t, c: t.join(root.toDF(c, "r_" + c), c, "left").withColumn(c, F.coalesce("r_" + c, c)).drop("r_" + c)
    joined = scratch.table(up(up(more, "a"), "b").distinct())
    if not joined.isEmpty():
        top = components(joined, scratch)
        met = root.union(joined.select("a", "a").union(joined.select("b", "b"))).distinct().toDF("id", "old")
        root = scratch.table(met.join(top.toDF("old", "new"), "old", "left").select("id", F.coalesce("new", "old").alias("root")))
    # Those with an equal set follow the one that stands for them, twins the first of their batch.
    lot = scratch.table(firsts.join(root.toDF("first", "root"), "first", "left").select("id", F.coalesce("root", "first").alias("root")))
    known = root.union(lot)
    rest = twins.join(known.toDF("first", "root"), "first", "left").select("id", F.coalesce("root", "first").alias("root"))
    heads = lot.union(rest).select(F.col("root").alias("id"), "root").distinct()
    out = known.union(rest).union(heads).groupBy("id").agg(F.min("root").alias("root"))
    return out.select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"), (F.col("id") == F.col("root")).alias("keep"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without all but one of each group of near copies, in the columns of the input.

    Of several rows of a kept id all stay; rows of null ids stay.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-out")
    gone = scratch.table(near_groups(docs, id_col, text_col, threshold).where("not keep").select("doc_id"))
    maybe = probing(spark, *repeat_filter(gone, gone.count(), 1))
    key, mark = fresh(docs, "_gone"), fresh(docs, "_maybe")
    id_ = F.col(f"`{id_col}`").cast("long")
    marked = docs.withColumn(mark, id_.isNotNull() & maybe(F.coalesce(id_, F.lit(0))))
    stay = marked.where(F.col(mark)).drop(mark).join(gone.toDF(key), id_ == F.col(key), "left_anti")
    return marked.where(~F.col(mark)).drop(mark).unionByName(stay)
