"""Best-fit packing of documents into fixed contexts, with certified bin counts.

Documents are cut into pieces of at most the capacity. Each partition packs its
pieces by best-fit decreasing and computes lower bounds from dual-feasible
functions on its histogram of sizes. Where bins and bound agree the packing is
optimal and stays. Partitions with a gap give up the documents of bins that
aren't full; those meet in new partitions and are packed again. A round that
saves no bin is the last. What full bins keep and what is given up count as two
parts, so the bins and bounds of all parts add up at any time.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from .mixing import n_words

CAPACITY = 2048
ITEMS_PER_PARTITION = 100_000


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing of these sizes (1 to capacity) needs at least: the best of the volume bound and two families of dual-feasible functions, in whole numbers."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(object if len(sizes) * capacity * 64 > 2**62 else np.int64)
    s = np.arange(capacity + 1)
    best = -(-int((count * s).sum()) // capacity)
    for k in range(1, 65):
        up = (k + 1) * s
        u = np.where(up % capacity == 0, k * s, capacity * (up // capacity))  # k * capacity times the function's value
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    number, volume = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * s)])
    for e in np.unique(sizes[sizes * 2 <= capacity]):
        large = int(number[-1] - number[capacity - e + 1])
        middle = int(volume[capacity - e + 1] - volume[e])
        best = max(best, large - (-middle // capacity))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(bin of each item, bins): the largest items first, each into the fullest bin that has room."""
    out = np.zeros(len(sizes), np.int64)
    rooms: list[int] = []  # distinct free sizes, ascending
    at: dict[int, list[int]] = {}
    bins = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect_left(rooms, s)
        if k < len(rooms):
            room = rooms[k]
            b = at[room].pop()
            if not at[room]:
                del at[room], rooms[k]
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        if left := room - s:
            if left not in at:
                at[left] = []
                insort(rooms, left)
            at[left].append(b)
    return out, bins


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, items_per_partition: int = ITEMS_PER_PARTITION, sizes: DataFrame | None = None) -> DataFrame:
    """(doc_id, start_token, n_tokens, bin_id, part, part_bins, part_bound) of every piece of every document.

    A document of more than `capacity` white-space words is cut at multiples of
    it. Every bin is in one part; part_bins is the number of the part's bins and
    part_bound the least number that its pieces need. A full piece is a bin and
    a part by itself, part null. Repacking goes on until it saves no bin. Ids
    are whole numbers. A null or empty text has no
    tokens: one row, bin_id and the part columns null. Repeated rows and ties
    are packed each for itself; a null id is packed like any other. An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    if sizes is None:
        sizes = docs.select(F.col(f"`{id_col}`").alias("doc_id"), n_words(F.col(f"`{text_col}`")).alias("n"))
    sizes = scratch.table(sizes.select("doc_id", "n", F.monotonically_increasing_id().alias("row")))  # ids may repeat or be null; a row's number, once written, is its own
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity) * capacity, F.lit(capacity).cast("long")))
    items = sizes.where("n > 0").select("doc_id", "n", "row", starts.alias("start_token")).select("doc_id", "row", "start_token", F.least(F.col("n") - F.col("start_token"), F.lit(capacity)).cast("long").alias("n_tokens"))
    n = sizes.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    full = items.where(F.col("n_tokens") == capacity).select("doc_id", "start_token", "n_tokens", F.concat(F.lit("full-"), F.col("row"), F.lit("-"), F.col("start_token")).alias("bin_id"), F.lit(None).cast("long").alias("part"), F.lit(1).cast("long").alias("part_bins"), F.lit(1).cast("long").alias("part_bound"))
    kind = "doc_id long, row long, start_token long, n_tokens long, bin_id string, part long, part_bins long, part_bound long, open boolean"
    arrow = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start_token", pa.int64()), ("n_tokens", pa.int64()), ("bin_id", pa.string()), ("part", pa.int64()), ("part_bins", pa.int64()), ("part_bound", pa.int64()), ("open", pa.bool_())])
    shown = ["doc_id", "start_token", "n_tokens", "bin_id", "part", "part_bins", "part_bound"]

    def packer(turn: int):
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("start_token", "ascending")])
            size, part = t.column("n_tokens").to_numpy(), t.column("part")[0].as_py()
            bins, used = best_fit(size, capacity)
            bound = lower_bound(size, capacity)
            load = np.bincount(bins, weights=size, minlength=used)
            gone = (used > bound) & (load[bins] < capacity)
            lost = int((load < capacity).sum()) if used > bound else 0
            if lost:  # full bins need no fewer, whatever they hold
                took, least = np.where(gone, lost, used - lost), np.where(gone, lower_bound(size[gone], capacity), used - lost)
            else:
                took, least = np.full(len(t), used), np.full(len(t), bound)
            return pa.Table.from_arrays([t.column("doc_id"), t.column("row"), t.column("start_token"), t.column("n_tokens"), pa.array([f"{turn}-{part}-{b}" for b in bins]), pa.array((turn << 40 | part << 1) + gone.astype(np.int64)), pa.array(took.astype(np.int64)), pa.array(least.astype(np.int64)), pa.array(gone)], schema=arrow)

        return run

    def packed(rows: DataFrame, many: int, turn: int) -> DataFrame:
        cols = rows.select("doc_id", "row", "start_token", "n_tokens", F.pmod(F.xxhash64(F.lit(turn), "row", "start_token"), F.lit(many)).alias("part"))
        return scratch.table(cols.groupBy("part").applyInArrow(packer(turn), kind))

    short = items.where(F.col("n_tokens") < capacity)
    state = packed(short, max(1, -(-n // items_per_partition)), 0)
    done = [full, state.where("not open").select(*shown)]
    left, turn = state.where("open"), 0
    bins_of = lambda t: t.agg(F.count("*"), F.countDistinct("bin_id")).first()
    many, before = bins_of(left)
    while many:
        turn += 1
        again = packed(left, max(1, -(-many // items_per_partition)), turn)
        _, after = bins_of(again)
        if after >= before:
            break
        done.append(again.where("not open").select(*shown))
        left = again.where("open")
        many, before = bins_of(left)
    done.append(left.select(*shown))
    none = sizes.where("n <= 0").select("doc_id", F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("n_tokens"), *[F.lit(None).cast(k).alias(c) for c, k in (("bin_id", "string"), ("part", "long"), ("part_bins", "long"), ("part_bound", "long"))])
    out = none
    for d in done:
        out = out.unionByName(d)
    return out
