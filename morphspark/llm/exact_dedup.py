"""Exact dedup by two-pass Bloom filtering.

Pass 1 sets bits for the hash of every text and finds the bits set at least
twice; a text that occurs twice sets all its bits twice. Pass 2 probes every
row: only rows whose bits were all set twice shuffle, and meet by a 256-bit
digest of the text; the rest pass straight through. A false positive costs a
row's shuffle, never a wrong result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import fresh
from ._text import mix

HASHES = 2
BITS_PER_ROW = 16
BLOCK_BITS = 1 << 23


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions of each 64-bit hash."""
    h = h.view(np.uint64)
    return np.concatenate([mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) & np.uint64(bits - 1) for k in range(HASHES)])


def filter_bits(rows: int, most_bytes: int) -> int:
    """A power of two: BITS_PER_ROW for each row, within the memory that is allowed."""
    bits = 1 << max(16, int(np.ceil(np.log2(max(1, rows) * BITS_PER_ROW))))
    while bits // 8 > most_bytes and bits > 1 << 16:
        bits >>= 1
    return bits


def repeat_filter(hashes: DataFrame, rows: int, least: int = 2, most_bytes: int = 256 << 20) -> tuple[np.ndarray, int]:
    """(bitmap, bits): the bits that at least `least` (1 or 2) of the hashes in the one column set."""
    bits = filter_bits(rows, most_bytes)
    block = min(bits, BLOCK_BITS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            at, n = np.unique(positions(np.concatenate(held), bits), return_counts=True)
            for k in np.unique(at // block):
                of = at // block == k
                once, twice = (at[of] % block).astype(np.uint32), (at[of & (n > 1)] % block).astype(np.uint32)
                pack = lambda x: zlib.compress(np.diff(x, prepend=np.uint32(0)).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int64()), pa.array([pack(once)]), pa.array([pack(twice)])], ["k", "once", "twice"])

        held, n = [], 0
        for b in batches:
            h = b.column(0).drop_null()
            held.append(h.to_numpy(zero_copy_only=False).astype(np.int64))
            n += len(h)
            if n > 4_000_000:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    def merge(t: pa.Table) -> pa.Table:
        seen, again = np.zeros(block, bool), np.zeros(block, bool)
        for once, twice in zip(t.column("once"), t.column("twice")):
            at = np.cumsum(np.frombuffer(zlib.decompress(once.as_py()), np.uint32), dtype=np.uint32)
            again[at[seen[at]]] = True
            seen[at] = True
            again[np.cumsum(np.frombuffer(zlib.decompress(twice.as_py()), np.uint32), dtype=np.uint32)] = True
        return pa.table({"k": t.column("k")[:1], "map": pa.array([np.packbits(again if least == 2 else seen, bitorder="little").tobytes()])})

    found = hashes.mapInArrow(local, "k long, once binary, twice binary").groupBy("k").applyInArrow(merge, "k long, map binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in found:
        out[r.k * block // 8 :][: block // 8] = np.frombuffer(r["map"], np.uint8)
    return out, bits


def probe(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are set."""
    at = positions(h, bits)
    return ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).reshape(HASHES, -1).all(axis=0)


def probing(spark, bitmap: np.ndarray, bits: int):
    """A column function: whether a hash may be in the filter. The filter, of checked size, is broadcast."""
    held = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(probe(held.value, bits, h.to_numpy(dtype=np.int64)))

    return maybe


def row_order(df: DataFrame, first: str) -> list[Column]:
    """A total order of rows up to equal ones: the id, then the other columns' hash."""
    plain = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return [F.col(f"`{first}`").asc_nulls_last(), F.xxhash64(*plain)]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 256 << 20) -> DataFrame:
    """Of the rows with the same text one is kept: that of the smallest id.

    All columns come back as they were. A null text equals no other, so such
    rows stay; empty texts equal each other. Of repeated rows one stays; among
    rows of one text and one id, the least by a hash of the row. A null id
    comes last. An empty table gives an empty one. The Bloom filter takes
    16 bits for each row up to max_filter_bytes; beyond that only the share of
    rows that shuffle grows.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.col(f"`{text_col}`"))
    keyed = docs.where(F.col(f"`{text_col}`").isNotNull()).select(h.alias("h"))
    bitmap, bits = repeat_filter(keyed, docs.count(), 2, max_filter_bytes)
    maybe = probing(spark, bitmap, bits)
    mark, key, rank = (fresh(docs, x) for x in ("_maybe", "_digest", "_rank"))
    marked = docs.withColumn(mark, F.col(f"`{text_col}`").isNotNull() & maybe(F.coalesce(h, F.lit(0))))
    through = marked.where(~F.col(mark)).drop(mark)
    again = marked.where(F.col(mark)).drop(mark).withColumn(key, F.sha2(F.col(f"`{text_col}`"), 256))
    w = Window.partitionBy(key).orderBy(*row_order(docs, id_col))
    return through.unionByName(again.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank, key))
