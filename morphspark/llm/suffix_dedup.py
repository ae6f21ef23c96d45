"""Repeated passages by suffix arrays of many documents, built column by column.

Every window of LENGTH words belongs to its minimiser, the least hash of GRAM
words in it, so equal windows meet at equal minimisers. Windows in a row that
share one form a piece. Pieces whose minimiser occurs once in the corpus hold
no repeat and stop there; the rest gather by minimiser in buckets, equal pieces
as one. A minimiser with too many unlike pieces for one task is parted: its
pieces are cut again by another minimiser of their windows, at last to single
windows, so no bucket grows with the corpus. For each bucket the Burrows-Wheeler transform of all its pieces and
the common prefixes of neighbouring suffixes are built by inserting, in each
round, the next symbol of every piece from its end; what stands so far is read
and written in order, in memory while it is small and else in files in the
shared folder. Suffixes with common prefixes of LENGTH words are repeats.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch, shared_dir
from ._text import chunks, mix, ragged, ws_words
from .exact_dedup import probe, repeat_filter

LENGTH = 50
GRAM = 8
IN_MEMORY = 64 << 20
BUCKET_WORDS = 200_000
#: Unlike pieces of one minimiser that one task takes; SEEDS: minimisers that part those with more, before single windows do.
MOST_PIECES = 20_000
SEEDS = (1, 2, 3)


class Columns:
    """Arrays that one round reads in order and the next replaces: held in memory up to IN_MEMORY bytes, beyond in a file of the shared folder."""

    def __init__(self, folder: str, in_memory: int = IN_MEMORY):
        self.folder, self.in_memory, self.held, self.path, self.fs = folder, in_memory, None, None, None

    def write(self, *arrays: np.ndarray) -> None:
        old = self.path
        if sum(a.nbytes for a in arrays) <= self.in_memory:
            self.held, self.path = arrays, None
        else:
            if self.fs is None:
                self.fs, base = pyarrow.fs.FileSystem.from_uri(self.folder if "://" in self.folder else "file://" + self.folder)
                self.base = f"{base}/columns-{uuid.uuid4().hex}"
                self.fs.create_dir(self.base)
            self.held, self.path = None, f"{self.base}/{uuid.uuid4().hex}"
            with self.fs.open_output_stream(self.path) as f:
                for a in arrays:
                    np.lib.format.write_array(f, a, allow_pickle=False)
            self.many = len(arrays)
        if old:
            self.fs.delete_file(old)

    def read(self) -> tuple[np.ndarray, ...]:
        if self.path is None:
            return self.held
        with self.fs.open_input_file(self.path) as f:
            raw = io.BytesIO(f.read())
        return tuple(np.lib.format.read_array(raw, allow_pickle=False) for _ in range(self.many))

    def close(self) -> None:
        if self.fs is not None:
            self.fs.delete_dir(self.base)


def build(symbols: np.ndarray, rows: np.ndarray, cap: int, folder: str, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, common prefix with the suffix before, BWT symbol), suffixes in order.

    symbols: small whole numbers of all pieces on end, row offsets. Common
    prefixes are cut at cap. Suffixes that agree to a piece's
    end come in the order of their pieces. The BWT symbol of a whole piece is -1.
    """
    n = np.diff(rows)
    m = len(n)
    state = Columns(folder, in_memory)
    # The empty suffixes, all equal to each other. place: where each piece's last suffix stands.
    piece = np.arange(m, dtype=np.int32)
    first = np.full(m, -1, np.int64)  # first symbol of the suffix
    rest = np.arange(m, dtype=np.int64)  # where the suffix without it stands
    kind = np.uint8 if cap < 256 else np.uint16 if cap < 65536 else np.int64
    lcp = np.zeros(m, kind)
    offset = n.astype(np.int32).copy()
    place = np.arange(m, dtype=np.int64)
    state.write(piece, offset, first, rest, lcp)
    width = np.int64(1) << 32
    for j in range(1, int(n.max(initial=0)) + 1):
        piece, offset, first, rest, lcp = state.read()
        live = np.flatnonzero(n >= j)
        c = symbols[rows[live + 1] - j].astype(np.int64)
        order = np.lexsort((place[live], c))
        live, c = live[order], c[order]
        q = place[live]
        key = first * width + rest  # suffixes are in this order
        at = np.searchsorted(key, c * width + q)
        size, k = len(key), len(live)
        new = at + np.arange(k)  # their places after insertion
        moved = np.ones(size + k, bool)
        moved[new] = False
        old = np.flatnonzero(moved)

        def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.empty(size + k, a.dtype)
            out[old], out[new] = a, b
            return out

        # Range minima of the common prefixes so far give those of the new neighbours.
        table = [lcp]
        while (1 << len(table)) <= size:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))

        def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """min of lcp[lo + 1 .. hi], for lo < hi."""
            span = np.frexp(np.maximum(hi - lo, 1).astype(np.float64))[1] - 1
            out = np.empty(len(lo), kind)
            for s in np.unique(span):
                w = span == s
                out[w] = np.minimum(table[s][lo[w] + 1], table[s][hi[w] - (1 << s) + 1])
            return out

        f2, r2 = merged(first, c), merged(rest, q)  # rest still by the old places
        touched = np.unique(np.concatenate([new, np.minimum(new + 1, size + k - 1)]))
        l2 = merged(lcp, np.zeros(k, kind))
        t = touched[touched > 0]
        same = (f2[t] == f2[t - 1]) & (f2[t] >= 0)
        value = np.zeros(len(t), kind)
        if same.any():
            w = t[same]
            value[same] = np.minimum(least(r2[w - 1], r2[w]).astype(np.int64) + 1, cap).astype(kind)
        l2[t] = value
        place[live] = new
        state.write(merged(piece, live.astype(np.int32)), merged(offset, (n[live] - j).astype(np.int32)), f2, np.where(f2 >= 0, old[np.minimum(r2, size - 1)], r2), l2)
        # Pieces that ended earlier move with the rest.
        done = np.flatnonzero(n < j)
        place[done] = old[place[done]]
    piece, offset, first, rest, lcp = state.read()
    state.close()
    before = np.where(offset > 0, symbols[np.maximum(rows[piece] + offset - 1, 0)] if len(symbols) else -1, -1)
    return piece, offset, lcp, before


def pieces(h: np.ndarray, rows: np.ndarray, length: int, gram: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimiser) of the pieces: windows in a row with one minimiser. Another seed has other minimisers."""
    g = np.full(max(0, len(h) - gram + 1), seed, np.uint64)
    for k in range(gram):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(g)])
    end = np.repeat(rows[1:], np.diff(rows))
    i = np.flatnonzero(np.arange(len(h)) + length <= end)
    if not len(i):
        return i, i, np.zeros(0, np.uint64)
    # Sliding minimum of g over length - gram + 1 places, by doubling; the rightmost of equal ones.
    many = length - gram + 1
    low, at, have = g, np.arange(len(g)), 1
    while have < many:
        step = min(have, many - have)
        a, b = low[: len(low) - step], low[step:]
        right = b <= a
        at = np.where(right, at[step:], at[: len(at) - step])
        low = np.where(right, b, a)
        have += step
    who = at[i]
    edge = np.flatnonzero((np.diff(who) != 0) | (np.diff(i) != 1))
    start, stop = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(i) - 1]])
    return i[start], i[stop], g[who[start]]


def _pieces_batch(ids: pa.Array, ts: pa.Array, w: np.ndarray, lo: np.ndarray, hi: np.ndarray, m: np.ndarray, h: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows (id, t, w, m, p, words) of pieces; w: first word in the text, lo and hi: first and last window in h, p: a hash of all words."""
    n = hi - lo + length
    base = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(n.sum()) - np.repeat(base, n)
    words = h[np.repeat(lo, n) + place]
    key = mix(np.add.reduceat(mix(words.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), base))
    return pa.RecordBatch.from_arrays([ids, ts, pa.array(w.astype(np.int32)), pa.array(m.view(np.int64)), pa.array(key.view(np.int64)), ragged(words.view(np.int32), n, pa.int32())], ["id", "t", "w", "m", "p", "words"])


def _parted(length: int, gram: int, seed: int | None):
    """Cuts pieces by another minimiser; without a seed, to single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 5_000):
                part = batch.slice(s, 5_000)
                words = part.column(5)
                rows = words.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
                h = words.values.to_numpy(zero_copy_only=False)[rows[0] : rows[-1]].view(np.uint32)
                rows = rows - rows[0]
                if seed is None:
                    lo = np.flatnonzero(np.arange(len(h)) + length <= np.repeat(rows[1:], np.diff(rows)))
                    hi, m = lo, np.zeros(len(lo), np.uint64)
                    for k in range(length):
                        m = mix(m * np.uint64(31) + h[lo + k].astype(np.uint64))
                else:
                    lo, hi, m = pieces(mix(h.astype(np.uint64)), rows, length, gram, seed)
                if len(lo):
                    row = np.searchsorted(rows, lo, side="right") - 1
                    take = pa.array(row)
                    m = mix(m + mix(part.column(3).to_numpy(zero_copy_only=False).view(np.uint64)[row]))
                    yield _pieces_batch(part.column(0).take(take), part.column(1).take(take), part.column(2).to_numpy(zero_copy_only=False)[row] + lo - rows[row], lo, hi, m, h, length)

    return run


def _list(x: list) -> pa.Array:
    return pa.array(x, pa.list_(pa.int32()))


def ranges(hit: np.ndarray) -> list[int]:
    """[first, last, first, last, ...] of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    out = edge.copy()
    out[1::2] -= 1
    return out.tolist()


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, in_memory: int = IN_MEMORY, most_pieces: int = MOST_PIECES) -> DataFrame:
    """(doc_id, start_word, n_words, first): the passages made of windows of `length` words that occur more than once.

    Words are cut at white space and compared as they are. first is true for
    passages of first occurrences: by id, then place in the text. A passage
    where first is false can be cut out without loss of the first occurrence.
    Two passages of one document may overlap if one is first and the other
    isn't. length may be any whole number of gram words or more. Ids are whole
    numbers. Null texts, null ids and texts shorter than the window have none;
    repeated rows of one id and text count once, rows of one id with different
    texts as one id's texts, in the order of a hash. An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    folder = shared_dir(spark)
    id_, text_ = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    text = docs.where(id_.isNotNull() & text_.isNotNull()).select(id_.cast("long").alias("id"), F.xxhash64(text_).alias("t"), text_.alias("text"))

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, b, o in chunks(batch.column(0)):
                h, _, _, rows = ws_words(b, o)
                yield pa.RecordBatch.from_arrays([pa.array(pieces(h, rows, length, gram)[2].view(np.int64))], ["m"])

    bitmap, bits = repeat_filter(text.select("text").mapInArrow(minimisers, "m long"), docs.count() * 24, 2)
    held = spark.sparkContext.broadcast(bitmap)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, _, b, o in chunks(batch.column(2)):
                h, _, _, rows = ws_words(b, o)
                lo, hi, m = pieces(h, rows, length, gram)
                hit = np.flatnonzero(probe(held.value, bits, m.view(np.int64))) if len(m) else np.zeros(0, np.int64)
                if len(hit):
                    row = np.searchsorted(rows, lo[hit], side="right") - 1
                    take = pa.array(row + r0)
                    yield _pieces_batch(batch.column(0).take(take), batch.column(1).take(take), lo[hit] - rows[row], lo[hit], hi[hit], m[hit], (h >> np.uint64(32)).astype(np.uint32), length)

    kind = "id long, t long, w int, m long, p long, words array<int>"
    found = scratch.table(text.mapInArrow(emit, kind))
    for seed in (*SEEDS, None):
        many = scratch.table(found.groupBy("m", "p").agg(F.lit(1).alias("one")).groupBy("m").count().where(F.col("count") > most_pieces).select("m"))
        if many.isEmpty():
            break
        hot = found.join(many, "m", "left_semi").select(*found.columns)
        found = scratch.table(found.join(many, "m", "left_anti").select(*found.columns).unionByName(hot.mapInArrow(_parted(length, gram, seed), kind)))
    where = F.struct("id", "t", "w")
    kinds = found.groupBy("m", "p").agg(F.min(where).alias("at"), F.when(F.min(where) == F.max(where), 1).otherwise(2).alias("n"), F.first("words").alias("words"))
    total = found.count()
    buckets = max(1, total * (length + length // 2) // BUCKET_WORDS)
    schema = "m long, p long, id long, t long, w int, again array<int>, later array<int>"

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("m", "ascending"), ("p", "ascending")])
        words = t.column("words").combine_chunks()
        rows = np.frombuffer(words.buffers()[1] if words.offset == 0 else words.offsets.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        flat_words = words.values.to_numpy(zero_copy_only=False)[rows[0] : rows[-1]]
        rows = rows - rows[0]
        _, symbols = np.unique(flat_words, return_inverse=True)
        piece, offset, lcp, _ = build(symbols, rows, length, folder, in_memory)
        n = np.diff(rows)
        many = t.column("n").to_numpy()
        at = t.column("at").combine_chunks()
        ids, ts, ws = (at.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        full = n[piece] - offset >= length  # suffixes that hold a window
        group = np.cumsum(lcp < length)
        piece, offset, group = piece[full], offset[full], group[full]
        _, group = np.unique(group, return_inverse=True)
        often = np.bincount(group, weights=many[piece]) > 1
        order = np.lexsort((ws[piece] + offset, ts[piece], ids[piece], group))
        head = np.zeros(len(group), bool)
        head[order[np.concatenate([[True], np.diff(group[order]) > 0])]] = True
        windows = n - length + 1
        base = np.concatenate([[0], np.cumsum(windows)])
        again, later = np.zeros(base[-1], bool), np.zeros(base[-1], bool)
        again[base[piece] + offset] = often[group]
        later[base[piece] + offset] = often[group] & ~head
        keep = [k for k in range(len(n)) if again[base[k] : base[k + 1]].any()]
        cut = lambda x: _list([ranges(x[base[k] : base[k + 1]]) for k in keep])
        take = pa.array(keep, pa.int64())
        pick = lambda x: pa.array(x[keep])
        return pa.Table.from_arrays([t.column("m").take(take), t.column("p").take(take), pick(ids), pick(ts), pick(ws.astype(np.int32)), cut(again), cut(later)], ["m", "p", "id", "t", "w", "again", "later"])

    marked = scratch.table(kinds.withColumn("b", F.pmod(F.xxhash64("m"), F.lit(buckets))).groupBy("b").applyInArrow(search, schema))
    joined = found.select("id", "t", "w", "m", "p").join(marked.select("m", "p", F.struct("id", "t", "w").alias("at"), "again", "later"), ["m", "p"])
    # The first of equal pieces is later only where another piece has the window before it.
    own = joined.select("id", "t", "w", "again", F.when(where.eqNullSafe(F.col("at")), F.col("later")).otherwise(F.col("again")).alias("later"), (where.eqNullSafe(F.col("at"))).alias("head"))

    def spans(t: pa.Table) -> pa.Table:
        by: dict[tuple, tuple[list, list]] = {}
        for r in t.select(["id", "t", "w", "again", "later"]).to_pylist():
            a, b = by.setdefault((r["id"], r["t"]), ([], []))
            later = set()
            for x, y in zip(r["later"][::2], r["later"][1::2]):
                b.append((r["w"] + x, r["w"] + y + length))
                later.update(range(x, y + 1))
            for x, y in zip(r["again"][::2], r["again"][1::2]):
                s = None
                for k in range(x, y + 2):
                    if k <= y and k not in later:
                        s = k if s is None else s
                    elif s is not None:
                        a.append((r["w"] + s, r["w"] + k - 1 + length))
                        s = None
        rows = []
        for (i, _), pair in by.items():
            for is_first, each in zip((True, False), pair):
                merged: list[list[int]] = []
                for x, y in sorted(each):
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], y)
                    else:
                        merged.append([x, y])
                rows += [(i, x, y - x, is_first) for x, y in merged]
        return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "start_word": pa.array([r[1] for r in rows], pa.int32()), "n_words": pa.array([r[2] for r in rows], pa.int32()), "first": pa.array([r[3] for r in rows], pa.bool_())})

    lots = max(1, total // 50_000)
    return own.withColumn("b", F.pmod(F.xxhash64("id", "t"), F.lit(lots))).groupBy("b").applyInArrow(spans, "doc_id long, start_word int, n_words int, first boolean")


SQL = """
with d as (select doc_id, regexp_extract_all(text, '[^ \t\n\r\f\v]+') as ws from documents where text is not null),
n as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from d where len(ws) >= 50),
h as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as g from n),
w as (select doc_id, i, row_number() over (partition by g order by doc_id, i) = 1 as first, count(*) over (partition by g) as c from h),
r as (select doc_id, first, i, case when i <= 50 + max(i) over (partition by doc_id, first order by i rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from w where c > 1),
k as (select *, sum(fresh) over (partition by doc_id, first order by i) as k from r)
select doc_id, (min(i) - 1)::int as start_word, (max(i) - min(i) + 50)::int as n_words, first from k group by doc_id, first, k
"""
