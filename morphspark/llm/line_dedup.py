"""Line dedup by winnowing over line hashes.

A run of lines is long enough if it has RUN lines, or LEAST letters and digits.
From every line on, the shortest such run is a window, and each window selects
its least line hash as a fingerprint: equal runs that are long enough select
the same ones. A filter finds the fingerprints selected at two positions or
more; only there is each window extended, line by line, up to RUN lines. What
is found is joined with the first position of an equal run, overlapping runs
grow into the longest match both ways, and all but the first are deleted.
Within a batch only the first of equal runs takes part in that join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._text import _LETTER, chunks, hashes, mix
from .exact_dedup import probe, probing, repeat_filter

RUN, LEAST = 3, 25


def lines(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first line of each row and the total). Lines end at line feeds; every row has one at least."""
    feed = np.flatnonzero(b == 10)
    starts = np.concatenate([offsets[:-1], feed + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feed, side="right") - 1])
    order = np.lexsort((np.arange(len(starts)), starts, row))
    starts, row = starts[order], row[order]
    rows = np.searchsorted(row, np.arange(len(offsets)))
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[rows[1:] - 1] = offsets[1:]
    return starts, ends, rows


def line_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.full(len(starts), 0x1234567, np.uint64)
    some = ends > starts
    out[some] = hashes(b, starts[some], ends[some])
    return out


def letters(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Letters and digits of each line; characters beyond ASCII count as letters."""
    total = np.concatenate([[0], np.cumsum(_LETTER[b] & ((b & 0xC0) != 0x80))])
    return total[ends] - total[starts]


def windows(h: np.ndarray, size: np.ndarray, rows: np.ndarray, run: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, lines, place of the fingerprint) of the shortest run that is long enough from every line on, within its row."""
    end = np.repeat(rows[1:], np.diff(rows))
    i = np.arange(len(h))
    many, place = np.zeros(len(h), np.int64), i.copy()
    total, low, at = np.zeros(len(h), np.int64), h.copy(), i.copy()
    for k in range(run):
        j = np.minimum(i + k, max(0, len(h) - 1))
        inside = i + k < end
        total = total + np.where(inside, size[j], 0)
        less = inside & (h[j] <= low)
        low, at = np.where(less, h[j], low), np.where(less, j, at)
        now = inside & (many == 0) & ((total >= least) | (k == run - 1))
        many[now], place[now] = k + 1, at[now]
    some = np.flatnonzero(many)
    return some, many[some], place[some]


def extended(h: np.ndarray, rows: np.ndarray, i: np.ndarray, many: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first line, lines, hash, second hash) of the windows and of what they grow to, up to `run` lines."""
    end = np.repeat(rows[1:], np.diff(rows))[i] if len(i) else i
    g, c, out = np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64), []
    for k in range(run):
        ok = i + k < end
        x = h[np.minimum(i + k, max(0, len(h) - 1))] if len(h) else g
        g, c = mix(g * np.uint64(0x9E3779B97F4A7C15) + x), mix(c * np.uint64(0xC2B2AE3D27D4EB4F) + x + np.uint64(k + 1))
        w = np.flatnonzero(ok & (many <= k + 1))
        out.append((i[w], np.full(len(w), k + 1), g[w], c[w]))
    return tuple(np.concatenate(x) for x in zip(*out))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least: int = LEAST) -> DataFrame:
    """(doc_id, text, n_deleted) of every row: the text without runs of lines that stand earlier in the corpus or the text.

    A run counts if it has `run` lines or `least` letters and digits: one line
    of that size, two, or three lines of any.

    Earlier is by id (nulls last), then place. Lines are compared as they are,
    blank ones too. Ids are whole numbers. Rows of one id and one text count as one document and are
    all cut alike; rows of one id with different texts come in the order of a
    hash. A null text stays null, a text without such runs stays whole, one that
    is all repeats becomes empty. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    slim = docs.where(text.isNotNull()).select(id_.cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))

    step = run + 1  # first line and number of lines in one number

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, b, o in chunks(batch.column(0)):
                s, e, rows = lines(b, o)
                h = line_hashes(b, s, e)
                _, _, place = windows(h, letters(b, s, e), rows, run, least)
                yield pa.RecordBatch.from_arrays([pa.array(h[np.unique(place)].view(np.int64))], ["f"])

    bitmap, bits = repeat_filter(slim.select("text").mapInArrow(fingerprints, "f long"), docs.count() * 8, 2)
    held = spark.sparkContext.broadcast(bitmap)

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for r0, _, b, o in chunks(batch.column(2)):
                s, e, rows = lines(b, o)
                h = line_hashes(b, s, e)
                i, many, place = windows(h, letters(b, s, e), rows, run, least)
                hit = probe(held.value, bits, h[place].view(np.int64)) if len(place) else np.zeros(0, bool)
                i, many, g, c = extended(h, rows, i[hit], many[hit], run)
                row = np.searchsorted(rows, i, side="right") - 1
                got.append((row + r0, i - rows[row], many, g, c))
            if not got:
                continue
            row, i, many, g, c = (np.concatenate(x) for x in zip(*got))
            ids, ts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            known, number = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((i, ts[row], number[row], ~known[row], c, g))
            row, i, many, g, c = row[order], i[order], many[order], g[order], c[order]
            same = (g[1:] == g[:-1]) & (c[1:] == c[:-1])  # as the one before: an equal run stands earlier in this batch
            twin = same & (i[1:] == i[:-1]) & (ts[row[1:]] == ts[row[:-1]]) & (number[row[1:]] == number[row[:-1]]) & (known[row[1:]] == known[row[:-1]])
            keep = np.concatenate([[True], ~twin])[: len(row)]  # repeated rows are one document
            sure = np.concatenate([[False], same])[: len(row)] & keep
            first = np.concatenate([[True], ~same])[: len(row)]
            row, i, many, g, c, sure = row[keep], i[keep], many[keep], g[keep], c[keep], (sure & ~first)[keep]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([ids.take(at), batch.column(1).take(at), pa.array(i * step + many), pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(sure)], ["id", "t", "i", "g", "c", "sure"])

    found = scratch.table(slim.mapInArrow(matches, "id long, t long, i long, g long, c long, sure boolean"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "t", "i")
    heads = found.where("not sure")
    first = heads.groupBy("g", "c").agg(F.min(place).alias("first"), F.max(place).alias("end")).where("first <> end").drop("end")
    later = heads.join(first, ["g", "c"]).where(~place.eqNullSafe(F.col("first")))
    cut = scratch.table(later.select("id", "t", "i").union(found.where("sure").select("id", "t", "i")).groupBy("id", "t").agg(F.sort_array(F.collect_set("i")).alias("cut")))
    maybe = probing(spark, *repeat_filter(cut.select(F.xxhash64("id", "t")), cut.count(), 1))

    @F.arrow_udf("struct<text: string, n: int>")
    def without(text: pa.Array, cut: pa.Array) -> pa.Array:
        out, n = [], []
        for x, c in zip(text.to_pylist(), cut.to_pylist()):
            if not c:
                out.append(x)
                n.append(0)
                continue
            every = x.split("\n")
            gone = {k for x in c for k in range(x // step, x // step + x % step)}
            out.append("\n".join(v for k, v in enumerate(every) if k not in gone))
            n.append(len(gone))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int32())], ["text", "n"])

    plain = docs.select(id_.alias("doc_id"), text.alias("text"))
    k1, k2 = id_.cast("long"), F.xxhash64(text)
    marked = docs.select(id_.alias("doc_id"), text.alias("text"), k1.alias("k1"), k2.alias("k2"), (text.isNotNull() & maybe(F.xxhash64(k1, k2))).alias("m"))
    through = marked.where("not m").select("doc_id", "text", F.lit(0).alias("n_deleted"))
    rest = marked.where("m").join(cut, F.col("k1").eqNullSafe(F.col("id")) & (F.col("k2") == F.col("t")), "left").select("doc_id", without("text", "cut").alias("x"))
    return through.unionByName(rest.select("doc_id", "x.text", F.col("x.n").alias("n_deleted"))).select(*plain.columns, "n_deleted")


SQL = """
with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
e as (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as i from l),
s as (select *, length(regexp_replace(line, '[^A-Za-z0-9\\x{80}-\\x{10ffff}]', '', 'g')) as n, lead(line) over w as line2, lead(line, 2) over w as line3 from e window w as (partition by doc_id order by i)),
t as (select *, lead(n) over (partition by doc_id order by i) as n2 from s),
r as (select doc_id, i, 1 as k, [line] as run from t where n >= 25
      union all select doc_id, i, 2, [line, line2] from t where line2 is not null and n + n2 >= 25
      union all select doc_id, i, 3, [line, line2, line3] from t where line3 is not null),
w as (select doc_id, i, k, row_number() over (partition by run order by doc_id, i) as rn from r),
gone as (select distinct doc_id, unnest(range(i, i + k)) as i from w where rn > 1),
k as (select doc_id, string_agg(line, chr(10) order by i) as text from e anti join gone using (doc_id, i) group by doc_id),
c as (select doc_id, count(*)::int as n from gone group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text, coalesce(c.n, 0) as n_deleted
from documents d left join k on d.doc_id = k.doc_id left join c on d.doc_id = c.doc_id
"""
