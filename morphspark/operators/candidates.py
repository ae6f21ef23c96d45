"""What goes into a lattice, as columns: runs of classes, places where words may begin, dictionary and unknown words.

Row by row in pieces of Arrow batches: nothing is shuffled, whatever the length of texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from morphspark.functions.chars import JOINED, NO_START, NO_START2, CharTable
from morphspark.functions.kernel import BARRED, Text
from morphspark.sources.dictionary import Dictionary

from .pieces import text_function
from .relational import small

__all__ = ["begin_places", "class_runs", "small", "unknown_candidates", "word_candidates"]


def _column(text: Column | str) -> Column:
    return text if isinstance(text, Column) else F.col(f"`{text}`")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Masks:
    """Masks of arrays of code points: a table for the first plane, bisection beyond."""

    def __init__(self, ranges: list[tuple[int, int, int]]):
        table = CharTable(ranges)
        self.starts = np.array(table.starts, np.uint32)
        self.masks = np.array([r[2] for r in table.ranges], np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        return self.masks[np.searchsorted(self.starts, codes, side="right") - 1]


def class_runs(ranges: list[tuple[int, int, int]], text: Column | str) -> Column:
    """array<struct<begin, end, mask>>: the longest stretches of one mask; null of null."""
    masks = _Masks(ranges)

    @text_function("array<struct<`begin`: int, `end`: int, mask: bigint>>")
    def run(texts: list[str | None]) -> pa.Array:
        sizes, begin, end, mask, n = [], [], [], [], 0
        for x in texts:
            sizes.append(None if x is None else n)
            if x:
                m = masks(_codes(x))
                edge = np.concatenate([[0], np.flatnonzero(np.diff(m)) + 1, [len(m)]])
                begin.append(edge[:-1])
                end.append(edge[1:])
                mask.append(m[edge[:-1]])
                n += len(edge) - 1
        flat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        inner = pa.StructArray.from_arrays([flat(begin, pa.int32()), flat(end, pa.int32()), flat(mask, pa.int64())], ["begin", "end", "mask"])
        return pa.ListArray.from_arrays(pa.array([*sizes, n], pa.int32()), inner)

    return run(_column(text))


def begin_places(ranges: list[tuple[int, int, int]], text: Column | str) -> Column:
    """array<int>: the characters at which a word may begin; null of null."""
    masks = _Masks(ranges)

    @text_function("array<int>")
    def run(texts: list[str | None]) -> pa.Array:
        sizes, out, n = [], [], 0
        for x in texts:
            sizes.append(None if x is None else n)
            if x:
                m = masks(_codes(x))
                before = np.concatenate([[0], m[:-1]])
                ok = (m & (NO_START | NO_START2) == 0) & ~((m & JOINED != 0) & (m & before != 0))
                barred = False  # after a joiner that isn't itself barred
                for i in np.flatnonzero(m & NO_START2):
                    if barred and i == last + 1:
                        barred = False
                        continue
                    if i + 1 < len(m):
                        ok[i + 1] = False
                    barred, last = True, i
                at = np.flatnonzero(ok)
                out.append(at)
                n += len(at)
        return pa.ListArray.from_arrays(pa.array([*sizes, n], pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int32()))

    return run(_column(text))


def _nodes(dictionary: Dictionary, text: Column | str, of: Callable) -> Column:
    held = dictionary.broadcast()

    @text_function("array<struct<`begin`: int, `end`: int, word_id: bigint, left_id: int, right_id: int, cost: int>>")
    def run(texts: list[str | None]) -> pa.Array:
        d, sizes, flat = held.value, [], []
        for x in texts:
            sizes.append(None if x is None else len(flat))
            if x:
                flat += of(d, x)
        cols = list(zip(*flat)) or [()] * 6
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        inner = pa.StructArray.from_arrays([pa.array(cols[k], t) for k, t in zip((0, 1, 5, 2, 3, 4), kinds)], ["begin", "end", "word_id", "left_id", "right_id", "cost"])
        return pa.ListArray.from_arrays(pa.array([*sizes, len(flat)], pa.int32()), inner)

    return run(_column(text))


def word_candidates(dictionary: Dictionary, text: Column | str) -> Column:
    """array<struct<begin, end, word_id, left_id, right_id, cost>>: every word at every place, in the order of the lattice, without normalisation."""

    def of(d, x: str) -> list[tuple]:
        starts = {c for lengths in d.lengths for c in lengths}
        return [(i, *w) for i, c in enumerate(x) if c in starts for w in d.found(x, i)]

    return _nodes(dictionary, text, of)


def unknown_candidates(dictionary: Dictionary, text: Column | str) -> Column:
    """The same of the unknown words that the providers propose at every place where one may stand."""

    def of(d, x: str) -> list[tuple]:
        t, out = Text(x, d.table), []
        for i in range(len(x)):
            if t.masks[i] & BARRED:
                continue
            ends = {w[0] for w in d.found(x, i) if w[0] == len(x) or t.bow[w[0]]}
            for p in d.unknown:
                more = p.propose(t, i, ends)
                out += [(i, *w) for w in more]
                ends |= {w[0] for w in more}
        return out

    return _nodes(dictionary, text, of)
