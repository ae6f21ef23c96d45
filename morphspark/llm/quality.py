"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shares of kinds of bytes, lengths and
repeats, its own and those of the lines before and after. Forward-backward
gives each line's marginal; a document's quality is their mean by length.

Only documents are labelled, so the labels of lines are latent: a label bounds
the mean of its lines, and expectation-maximisation finds the rest. So that the
chain learns where good and bad meet, as many documents again are made by
setting a stretch of one into another; each stretch keeps its bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import _SPACE, chunks, ragged, row_sums, ws_words
from .line_dedup import line_hashes, lines

MOST_TRAINING = 4_000
#: Labelled documents of more lines are left out of the training.
MOST_LINES = 2_000
#: Least mean of the lines of a good document, most of a bad one.
HIGH, LOW = 0.85, 0.15
CHUNK = 4 << 20

_KINDS = np.zeros((256, 8), np.float32)
_KINDS[65:91, 0] = _KINDS[97:123, 1] = _KINDS[48:58, 2] = _KINDS[_SPACE, 3] = _KINDS[128:, 4] = 1
_KINDS[[*b".,;:'\"()-?"], 5] = 1
_KINDS[[*b"!*&%$#"], 6] = 1
_KINDS[[*b"|<>{}[]\\/=_~^+@`"], 7] = 1
_KIND = (_KINDS * np.arange(1, 9)).sum(1).astype(np.uint8)
N_OWN = 19


def features(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of its own features for each line, its length in bytes but spaces, first line of each row and the total)."""
    s, e, rows = lines(b, offsets)
    n = (e - s).astype(np.float64)
    kind = _KIND[b]
    x = np.zeros((len(s), N_OWN), np.float32)
    at = np.empty(2 * len(s), np.int64)
    at[::2], at[1::2] = s, e
    pad = np.zeros(len(b) + 1, np.int32)
    size = np.maximum(n, 1)
    for k in range(8):
        pad[:-1] = kind == k + 1
        x[:, k] = np.where(n > 0, np.add.reduceat(pad, at)[::2], 0) / size
    words = np.zeros(len(b) + 1, np.int32)
    words[:-1] = (kind != 4) & (np.concatenate([[4], kind[:-1]]) == 4)
    words = np.where(n > 0, np.add.reduceat(words, at)[::2], 0)
    last = b[np.maximum(e - 1, 0)] if len(b) else np.zeros(len(s), np.uint8)
    first = b[np.minimum(s, len(b) - 1)] if len(b) else np.zeros(len(s), np.uint8)
    some = n > 0
    h = line_hashes(b, s, e)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((h, row))
    twin = np.zeros(len(s), bool)
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    x[:, 8] = np.log1p(n) / 8
    x[:, 9] = np.log1p(words) / 6
    x[:, 10] = np.minimum(n / np.maximum(words, 1), 40) / 10
    x[:, 11] = some & (last == 46)
    x[:, 12] = some & (first >= 65) & (first < 91)
    x[:, 13] = ~some
    x[:, 14] = twin & some
    x[:, 15] = x[:, 0] > 0.5
    x[:, 16] = x[:, 6] > 0.05
    x[:, 17] = x[:, 7] > 0.03
    h, ws, _, _ = ws_words(b, offsets)
    if len(h):  # words that repeat the one before
        again = np.zeros(len(h) + 1, np.int32)
        again[1:-1] = h[1:] == h[:-1]
        at = np.searchsorted(ws, np.append(s, len(b)))
        total = np.concatenate([[0], np.cumsum(again[:-1])])
        x[:, 18] = (total[at[1:]] - total[at[:-1]]) / np.maximum(words, 1)
    return x, np.rint(n - x[:, 3] * n), rows


def with_neighbours(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The features of each line, of the ones before and after it, and a one. No row is empty."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[rows[:-1]] = 0
    after[rows[1:] - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1), x.dtype)])


def marginals(u: np.ndarray, rows: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(good) of each line by forward-backward on the odds of good to bad; with pairs, also the expected transitions.

    u: score of good over bad of each line; trans: 2 x 2 scores, from and to.
    """
    t = np.exp(trans)
    w = np.exp(np.clip(u, -25, 25))
    n = np.diff(rows)
    order = np.argsort(-n, kind="stable")
    start, size = rows[:-1][order], n[order]
    fore, back = np.empty(len(u)), np.empty(len(u))
    most = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, most + 1), side="right")  # rows with more than k lines
    a = np.ones(0)
    for k in range(most):
        i = start[: live[k]] + k
        a = w[i] if k == 0 else w[i] * (a[: live[k]] * t[1, 1] + t[0, 1]) / (a[: live[k]] * t[1, 0] + t[0, 0])
        fore[i] = a
    c = np.ones(0)
    for k in range(most - 1, -1, -1):
        i = start[: live[k]] + k
        m = len(c)
        c = np.concatenate([c, np.ones(live[k] - m)])
        back[i] = c
        g = w[i] * c
        c = (t[1, 1] * g + t[1, 0]) / (t[0, 1] * g + t[0, 0])
    odds = fore * back
    p = odds / (1 + odds)
    if not pairs:
        return p
    inner = np.ones(len(u), bool)
    inner[rows[:-1][n > 0]] = False
    j = np.flatnonzero(inner)
    f, g = fore[j - 1], w[j] * back[j]
    cell = np.stack([np.full(len(j), t[0, 0]), t[0, 1] * g, t[1, 0] * f, t[1, 1] * f * g])
    return p, (cell / cell.sum(0)).sum(1).reshape(2, 2)


def spliced(rows: np.ndarray, y: np.ndarray, seed: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lines, row offsets, stretch of each line, label of each stretch) of the documents and of as many made ones, each with a stretch of a document of the other label inside or at an end."""
    g = np.random.default_rng(seed)
    at, ends, stretch, label = [], [0], [], []

    def add(parts: list[tuple[int, int, int]]) -> None:
        for a, b, k in parts:
            if b > a:
                at.append(np.arange(a, b))
                stretch.append(np.full(b - a, len(label)))
                label.append(k)
        ends.append(sum(map(len, at[-len(parts) :])) + ends[-1] if parts else ends[-1])

    def one(parts: list[tuple[int, int, int]]) -> None:
        add([p for p in parts if p[1] > p[0]])

    for d in range(len(y)):
        one([(rows[d], rows[d + 1], y[d])])
    other = [np.flatnonzero(y != k) for k in (0, 1)]
    for d in range(len(y)):
        if not len(other[y[d]]):
            continue
        e = g.choice(other[y[d]])
        n, m = rows[d + 1] - rows[d], rows[e + 1] - rows[e]
        size = int(g.integers(1, min(m, 12) + 1))
        start = rows[e] + int(g.integers(0, m - size + 1))
        cut = rows[d] + int(g.integers(0, n + 1))
        one([(rows[d], cut, y[d]), (start, start + size, y[e]), (cut, rows[d + 1], y[d])])
    return np.concatenate(at), np.array(ends), np.concatenate(stretch), np.array(label)


class Field:
    """The trained field: weights of the features and transition scores.

    x: own features of the lines of the training documents, n: their lengths,
    rows: offsets of documents, y: labels of documents.
    """

    def __init__(self, x: np.ndarray, n: np.ndarray, rows: np.ndarray, y: np.ndarray, rounds: int = 6, steps: int = 20, decay: float = 1e-3):
        self.w, self.trans = np.zeros(3 * N_OWN + 1), np.zeros((2, 2))
        if not len(y):
            return
        at, rows, stretch, label = spliced(rows, y)
        x, n = with_neighbours(x[at], rows), n[at] + 1e-3
        total = np.bincount(stretch, weights=n)
        m, v, turn = np.zeros(len(self.w) + 4), np.zeros(len(self.w) + 4), 0

        def climb(q: np.ndarray, pairs: np.ndarray, many: int) -> None:
            nonlocal m, v, turn
            for _ in range(many):
                turn += 1
                p, model = marginals(x @ self.w, rows, self.trans, True)
                g = np.concatenate([x.T @ (q - p), (pairs - model).ravel()]) / len(q) - decay * np.concatenate([self.w, self.trans.ravel()])
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                step = 0.08 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
                self.w += step[:-4]
                self.trans += step[-4:].reshape(2, 2)

        first = label[stretch].astype(np.float64)  # at first all lines are what their document is
        inner = np.ones(len(first), bool)
        inner[rows[:-1]] = False
        j = np.flatnonzero(inner)
        climb(first, np.bincount(label[stretch][j - 1] * 2 + label[stretch][j], minlength=4).reshape(2, 2), 3 * steps)
        for _ in range(rounds):
            climb(*self._expected(x @ self.w, rows, n, stretch, label, total), steps)

    def _expected(self, u, rows, n, stretch, label, total):
        """(P(good) of each line, expected transitions), with a score added to each stretch where its mean would break its bound."""
        low, high = np.zeros(len(label)), np.where(label == 1, 12.0, -12.0)
        mean = lambda p: np.bincount(stretch, weights=p * n) / total
        kept = lambda p: np.where(label == 1, mean(p) >= HIGH, mean(p) <= LOW)
        free = kept(marginals(u, rows, self.trans))
        for _ in range(10):
            mid = (low + high) / 2
            ok = kept(marginals(u + np.where(free, 0.0, mid)[stretch], rows, self.trans))
            low, high = np.where(ok, low, mid), np.where(ok, mid, high)
        return marginals(u + np.where(free, 0.0, high)[stretch], rows, self.trans, True)

    def lines(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good), length, row offsets) of the lines of a flat buffer."""
        x, n, rows = features(b, offsets)
        own, before, after = (x @ self.w[:-1].reshape(3, N_OWN).T.astype(np.float32)).astype(np.float64).T
        u = own + self.w[-1]
        inner = np.ones(len(u), bool)
        inner[rows[:-1]] = False
        j = np.flatnonzero(inner)
        u[j] += before[j - 1]
        u[j - 1] += after[j]
        return marginals(u, rows, self.trans), n, rows

    def quality(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(quality, lines, bad lines) of each text; NaN of one without a byte that is no space."""
        out = []
        for _, _, b, o in chunks(text, CHUNK):
            p, n, rows = self.lines(b, o)
            total = row_sums(n, rows)
            with np.errstate(invalid="ignore", divide="ignore"):
                out.append((row_sums(p * n, rows) / total, np.diff(rows), row_sums(((p < 0.5) & (n > 0)).astype(np.int64), rows)))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_training: int = MOST_TRAINING) -> Field:
    """A field fitted to at most most_training labelled documents, half of each label, picked by a hash of the id; of those, the ones of at most MOST_LINES lines."""
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)").dropDuplicates(["id"])
    half = [named.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most_training // 2) for y in (0, 1)]
    some = F.broadcast(half[0].union(half[1]))  # at most most_training rows
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null").join(some, "id").select("y", "text")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, o in chunks(batch.column(1), CHUNK):
                x, n, rows = features(b, o)
                size = np.diff(rows)
                few = np.flatnonzero((size <= MOST_LINES) & (row_sums(n, rows) > 0))
                pick = np.repeat(np.isin(np.arange(len(size)), few), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(few)), ragged(np.hstack([x, n[:, None]])[pick].ravel(), size[few] * (N_OWN + 1), pa.float32())], ["y", "x"])

    t = text.mapInArrow(collect, "y int, x array<float>").toArrow()
    if not len(t):
        return Field(np.zeros((0, N_OWN)), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int64))
    size = np.array([len(v) // (N_OWN + 1) for v in t.column("x")])
    x = np.concatenate([v.values.to_numpy(zero_copy_only=False) for v in t.column("x")]).reshape(-1, N_OWN + 1).astype(np.float64)
    return Field(x[:, :-1], x[:, -1], np.concatenate([[0], np.cumsum(size)]), np.array(t.column("y").to_pylist()))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, most_training: int = MOST_TRAINING) -> DataFrame:
    """(doc_id, quality, n_lines, n_bad_lines, good) of every row.

    quality is the mean probability of a good line, weighted by length without
    spaces. Ids are whole numbers. A null or empty text, or one of blank lines
    only, has a null quality and isn't
    good. Repeated rows get equal results; null ids are carried. Without
    labels every probability is one half. An empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, most_training))

    @F.arrow_udf("struct<q: double, n: long, bad: long>")
    def judge(text: pa.Array) -> pa.Array:
        q, n, bad = held.value.quality(text)
        return pa.StructArray.from_arrays([pa.array(q, pa.float64(), from_pandas=True), pa.array(n.astype(np.int64)), pa.array(bad.astype(np.int64))], ["q", "n", "bad"])

    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), judge(F.col(f"`{text_col}`")).alias("x"))
    return out.select("doc_id", F.col("x.q").alias("quality"), F.col("x.n").alias("n_lines"), F.col("x.bad").alias("n_bad_lines"), (F.coalesce(F.col("x.q"), F.lit(-1.0)) >= threshold).alias("good"))
