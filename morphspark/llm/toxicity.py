"""Toxicity by weak supervision.

Lexicon and pattern voters fire or don't on each document. Besides the lexicons
written here there is one of stems, word beginnings that a bounded sample of
labelled documents repeats when toxic and hardly otherwise. A generative label
model, a latent class with a tree of dependences between voters, is fitted by
expectation-maximisation to the counts of all vote patterns in the corpus: it
estimates each voter's accuracy and which voters only repeat each other. A
linear classifier on hashed words and repeated beginnings of words is then trained on the posterior labels of a
bounded sample, and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._text import _LETTER, chunks, hashes, lower, lower_words, mix, prefix_hashes, ragged, row_sums, spans, word_hash

LEXICON = {
    "mind": "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile imbeciles dimwit halfwit brainless braindead cretin simpleton dolt nitwit dumm dummkopf trottel depp blöd blödmann imbécile débile crétin idiote estúpido estúpida tonto imbécil tarado",
    "worth": "worthless pathetic loser losers useless failure nobody spineless wertlos versager nichtsnutz erbärmlich raté minable incapable inútil fracasado patético perdedor",
    "filth": "scum trash garbage filth filthy vermin scumbag scumbags dirtbag sleaze parasite maggot abschaum müll ungeziefer ordure racaille vermine basura escoria",
    "mock": "clown clowns buffoon laughingstock joker freak weirdo witzfigur bouffon guignol payaso payasa",
    "disgust": "disgusting revolting vile repulsive despicable nauseating sickening loathsome ekelhaft widerlich abstoßend dégoûtant répugnant asqueroso repugnante",
    "profane": "shit shitty bullshit fuck fucking fucker asshole bastard bitch crap damn dick piss scheiße arschloch merde putain connard salope mierda puta cabrón",
    "threat": "kill hate destroy hurt stab strangle murder töten hassen umbringen tuer haïr matar odiar",
}
YOU = "you your youre ur u du dich dein euch tu toi vous ton te usted"
VOTERS = [*LEXICON, "several", "distinct", "dense", "disguised", "direct", "stems"]
BUCKET_BITS = 18
MOST_TRAINING = 8_000
MOST_LABELLED, MOST_STEMS = 4_000, 4_000
STEMS = (4, 5, 6, 7, 8)  # bytes
REPEATED = (5, 7)
#: A word beginning also counts if it comes so many times in a stretch of so many words, however long the text.
CROWD, STRETCH = 4, 250
#: Candidates for the training sample are drawn so many times as often as would do if voters fired on all documents.
OVERDRAW = 32
NO_STEMS = np.zeros(0, np.uint64)

_GROUPS = {word_hash(w): k for k, words in enumerate(LEXICON.values()) for w in words.split()}
_HASH = np.array(sorted(_GROUPS), np.uint64)
_GROUP = np.array([_GROUPS[int(h)] for h in _HASH])
_YOU = np.sort(np.array([word_hash(w) for w in YOU.split()], np.uint64))
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$!", b"oieastasi"):
    _LEET[_a] = _b
_FIRST = np.zeros(1 << 16, bool)
_FIRST[(_HASH & np.uint64(0xFFFF)).astype(np.int64)] = True


def _lookup(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of lexicon words, their entries)."""
    at = np.flatnonzero(_FIRST[(h & np.uint64(0xFFFF)).astype(np.int64)])
    k = np.minimum(np.searchsorted(_HASH, h[at]), len(_HASH) - 1)
    hit = _HASH[k] == h[at]
    return at[hit], k[hit]


def _often(b: np.ndarray, words, sizes: tuple[int, ...], least: int, words_each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, times) of the word beginnings that a row has `least` times or more, and once in words_each words at least or crowded in a stretch."""
    _, s, e, rows = words
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    out = []
    for h in prefix_hashes(lower(b), s, e, sizes):
        at = np.flatnonzero(h)
        at = at[np.lexsort((h[at], row[at]))]
        first = np.flatnonzero(np.concatenate([[True], (h[at][1:] != h[at][:-1]) | (row[at][1:] != row[at][:-1])])) if len(at) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(at)))
        r = row[at[first]]
        close = np.zeros(len(at) + 1, np.int64)  # crowds that begin at each occurrence
        if len(at) >= CROWD:
            i = np.arange(len(at) - CROWD + 1)
            close[i] = (at[i + CROWD - 1] - at[i] < STRETCH) & (np.searchsorted(first, i, side="right") == np.searchsorted(first, i + CROWD - 1, side="right"))
        crowded = np.add.reduceat(close, first) > 0 if len(first) else np.zeros(0, bool)
        ok = (times >= least) & ((times * words_each >= np.diff(rows)[r]) | crowded)
        out.append((r[ok], h[at[first]][ok], times[ok]))
    return tuple(np.concatenate(x) for x in zip(*out))


def stems(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = MOST_LABELLED) -> np.ndarray:
    """Hashes of the word beginnings that toxic documents repeat and others don't, from at most most_labelled labelled documents, half of each label; at most MOST_STEMS, the surest."""
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)").dropDuplicates(["id"])
    half = [named.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most_labelled // 2) for y in (0, 1)]
    some = F.broadcast(half[0].union(half[1]))  # at most most_labelled rows
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null").join(some, "id").select("y", "text")

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, b, o in chunks(batch.column(1)):
                row, h, _ = _often(b, lower_words(b, o), STEMS, 3, 250)
                yield pa.RecordBatch.from_arrays([pa.array(y[i + row], pa.int32()), pa.array(h.view(np.int64))], ["y", "h"])
                yield pa.RecordBatch.from_arrays([pa.array(y[i : i + len(o) - 1], pa.int32()), pa.array(np.zeros(len(o) - 1, np.int64))], ["y", "h"])  # each document once

    n = text.mapInArrow(repeated, "y int, h long").groupBy("h").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    every = n.where("h = 0").first()
    if not every or not every.a or not every.b:
        return NO_STEMS
    na, nb = float(every.a), float(every.b)
    term = lambda x, share: F.when(x > 0, x * F.log(x / ((F.col("a") + F.col("b")) * share))).otherwise(0.0)
    sure = 2 * (term(F.col("a"), na / (na + nb)) + term(F.col("b"), nb / (na + nb)))
    found = n.where("h <> 0 and a >= 4").where(F.col("a") / na > 10 * F.col("b") / nb).withColumn("g", sure).where("g >= 14").orderBy(F.desc("g"), "h").limit(MOST_STEMS).collect()
    return np.sort(np.array([r.h for r in found], np.int64).view(np.uint64))


def votes(b: np.ndarray, offsets: np.ndarray, words=None, known: np.ndarray = NO_STEMS) -> np.ndarray:
    """A bit for each voter that fires, for each row."""
    h, s, e, rows = words or lower_words(b, offsets)
    n = len(offsets) - 1
    at, entry = _lookup(h)
    out = np.zeros(n, np.int64)
    row = np.searchsorted(rows, at, side="right") - 1
    np.bitwise_or.at(out, row, 1 << _GROUP[entry])
    total = np.bincount(row, minlength=n)
    kinds = np.bincount(np.unique(row * len(_HASH) + entry) // len(_HASH), minlength=n)
    m, size = len(LEXICON), np.diff(rows)
    if len(known):  # a stem may turn up by chance: the first doesn't count, nor do few in a long text
        hit = np.zeros(len(h), bool)
        for x in prefix_hashes(lower(b), s, e, STEMS):
            hit |= known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
        where = np.flatnonzero(hit)
        of = np.searchsorted(rows, where, side="right") - 1
        times = np.bincount(of, minlength=n)
        crowd = np.zeros(n, bool)
        if len(where) >= CROWD:
            close = (where[CROWD - 1 :] - where[: 1 - CROWD] < STRETCH) & (of[CROWD - 1 :] == of[: 1 - CROWD])
            crowd[of[: 1 - CROWD][close]] = True
        times = np.where((times >= 2) & ((times * 120 >= size) | crowd), times, 0)
        out |= (times > 0).astype(np.int64) << (m + 5)
        total, kinds = total + np.maximum(times - 1, 0), kinds + times // 2
    out |= (total >= 2).astype(np.int64) << m
    out |= (kinds >= 2).astype(np.int64) << (m + 1)
    out |= ((total > 0) & (total * 50 >= size)).astype(np.int64) << (m + 2)
    odd = np.zeros(256, bool)
    odd[[*b"013457@$!"]] = True
    if odd[b].any():  # words with digits or signs in place of letters
        o_s, o_e, o_rows = spans(b, offsets, ~(_LETTER | odd))
        inner = np.concatenate([[0], np.cumsum(odd[b])])
        letters = np.concatenate([[0], np.cumsum(_LETTER[b] & ~odd[b])])
        some = np.flatnonzero((inner[o_e] > inner[o_s]) & (letters[o_e] > letters[o_s]))
        if len(some):
            plain = hashes(_LEET[lower(b)], o_s[some], o_e[some])
            found, _ = _lookup(plain)
            strict = found[(plain[found] != hashes(lower(b), o_s[some][found], o_e[some][found]))] if len(found) else found
            np.bitwise_or.at(out, np.searchsorted(o_rows, some[strict], side="right") - 1, 1 << (m + 3))
    if len(at):
        direct = np.zeros(len(at), bool)
        for back in (1, 2, 3):
            p = at - back
            ok = p >= rows[row]
            q = h[np.maximum(p, 0)]
            k = np.minimum(np.searchsorted(_YOU, q), len(_YOU) - 1)
            direct |= ok & (_YOU[k] == q)
        np.bitwise_or.at(out, row[direct], 1 << (m + 4))
    return out


class LabelModel:
    """A latent class (toxic or not) over binary voters; a voter may depend on one other besides the class."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
        v = (patterns[:, None] >> np.arange(len(VOTERS))) & 1
        self.parent = np.full(v.shape[1], -1)
        p = np.where(v[:, : len(LEXICON)].any(1) | v[:, [len(LEXICON), len(LEXICON) + 3]].any(1), 0.9, 0.01)
        self._fit(v, counts, p, rounds)
        self.parent = self._tree(v, counts, self.posterior(v))
        self._fit(v, counts, self.posterior(v), rounds)

    def _state(self, v: np.ndarray) -> np.ndarray:
        return np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0)

    def _fit(self, v: np.ndarray, counts: np.ndarray, p: np.ndarray, rounds: int) -> None:
        last = -np.inf
        for _ in range(rounds):
            w = np.stack([counts * (1 - p), counts * p])
            self.prior = np.clip(w.sum(1) / max(1e-9, w.sum()), 1e-6, 1)
            up = self._state(v)
            self.rate = np.empty((2, 2, v.shape[1]))  # by class and by the parent's vote
            for s in (0, 1):
                of = w[:, :, None] * (up == s)[None]
                self.rate[:, s] = ((of * v[None]).sum(1) + 0.05) / (of.sum(1) + 0.1 + 1e-9)
            p, like = self._posterior(v)
            now = float((counts * like).sum())
            if now - last < 1e-9 * max(1.0, abs(now)):
                break
            last = now
        if self.rate[1, 0].sum() + self.rate[1, 1].sum() < self.rate[0, 0].sum() + self.rate[0, 1].sum():  # the class that fires more is the toxic one
            self.rate, self.prior = self.rate[::-1], self.prior[::-1]

    def _posterior(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.clip(np.where(self._state(v)[None] == 1, self.rate[:, 1][:, None, :], self.rate[:, 0][:, None, :]), 1e-6, 1 - 1e-6)
        s = np.log(self.prior)[:, None] + np.where(v[None] == 1, np.log(r), np.log(1 - r)).sum(2)
        top = s.max(0)
        like = top + np.log(np.exp(s - top).sum(0))
        return np.exp(s[1] - like), like

    def posterior(self, v: np.ndarray) -> np.ndarray:
        return self._posterior(v)[0]

    def _tree(self, v: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The spanning forest of the strongest dependences within the classes."""
        m = v.shape[1]
        info = np.zeros((m, m))
        for w in (counts * (1 - p), counts * p):
            n = w.sum()
            if n < 50:
                continue
            for a in range(m):
                for b in range(a):
                    for x in (0, 1):
                        for y in (0, 1):
                            xy = (w * (v[:, a] == x) * (v[:, b] == y)).sum() / n
                            xx, yy = (w * (v[:, a] == x)).sum() / n, (w * (v[:, b] == y)).sum() / n
                            if xy > 0:
                                info[a, b] += xy * np.log(xy / (xx * yy)) * n / counts.sum()
        info += info.T
        parent, inside = np.full(m, -1), {0}
        while len(inside) < m:
            a, b = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda e: info[e])
            parent[b] = a if info[a, b] > 1e-4 else -1
            inside.add(b)
        return parent


def _features(b: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the words and repeated word beginnings of each row, and their numbers."""
    h, _, _, rows = words
    row = np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows))
    r, x, times = _often(b, words, REPEATED, 2, 120)
    more = times > 2
    row = np.concatenate([row, r.astype(np.uint64), r[more].astype(np.uint64)])
    h = np.concatenate([h, mix(x + np.uint64(2)), mix(x[more] + np.uint64(3))])
    u = np.unique(row << np.uint64(BUCKET_BITS) | h >> np.uint64(64 - BUCKET_BITS))
    return (u & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int32), np.bincount((u >> np.uint64(BUCKET_BITS)).astype(np.int64), minlength=len(rows) - 1)


def fit_linear(rows: list[np.ndarray], target: np.ndarray, penalty: float = 3e-4, steps: int = 200, least: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on sets of buckets, by accelerated proximal gradient. Buckets of fewer than `least` rows have weight 0."""
    out = np.zeros(1 << BUCKET_BITS, np.float32)
    x = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    df = np.bincount(x, minlength=len(out))
    least = min(least, max(1, len(rows) // 20))
    row, x = row[df[x] >= least], x[df[x] >= least]
    used, x = np.unique(x, return_inverse=True)
    n, m = len(rows), len(used)
    if not m:
        return out, -10.0
    scale = np.minimum(np.sqrt(n / df[used]), 10.0)  # rare words move as easily as frequent ones
    times = lambda w: np.bincount(row, weights=(w * scale)[x], minlength=n)
    back = lambda g: np.bincount(x, weights=g[row], minlength=m) * scale
    v = np.ones(m)
    for _ in range(12):  # the largest curvature, by power iteration
        v = back(times(v)) / n
        curve = np.linalg.norm(v)
        v /= max(curve, 1e-12)
    step = 1 / (0.25 * curve * 1.05 + 0.25)
    base = float(np.clip(target.mean(), 1e-4, 1 - 1e-4))
    w, z, t = np.zeros(m), np.zeros(m), 1.0
    b = zb = np.log(base / (1 - base))
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(times(z) + zb, -30, 30))) - target
        new = z - step * back(g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = zb - step * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    out[used] = w * scale
    return out, float(b)


class Model:
    """The trained classifier."""

    def __init__(self, weights: np.ndarray, bias: float, labels: LabelModel | None):
        self.weights, self.bias, self.labels = weights, bias, labels

    def score(self, text: pa.Array) -> np.ndarray:
        out = []
        for _, _, b, o in chunks(text):
            f, n = _features(b, lower_words(b, o))
            out.append(row_sums(self.weights[f].astype(np.float64), np.concatenate([[0], np.cumsum(n)])))
        s = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(s + self.bias, -30, 30)))


def train(docs: DataFrame, text_col: str = "text", most_training: int = MOST_TRAINING, labels: DataFrame | None = None, id_col: str = "doc_id") -> Model:
    """Label model from the votes on all documents, classifier from at most about most_training of them, picked by a hash of the text: half from documents on which no voter fires. One pass counts the votes and draws candidates; the sample is taken from those when the counts are known. Of documents on which a voter fires fewer are taken if those are less than one in OVERDRAW."""
    text = docs.select(F.col(f"`{text_col}`").alias("text")).where("text is not null")
    known = NO_STEMS if labels is None else stems(docs, labels, id_col, text_col)

    share = min(1.0, most_training / 2 / max(1, docs.count()))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pattern, documents, null, null) of each batch, and (pattern, null, draw, features) of candidates for the sample."""
        for batch in batches:
            every = []
            for _, _, b, o in chunks(batch.column(0)):
                words = lower_words(b, o)
                v = votes(b, o, words, known)
                every.append(v)
                h, _, _, rows = words
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
                draw = ((total[rows[1:]] - total[rows[:-1]]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2**53
                at = np.flatnonzero(draw < share * np.where(v != 0, OVERDRAW, 4))
                if len(at):
                    cut = np.repeat(np.isin(np.arange(len(v)), at), np.diff(o))  # features of those alone
                    size = np.diff(o)[at]
                    few = np.concatenate([[0], np.cumsum(size)])
                    f, n = _features(b[cut], lower_words(b[cut], few))
                    yield pa.RecordBatch.from_arrays([pa.array(v[at]), pa.nulls(len(at), pa.int64()), pa.array(draw[at]), ragged(f, n, pa.int32())], ["p", "n", "draw", "f"])
            p, n = np.unique(np.concatenate(every) if every else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(n.astype(np.int64)), pa.nulls(len(p), pa.float64()), pa.nulls(len(p), pa.list_(pa.int32()))], ["p", "n", "draw", "f"])

    voted = Scratch(docs.sparkSession, "toxicity").table(text.mapInArrow(vote, "p long, n long, draw double, f array<int>"))
    found = voted.where("n is not null").groupBy("p").agg(F.sum("n").alias("n")).collect()  # at most 2 ** voters rows
    if not found:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), -10.0, None)
    patterns, counts = np.array([r.p for r in found]), np.array([float(r.n) for r in found])
    labels = LabelModel(patterns, counts)
    post = dict(zip(patterns.tolist(), labels.posterior((patterns[:, None] >> np.arange(len(VOTERS))) & 1)))
    fires = patterns != 0
    rate = [min(1.0, most_training / 2 / max(1.0, counts[of].sum())) for of in (~fires, fires)]
    t = voted.where(F.col("f").isNotNull() & (F.col("draw") < F.when(F.col("p") == 0, rate[0]).otherwise(rate[1]))).select("p", "f").toArrow()  # about most_training rows
    if not len(t):
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), -10.0, labels)
    rows = [np.asarray(x, np.int32) for x in t.column("f").to_pylist()]
    weights, bias = fit_linear(rows, np.array([post.get(p, 0.0) for p in t.column("p").to_pylist()]))
    return Model(weights, bias, labels)


def _scorer(docs: DataFrame, model: Model):
    held = docs.sparkSession.sparkContext.broadcast(Model(model.weights, model.bias, None))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(held.value.score(text))

    return score


def toxicity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, most_training: int = MOST_TRAINING, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, toxic) of every row.

    Whole texts are scored. Ids are whole numbers where labels are given. A null, empty or wordless text has no evidence
    and is not toxic. Repeated rows get equal scores; null ids are carried. An
    empty table gives an empty one. At most about most_training documents
    train the classifier; the label model's counts cover all. labels (the id,
    toxic) serve to find stems; without them there are none.
    """
    score = _scorer(docs, train(docs, text_col, most_training, labels, id_col))
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), score(F.col(f"`{text_col}`")).alias("score"))
    return out.withColumn("toxic", F.col("score") >= threshold)


def drop_toxic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, most_training: int = MOST_TRAINING, labels: DataFrame | None = None) -> DataFrame:
    """The rows that toxicity() doesn't call toxic, in the columns of the input.

    Null, empty and wordless texts stay, null ids too; repeated rows stay or go
    together. An empty table gives an empty one.
    """
    score = _scorer(docs, train(docs, text_col, most_training, labels, id_col))
    return docs.where(score(F.col(f"`{text_col}`")) < threshold)

