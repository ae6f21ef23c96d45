"""Personal data by a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy on labelled spans: texts in which addresses,
numbers and keys of many shapes are set between invented words. Whole texts are
read in overlapping windows. Where two overlap their scores are averaged, more
weight on the one that shows more around, and one best path is taken over the
whole text. Only stretches whose scores make up for the transitions that a span costs can
hold one, so the path need be searched only there.

`python -m morphspark.llm.pii` trains the network and saves its weights beside
this module; they are read from there.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import chunks

KINDS = ["EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN"]
TAGS = len(KINDS) + 1  # 0: none
HIDDEN = 8
WINDOW, OVERLAP = 768, 96
TRAINING = 6_000
WEIGHTS = Path(__file__).with_name("pii_weights.npz")

# Characters: printable ASCII each for itself, then other small letters, capitals, digits, white space, all else.
_CLASS = np.full(0x110000 >> 0, 104, np.uint8)
_CLASS[32:127] = np.arange(95)
_CLASS[[9, 10, 11, 12, 13, 0xA0]] = 103
for _c in range(128, 0x3000):
    _s = chr(_c)
    if _s.isalpha():
        _CLASS[_c] = 101 if _s.isupper() else 100
    elif _s.isdigit():
        _CLASS[_c] = 102
_CLASS[0x3000:0x11000] = 100
VOCABULARY = 105


def _word(r: random.Random) -> str:
    parts = r.choice([("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "tion", "ing", "ly", "ble"), ("qu", "eau", "é", "è", "ment", "le", "la", "ou", "ai", "ç", "tion", "en", "oi", "ier"), ("sch", "ein", "ung", "keit", "er", "ä", "ö", "ü", "ß", "lich", "ich", "be", "ge", "zu"), ("ción", "ado", "que", "ñ", "í", "ó", "mente", "os", "as", "rr", "ll", "es", "ar", "ja"), tuple("abcdefghijklmnopqrstuvwxyz")])
    w = "".join(r.choice(parts) for _ in range(r.choice([1, 1, 2, 2, 3, 3, 4, 5, 6])))
    x = r.random()
    return w.capitalize() if x < 0.12 else w.upper() if x < 0.2 else w


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _plain(r: random.Random) -> str:
    """Numbers, links and signs that are nobody's data."""
    return r.choice([
        lambda: str(r.randint(0, 99)), lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(0, 999)}.{r.randint(0, 99):02}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
        lambda: f"{r.randint(1, 999)},{_digits(r, 3)}", lambda: f"{r.randint(1950, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}", lambda: f"${r.randint(1, 9999)}", lambda: f"{r.randint(1, 100)}%", lambda: f"({r.randint(1, 20)})", lambda: f"#{r.randint(1, 999)}",
        lambda: f"http://www.{_word(r).lower()}.org/{_word(r).lower()}-{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: "|", lambda: "@", lambda: f"@{_word(r)}", lambda: "+", lambda: "token", lambda: '"' + _word(r) + '"', lambda: "=", lambda: f"{_word(r)}-{_word(r)}", lambda: f"{_word(r)}.{_word(r)}", lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}.", lambda: _word(r) + str(r.randint(1, 99)),
        lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}.", lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}.", lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"{_word(r)}.", lambda: f"({_word(r)} {r.randint(0, 9)}.{r.randint(0, 9)})",
    ])()


def _name(r: random.Random) -> str:
    """A small-letter piece of an address: letters, digits or both."""
    x = r.random()
    w = "".join(c for c in _word(r).lower() if c.isascii() and c.isalpha()) or "x"
    return w if x < 0.55 else w + _digits(r, r.randint(1, 4)) if x < 0.75 else _digits(r, r.randint(1, 4)) if x < 0.85 else r.choice("abcdefghijklmnopqrstuvwxyz") if x < 0.95 else _digits(r, 1) + w


def _email(r: random.Random) -> str:
    local = "".join(x for k in range(r.choice([1, 1, 2, 2, 3])) for x in ((r.choice("._-+") if k else ""), _name(r)))
    host = ".".join("-".join(_name(r) for _ in range(r.choice([1, 1, 1, 2]))) for _ in range(r.choice([1, 1, 2, 2, 3])))
    end = r.choice(["com", "org", "net", "info", "de", "fr", "es", "co.uk", "io", "edu", "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 4)))])
    mail = f"{local}@{host}.{end}"
    return mail.upper() if r.random() < 0.03 else mail


def _phone(r: random.Random) -> str:
    sizes = r.choice([(3, 3, 4), (3, 3, 4), (3, 3, 4), (2, 4, 4), (3, 4), (4, 3, 3), (2, 2, 2, 2, 2), (1, 4, 4), (5, 6), (3, 7)])
    groups = [_digits(r, n) for n in sizes]
    mark = r.choice([" ", "-", "-", "."])
    if r.random() < 0.4:
        groups[0] = f"({groups[0]})"
        body = groups[0] + r.choice([" ", " ", ""]) + mark.join(groups[1:])
    else:
        body = mark.join(groups)
    code = r.choice(["", "", f"+{r.randint(1, 9)}", f"+{r.randint(1, 99)}", f"+{r.randint(1, 399)}", f"00{r.randint(1, 99)}"])
    return code + (r.choice([" ", " ", mark]) if code else "") + body if len(sizes) > 2 or code else "0" + body


def _secret(r: random.Random) -> str:
    signs = r.choice(["0123456789abcdef", "0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
    body = "".join(r.choice(signs) for _ in range(r.randint(20, 64)))
    return (r.choice(["sk-", "ghp_", "AKIA", "xoxb-", "pk_live_"]) if r.random() < 0.2 else "") + body


def _private(r: random.Random) -> tuple[str, str, str, int]:
    """(before, span, after, tag)."""
    k = r.randint(1, TAGS - 1)
    kind = KINDS[k - 1]
    if kind == "EMAIL":
        return r.choice(["", "", "", "<", "(", "mailto:"]), _email(r), "", k
    if kind == "PHONE":
        return r.choice(["", "", "", "", "tel. ", "phone: ", "(", "call "]), _phone(r), "", k
    if kind == "IP":
        return "", ".".join(str(r.randint(0, 255)) for _ in range(4)), r.choice(["", "", "", f":{r.randint(1, 65535)}", "/"]), k
    if kind == "CARD":
        n = _digits(r, r.choice([16, 16, 16, 15, 14, 13]))
        if len(n) != 16 or r.random() < 0.5:
            return "", n, "", k
        mark = r.choice(" -")
        return "", mark.join(n[i : i + 4] for i in range(0, 16, 4)), "", k
    if kind == "SECRET":
        quote = r.choice(['"', '"', "'", "`", ""])
        said = r.choice(["token", "api_key", "apiKey", "key", "secret", "password", "passwd", "auth", "bearer", "access_token", "SECRET_KEY", _word(r).lower(), ""])
        return (said + r.choice([" = ", "=", ": ", " := ", ": ", " "]) if said else "") + quote, _secret(r), quote, k
    return "", f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", "", k


def labelled(n: int, seed: int, length: int = 150) -> list[tuple[str, np.ndarray]]:
    """n texts of that length with a tag for each character. They begin and end anywhere; a span of which too little is left to tell what it is has no tag."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, at, spans = [], 0, []
        tail = r.choice(["", "", "", "", "***", "&&&", "%%%", "$$$", "###", "!!", ","])
        hot = r.choice([0.0, 0.0, 0.06, 0.12, 0.25])
        stop = r.choice([".", ".", ",", tail])
        while at < length + 20:
            x = r.random()
            if x < hot:
                a, s, b, k = _private(r)
                spans.append((at + len(a), at + len(a) + len(s), k))
                piece = a + s + b + r.choice(["", "", "", "", ".", ",", ")", ">", tail])
            elif x < hot + 0.05:
                piece = _plain(r)
            else:
                piece = _word(r) + (tail if r.random() < 0.8 else "") + r.choice(["", "", "", "", stop, ".", ",", "!"])
            piece += r.choice([" "] * 9 + ["\n", " | "])
            text.append(piece)
            at += len(piece)
        cut = r.randint(0, 20)
        shown, tags = "".join(text)[cut : cut + length], np.zeros(length, np.int64)
        for s, e, k in spans:
            i, j = max(s - cut, 0), min(e - cut, length)
            if j - i >= 0.7 * (e - s) and (KINDS[k - 1] != "EMAIL" or "@" in shown[i:j]):
                tags[i:j] = k
        out.append((shown, tags))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


#: From one kind to another there is no way but through none.
_FORBIDDEN = np.where((np.arange(TAGS)[:, None] == np.arange(TAGS)) | (np.arange(TAGS)[:, None] == 0) | (np.arange(TAGS) == 0), 0.0, -1e4).astype(np.float32)


class Tagger:
    """The network. p: embedding table straight into the gates (i, f, o, g) and recurrence for each direction; output weights; transitions."""

    def __init__(self, seed: int = 1, hidden: int = HIDDEN):
        g = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = g.normal(0, 0.3, (VOCABULARY, 4 * h)).astype(np.float32)
            self.p["u" + d] = g.normal(0, 1 / np.sqrt(h), (h, 4 * h)).astype(np.float32)
            self.p["x" + d][:, h : 2 * h] += 1
            self.p["o" + d] = g.normal(0, 0.3, (h, TAGS)).astype(np.float32)
        self.p["b"] = np.zeros(TAGS, np.float32)
        self.p["b"][0] = 1
        self.p["t"] = np.zeros((TAGS, TAGS), np.float32)

    def _forward(self, ids: np.ndarray, d: str):
        x, u, h = self.p["x" + d], self.p["u" + d], self.hidden
        n, m = ids.shape
        hs, cs, gates = np.zeros((n + 1, m, h), np.float32), np.zeros((n + 1, m, h), np.float32), np.empty((n, m, 4 * h), np.float32)
        for t in range(n):
            z = x[ids[t]] + hs[t] @ u
            z[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
            z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            gates[t] = z
            cs[t + 1] = z[:, h : 2 * h] * cs[t] + z[:, :h] * z[:, 3 * h :]
            hs[t + 1] = z[:, 2 * h : 3 * h] * np.tanh(cs[t + 1])
        return hs, cs, gates

    def _backward(self, ids, d, hs, cs, gates, dh_out, grad):
        x, u, h = self.p["x" + d], self.p["u" + d], self.hidden
        n, m = ids.shape
        gx, gu = np.zeros_like(x), np.zeros_like(u)
        dh, dc = np.zeros((m, h), np.float32), np.zeros((m, h), np.float32)
        dzs = np.empty_like(gates)
        for t in range(n - 1, -1, -1):
            i, f, o, g = (gates[t][:, k * h : (k + 1) * h] for k in range(4))
            tc = np.tanh(cs[t + 1])
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = dzs[t]
            dz[:, :h] = dc * g * i * (1 - i)
            dz[:, h : 2 * h] = dc * cs[t] * f * (1 - f)
            dz[:, 2 * h : 3 * h] = dh * tc * o * (1 - o)
            dz[:, 3 * h :] = dc * i * (1 - g * g)
            dc = dc * f
            dh = dz @ u.T
        gu = np.tensordot(hs[:-1], dzs, ((0, 1), (0, 1)))
        seen = ids.ravel()
        order = np.argsort(seen, kind="stable")
        seen = seen[order]
        edge = np.flatnonzero(np.diff(seen, prepend=-1))
        gx[seen[edge]] = np.add.reduceat(dzs.reshape(-1, 4 * h)[order], edge, axis=0)
        grad["x" + d], grad["u" + d] = gx, gu

    def gradient(self, ids: np.ndarray, tags: np.ndarray):
        """(loss, gradients) over texts of one length: ids and tags are time x batch."""
        n, m = ids.shape
        ff = self._forward(ids, "f")
        bb = self._forward(ids[::-1], "b")
        hf, hb = ff[0][1:], bb[0][1:][::-1]
        e = hf @ self.p["of"] + hb @ self.p["ob"] + self.p["b"]
        trans = self.p["t"] + _FORBIDDEN
        a = np.empty_like(e)
        a[0] = e[0]
        for t in range(1, n):
            a[t] = e[t] + _lse(a[t - 1][:, :, None] + trans, 1)
        z = _lse(a[-1], 1)
        b = np.zeros_like(e)
        pair = np.zeros((TAGS, TAGS), np.float32)
        for t in range(n - 2, -1, -1):
            w = trans + (e[t + 1] + b[t + 1])[:, None, :]
            b[t] = _lse(w, 2)
            pair += np.exp(a[t][:, :, None] + w - z[:, None, None]).sum(0)
        de = np.exp(a + b - z[None, :, None])
        gold = np.take_along_axis(e, tags[:, :, None], 2).sum() + trans[tags[:-1], tags[1:]].sum()
        np.put_along_axis(de, tags[:, :, None], np.take_along_axis(de, tags[:, :, None], 2) - 1, 2)
        np.add.at(pair, (tags[:-1].ravel(), tags[1:].ravel()), -1)
        grad = {"t": np.where(_FORBIDDEN < 0, 0, pair), "b": de.sum((0, 1)), "of": np.tensordot(hf, de, ((0, 1), (0, 1))), "ob": np.tensordot(hb, de, ((0, 1), (0, 1)))}
        self._backward(ids, "f", *ff, de @ self.p["of"].T, grad)
        self._backward(ids[::-1], "b", *bb, (de @ self.p["ob"].T)[::-1], grad)
        return float(z.sum() - gold), grad

    def fit(self, data: list[tuple[str, np.ndarray]], epochs: int = 30, batch: int = 96, rate: float = 0.025, seed: int = 5) -> None:
        g = np.random.default_rng(seed)
        size = min(len(t) for t, _ in data)
        ids = np.stack([_CLASS[np.array([ord(c) for c in t[:size]])] for t, _ in data], 1).astype(np.int64)
        tags = np.stack([k[:size] for _, k in data], 1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, total = 0, epochs * -(-len(data) // batch)
        for _ in range(epochs):
            order = g.permutation(len(data))
            for s in range(0, len(order), batch):
                at = order[s : s + batch]
                _, grad = self.gradient(ids[:, at], tags[:, at])
                norm = np.sqrt(sum(float((x * x).sum()) for x in grad.values())) / len(at)
                step += 1
                lr = rate * min(1, step / 20) * (0.5 + 0.5 * np.cos(np.pi * step / total))
                for k, x in grad.items():
                    x = x / len(at) / max(1.0, norm / 5)
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    # Decoding. The gates' halving of the sigmoid's argument is put into the weights, so one tanh serves all.

    def ready(self) -> None:
        h = self.hidden
        half = np.concatenate([np.full(3 * h, 0.5), np.ones(h)]).astype(np.float32)
        self.fast = {d: (np.ascontiguousarray((self.p["x" + d] * half).T), np.ascontiguousarray((self.p["u" + d] * half).T), np.ascontiguousarray(self.p["o" + d].T)) for d in "fb"}

    def _emit(self, ids: np.ndarray, live: np.ndarray, d: str) -> np.ndarray:
        """Tag scores, time x tags x windows; windows come longest first, live: how many last beyond each time."""
        x, u, o = self.fast[d]
        h = self.hidden
        n, m = ids.shape
        out = np.empty((n, TAGS, m), np.float32)
        new = lambda k: (np.empty((4 * h, k), np.float32), np.empty((4 * h, k), np.float32), np.empty((h, k), np.float32))
        hid, cell, was = np.zeros((h, m), np.float32), np.zeros((h, m), np.float32), m
        z, y, s = new(m)
        for t in range(n):
            k = int(live[t])
            if k != was:
                hid, cell, was = np.ascontiguousarray(hid[:, :k]), np.ascontiguousarray(cell[:, :k]), k
                z, y, s = new(k)
            np.matmul(u, hid, out=z)
            np.take(x, ids[t, :k], axis=1, out=y, mode="clip")
            z += y
            np.tanh(z, out=z)
            gate = z[: 3 * h]
            gate *= 0.5
            gate += 0.5
            cell *= z[h : 2 * h]
            np.multiply(z[:h], z[3 * h :], out=s)
            cell += s
            np.tanh(cell, out=hid)
            hid *= z[2 * h : 3 * h]
            out[t, :, :k] = o @ hid
        return out

    def scores(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores, time x tags x windows, from both directions. Windows: places in codes, longest first."""
        n, m = int(size[0]), len(size)
        live = np.searchsorted(-size, -np.arange(1, n + 1), side="right")
        t = np.arange(n)[:, None]
        inside = t < size
        cls = _CLASS[codes]
        fore = np.where(inside, cls[np.minimum(start + t, len(cls) - 1)], 0).astype(np.intp)
        back = np.where(inside, cls[np.maximum(start + size - 1 - t, 0)], 0).astype(np.intp)
        e = self._emit(fore, live, "f")
        eb = self._emit(back, live, "b")
        bias = self.p["b"][:, None]
        w = np.arange(m)
        full = int(np.searchsorted(-size, -n, side="right"))  # windows of the greatest length
        for i in range(n):
            k = int(live[i])
            x = e[i, :, :k]
            x += bias
            x[:, :full] += eb[n - 1 - i, :, :full]
            if k > full:
                x[:, full:] += eb[size[full:k] - 1 - i, :, w[full:k]].T
        return e

    def reconciled(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of every character, characters x tags: averages where windows overlap. at: offsets of the texts in codes."""
        n = np.diff(at)
        stride = WINDOW - OVERLAP
        many = np.where(n > 0, np.maximum(1, -(-(n - OVERLAP) // stride)), 0)
        row = np.repeat(np.arange(len(n)), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = at[row] + k * stride
        size = np.minimum(WINDOW, at[row + 1] - start)
        out = np.zeros((len(codes), TAGS), np.float32)
        order = np.argsort(-size, kind="stable")
        more = (k < many[row] - 1)[order]
        k, start, size = k[order], start[order], size[order]
        for s in range(0, len(row), 2048):
            part = slice(s, s + 2048)
            e = self.scores(codes, start[part], size[part])
            ramp = ((np.arange(OVERLAP, dtype=np.float32) + 0.5) / OVERLAP)[:, None, None]
            if len(w := np.flatnonzero(k[part] > 0)):
                e[:OVERLAP, :, w] *= ramp
            if len(w := np.flatnonzero(more[part])):  # these have the full length
                e[WINDOW - OVERLAP : WINDOW, :, w] *= ramp[::-1]
            e = np.ascontiguousarray(e.transpose(2, 0, 1))
            for j, (a, m) in enumerate(zip(start[part].tolist(), size[part].tolist())):
                out[a : a + m] += e[j, :m]
        return out

    def best_tags(self, g: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The tags of the best path over each text. g: scores, characters x tags; at: offsets of the texts."""
        t = self.p["t"].astype(np.float64)
        own = np.diag(t)[1:]
        # A run of one kind costs transitions; only in a stretch whose scores make up for them can there be one.
        cost = (own + t[0, 0] - t[1:, 0] - t[0, 1:]).min()
        at_start, at_end, whole = (own - t[1:, 0]).min(), (own - t[0, 1:]).min(), (own - t[0, 0]).min()
        top = g[:, 1].copy()
        for k in range(2, TAGS):
            np.maximum(top, g[:, k], out=top)
        gain = (top - g[:, 0]).astype(np.float64) + max(0.0, (own - t[0, 0]).max())
        n = np.diff(at)
        some = np.flatnonzero(n)
        gain[at[some]] += max(cost - at_start, (cost - whole) / 2)
        gain[at[some + 1] - 1] += max(cost - at_end, (cost - whole) / 2)
        total = np.zeros(len(g) + len(n))  # sums of each text from a nought of its own, each text far below the one before
        place = np.arange(len(g)) + np.repeat(np.arange(len(n)), n) + 1
        total[place] = gain
        total = np.cumsum(total) - 1e9 * np.repeat(np.arange(len(n)), n + 1)
        low, high = np.minimum.accumulate(total), np.maximum.accumulate(total[::-1])[::-1]
        free = high[place] - low[place - 1] > cost - 0.05
        tags = np.zeros(len(g), np.int8)
        if not free.any():
            return tags
        edge = np.zeros(len(g) + 1, bool)
        edge[at] = True
        start = np.flatnonzero(free & (edge[:-1] | ~np.concatenate([[False], free[:-1]])))
        end = np.flatnonzero(free & (edge[1:] | ~np.concatenate([free[1:], [False]]))) + 1
        order = np.argsort(start - end, kind="stable")
        start, end = start[order], end[order]
        size = end - start
        s = 0
        while s < len(start):
            part = slice(s, s + max(1, min(2048, 4_000_000 // int(size[s]))))
            n, st = size[part], start[part]
            i = np.arange(int(n[0]))[:, None]
            e = np.ascontiguousarray(g[np.minimum(st + i, len(g) - 1)].transpose(0, 2, 1))
            w = np.flatnonzero(~edge[st])
            e[0][:, w] += self.p["t"][0][:, None]
            w = np.flatnonzero(~edge[end[part]])
            e[n[w] - 1, :, w] += self.p["t"][:, 0]
            for j, path in enumerate(self._best(e, n)):
                tags[st[j] : st[j] + n[j]] = path
            s = part.stop
        return tags

    def _best(self, e: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The best path of each window. e: time x tags x windows, longest first.

        A kind goes on or comes from none, so a step keeps one bit for each
        kind and, for none, which kind has ended if any.
        """
        n, m = int(size[0]), len(size)
        live = np.searchsorted(-size, -np.arange(1, n + 1), side="right")
        trans = self.p["t"]
        stay, into, out_of, keep = trans[0, 0], trans[0, 1:, None], trans[1:, 0, None], np.diag(trans)[1:, None]
        none, kinds = e[0, 0].copy(), e[0, 1:].copy()
        begun, ended = np.zeros((n, TAGS - 1, m), bool), np.zeros((n, m), np.int8)
        for i in range(1, n):
            k = int(live[i])
            a, b = none[:k], kinds[:, :k]
            on, new, off = b + keep, a + into, b + out_of
            begun[i, :, :k] = new > on
            which, top = off.argmax(0), off.max(0)
            a = a + stay
            ended[i, :k] = np.where(top > a, which + 1, 0)
            none[:k] = np.maximum(a, top) + e[i, 0, :k]
            kinds[:, :k] = np.maximum(on, new) + e[i, 1:, :k]
        now = np.where(kinds.max(0) > none, kinds.argmax(0) + 1, 0)
        tags, w = np.zeros((n, m), np.int8), np.arange(m)
        for i in range(n - 1, -1, -1):
            k = int(live[i])
            x = now[:k]
            tags[i, :k] = x
            if i:
                now[:k] = np.where(x == 0, ended[i, :k], np.where(begun[i, np.maximum(x - 1, 0), w[:k]], 0, x))
        return [tags[:k, j] for j, k in enumerate(size)]

    def spans(self, b: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, str]]:
        """(row, first character, end, tag, text) of the spans in the rows of a flat buffer."""
        text = b.tobytes().decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])[offsets]
        if not len(codes):
            return []
        tags = self.best_tags(self.reconciled(codes, at), at)
        if not tags.any():
            return []
        first = np.zeros(len(codes) + 1, bool)
        first[at] = True
        edge = np.flatnonzero((np.diff(tags, prepend=-1) != 0) | first[:-1])
        out = []
        for s, e in zip(edge, np.append(edge[1:], len(codes))):
            if tags[s]:
                r = int(np.searchsorted(at, s, side="right")) - 1
                out.append((r, int(s - at[r]), int(e - at[r]), int(tags[s]), text[s:e]))
        return out


def train(n: int = TRAINING, seed: int = 11, epochs: int = 20) -> Tagger:
    """A tagger trained on n labelled texts."""
    t = Tagger()
    t.fit(labelled(n, seed), epochs)
    t.ready()
    return t


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger with the weights that train() gave and save() wrote."""
    t = Tagger()
    with np.load(WEIGHTS, allow_pickle=False) as f:
        t.p = {k: f[k] for k in f.files}
    t.ready()
    return t


def save(t: Tagger, path: Path = WEIGHTS) -> None:
    np.savez_compressed(path, **t.p)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, kind, span) of all personal data: places in characters, end excluded.

    Whole texts are read. Ids are whole numbers. Null, empty and clean texts have no rows; repeated
    rows each have theirs; null ids are carried. An empty table gives an empty
    one.
    """
    held = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, b, o in chunks(batch.column(1)):
                found = held.value.spans(b, o)
                if found:
                    r, s, e, k, x = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + v for v in r])), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array([KINDS[v - 1] for v in k]), pa.array(x)], ["doc_id", "start", "end", "kind", "span"])

    id_ = F.col(f"`{id_col}`")
    return docs.where(F.col(f"`{text_col}`").isNotNull()).select(id_.cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, start int, end int, kind string, span string")


if __name__ == "__main__":
    save(train())
