"""Text normalisation that keeps, for every character of the result, its place in the original."""

from __future__ import annotations

import re
import unicodedata

from .chars import BITS, CharTable

MAX_BYTES = 65535 // 4 * 3
MAX_REWRITTEN = 65535


class InputTooLong(ValueError):
    """The text has more bytes than one analysis takes."""


#: Characters that may join with one before them: the quick check says "maybe".
_SECOND = {chr(int(parts[1], 16)) for c in range(0x30000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and len(parts := d.split()) == 2} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
_MAYBE = re.compile("[" + "".join(map(re.escape, sorted(_SECOND))) + "]")


class Buffer:
    """A text under rewriting. origin: the place in the original of each character and of the end; None while they are the same."""

    __slots__ = ("original", "text", "origin")

    def __init__(self, text: str, max_bytes: int | None = MAX_BYTES):
        if max_bytes is not None and len(text) * 4 > max_bytes and len(text.encode("utf-8", "surrogatepass")) > max_bytes:
            raise InputTooLong(f"a text of more than {max_bytes} bytes")
        self.original, self.text, self.origin = text, text, None

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ranges; sorted and apart. The first character of a replacement stands at the start of what it replaces, the others at its end."""
        if not edits:
            return
        src, out, at = self.text, [], 0
        if self.origin is None and all(e - s == len(w) == 1 for s, e, w in edits):
            for s, e, w in edits:
                out += (src[at:s], w)
                at = e
            out.append(src[at:])
            self.text = "".join(out)
            return
        origin = self.origin or list(range(len(src) + 1))
        new: list[int] = []
        for s, e, w in edits:
            out += (src[at:s], w)
            new += origin[at:s]
            if w:
                new.append(origin[s])
                new += [origin[e]] * (len(w) - 1)
            at = e
        out.append(src[at:])
        new += origin[at:]
        new[0] = 0
        self.text, self.origin = "".join(out), new

    def place(self, i: int) -> int:
        return i if self.origin is None else self.origin[i]


class DefaultNormalizer:
    """Rewrite pairs, then small letters and NFKC, character by character.

    pairs: forced replacements; exempt: characters that NFKC leaves alone. A
    text that is NFKC already and has no capitals only gets the pairs, the
    longest first; in other texts the shortest pair that matches is taken.
    """

    def __init__(self, pairs: dict[str, str] | None = None, exempt: set[str] | frozenset[str] = frozenset()):
        self.pairs, self.exempt = dict(pairs or {}), frozenset(exempt)
        keys = sorted(self.pairs, key=len)
        either = lambda ks: "|".join(map(re.escape, ks))
        self.longest = re.compile(either(keys[::-1])) if keys else None
        self.any = re.compile((either(keys) + "|" if keys else "") + "[A-Z]|[^\x00-\x7f]")
        self.known: dict[str, str | None] = dict(self.pairs)

    def _single(self, ch: str) -> str | None:
        """What the character becomes; None if it stays."""
        low = ch.isupper()
        form = unicodedata.normalize("NFKC", ch) if ch not in self.exempt else ch
        if form != ch or (ch not in self.exempt and ch in _SECOND):
            new = unicodedata.normalize("NFKC", ch.lower() if low else ch)
        else:
            new = ch.lower() if low else ch
        return None if not new or new[0] == ch else new

    def __call__(self, b: Buffer) -> None:
        text = b.text
        if text.isascii():
            plain = text == text.lower()
        else:
            plain = unicodedata.is_normalized("NFKC", text) and not any(map(str.isupper, set(text))) and not _MAYBE.search(text)
        if plain:
            if self.longest:
                b.edit([(m.start(), m.end(), self.pairs[m[0]]) for m in self.longest.finditer(text)])
            return
        known, edits = self.known, []
        for m in self.any.finditer(text):
            key = m[0]
            try:
                new = known[key]
            except KeyError:
                new = known[key] = self._single(key)
            if new is not None:
                edits.append((m.start(), m.end(), new))
        b.edit(edits)


class ProlongedMarks:
    """Two or more prolonged sound marks in a row become one."""

    def __init__(self, marks: str = "ー-⁓〜〰", symbol: str = "ー"):
        self.pattern, self.symbol = re.compile("[" + re.escape(marks) + "]{2,}"), symbol

    def __call__(self, b: Buffer) -> None:
        b.edit([(m.start(), m.end(), self.symbol) for m in self.pattern.finditer(b.text)])


class IgnoreReadings:
    """Bracketed kana after a kanji are taken out."""

    def __init__(self, table: CharTable, left: str = "(（", right: str = ")）", longest: int = 4):
        kanji, kana = table.class_pattern(BITS["KANJI"]), table.class_pattern(BITS["HIRAGANA"] | BITS["KATAKANA"])
        self.pattern = re.compile(f"{kanji}([{re.escape(left)}]{kana}{{1,{longest}}}[{re.escape(right)}])")

    def __call__(self, b: Buffer) -> None:
        b.edit([(*m.span(1), "") for m in self.pattern.finditer(b.text)])
