"""Character classes: ranges of code points to category masks, and what follows from them along a text."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterable

NAMES = ["DEFAULT", "SPACE", "KANJI", "SYMBOL", "NUMERIC", "ALPHA", "HIRAGANA", "KATAKANA", "KANJINUMERIC", "GREEK", "CYRILLIC", "USER1", "USER2", "USER3", "USER4"]
BITS: dict[str, int] = {name: 1 << k for k, name in enumerate(NAMES)} | {"NOOOVBOW": 1 << 30, "NOOOVBOW2": 1 << 31, "ALL": (1 << 30) - 1}
DEFAULT = BITS["DEFAULT"]
NO_START, NO_START2 = BITS["NOOOVBOW"], BITS["NOOOVBOW2"]
#: A character of these classes can't begin a word after one of its own class.
JOINED = BITS["ALPHA"] | BITS["GREEK"] | BITS["CYRILLIC"]

#: (first, last, classes) by Unicode block.
BLOCKS: list[tuple[int, int, str]] = [
    (0x09, 0x0D, "SPACE"), (0x20, 0x20, "SPACE"), (0xA0, 0xA0, "SPACE"), (0x2000, 0x200B, "SPACE"), (0x3000, 0x3000, "SPACE"),
    (0x21, 0x2F, "SYMBOL"), (0x3A, 0x40, "SYMBOL"), (0x5B, 0x60, "SYMBOL"), (0x7B, 0x7E, "SYMBOL"), (0xA1, 0xBF, "SYMBOL"), (0xD7, 0xD7, "SYMBOL"), (0xF7, 0xF7, "SYMBOL"), (0x2010, 0x206F, "SYMBOL"), (0x20A0, 0x20CF, "SYMBOL"), (0x2100, 0x27BF, "SYMBOL"), (0x3001, 0x3004, "SYMBOL"), (0x3008, 0x303F, "SYMBOL"), (0xFF01, 0xFF0F, "SYMBOL"), (0xFF1A, 0xFF20, "SYMBOL"), (0xFF3B, 0xFF40, "SYMBOL"), (0xFF5B, 0xFF65, "SYMBOL"),
    (0x30, 0x39, "NUMERIC"), (0xFF10, 0xFF19, "NUMERIC"),
    (0x41, 0x5A, "ALPHA"), (0x61, 0x7A, "ALPHA"), (0xC0, 0xD6, "ALPHA"), (0xD8, 0xF6, "ALPHA"), (0xF8, 0x24F, "ALPHA"), (0x1E00, 0x1EFF, "ALPHA"), (0xFF21, 0xFF3A, "ALPHA"), (0xFF41, 0xFF5A, "ALPHA"),
    (0x370, 0x3FF, "GREEK"), (0x400, 0x52F, "CYRILLIC"),
    (0x3041, 0x309F, "HIRAGANA"), (0x30A1, 0x30FF, "KATAKANA"), (0x31F0, 0x31FF, "KATAKANA"), (0xFF66, 0xFF9F, "KATAKANA"), (0x30FC, 0x30FC, "HIRAGANA"),
    (0x2E80, 0x2FDF, "KANJI"), (0x3005, 0x3005, "KANJI"), (0x3007, 0x3007, "KANJI"), (0x3400, 0x4DBF, "KANJI"), (0x4E00, 0x9FFF, "KANJI"), (0xF900, 0xFAFF, "KANJI"), (0x20000, 0x3FFFF, "KANJI"),
    (0x300, 0x36F, "ALL NOOOVBOW"), (0x1AB0, 0x1AFF, "ALL NOOOVBOW"), (0x1DC0, 0x1DFF, "ALL NOOOVBOW"), (0x20D0, 0x20FF, "ALL NOOOVBOW"), (0xFE00, 0xFE0F, "ALL NOOOVBOW"), (0xFE20, 0xFE2F, "ALL NOOOVBOW"), (0x1F3FB, 0x1F3FF, "ALL NOOOVBOW"), (0x200C, 0x200D, "ALL NOOOVBOW2"),
]


def mask_of(names: str | Iterable[str]) -> int:
    """The mask of class names; ValueError for one that doesn't exist."""
    out = 0
    for name in names.split() if isinstance(names, str) else names:
        if name not in BITS:
            raise ValueError(f"no such character class: {name}")
        out |= BITS[name]
    return out


def default_ranges() -> list[tuple[int, int, int]]:
    """(first, end, mask), end excluded."""
    numerals = [(ord(c), ord(c) + 1, BITS["KANJINUMERIC"]) for c in "〇一二三四五六七八九十百千万億兆"]
    return [(lo, hi + 1, mask_of(names)) for lo, hi, names in BLOCKS] + numerals


def compile_ranges(ranges: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint (first, end, mask) over all code points: overlaps have both masks, gaps DEFAULT, and equal neighbours are one."""
    ranges = list(ranges)
    edges = sorted({0, sys.maxunicode + 1, *(e for lo, hi, _ in ranges for e in (lo, hi))})
    masks = [0] * len(edges)
    place = {e: k for k, e in enumerate(edges)}
    for lo, hi, mask in ranges:
        for k in range(place[lo], place[hi]):
            masks[k] |= mask
    out: list[tuple[int, int, int]] = []
    for lo, hi, mask in zip(edges, edges[1:], masks):
        mask = mask or DEFAULT
        if out and out[-1][2] == mask:
            out[-1] = (out[-1][0], hi, mask)
        else:
            out.append((lo, hi, mask))
    return out


class CharTable:
    """Masks of characters, by bisection once and then from a table of those seen."""

    def __init__(self, ranges: Iterable[tuple[int, int, int]] | None = None):
        self.ranges = compile_ranges(default_ranges() if ranges is None else ranges)
        self.starts = [r[0] for r in self.ranges]
        self.seen: dict[str, int] = {}
        self.shared: dict[str, int] = {}
        self.finders: dict[int, re.Pattern] = {}

    def __call__(self, ch: str) -> int:
        mask = self.seen.get(ch)
        if mask is None:
            mask = self.seen[ch] = self.ranges[bisect_right(self.starts, ord(ch)) - 1][2]
        return mask

    def masks(self, text: str) -> list[int]:
        seen = self.seen
        try:
            return [seen[c] for c in text]
        except KeyError:
            return [self(c) for c in text]

    def class_pattern(self, mask: int, but: int = 0) -> str:
        """A regular-expression class of the characters that have any class of the mask, and none of the other."""
        some = "".join(f"\\U{lo:08x}-\\U{hi - 1:08x}" for lo, hi, m in self.ranges if m & mask and not m & but)
        return f"[{some}]" if some else "(?!)"

    def finder(self, mask: int) -> re.Pattern:
        """An expression that finds such characters."""
        if mask not in self.finders:
            self.finders[mask] = re.compile(self.class_pattern(mask))
        return self.finders[mask]

    def common(self, text: str) -> int:
        """The classes that all characters have; none of an empty text."""
        out = self.shared.get(text)
        if out is None:
            out = common(self.masks(text), 0, len(text))
            if len(text) <= 64 and len(self.shared) < 100_000:
                self.shared[text] = out
        return out


def run_lengths(masks: list[int]) -> list[int]:
    """How many characters from each on share a class, all of them with each other."""
    out = [1] * len(masks)
    common = masks[-1] if masks else 0
    for i in range(len(masks) - 2, -1, -1):
        both = masks[i] & common
        if both:
            out[i] = out[i + 1] + 1
            common = both
        else:
            common = masks[i]
    return out


def can_begin(masks: list[int]) -> list[bool]:
    """Whether a word may begin at each character."""
    out, before, barred = [], 0, False
    for m in masks:
        if barred:
            barred, ok = False, False
        elif m & NO_START2:
            barred, ok = True, False
        elif m & NO_START:
            ok = False
        else:
            ok = not (m & JOINED and m & before)
        out.append(ok)
        before = m
    return out


def common(masks: list[int], begin: int, end: int) -> int:
    """The classes that all characters of the range have; none of an empty range."""
    if begin >= end:
        return 0
    out = masks[begin]
    for m in masks[begin + 1 : end]:
        out &= m
    return out


def to_next_begin(bow: list[bool], i: int) -> int:
    """Characters from i to the next that can begin a word, or to the end."""
    n = len(bow)
    j = i + 1
    while j < n and not bow[j]:
        j += 1
    return j - i
