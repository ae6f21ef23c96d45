"""Sentence boundaries in Japanese and mixed text."""

from __future__ import annotations

import re

STOPS = "。？！♪…?!"
DOTS = ".．"
COMMAS = ",，、"
WORDY = "a-zA-Z0-9ａ-ｚＡ-Ｚ０-９〇一二三四五六七八九十百千万億兆"
OPENING = "({｛[（「【『［≪〔“"
CLOSING = ")}]）」｝】』］〕≫”"
LIMIT = 4096
LOOK_BACK = 30

_any = lambda chars: "[" + re.escape(chars) + "]"
_BREAK = re.compile(f"(?:{_any(STOPS)}|・{{3,}}+|(?<![{WORDY}]){_any(DOTS)}(?![{WORDY}{re.escape(COMMAS)}])){_any(DOTS + STOPS)}*|(?:<br>|<BR>){{2,}}")
_ITEM = re.compile(f"[{WORDY}]{_any(DOTS)}\\Z")
_TAIL = re.compile(f"{_any(CLOSING + COMMAS + STOPS)}*")
_QUOTED = re.compile(f"{_any('！？!?' + CLOSING)}(?:と|っ|です)")
_SPACES = re.compile(".+\\s+")
_BRACKET = re.compile(_any(OPENING + CLOSING))


def depth(text: str) -> int:
    """Brackets that are open at the end."""
    out = 0
    for m in _BRACKET.finditer(text):
        out = out + 1 if m[0] in OPENING else max(0, out - 1)
    return out


def crosses(dictionary, text: str, at: int, since: int = 0) -> bool:
    """Whether a dictionary word that begins within LOOK_BACK bytes before goes on beyond the place, or ends there with more than one character."""
    i, size = at, 0
    while i > since and (size := size + len(text[i - 1].encode("utf-8", "surrogatepass"))) <= LOOK_BACK:
        i -= 1
    for k in range(i, at):
        for w in dictionary.found(text, k):
            if w[0] > at:
                return True
            if w[0] == at:
                return at - k > 1
    return False


def first_end(text: str, dictionary=None, limit: int = LIMIT, since: int = 0) -> int:
    """Characters from `since` to the first boundary; without one, less than 0: a harmless place to cut."""
    s = text[since : since + limit]
    if not s:
        return 0
    item = len(s) == 2 and bool(_ITEM.match(s))
    for m in _BREAK.finditer(s):
        end = m.end()
        if depth(s[:end]) > 0:
            continue
        end = _TAIL.match(s, end).end()
        if item:
            continue
        if end < len(s) and (_QUOTED.match(s, end - 1) or (s[end] in "とやの" and _ITEM.search(s[max(0, end - 2) : end]))):
            continue
        if dictionary is not None and crosses(dictionary, text, since + end, since):
            continue
        return end
    if since + len(s) < len(text) and (m := _SPACES.search(s)):
        return -m.end()
    return -len(s)


def spans(text: str, dictionary=None, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(begin, end) of the sentences, without a gap. Where no boundary is found within the limit, all the rest is one."""
    out, at = [], 0
    while at < len(text):
        n = first_end(text, dictionary, limit, at)
        end = len(text) if n < 0 else at + n
        out.append((at, end))
        at = end
    return out
