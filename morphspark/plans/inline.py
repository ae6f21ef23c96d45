"""Small inline tables that the registered queries and their SQL share, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from morphspark.functions.chars import BLOCKS, compile_ranges, default_ranges
from morphspark.sources import sample

TEXTS = [(1, "東京都大学に行く。"), (2, "酒を飲まなかった人"), (3, "京都東京都京都"), (4, "MEGAへ行く"), (5, "徳島（とくしま）に行った。"), (6, "なま〜〜ーー。"), (7, "アイスは1,200円"), (8, "")]
SHORT = [(1, "東京都"), (2, "東京都大学"), (3, "酒は人"), (4, "京都へ行く"), (5, "東京大学")]
QUERIES = [(1, "東京都"), (2, "x"), (3, "行っ"), (4, "無い"), (5, "京都"), (6, "")]
BAD_ROWS = [
    ("木", 1, 1, 5, "A", "", ""), ("", 1, 1, 5, "A", "", ""), ("林", 99, 1, 5, "A", "", ""), ("森", 1, 1, 99999, "A", "", ""), ("草", 1, 1, 5, "D", "", ""), ("花", 1, 1, 5, "A", "0/0", ""), ("実", 1, 1, 5, "B", "0/77", ""), ("葉", -1, 1, 5, "B", "0/0", ""),
]


REWRITTEN = [(1, "ＡＢＣ"), (2, "カ゛か゛"), (3, "ウ゛ｶﾞ"), (4, "東京（とうきょう）へ"), (5, "すごーーい〜-"), (6, "㍿ＶＩ"), (7, ""), (8, "ÀÉ ½"), (9, "都(と)京(きょうきょう)")]
LONG = [(49149, "a"), (49150, "a"), (16383, "あ"), (16384, "あ"), (24575, "é")]
SENTENCES = [(1, "東京に行く。京都は酒。"), (2, "（酒を飲む。）と言った。"), (3, "な。なに行く"), (4, "本当か？と聞く！はい"), (5, "1.5と2.。3"), (6, "酒・・・・酒"), (7, "一<br><br>二"), (8, "終わり。）」次"), (9, "")]
NUMBERS = [(1, "12億34万5"), (2, "1,234.50円"), (3, "1,23"), (4, "三百二十"), (5, "0.5.2"), (6, "二〇〇〇"), (7, "千万"), (8, "1,000,000"), (9, "5.円"), (10, "六三四")]
PARTS = [(1, "東京ab-12行く"), (2, "xab-1"), (3, "酒a1-22に"), (4, "ab-"), (5, "大学-1")]
CHARACTER_LINES = [
    "# our own classes", "DEFAULT 0 1 0", "SPACE 0 1 0", "KANJI 0 0 2", "SYMBOL 1 1 0", "NUMERIC 1 1 0", "ALPHA 1 1 0", "HIRAGANA 0 1 2", "KATAKANA 1 1 2",
    *[f"0x{lo:04X}..0x{hi:04X} {names}  # {names.lower()}" for lo, hi, names in BLOCKS], *[f"0x{ord(c):04X} KANJINUMERIC" for c in "〇一二三四五六七八九十百千万億兆"],
]
UNKNOWN_LINES = [f"{c},{i},{i},{32000 if c == 'NUMERIC' else cost}," + ",".join(p) for c, i, _, cost, p in sample.UNKNOWN if c not in ("GREEK", "CYRILLIC")]
REWRITE_LINES = ["# pairs and exempt signs", "か゛ が", "〜"]
FROM_SOURCES = [(1, "コンピュータは12円"), (2, "か゛〜。"), (3, "mega特a ABC"), (4, "京都へ行った!!"), (5, "酒 酒")]


def values(rows: list[tuple], columns: str) -> str:
    """A derived table of SQL."""

    def one(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return str(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(one, v)) + "]" + ("" if v else "::bigint[]")
        return "'" + v.replace("'", "''") + "'"

    return f"(values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_CLASSES = sorted(sample.CLASSES, key=lambda k: next((n for n, w in enumerate(sample.WORDS) if w[1] == k), 999))


def pos_rows() -> list[tuple]:
    """(pos_id, p1..p6) in the order of the first words."""
    return [(k, *sample.CLASSES[c]) for k, c in enumerate(c for c in _CLASSES if any(w[1] == c for w in sample.WORDS))]


def lexicon_rows() -> list[tuple]:
    """(word_id, surface, left_id, right_id, cost, pos_id, reading, normalized, dic, split_a, split_b)."""
    ids = {c: k for k, c in enumerate(_CLASSES)}
    ref = lambda x: [int(v) for v in x.split("/")] if x else []
    return [(n, s, i, i, cost, ids[k], r, norm or s, int(d) if d else -1, ref(a), ref(b)) for n, (s, k, i, cost, r, norm, d, _, a, b, _) in enumerate(sample.WORDS)]


LEXICON_COLUMNS = "word_id, surface, left_id, right_id, cost, pos_id, reading, normalized, dic, split_a, split_b"


def range_rows() -> list[tuple]:
    return compile_ranges(default_ranges())


def conn_rows() -> list[tuple]:
    return sample.matrix()[2]
