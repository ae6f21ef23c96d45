"""A small dictionary of our own for examples, tests and the registered queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession

from .config import Config
from .dictionary import Dictionary, DictionaryBuilder

CLASSES = {
    "noun": ("名詞", "普通名詞", "一般", "*", "*", "*"),
    "place": ("名詞", "固有名詞", "地名", "一般", "*", "*"),
    "numeral": ("名詞", "数詞", "*", "*", "*", "*"),
    "case": ("助詞", "格助詞", "*", "*", "*", "*"),
    "binding": ("助詞", "係助詞", "*", "*", "*", "*"),
    "verb": ("動詞", "一般", "*", "*", "五段-マ行", "終止形-一般"),
    "verb-mizen": ("動詞", "一般", "*", "*", "五段-マ行", "未然形-一般"),
    "go": ("動詞", "非自立可能", "*", "*", "五段-カ行", "終止形-一般"),
    "went": ("動詞", "非自立可能", "*", "*", "五段-カ行", "連用形-促音便"),
    "adjective": ("形容詞", "非自立可能", "*", "*", "形容詞", "連用形-促音便"),
    "adjective-end": ("形容詞", "非自立可能", "*", "*", "形容詞", "終止形-一般"),
    "auxiliary": ("助動詞", "*", "*", "*", "助動詞-タ", "終止形-一般"),
    "sign": ("補助記号", "一般", "*", "*", "*", "*"),
    "stop": ("補助記号", "句点", "*", "*", "*", "*"),
}
SIZE = 12
#: surface, class, connection id, cost, reading, normal form ("" as surface), dictionary form, unit, A parts, B parts, synonym groups
WORDS = [
    ("京都", "place", 1, 4100, "キョウト", "", "", "A", "", "", "1/5"),
    ("東京", "place", 1, 2300, "トウキョウ", "", "", "A", "", "", "2"),
    ("東", "noun", 2, 4400, "ヒガシ", "", "", "A", "", "", ""),
    ("都", "noun", 3, 3000, "ト", "", "", "A", "", "", ""),
    ("東京都", "place", 1, 3900, "トウキョウト", "", "", "B", "1/3", "", ""),
    ("大学", "noun", 2, 2600, "ダイガク", "", "", "A", "", "", ""),
    ("東京都大学", "place", 1, 5200, "トウキョウトダイガク", "", "", "C", "1/3/5", "4/5", ""),
    ("酒", "noun", 2, 3300, "サケ", "", "", "A", "", "", "7"),
    ("人", "noun", 2, 3100, "ヒト", "", "", "A", "", "", ""),
    ("を", "case", 4, 1500, "ヲ", "", "", "A", "", "", ""),
    ("に", "case", 4, 1600, "ニ", "", "", "A", "", "", ""),
    ("へ", "case", 4, 1700, "ヘ", "", "", "A", "", "", ""),
    ("は", "binding", 5, 1400, "ハ", "", "", "A", "", "", ""),
    ("飲む", "verb", 6, 3700, "ノム", "", "", "A", "", "", ""),
    ("飲ま", "verb-mizen", 7, 3800, "ノマ", "飲む", "13", "A", "", "", ""),
    ("なかっ", "adjective", 8, 2500, "ナカッ", "無い", "16", "A", "", "", ""),
    ("ない", "adjective-end", 8, 2700, "ナイ", "無い", "", "A", "", "", ""),
    ("た", "auxiliary", 9, 1300, "タ", "", "", "A", "", "", ""),
    ("行く", "go", 6, 3500, "イク", "", "", "A", "", "", ""),
    ("行っ", "went", 7, 3550, "イッ", "行く", "18", "A", "", "", ""),
    ("いっ", "went", 7, 3650, "イッ", "行く", "18", "A", "", "", ""),
    ("mega", "noun", 2, 2000, "メガ", "メガ", "", "A", "", "", ""),
    ("特a", "noun", 3, 2900, "トクエー", "", "", "A", "", "", ""),
    ("な。な", "noun", 3, 2950, "ナナ", "", "", "A", "", "", ""),
    ("アイ", "noun", 2, 4500, "アイ", "", "", "A", "", "", ""),
    ("アイス", "noun", 2, 3600, "アイス", "", "", "A", "", "", ""),
    ("。", "stop", 11, 900, "。", "", "", "A", "", "", ""),
    ("円", "noun", 3, 2800, "エン", "", "", "A", "", "", ""),
    ("x", "sign", 10, -900, "x", "", "", "A", "", "", ""),
    ("x", "noun", 10, -900, "エックス", "", "", "A", "", "", ""),
    ("なま", "noun", 3, 3200, "ナマ", "生", "", "A", "", "", ""),
    ("さけのみ", "noun", 2, 3000, "サケノミ", "酒飲み", "", "A", "", "", ""),
    *[(c, "numeral", 10, 2200, r, "", "", "A", "", "", "") for c, r in zip("0123456789〇一二三四五六七八九十百千万億兆", "ゼロ イチ ニ サン ヨン ゴ ロク ナナ ハチ キュウ ゼロ イチ ニ サン ヨン ゴ ロク ナナ ハチ キュウ ジュウ ヒャク セン マン オク チョウ".split())],
]
USER_WORDS = [
    ("すだち", "noun", 2, 2500, "スダチ", "酢橘", "", "A", "", "", "", ""),
    ("ぴらる", "noun", 3, -32768, "ピラル", "", "", "A", "", "", "", ""),
    ("京都府", "place", 1, 2600, "キョウトフ", "", "", "B", "0/U3", "", "", ""),
    ("府", "noun", 3, 2900, "フ", "", "", "A", "", "", "", ""),
]
CATEGORIES = [("DEFAULT", False, True, 0), ("SPACE", False, True, 0), ("KANJI", False, False, 2), ("SYMBOL", True, True, 0), ("NUMERIC", True, True, 0), ("ALPHA", True, True, 0), ("HIRAGANA", False, True, 2), ("KATAKANA", True, True, 2), ("GREEK", True, True, 0), ("CYRILLIC", True, True, 0)]
UNKNOWN = [(c, i, i, cost, CLASSES[k]) for c, i, cost, k in [("DEFAULT", 10, 6000, "sign"), ("SPACE", 10, 3000, "sign"), ("KANJI", 2, 9000, "noun"), ("SYMBOL", 10, 5000, "sign"), ("NUMERIC", 2, 8000, "noun"), ("ALPHA", 2, 6500, "noun"), ("HIRAGANA", 3, 9500, "noun"), ("KATAKANA", 2, 7000, "noun"), ("GREEK", 2, 7000, "noun"), ("CYRILLIC", 2, 7000, "noun")]]
REWRITES = {"か゛": "が", "ウ゛": "ヴ", "ｶﾞ": "ガ", "ﾊﾟ": "パ"}
EXEMPT = set("⼼〜")
CONFIG = {
    "normalizers": [{"class": "DefaultInputText"}, {"class": "ProlongedSoundMark", "prolongedSoundMarks": ["ー", "-", "〜"], "replacementSymbol": "ー"}, {"class": "IgnoreYomigana", "maxYomiganaLength": 4}],
    "unknown": [{"class": "MeCabOov"}, {"class": "SimpleOov", "oovPOS": list(CLASSES["sign"]), "leftId": 10, "rightId": 10, "cost": 7000}],
    "rewriters": [{"class": "JoinNumeric", "enableNormalize": True}, {"class": "JoinKatakanaOov", "oovPOS": list(CLASSES["noun"]), "minLength": 3}],
}


def matrix() -> tuple[int, int, list[tuple[int, int, int]]]:
    return SIZE, SIZE, [(a, b, (a * 389 + b * 631) % 2003 - 700 if a and b else (a + b) * 40) for a in range(SIZE) for b in range(SIZE)]


def lexicon(words=WORDS) -> list[tuple]:
    """The rows as a lexicon file has them."""
    return [(s, i, i, cost, s, *CLASSES[k], r, n or s, d or "*", u, a or "*", b or "*", "*", y or "*") for s, k, i, cost, r, n, d, u, a, b, y, *_ in words]


def sample(spark: SparkSession) -> Dictionary:
    """The compiled sample dictionary with its plug-ins, one for each session."""
    return _sample(spark, spark.sparkContext.applicationId)


@lru_cache(maxsize=2)
def _sample(spark: SparkSession, app: str) -> Dictionary:
    d = DictionaryBuilder(spark, None, "sample", 0).read_conn(matrix()).read_lexicon(lexicon()).compile()
    d.categories, d.unknown, d.rewrites, d.exempt, d.config = CATEGORIES, UNKNOWN, REWRITES, EXEMPT, Config.of(CONFIG)
    return d


def user_words(spark: SparkSession) -> Dictionary:
    """A user dictionary over the sample."""
    return DictionaryBuilder(spark, sample(spark), "user words", 0).read_lexicon(lexicon(USER_WORDS)).compile()
