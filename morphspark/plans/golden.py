"""What small texts give, as this engine gave it and read over by hand: fixed values for queries that SQL can't compute."""

#: query -> (columns, those of 64 bits, rows)
EXPECTED: dict[str, tuple[list[str], list[str], list[tuple]]] = {
    "rewritten_inline": (["id", "text", "places"], [], [
        (1, "abc", "0 1 2 3"),
        (2, "カ ゙が", "0 1 2 2 4"),
        (3, "ヴガ", "0 2 4"),
        (4, "東京(とうきょう)へ", "0 1 2 3 4 5 6 7 8 9 10"),
        (5, "すごーいー", "0 1 2 4 5 7"),
        (6, "株式会社vi", "0 1 1 1 1 2 3"),
        (7, "", "0"),
        (8, "àé 1⁄2", "0 1 2 3 4 4 4"),
        (9, "都京(きょうきょう)", "0 4 5 6 7 8 9 10 11 12 13"),
    ]),
    "sentences_inline": (["id", "index", "begin", "end"], [], [
        (1, 0, 0, 6),
        (1, 1, 6, 11),
        (2, 0, 0, 12),
        (3, 0, 0, 6),
        (4, 0, 0, 8),
        (4, 1, 8, 10),
        (5, 0, 0, 7),
        (5, 1, 7, 8),
        (6, 0, 0, 5),
        (6, 1, 5, 6),
        (7, 0, 0, 9),
        (7, 1, 9, 10),
        (8, 0, 0, 6),
        (8, 1, 6, 7),
    ]),
    "dictionary_of_sources": (["id", "index", "begin", "end", "surface", "normalized_form", "is_oov"], [], [
        (1, 0, 0, 6, "コンピュータ", "コンピュータ", True),
        (1, 1, 6, 7, "は", "は", False),
        (1, 2, 7, 8, "1", "1", False),
        (1, 3, 8, 9, "2", "2", False),
        (1, 4, 9, 10, "円", "円", False),
        (2, 0, 0, 2, "か゛", "が", True),
        (2, 1, 2, 4, "〜。", "〜。", True),
        (3, 0, 0, 4, "mega", "メガ", False),
        (3, 1, 4, 6, "特a", "特a", False),
        (3, 2, 6, 7, " ", " ", True),
        (3, 3, 7, 10, "ABC", "abc", True),
        (4, 0, 0, 2, "京都", "京都", False),
        (4, 1, 2, 3, "へ", "へ", False),
        (4, 2, 3, 5, "行っ", "行く", False),
        (4, 3, 5, 6, "た", "た", False),
        (4, 4, 6, 8, "!!", "!!", True),
        (5, 0, 0, 1, "酒", "酒", False),
        (5, 1, 1, 2, " ", " ", True),
        (5, 2, 2, 3, "酒", "酒", False),
    ]),
    "joined_numbers": (["id", "index", "surface", "normalized_form"], [], [
        (1, 0, "12億34万5", "1200340005"),
        (2, 0, "1,234.50", "1234.5"),
        (2, 1, "円", "円"),
        (3, 0, "1", "1"),
        (3, 1, ",", ","),
        (3, 2, "2", "2"),
        (3, 3, "3", "3"),
        (4, 0, "三百二十", "320"),
        (5, 0, "0", "0"),
        (5, 1, ".", "."),
        (5, 2, "5", "5"),
        (5, 3, ".", "."),
        (5, 4, "2", "2"),
        (6, 0, "二〇〇〇", "2000"),
        (7, 0, "千万", "10000000"),
        (8, 0, "1,000,000", "1000000"),
        (9, 0, "5", "5"),
        (9, 1, ".", "."),
        (9, 2, "円", "円"),
        (10, 0, "六三四", "634"),
    ]),
    "regex_words": (["id", "index", "surface", "is_oov"], [], [
        (1, 0, "東京", False),
        (1, 1, "ab-12", True),
        (1, 2, "行く", False),
        (2, 0, "xab-1", True),
        (3, 0, "酒", False),
        (3, 1, "a1-22", True),
        (3, 2, "に", False),
        (4, 0, "ab", True),
        (4, 1, "-", True),
        (5, 0, "大学", False),
        (5, 1, "-", True),
        (5, 2, "1", False),
    ]),
    "split_morphemes": (["id", "index", "part", "begin", "end", "surface", "word_id"], ["word_id"], [
        (1, 0, 0, 0, 2, "東京", 1),
        (1, 0, 1, 2, 3, "都", 3),
        (1, 0, 2, 3, 5, "大学", 5),
        (3, 1, 0, 2, 4, "東京", 1),
        (3, 1, 1, 4, 5, "都", 3),
    ]),
    "tokens_inline": (["id", "index", "begin", "end", "surface", "normalized_form", "dictionary_form", "reading_form", "pos_id", "is_oov"], [], [
        (1, 0, 0, 5, "東京都大学", "東京都大学", "東京都大学", "トウキョウトダイガク", 0, False),
        (1, 1, 5, 6, "に", "に", "に", "ニ", 2, False),
        (1, 2, 6, 8, "行く", "行く", "行く", "イク", 9, False),
        (1, 3, 8, 9, "。", "。", "。", "。", 11, False),
        (2, 0, 0, 1, "酒", "酒", "酒", "サケ", 1, False),
        (2, 1, 1, 2, "を", "を", "を", "ヲ", 2, False),
        (2, 2, 2, 4, "飲ま", "飲む", "飲む", "ノマ", 5, False),
        (2, 3, 4, 7, "なかっ", "無い", "ない", "ナカッ", 6, False),
        (2, 4, 7, 8, "た", "た", "た", "タ", 8, False),
        (2, 5, 8, 9, "人", "人", "人", "ヒト", 1, False),
        (3, 0, 0, 2, "京都", "京都", "京都", "キョウト", 0, False),
        (3, 1, 2, 5, "東京都", "東京都", "東京都", "トウキョウト", 0, False),
        (3, 2, 5, 7, "京都", "京都", "京都", "キョウト", 0, False),
        (4, 0, 0, 4, "MEGA", "メガ", "mega", "メガ", 1, False),
        (4, 1, 4, 5, "へ", "へ", "へ", "ヘ", 2, False),
        (4, 2, 5, 7, "行く", "行く", "行く", "イク", 9, False),
        (5, 0, 0, 8, "徳島（とくしま）", "徳島", "徳島", "徳島", 1, True),
        (5, 1, 8, 9, "に", "に", "に", "ニ", 2, False),
        (5, 2, 9, 11, "行っ", "行く", "行く", "イッ", 10, False),
        (5, 3, 11, 12, "た", "た", "た", "タ", 8, False),
        (5, 4, 12, 13, "。", "。", "。", "。", 11, False),
        (6, 0, 0, 2, "なま", "生", "なま", "ナマ", 1, False),
        (6, 1, 2, 6, "〜〜ーー", "ー", "ー", "ー", 1, True),
        (6, 2, 6, 7, "。", "。", "。", "。", 11, False),
        (7, 0, 0, 3, "アイス", "アイス", "アイス", "アイス", 1, False),
        (7, 1, 3, 4, "は", "は", "は", "ハ", 3, False),
        (7, 2, 4, 9, "1,200", "1200", "1,200", "イチニゼロゼロ", 13, True),
        (7, 3, 9, 10, "円", "円", "円", "エン", 1, False),
    ]),
    "lattice_nodes": (["id", "begin", "end", "word_id", "cost", "total_cost"], ["word_id"], [
        (1, 0, 1, 2, 4400, 4480),
        (1, 0, 2, 1, 2300, 2340),
        (1, 0, 3, 4, 3900, 3940),
        (1, 1, 3, 0, 4100, 9289),
        (1, 2, 3, 3, 3000, 4919),
        (2, 0, 1, 2, 4400, 4480),
        (2, 0, 2, 1, 2300, 2340),
        (2, 0, 3, 4, 3900, 3940),
        (2, 0, 5, 6, 5200, 5240),
        (2, 1, 3, 0, 4100, 9289),
        (2, 2, 3, 3, 3000, 4919),
        (2, 3, 5, 5, 2600, 7245),
        (3, 0, 1, 7, 3300, 3380),
        (3, 1, 2, 12, 1400, 6010),
        (3, 2, 3, 8, 3100, 9614),
        (4, 0, 2, 0, 4100, 4140),
        (4, 2, 3, 11, 1700, 6050),
        (4, 3, 5, 18, 3500, 10186),
        (5, 0, 1, 2, 4400, 4480),
        (5, 0, 2, 1, 2300, 2340),
        (5, 1, 2, 4026531852, 7000, 11859),
        (5, 2, 4, 5, 2600, 5891),
    ]),
    "user_dictionary": (["id", "index", "surface", "normalized_form", "dictionary_id"], [], [
        (1, 0, "京都", "京都", 0),
        (1, 1, "府", "府", 1),
        (1, 2, "に", "に", 0),
        (1, 3, "行く", "行く", 0),
        (2, 0, "すだち", "酢橘", 1),
        (2, 1, "酒", "酒", 0),
        (2, 2, "を", "を", 0),
        (2, 3, "飲む", "飲む", 0),
        (3, 0, "ぴらる", "ぴらる", 1),
        (3, 1, "は", "は", 0),
        (3, 2, "府", "府", 1),
    ]),
    "internal_cost": (["id", "cost"], [], [
        (1, 7409),
        (2, 15264),
        (3, 8640),
        (4, 6435),
        (5, 8633),
        (6, 8636),
        (7, 17790),
        (8, 0),
    ]),
    "tsv_texts": (["id", "lines"], [], [
        (1, "東京都大学\t名詞,固有名詞,地名,一般,*,*\t東京都大学\t東京都大学\tトウキョウトダイガク\t0\t[]\nに\t助詞,格助詞,*,*,*,*\tに\tに\tニ\t0\t[]\n行く\t動詞,非自立可能,*,*,五段-カ行,終止形-一般\t行く\t行く\tイク\t0\t[]\n。\t補助記号,句点,*,*,*,*\t。\t。\t。\t0\t[]\nEOS"),
        (2, "酒\t名詞,普通名詞,一般,*,*,*\t酒\t酒\tサケ\t0\t[7]\nを\t助詞,格助詞,*,*,*,*\tを\tを\tヲ\t0\t[]\n飲ま\t動詞,一般,*,*,五段-マ行,未然形-一般\t飲む\t飲む\tノマ\t0\t[]\nなかっ\t形容詞,非自立可能,*,*,形容詞,連用形-促音便\t無い\tない\tナカッ\t0\t[]\nた\t助動詞,*,*,*,助動詞-タ,終止形-一般\tた\tた\tタ\t0\t[]\n人\t名詞,普通名詞,一般,*,*,*\t人\t人\tヒト\t0\t[]\nEOS"),
        (3, "京都\t名詞,固有名詞,地名,一般,*,*\t京都\t京都\tキョウト\t0\t[1,5]\n東京都\t名詞,固有名詞,地名,一般,*,*\t東京都\t東京都\tトウキョウト\t0\t[]\n京都\t名詞,固有名詞,地名,一般,*,*\t京都\t京都\tキョウト\t0\t[1,5]\nEOS"),
        (4, "MEGA\t名詞,普通名詞,一般,*,*,*\tメガ\tmega\tメガ\t0\t[]\nへ\t助詞,格助詞,*,*,*,*\tへ\tへ\tヘ\t0\t[]\n行く\t動詞,非自立可能,*,*,五段-カ行,終止形-一般\t行く\t行く\tイク\t0\t[]\nEOS"),
        (5, "徳島（とくしま）\t名詞,普通名詞,一般,*,*,*\t徳島\t徳島\t徳島\t-1\t[]\t(OOV)\nに\t助詞,格助詞,*,*,*,*\tに\tに\tニ\t0\t[]\n行っ\t動詞,非自立可能,*,*,五段-カ行,連用形-促音便\t行く\t行く\tイッ\t0\t[]\nた\t助動詞,*,*,*,助動詞-タ,終止形-一般\tた\tた\tタ\t0\t[]\n。\t補助記号,句点,*,*,*,*\t。\t。\t。\t0\t[]\nEOS"),
        (6, "なま\t名詞,普通名詞,一般,*,*,*\t生\tなま\tナマ\t0\t[]\n〜〜ーー\t名詞,普通名詞,一般,*,*,*\tー\tー\tー\t-1\t[]\t(OOV)\n。\t補助記号,句点,*,*,*,*\t。\t。\t。\t0\t[]\nEOS"),
        (7, "アイス\t名詞,普通名詞,一般,*,*,*\tアイス\tアイス\tアイス\t0\t[]\nは\t助詞,係助詞,*,*,*,*\tは\tは\tハ\t0\t[]\n1,200\t名詞,数詞,*,*,*,*\t1200\t1,200\tイチニゼロゼロ\t-1\t[]\t(OOV)\n円\t名詞,普通名詞,一般,*,*,*\t円\t円\tエン\t0\t[]\nEOS"),
        (8, "EOS"),
    ]),
}
