"""Character classes, normalisation, numbers and sentences on texts with known results."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from morphspark.functions import chars, numbers, sentences
from morphspark.functions.normalize import Buffer, DefaultNormalizer, IgnoreReadings, InputTooLong, ProlongedMarks

TABLE = chars.CharTable()
DEFAULT = DefaultNormalizer({"か゛": "が", "ウ゛": "ヴ", "ｶﾞ": "ガ"}, {"⼼"})


def run(f, text):
    b = Buffer(text)
    f(b)
    return b


def test_ranges_overlap_and_merge():
    got = chars.compile_ranges([(10, 20, 2), (15, 30, 4), (30, 40, 4)])
    assert got == [(0, 10, 1), (10, 15, 2), (15, 20, 6), (20, 40, 4), (40, 0x110000, 1)]
    rng = random.Random(1)
    ranges = [(a := rng.randrange(200), a + rng.randrange(1, 40), 1 << rng.randrange(1, 5)) for _ in range(30)]
    table = chars.CharTable(ranges)
    for c in range(260):
        assert table(chr(c)) == (sum({m for lo, hi, m in ranges if lo <= c < hi}) or 1)


def test_unknown_class_name():
    with pytest.raises(ValueError):
        chars.mask_of("NUMERIC NOTHING")


def test_runs_and_beginnings():
    masks = TABLE.masks("特ab京都")
    assert chars.run_lengths(masks) == [1, 2, 1, 2, 1]
    assert chars.can_begin(masks) == [True, True, False, True, True]
    assert chars.can_begin(TABLE.masks("👩‍👩")) == [True, False, False]
    assert chars.can_begin(TABLE.masks("ée")) == [True, False, False]
    assert chars.common([6, 4, 12], 0, 3) == 4 and chars.common([6], 1, 1) == 0
    assert chars.to_next_begin([True, False, False, True], 0) == 3 and chars.to_next_begin([True], 0) == 1


def test_default_normalizer():
    b = run(DEFAULT, "ÂＢΓД㈱ｶﾞウ゛⼼Ⅲ")
    assert b.text == "âbγд(株)ガヴ⼼iii"
    assert run(DEFAULT, "İ").text == "i̇" and run(DEFAULT, "ẞΣ").text == "ßσ"
    dots = run(DEFAULT, "京都…")
    assert dots.text == "京都..." and dots.origin == [0, 1, 2, 3, 3, 3]
    assert run(DEFAULT, "か゛か").text == "がか"


def test_longest_and_shortest_pairs():
    f = DefaultNormalizer({"ab": "1", "abc": "2"})
    assert run(f, "xabc").text == "x2" and run(f, "Xabc").text == "x1c"


def test_prolonged_marks_and_readings():
    assert run(ProlongedMarks(), "なまーー〜。").text == "なまー。" and run(ProlongedMarks(), "ー").text == "ー"
    b = run(IgnoreReadings(TABLE), "徳島（とくしま）に行く")
    assert b.text == "徳島に行く" and b.origin == [0, 1, 8, 9, 10, 11]
    assert run(IgnoreReadings(TABLE), "徳島（とくしまけん）に").text == "徳島（とくしまけん）に"


def test_edits_chain():
    b = Buffer("宇宙人")
    b.edit([(0, 1, "銀河")])
    assert (b.text, b.origin) == ("銀河宙人", [0, 1, 1, 2, 3])
    b.edit([(1, 3, "")])
    assert (b.text, b.origin) == ("銀人", [0, 2, 3])
    b.edit([(0, 2, "")])
    assert (b.text, b.origin) == ("", [0])


def test_too_long():
    with pytest.raises(InputTooLong):
        Buffer("あ" * 16384)
    assert Buffer("あ" * 16383).text and Buffer("あ" * 20000, None).text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_normalizer_places(text):
    b = run(DEFAULT, text)
    origin = b.origin or list(range(len(text) + 1))
    assert len(origin) == len(b.text) + 1 and origin[0] == 0 and origin == sorted(origin) and origin[-1] in (0, len(text))
    if text.isascii():
        assert b.text == text.lower()


NUMBERS = [("1000", "1000"), ("1,000", "1000"), ("二十七", "27"), ("三兆2千億千三百二十七万一四.〇五", "3200013270014.05"), ("1.5百万1.5千20", "1501520"), ("6.0", "6"), ("00.1000", "00.1"), ("千", "1000"), ("〇", "0"), ("1234567890123456789012345", "1234567890123456789012345"), ("0.5", "0.5"), ("256,550.389", "256550.389"), ("一万", "10000")]
NOT_NUMBERS = [("200,00,000", "comma"), ("2,4", "comma"), ("000,000", "comma"), (",000", "comma"), ("256,55.1", "comma"), ("6.", "point"), ("1.2.3", "point"), (".5", "point"), ("万", ""), ("百百千", ""), ("x", "")]


@pytest.mark.parametrize("text,value", NUMBERS)
def test_numbers(text, value):
    assert numbers.normalize_number(text) == value


@pytest.mark.parametrize("text,error", NOT_NUMBERS)
def test_no_numbers(text, error):
    r = numbers.NumberReader()
    assert not (all(map(r.append, text)) and r.done()) and r.error == error
    assert numbers.normalize_number(text) is None


@given(st.integers(0, 10**30))
def test_number_round_trip(n):
    assert numbers.normalize_number(f"{n:,}") == str(n)


ENDS = [("あいうえお。", 6), ("あいう。えお", 4), ("あいう。。えお。", 5), ("あいうえお", -5), ("", 0), ("あいう.えお", 4), ("3.141", -5), ("四百十.〇", -5), ("あいうえお!??", 8), ("あ（いう。え）お", -8), ("あ（いう）。えお", 6), ("1. あいう。えお", 7), ("あいう?えお", 4), ("あいう?)えお", 5), ("あいう?,えお", 5), ("あいう?です。", 7), ("あいう?という。", 8), ("あいう?の？です。", 4), ("1.と2.が。", 7), ("1.やb.から。", 8), ("Hello world. Next.", -18), ("été. Le", 4), ("a<br><br>b", 9)]


@pytest.mark.parametrize("text,end", ENDS)
def test_sentence_ends(text, end):
    assert sentences.first_end(text) == end


def test_sentence_limit():
    assert sentences.first_end("あいうえおか。", None, 5) == -5
    assert sentences.first_end("あい うえお", None, 5) == -3
    assert sentences.spans("あいうえおか。き。", None, 5) == [(0, 9)]


@given(st.text(alphabet="あ。?（）.1a \n、", max_size=60))
def test_sentences_tile(text):
    got = sentences.spans(text)
    assert "".join(text[a:b] for a, b in got) == text and all(a < b for a, b in got)


def test_begin_places_agree(spark):
    from morphspark.operators import candidates

    rng = random.Random(7)
    texts = ["".join(rng.choice("aé京あア1 ‍́γд👩。") for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    rows = df.select("text", candidates.begin_places(chars.default_ranges(), "text").alias("at"), candidates.class_runs(chars.default_ranges(), "text").alias("runs")).collect()
    for r in rows:
        if r.text is None:
            assert r["at"] is None and r.runs is None
            continue
        masks = TABLE.masks(r.text)
        assert r["at"] == list(np.flatnonzero(chars.can_begin(masks))) if masks else r["at"] == []
        assert [m for x in r.runs for m in [x.mask] * (x.end - x.begin)] == masks
