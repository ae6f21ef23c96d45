"""Analysis with the sample dictionary: paths, unknown words, rewriting, splitting, forms, building, storage, streams."""

import random

import pytest
from pyspark.sql import functions as F

from morphspark.functions import kernel
from morphspark.functions.chars import CharTable
from morphspark.functions.normalize import InputTooLong
from morphspark.operators import formats, relational
from morphspark.operators.analyzer import FIELDS, Analyzer, register_sql
from morphspark.operators.posmatch import PosMatcher
from morphspark.sources import config, formats as sources
from morphspark.sources.config import Config, ConfigError
from morphspark.sources.dictionary import Dictionary, DictionaryBuilder
from morphspark.sources.formats import BuildError
from morphspark.sources.sample import CLASSES, lexicon, matrix, sample, user_words
from morphspark.streaming.tokens import stream_tokens


@pytest.fixture(scope="module")
def held(spark):
    return sample(spark).compiled()


def words(d, text, mode="C", form=None):
    b, path = d.analyze(text, mode, None)
    return [b.original[b.place(x[0]) : b.place(x[1])] if form is None else x[7][form] or x[7][0] for x in path]


PATHS = [
    ("京都東京都京都", ["京都", "東京都", "京都"]), ("東京都大学", ["東京都大学"]), ("酒を飲まなかった人", ["酒", "を", "飲ま", "なかっ", "た", "人"]), ("MEGAへ行く", ["MEGA", "へ", "行く"]), ("特a", ["特a"]), ("ab", ["ab"]), ("特ab", ["特", "ab"]), ("İstanbul", ["İstanbul"]),
    ("徳島（とくしま）に行く", ["徳島（とくしま）", "に", "行く"]), ("1,234.5円", ["1,234.5", "円"]), ("2,00,000円", ["2", ",", "00", ",", "000", "円"]), ("三千五百円", ["三千五百", "円"]), ("1.20.3", ["1", ".", "20", ".", "3"]), ("アイスアイアイア", ["アイスアイアイア"]), ("", []),
]


@pytest.mark.parametrize("text,want", PATHS)
def test_paths(held, text, want):
    assert words(held, text) == want


def test_forms_and_modes(held):
    assert words(held, "酒を飲まなかった人", form=4) == ["酒", "を", "飲む", "ない", "た", "人"]
    assert words(held, "1,234.5円", form=3) == ["1234.5", "円"]
    assert words(held, "東京都大学", "A") == ["東京", "都", "大学"] and words(held, "東京都大学", "B") == ["東京都", "大学"]
    assert all(len(words(held, e)) == 1 for e in ("👩‍👩‍👦", "👍🏽"))


def test_best_path_is_the_cheapest(held):
    """All paths of words through short texts, one by one."""
    conn = held.costs

    def paths(text, at, right, total):
        if at == len(text):
            yield total + conn[right][0]
            return
        for end, left, r, cost, _ in held.found(text, at):
            yield from paths(text, end, r, total + conn[right][left] + cost)

    rng = random.Random(2)
    pieces = ["東京", "都", "京都", "大学", "東", "酒", "人", "は", "を", "行く"]
    for _ in range(30):
        text = "".join(rng.choice(pieces) for _ in range(5))
        t = kernel.Text(text, held.table)
        bare = kernel.Compiled([[]], {}, held.conn, held.pos, held.table)
        bare.words, bare.lengths, bare.infos = held.words, held.lengths, held.infos
        bare.unknown = [kernel.SimpleUnknown(0, 1, 1, 30000)]
        last = bare.best(t)[-1]
        assert last[6] + conn[last[3]][0] == min(paths(text, 0, 0, 0))


def test_first_of_equal_paths_wins(held):
    x = held.analyze("x")[1][0]
    assert x[7][2] == next(k for k, p in enumerate(held.pos) if p == CLASSES["sign"])


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(held, seed):
    rng = random.Random(seed)
    alphabet = "東京都大学酒を飲む行っアイスーab1,.万百 。（）\x00　‍́É…㈱👩か゛-"
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))
        b, path = held.analyze(text)
        if path:
            assert "".join(words(held, text)) == text
            assert path[0][0] == 0 and path[-1][1] == len(b.text) and all(x[1] == y[0] for x, y in zip(path, path[1:]))
        for mode in "AB":
            assert "".join(words(held, text, mode)) == "".join(words(held, text))


def test_category_unknown():
    table = CharTable()
    for invoke in (False, True):
        for group in (False, True):
            for length in (0, 1, 2, 3):
                p = kernel.CategoryUnknown({4: (invoke, group, length)}, {4: [(1, 1, 5, 0)]})
                t = kernel.Text("京都大", table)
                for has in (set(), {1}):
                    want = [] if has and not invoke else ([3] if group else []) + [k for k in (1, 2, 3) if k <= length and k <= 3 - group]
                    assert [x[0] for x in p.propose(t, 0, has)] == want


def test_regex_unknown(held):
    t = kernel.Text("京都XAG-2F東京", held.table)
    p = kernel.RegexUnknown("[0-9a-zA-Z-]+", 1, 2, 2, 100)
    assert [x[0] for x in p.propose(t, 2, set())] == [8] and p.propose(t, 3, set()) == [] and p.propose(t, 2, {8}) == []
    with pytest.raises(ValueError):
        kernel.RegexUnknown("a(?=b)", 1, 2, 2, 100)


def test_no_provider(spark, held):
    bare = kernel.Compiled([[]], {}, held.conn, held.pos, held.table)
    with pytest.raises(kernel.AnalysisError):
        bare.analyze("あ")


def test_columns_and_errors(spark):
    d = sample(spark)
    long = "東京" * 20_000
    df = spark.createDataFrame([(1, "東京に行く", 5), (2, None, 5), (3, "", 5), (4, long, 5)], "id int, text string, index int")
    got = df.select("id", Analyzer(d, on_error="null").analyze("text").alias("m")).orderBy("id").collect()
    assert [None if r.m is None else len(r.m) for r in got] == [3, None, 0, None]
    assert len(df.where("id = 4").select(Analyzer(d, max_bytes=None).analyze("text").alias("m")).first().m) == 20_000
    with pytest.raises(Exception, match="bytes"):
        df.select(Analyzer(d).analyze("text")).collect()
    with pytest.raises(InputTooLong):
        d.compiled().analyze(long)
    for bad in ({"mode": "D"}, {"fields": ["nothing"]}, {"projection": "nothing"}, {"on_error": "skip"}):
        with pytest.raises(ConfigError):
            Analyzer(d, **bad)
    assert set(Analyzer(d).fields) == set(FIELDS)


def test_plan_prunes_and_pushes(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "東京", "x"), (2, "京都", "y")], "id int, text string, other string").write.parquet(path)
    df = spark.read.parquet(path)
    rows = df.withColumn("m", Analyzer(sample(spark)).analyze("text")).where("id = 1")
    plan = rows.select("id", F.size("m"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,1)]" in plan and "other" not in plan.split("ReadSchema")[1]
    assert "ArrowEvalPython" not in rows.select("id")._jdf.queryExecution().executedPlan().toString()


def test_formats(spark):
    a = Analyzer(sample(spark))
    df = spark.createDataFrame([("京都に",), ("",), (None,)], "text string")
    got = [tuple(r) for r in df.select(formats.wakati(a.analyze("text")), formats.tsv(a.analyze("text"), True), formats.text_of(a.analyze("text"))).collect()]
    assert got[0] == ("京都 に", "京都\t名詞,固有名詞,地名,一般,*,*\t京都\t京都\tキョウト\t0\t[1,5]\nに\t助詞,格助詞,*,*,*,*\tに\tに\tニ\t0\t[]\nEOS", "[<京都(0:2)>, <に(2:3)>]")
    assert got[1][:2] == ("", "EOS") and got[2] == (None, None, None)


def test_projections_precedence_and_pretokens(spark):
    d = sample(spark).with_config({"projection": "reading"})
    df = spark.createDataFrame([("酒を飲まなかった人",)], "text string")
    assert df.select(Analyzer(d).surface("text")).first()[0] == ["サケ", "ヲ", "ノマ", "ナカッ", "タ", "ヒト"]
    assert df.select(Analyzer(d, projection="dictionary_and_surface").pretokenize("text")).first()[0] == ["酒", "を", "飲ま", "なかっ", "た", "人"]
    only = Analyzer(d).pretokenize("text", lambda m: F.transform(F.filter(m, lambda x: F.get(x["pos"], F.lit(0)) == "名詞"), lambda x: x["surface"]))
    assert df.select(only).first()[0] == ["酒", "人"]


def test_sentence_tokens(spark):
    a = Analyzer(sample(spark))
    df = spark.createDataFrame([(1, "な。なに行く。東京は京都。")], "id int, text string")
    assert [r.sentence_text for r in a.sentence_tokens(df, split="only").collect()] == ["な。なに行く。", "東京は京都。"]
    assert {r.sentence for r in a.sentence_tokens(df).collect()} == {0, 1}
    assert {r.sentence for r in a.sentence_tokens(df, split="no").collect()} == {0}


def test_sql_function(spark):
    register_sql(Analyzer(sample(spark), fields=("normalized_form",)), "tokens_of")
    rows = spark.sql("select t.surface, t.normalized_form from values ('MEGAへ'), (null) v(x), lateral tokens_of(x) t").collect()
    assert [tuple(r) for r in rows] == [("MEGA", "メガ"), ("へ", "へ")]


def test_user_dictionary(spark):
    d = sample(spark).with_user(user_words(spark))
    k = d.compiled()
    assert words(k, "京都府に行く") == ["京都府", "に", "行く"] and words(k, "京都府に行く", "A") == ["京都", "府", "に", "行く"]
    auto = d.table("lexicon").where("surface = 'ぴらる'").first()
    base = sample(spark).compiled().internal_cost("ぴらる")
    assert auto.cost == base[0] - 20 * base[1] and auto.word_id == (1 << 28) + 1
    two = d.with_user(user_words(spark))
    assert {r.dic_id for r in two.table("lexicon").select("dic_id").distinct().collect()} == {0, 1, 2}
    assert two.compiled().analyze("すだち")[1][0][5] >> 28 == 2


def test_save_and_load(spark, tmp_path):
    sample(spark).save(f"{tmp_path}/d")
    d = Dictionary.load(spark, f"{tmp_path}/d")
    assert words(d.compiled(), "東京都大学に1,000円") == ["東京都大学", "に", "1,000", "円"]
    with pytest.raises(ConfigError):
        Dictionary.load(spark, f"{tmp_path}/d", kind="user")
    with pytest.raises(Exception, match="(?i)exists"):
        sample(spark).save(f"{tmp_path}/d")
    config.register_edition("core", f"{tmp_path}/d")
    assert config.edition("core") == f"{tmp_path}/d"
    with pytest.raises(ConfigError):
        config.edition("full")


def row(surface="木", left=1, right=1, cost=5, unit="A", a="*", b="*", form="*", n=19):
    return (surface, left, right, cost, surface, *CLASSES["noun"], surface, surface, form, unit, a, b, "*", "*")[:n]


BAD = [(row(""), "empty surface"), (row(n=17), "too few fields"), (row(left="x"), "bad number"), (row(left=12), "connection id out of range"), (row(cost=40000), "cost out of range"), (row(unit="D"), "bad split unit"), (row(a="0/0"), "A unit with parts"), (row(unit="B", a="/".join(["0"] * 128)), "too many units"), (row(unit="B", a="0/x"), "bad split"), (row(form="q"), "bad dictionary form"), (row(unit="B", a="0/5"), "reference out of range"), (row(unit="B", a="0/草,名詞,普通名詞,一般,*,*,*,クサ"), "split can't be resolved")]


@pytest.mark.parametrize("bad,kind", BAD)
def test_build_errors(spark, bad, kind):
    b = DictionaryBuilder(spark).read_conn(matrix()).read_lexicon([row(), bad])
    with pytest.raises(BuildError) as e:
        b.compile()
    assert (e.value.kind, e.value.line) == (kind, 2)


def test_readers(spark, tmp_path):
    (tmp_path / "m").write_text("\n2 2\n0 0 1\n0 1 -2\n\n1 0 3\n1 1 4\n")
    n, m, rows = sources.read_matrix(spark, str(tmp_path / "m"))
    assert (n, m, sorted(tuple(r) for r in rows.collect())) == (2, 2, [(0, 0, 1), (0, 1, -2), (1, 0, 3), (1, 1, 4)])
    for bad in ("", "2\n", "2 2\n0 5 1\n", "2 2\n0 x 1\n", "2 2\n0 0 99999\n"):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(BuildError):
            sources.read_matrix(spark, str(tmp_path / "bad"))
    assert sources.parse_characters(["ALPHA 1 1 0 # x", "0x41..0x5A ALPHA", "0x30 NUMERIC"]) == ([(0x41, 0x5B, 32), (0x30, 0x31, 16)], [("ALPHA", True, True, 0)])
    assert sources.parse_rewrites(["# x", "Ⅲ", "か゛ が"]) == ({"か゛": "が"}, {"Ⅲ"})
    for bad in (["a b c"], ["ab"], ["a b", "a c"]):
        with pytest.raises(BuildError):
            sources.parse_rewrites(bad)
    assert sources.unescape(r"aA\u{1F385}") == "aA🎅"
    with pytest.raises(BuildError):
        sources.unescape(r"\u{110000}")


def test_build_from_files(spark, tmp_path):
    import csv

    n, m, rows = matrix()
    (tmp_path / "matrix").write_text(f"{n} {m}\n" + "\n".join(f"{a} {b} {c}" for a, b, c in rows))
    with open(tmp_path / "lex.csv", "w", newline="") as f:
        csv.writer(f).writerows(lexicon())
    b = DictionaryBuilder(spark).read_conn(str(tmp_path / "matrix")).read_lexicon(str(tmp_path / "lex.csv"))
    got = b.compile()
    same = lambda d: sorted(map(tuple, d.table("lexicon").collect()))
    assert same(got) == same(sample(spark)) and {r.part for r in b.report().collect()} == {"matrix", "lexicon", "parts of speech", "word infos"}


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"systemDict": "s", "userDict": "u", "projection": "reading"}')
    c = Config.of(str(tmp_path / "c.json"))
    assert c.system == "s" and c.user == ("u",) and Config.of('{"system": "t"}').over(c).system == "t"
    assert c.find("c.json").endswith("c.json") and Config.of(c.as_json()) == c and c.update(system="q").system == "q"
    for bad in ('{"nothing": 1}', "{", '{"projection": "x"}', "no such file"):
        with pytest.raises(ConfigError):
            Config.of(bad)
    with pytest.raises(ConfigError):
        c.find("missing")


def test_pos_matcher(spark):
    pos = sample(spark).part_of_speech()
    nouns, verbs = PosMatcher.of(pos, [("名詞",)]), PosMatcher.of(pos, lambda p: p[0] == "動詞")
    assert len(nouns | verbs) == len(nouns) + len(verbs) and len(nouns & verbs) == 0 and len(~nouns) == len(pos) - len(nouns)
    assert set(nouns - nouns) == set() and [p[0] for p in verbs] == ["動詞"] * len(verbs)
    with pytest.raises(ConfigError):
        PosMatcher.of(pos, [("名詞", "ない")])


def test_lookup_and_split(spark):
    d = sample(spark)
    q = spark.createDataFrame([("東京都",), ("ない語",), (None,)], "q string")
    assert [r.word_id for r in relational.lookup(q, d.table("lexicon"), "q").collect()] == [4]
    t = spark.createDataFrame([(1, 0, 5, 6), (2, 5, 6, 9)], "id int, begin int, end int, word_id long")
    got = sorted(tuple(r) for r in relational.split_tokens(t, d.table("lexicon"), "A", ["id"]).collect())
    assert got == [(1, 0, 0, 2, 1), (1, 1, 2, 3, 3), (1, 2, 3, 5, 5), (2, 0, 5, 6, 9)]
    assert relational.split_tokens(t, d.table("lexicon"), "A", ["id"], add_single=False).count() == 3


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("東京に行く\n京都\n", encoding="utf-8")
    rows = stream_tokens(spark.readStream.text(str(tmp_path / "in")), Analyzer(sample(spark), fields=()))
    rows.writeStream.format("memory").queryName("stream_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.surface for r in spark.table("stream_rows").collect()) == ["に", "京都", "東京", "行く"]
