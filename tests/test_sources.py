"""Dictionaries of files and configurations, plug-ins of one's own, and what rows of morphemes offer."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from morphspark import cli
from morphspark.functions import kernel
from morphspark.operators import formats
from morphspark.operators.analyzer import Analyzer, SplitMode, spread
from morphspark.plans import inline
from morphspark.sources import config, dictionary, sample
from morphspark.sources.dictionary import Dictionary
from morphspark.streaming.tokens import windowed_counts


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    """Files of a whole dictionary, and a configuration that names them."""
    d = tmp_path_factory.mktemp("sources")
    n, m, rows = sample.matrix()
    (d / "matrix.def").write_text(f"{n} {m}\n" + "\n".join(f"{a} {b} {c}" for a, b, c in rows))
    for name, words in (("lex.csv", sample.lexicon()), ("user.csv", sample.lexicon(sample.USER_WORDS))):
        with open(d / name, "w", newline="") as f:
            csv.writer(f).writerows(words)
    (d / "char.def").write_text("\n".join(inline.CHARACTER_LINES), encoding="utf-8")
    (d / "unk.def").write_text("\n".join(inline.UNKNOWN_LINES), encoding="utf-8")
    (d / "rewrite.def").write_text("\n".join(inline.REWRITE_LINES), encoding="utf-8")
    settings = {
        "systemDict": "system", "userDict": ["user"], "characterDefinitionFile": "char.def",
        "inputTextPlugin": [{"class": "DefaultInputTextPlugin", "rewriteDef": "rewrite.def"}],
        "oovProviderPlugin": [{"class": "MeCabOovPlugin", "charDef": "char.def", "unkDef": "unk.def"}],
    }
    (d / "config.json").write_text(json.dumps(settings), encoding="utf-8")
    return d


def surfaces(d, text, mode="C"):
    spark = d.spark
    return spark.createDataFrame([(text,)], "text string").select(Analyzer(d, mode).surface("text").alias("s")).first().s


def test_dictionary_of_files(spark, sources, tmp_path):
    cli.main(["build", "--matrix", f"{sources}/matrix.def", "--characters", f"{sources}/char.def", "--unknown", f"{sources}/unk.def", "--rewrites", f"{sources}/rewrite.def", str(tmp_path / "whole"), f"{sources}/lex.csv"], spark)
    whole = Dictionary.load(spark, str(tmp_path / "whole"))
    assert surfaces(whole, "コンピュータに12") == ["コンピュータ", "に", "1", "2"] and whole.exempt == {"〜"} and whole.rewrites == {"か゛": "が"}
    # The same from a dictionary without definitions, by the files that a configuration names.
    cli.main(["build", "--matrix", f"{sources}/matrix.def", f"{sources}/system", f"{sources}/lex.csv"], spark)
    cli.main(["ubuild", "--system", f"{sources}/system", f"{sources}/user", f"{sources}/user.csv"], spark)
    d = Dictionary.open(spark, f"{sources}/config.json")
    assert surfaces(d, "コンピュータに京都府", "A") == ["コンピュータ", "に", "京都", "府"]
    assert surfaces(Dictionary.open(spark, {**json.loads((sources / "config.json").read_text()), "userDict": []}, resources=str(sources)), "か゛コン") == ["か゛", "コン"]
    (tmp_path / "in.txt").write_text("コンピュータと酒", encoding="utf-8")
    cli.main(["tokenize", str(tmp_path / "in.txt"), str(tmp_path / "out"), "--config", f"{sources}/config.json", "--wakati"], spark)
    assert spark.read.text(str(tmp_path / "out")).first().value == "コンピュータ と 酒"
    with pytest.raises(config.ConfigError):
        Dictionary.open(spark, {})
    assert "58 words" in repr(d)


def test_editions_are_kept(spark, sources, tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    cli.main(["edition", "tiny", "/somewhere"], spark)
    monkeypatch.setattr(config, "_EDITIONS", {})
    assert config.edition("tiny") == "/somewhere"
    with pytest.raises(config.ConfigError):
        config.edition("huge")


def test_connection_plugin(spark):
    dictionary.register_plugin("connection", "Dearer", lambda d, s: lambda conn: conn.withColumn("cost", (F.col("cost") + s["by"]).cast("short")))
    d = sample.sample(spark)
    edited = d.with_config({"connection": [{"class": "Dearer", "by": 7}, {"class": "InhibitConnection", "inhibitPair": [[0, 1]]}]}).edited_conn()
    was = {(r.left, r.right): r.cost for r in d.table("conn").collect()}
    assert {(r.left, r.right): r.cost for r in edited.collect()} == {k: 32767 if k == (0, 1) else v + 7 for k, v in was.items()}


def test_parts_against_whole_texts(spark):
    """The search by parts finds the path that one search over the whole text finds."""
    d = sample.sample(spark).compiled()
    rng = random.Random(1)
    pieces = ["東京都", "大学", "行く", "アイス", "ー", "カナ", "mega", "特a", "な。な", "x", "a", " ", "12", ",", "三", "hello", "é", "́", "‍", "。", "Ω", "\n", "ぁ"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        t = kernel.Text(text, d.table)
        assert d.in_parts and len(d.segments(text)) >= 1 and "".join(text[b:e] for b, e in d.segments(text)) == text
        got = d.best(t)
        d.in_parts = False
        want = d.best(t)
        d.in_parts = True
        assert got == want


def test_rows_of_morphemes(spark):
    a = Analyzer(sample.sample(spark))
    df = spark.createDataFrame([(1, "é東京都大学、", 0), (2, "", 1), (3, "酒は人", 2)], "id int, text string, at int")
    m = a.analyze("text")
    rows = {r.id: r for r in df.select("id", m.alias("m"), a.pretokenize("text", lambda i, t, m: F.array(i.cast("string"), t, F.size(m).cast("string")), F.col("at")).alias("h"), a.pretokenize("text", lambda m: F.transform(m, lambda x: x["reading_form"])).alias("r"), formats.get(m, -1)["surface"].alias("last"), formats.get(m, 9).alias("none"), formats.cut(m, -2).alias("two"), formats.morpheme_text(m[0]).alias("shown")).where("id <> 2").collect()}
    assert rows[3].h == ["2", "酒は人", "3"] and rows[3].r == ["サケ", "ハ", "ヒト"] and rows[3]["last"] == "人" and rows[3].none is None and [x.surface for x in rows[3].two] == ["は", "人"]
    assert rows[3].shown == "<Morpheme(酒, 0:1, 名詞,普通名詞,一般,*,*,*)>"
    assert [(x.begin_byte, x.end_byte) for x in rows[1].m] == [(0, 2), (2, 17), (17, 20)]
    info = df.where("id = 1").select(F.transform(m, a.word_info).alias("w")).first().w
    assert [w.length for w in info] == [2, 15, 3] and info[1].split_b == [4, 5]
    tokens = a.tokens(df, "text", ["id"])
    parts = a.split(tokens, SplitMode.B, ["id"]).where("id = 1").orderBy("index", "part").collect()
    assert [(r["index"], r.part, r.surface, r.begin, r.end) for r in parts] == [(0, 0, "é", 0, 1), (1, 0, "東京都", 1, 4), (1, 1, "大学", 4, 6), (2, 0, "、", 6, 7)]
    assert a.split(tokens, "A", ["id"], add_single=False).where("id = 3").count() == 0
    with pytest.raises(kernel.NoProvider):
        kernel.Compiled([[]], {}, sample_matrix(), [], sample.sample(spark).compiled().table).analyze("x")


def sample_matrix():
    import numpy as np

    return np.zeros((12, 12), np.int16)


def test_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert spread(one, 1000).rdd.getNumPartitions() == one.rdd.getNumPartitions()


def test_windowed_counts(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{k}:00", t) for k, t in ((0, "酒は人"), (1, "酒"), (7, "大学"))]
    spark.createDataFrame(rows, "ts string, text string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").json(str(tmp_path / "in"))
    a = Analyzer(sample.sample(spark))
    q = windowed_counts(stream, a, "ts", "text", window="5 minutes").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    q.awaitTermination(120)
    got = spark.table("counted").collect()
    assert sum(r[-1] for r in got) == 5
