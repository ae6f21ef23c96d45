"""The command line on small files."""

import csv

from morphspark import cli
from morphspark.sources.sample import USER_WORDS, lexicon, matrix


def test_tokenize(spark, tmp_path):
    (tmp_path / "in.txt").write_text("東京に行く。京都は酒\n\n", encoding="utf-8")
    source = str(tmp_path / "in.txt")
    lines = lambda name: [r.value for r in spark.read.text(str(tmp_path / name)).collect()]
    cli.main(["tokenize", source, str(tmp_path / "w"), "--wakati"], spark)
    assert lines("w") == ["東京 に 行く 。", "京都 は 酒", ""]
    cli.main(["tokenize", source, str(tmp_path / "s"), "--split-sentences", "only"], spark)
    assert lines("s") == ["東京に行く。", "京都は酒", ""]
    cli.main(["tokenize", source, str(tmp_path / "a"), "--all", "--split-sentences", "no"], spark)
    assert lines("a").count("EOS") == 2


def test_build_and_dump(spark, tmp_path):
    n, m, rows = matrix()
    (tmp_path / "matrix").write_text(f"{n} {m}\n" + "\n".join(f"{a} {b} {c}" for a, b, c in rows))
    for name, words in (("lex", lexicon()), ("user", lexicon(USER_WORDS))):
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f).writerows(words)
    cli.main(["build", "--matrix", str(tmp_path / "matrix"), str(tmp_path / "d"), str(tmp_path / "lex")], spark)
    cli.main(["ubuild", "--system", str(tmp_path / "d"), str(tmp_path / "u"), str(tmp_path / "user")], spark)
    cli.main(["dump", str(tmp_path / "d"), "pos", str(tmp_path / "pos")], spark)
    assert spark.read.text(str(tmp_path / "pos")).first().value == "名詞,固有名詞,地名,一般,*,*"
    (tmp_path / "in.txt").write_text("京都府に", encoding="utf-8")
    unknown = '{"unknown": [{"class": "SimpleOov", "oovPOS": ["補助記号", "一般", "*", "*", "*", "*"], "leftId": 10, "rightId": 10, "cost": 7000}]}'
    cli.main(["tokenize", str(tmp_path / "in.txt"), str(tmp_path / "out"), "--dictionary", str(tmp_path / "d"), "--user", str(tmp_path / "u"), "--config", unknown, "--wakati", "--mode", "A"], spark)
    assert spark.read.text(str(tmp_path / "out")).first().value == "京都 府 に"
