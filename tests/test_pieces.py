"""Arrow functions of texts take a batch in pieces: what they hold and give back at once doesn't grow with it."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from morphspark.functions import kernel
from morphspark.functions.chars import default_ranges
from morphspark.operators.analyzer import normalized_text
from morphspark.operators.candidates import begin_places
from morphspark.operators.pieces import BYTES, pieces
from morphspark.plans import queries
from morphspark.sources.sample import sample

SF = "/root/testdata/sf0.001"


def test_pieces_hold_every_row():
    rows = ["a" * 5, None, "", "é" * 4, "b" * 30, "c", None]
    cut = [p.to_pylist() for p in pieces(pa.array(rows, pa.string()), 12)]
    assert cut == [["a" * 5, None, ""], ["é" * 4], ["b" * 30], ["c", None]]
    assert [p.to_pylist() for p in pieces(pa.array(rows, pa.string()).slice(3, 2), 12)] == [["é" * 4], ["b" * 30]]
    assert list(pieces(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("name", ["unknown_candidates", "prefix_candidates", "tokens_documents", "token_counts_by_lang", "token_runs", "wakati_documents", "normalized_documents", "tokens_conversations", "ignore_yomigana", "prolonged_marks", "char_runs", "bow_flags", "sentences"])
def test_batches_in_pieces(spark, monkeypatch, name):
    made, real = [], F.arrow_udf

    def arrow_udf(kind):
        return lambda f: made.append(f) or real(kind)(f)

    monkeypatch.setattr(F, "arrow_udf", arrow_udf)
    queries.QUERIES[name](spark, SF)
    long = "a word, 1 more. " * 512
    rows = [long, None, "", "mega"] * (8 * BYTES // len(long))
    out = list(made[-1](iter([pa.array(rows, pa.string())])))
    assert sum(map(len, out)) == len(rows) and len(out) >= 8
    got = [x for piece in out for x in piece.to_pylist()]
    assert got[:4] * (len(rows) // 4) == got


def test_memory_of_parts_is_bounded(spark, monkeypatch):
    d = sample(spark).compiled()
    monkeypatch.setattr(kernel, "MOST_KEPT", 100)
    d.memo.clear()
    d.kept = 0
    for k in range(200):
        d.analyze("".join(map(chr, (0x4E00 + k, 0x4E80 + k, 0x3042))) + " ")
        assert sum(len(tokens) for got in d.memo.values() for _, tokens in got[2]) == d.kept < 200
    d.memo.clear()
    d.kept = 0


def test_normalized_places(spark):
    got = spark.createDataFrame([("aーーb",), (None,), ("",), ("ab",)], "text string").select(normalized_text(sample(spark), "text").alias("n"))
    assert [r.n and tuple(r.n) for r in got.collect()] == [("aーb", [0, 1, 3, 4]), None, ("", [0]), ("ab", [0, 1, 2])]


def test_two_functions_of_one_text(spark):
    rows = spark.createDataFrame([("ab 1",), (None,), ("",)], "text string")
    got = rows.select(F.size(begin_places(default_ranges(), "text")).alias("a"), F.size(begin_places(default_ranges(), F.upper("text"))).alias("b")).collect()
    assert [tuple(r) for r in got] == [(3, 3), (None, None), (0, 0)]
