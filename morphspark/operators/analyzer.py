"""Analysis of text columns: morphemes, sentences, pre-tokens and number forms as columns and as rows.

All are scalar Arrow functions, so unused ones drop out of a plan, filters on
other columns go below them and scans stay narrow. A struct holds only the
fields asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import StrEnum
from inspect import signature

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from morphspark.functions import kernel, numbers, sentences
from morphspark.functions.normalize import MAX_BYTES, InputTooLong
from morphspark.sources.config import PROJECTIONS, ConfigError
from morphspark.sources.dictionary import Dictionary

from . import relational
from .pieces import text_function
from .projection import projected

_TEXT, _IDS = pa.string(), pa.list_(pa.int64())
#: field: Spark type, Arrow type, value of (buffer, token, dictionary)
_FORM = lambda k: lambda b, x, d: x[7][k] or x[7][0]


def _dictionary_id(b, x, d) -> int:
    return -1 if x[5] >> 28 == 15 else x[5] >> 28


FIELDS: dict[str, tuple[str, pa.DataType, Callable]] = {
    "begin": ("int", pa.int32(), lambda b, x, d: b.place(x[0])),
    "end": ("int", pa.int32(), lambda b, x, d: b.place(x[1])),
    "begin_byte": ("int", pa.int32(), lambda b, x, d: len(b.original[: b.place(x[0])].encode("utf-8", "surrogatepass"))),
    "end_byte": ("int", pa.int32(), lambda b, x, d: len(b.original[: b.place(x[1])].encode("utf-8", "surrogatepass"))),
    "surface": ("string", _TEXT, lambda b, x, d: b.original[b.place(x[0]) : b.place(x[1])]),
    "word_id": ("bigint", pa.int64(), lambda b, x, d: x[5]),
    "dictionary_id": ("int", pa.int32(), _dictionary_id),
    "is_oov": ("boolean", pa.bool_(), lambda b, x, d: x[5] >> 28 == 15),
    "pos_id": ("int", pa.int32(), lambda b, x, d: x[7][2]),
    "pos": ("array<string>", pa.list_(_TEXT), None),
    "dictionary_form": ("string", _TEXT, _FORM(4)),
    "normalized_form": ("string", _TEXT, _FORM(3)),
    "reading_form": ("string", _TEXT, _FORM(5)),
    "synonym_group_ids": ("array<int>", pa.list_(pa.int32()), lambda b, x, d: x[7][9]),
    "split_a": ("array<bigint>", _IDS, lambda b, x, d: x[7][6]),
    "split_b": ("array<bigint>", _IDS, lambda b, x, d: x[7][7]),
    "word_structure": ("array<bigint>", _IDS, lambda b, x, d: x[7][8]),
    "head_word_length": ("int", pa.int32(), lambda b, x, d: x[7][1]),
    "total_cost": ("int", pa.int32(), lambda b, x, d: x[6]),
    "left_id": ("int", pa.int32(), lambda b, x, d: x[2]),
    "right_id": ("int", pa.int32(), lambda b, x, d: x[3]),
    "cost": ("int", pa.int32(), lambda b, x, d: x[4]),
}
#: The same over many tokens at once.
_FAST = {
    "word_id": lambda t: [x[5] for x in t],
    "is_oov": lambda t: [x[5] >> 28 == 15 for x in t],
    "pos_id": lambda t: [x[7][2] for x in t],
    "normalized_form": lambda t: [x[7][3] or x[7][0] for x in t],
    "total_cost": lambda t: [x[6] for x in t],
}


def _places(k: int) -> Callable:
    return lambda b, t: [x[k] for x in t] if b.origin is None else [b.origin[x[k]] for x in t]


def _bytes_before(k: int) -> Callable:
    """Byte places in the original: of ASCII texts the characters'."""

    def run(b, t) -> list[int]:
        at = _places(k)(b, t)
        if b.original.isascii():
            return at
        size = [0]
        for ch in b.original:
            size.append(size[-1] + len(ch.encode("utf-8", "surrogatepass")))
        return [size[i] for i in at]

    return run


def _surfaces(b, t) -> list[str]:
    s, o = b.original, b.origin
    return [s[x[0] : x[1]] for x in t] if o is None else [s[o[x[0]] : o[x[1]]] for x in t]


_IN_TEXT = {"begin": _places(0), "end": _places(1), "begin_byte": _bytes_before(0), "end_byte": _bytes_before(1), "surface": _surfaces}
BASIC = ("begin", "end", "surface", "pos_id", "is_oov")
WORD_INFO = ("surface", "head_word_length", "pos_id", "normalized_form", "dictionary_form", "reading_form", "split_a", "split_b", "word_structure", "synonym_group_ids")
#: What a surface projection needs besides.
_NEEDS = {"normalized": ("normalized_form",), "reading": ("reading_form",), "dictionary": ("dictionary_form",), "dictionary_and_surface": ("dictionary_form", "pos"), "normalized_and_surface": ("normalized_form", "pos"), "normalized_nouns": ("normalized_form", "pos")}
MODES = ("A", "B", "C")


class SplitMode(StrEnum):
    """Short, middle and long units; wherever a mode is asked for, its letter does too."""

    A, B, C = MODES


def spread(df: DataFrame, files: int | None = None) -> DataFrame:
    """The rows over all cores where a table has fewer files than there are cores: one row group is one task, however long. A table of more files is left as it is, without a shuffle."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = len(df.inputFiles()) if files is None else files
    return df.repartition(4 * cores) if few < cores else df


def struct_array(rows: list[tuple | None], fields: tuple[str, ...], dictionary: kernel.Compiled) -> pa.Array:
    """An Arrow list of structs for each (buffer, tokens); null for None."""
    sizes, buffers, flat = [], [], []
    for r in rows:
        sizes.append(None if r is None else len(flat))
        if r is not None and r[1]:
            buffers.append((r[0], len(flat), len(flat) + len(r[1])))
            flat += r[1]
    columns = []
    for name in fields:
        kind, of = FIELDS[name][1:]
        if name == "pos":
            columns.append(pa.array([list(p) for p in dictionary.pos], kind).take(pa.array([x[7][2] for x in flat], pa.int32())))
        elif name in _FAST:
            columns.append(pa.array(_FAST[name](flat), kind))
        elif name in _IN_TEXT:
            values: list = []
            for b, i, j in buffers:
                values += _IN_TEXT[name](b, flat[i:j])
            columns.append(pa.array(values, kind))
        else:
            columns.append(pa.array([of(None, x, dictionary) for x in flat], kind))
    inner = pa.StructArray.from_arrays(columns, list(fields))
    return pa.ListArray.from_arrays(pa.array([*sizes, len(flat)], pa.int32()), inner)


class Analyzer:
    """Analysis with one dictionary, mode and choice of fields.

    mode: A, B or C, short to long units. fields: of FIELDS; None for all.
    on_error: "raise" or "null", for texts beyond max_bytes and without a path.
    max_bytes: None for texts of any length. projection: what surface() gives;
    the dictionary's if not given here.
    """

    def __init__(self, dictionary: Dictionary, mode: str = "C", fields: tuple[str, ...] | list[str] | None = None, projection: str | None = None, on_error: str = "raise", max_bytes: int | None = MAX_BYTES):
        if mode.upper() not in MODES:
            raise ConfigError(f"no such mode: {mode}")
        self.projection = projection or dictionary.config.projection
        if self.projection not in PROJECTIONS:
            raise ConfigError(f"no such projection: {self.projection}")
        if on_error not in ("raise", "null"):
            raise ConfigError("on_error is raise or null")
        if fields is not None and (odd := [f for f in fields if f not in FIELDS]):
            raise ConfigError(f"no such fields: {odd}")
        wanted = set(FIELDS if fields is None else fields) | set(BASIC) | set(_NEEDS.get(self.projection, ()))
        self.fields = tuple(f for f in FIELDS if f in wanted)
        self.dictionary, self.mode, self.on_error, self.max_bytes = dictionary, mode.upper(), on_error, max_bytes
        self.type = "array<struct<" + ", ".join(f"`{f}`: {FIELDS[f][0]}" for f in self.fields) + ">>"

    def analyze(self, text: Column | str) -> Column:
        """array<struct> of the morphemes of each text; null of null, empty of empty."""
        held, mode, fields, null_errors, most = self.dictionary.broadcast(), self.mode, self.fields, self.on_error == "null", self.max_bytes

        @text_function(self.type)
        def run(texts: list[str | None]) -> pa.Array:
            d = held.value
            rows: list[tuple | None] = []
            for x in texts:
                try:
                    rows.append(None if x is None else d.analyze(x, mode, most))
                except (InputTooLong, kernel.AnalysisError):
                    if not null_errors:
                        raise
                    rows.append(None)
            return struct_array(rows, fields, d)

        return run(text if isinstance(text, Column) else F.col(f"`{text}`"))

    def tokens(self, df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """A row for each morpheme: the kept columns (all by default), its number from 0 and its fields. Texts without any have none."""
        cols = df.columns if keep is None else keep
        exploded = df.select(*[F.col(f"`{c}`") for c in cols], F.posexplode(self.analyze(text)).alias("index", "m"))
        return exploded.select(*[F.col(f"`{c}`") for c in cols], "index", *[F.col(f"m.{f}").alias(f) for f in self.fields])

    def surface(self, text: Column | str, projection: str | None = None) -> Column:
        """array<string>: the projected surfaces."""
        return F.transform(self.analyze(text), lambda m: projected(m, projection or self.projection))

    def pretokenize(self, text: Column | str, handler: Callable[..., Column] | None = None, index: Column | int = 0) -> Column:
        """array<string> of pre-tokens. handler(index, text, morphemes) makes them of the number of the piece in its text, the piece and its morphemes; one of a single parameter has the morphemes alone."""
        if handler is None:
            return self.surface(text)
        column, m = text if isinstance(text, Column) else F.col(f"`{text}`"), self.analyze(text)
        if len(signature(handler).parameters) == 1:
            return handler(m)
        return handler(index if isinstance(index, Column) else F.lit(index), column, m)

    def split(self, tokens: DataFrame, mode: str, key: list[str], add_single: bool = True) -> DataFrame:
        """Morpheme rows of tokens() split further: key, index, part, begin, end, surface, word_id.

        tokens must have surface and word_id besides the key. A morpheme of one part or
        more is split; one without stays as part 0, or falls out without
        add_single. Places are those of the original text, if nothing in it was
        rewritten to another length.
        """
        lex = self.dictionary.table("lexicon")
        rows = tokens.select(*[F.col(f"`{c}`") for c in key], "index", "begin", "end", "word_id", F.col("surface").alias("_surface"), F.col("begin").alias("_from"))
        parts = relational.split_tokens(rows, lex, mode, [*key, "index"], 1, add_single)
        return parts.join(rows.select(*key, "index", "_surface", "_from"), [*key, "index"]).select(*key, "index", "part", "begin", "end", F.expr("substring(_surface, begin - _from + 1, end - begin)").alias("surface"), "word_id")

    def word_info(self, m: Column) -> Column:
        """What a morpheme struct says of its word: all forms, classes, parts and the length of its surface in bytes of the normalised text."""
        odd = [f for f in WORD_INFO if f not in self.fields]
        if odd:
            raise ConfigError(f"fields are missing: {odd}")
        return F.struct(*[m[f].alias(f) for f in WORD_INFO], m["head_word_length"].alias("length"))

    def internal_cost(self, text: Column | str) -> Column:
        """Cost of the path without its first morpheme; 0 of an empty text."""
        m = self.analyze(text)
        return F.when(F.size(m) > 0, F.element_at(m, -1)["total_cost"] - m[0]["total_cost"]).when(m.isNotNull(), 0)

    def sentences(self, text: Column | str, check_words: bool = True, limit: int = sentences.LIMIT) -> Column:
        return split_sentences(text, self.dictionary if check_words else None, limit)

    def sentence_tokens(self, df: DataFrame, text: str = "text", split: str = "yes") -> DataFrame:
        """Rows of morphemes by sentence. split: yes, no (a text is one sentence) or only (sentences themselves)."""
        if split not in ("yes", "no", "only"):
            raise ConfigError("split is yes, no or only")
        whole = F.array(F.struct(F.lit(0).alias("begin"), F.length(text).alias("end"), F.col(f"`{text}`").alias("text")))
        rows = df.select("*", F.posexplode(whole if split == "no" else self.sentences(text)).alias("sentence", "s"))
        if split == "only":
            return rows.select(*df.columns, "sentence", "s.begin", "s.end", F.col("s.text").alias("sentence_text"))
        named = rows.select(*df.columns, "sentence", F.col("s.begin").alias("sentence_begin"), F.col("s.text").alias("sentence_text"))
        return self.tokens(named, "sentence_text")

    def lattice(self, text: Column | str) -> Column:
        """array<struct> of all lattice nodes of a text, for looking into an analysis."""
        held, most = self.dictionary.broadcast(), self.max_bytes
        names = ("begin", "end", "left_id", "right_id", "cost", "word_id", "total_cost")

        @text_function("array<struct<`begin`: int, `end`: int, left_id: int, right_id: int, cost: int, word_id: bigint, total_cost: int>>")
        def run(texts: list[str | None]) -> pa.Array:
            d, out = held.value, []
            for x in texts:
                b = None if x is None else d.prepare(x, most)
                out.append(None if b is None else [dict(zip(names, n[:7])) for e in d.lattice(kernel.Text(b.text, d.table))[1:] for n in e or ()] if b.text else [])
            return pa.array(out, pa.list_(pa.struct([(n, pa.int64() if n == "word_id" else pa.int32()) for n in names])))

        return run(text if isinstance(text, Column) else F.col(f"`{text}`"))


def normalized_text(dictionary: Dictionary, text: Column | str, max_bytes: int | None = MAX_BYTES) -> Column:
    """struct<text, origin>: the normalised text and each character's place in the original, the end's too."""
    held = dictionary.broadcast()

    @text_function("struct<text: string, origin: array<int>>")
    def run(texts: list[str | None]) -> pa.Array:
        out, origins, ends = [], [], [0]
        for x in texts:
            b = None if x is None else held.value.prepare(x, max_bytes)
            out.append(None if b is None else b.text)
            if b is not None:
                origins.append(np.arange(len(b.text) + 1, dtype=np.int32) if b.origin is None else np.array(b.origin, np.int32))
            ends.append(ends[-1] + (0 if b is None else len(origins[-1])))
        origin = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(origins) if origins else [], pa.int32()))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), origin], ["text", "origin"], mask=pa.array([x is None for x in out], pa.bool_()))

    return run(text if isinstance(text, Column) else F.col(f"`{text}`"))


def split_sentences(text: Column | str, dictionary: Dictionary | None = None, limit: int = sentences.LIMIT) -> Column:
    """array<struct<begin, end, text>> of the sentences; null of null."""
    held = None if dictionary is None else dictionary.broadcast()

    @text_function("array<struct<`begin`: int, `end`: int, text: string>>")
    def run(column: list[str | None]) -> pa.Array:
        d, sizes, begins, ends, texts = None if held is None else held.value, [], [], [], []
        for x in column:
            sizes.append(None if x is None else len(begins))
            for b, e in sentences.spans(x, d, limit) if x else ():
                begins.append(b)
                ends.append(e)
                texts.append(x[b:e])
        inner = pa.StructArray.from_arrays([pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())], ["begin", "end", "text"])
        return pa.ListArray.from_arrays(pa.array([*sizes, len(begins)], pa.int32()), inner)

    return run(text if isinstance(text, Column) else F.col(f"`{text}`"))


@F.arrow_udf(StringType())
def normalize_number(column: pa.Array) -> pa.Array:
    """The plain decimal of texts that are numbers as a whole; null of others."""
    return pa.array([numbers.normalize_number(x) for x in column.to_pylist()], pa.string())


def register_sql(analyzer: Analyzer, name: str = "tokens") -> None:
    """A table function for SQL: SELECT ... FROM documents, LATERAL tokens(text)."""
    from pyspark.sql.functions import udtf

    held, mode, most, fields = analyzer.dictionary.broadcast(), analyzer.mode, analyzer.max_bytes, analyzer.fields
    kinds = ", ".join(f"`{f}` {FIELDS[f][0]}" for f in fields)

    class Tokens:
        def eval(self, text: str):
            d = held.value
            if not text:
                return
            b, path = d.analyze(text, mode, most)
            for k, x in enumerate(path):
                yield (k, *[list(d.pos[x[7][2]]) if f == "pos" else (list(v) if isinstance(v := FIELDS[f][2](b, x, d), tuple) else v) for f in fields])

    analyzer.dictionary.spark.udtf.register(name, udtf(Tokens, returnType=f"index int, {kinds}"))
