"""Readers of dictionary sources: lexicon, matrix, character classes, unknown words, rewrite rules, plain lines."""

from __future__ import annotations

import csv
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from morphspark.functions.chars import BITS, mask_of

LEXICON = ("surface", "left_id", "right_id", "cost", "headword", "p1", "p2", "p3", "p4", "p5", "p6", "reading", "normalized", "dictionary", "unit", "split_a", "split_b", "structure", "synonyms")
REQUIRED = 18


class BuildError(ValueError):
    """A source that can't be built. kind names what is wrong, line where."""

    def __init__(self, kind: str, line: int | None = None, detail: str = ""):
        super().__init__(f"{kind}{'' if line is None else f' in line {line}'}{': ' + detail if detail else ''}")
        self.kind, self.line = kind, line


_ESCAPE = re.compile(r"\\u(?:\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4}))")


def unescape(text: str) -> str:
    r"""\uXXXX and \u{...} as the characters they name."""

    def one(m: re.Match) -> str:
        code = int(m[1] or m[2], 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            raise BuildError("bad escape", detail=m[0])
        return chr(code)

    return _ESCAPE.sub(one, text) if "\\u" in text else text


@F.arrow_udf(StringType())
def unescaped(column: pa.Array) -> pa.Array:
    return pa.array([x if x is None else unescape(x) for x in column.to_pylist()], pa.string())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): the lines of text files without their ends; at sorts them as they stand."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    return lines.select("at", "value")


def small_file(spark: SparkSession, path: str) -> list[str]:
    """The lines of a definition file, which has a few thousand at most."""
    whole = spark.read.text(path, wholetext=True).first()
    return [] if whole is None else whole[0].splitlines()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(at, and the 19 fields as text) of a headerless lexicon; at: sorts rows as they stand in the file."""
    schema = StructType([StructField(c, StringType()) for c in LEXICON])
    rows = spark.read.schema(schema).csv(path, header=False, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", nullValue="\x00", comment="\x00", mode="PERMISSIVE")
    return rows.select(F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"), *LEXICON)


def lexicon_rows(spark: SparkSession, lines: list[str] | list[tuple]) -> DataFrame:
    """The same from lines or tuples held in memory."""
    got = csv.reader(lines) if lines and isinstance(lines[0], str) else lines
    rows = [((0, k), *(None if j >= len(r) else str(r[j]) for j in range(len(LEXICON)))) for k, r in enumerate(got)]
    return spark.createDataFrame(rows, "at struct<b: long, i: long>, " + ", ".join(f"{c} string" for c in LEXICON))


def parse_matrix(lines: list[str]) -> tuple[int, int, list[tuple[int, int, int]]]:
    """(lefts, rights, [(left, right, cost)])."""
    size, out = None, []
    for k, line in enumerate(lines, 1):
        if not line.strip():
            continue
        parts = line.split()
        try:
            numbers = [int(x) for x in parts]
        except ValueError as e:
            raise BuildError("bad number", k, line) from e
        if size is None:
            if len(numbers) != 2 or min(numbers) <= 0:
                raise BuildError("bad matrix size", k, line)
            size = numbers
            continue
        if len(numbers) != 3:
            raise BuildError("bad matrix row", k, line)
        if not (0 <= numbers[0] < size[0] and 0 <= numbers[1] < size[1]):
            raise BuildError("connection id out of range", k, line)
        if not -32768 <= numbers[2] <= 32767:
            raise BuildError("cost out of range", k, line)
        out.append(tuple(numbers))
    if size is None:
        raise BuildError("empty matrix")
    return size[0], size[1], out


def read_matrix(spark: SparkSession, path: str) -> tuple[int, int, DataFrame]:
    """(lefts, rights, (left, right, cost)). The entries are read and checked as a table: real matrices have tens of millions."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("x"))
    head = lines.where(F.size("x") == 2).limit(2).collect()
    if len(head) != 1:
        raise BuildError("bad matrix size" if head else "empty matrix")
    n, m = (int(v) for v in head[0].x)
    number = lambda k: F.expr(f"try_cast(x[{k}] as int)")
    rows = lines.where(F.size("x") != 2).select(number(0).alias("left"), number(1).alias("right"), number(2).alias("cost"), F.size("x").alias("n"), F.array_join("x", " ").alias("line"))
    fine = F.coalesce((F.col("n") == 3) & F.col("left").between(0, n - 1) & F.col("right").between(0, m - 1) & F.col("cost").between(-32768, 32767), F.lit(False))
    if bad := rows.where(~fine).select("line").first():
        raise BuildError("bad matrix row", detail=bad[0])
    return n, m, rows.select("left", "right", F.col("cost").cast("short").alias("cost"))


def parse_characters(lines: list[str]) -> tuple[list[tuple[int, int, int]], list[tuple[str, bool, bool, int]]]:
    """(ranges (first, end, mask), categories (name, invoke, group, length))."""
    ranges, kinds = [], {}
    for k, line in enumerate(lines, 1):
        parts = line.split("#", 1)[0].split()
        if not parts:
            continue
        try:
            if parts[0].startswith("0x"):
                lo, _, hi = parts[0].partition("..")
                first, last = int(lo, 16), int(hi or lo, 16)
                if first > last or last > 0x10FFFF or len(parts) < 2:
                    raise ValueError(line)
                ranges.append((first, last + 1, mask_of(parts[1:])))
            else:
                if len(parts) < 4 or parts[0] not in BITS or parts[0] in kinds:
                    raise ValueError(line)
                kinds[parts[0]] = (parts[0], parts[1] == "1", parts[2] == "1", int(parts[3]))
        except ValueError as e:
            raise BuildError("bad character definition", k, line) from e
    return ranges, list(kinds.values())


def parse_unknown(lines: list[str], lefts: int, rights: int) -> list[tuple[str, int, int, int, tuple[str, ...]]]:
    """(category, left, right, cost, class of words)."""
    out = []
    for k, r in enumerate(csv.reader(lines), 1):
        if not r or not "".join(r).strip() or r[0].startswith("#"):
            continue
        if len(r) < 10 or r[0] not in BITS:
            raise BuildError("bad unknown-word row", k)
        try:
            left, right, cost = map(int, r[1:4])
        except ValueError as e:
            raise BuildError("bad number", k) from e
        if not (0 <= left < lefts and 0 <= right < rights and -32768 <= cost <= 32767):
            raise BuildError("connection id out of range", k)
        out.append((r[0], left, right, cost, tuple(r[4:10])))
    return out


def parse_rewrites(lines: list[str]) -> tuple[dict[str, str], set[str]]:
    """(pairs, characters that NFKC leaves alone)."""
    pairs: dict[str, str] = {}
    exempt: set[str] = set()
    for k, line in enumerate(lines, 1):
        parts = line.split()
        if not parts or parts[0].startswith("#"):
            continue
        if len(parts) == 1 and len(parts[0]) == 1 and parts[0] not in exempt:
            exempt.add(parts[0])
        elif len(parts) == 2 and parts[0] not in pairs:
            pairs[parts[0]] = parts[1]
        else:
            raise BuildError("bad rewrite rule", k, line)
    return pairs, exempt
