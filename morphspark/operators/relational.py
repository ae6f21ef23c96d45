"""The parts of an analysis that are joins and windows: character tables, lookups, connections, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A lexicon of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_WORDS = 200_000


def small(table: DataFrame, most: int = BROADCAST_WORDS) -> DataFrame:
    """The table marked for broadcast if it has at most that many rows, and as it is if it has more."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def chars(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row for each character: the kept columns, i from 0, ch."""
    cols = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    return df.select(*cols, F.posexplode(F.filter(F.split(F.col(f"`{text}`"), ""), lambda c: c != "")).alias("i", "ch"))


def distinct_masks(df: DataFrame, ranges: DataFrame, text: str = "text") -> DataFrame:
    """(ch, code, n, mask) of the distinct characters of a column: the range join is over these alone."""
    found = chars(df, text, []).groupBy("ch").agg(F.count("*").alias("n")).withColumn("code", F.ascii("ch"))
    return found.join(F.broadcast(ranges), (F.col("code") >= F.col("lo")) & (F.col("code") < F.col("hi"))).select("ch", "code", "n", "mask")


def lookup(queries: DataFrame, lexicon: DataFrame, column: str) -> DataFrame:
    """The words whose surface is the value of a column, as it is, without analysis; unindexed words are not found."""
    words = lexicon.where("indexed").withColumnRenamed("surface", "_surface")
    return queries.join(small(words), F.col(f"`{column}`") == F.col("_surface")).drop("_surface")


def word_infos(ids: DataFrame, lexicon: DataFrame, pos: DataFrame, column: str = "word_id") -> DataFrame:
    """Rows with a word id, and the word's forms by name, empty ones filled in, its dictionary form found in the same table."""
    lex = lexicon.select(F.col("word_id").alias(column), "headword", "pos_id", "reading", "normalized", "dic_form_word_id", "split_a", "split_b", "structure", "synonyms")
    base = lexicon.select(F.col("word_id").alias("dic_form_word_id"), F.col("headword").alias("base"))
    fill = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.col("headword")).otherwise(F.col(c))
    rows = ids.join(small(lex), column).join(small(base), "dic_form_word_id", "left").join(F.broadcast(pos), "pos_id")  # at most 32,767 classes
    return rows.select(*ids.columns, "headword", "pos_id", *[f"p{k}" for k in range(1, 7)], fill("base").alias("dictionary_form"), fill("normalized").alias("normalized_form"), fill("reading").alias("reading_form"), "split_a", "split_b", "structure", "synonyms")


def connect(pairs: DataFrame, conn: DataFrame) -> DataFrame:
    """Rows of (right_id of the left word, left_id of the right word) with the cost of their connection."""
    return pairs.join(conn.select(F.col("left").alias("right_id"), F.col("right").alias("left_id"), F.col("cost").alias("connection")), ["right_id", "left_id"])


def split_tokens(tokens: DataFrame, lexicon: DataFrame, mode: str, key: list[str], at_least: int = 2, add_single: bool = True) -> DataFrame:
    """The parts of tokens in mode A or B: (key, part, begin, end, word_id), begin and end in characters of the text.

    tokens: key, begin, end, word_id. Parts go on by the length of their words,
    the last has the rest. Tokens of fewer than at_least parts stay whole, or
    fall out without add_single.
    """
    column = {"A": "split_a", "B": "split_b"}[mode.upper()]
    units = lexicon.select("word_id", F.col(column).alias("_units"))
    sizes = lexicon.select(F.col("word_id").alias("_part"), F.length("surface").alias("_n"))
    have = tokens.join(small(units), "word_id", "left").withColumn("_units", F.coalesce("_units", F.array().cast("array<bigint>")))
    many = F.size("_units") >= at_least
    whole = have.where(~many).select(*key, F.lit(0).alias("part"), "begin", "end", "word_id") if add_single else None
    parts = have.where(many).withColumn("_last", F.size("_units") - 1).select(*key, "begin", "end", "_last", F.posexplode("_units").alias("part", "_part")).join(small(sizes), "_part")
    w = Window.partitionBy(*key).orderBy("part")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("_b", F.col("begin") + before)
    out = placed.select(*key, "part", F.col("_b").cast("int").alias("begin"), F.when(F.col("part") == F.col("_last"), F.col("end")).otherwise(F.col("_b") + F.col("_n")).cast("int").alias("end"), F.col("_part").alias("word_id"))
    return out if whole is None else whole.unionByName(out)


def too_long(text: Column | str, most: int) -> Column:
    """Whether a text has more bytes than one analysis takes."""
    return F.octet_length(text if isinstance(text, Column) else F.col(f"`{text}`")) > most


def prolonged_text(text: Column | str, marks: str = "ー\\-〜", symbol: str = "ー") -> Column:
    """The text with runs of prolonged sound marks as one, without offsets."""
    return F.regexp_replace(text, f"[{marks}]{{2,}}", symbol)


def without_readings(text: Column | str, longest: int = 4) -> Column:
    """The text without bracketed kana after kanji, without offsets."""
    return F.regexp_replace(text, f"([一-鿿々])[(（][ぁ-ゟァ-ヿ]{{1,{longest}}}[)）]", "$1")
